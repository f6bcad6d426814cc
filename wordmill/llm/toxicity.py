"""Toxicity from subword-bag embeddings under a linear softmax.

A word is the mean of the vectors of its hashed character n-grams (and of the word itself, hashed
alike); a document is the mean over its word occurrences; a linear softmax over the two classes
reads it. Vectors and softmax are trained jointly in numpy. An unseen misspelling shares most
n-grams, and so most of its vector, with the word it stands for.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, id_type

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
SIZE = 8
#: Brings the mean over a document's words to the softmax's scale.
GAIN = 40.0
#: Learning rate, and the length that a step takes off every vector in terms of it.
RATE = 0.03
SHRINK = 1.0
#: Buckets in fewer texts than this share of the sample, or in one text alone, teach nothing.
LEAST_SHARE = 1 / 400
#: The most labelled documents of each class (0, 1) that the model is fitted on.
SAMPLE_PER_CLASS = (1800, 1200)
THRESHOLD = 0.7
#: Texts that training sees, repeats included; a small sample is seen more often.
TEXTS_SEEN = 24_000
#: Words that a worker remembers the score of before it starts anew, and how much text it takes at once.
REMEMBERED = 200_000
CHARACTERS_AT_ONCE = 1_000_000
#: Fixed value: what is cut off a word's ends.
EDGES = ".,;:!?\"'()[]{}<>*#$%&|"


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every lower-case word itself and of its n-grams of 3 to 5 characters, ends marked."""
    marked = [f"<{w.strip(EDGES)}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(marked)), size)
    left = ends[owner] - np.arange(len(code))  # characters from here to the word's end
    prime = np.uint64(0x100000001B3)
    rolled = code.copy()
    place = (size[owner] - left).astype(np.uint64)
    spread = (code + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + prime)
    hashes, owners = [np.add.reduceat(spread * (spread >> np.uint64(7) | np.uint64(1)), ends - size)] if len(marked) else [], [np.arange(len(marked))]
    for n in range(2, 6):
        rolled = rolled[:-1] * prime + code[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n > 2:
            whole = left[: len(rolled)] >= n
            hashes.append(rolled[whole] + np.uint64(n))
            owners.append(owner[: len(rolled)][whole])
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (np.concatenate(hashes) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
    return mixed.astype(np.int64), np.concatenate(owners)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and each one's share of the document vector."""
    counts = Counter(words_of(text))
    index, owner = grams(list(counts))
    times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    own = np.bincount(owner, minlength=len(counts))
    found, where = np.unique(index, return_inverse=True)
    share = (times / np.maximum(own, 1) / max(times.sum(), 1))[owner]
    return found.astype(np.int32), np.bincount(where, weights=share, minlength=len(found)).astype(np.float32)


def _packed(index: np.ndarray, share: np.ndarray) -> bytes:
    """A bag in a few bytes: one task holds all of the sample's."""
    gaps = np.diff(index, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor().compress(np.ascontiguousarray(gaps).tobytes() + share.astype("<f4").tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // 8
    gaps = np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T
    return np.cumsum(np.ascontiguousarray(gaps).view("<u4").ravel()).astype(np.int32), np.frombuffer(raw, "<f4", n, 4 * n)


@dataclass
class Model:
    """Trained vectors and softmax; score() needs only their product, one number for a bucket."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def bucket_logits(self) -> np.ndarray:
        return GAIN * (self.vectors.astype(np.float64) @ (self.weights[:, 1] - self.weights[:, 0]))

    def bias_logit(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int | None = None, seed: int = 7) -> Model:
    """Joint training of vectors and softmax on the class-balanced cross entropy; without both classes, a constant model.

    The list of bags is used up.

    Buckets count by their inverse document frequency, those in too few texts (LEAST_SHARE) not at all. Adam steps alternate with shrinking every vector's length (a group lasso): vectors that
    carry no signal go to zero, which is what keeps rare n-grams from learning single texts by heart.
    """
    epochs = epochs or int(np.clip(TEXTS_SEEN // max(1, len(bags)), 8, 60))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.1 / SIZE, 0.1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    weights = rng.normal(0, 1, (SIZE, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    labels = np.asarray(labels, dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        toxic = len(labels) > 0 and bool(labels[0])
        return Model(vectors * 0, weights * 0, np.array([0.0, 2.0 if toxic else -2.0], np.float32))
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for index, _ in bags:
        seen[index] += 1
    rarity = np.where(seen >= max(2, LEAST_SHARE * len(bags)), np.log((1 + len(bags)) / (1 + seen)), 0).astype(np.float32)
    used = np.flatnonzero(rarity)
    place = np.zeros(BUCKETS, dtype=np.int32)
    place[used] = np.arange(len(used))
    for n, (index, share) in enumerate(bags):  # in place: one copy of the sample is held
        share = share * rarity[index]
        bags[n] = place[index[share > 0]], share[share > 0]
    vectors = vectors[used]
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, weights, bias)]
    step, batch = 0, 64
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            index = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            held = vectors[index] * share[:, None]
            hidden = GAIN * np.stack([np.bincount(owner, held[:, k], len(rows)) for k in range(SIZE)], axis=1)
            logits = hidden @ weights + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(rows)), labels[rows]] -= 1
            chance *= balance[rows][:, None] / len(rows)
            back = (GAIN * (chance @ weights.T))[owner] * share[:, None]
            slope = np.stack([np.bincount(index, back[:, k], len(used)) for k in range(SIZE)], axis=1)
            step += 1
            for (first, second), p, g in zip(
                state, (vectors, weights, bias), (slope, hidden.T @ chance + 1e-4 * weights, chance.sum(axis=0)), strict=True
            ):
                first += 0.1 * (g - first)
                second += 0.01 * (g * g - second)
                p -= (rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)).astype(p.dtype)
            length = np.sqrt((vectors * vectors).sum(axis=1))
            vectors *= np.maximum(0, 1 - rate * SHRINK / (length + 1e-12))[:, None].astype(np.float32)
    every = np.zeros((BUCKETS, SIZE), np.float32)
    every[used] = vectors * rarity[used][:, None]
    return Model(every, weights, bias)


_logits: dict[str, np.ndarray] = {}
_known: dict[str, dict[str, float]] = {}


def _learn(words: set[str], table: np.ndarray, known: dict[str, float]) -> None:
    new = list(words.difference(known))
    if new:
        index, owner = grams(new)
        values = np.bincount(owner, weights=table[index], minlength=len(new)) / np.bincount(owner, minlength=len(new))
        known.update(zip(new, values.tolist(), strict=True))


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    """Chance of the toxic class for whole texts; a text without words has the bias's."""
    if model.key not in _logits:
        _logits.clear()
        _known.clear()
        _logits[model.key] = model.bucket_logits()
        _known[model.key] = {}
    table, known = _logits[model.key], _known[model.key]
    out = np.full(len(texts), model.bias_logit())
    at = 0
    while at < len(texts):
        part: list[list[str]] = []
        size = 0
        while at + len(part) < len(texts) and size < CHARACTERS_AT_ONCE:
            part.append(words_of(texts[at + len(part)]))
            size += len(texts[at + len(part) - 1] or "")
        if len(known) > REMEMBERED:
            known.clear()
        _learn(set().union(*part), table, known)
        for i, words in enumerate(part, at):
            if words:
                out[i] += sum(map(known.__getitem__, words)) / len(words)
        at += len(part)
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def is_held_out(id_col: str) -> F.Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, y): at most per_class[y] labelled, not held-out texts of each class y, chosen by id hash."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("key")).agg(F.max(label).cast("int").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(per_class[y]) for y in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # the sum of per_class rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(picked, F.col("id") == F.col("key"))
    return rows.groupBy("id", "y").agg(F.min("t").alias("t"))


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of labels.toxic, fitted on a bounded sample of rows that are not held out."""

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                yield pd.DataFrame({"id": part["id"].astype(str), "y": part["y"], "b": [_packed(*bag(t)) for t in part["t"]]})

    sample = labelled_sample(docs, labels, "toxic", per_class, id_col, text_col)

    def learn(rows: pd.DataFrame) -> Model:
        rows = rows.sort_values(["id", "y"])
        return train([_unpacked(b) for b in rows["b"]], rows["y"].to_numpy(np.int64))

    return fitted(sample.mapInPandas(bags, "id string, y int, b binary"), learn)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs.

    Null and empty texts get the score of the bias alone; very long ones are scored whole. A score at the
    threshold is predicted toxic. Repeated rows are scored each; other columns of docs are not read.
    """
    kind = id_type(docs, id_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x SIZE floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": score_texts(batch["t"].tolist(), sent.value)})

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col), is_held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def reject_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold; cases are those of toxicity().

    Null and empty texts stay unless the bias alone is toxic.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), sent.value))

    return docs.where(score(F.col(text_col)) < threshold)
