"""Quality rules, and a linear-chain conditional random field over a document's lines.

Base statistics come first (words, symbols, repeated lines, words in repeated windows) with two
rules. Then every line with a word is labelled content or boilerplate by Viterbi decoding; the share
of words that stand in content lines decides whether the document is kept.

Only documents are labelled, so the labels of lines are latent: a good text is taken to hold mostly
content lines and a poor one few, and expectation maximisation under these bounds finds which.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, id_type
from .toxicity import labelled_sample

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
CONTENT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: The most labelled documents of each quality class (0, 1) that the field is fitted on, with all their lines, and the lines of one sequence.
SAMPLE_PER_CLASS = (1500, 1500)
LINES_AT_ONCE = 64
#: Expected share of content lines that a good text has at least, and a poor one at most.
GOOD_SHARE, POOR_SHARE = 0.9, 0.3
FEATURES = (
    "bias", "log words", "pipes", "symbols", "exclamations", "digits", "all capitals", "small start", "sentence end",
    "one word", "few words", "repeated words", "same neighbours", "seen before", "first line", "last line", "word length",
)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by windows of WINDOW words that stand in the text more than once, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    # windows of 2, 4 and 8 words get equal numbers if and only if they are equal
    width = 1
    while width < WINDOW:
        pair = code[:-width] * np.int64(code.max() + 1) + code[width:]
        _, code = np.unique(pair, return_inverse=True)
        width *= 2
    starts = np.flatnonzero(np.bincount(code)[code] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) of the lines that have a word, in order."""
    rows, counts = [], []
    seen: set[str] = set()
    kept = [x for x in lines if x.strip(BLANKS)]
    for i, line in enumerate(kept):
        words = line.split()
        n = len(words) or 1
        bare = line.strip()
        digits = sum(map(line.count, "0123456789"))
        rows.append((
            1.0,
            np.log1p(n) / 4,
            min(1.0, line.count("|") / n * 2),
            min(1.0, sum(map(line.count, "#*$%&<>")) / n),
            min(1.0, line.count("!!") / n * 2),
            min(1.0, digits / max(len(line), 1) * 5),
            float(bare.upper() == bare and bare.lower() != bare),
            float(bare[:1].islower()),
            float(bare[-1:] in ".!?"),
            float(n == 1),
            float(1 < n < 5),
            1 - len(set(words)) / n,
            sum(map(eq, words, words[1:])) / n,
            float(line in seen),
            float(i == 0),
            float(i == len(kept) - 1),
            min(2.0, len(bare) / n / 8),
        ))
        seen.add(line)
        counts.append(len(words))
    return np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES)), np.array(counts, dtype=np.int64)


@dataclass
class Field:
    """Weights of the features of content (over boilerplate), of the steps between labels and of the first label."""

    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels (1: content) of a sequence of lines."""
        if not len(features):
            return np.zeros(0, dtype=np.int64)
        gains = (features @ self.weights).tolist()
        (bb, bc), (cb, cc) = self.steps.tolist()
        b, c = float(self.first[0]), float(self.first[1]) + gains[0]
        came: list[tuple[int, int]] = [(0, 0)]
        for g in gains[1:]:
            from_b = int(c + cb > b + bb), int(c + cc >= b + bc)
            b, c = max(b + bb, c + cb), max(b + bc, c + cc) + g
            came.append(from_b)
        label = int(c >= b)
        out = [label]
        for back in reversed(came[1:]):
            label = back[label]
            out.append(label)
        return np.array(out[::-1], dtype=np.int64)


class _Sequences:
    """Padded sequences, and the expectations of a field over them."""

    def __init__(self, pieces: list[np.ndarray]) -> None:
        self.size = np.array([len(x) for x in pieces])
        self.longest = int(self.size.max())
        self.live = np.arange(self.longest)[None, :] < self.size[:, None]
        self.x = np.zeros((len(pieces), self.longest, len(FEATURES)))
        for row, piece in zip(self.x, pieces, strict=True):
            row[: len(piece)] = piece

    def expected(self, gain: np.ndarray, steps: np.ndarray, start: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chance of content for each line, expected steps weighted by the sequences' shares) by forward-backward sums.

        gain is what content scores over boilerplate at each line.
        """
        n = len(self.x)
        two = np.zeros((n, self.longest, 2))
        two[:, :, 1] = gain
        ahead = np.zeros_like(two)
        ahead[:, 0] = start + two[:, 0]
        for t in range(1, self.longest):
            new = np.logaddexp(ahead[:, t - 1, :1] + steps[0], ahead[:, t - 1, 1:] + steps[1]) + two[:, t]
            ahead[:, t] = np.where(self.live[:, t, None], new, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        behind = np.zeros_like(two)
        hops = np.zeros(4)
        for t in range(self.longest - 2, -1, -1):
            after = two[:, t + 1] + behind[:, t + 1]
            on = self.live[:, t + 1]
            joint = np.exp(np.minimum(ahead[:, t, :, None] + steps[None] + after[:, None, :] - total[:, None, None], 0))
            hops += (joint * (on * share)[:, None, None]).sum(axis=0).ravel()
            new = np.logaddexp(steps[:, 0] + after[:, :1], steps[:, 1] + after[:, 1:])
            behind[:, t] = np.where(on[:, None], new, 0)
        chance = np.exp(np.minimum(ahead[:, :, 1] + behind[:, :, 1] - total[:, None], 0)) * self.live
        return chance, hops


class _Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.value, self.first, self.second = (np.zeros(size) for _ in range(3))
        self.rate, self.turn = rate, 0

    def step(self, slope: np.ndarray) -> None:
        self.turn += 1
        self.first += 0.1 * (slope - self.first)
        self.second += 0.01 * (slope * slope - self.second)
        self.value -= self.rate * (self.first / (1 - 0.9**self.turn)) / (np.sqrt(self.second / (1 - 0.99**self.turn)) + 1e-9)


def spread(features: np.ndarray) -> list[np.ndarray]:
    """All lines of one text, as sequences of LINES_AT_ONCE lines."""
    return [features[i : i + LINES_AT_ONCE] for i in range(0, len(features), LINES_AT_ONCE)]


def train(sequences: list[tuple[np.ndarray, int]], rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """A field from the lines of labelled texts (1: good), whose lines have no labels of their own.

    The first guess is a line by line one, from the text's label. Then, in turns, the chances of the
    lines' labels are found under bounds (content is GOOD_SHARE of a good sequence at least, POOR_SHARE
    of a poor one at most, each kept by a multiplier of its own), and the field steps towards them: Adam
    on the difference of forward-backward expectations with and without the bounds. Each text counts
    once, however many lines it has. Without both classes every line is the one class (content if none).
    """
    k = len(FEATURES)
    labels = {y for _, y in sequences}
    if len(labels) < 2:
        bias = np.zeros(k)
        bias[0] = -5.0 if labels == {0} else 5.0
        return Field(bias, np.zeros((2, 2)), np.zeros(2))
    pieces = [(piece, y, 1 / len(x)) for x, y in sequences for piece in spread(x)]
    held = _Sequences([x for x, _, _ in pieces])
    y = np.array([label for _, label, _ in pieces])
    share = np.array([s for _, _, s in pieces])
    share *= np.where(y == 1, 0.5 / (y * share * held.size).sum(), 0.5 / ((1 - y) * share * held.size).sum())
    fit = _Adam(k + 6, rate)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-held.x @ fit.value[:k])) * held.live
        slope = ridge * fit.value
        slope[:k] += np.einsum("nt,ntk->k", (chance - y[:, None] * held.live) * share[:, None], held.x)
        fit.step(slope)
    # the line by line guess took ordinary lines of poor texts for poor: their multipliers settle that
    bound, sign = np.where(y == 1, GOOD_SHARE, POOR_SHARE), np.where(y == 1, 1.0, -1.0)
    push = np.zeros(len(y))
    goal_chance = goal_hops = None
    for turn in range(rounds):
        w, steps, start = fit.value[:k], fit.value[k : k + 4].reshape(2, 2), fit.value[k + 4 :]
        gain = held.x @ w
        if turn % 4 == 0:
            goal_chance, goal_hops = held.expected(gain + push[:, None], steps, start, share)
            missing = bound - goal_chance.sum(axis=1) / held.size
            push = sign * np.clip(sign * (push + 4.0 * missing), 0, 8)
        chance, hops = held.expected(gain, steps, start, share)
        slope = ridge * fit.value
        slope[:k] += np.einsum("nt,ntk->k", (chance - goal_chance) * share[:, None], held.x)
        slope[k : k + 4] += hops - goal_hops
        gone = ((chance[:, 0] - goal_chance[:, 0]) * share).sum()
        slope[k + 4 :] += (-gone, gone)
        fit.step(slope)
    value = fit.value
    return Field(value[:k].copy(), value[k : k + 4].reshape(2, 2).copy(), value[k + 4 :].copy())


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field of labels.quality, fitted on a bounded sample of texts.

    SAMPLE_PER_CLASS texts of each class at most, each with all its lines. Documents that fail a base rule teach it too; null and empty ones have no line.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [spread(line_features((t or "").split("\n"))[0]) for t in batch["t"]]
            found = [np.concatenate(x).astype(np.float32).tobytes() if x else b"" for x in found]
            yield pd.DataFrame({"id": batch["id"].astype(str), "y": batch["y"], "x": found})

    sample = labelled_sample(docs, labels, "quality", per_class, id_col, text_col)

    def learn(rows: pd.DataFrame) -> Field:
        rows = rows.sort_values(["id", "y"])
        pairs = [(np.frombuffer(x, np.float32).reshape(-1, len(FEATURES)).astype(np.float64), y) for x, y in zip(rows["x"], rows["y"], strict=True)]
        return train([(x, y) for x, y in pairs if len(x)])

    return fitted(sample.mapInPandas(run, "id string, y int, x binary"), learn)


def judge(text: str | None, field: Field) -> tuple[int, int, int, int, int, bool, float, bool]:
    """Statistics of one whole text, whether a base rule fails, its content share, and the verdict."""
    text = text or ""
    words = text.encode().split()  # bytes: ASCII white space only
    lines = text.split("\n")
    seen: set[str] = set()
    twice = 0
    for line in lines:
        if line in seen:
            twice += bool(line.strip(BLANKS))
        else:
            seen.add(line)
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * len(words)
    features, sizes = line_features(lines)
    content = float(sizes[field.viterbi(features) == 1].sum() / max(sizes.sum(), 1)) if len(sizes) else 0.0
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), twice, repeated, failed, content, not failed and content >= CONTENT_SHARE


COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def quality(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, statistics, base_failed, content_share, kept) for every row of docs.

    Null and empty texts have no words, fail the base rules and are not kept. Very long texts are judged
    whole, all their lines as one sequence. A line that scores alike both ways is content. Repeated rows
    are judged each; other columns of docs are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([judge(t, field) for t in batch["t"]], columns=NAMES)
            found.insert(0, "id", batch["id"].array)
            yield found

    kind = id_type(docs, id_col)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, {COLUMNS}")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that quality() keeps.

    Null and empty texts go; very long ones are judged whole; repeated rows stay or go together.
    """

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([judge(t, field)[-1] for t in texts], dtype=bool)

    return docs.where(kept(F.col(text_col)))
