"""Sequence jobs: error rates, alignment, chunking, lexicon lookup and re-assembly."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import islice
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from ..functions.tables import text_parts
from .windows import fixed

#: Cells of tables of distances, and bytes of text, that a step of a Python task takes at once.
CELLS_AT_ONCE, TEXT_AT_ONCE = 1 << 20, 1 << 20


def cer(a: Column, b: Column) -> Column:
    """Edit distance of two keys over the length of the first."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.lit(1))


def word_distance(p: Sequence[str], q: Sequence[str]) -> int:
    """Edit distance of two lists of words, one column of the table at a time as the bits of two numbers."""
    if len(p) > len(q):
        p, q = q, p
    if not p:
        return len(q)
    places: dict[str, int] = {}
    for i, word in enumerate(p):
        places[word] = places.get(word, 0) | 1 << i
    full, last = (1 << len(p)) - 1, 1 << len(p) - 1
    up, down, distance = full, 0, len(p)
    for word in q:
        same = places.get(word, 0)
        free = ((same & up) + up ^ up) | same | down
        right, left = down | ~(free | up) & full, up & free
        if right & last:
            distance += 1
        elif left & last:
            distance -= 1
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | ~(free | right) & full, right & free
    return distance


#: Fixed value: a word, between what regular expressions take for white space.
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


@F.pandas_udf(DoubleType())
def _long_wer(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        p, q = WORD.findall(x), WORD.findall(y)
        return word_distance(p, q) / max(len(p), 1)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def wer(a: Column, b: Column) -> Column:
    """Edit distance of two texts' words over the first one's number of words."""
    return _long_wer(a, b)


def frame_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all frames of a (n, k) to those of b (m, k): l1, l2 or cosine (1 where a frame is all zero)."""
    if metric == "cosine":
        sizes = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        return 1 - np.divide(a @ b.T, sizes, out=np.zeros_like(sizes), where=sizes > 0)
    apart = (np.abs(x - b) for x in a)
    rows = [d.sum(axis=1) if metric == "l1" else np.sqrt((d * d).sum(axis=1)) for d in apart]
    return np.stack(rows) if rows else np.zeros((0, len(b)))


def warped(apart: np.ndarray, band: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(cost, steps) of the best paths to every cell of a table of distances, one diagonal of it at a time; of equal costs the fewest steps.

    Further axes of apart are tables of their own, which are walked together.
    """
    n, m, *tables = apart.shape
    cost = np.full((n + 1, m + 1, *tables), np.inf)
    steps = np.zeros((n + 1, m + 1, *tables), dtype=np.int64)
    cost[0, 0] = 0
    for diagonal in range(2, n + m + 1):
        i = np.arange(max(1, diagonal - m), min(n, diagonal - 1) + 1)
        j = diagonal - i
        if band is not None:
            inside = np.abs(j - i * m // n) <= band
            i, j = i[inside], j[inside]
        costs = np.stack([cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1]])
        least = costs.min(axis=0)
        counts = np.where(costs == least, np.stack([steps[i - 1, j - 1], steps[i - 1, j], steps[i, j - 1]]), n + m)
        cost[i, j], steps[i, j] = least + apart[i - 1, j - 1], counts.min(axis=0) + 1
    return cost, steps


#: The cells of a diagonal that a path can meet: the first one's i, costs, steps.
Line = tuple[int, np.ndarray, np.ndarray]


class LongPair:
    """What warped() says of one pair of frames (n, k) and (m, k), without its tables.

    Of the diagonals only the last two are held. The path is found from the end: a stretch of diagonals of more than
    CELLS_AT_ONCE cells is halved, its second half is walked again from the two diagonals before it and traced first.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, band: int | None, metric: str) -> None:
        self.x, self.y, self.metric, self.end = x, y, metric, len(x) + len(y)
        n, m = len(x), len(y)
        diagonals = np.arange(self.end + 1)
        self.low, self.high = np.maximum(1, diagonals - m), np.minimum(n, diagonals - 1)
        if band is not None:
            i = np.arange(1, n + 1)
            places = i + i * m // n
            self.low = np.maximum(self.low, np.searchsorted(places, diagonals - band) + 1)
            self.high = np.minimum(self.high, np.searchsorted(places, diagonals + band, side="right"))
        self.cells = np.cumsum(np.maximum(0, self.high - self.low + 1))
        if metric == "cosine":
            self.sizes = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        none = np.zeros(0)
        self.start: tuple[Line, Line] = (0, np.zeros(1), np.zeros(1, dtype=np.int64)), (0, none, none.astype(np.int64))

    def _apart(self, diagonal: int, low: int, high: int) -> np.ndarray:
        own, other = slice(low - 1, high), slice(diagonal - high - 1, diagonal - low)
        a, b = self.x[own], self.y[other][::-1]
        if self.metric == "cosine":
            sizes = self.sizes[0][own] * self.sizes[1][other][::-1]
            return 1 - np.divide((a * b).sum(axis=1), sizes, out=np.zeros_like(sizes), where=sizes > 0)
        d = np.abs(a - b)
        return d.sum(axis=1) if self.metric == "l1" else np.sqrt((d * d).sum(axis=1))

    @staticmethod
    def _at(line: Line, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(costs, steps) from low to high, which no path meets outside the line."""
        first, own, counts = line
        cost, steps = np.full(high - low + 1, np.inf), np.zeros(high - low + 1, dtype=np.int64)
        a, b = max(low, first), min(high + 1, first + len(own))
        if a < b:
            cost[a - low : b - low], steps[a - low : b - low] = own[a - first : b - first], counts[a - first : b - first]
        return cost, steps

    def lines(self, before: tuple[Line, Line], first: int, last: int) -> Iterator[Line]:
        """The diagonals from first to last, from the two before them."""
        two, one = before
        for diagonal in range(first, last + 1):
            low = int(self.low[diagonal])
            high = max(low - 1, int(self.high[diagonal]))
            met = [self._at(two, low - 1, high - 1), self._at(one, low - 1, high - 1), self._at(one, low, high)]
            costs = np.stack([c for c, _ in met])
            least = costs.min(axis=0)
            counts = np.where(costs == least, np.stack([s for _, s in met]), self.end)
            two, one = one, (low, least + self._apart(diagonal, low, high), counts.min(axis=0) + 1)
            yield one

    def _trace(self, before: tuple[Line, Line], first: int, last: int, i: int, j: int, path: list[dict[str, int]]) -> tuple[int, int]:
        """Adds the cells of the path from (i, j) back to the diagonal first; the cell that comes before them."""
        if last > first and self.cells[last] - self.cells[first - 1] > CELLS_AT_ONCE:
            middle = (first + last) // 2
            held = before
            for line in self.lines(before, first, middle):
                held = held[1], line
            i, j = self._trace(held, middle + 1, last, i, j, path)
            return self._trace(before, first, middle, i, j, path)
        held = [*before, *self.lines(before, first, last)]

        def at(p: int, q: int) -> tuple[float, int]:
            low, costs, steps = held[p + q - first + 2]
            return (costs[p - low], steps[p - low]) if low <= p < low + len(costs) else (np.inf, 0)

        while i and j and i + j >= first:
            path.append({"i": i - 1, "j": j - 1})
            *_, i, j = min((*at(p, q), p, q) for p, q in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
        return i, j

    def warped(self) -> tuple[float, int]:
        """(cost, steps) of the best path, of equal costs the fewest steps."""
        for line in self.lines(self.start, 2, self.end):
            pass
        return float(line[1][-1]), int(line[2][-1])

    def path(self) -> list[dict[str, int]]:
        """The steps of a path of finite cost, from the start."""
        path: list[dict[str, int]] = []
        self._trace(self.start, 2, self.end, len(self.x), len(self.y), path)
        return path[::-1]


def dtw_costs(pairs: DataFrame, band: int | None, most_cells: int | None = None, metric: str = "l1", with_path: bool = False) -> DataFrame:
    """(pair, cost, steps) of pairs (pair, x, y: arrays of numbers, or of equally long frames) by dynamic time warping.

    The metric is l1, l2 or cosine; band is how far a path may leave the diagonal, None for anywhere; the cost is infinite
    where that leaves no path. With with_path, path holds the steps (i, j) from the start. Every pair is warped, whatever its size, unless the
    caller sets most_cells: pairs of more cells then get nulls before any Python runs. Where x or y is null, so is the rest.
    Pairs of up to CELLS_AT_ONCE cells are dealt by their cells so that tasks have like work, and those of the
    same lengths are warped together, CELLS_AT_ONCE at a time. Longer ones are dealt one by one and walked by diagonals, of which
    a task holds two (with_path: CELLS_AT_ONCE cells and two for each halving); a pair is the work of one task.
    """
    if metric not in ("l1", "l2", "cosine"):
        raise ValueError(f"no such metric: {metric}")
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    cells = pairs.withColumn("cells", F.when(known, F.size("x").cast("bigint") * F.size("y")))

    def frames(values: np.ndarray) -> np.ndarray:
        return np.array([np.atleast_1d(v) for v in values], float).reshape(len(values), -1)

    def tables(xs: Sequence[np.ndarray], ys: Sequence[np.ndarray]) -> np.ndarray:
        n, m = len(xs[0]), len(ys[0])
        if not n or not m:
            return np.zeros((n, m, len(xs)))
        if metric == "cosine" or any(np.ndim(v[0]) for v in (*xs, *ys)):
            return np.stack([frame_distances(frames(x), frames(y), metric) for x, y in zip(xs, ys, strict=True)], axis=2)
        apart = np.abs(np.array(xs, float).T[:, None] - np.array(ys, float).T[None, :])
        return apart if metric == "l1" else np.sqrt(apart * apart)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, xs, ys = batch["pair"].tolist(), batch["x"].tolist(), batch["y"].tolist()
            alike: dict[tuple[int, int], list[int]] = {}
            for row, (x, y) in enumerate(zip(xs, ys, strict=True)):
                alike.setdefault((len(x), len(y)), []).append(row)
            for (n, m), rows in alike.items():
                if n * m > CELLS_AT_ONCE:
                    yield from (alone(ids[r], xs[r], ys[r]) for r in rows)
                    continue
                most = max(1, CELLS_AT_ONCE // max(1, n * m))
                for part in (rows[at : at + most] for at in range(0, len(rows), most)):
                    cost, steps = warped(tables([xs[r] for r in part], [ys[r] for r in part]), band)
                    out = pd.DataFrame({"pair": [ids[r] for r in part], "cost": cost[-1, -1], "steps": steps[-1, -1]})
                    if with_path:
                        out["path"] = [walked(cost[:, :, k], steps[:, :, k]) for k in range(len(part))]
                    yield out

    def alone(pair: object, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        long = LongPair(frames(x), frames(y), band, metric)
        cost, steps = long.warped()
        out = pd.DataFrame({"pair": [pair], "cost": [cost], "steps": [steps]})
        if with_path:
            out["path"] = [long.path() if np.isfinite(cost) else []]
        return out

    def walked(cost: np.ndarray, steps: np.ndarray) -> list[dict[str, int]]:
        i, j, path = cost.shape[0] - 1, cost.shape[1] - 1, []
        while i and j and np.isfinite(cost[i, j]):
            path.append({"i": i - 1, "j": j - 1})
            _, _, i, j = min((cost[p, q], steps[p, q], p, q) for p, q in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
        return path[::-1]

    kinds = f"pair {pairs.schema['pair'].dataType.simpleString()}, cost double, steps bigint" + ", path array<struct<i: int, j: int>>" * with_path
    short = CELLS_AT_ONCE if most_cells is None else min(most_cells, CELLS_AT_ONCE)
    out = cells.where(F.col("cells") <= short).repartitionByRange("cells", "pair").select("pair", "x", "y").mapInPandas(run, kinds)
    if most_cells is None or most_cells > short:
        long = cells.where(F.col("cells") > short) if most_cells is None else cells.where(F.col("cells").between(short + 1, most_cells))
        tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.unionByName(long.select("pair", "x", "y").repartition(tasks, "pair").mapInPandas(run, kinds))
    left = F.col("cells").isNull() if most_cells is None else F.col("cells").isNull() | (F.col("cells") > most_cells)
    skipped = cells.where(left).select("pair", F.lit(None).cast("double").alias("cost"), F.lit(None).cast("bigint").alias("steps"))
    if with_path:
        skipped = skipped.withColumn("path", F.lit(None).cast("array<struct<i: int, j: int>>"))
    return out.unionByName(skipped)


def lookup(words: DataFrame, lexicon: DataFrame, supplement: DataFrame) -> DataFrame:
    """(word, reading, origin) for distinct words: lexicon, without a possessive, supplement, spelled out.

    Only distinct words are joined; the caller joins readings back to its rows.
    """
    distinct = words.select("word").distinct().withColumn("bare", F.regexp_replace("word", "'s$", ""))
    lex = lexicon.select(F.col("word").alias("w"), F.col("reading").alias("r"))
    sup = supplement.select(F.col("word").alias("sw"), F.col("reading").alias("sr"))
    joined = distinct.join(lex, F.col("word") == F.col("w"), "left").join(
        lex.select(F.col("w").alias("bw"), F.col("r").alias("br")), F.col("bare") == F.col("bw"), "left"
    ).join(sup, F.col("word") == F.col("sw"), "left")
    spelled = F.trim(F.regexp_replace("word", "(.)", "$1 "))
    origin = F.when(F.col("r").isNotNull(), "lexicon").when(F.col("br").isNotNull(), "possessive").when(F.col("sr").isNotNull(), "supplement").otherwise("spell")
    return joined.select("word", F.coalesce("r", "br", "sr", spelled).alias("reading"), origin.alias("origin"))


def _bounded(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most TEXT_AT_ONCE bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_AT_ONCE, side="right")))
        yield batch.slice(at, end - at)
        at = end


def chunks(texts: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, chunk, n_chunks, n_words, hard, part): texts cut to at most `budget` words each.

    Cuts fall after sentence ends, else after clause marks, else between words (hard). Short
    neighbours merge as long as they fit. Joined by spaces the parts give the text's words again. A task
    cuts TEXT_AT_ONCE bytes of text at a time, so what it holds doesn't grow with its rows.
    """
    kind = texts.schema[key].dataType.simpleString()
    ddl = StructType.fromDDL(f"k {kind}, chunk int, n_chunks int, n_words int, hard boolean, part string")
    schema = to_arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _bounded(batch, "t"):
                rows, out = [], ([], [], [], [], [])
                for row, text in enumerate(piece.column("t")):
                    parts = list(text_parts((text.as_py() or "").split(), budget))
                    for number, (words, hard) in enumerate(parts):
                        rows.append(row)
                        for column, value in zip(out, (number, len(parts), len(words), hard, " ".join(words)), strict=True):
                            column.append(value)
                keys = piece.column("k").take(pa.array(rows, pa.int64())).cast(schema.types[0])
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(out, schema.types[1:], strict=True))], schema=schema)

    found = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, ddl)
    return found.withColumnRenamed("k", key)


def reassemble(parts: DataFrame, key: str) -> DataFrame:
    """(key, text) of groups that have all their chunks."""
    grouped = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("l"), F.max("n_chunks").alias("n"))
    return grouped.where(F.size("l") == F.col("n")).select(key, F.array_join(F.transform("l", lambda x: x["part"]), " ").alias("text"))


#: Phrases of a lexicon that every task may hold as a tree; those of a larger one are met by a join.
TREE_PHRASES = 200_000


class PhraseTree:
    """A lexicon of phrases as a tree of their words."""

    def __init__(self, phrases: Iterable[str]) -> None:
        self.root: dict = {}
        for phrase in phrases:
            node = self.root
            for word in phrase.split():
                node = node.setdefault(word, {})
            if node is not self.root:
                node[None] = True

    def lengths(self, words: Sequence[str], at: int) -> list[int]:
        """The numbers of words of all phrases that begin at a place."""
        out, node = [], self.root
        for end in range(at, len(words)):
            node = node.get(words[end])
            if node is None:
                break
            if None in node:
                out.append(end - at + 1)
        return out


def _taken(words: Sequence[str], hits: Mapping[int, Sequence[int]], not_after: Mapping[str, Collection[str]], overlaps: bool) -> Iterator[tuple[int, str]]:
    """Longest phrases from left to right, without those that a veto rules out."""
    at = 0
    while at < len(words):
        for n in sorted(hits.get(at, ()), reverse=True):
            phrase = " ".join(words[at : at + n])
            if at and words[at - 1] in not_after.get(phrase, ()):
                continue
            if overlaps and n > 1 and (n - 1) in hits[at] and max(hits.get(at + n - 1, (0,))) > 1:
                continue
            yield at, phrase
            at += n
            break
        else:
            at += 1


def tag_phrases(
    texts: DataFrame, key: str, text: str, phrases: DataFrame | Iterable[str], not_after: Mapping[str, Collection[str]] | None = None, overlaps: bool = False, tree: int = TREE_PHRASES
) -> DataFrame:
    """(key, at, phrase): the longest phrases of a lexicon over a text's lower-cased words, left to right without overlap.

    phrases is a list or a DataFrame with a column phrase, of any size: up to `tree` of them go to every task as a
    tree; with more, the stretches of each text's words are joined to them. not_after names words that may
    not stand before a phrase. With overlaps, a phrase gives way where its last word begins a longer one
    and what remains of it is a phrase too. A vetoed phrase leaves its place to the next shorter one. Null and empty
    texts have no tag. Keys stand for one row each where phrases are joined.
    """
    kind, veto = texts.schema[key].dataType.simpleString(), dict(not_after or {})
    spark, out_kinds = texts.sparkSession, f"k {kind}, at int, phrase string"
    rows = texts.select(F.col(key).alias("k"), F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "").alias("w"))
    lexicon = phrases if isinstance(phrases, DataFrame) else spark.createDataFrame([(p,) for p in phrases], "phrase string")
    lexicon = lexicon.select(F.array_join(F.filter(F.split("phrase", r"\s+"), lambda w: w != ""), " ").alias("phrase")).where("phrase <> ''").distinct()
    some = [r["phrase"] for r in lexicon.limit(tree + 1).collect()]  # tree + 1 at most
    if len(some) <= tree:
        sent = spark.sparkContext.broadcast(PhraseTree(some))

        def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = sent.value
            for batch in batches:
                out = []
                for k, words in zip(batch["k"], batch["w"], strict=True):
                    words = list(words)
                    hits = {at: found for at in range(len(words)) if (found := held.lengths(words, at))}
                    out += [(k, at, phrase) for at, phrase in _taken(words, hits, veto, overlaps)]
                yield pd.DataFrame(out, columns=["k", "at", "phrase"])

        return rows.mapInPandas(tag, out_kinds).withColumnRenamed("k", key)

    sizes = lexicon.groupBy(F.size(F.split("phrase", " ")).alias("n")).count().orderBy("n").collect()  # one row for each number of words
    places = rows.select("k", F.posexplode("w").alias("at", "first"), "w")
    firsts = lexicon.select(F.split_part("phrase", F.lit(" "), F.lit(1)).alias("first")).distinct()
    spans = places.join(firsts, "first", "left_semi").select(
        "k", "at", F.explode(F.array(*(F.when(F.size("w") >= F.col("at") + r["n"], F.array_join(F.slice("w", F.col("at") + 1, r["n"]), " ")) for r in sizes))).alias("phrase")
    )
    hits = spans.join(lexicon, "phrase").select("k", F.struct("at", F.size(F.split("phrase", " ")).alias("n")).alias("hit")).groupBy("k").agg(F.collect_list("hit").alias("hits"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, words, found in zip(batch["k"], batch["w"], batch["hits"], strict=True):
                own: dict[int, list[int]] = {}
                for hit in found:
                    own.setdefault(int(hit["at"]), []).append(int(hit["n"]))
                out += [(k, at, phrase) for at, phrase in _taken(list(words), own, veto, overlaps)]
            yield pd.DataFrame(out, columns=["k", "at", "phrase"])

    return rows.join(hits, "k").mapInPandas(choose, out_kinds).withColumnRenamed("k", key)


def in_context(tokens: DataFrame, rules: Sequence[Mapping[str, object]]) -> DataFrame:
    """tokens (utt, pos, token, phones) with phones as the token before asks for.

    A rule has after (tokens before it) and starts (what the token begins with) or is (the token itself);
    drop takes phones out, and where none is left all stay; phones puts others in their place. The first rule that fits counts.
    """
    before = F.lag("token").over(Window.partitionBy("utt").orderBy("pos"))
    rows, phones = tokens.withColumn("before_", before), F.col("phones")

    def without(dropped: list[str]) -> Column:
        return F.filter(phones, lambda p: ~p.isin(*dropped))

    out = None
    for rule in rules:
        fits = F.col("before_").isin(*sorted(rule["after"])) & (F.col("token") == rule["is"] if "is" in rule else F.col("token").startswith(rule["starts"]))
        if "phones" in rule:
            new = F.array(*(F.lit(p) for p in rule["phones"]))
        else:
            left = without(sorted(rule["drop"]))
            new = F.when(F.size(left) > 0, left).otherwise(phones)
        out = F.when(fits, new) if out is None else out.when(fits, new)
    return rows.withColumn("phones", phones if out is None else out.otherwise(phones)).drop("before_")


class _Aligned:
    """Spoken intervals of one utterance, with what a token may take of them."""

    def __init__(self, labels: list[str], frames: list[float], nuclei: Collection[str], same: Mapping[str, Collection[str]], ahead: int) -> None:
        self.labels, self.frames, self.same, self.ahead = labels, frames, same, ahead
        self.wall = [len(labels)] * (len(labels) + 1)  # the first nucleus from each place on
        for at in reversed(range(len(labels))):
            self.wall[at] = at if labels[at] in nuclei else self.wall[at + 1]

    def fits(self, at: int, phone: str) -> bool:
        return at < len(self.labels) and (self.labels[at] == phone or self.labels[at] in self.same.get(phone, ()))

    def find(self, at: int, phone: str) -> int | None:
        """Where the phone is spoken: within reach, and not behind a nucleus that is another."""
        reach = min(at + self.ahead, len(self.labels), self.wall[min(at, len(self.labels))] + 1)
        return next((j for j in range(at, reach) if self.fits(j, phone)), None)

    def take(self, at: int, phones: list[str], onsets: Collection[str], codas: Collection[str]) -> tuple[float | None, int]:
        """(frames of a token that begins here or None, where the next one begins)."""
        first, places = at, []
        for k, phone in enumerate(phones):
            last = k == len(phones) - 1
            if (phone in onsets and not last) or (phone in codas and last and places):
                found = at if self.fits(at, phone) else None
            else:
                found = self.find(at, phone)
                if found is None:
                    # what it has taken stays with it; if nothing, the nucleus in its way is what it was spoken as
                    wall = self.wall[min(first, len(self.labels))]
                    return None, at if places else wall + 1 if wall < min(first + self.ahead, len(self.labels)) else first
            if found is not None:
                places.append(found)
                at = found + 1
        total = sum(self.frames[j] for j in places)
        return (total, at) if total > 0 else (None, first)


#: Utterances that a step of a Python task walks at once, and what it has of each.
UTTERANCES_AT_ONCE, COLLECTED = 200, ("pos", "token", "phones", "label", "frames")


def _as_lists(column: pa.ListArray) -> Iterator[list]:
    """The lists of a column, empty for nulls; values are converted all at once."""
    values = column.flatten().to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return (values[a:b] for a, b in zip([0, *ends], ends, strict=False))


def assign_intervals(
    tokens: DataFrame, intervals: DataFrame, onsets: Collection[str], nuclei: Collection[str], rate: float, ahead: int = 6, codas: Collection[str] = (), same: Mapping[str, Collection[str]] | None = None
) -> DataFrame:
    """(utt, pos, token, frames): durations of tokens from the labelled intervals of their utterance.

    tokens: (utt, pos, token, phones), intervals: (utt, pos, label, start, end). A token takes its phones in
    order, each within `ahead` intervals but never behind a nucleus that is not its own; same lists labels that a
    phone may be spoken as. An onset before the last phone, and a coda that is the last after others, count where they stand
    next and may be missing. A token that doesn't fit has null frames and keeps what it took from the
    next; if that is nothing, it passes the nucleus that stood in its way. The group of a task is one utterance.
    """
    kind, alike = tokens.schema["utt"].dataType.simpleString(), dict(same or {})
    ddl = StructType.fromDDL(f"utt {kind}, pos bigint, token string, frames double")
    schema = to_arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(at, UTTERANCES_AT_ONCE) for at in range(0, len(batch), UTTERANCES_AT_ONCE)):
                count = pc.list_value_length(piece.column("token")).to_numpy()
                phones = _as_lists(piece.column("phones").flatten())
                out = []
                for n, labels, lengths in zip(count.tolist(), _as_lists(piece.column("label")), _as_lists(piece.column("frames")), strict=True):
                    spoken, at = _Aligned(labels, lengths, nuclei, alike, ahead), 0
                    for own in islice(phones, n):
                        frames, at = spoken.take(at, own, onsets, codas) if own else (None, at)
                        out.append(frames)
                utts = piece.column("utt").take(pa.array(np.repeat(np.arange(len(piece)), count))).cast(schema.types[0])
                yield pa.RecordBatch.from_arrays([utts, piece.column("pos").flatten(), piece.column("token").flatten(), pa.array(out, pa.float64())], schema=schema)

    # both sides meet in one aggregation, where null utterances are one, too; nulls of pos come last
    word = F.struct(F.col("pos").isNull(), F.col("pos").cast("bigint").alias("pos"), "token", "phones")
    length = F.coalesce(((F.col("end") - F.col("start")) * rate).cast("double"), F.lit(float("nan")))
    sound = F.struct(F.col("pos").isNull(), F.col("pos").alias("pos"), "label", length.alias("frames"))
    left = tokens.select("utt", word.alias("word"))
    both = left.unionByName(intervals.select("utt", sound.alias("sound")), allowMissingColumns=True)
    met = both.groupBy("utt").agg(*(F.sort_array(F.collect_list(c)).alias(c) for c in ("word", "sound"))).where(F.size("word") > 0)
    parts = [F.transform("word" if name in ("pos", "token", "phones") else "sound", lambda x: x[name]).alias(name) for name in COLLECTED]
    return met.select("utt", *parts).mapInArrow(run, ddl)


Scorer = Callable[[np.ndarray], Mapping[str, np.ndarray]]


def _scores(rows: DataFrame, key: str, values: str, names: Sequence[str], scorer: Scorer, most: int) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    ddl = StructType.fromDDL(f"k {kind}, " + ", ".join(f"{n} double" for n in names))
    schema = to_arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, list[float]]] = []

        def scored() -> pa.RecordBatch:
            found = scorer(np.array([v for _, v in held], dtype=float))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], schema.types[0]), *(pa.array(np.asarray(found[n], dtype=float)) for n in names)], schema=schema)

        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if held and (len(held) == most or len(held[0][1]) != len(v)):
                    yield scored()
                    held = []
                held.append((k, v))
        if held:
            yield scored()

    sized = rows.select(F.col(key).alias("k"), F.col(values).cast("array<double>").alias("v")).where(F.size("v") > 0).withColumn("n", F.size("v"))
    dealt = sized.repartitionByRange("n", "k").sortWithinPartitions("n", "k")
    return dealt.select("k", "v").mapInArrow(run, ddl)


def score_in_batches(rows: DataFrame, key: str, values: str, scorer: Scorer, thresholds: Mapping[str, float], most: int = 8, margin: float = 0.002, careful: Scorer | None = None) -> DataFrame:
    """(key, score ..., again): an outside scorer over batches of at most `most` rows whose values have one length, so nothing is padded.

    scorer takes an array (rows, length) and gives an array for each name of thresholds. Rows with a score within
    `margin` of its threshold go to `careful`, by default the scorer itself, alone, and keep what that says; again
    tells them. Rows are dealt by length and key, so a length that many rows share is many tasks. Null and
    empty values have null scores.
    """
    names = list(thresholds)
    first = fixed(_scores(rows, key, values, names, scorer, most))
    near = reduce(or_, (F.abs(F.col(n) - t) < margin for n, t in thresholds.items()))
    doubtful = rows.join(first.where(near).select(F.col("k").alias(key)), key, "left_semi")
    second = _scores(doubtful, key, values, names, careful or scorer, 1).select("k", *(F.col(n).alias(f"{n}_again") for n in names), F.lit(True).alias("again"))
    both = first.join(second, "k", "left").select(F.col("k").alias(key), *(F.coalesce(f"{n}_again", n).alias(n) for n in names), F.coalesce("again", F.lit(False)).alias("again"))
    return rows.select(key).join(both, key, "left").withColumn("again", F.coalesce("again", F.lit(False)))


def encoded_chunks(rows: DataFrame, key: str, budget: int, strong: frozenset[str], weak: frozenset[str]) -> DataFrame:
    """(key, chunk, tokens, ids) of rows (key, tokens, ids): both arrays cut together to at most `budget` each.

    A cut falls after the last strong token that fits, else after the last weak one, else at the budget.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, tokens, ids in zip(batch["k"], batch["tokens"], batch["ids"], strict=True):
                tokens, ids, at, number = list(tokens), list(ids), 0, 0
                while at < len(tokens):
                    end = min(at + budget, len(tokens))
                    if end < len(tokens):
                        for marks in (strong, weak):
                            cut = next((i + 1 for i in range(end - 1, at - 1, -1) if tokens[i] in marks), None)
                            if cut:
                                end = cut
                                break
                    out.append((k, number, tokens[at:end], ids[at:end]))
                    at, number = end, number + 1
            yield pd.DataFrame(out, columns=["k", "chunk", "tokens", "ids"])

    cut = rows.select(F.col(key).alias("k"), "tokens", "ids").mapInPandas(run, f"k {kind}, chunk int, tokens array<string>, ids array<int>")
    return cut.withColumnRenamed("k", key)


def reference_mismatches(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(line, pos, word, expected, got) of words whose dictionary units don't stand next in the reference.

    lines: (line, words, units). A word takes as many units as its dictionary form has; on a mismatch the
    walk takes what is there and goes on. Words that the dictionary lacks end a line's walk.
    """
    exploded = lines.select("line", "units", F.posexplode("words").alias("pos", "word"))
    joined = exploded.join(lexicon.select("word", F.col("phones").alias("own")), "word", "left")
    size = F.coalesce(F.size("own"), F.lit(0))
    grouped = joined.groupBy("line").agg(F.first("units").alias("units"), F.sort_array(F.collect_list(F.struct("pos", "word", "own", size.alias("n")))).alias("w"))
    known = F.size(F.array_compact(F.transform("w", lambda x: F.when(x["own"].isNull(), x["pos"]))))
    first_gap = F.when(known > 0, F.array_min(F.filter(F.transform("w", lambda x: F.when(x["own"].isNull(), x["pos"])), lambda p: p.isNotNull()))).otherwise(F.size("w"))
    walked = grouped.withColumn("w", F.slice("w", F.lit(1), first_gap))
    rows = walked.select("line", "units", "w", F.posexplode("w").alias("i", "x"))
    before = F.aggregate(F.slice("w", F.lit(1), F.col("i")), F.lit(0), lambda a, y: a + y["n"])
    got = F.slice("units", before + 1, F.col("x.n"))
    return rows.withColumn("got", got).where(F.col("got") != F.col("x.own")).select("line", F.col("x.pos").alias("pos"), F.col("x.word").alias("word"), F.col("x.own").alias("expected"), "got")


Rule = Mapping[str, object]


def _fits(rule: Rule, lists: Mapping[str, Collection[str]]) -> Column:
    """The condition of a rule on the columns prev, next (bare words, null if none) and following (the token after, null at the end)."""
    prev, nxt, following = F.col("prev"), F.col("next"), F.col("following")

    def among(column: Column, name: str) -> Column:
        return F.coalesce(column.isin(*sorted(lists[name])), F.lit(False)) if lists[name] else F.lit(False)

    made = {
        "prev_in": lambda name: among(prev, name),
        "prev_not_in": lambda name: ~among(prev, name),
        "next_in": lambda name: among(nxt, name),
        "prev_suffix": lambda end: F.coalesce(prev.endswith(end), F.lit(False)),
        "next_suffix": lambda end: F.coalesce(nxt.endswith(end), F.lit(False)),
        "prev_matches": lambda pattern: F.coalesce(prev.rlike(pattern), F.lit(False)),
        "next_vowel": lambda wanted: F.coalesce(nxt.rlike("^[aeiou]"), F.lit(False)) if wanted else F.lit(True),
        "next_end": lambda wanted: (following.isNull() | following.rlike(r"^\s*[^\p{L}\p{N}]?\s*$")) if wanted else F.lit(True),
    }
    unknown = set(rule.get("when", {})) - set(made)
    if unknown:
        raise ValueError(f"no such condition: {sorted(unknown)}")
    return reduce(lambda a, b: a & b, (made[name](value) for name, value in rule.get("when", {}).items()), F.lit(True))


def context_variants(rows: DataFrame, group: Sequence[str], order: str, token: str, table: Mapping[str, Sequence[Rule]], lists: Mapping[str, Collection[str]]) -> DataFrame:
    """rows with variant: what the first rule of a word that fits picks, null where none does.

    table holds the rules of each upper-case word: {"pick": n, "when": {...}} with prev_in, prev_not_in, next_in
    (names of lists), prev_suffix, next_suffix, prev_matches, next_vowel, next_end. prev and next are the nearest words of the
    group, lower-case and without quotes; tokens without a letter or digit are skipped, and count for next_end alone.
    The rules become one expression over two windows; a group is a sentence, which fits a task.
    """
    bare = F.regexp_replace(F.lower(F.trim(token)), "^['\"]+|['\"]+$", "")
    word = F.when(bare.rlike(r"[\p{L}\p{N}]"), bare)
    by = Window.partitionBy(*group).orderBy(order)
    near = rows.withColumn("word_", word)
    near = near.withColumns({
        "prev": F.last("word_", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)),
        "next": F.first("word_", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)),
        "following": F.lead(token).over(by),
    })
    picks = [F.when((F.upper(F.trim(token)) == name) & _fits(rule, lists), F.lit(int(rule["pick"]))) for name, rules in table.items() for rule in rules]
    return near.withColumn("variant", F.coalesce(*picks) if picks else F.lit(None).cast("int")).drop("word_", "prev", "next", "following")


#: Fixed value: one part of a compound in mixed case.
PASCAL = "[A-Z][a-z]+|[A-Z]+(?![a-z])"


def _spoken(words: DataFrame, lexicon: DataFrame, supplement: DataFrame, letters: Mapping[str, str], spell: bool) -> DataFrame:
    """words (word, pick) with reading and origin by the lexicon, the supplement and, with spell, their letters."""
    upper = F.upper(F.trim(F.translate("word", "’", "'")))
    keys = F.array_distinct(F.array(
        upper, F.when(upper.rlike("^[A-Z]"), F.concat(F.lit("'"), upper)), F.when(upper.endswith("'S"), F.expr("left(k_, length(k_) - 2)")), F.when(upper.endswith("'"), F.expr("left(k_, length(k_) - 1)")),
    ))
    named = words.withColumn("k_", upper)
    tried = named.select("word", "pick", F.posexplode(keys).alias("rank", "key")).where(F.col("key").isNotNull())
    own = lexicon.select(F.upper("word").alias("key"), "variant", "reading")
    # the key that is asked for first, of it the variant that was picked, or else the first
    order = F.struct("rank", (F.col("variant") != F.coalesce("pick", F.lit(0))).alias("other"), "variant")
    found = tried.join(own, "key").groupBy("word", "pick").agg(F.min_by("reading", order).alias("lex"))
    extra = supplement.groupBy(F.upper("word").alias("sup_key")).agg(F.min("reading").alias("sup"))
    alike = named.alias("w").join(found.alias("f"), F.col("w.word").eqNullSafe(F.col("f.word")) & F.col("w.pick").eqNullSafe(F.col("f.pick")), "left").select("w.word", "w.pick", "k_", "lex")
    alike = alike.join(extra, F.col("k_") == F.col("sup_key"), "left")
    names = F.transform(F.regexp_extract_all(F.upper("word"), F.lit(r"\p{L}"), F.lit(0)), lambda x: F.element_at(F.create_map(*(F.lit(v) for pair in letters.items() for v in pair)), x)) if letters else None
    spelled = F.when((F.size(names) > 0) & ~F.exists(names, lambda x: x.isNull()), F.array_join(names, " ")) if spell and letters else F.lit(None).cast("string")
    origin = F.when(F.col("lex").isNotNull(), "lexicon").when(F.col("sup").isNotNull(), "supplement").when(spelled.isNotNull(), "spell").otherwise("missing")
    return alike.select("word", "pick", F.coalesce("lex", "sup", spelled).alias("reading"), origin.alias("origin"))


def pronounce(words: DataFrame, lexicon: DataFrame, supplement: DataFrame, letters: Mapping[str, str]) -> DataFrame:
    """(word, pick, reading, origin) of the distinct (word, pick) of words; the caller joins them back to its rows.

    lexicon: (word, variant, reading), supplement: (word, reading), letters: the readings of capitals. A word is
    looked up as it is, with a leading apostrophe, without a possessive and without a closing apostrophe; pick is
    the variant that context_variants() chose, null for the first. A word with an underscore is its parts; any other
    that lexicon and supplement lack is its parts at hyphens or at capitals (origins underscore, hyphen, compound) if each has a
    reading, else its letters, else missing. Only distinct words are joined.
    """
    distinct = words.select("word", F.col("pick").cast("int").alias("pick") if "pick" in words.columns else F.lit(None).cast("int").alias("pick")).where("word is not null").distinct()
    pascal = F.regexp_extract_all("word", F.lit(PASCAL), F.lit(0))
    kind = F.when(F.contains("word", F.lit("_")), "underscore").when(F.contains("word", F.lit("-")), "hyphen").when((F.size(pascal) > 1) & (F.array_join(pascal, "") == F.col("word")), "compound")
    at_marks = [F.filter(F.split("word", mark), lambda p: p != "") for mark in ("_", "-")]
    parts = F.when(F.col("kind") == "underscore", at_marks[0]).when(F.col("kind") == "hyphen", at_marks[1]).otherwise(pascal)
    split = distinct.select("word", kind.alias("kind")).distinct().where("kind is not null").withColumn("parts", parts).where(F.size("parts") > 1)
    pieces = split.select("word", "kind", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part"))
    known = _spoken(pieces.select(F.col("part").alias("word"), F.lit(None).cast("int").alias("pick")).distinct(), lexicon, supplement, letters, True).where("reading is not null")
    met = pieces.join(known.select(F.col("word").alias("part"), "reading"), "part")
    joined = met.groupBy("word", "kind", "n").agg(F.array_sort(F.collect_list(F.struct("at", "reading"))).alias("l")).where(F.size("l") == F.col("n"))
    joined = joined.select(F.col("word").alias("whole"), "kind", F.array_join(F.transform("l", lambda x: x["reading"]), " ").alias("by_parts"))
    direct = _spoken(distinct, lexicon, supplement, letters, True).join(joined, F.col("word") == F.col("whole"), "left")
    takes = F.col("by_parts").isNotNull() & ((F.col("kind") == "underscore") | ~F.col("origin").isin("lexicon", "supplement"))
    return direct.select("word", "pick", F.when(takes, F.col("by_parts")).otherwise(F.col("reading")).alias("reading"), F.when(takes, F.col("kind")).otherwise(F.col("origin")).alias("origin"))
