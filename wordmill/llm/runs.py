"""Periodic runs of words, found as maximal pairs in the LCP-interval tree of a suffix array.

A run is a stretch of consecutive words with a smallest period q, as long as LEAST words and TIMES
periods at least, that no neighbouring word extends. Its first word i and the word i + q begin the same
`length - q` words, differ in the word before and in the word after: they are a maximal pair at
distance q. The other way round, a maximal pair at distance q with a match of m words is a run of
m + q words wherever m + q meets the two bounds, so nothing has to be extended.

* The intervals of suffixes that share m words form a tree. It is walked bottom up from the deepest
  matches; an interval holds lists of its places by the word to their left, and two places are a
  maximal pair where two children of an interval meet and the words to their left differ.
* The bounds allow a distance of m / (TIMES - 1) at most, so only the neighbours of a place within that
  distance are looked up, and only intervals with a match of `shortest_match` words or more are built.
* A distance that is a multiple of a run's period gives the same stretch: the smallest is the period.

Texts are worked on in groups of about WORDS_AT_ONCE words, a word that occurs nowhere else between
them. A text without two equal windows of `shortest_match` words can have no run and is left out of the suffix array.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import id_type

LEAST = 24
TIMES = 3
#: Words of texts that share one suffix array; a longer text has one of its own.
WORDS_AT_ONCE = 150_000

Run = tuple[int, int, int]


def shortest_match(least: int = LEAST, times: int = TIMES) -> int:
    """Words that the two places of a run's maximal pair have in common at least: least - q or (times - 1) * q, whichever is more."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the suffixes that begin there, and the words each shares with the one before (first: 0).

    By doubling: the ranks of stretches of 2^k words give those of 2^(k+1). The shared lengths are read
    off the same ranks, longest stretches first.
    """
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    levels = [rank]
    width = 1
    while rank.max(initial=0) + 1 < n:
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - width, 0)] = rank[width:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + after, return_inverse=True)
        levels.append(rank)
        width *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    shared = np.zeros(n, dtype=np.int64)
    if n > 1:
        left, right = order[:-1], order[1:]
        at = np.zeros(n - 1, dtype=np.int64)
        for k in reversed(range(len(levels))):
            inside = np.maximum(left, right) + at + (1 << k) <= n
            a, b = np.where(inside, left + at, 0), np.where(inside, right + at, 0)
            at += np.where(inside & (levels[k][a] == levels[k][b]), 1 << k, 0)
        shared[1:] = at
    return order, shared


class _Interval:
    """An interval of the tree: its places in order, and the same by the word to their left."""

    __slots__ = ("match", "places", "by_left")

    def __init__(self, match: int, places: list[int], by_left: dict[int, list[int]]) -> None:
        self.match, self.places, self.by_left = match, places, by_left


def _meet(into: _Interval, child: _Interval, left: list[int], reach: int, found: list[tuple[int, int, int]]) -> _Interval:
    """One interval of the places of both; pairs of one place of each, at most reach apart and with other words to their left, are found."""
    match = into.match
    large, small = (into, child) if len(into.places) >= len(child.places) else (child, into)
    for p in small.places:
        first, last = bisect_left(large.places, p - reach), bisect_right(large.places, p + reach)
        own = left[p]
        if last - first <= len(large.by_left):
            others = [other for other in large.places[first:last] if left[other] != own]
        else:
            near = (held for word, held in large.by_left.items() if word != own)
            others = [other for held in near for other in held[bisect_left(held, p - reach) : bisect_right(held, p + reach)]]
        found.extend((min(p, other), abs(p - other), match) for other in others)
    for p in small.places:
        insort(large.places, p)
    for word, places in small.by_left.items():
        held = large.by_left.get(word)
        if held is None:
            large.by_left[word] = places
        else:
            for p in places:
                insort(held, p)
    large.match = match
    return large


def maximal_pairs(codes: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(first place, distance, shared words) of the maximal pairs that can be runs."""
    shortest = shortest_match(least, times)
    order, shared = suffix_array(codes)
    left = np.concatenate([[-1], codes[:-1]]).tolist()
    found: list[tuple[int, int, int]] = []
    deep = np.nonzero(shared >= shortest)[0]
    if not len(deep):
        return found
    cuts = np.nonzero(np.diff(deep) > 1)[0] + 1
    for part in np.split(deep, cuts):
        first, last = int(part[0]) - 1, int(part[-1])
        places, matches = order[first : last + 1].tolist(), [*shared[first + 1 : last + 1].tolist(), 0]
        open_: list[_Interval] = []  # nested, the deepest last
        for p, after in zip(places, matches, strict=True):
            node = _Interval(-1, [p], {left[p]: [p]})
            # close what is deeper than the match with the next suffix
            while open_ and open_[-1].match > after:
                top = open_.pop()
                node = _meet(top, node, left, top.match // (times - 1), found)
            if open_ and open_[-1].match == after:
                top = open_.pop()
                node = _meet(top, node, left, after // (times - 1), found)
            node.match = after
            open_.append(node)
    return found


def _coded(texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, each text followed by a word of its own; the places where texts begin."""
    codes: dict = {}
    sizes = np.array([len(words) + 1 for words in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(starts[-1]), dtype=np.int64)
    for start, words in zip(starts.tolist(), texts, strict=False):
        out[start : start + len(words)] = [codes.setdefault(w, len(codes)) for w in words]
    out[starts[1:] - 1] = -2 - np.arange(len(texts))
    return out, starts


def _repeating(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which texts have two windows of width words with equal hashes."""
    count = len(starts) - 1
    if len(codes) < width or not count:
        return np.zeros(count, dtype=bool)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    window = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    for k in range(width):
        window = window * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + len(window)]
    owner = np.repeat(np.arange(count), np.diff(starts))
    inside = owner[: len(window)] == owner[width - 1 :]  # a text's own word after it makes windows across texts unlike any other
    rows, hashes = owner[: len(window)][inside], window[inside]
    by = np.lexsort((hashes, rows))
    same = (rows[by][1:] == rows[by][:-1]) & (hashes[by][1:] == hashes[by][:-1])
    out = np.zeros(count, dtype=bool)
    out[rows[by][1:][same]] = True
    return out


def runs_of(texts: list[list], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs (start, length, period) of each list of words, by start and then period."""
    if least < 2 or times < 2:
        raise ValueError("runs have two words and two periods at least")
    out: list[list[Run]] = [[] for _ in texts]
    codes, starts = _coded(texts)
    which = np.nonzero(_repeating(codes, starts, shortest_match(least, times)))[0]
    if not len(which):
        return out
    kept = np.concatenate([codes[starts[i] : starts[i + 1]] for i in which])
    kept_starts = np.concatenate([[0], np.cumsum(starts[which + 1] - starts[which])])
    best: dict[tuple[int, int], int] = {}
    for place, distance, match in maximal_pairs(kept, least, times):
        length = match + distance
        if length >= max(least, times * distance):
            key = (place, length)
            best[key] = min(distance, best.get(key, distance))
    for (place, length), period in best.items():
        text = int(np.searchsorted(kept_starts, place, side="right")) - 1
        out[which[text]].append((place - int(kept_starts[text]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list, runs: list[Run]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length for its period; ties go to the smaller start, then the smaller period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def period_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    times: int = TIMES,
    change: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(id_col, runs, best, collapsed) for every row: its runs as structs, the strongest, and the text without repetitions.

    Words are what stands between ASCII white space; change, if given, makes other words of a row's id and
    words first. Null and empty texts have no run, a null best and an empty collapsed text. Every row is
    worked on alone, so repeated rows, tied ids and null ids come out as they came in; an empty table
    gives an empty result. Long texts are read whole, alone in their group. Other columns are not read.
    """

    kind = id_type(docs, id_col)
    one = "struct<start: bigint, length: bigint, period: bigint>"
    schema = to_arrow_schema(StructType.fromDDL(f"id {kind}, runs array<{one}>, best {one}, collapsed string"))
    names = ("start", "length", "period")

    def finish(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, least, times)
        runs = [[dict(zip(names, r, strict=True)) for r in of_text] for of_text in found]
        best = [r and dict(zip(names, r, strict=True)) for r in map(strongest, found)]
        rest = [b" ".join(collapsed(words, of_text)).decode("utf-8", "replace") for words, of_text in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, runs, best, rest), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(*(batch.column(name).to_pylist() for name in ("id", "t")), strict=True):
                words = (text or "").encode().split()  # bytes: only ASCII white space counts
                words = change(key, words) if change else words
                ids.append(key)
                texts.append(words)
                size += len(words)
                if size >= WORDS_AT_ONCE:
                    yield finish(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield finish(ids, texts)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = rows.mapInArrow(run, StructType.fromDDL(f"id {kind}, runs array<{one}>, best {one}, collapsed string"))
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """What period_runs finds, in numbers and hashes: one row for each row of docs."""
    found = period_runs(docs, id_col, text_col, change=change)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    best = F.col("best")
    return found.select(
        id_col,
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
