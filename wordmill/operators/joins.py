"""Joins: exclusion, overlap, pairing, intervals, near duplicates, precedence and fallback."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import fixed


#: Characters of a shingle that near_matches() counts.
SHINGLE = 8
#: Characters that a key has at least to be matched.
LEAST = 12
#: Share of the longer key that a contained one has at least, and its least size; whatever it is, MIDDLE characters in the middle of the longer key are in it.
CONTAINED, LEAST_HELD, MIDDLE = 0.65, 20, 10
#: Cells that letters and stretches of three letters are counted in; those that share one only let more pairs through.
LETTERS, TRIPLES = 32, 2048
#: Numbers that hold a key's parities; keys of FILLED characters or fewer need but one of them, of twice as many but two.
WORDS, FILLED = 3, 40
#: Keys and characters of the right side sent out at once, keys and characters of the left one, cells and pairs judged at once.
KEYS_AT_ONCE, LEFT_AT_ONCE, CHARS_AT_ONCE, CELLS_AT_ONCE, PAIRS_AT_ONCE = 20_000, 30_000, 2_000_000, 1 << 20, 1 << 14
#: Characters of keys whose common lengths are found together, and pairs of these at once.
WIDE, TOGETHER = 512, 512


def exclude(rows: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows of which no key is among the excluded: one anti-join per key, never one join with OR."""
    out = rows
    for key in keys:
        out = out.join(excluded.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return out


def overlaps(rows: DataFrame, key: str, part: str) -> DataFrame:
    """Keys that stand in more than one part."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(part)), ",").alias("parts"), F.count_distinct(part).alias("n")).where("n > 1").drop("n")


def intersection_over_union(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(union > 0, inter / union)


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs of intervals (start_l, end_l) and (start_r, end_r) that overlap, by key.

    Each interval goes to every bin of `width` that it touches, which makes this an equi-join; a pair
    that shares several bins is kept in the first of them only.
    """
    def bins(start: str, end: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))

    a = left.where("end_l > start_l").withColumn("bin", bins("start_l", "end_l"))
    b = right.where("end_r > start_r").withColumn("bin", bins("start_r", "end_r"))
    first = F.floor(F.greatest("start_l", "start_r") / width)
    return a.join(b, [*keys, "bin"]).where((F.col("start_l") < F.col("end_r")) & (F.col("start_r") < F.col("end_l")) & (F.col("bin") == first)).drop("bin")


def point_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, width: int) -> DataFrame:
    """Points joined to the spans (start, end) that hold them, by key and by bins of `width`."""
    p = points.withColumn("bin", F.floor(F.col(point) / width))
    s = spans.where("end > start").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    return p.join(s, [*keys, "bin"]).where((F.col(point) >= F.col("start")) & (F.col(point) < F.col("end"))).drop("bin")


def pair_by_index(left: DataFrame, right: DataFrame, group: str, index: str) -> DataFrame:
    """left paired with right by index where right's indexes are unique in the group, else by position."""
    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(index, "start")))

    r = placed(right)
    unique = r.groupBy(group).agg((F.count("*") == F.count_distinct(index)).alias("by_index"))
    a = placed(left).join(unique, group, "left").withColumn("at", F.when(F.coalesce("by_index", F.lit(False)), F.col(index)).otherwise(F.col("place")))
    b = r.join(unique, group).withColumn("at", F.when(F.col("by_index"), F.col(index)).otherwise(F.col("place")))
    return a.join(b.select(group, "at", F.col("start").alias("other_start")), [group, "at"], "left")


def primary_or_supplement(primary: DataFrame, supplement: DataFrame, key: str) -> DataFrame:
    """All of primary, and what supplement has for other keys; origin tells them apart."""
    more = supplement.join(primary.select(key).distinct(), key, "left_anti")
    return primary.withColumn("origin", F.lit("primary")).unionByName(more.withColumn("origin", F.lit("supplement")))


def common_length(x: str, y: str) -> int:
    """The longest common subsequence's length, in bit-parallel steps."""
    masks: dict[str, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    full, row = (1 << len(x)) - 1, (1 << len(x)) - 1
    for c in y:
        both = row & masks.get(c, 0)
        row = (row + both | row - both) & full
    return len(x) - row.bit_count()


def _points(keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all keys, one after the other, and the keys' sizes."""
    return np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(k) for k in keys], dtype=np.int64)


def _letters(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Counts, up to 255, of each key's letters in LETTERS cells, by their code points."""
    owner = np.repeat(np.arange(len(sizes)) * LETTERS, sizes)
    found = np.bincount(owner + points % np.uint32(LETTERS), minlength=len(sizes) * LETTERS)
    return np.minimum(found, 255).astype(np.uint8).reshape(-1, LETTERS)


def _triples(keys: Sequence[str]) -> np.ndarray:
    """Counts, up to 255, of each key's stretches of three letters in TRIPLES cells."""
    out, some = np.zeros((len(keys), TRIPLES), dtype=np.uint8), CELLS_AT_ONCE // TRIPLES
    for at in range(0, len(keys), some):
        points, sizes = _points(keys[at : at + some])
        owner = np.repeat(np.arange(len(sizes)) * TRIPLES, sizes)
        same = owner[2:] == owner[:-2]
        cells = (((points[:-2] * np.uint32(31) + points[1:-1]) * np.uint32(31) + points[2:]) % np.uint32(TRIPLES))[same]
        found = np.bincount(owner[2:][same] + cells, minlength=len(sizes) * TRIPLES)
        out[at : at + some] = np.minimum(found, 255).reshape(-1, TRIPLES)
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the differences of counts, by row."""
    return (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)


def _switches() -> np.ndarray:
    """Parities of 0 to 255 letters of each cell: the n-th letter of a cell switches one bit, of no meaning, in WORDS numbers."""
    bits = np.random.default_rng(0).integers(0, 64 * WORDS, (LETTERS, 255))
    ones = np.zeros((LETTERS, 256, WORDS), dtype=np.uint64)
    np.put_along_axis(ones[:, 1:], bits[:, :, None] // 64, np.left_shift(np.uint64(1), (bits[:, :, None] % 64).astype(np.uint64)), axis=2)
    return np.bitwise_xor.accumulate(ones, axis=1)


SWITCHES = _switches()


def _parities(counts: np.ndarray) -> np.ndarray:
    """WORDS numbers for each key: keys whose counts are d apart differ in d bits at most, also when numbers are put together by XOR."""
    out = np.zeros((len(counts), WORDS), dtype=np.uint64)
    for cell in range(LETTERS):
        out ^= SWITCHES[cell][counts[:, cell]]
    return out


def _folded(parities: np.ndarray, words: int) -> list[np.ndarray]:
    """Parities put together in fewer words."""
    return [np.bitwise_xor.reduce(parities[:, word::words], axis=1) for word in range(words)]


def _grams(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the MIDDLE characters from each start on."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(MIDDLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + points[starts + k]
    return out


class Known(NamedTuple):
    """Keys sorted by size, and what is known of them: counts, parities, and all their stretches of MIDDLE characters by hash."""

    keys: Sequence[str]
    sizes: np.ndarray
    counts: np.ndarray
    triples: np.ndarray
    parities: np.ndarray
    grams: np.ndarray
    owners: np.ndarray


def known(keys: Sequence[str]) -> Known:
    points, sizes = _points(keys)
    counts = _letters(points, sizes)
    ends, owner = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
    starts = np.flatnonzero((np.arange(len(points)) + MIDDLE <= ends) & (sizes[owner] >= LEAST_HELD))
    grams, owner = _grams(points, starts), owner[starts]
    order = np.lexsort((owner, grams))
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), dtype=bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return Known(keys, sizes, counts, _triples(keys), _parities(counts), grams[first], owner[first])


def _common_lengths(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """common_length() of many pairs; but for the longest ones a step of all of them at a time, in 64-bit words."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in pairs]
    out, wide = np.zeros(len(pairs), dtype=np.int64), np.array([len(y) for _, y in pairs], dtype=np.int64)
    for k in np.flatnonzero(wide > WIDE).tolist():
        out[k] = common_length(*pairs[k])
    order = np.argsort(wide, kind="stable")[: np.count_nonzero(wide <= WIDE)]
    for at in range(0, len(order), TOGETHER):
        part = order[at : at + TOGETHER].tolist()
        (x, short), (y, long) = (_points([pairs[k][side] for k in part]) for side in (0, 1))
        letters, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
        words = -(-int(short.max()) // 64)
        many = max(1, CELLS_AT_ONCE // ((words or 1) * (len(letters) + 1)))  # with very many letters a few at a time
        own = np.repeat(np.arange(len(part)), short), np.repeat(np.arange(len(part)), long)
        place = [np.arange(len(z)) - np.repeat(np.cumsum(n) - n, n) for z, n in ((x, short), (y, long))]
        steps = np.full((int(long.max()), len(part)), len(letters))
        steps[place[1], own[1]] = codes[len(x) :]
        for first in range(0, len(part), many):
            these = slice(first, first + many)
            inside = (own[0] >= first) & (own[0] < first + many)
            masks = np.zeros((words, len(short[these]), len(letters) + 1), dtype=np.uint64)
            np.bitwise_or.at(masks, (place[0][inside] // 64, own[0][inside] - first, codes[: len(x)][inside]), np.left_shift(np.uint64(1), (place[0][inside] % 64).astype(np.uint64)))
            rows = np.full(masks.shape[:2], 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            every = np.arange(masks.shape[1])
            for step in steps[:, these]:
                carry = np.zeros(len(every), dtype=np.uint64)
                for mask, row in zip(masks, rows, strict=True):
                    both = row & mask[every, step]
                    half = row + both
                    whole = half + carry
                    carry = ((half < both) | (whole < half)).astype(np.uint64)
                    row[:] = whole | row ^ both
            out[part[these]] = (64 - np.bitwise_count(rows).astype(np.int64)).sum(axis=0)
    return out


def _holds(x: str, y: str) -> bool:
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    return len(short) >= LEAST_HELD and len(short) >= CONTAINED * len(long) and short in long


def _holding(left: Sequence[str], points: np.ndarray, sizes: np.ndarray, counts: np.ndarray, right: Known) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of which one holds the other.

    A stretch in the middle of the left key is in every right key of enough length that it holds, and in every one that holds it.
    """
    rows = np.flatnonzero(sizes >= LEAST_HELD)
    n = sizes[rows]
    start = n - np.maximum(LEAST_HELD, np.ceil(CONTAINED * n)).astype(np.int64)
    grams = _grams(points, (np.cumsum(sizes) - sizes)[rows] + start)
    low, high = (np.searchsorted(right.grams, grams, side) for side in ("left", "right"))
    rows, low, many = rows[high > low], low[high > low], (high - low)[high > low]
    ends = np.cumsum(many)
    for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
        places = np.arange(first, min(first + PAIRS_AT_ONCE, int(ends[-1])))
        at = np.searchsorted(ends, places, "right")
        i, j = rows[at], right.owners[low[at] + places - (ends - many)[at]]
        short, long = np.minimum(sizes[i], right.sizes[j]), np.maximum(sizes[i], right.sizes[j])
        fits = (short >= CONTAINED * long) & (_apart(counts[i], right.counts[j]) <= long - short)
        i, j = i[fits], j[fits]
        held = np.array([_holds(left[a], right.keys[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)
        yield i[held], j[held]


def _near(left: Sequence[str], sizes: np.ndarray, counts: np.ndarray, right: Known, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with a ratio of common characters; left is sorted by size."""
    own, others = ({words: _folded(p, words) for words in (1, 2, WORDS)} for p in (_parities(counts), right.parities))
    least, share = ratio / (200 - ratio), 1 - ratio / 100
    open_pairs: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def verified() -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(*open_pairs, strict=True))
        open_pairs.clear()
        likely = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), CELLS_AT_ONCE // TRIPLES):
            a, b = i[at : at + CELLS_AT_ONCE // TRIPLES], j[at : at + CELLS_AT_ONCE // TRIPLES]
            rows, places = np.unique(a, return_inverse=True)
            likely[at : at + len(a)] = _apart(_triples([left[k] for k in rows.tolist()])[places], right.triples[b]) <= 5 * (share * (sizes[a] + right.sizes[b]) + 1e-6)
        i, j = i[likely], j[likely]
        common = _common_lengths([(left[a], right.keys[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
        near = 200.0 * common / (sizes[i] + right.sizes[j]) >= ratio
        return i[near], j[near]

    for n in np.unique(sizes):
        begin, end = np.searchsorted(sizes, [n, n + 1])
        low, high = np.searchsorted(right.sizes, [np.floor(n * least), np.ceil(n / least) + 1])
        limit = share * (n + right.sizes[low:high]) + 1e-6
        words = next((w for w in (1, 2) if n <= FILLED * w), WORDS)
        step = max(1, CELLS_AT_ONCE // max(1, high - low))
        for at in range(begin, end if high > low else begin, step):
            bits = np.zeros((min(step, end - at), high - low), dtype=np.uint8)  # 64 * WORDS fits
            for mine, other in zip(own[words], others[words], strict=True):
                bits += np.bitwise_count(mine[at : min(at + step, end), None] ^ other[low:high])
            i, j = np.nonzero(bits <= np.clip(limit, 0, 64 * WORDS).astype(np.uint8))
            for first in range(0, len(i), PAIRS_AT_ONCE):
                a, b = i[first : first + PAIRS_AT_ONCE], j[first : first + PAIRS_AT_ONCE]
                fits = _apart(counts[at + a], right.counts[low + b]) <= limit[b]
                open_pairs.append((at + a[fits], low + b[fits]))
                waiting += np.count_nonzero(fits)
                if waiting >= PAIRS_AT_ONCE:
                    yield verified()
                    waiting = 0
    if open_pairs:
        yield verified()


def _near_pairs(left: Sequence[str], right: Known, ratio: float) -> Iterator[tuple[int, int]]:
    """(i, j) of left and right, each once, that are near; left is judged a bounded stretch of characters at a time."""
    lengths = np.array([len(x) for x in left], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    ends, order = np.cumsum(lengths[order]), order.tolist()
    first = 0
    while first < len(order):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHARS_AT_ONCE, "right")))
        part = order[first:last]
        keys = [left[i] for i in part]
        points, sizes = _points(keys)
        counts = _letters(points, sizes)
        for i, j in _holding(keys, points, sizes, counts, right):
            yield from ((part[a], b) for a, b in zip(i.tolist(), j.tolist(), strict=True))
        for i, j in _near(keys, sizes, counts, right, ratio):
            yield from ((part[a], b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if not _holds(keys[a], right.keys[b]))
        first = last


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    """Ids and keys of the left side that are long enough, LEFT_AT_ONCE keys or CHARS_AT_ONCE characters of them and no more than one batch beyond."""
    ids, keys, chars = [], [], 0
    for batch in batches:
        for lid, key in zip(batch["lid"].tolist(), batch["lkey"].tolist(), strict=True):
            if key is not None and len(key) >= LEAST:
                ids.append(lid)
                keys.append(key)
                chars += len(key)
        if len(keys) >= LEFT_AT_ONCE or chars >= CHARS_AT_ONCE:
            yield ids, keys
            ids, keys, chars = [], [], 0
    if keys:
        yield ids, keys


def near_matches(left: DataFrame, right: DataFrame, ratio: float = 88.0) -> DataFrame:
    """(lid, rid, shared): keys of left (lid, lkey) and right (rid, rkey) that are nearly equal or contain each other.

    Keys have 12 characters or more; near are a ratio of common characters, or containment at 20
    characters and 0.65 of the length. shared is how many shingles of SHINGLE characters both have.

    Every pair is judged, none by rank: a character put in or taken out changes the counts of letters
    by one, their parities by one bit and those of three letters in a row by five at most, which rules out
    all pairs of compatible lengths but few, and those are verified. Contained keys meet by a stretch
    that both must have. right, the smaller side, goes out in bounded sets; each is one pass
    over left without a shuffle, so no frequent key, shingle or group is one task.
    """
    kinds = f"lid {left.schema['lid'].dataType.simpleString()}, rid {right.schema['rid'].dataType.simpleString()}, shared bigint"
    a = left.select("lid", "lkey")  # a filter by length would be pushed below what makes the keys, which would then be made twice
    b = right.where(F.length("rkey") >= LEAST).select("rid", "rkey")
    size = b.agg(F.count("*").alias("keys"), F.sum(F.length("rkey")).alias("chars")).first()
    sets = max(1, -(-size["keys"] // KEYS_AT_ONCE), -(-(size["chars"] or 0) // CHARS_AT_ONCE))
    if sets > 1:  # every set reads both sides
        a, b = fixed(a), fixed(b)
    found = None
    for number in range(sets):
        rows = sorted(b.where(F.pmod(F.xxhash64("rid", "rkey"), F.lit(sets)) == number).collect(), key=lambda r: len(r["rkey"]))  # about KEYS_AT_ONCE rows
        if not rows:
            continue
        sent = left.sparkSession.sparkContext.broadcast(([r["rid"] for r in rows], [r["rkey"] for r in rows]))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, keys = sent.value
            there = known(keys)
            for own_ids, own in _gathered(batches):
                out = []
                for i, j in _near_pairs(own, there, ratio):
                    x, y = ({k[at : at + SHINGLE] for at in range(len(k) - SHINGLE + 1)} for k in (own[i], keys[j]))
                    out.append((own_ids[i], ids[j], len(x & y)))
                    if len(out) >= PAIRS_AT_ONCE:
                        yield pd.DataFrame(out, columns=["lid", "rid", "shared"])
                        out = []
                yield pd.DataFrame(out, columns=["lid", "rid", "shared"])

        met = a.mapInPandas(run, kinds)
        if sets > 1:  # so that no more than one set is held at a time
            met = fixed(met)
            sent.destroy()
        found = met if found is None else found.unionByName(met)
    return left.sparkSession.createDataFrame([], kinds) if found is None else found
