"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. The perfect binary Golay code
(23, 12, 7) maps a segment, padded with zeros, to its one nearest codeword (12 bits). Two segments
that differ in at most one bit share a codeword when one side gives its own nearest codeword and the
other side the nearest codewords of all vectors one flip away (one key, or six).

Three errors over three segments leave two cases (pigeonhole):

* some segment has none: one of the other two then has at most one error, so the pair meets under
  (exact segment, codeword of the other), in one of six orders;
* every segment has exactly one: the pair meets under the codewords of all three together with the
  parities of all three.

Keys therefore hold 33 to 39 bits, candidates are few, and every candidate is verified by its
Hamming distance inside the join, so only true links leave it.

A dense cluster of n fingerprints would still give up to n * n candidates under one key. Fingerprints
under such a heavy key are linked through hubs instead: two of them are within three bits if and only
if some word is one bit or less from the one and two bits or less from the other. All fingerprints
near a word are linked to one of those within one bit of it, which is a true link for each: the links
grow with n, and reach whatever all pairs would.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import id_type, join_hot, written
from .components import components

#: Fixed value: the generator polynomial of the (23, 12) Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
#: Fingerprints of a key above which it is heavy.
HEAVY = 2_000
#: Rows to leave out that may be broadcast (two longs each); with more, they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def text_fingerprint(text: str | None) -> int:
    """The unsigned SimHash of one whole text; 0 for a text without a word, and for null."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp): for every row the hash of its text and the 64-bit fingerprint of the whole text, a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([text_fingerprint(t) for t in batch["t"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "key": batch["key"], "fp": values.view(np.int64)})

    kind = id_type(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("t"))
    return rows.mapInPandas(run, f"id {kind}, key bigint, fp bigint")


def _remainders() -> np.ndarray:
    """Remainder by the generator of every single bit of a 23-bit word."""
    out, value = [], 1
    for _ in range(23):
        out.append(value)
        value <<= 1
        if value & 0x800:
            value ^= GENERATOR
    return np.array(out, dtype=np.int64)


class Golay:
    """Nearest codewords of 23-bit words held in integer arrays."""

    def __init__(self) -> None:
        self.bit = _remainders()
        low = np.zeros(1 << 12, dtype=np.int64)
        high = np.zeros(1 << 11, dtype=np.int64)
        for j in range(12):
            low[np.arange(1 << 12) >> j & 1 == 1] ^= self.bit[j]
        for j in range(11):
            high[np.arange(1 << 11) >> j & 1 == 1] ^= self.bit[12 + j]
        self.low, self.high = low, high
        # every error of weight 0 to 3 has its own remainder: the code is perfect
        self.error = np.zeros(1 << 11, dtype=np.int64)
        flips = [(0, 0)] + [(1 << j, int(self.bit[j])) for j in range(23)]
        for a, ra in flips:
            for b, rb in flips:
                for c, rc in flips:
                    self.error[ra ^ rb ^ rc] = a ^ b ^ c

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index (12 message bits) of the codeword nearest to each word."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.error[syndrome]) >> 11

    def around(self, words: np.ndarray, bits: int) -> np.ndarray:
        """(n, bits + 1): nearest codewords of each word and of its one-bit neighbours; repeats are -1."""
        flips = np.concatenate([[0], 1 << np.arange(bits)])
        found = np.sort(self.nearest(words[:, None] ^ flips[None, :]), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def _crossed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys for all combinations of each row's codewords (-1: none)."""
    rows = np.arange(len(parts[0]))
    key = np.zeros(len(rows), dtype=np.int64)
    for part in parts:
        part = part[rows]
        at, which = np.nonzero(part >= 0)
        key = (key[at] << 12) | part[at, which]
        rows = rows[at]
    return rows, key


def candidate_keys(values: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((rows, keys) of the narrow side, (rows, keys) of the wide side) for unsigned fingerprints.

    Two fingerprints at a distance of 3 or less share a key whichever of them takes which side.
    """
    code = golay()
    parts = [((values >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    one = [code.nearest(p)[:, None] for p in parts]
    some = [code.around(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    every = np.arange(len(values))
    narrow, wide = [], []
    for tag, (x, y) in enumerate(permutations(range(3), 2)):
        base = ((np.int64(tag) << 22) | parts[x]) << 12
        narrow.append((every, base | one[y][:, 0]))
        at, which = np.nonzero(some[y] >= 0)
        wide.append((at, base[at] | some[y][at, which]))
    parity = np.zeros(len(values), dtype=np.int64)
    for p in parts:
        parity = (parity << 1) | (np.bitwise_count(p) & 1)
    # one error in each segment flips every parity: the wide side states what its partner has
    for into, sides, flag in ((narrow, [some[0], one[1], some[2]], parity), (wide, [one[0], some[1], one[2]], parity ^ 7)):
        rows, key = _crossed(sides)
        into.append((rows, (((np.int64(7) << 3) | flag[rows]) << 36) | key))
    return tuple((np.concatenate([r for r, _ in side]), np.concatenate([k for _, k in side])) for side in (narrow, wide))


def _keys(values: DataFrame, side: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            rows, key = candidate_keys(fp.view(np.uint64))[side]
            yield pd.DataFrame({"key": key, "fp": fp[rows]})

    return values.select("fp").mapInPandas(run, "key bigint, fp bigint")


def _flips(most: int) -> np.ndarray:
    """All 64-bit words of `most` bits or fewer."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    out = [np.zeros(1, np.uint64), one]
    if most > 1:
        a, b = np.triu_indices(64, 1)
        out.append(one[a] | one[b])
    return np.concatenate(out)


def hub_links(values: DataFrame) -> DataFrame:
    """Pairs (u, v) of fingerprints in column fp that are within 3 bits: as many as connect all such pairs.

    Every fingerprint names the 2,081 words within two bits of it, and tells which are within one. A word that is
    within one bit of some is a hub: whatever names it is within three bits of the least of those.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = _flips(2)
        close = np.arange(len(flips)) <= 64
        for batch in batches:
            for at in range(0, len(batch), 256):
                fp = batch["fp"].to_numpy()[at : at + 256]
                hubs = (fp.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64)
                yield pd.DataFrame({"hub": hubs.ravel(), "fp": np.repeat(fp, len(flips)), "close": np.tile(close, len(fp))})

    named = values.select("fp").mapInPandas(run, "hub bigint, fp bigint, close boolean")
    near = Window.partitionBy("hub")  # a hub is named by 2,081 fingerprints at most
    least = named.withColumn("least", F.min(F.when(F.col("close"), F.col("fp"))).over(near))
    met = least.where((F.col("least") != F.col("fp")) & F.col("least").isNotNull())
    return met.select(F.least("fp", "least").alias("u"), F.greatest("fp", "least").alias("v")).distinct()


def links(values: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Pairs (u < v) of the distinct fingerprints in column fp that differ in 3 bits or fewer.

    All such pairs that no heavy key (of more than `heavy` fingerprints) brings together, and of those
    that one does, as many as connect the same fingerprints.
    """
    left = written(_keys(values, 0).withColumnRenamed("fp", "u"), "simhash-keys")
    right = _keys(values, 1).withColumnRenamed("fp", "v")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE)
    crowded = written(left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("key"), "heavy-keys")
    count = crowded.count()
    if not count:
        return left.join(right.hint("merge"), (left["key"] == right["key"]) & near).select("u", "v")
    right = written(right, "simhash-keys")
    small = F.broadcast(crowded) if count <= BROADCAST_ROWS else crowded
    plain = left.join(small, "key", "left_anti")
    light = plain.join(right.hint("merge"), (plain["key"] == right["key"]) & near).select("u", "v")
    dense = left.join(small, "key", "left_semi").select(F.col("u").alias("fp")).unionByName(right.join(small, "key", "left_semi").select(F.col("v").alias("fp")))
    return light.unionByName(hub_links(dense.distinct()))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, id, key, root, component_id) of every row; root is the same within a group."""
    known = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(known.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("size")), "distinct-fingerprints")
    total, fps = distinct.agg(F.sum("size"), F.count("*")).first()
    rooted = components(links(distinct))
    labelled = distinct.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", "size", "least", F.coalesce("root", "fp").alias("root"))
    labelled = written(labelled, "rooted-fingerprints")
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_hot(labelled, least, "root", "members", fps)
    return join_hot(known, named.select("fp", "root", "component_id", "size"), "fp", "size", total or 0)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, fingerprint, component_id).

    component_id is the smallest id that links of 3 or fewer differing bits reach, the row's own
    included. Null and empty texts, and texts of white space only, have fingerprint zero and link like
    any other. Repeated rows come out as often as they came in. A null id takes part but is never a
    component_id unless its component has no other. Very long texts are read whole. Other columns of docs
    are not read.
    """
    out = _grouped(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each group: the one with the smallest id, nulls last.

    Of rows that repeat that id, the one whose text has the least hash stays, once; of those that repeat
    id and text, the one whose columns come first as JSON. Null and empty texts are one group.
    """
    rows = written(_grouped(docs, id_col, text_col).groupBy("root", "id", "key").agg(F.count("*").alias("n")), "grouped-rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("s"), F.count("*").alias("size"))
    rows = join_hot(rows, first, "root", "size", rows.count())
    stays = F.col("id").eqNullSafe(F.col("s.id")) & (F.col("key") == F.col("s.key"))
    marked = written(
        rows.where(~stays | (F.col("n") > 1)).select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key"), stays.alias("stays")), "near-copies"
    )

    def meets(side: DataFrame):
        return held["own_id"].eqNullSafe(side["gone_id"]) & (held["own_key"] == side["gone_key"])

    held = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_key"))
    gone = marked.drop("stays")
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = held.join(gone, meets(gone), "left_anti").select("row")
    repeated = marked.where("stays").drop("stays")
    if repeated.limit(1).count():  # rows that stay and have equals
        again = held.join(repeated, meets(repeated), "left_semi")
        kept = kept.unionByName(again.groupBy("own_id", "own_key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return kept.select("row.*")
