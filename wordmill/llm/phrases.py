"""Collocations by set-oriented mining (SETM): occurrence relations joined with themselves by place.

R_k holds a row for every place where a frequent phrase of k words stands: its chunk, its place there and
its k words, in the order of places. It is kept as Parquet, the rows of a chunk as columns of one record, in
row groups of RECORD_BYTES, so that what a task holds doesn't grow with the records that it reads or writes;
a chunk is up to CHUNK_WORDS words of texts of one language, places count on through it, and one place is
left out between pieces, so that no phrase crosses from one piece into the next.

* Join: the next length comes from two rows of R_k at adjacent places of a piece, found by merging R_k with
  itself in the order of places, chunk by chunk.
* Count: the groups of a chunk are counted where they are; Spark sums them over chunks, by all words of a group.
* Semi-join: rows whose group is frequent make R_(k+1). Every task holds the frequent groups as a Bloom
  filter of FILTER_BITS bits, whatever their number. A row that passes by mistake costs time only: every count is exact.

Words are known by 64-bit hashes of language and word. That no frequent word shares its hash with
another word is checked on the table of all words; another seed is taken where one does.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from .common import bytes_at_once, written

LEAST = 30
LONGEST = 4
FIRST = 2000
CHUNK_WORDS = 600_000
#: Bytes of a relation that a task holds at once where it writes, reads or passes on records, or one record; a chunk of many words has 6 MB.
RECORD_BYTES = 16 << 20
#: Texts that are split at once.
TEXTS_AT_ONCE = 500
FILTER_BITS = 26
PROBES = 3
#: Tasks that find a language's first phrases before one task orders what they found.
SALTS = 64
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
#: A-Z in lower case, and line feed for every character that ends a piece.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n")


class _Codes(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


class _Chunk:
    """The words of one language's texts: a code for each place, -1 between pieces."""

    def __init__(self) -> None:
        self.codes, self.places, self.words = _Codes(), array("i"), 0

    def add(self, piece: list[bytes]) -> None:
        self.places.extend(map(self.codes.__getitem__, piece))
        self.places.append(-1)
        self.words += len(piece)


def pieces(text: bytes) -> list[list[bytes]]:
    """The words of each piece of a text, in lower case; pieces without a word are left out."""
    return [words for piece in text.translate(_TABLE).split(b"\n") if (words := piece.split())]


def _bytes(values: np.ndarray) -> bytes:
    return values.astype("<i4").tobytes()


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<i4")


def occurrences(docs: DataFrame, seed: int, text_col: str, lang_col: str, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """R_1 of all words: (chunk, lang, words, hashes, counts, place, items), one row for each chunk.

    words, hashes and counts list the chunk's distinct words; place holds the steps from place to place,
    items the number of the word there.
    """
    ddl = StructType.fromDDL("chunk bigint, lang string, words array<string>, hashes array<bigint>, counts array<bigint>, place binary, items binary")
    schema = to_arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, _Chunk] = {}

        def row(lang: str, chunk: _Chunk) -> pa.RecordBatch:
            nonlocal number
            number += 1
            codes = np.frombuffer(chunk.places, dtype=np.int32)
            at = np.flatnonzero(codes >= 0)
            head = lang.encode() + b"\x00"
            hashes = np.fromiter((xxh64_intdigest(head + w, seed) for w in chunk.codes), np.uint64, len(chunk.codes)).view(np.int64)
            counts = np.bincount(codes[at], minlength=len(chunk.codes))
            values = (number, lang, [w.decode() for w in chunk.codes], hashes, counts, _bytes(np.diff(at, prepend=0)), _bytes(codes[at]))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

        for batch in (whole.slice(at, TEXTS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, TEXTS_AT_ONCE)):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("t").cast(pa.binary()).to_pylist(), strict=True):
                for piece in pieces(text or b""):
                    chunk = held.setdefault(lang, _Chunk())
                    chunk.add(piece)
                    if chunk.words >= chunk_words:
                        yield row(lang, held.pop(lang))
        for lang in list(held):
            yield row(lang, held.pop(lang))

    return docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("t")).mapInArrow(run, ddl)


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number for the hashes of each group."""
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        out = (out ^ column.view(np.uint64)) * _ODD[0]
        out ^= out >> np.uint64(32)
    return out


def _slots(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The bits of a filter that stand for each group."""
    mixed = _mixed(columns)
    return [((mixed * odd) >> np.uint64(64 - bits)).astype(np.int64) for odd in _ODD[:PROBES]]


def _names(k: int) -> list[str]:
    return [f"h{i}" for i in range(k)]


class Filter:
    """A Bloom filter of groups of hashes, held once by every worker."""

    def __init__(self, groups: DataFrame, k: int, bits: int = FILTER_BITS) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.unique(np.concatenate(_slots([batch.column(n).to_numpy() for n in _names(k)], bits)))
                yield pa.RecordBatch.from_pydict({"slot": found >> 6, "value": np.left_shift(np.uint64(1), (found & 63).astype(np.uint64)).view(np.int64)})

        marks = groups.select(_names(k)).mapInArrow(run, "slot bigint, value bigint").groupBy("slot").agg(F.bit_or("value").alias("value"))
        found = marks.toArrow()  # 2^(bits - 6) rows at most
        words = np.zeros(1 << (bits - 6), dtype=np.int64)
        words[found["slot"].to_numpy()] = found["value"].to_numpy()
        self.bits, self.held = bits, groups.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def has(self, columns: list[np.ndarray]) -> np.ndarray:
        words, out = self.held.value, np.ones(len(columns[0]), dtype=bool)
        for slots in _slots(columns, self.bits):
            out &= (words[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


Relation = tuple[np.ndarray, np.ndarray, np.ndarray]


def _relation(row: dict, k: int) -> Relation:
    """(hashes of the chunk's words, places, their words' numbers) of one chunk."""
    return np.array(row["hashes"], dtype=np.int64), np.cumsum(_ints(row["place"])), _ints(row["items"]).reshape(-1, k)


def merge_join(places: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length k + 1 from those of length k at adjacent places. Places are in order, so the partner is the next row or none."""
    at = np.flatnonzero(places[1:] == places[:-1] + 1)
    return places[at], np.concatenate([items[at], items[at + 1, -1:]], axis=1)


def _columns(hashes: np.ndarray, items: np.ndarray) -> list[np.ndarray]:
    return [hashes[items[:, i]] for i in range(items.shape[1])]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].values.to_numpy() if name == "hashes" else batch.column(name)[i].as_py() for name in batch.schema.names}


def group_counts(relation: DataFrame, k: int, single: Filter | None, least: int) -> DataFrame:
    """(h0 .., f) of the groups of k words that occur `least` times, from R_(k-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes, places, items = _relation(row, k - 1)
            places, items = merge_join(*_kept(hashes, places, items, single))
            group = items[:, 0].astype(np.int64)
            for i in range(1, k):
                _, group = np.unique(group * len(hashes) + items[:, i], return_inverse=True)
            _, first, count = np.unique(group, return_index=True, return_counts=True)
            columns = _columns(hashes, items[first])
            yield pa.RecordBatch.from_pydict(dict(zip(_names(k), columns, strict=True)) | {"n": count.astype(np.int64)})

    schema = ", ".join(f"{n} bigint" for n in [*_names(k), "n"])
    counted = relation.select("hashes", "place", "items").mapInArrow(run, schema)
    return counted.groupBy(_names(k)).agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _kept(hashes: np.ndarray, places: np.ndarray, items: np.ndarray, groups: Filter | None) -> tuple[np.ndarray, np.ndarray]:
    if groups is None:
        return places, items
    stays = groups.has(_columns(hashes, items))
    return places[stays], items[stays]


def semi_join(relation: DataFrame, k: int, single: Filter | None, frequent: Filter) -> DataFrame:
    """R_k from R_(k-1): the joined rows whose group is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes, places, items = _relation(row, k - 1)
            places, items = _kept(hashes, *merge_join(*_kept(hashes, places, items, single)), frequent)
            used, items = np.unique(items, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"hashes": pa.array([hashes[used]], pa.list_(pa.int64())), "place": [_bytes(np.diff(places, prepend=0))], "items": [_bytes(items.ravel())]})

    return relation.select("hashes", "place", "items").mapInArrow(run, "hashes array<bigint>, place binary, items binary")


def _words(docs: DataFrame, text_col: str, lang_col: str, least: int, chunk_words: int) -> tuple[DataFrame, DataFrame]:
    """(R_1, (lang, word, h0, f) of all words), hashed so that no frequent word shares its hash."""
    for seed in range(8):
        relation = written(occurrences(docs, seed, text_col, lang_col, chunk_words), "occurrences-1", "zstd", RECORD_BYTES)
        one = relation.select("lang", F.explode(F.arrays_zip("words", "hashes", "counts")).alias("w"))
        words = one.groupBy("lang", F.col("w.words").alias("word"), F.col("w.hashes").alias("h0")).agg(F.sum("w.counts").alias("f"))
        words = written(words, "words", "zstd")
        if words.groupBy("h0").agg(F.count("*").alias("n"), F.max("f").alias("f")).where((F.col("n") > 1) & (F.col("f") >= least)).isEmpty():
            return relation, words
    raise RuntimeError("frequent words share their hashes under every seed")


def _exact(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def _cut(table: dict[int, DataFrame], k: int) -> DataFrame:
    """(h0 .., a, l, r, score) of the phrases of k words, by their lowest-scoring cut."""
    out, cuts = table[k].withColumnRenamed("f", "a"), []
    for at in range(1, k):
        left = table[at].select(*(F.col(f"h{i}").alias(f"l{i}") for i in range(at)), F.col("f").alias("l"))
        right = table[k - at].select(*(F.col(f"h{i}").alias(f"r{i}") for i in range(k - at)), F.col("f").alias("r"))
        out = out.join(left, [out[f"h{i}"] == left[f"l{i}"] for i in range(at)]).drop(*(f"l{i}" for i in range(at)))
        out = out.join(right, [out[f"h{at + i}"] == right[f"r{i}"] for i in range(k - at)]).drop(*(f"r{i}" for i in range(k - at)))
        score = F.expr("cast(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
        out = out.withColumn(f"cut{at}", F.struct(score.alias("score"), F.lit(at).alias("at"), "l", "r")).drop("l", "r")
        cuts.append(f"cut{at}")
    return out.withColumn("cut", F.array_min(F.array(*cuts))).select(*_names(k), "a", "cut.l", "cut.r", "cut.score")


def _inside(table: dict[int, DataFrame], k: int) -> DataFrame:
    """(h0 .., longer) of phrases of k words: the count of the most frequent longer one that holds it."""
    parts = [
        table[m].select(*(F.col(f"h{at + i}").alias(f"h{i}") for i in range(k)), "f")
        for m in range(k + 1, LONGEST + 1)
        for at in range(m - k + 1)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(_names(k)).agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, first: int = FIRST, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Each language's first phrases of 2 to 4 words: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z) and split into pieces at sentence marks and line ends, pieces into words at
    spaces and tabs. a is how often the phrase stands within pieces (`least` times at least), l and r the same
    for the two parts of the cut that gives the least 2000000 * a / (l + r), which rounded down is the
    score (ties: the earlier cut), n all words of the language. A phrase that a longer frequent one holds in 80 of 100 of its
    occurrences is left out. Order: score, then a, both descending, then phrase by its bytes. Null and empty
    texts have no words; a null language is `und`; repeated rows count as often as they are there; an empty table gives an
    empty result; long texts are read whole, over several chunks where need be. Other columns are not read.
    """
    with bytes_at_once(docs.sparkSession, RECORD_BYTES):
        relation, words = _words(docs, text_col, lang_col, least, chunk_words)
        table = {1: words.where(F.col("f") >= least).select("h0", "f")}
        single: Filter | None = Filter(table[1], 1)
        for k in range(2, LONGEST + 1):
            table[k] = written(group_counts(relation, k, single, least), f"phrases-{k}")
            if k < LONGEST:
                relation = written(semi_join(relation, k, single, Filter(table[k], k)), f"occurrences-{k}", "zstd", RECORD_BYTES)
            single = None

    names = words.where(F.col("f") >= least).select(F.col("h0").alias("h"), "word", "lang")
    found = None
    for k in range(2, LONGEST + 1):
        kept = _cut(table, k)
        if k < LONGEST:
            kept = kept.join(_inside(table, k), _names(k), "left").where(F.col("longer").isNull() | (100 * _exact("longer") < 80 * _exact("a")))
        for i in range(k):
            word = names.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), *(["lang"] if i == 0 else []))
            kept = kept.join(word, f"h{i}")
        kept = kept.select("lang", F.concat_ws(" ", *(f"w{i}" for i in range(k))).alias("phrase"), "a", "l", "r", "score")
        found = kept if found is None else found.unionByName(kept)
    found = written(found, "phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
