"""Nearest neighbours by score-aware (anisotropic) quantisation, four-bit table scans and exact reranking.

Vectors are scaled to length one, so the largest inner product is the largest cosine. They are cut
into subspaces of two dimensions, each with a codebook of 16 centres (four bits). The codebooks and
codes minimise a loss in which the part of the residual parallel to the vector weighs more than the
rest: that part is what moves the scores of the queries for which the vector matters.

A query makes one table of 16 inner products per subspace; tables of two neighbouring subspaces are
joined to one of 256, so a byte of code is one look-up. The best SHORTLIST by these sums in a block
of vectors are scored exactly, in double precision. A sum is off by the vector's residual at most, so
every other vector whose sum and residual together reach the k-th of these scores is scored too:
the block's best are exact, also among close copies. The blocks' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CENTRES = 16
#: How much more the parallel part of a residual weighs.
PARALLEL = 4.0
#: Vectors that the codebooks are fitted on, at most; every vector is indexed.
SAMPLE = 8192
#: First exact scores for each query in a block of vectors, vectors in a block, queries sent out at once.
SHORTLIST = 96
BLOCK = 4096
QUERIES_AT_ONCE = 4096
SCAN_AT_ONCE = 64


@dataclass
class Codebooks:
    """centres: (subspaces, 16, width of a subspace)."""

    centres: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[2]

    def encode(self, unit: np.ndarray, rounds: int = 3) -> np.ndarray:
        """(n, subspaces) codes of unit vectors by coordinate descent on the anisotropic loss."""
        n, parts = len(unit), len(self.centres)
        cut = unit.reshape(n, parts, self.width)
        codes = np.empty((n, parts), dtype=np.uint8)
        along = np.empty((n, parts))
        inner = np.empty((n, parts, CENTRES), dtype=np.float32)
        square = np.empty((n, parts, CENTRES), dtype=np.float32)
        for p in range(parts):
            rest = cut[:, p, None, :] - self.centres[p][None]
            square[:, p] = (rest * rest).sum(axis=2)
            inner[:, p] = (rest * cut[:, p, None, :]).sum(axis=2)
            codes[:, p] = square[:, p].argmin(axis=1)
            along[:, p] = inner[np.arange(n), p, codes[:, p]]
        # loss = |residual|^2 + (PARALLEL - 1) <residual, x>^2 for x of length one
        for _ in range(rounds):
            for p in range(parts):
                others = along.sum(axis=1) - along[:, p]
                loss = square[:, p] + (PARALLEL - 1) * (others[:, None] + inner[:, p]) ** 2
                codes[:, p] = loss.argmin(axis=1)
                along[:, p] = inner[np.arange(n), p, codes[:, p]]
        return codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, pairs of subspaces, 256) sums of inner products."""
        parts = len(self.centres)
        one = np.einsum("qpw,pcw->qpc", queries.reshape(len(queries), parts, self.width), self.centres)
        if parts % 2:
            one = np.concatenate([one, np.zeros((len(queries), 1, CENTRES))], axis=1)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), -1, CENTRES * CENTRES).astype(np.float32)


def residuals(unit: np.ndarray, codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """Lengths of what the packed codes miss of unit vectors."""
    parts = len(books.centres)
    each = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, :parts]
    total = np.zeros(len(unit))
    for p in range(parts):
        rest = unit[:, p * books.width : (p + 1) * books.width] - books.centres[p][each[:, p]]
        total += (rest * rest).sum(axis=1)
    return np.sqrt(total)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def train(unit: np.ndarray, rounds: int = 8, seed: int = 5) -> Codebooks:
    """Codebooks by turns of anisotropic assignment and weighted least squares for every centre."""
    rng = np.random.default_rng(seed)
    n, size = unit.shape
    width = 2 if size % 2 == 0 else 1
    parts = size // width
    cut = unit.reshape(n, parts, width)
    centres = np.zeros((parts, CENTRES, width))
    for p in range(parts):
        pick = cut[rng.choice(n, CENTRES, replace=n < CENTRES), p]
        centres[p] = pick + rng.normal(0, 1e-4, pick.shape)
    books = Codebooks(centres)
    for _ in range(rounds):
        codes = books.encode(unit, 1)
        along = np.empty((n, parts))
        for p in range(parts):
            along[:, p] = ((cut[:, p] - centres[p][codes[:, p]]) * cut[:, p]).sum(axis=1)
        total = along.sum(axis=1)
        for p in range(parts):
            x = cut[:, p]
            others = total - along[:, p]
            # for one centre c: sum |x - c|^2 + (PARALLEL - 1) (others + <x, x> - <c, x>)^2 is least at A c = b
            lift = (PARALLEL - 1) * (others + (x * x).sum(axis=1))
            for c in range(CENTRES):
                own = codes[:, p] == c
                if own.any():
                    y = x[own]
                    a = own.sum() * np.eye(width) + (PARALLEL - 1) * y.T @ y
                    centres[p, c] = np.linalg.solve(a, y.sum(axis=0) + y.T @ lift[own])
                else:
                    centres[p, c] = x[rng.integers(n)]
    return books


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors with an id, of finite components that are not all zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    out = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return out.where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite & some, F.lit(False)))


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Codebooks | None:
    """Codebooks fitted on at most so many vectors, picked by the hash of the id; None without any vector."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    return train(_unit(np.array([r["v"] for r in rows]))) if rows else None


def index(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(id, v, code) for every vector: its four-bit codes, two to a byte."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)  # 16 centres per subspace

    @F.pandas_udf("binary")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if len(batch):
                codes = packed(sent.value.encode(_unit(np.stack(batch.to_numpy()))))
                yield pd.Series([c.tobytes() for c in codes])
            else:
                yield pd.Series([], dtype=object)

    return vectors.withColumn("code", code("v"))


def _scan_block(ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, books: Codebooks, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    order = np.argsort(ids, kind="stable")  # ties go to smaller ids, in the short list too
    ids, rows, codes = ids[order], rows[order], codes[order]
    columns = np.ascontiguousarray(codes.T)
    lengths = np.sqrt((rows * rows).sum(axis=1))
    slack = residuals(_unit(rows), codes, books) + 1e-6 * (1 + len(columns))  # sums are in single precision
    first = max(SHORTLIST, k + 1)  # the query itself may be among them
    for at in range(0, len(queries), SCAN_AT_ONCE):
        part, part_ids = queries[at : at + SCAN_AT_ONCE], query_ids[at : at + SCAN_AT_ONCE]
        tables = books.tables(_unit(part))
        part_lengths = np.sqrt((part * part).sum(axis=1))
        for q in range(len(part)):
            rough = np.zeros(len(ids), dtype=np.float32)
            for column, table in zip(columns, tables[q], strict=True):
                rough += table[column]
            rough[ids == part_ids[q]] = -np.inf
            short = np.argpartition(rough, len(ids) - first)[-first:] if len(ids) > first else np.arange(len(ids))
            short = short[ids[short] != part_ids[q]]
            exact = (rows[short] @ part[q]) / (lengths[short] * part_lengths[q])
            if len(ids) > first:
                least = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
                short = np.flatnonzero(~(rough + slack < least) & (ids != part_ids[q]))
                exact = (rows[short] @ part[q]) / (lengths[short] * part_lengths[q])
            best = np.lexsort((ids[short], -exact))[:k]
            yield pd.DataFrame({"query_id": part_ids[q], "vec_id": ids[short][best], "score": exact[best]})


def nearest(
    vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for every vector whose id is divisible by `every`.

    Candidates are all rows but those with the query's id; score is the exact cosine of the original
    vectors in double precision, ties go to the smaller id. Null, zero and non-finite vectors and null ids take
    no part. Vectors of another length are a table of their own, as a cosine needs equal lengths. Vectors that are equal are candidates each; a repeated id is one query for each of
    its rows' vectors, whose answers merge. Extra columns are not read.

    The index is written once. Queries go out in bounded sets; for each, one pass without a shuffle
    scans blocks of the index, and only k rows per query and block are merged.
    """
    clean = usable(vectors, id_col, vector_col)
    lengths = sorted(r["n"] for r in clean.groupBy(F.size("v").alias("n")).count().collect())  # one row for each length
    found = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for n in lengths:
        found = found.unionByName(_nearest(clean.where(F.size("v") == n), k, every, block))
    return found


def _nearest(clean: DataFrame, k: int, every: int, block: int) -> DataFrame:
    """nearest() over vectors (id, v) of one length."""
    spark = clean.sparkSession
    books = fit(clean)
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if books is None:
        return spark.createDataFrame([], empty)
    table = written(index(clean, books), "ann-index")
    count = table.count()
    blocks = max(1, -(-count // block))
    dealt = written(table.repartition(blocks), "ann-blocks")
    queries = table.where(F.col("id") % every == 0).select("id", "v")
    sets = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    books_sent = spark.sparkContext.broadcast(books)
    found = []
    for number in range(sets):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(sets)) == number).collect()  # about QUERIES_AT_ONCE rows
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows])))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    codes = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(batch), -1)
                    parts = list(_scan_block(batch["id"].to_numpy(), np.stack(batch["v"].to_numpy()), codes, books_sent.value, *sent.value, k))
                    yield pd.concat(parts, ignore_index=True)

        found.append(dealt.mapInPandas(run, "query_id bigint, vec_id bigint, score double"))
    if not found:
        return spark.createDataFrame([], empty)
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
