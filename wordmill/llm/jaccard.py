"""Exact Jaccard self join of shingle sets in their metric space: pivots, Voronoi regions, triangle windows.

Two texts link when their sets of word shingles have a Jaccard similarity of `percent` hundredths or
more, that is a distance of at most r = 1 - percent / 100. Equal sets are one node from the start.

Regions. Texts that share nothing are all at distance 1 from each other and from every pivot, so no
window could tell them apart. The first regions therefore come from the part of the space where they do
differ: the universe of shingles is cut into parts by hash, and a region is what agrees in one part.
Linked sets of at most b shingles differ in at most D = 2b(100 - percent) / (100 + percent) shingles;
of D + 1 + e parts at least 1 + e agree. Each set enters the regions of all parts but its e least, and
the largest part on which two linked sets agree is among those of both: no link is lost. Sizes are cut
into bands, so that both sets of a pair are cut alike; a set also enters the band above where a partner may be there.

Inside a region pivots are chosen among the nodes that links do not yet connect with the region's largest
group; the first is the node that shares most regions, which connects most groups of copies. All its nodes get their exact distances from the pivots. Each goes to the Voronoi cell of its
nearest pivot, at distance d, and to every cell whose pivot is at most d + 2r away: by the triangle
inequality two linked nodes meet in the cell of either. Pivots have met everyone and leave; cells are
regions of the next step. A region whose windows would take in too much stays whole. It, and one with LEAF
nodes or fewer outside its largest group, is ended by making pivots of all of those; a sketch of 512 parities,
which differ no more than the sets do, leaves few of these pairs to be measured. Regions whose nodes are all connected are left.

Only nodes of regions that two different sets share are ever compared; their sets are made once more
from the texts, and every distance is the size of an intersection, not an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import id_type, join_hot, written
from .components import components

SHINGLE_WORDS = 3
PERCENT = 90
SEED = 42
#: Nodes outside the largest group of a region that is ended in one step, and about how many pivots a larger one gets.
LEAF = 1000
PIVOTS = 32
#: Columns of a set's sketch.
SKETCH = tuple(f"s{i}" for i in range(8))
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles; of fewer words, the one of them all; of none, nothing."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64))


def least_size(percent: int) -> int:
    """Shingles of the smallest set that can link with a smaller one."""
    return -(-100 // (100 - percent))


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(number, greatest size) of the bands in which a set of `size` may be the larger or the smaller one of a linked pair."""
    out, number, low = [], 0, least_size(percent)
    while low <= 100 * size // percent:
        above = max(low + 1, low * 7 // 5)
        if above > size:
            out.append((number, above - 1))
        number, low = number + 1, above
    return out


def part_keys(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys of the regions that a set enters; sets that can only link with their equals enter none."""
    out = [np.zeros(0, dtype=np.int64)]
    for number, top in bands(len(hashes), percent) if percent < 100 else ():
        apart = 2 * top * (100 - percent) // (100 + percent)
        spare = 1 + apart // 8
        parts = apart + 1 + spare
        at = (hashes % np.uint64(parts)).astype(np.int64)
        mixed = hashes * _ODD[0]
        mixed ^= mixed >> np.uint64(31)
        low = np.bincount(at, weights=(mixed & np.uint64(0xFFFFFFFF)).astype(float), minlength=parts).astype(np.uint64)
        high = np.bincount(at, weights=(mixed >> np.uint64(32)).astype(float), minlength=parts).astype(np.uint64)
        size = np.bincount(at, minlength=parts)
        content = low * _ODD[1] ^ high * _ODD[2]
        kept = np.lexsort((content, size))[spare:]  # stable: of equals, the part with the smaller number comes first
        key = (content + np.arange(parts, dtype=np.uint64) * _ODD[3] + np.uint64(number)) * _ODD[0]
        key ^= key >> np.uint64(29)
        out.append(key[kept].view(np.int64))
    return np.concatenate(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """64 bits for each column of SKETCH: whether an odd number of shingles falls into a cell. Two sets differ in at least as many shingles as bits."""
    return np.packbits(np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=64 * len(SKETCH)) & 1, bitorder="little").view(np.int64)


def _described(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, tkey, n, node, short, keys) of every row: a hash of the text, the set's size, its 128-bit digest, 64 bits of that, its keys.

    node and short are null for sets without a shingle. A task gives the keys of equal sets once.
    """
    kind = id_type(docs, id_col)
    ddl = StructType.fromDDL(f"id {kind}, tkey bigint, n bigint, node binary, short bigint, keys array<bigint>")
    schema = to_arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, nodes, shorts, keys = [], [], [], []
            for text in batch.column("t").to_pylist():
                hashes = shingle_set(text)
                node = xxh3_128_digest(hashes.tobytes()) if len(hashes) else None
                short = int.from_bytes(node[:8], "little", signed=True) if node else None
                sizes.append(len(hashes))
                nodes.append(node)
                shorts.append(short)
                keys.append(None if short is None or short in seen else part_keys(hashes, percent))
                seen.add(short)
            columns = [batch.column("id"), batch.column("tkey"), *(pa.array(x, t) for x, t in zip((sizes, nodes, shorts, keys), schema.types[2:], strict=True))]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("t")).mapInArrow(run, ddl)


def _sets(texts: DataFrame) -> DataFrame:
    """(node, n, shingles, s0 ..) of the rows of (node, t)."""
    ddl = StructType.fromDDL("node binary, n bigint, shingles array<bigint>, " + ", ".join(f"{s} bigint" for s in SKETCH))
    schema = to_arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t) for t in batch.column("t").to_pylist()]
            marks = np.array([sketch(s) for s in found], dtype=np.int64).reshape(-1, len(SKETCH))
            columns = [batch.column("node"), pa.array([len(s) for s in found]), pa.array([s.view(np.int64) for s in found], schema.types[2]), *(pa.array(m) for m in marks.T.copy())]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return texts.select("node", "t").mapInArrow(run, ddl).dropDuplicates(["node"])


def _shared_regions(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """(region, node) of the keys that two different sets or more have."""
    keyed = known.select(F.explode("keys").alias("region"), "short")
    shared = keyed.groupBy("region").agg(F.min("short").alias("a"), F.max("short").alias("b")).where("a <> b").select("region")
    return keyed.join(shared, "region").join(nodes.select("node", "short"), "short").select("region", "node").distinct()


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(p, x, both, either) for pairs of nodes (p, x): sizes of intersection and union."""
    x = sets.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("shingles").alias("sx"))
    p = sets.select(F.col("node").alias("p"), F.col("n").alias("np"), F.col("shingles").alias("sp"))
    met = pairs.join(x, "x").join(p, "p")
    both = F.size(F.array_intersect("sx", "sp")).cast("bigint")
    return met.select("p", "x", both.alias("both"), F.col("nx"), F.col("np")).select("p", "x", "both", (F.col("nx") + F.col("np") - F.col("both")).alias("either"))


def _step(live: DataFrame, sets: DataFrame, percent: int, number: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Pivots of all live regions (region, node, n, weight, s0 .., whole, root, main) met: (links of this step, regions of the next)."""
    first, own = number == 0, ["node", "n", "weight", *SKETCH]
    chance = F.xxhash64("node", F.lit(number)) / F.lit(2.0**64) + 0.5
    outside = (live if first else live.where("root <> main")).withColumn("chance", chance).withColumn("rank", F.struct("weight", "chance"))
    best = outside.groupBy("region").agg(F.max("rank").alias("best"), F.count("*").alias("others"))
    ends = F.lit(False) if first else F.col("whole") | (F.col("others") <= leaf)
    wanted = F.lit(0) if first else F.when(F.col("ends"), F.col("others")).otherwise(PIVOTS)
    chosen = (F.col("rank") == F.col("best")) | (F.col("chance") < F.col("wanted") / F.col("others"))
    pivots = outside.join(best, "region").withColumn("ends", ends).withColumn("wanted", wanted).where(chosen)
    pivots = pivots.select("region", "ends", *(F.col(c).alias(f"pivot_{c}") for c in ["root", "node", "n", *SKETCH]))
    pivots = written(pivots, "pivots")
    differ = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"pivot_{s}"))) for s in SKETCH[1:]), F.bit_count(F.col("s0").bitwiseXOR(F.col("pivot_s0"))))
    near = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("pivot_n"))
    wide = F.lit(False) if first else ~F.col("ends")  # cells need every distance
    met = live.join(pivots, "region").where((F.col("node") != F.col("pivot_node")) & (wide | (near & (F.col("root") != F.col("pivot_root")))))
    met = written(met.select("region", *own, "ends", F.col("pivot_node").alias("pivot"), F.least("node", "pivot_node").alias("p"), F.greatest("node", "pivot_node").alias("x")), "met")
    measured = written(_measured(met.select("p", "x").distinct(), sets), "distances")
    links = measured.where(100 * F.col("both") >= percent * F.col("either")).select(F.col("p").alias("u"), F.col("x").alias("v"))

    own_pivots = pivots.select("region", F.col("pivot_node").alias("node"))
    if first:  # one pivot: one cell
        return links, live.join(own_pivots, ["region", "node"], "left_anti").select("region", *own, "whole")
    rest = met.where("not ends").join(own_pivots, ["region", "node"], "left_anti")
    apart = rest.join(measured, ["p", "x"]).withColumn("d", 1 - F.col("both") / F.col("either"))
    nearest = apart.groupBy("region", "node").agg(F.min("d").alias("nearest"))
    window = F.col("nearest") + 2 * (100 - percent) / 100 + 1e-9
    cells = written(apart.join(nearest, ["region", "node"]).where(F.col("d") <= window).select("region", *own, "pivot"), "cells")
    whole = cells.groupBy("region").agg((2 * F.count("*") > 3 * F.count_distinct("node")).alias("whole"))
    place = F.when(F.col("whole"), F.col("region")).otherwise(F.xxhash64("region", "pivot"))
    return links, cells.join(whole, "region").select(place.alias("region"), *own, "whole").distinct()


def _weighted(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """regions with the nodes' sizes, sketches and weights: how many nodes a node meets in all its regions; who meets most is the most central."""
    sizes = regions.groupBy("region").agg(F.count("*").alias("size"))
    weights = regions.join(sizes, "region").groupBy("node").agg(F.sum("size").alias("weight"))
    return regions.join(weights, "node").join(sets.select("node", "n", *SKETCH), "node").withColumn("whole", F.lit(False))


def _renamed(rows: DataFrame, column: str, names: DataFrame | None, into: str) -> DataFrame:
    """rows with the root of a column's node, itself where it has none, as into."""
    if names is None:
        return rows.withColumn(into, F.col(column))
    found = names.select(F.col("node").alias("known_"), F.col("root").alias("root_"))
    return rows.join(found, F.col(column) == F.col("known_"), "left").withColumn(into, F.coalesce("root_", column)).drop("known_", "root_")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(node, root) with new links added: only the roots that they connect are named anew."""
    between = _renamed(_renamed(links, "u", roots, "a"), "v", roots, "b").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    between = written(between.distinct(), "links")
    if between.isEmpty():
        return roots
    named = components(between)
    if roots is None:
        return named
    old = _renamed(roots.select("node", F.col("root").alias("old")), "old", named, "root").select("node", "root")
    return written(old.unionByName(named.join(roots, "node", "left_anti").select("node", "root")), "roots")


def connected(regions: DataFrame, sets: DataFrame, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame | None:
    """(node, root) of the nodes that links connect, given regions (region, node) in which linked nodes meet; None if there is no link."""
    live = written(_weighted(regions, sets).withColumns({"root": F.col("node"), "main": F.col("node")}), "regions")
    roots, number = None, 0
    while not live.isEmpty():
        links, rows = _step(live, sets, percent, number, leaf)
        rows, roots, number = written(rows, "regions"), _merged(roots, links), number + 1
        held = written(_renamed(rows, "node", roots, "root"), "regions")
        groups = held.groupBy("region", "root").agg(F.count("*").alias("n")).groupBy("region").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("groups"))
        live = written(held.join(groups.where("groups > 1").select("region", "main"), "region"), "regions")
    return roots


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: (id_col, n_shingles, component_id).

    Two rows link when 100 * intersection >= percent * union for their sets of 3-word shingles of lower-cased
    (A-Z) words; component_id is the smallest id that links reach, the row's own included. Texts of one or
    two words have one shingle. Null and empty texts, and texts of white space only, have none and link with
    nothing, each other included. Repeated rows come out as often as they came in. A null id takes part but
    is never a component_id unless its component has no other. Texts are read whole; other columns are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    known = written(_described(docs, id_col, text_col, percent), "shingle-sets")
    any_row = F.struct(F.col("id").isNull().alias("none"), "id", "tkey")
    some = known.where("node is not null")
    nodes = written(some.groupBy("node", "short", "n").agg(F.min(any_row).alias("row"), F.min("id").alias("least"), F.count("*").alias("copies")), "shingle-nodes")
    regions = written(_shared_regions(known, nodes), "regions")
    compared = regions.select("node").distinct().join(nodes, "node").select("node", F.col("row.id").alias("row_id"), F.col("row.tkey").alias("row_tkey"))
    texts = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_tkey"), F.col(text_col).alias("t"))
    texts = texts.join(compared, texts["own_id"].eqNullSafe(compared["row_id"]) & (texts["own_tkey"] == compared["row_tkey"]))
    sets = written(_sets(texts), "shingle-sets")
    roots = connected(regions, sets, percent, leaf)

    total, count = nodes.agg(F.sum("copies"), F.count("*")).first()
    if roots is None:
        labelled = nodes.select("node", "copies", F.col("least").alias("component_id"))
    else:
        found = roots.select(F.col("node").alias("linked"), "root")
        rooted = nodes.join(found, nodes["node"] == found["linked"], "left").select("node", "copies", "least", F.coalesce("root", "node").alias("root"))
        rooted = written(rooted, "shingle-nodes")
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
        labelled = join_hot(rooted, least, "root", "members", count)
    named = join_hot(some.select("node", "id", "n"), labelled.select("node", "component_id", "copies"), "node", "copies", total or 0)
    alone = known.where("node is null").select("id", "n", F.col("id").alias("component_id"))
    out = named.select("id", "n", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
