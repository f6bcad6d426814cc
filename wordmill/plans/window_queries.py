"""Queries of windows, ranking, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import text_key
from ..operators import rules as R
from ..operators import windows as W
from ..registry import SQL, query
from .session import epoch_seconds, table

#: lineitem has no unique pair of keys; this tuple is unique.
TOTAL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
T = ", ".join(TOTAL)
ALL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*TOTAL, "l_returnflag", "l_linestatus", "l_discount", "l_extendedprice")


def _order(ids: str = "doc_id", seed: str = "0") -> str:
    return f"sha256('{seed}:' || {ids}::VARCHAR)"


@query("w1_best_of_n", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AND l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {T}) = 1")
def w1_best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the passed candidates of each finished order the best, ties to the smallest key."""
    lines = _lines(spark, sf_dir)
    closed = lines.join(lines.where("l_quantity > 49").select("l_orderkey").distinct(), "l_orderkey", "left_anti").where("l_returnflag <> 'R'")
    best = closed.groupBy("l_orderkey").agg(F.min(F.struct((-F.col("l_extendedprice")).alias("p"), *TOTAL)).alias("s"))
    return best.select("s.l_orderkey", "s.l_linenumber", "s.l_partkey")


@query("w2_first_wins", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def w2_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("text")


@query("w2_two_keys", r"WITH a AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) SELECT doc_id FROM a QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') ORDER BY doc_id) = 1")
def w2_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First wins on two keys in sequence.

    Exact where the first key determines the second, as here; otherwise a row that the first key
    rejects might still have held the second, which two passes don't see.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    once = R.first_by_key(rows, "text", ["doc_id"]).withColumn("key", text_key(F.col("text")))
    return once.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("w3_last_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w3_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("s"))
    return last.select("user_id", "s.event_id", "s.event_type")


@query("w4_drop_ends", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {T}) QUALIFY row_number() OVER w > 1 AND row_number() OVER w < count(*) OVER (PARTITION BY l_orderkey)")
def w4_drop_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("l_orderkey")
    rows = _lines(spark, sf_dir).withColumn("r", F.row_number().over(own.orderBy(*TOTAL))).withColumn("n", F.count("*").over(own))
    return rows.where("r > 1 and r < n").select("l_orderkey", "l_linenumber", "l_partkey")


@query("w5_intervals", f"SELECT {ALL}, sum(l_quantity) OVER w - l_quantity AS start, sum(l_quantity) OVER w AS stop FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {T} ROWS UNBOUNDED PRECEDING)")
def w5_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy(*TOTAL).rowsBetween(Window.unboundedPreceding, 0))
    return _lines(spark, sf_dir).select(*TOTAL[:5], (stop - F.col("l_quantity")).alias("start"), stop.alias("stop"))


@query(
    "w6_word_neighbours",
    """SELECT conv_id, turn, last_value(CASE WHEN role <> 'system' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    first_value(CASE WHEN role <> 'system' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM conversations""",
)
def w6_word_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id").orderBy("turn")
    real = F.when(F.col("role") != "system", F.col("turn"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.last(real, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first(real, ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )


@query("w7_interior", "SELECT conv_id, turn, row_number() OVER w > 1 AND row_number() OVER w < count(*) OVER (PARTITION BY conv_id) AS interior FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w7_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id")
    r = F.row_number().over(own.orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ((r > 1) & (r < F.count("*").over(own))).alias("interior"))


@query(
    "w8_islands",
    """WITH a AS (SELECT user_id, ts, event_id, value > 50 AS active, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, sum((value > 50)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
    i AS (SELECT user_id, island, count(*) AS n, min(r) AS f FROM a WHERE NOT active GROUP BY 1, 2), t AS (SELECT user_id, sum(active::INT) AS top FROM a GROUP BY 1)
    SELECT t.user_id, coalesce(max(n) FILTER (island = 0), 0)::BIGINT AS leading, coalesce(max(n) FILTER (island = top), 0)::BIGINT AS trailing, coalesce(max(n) FILTER (island > 0 AND island < top), 0)::BIGINT AS inner_longest FROM t LEFT JOIN i ON t.user_id = i.user_id GROUP BY 1""",
)
def w8_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest runs of inactive events of a user: at the start, at the end and between."""
    active = (F.col("value") > 50).cast("int")
    running = F.sum(active).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = table(spark, sf_dir, "events").select("user_id", active.alias("active"), running.alias("island"))
    runs = rows.groupBy("user_id", "island").agg(F.count_if(F.col("active") == 0).alias("n"))
    top = F.max("island").over(Window.partitionBy("user_id"))
    zero = F.lit(0).cast("bigint")
    n, island = F.col("n"), F.col("island")
    return runs.withColumn("top", top).groupBy("user_id").agg(
        F.coalesce(F.max(F.when(island == 0, n)), zero).alias("leading"), F.coalesce(F.max(F.when(island == F.col("top"), n)), zero).alias("trailing"),
        F.coalesce(F.max(F.when((island > 0) & (island < F.col("top")), n)), zero).alias("inner_longest"),
    )


@query("w8_islands_by_ranges", SQL["w8_islands"])
def w8_islands_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As w8, for users of whom one may have most of the events."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") > 50).cast("int").alias("active"))
    placed = W.running_in_groups(rows, ["user_id"], ["ts", "event_id"], "active", "island")
    runs = placed.groupBy("user_id", "island").agg(F.count_if(F.col("active") == 0).alias("n"), F.max("total_").alias("top"))
    n, island, zero = F.col("n"), F.col("island"), F.lit(0).cast("bigint")
    parts = {"leading": island == 0, "trailing": island == F.col("top"), "inner_longest": (island > 0) & (island < F.col("top"))}
    return runs.groupBy("user_id").agg(*(F.coalesce(F.max(F.when(where, n)), zero).alias(name) for name, where in parts.items()))


@query("w9_rolling_budget", "WITH s AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS used FROM s")
def w9_rolling_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the user in the last day (strictly less than a day ago)."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", epoch_seconds("ts").alias("t"))
    return rows.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-86_399, 0)).alias("used"))


@query("w10_stalls", "WITH s AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM s) SELECT user_id, count(*) AS stalls, max(gap) AS longest FROM g WHERE gap > 86400 GROUP BY 1")
def w10_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", epoch_seconds("ts").alias("t"))
    gaps = rows.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    return gaps.where("gap > 86400").groupBy("user_id").agg(F.count("*").alias("stalls"), F.max("gap").alias("longest"))


@query("w10_stalls_by_ranges", "WITH s AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM s) SELECT user_id, count(*) AS stalls, max(gap) AS longest FROM g WHERE gap > 86400 GROUP BY 1")
def w10_stalls_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As w10, for users of whom one may have most of the events."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", epoch_seconds("ts").alias("t"))
    gaps = W.lagged(rows, ["user_id"], ["t", "event_id"], {"t": "earlier"}).withColumn("gap", F.col("t") - F.col("earlier"))
    return gaps.where("gap > 86400").groupBy("user_id").agg(F.count("*").alias("stalls"), F.max("gap").alias("longest"))


KEYS = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT)"
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "frames"]


@query(
    "w11_stratified_quota",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity::BIGINT AS frames FROM lineitem), h AS (SELECT *, sha256('7:' || concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, frames)) AS h FROM a),
    p AS (SELECT *, ((2 * sum(frames) OVER (PARTITION BY l_returnflag ORDER BY h, l_orderkey, l_linenumber, l_partkey, l_suppkey, frames ROWS UNBOUNDED PRECEDING) - frames) * 1000000000 / (2 * sum(frames) OVER (PARTITION BY l_returnflag))) AS x FROM h),
    r AS (SELECT *, sum(frames) OVER (ORDER BY floor(x)::BIGINT, h, l_orderkey, l_linenumber, l_partkey, l_suppkey, frames ROWS UNBOUNDED PRECEDING) AS run FROM p)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, frames FROM r WHERE run - frames < 20000""",
)
def w11_stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("frames"))
    return W.stratified_quota(rows, ["l_returnflag"], LINE_KEYS, "frames", 20_000, "7").select(*LINE_KEYS)


@query("w12_hash_sample", f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_order()}, doc_id) <= 10")
def w12_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("source").orderBy(W.hash_order(F.col("doc_id")), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("r", F.row_number().over(by)).where("r <= 10").drop("r")


@query(
    "w13_length_batches",
    f"""WITH a AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY {_order(seed='e1')}, doc_id) - 1) // 160 AS win FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY n_chars, doc_id) - 1 AS n FROM a),
    c AS (SELECT *, n // 16 AS batch, n % 16 AS place FROM b) SELECT doc_id, win, batch, place FROM c QUALIFY count(*) OVER (PARTITION BY win, batch) = 16""",
)
def w13_length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return W.length_batches(rows, "doc_id", "n_chars", 16, 10, "e1").select("doc_id", F.col("window").alias("win"), "batch", F.col("place").cast("bigint").alias("place"))


@query(
    "w14_balanced",
    """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT max(n) AS top FROM n), r AS (SELECT d.doc_id, d.lang, n, top, unnest(range(0, ceil(top / n)::BIGINT)) AS round FROM documents d JOIN n ON d.lang = n.lang, t)
    SELECT doc_id, lang, round::INT AS round FROM r QUALIFY round * n + row_number() OVER (PARTITION BY lang, round ORDER BY sha256('b:' || round || ':' || doc_id), doc_id) <= top""",
)
def w14_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.balanced(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", "b").select("doc_id", "lang", "round")


@query("w15_strided", "SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS part FROM documents")
def w15_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(1).alias("one"))
    return W.running_in_groups(rows, ["source"], ["doc_id"], "one", "r").select("doc_id", ((F.col("r") - 1) % 4).alias("part"))


@query(
    "w16_dense_ids",
    "WITH s AS (SELECT s_nationkey, min(s_suppkey) AS lo, max(s_suppkey) - min(s_suppkey) + 1 AS w FROM supplier GROUP BY 1), o AS (SELECT *, sum(w) OVER (ORDER BY s_nationkey ROWS UNBOUNDED PRECEDING) - w AS start FROM s) SELECT s_suppkey, (start + s_suppkey - lo)::BIGINT AS dense FROM supplier JOIN o ON supplier.s_nationkey = o.s_nationkey",
)
def w16_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.dense_ids(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", "dense").select("s_suppkey", "dense")


@query("w17_line_numbers", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS line FROM conversations")
def w17_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(1).alias("one"))
    return W.global_running_sum(rows, ["conv_id", "turn"], "one", "line").select("conv_id", "turn", "line")


@query("w18_switches", "SELECT conv_id, count(*) FILTER (role <> p) AS switches FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY 1")
def w18_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("p", before).groupBy("conv_id").agg(F.count_if(F.col("role") != F.col("p")).alias("switches"))


@query("k1_queue_claim", "SELECT event_id, user_id FROM events WHERE event_type = 'view' ORDER BY event_id LIMIT 100")
def k1_queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'view'").orderBy("event_id").limit(100).select("event_id", "user_id")


@query("k2_pool_pick", f"SELECT lang, source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_order(seed='rank')}, doc_id) <= 3")
def k2_pool_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(W.hash_order(F.col("doc_id"), seed="rank"), "doc_id")
    return table(spark, sf_dir, "documents").select("lang", "source", "doc_id", F.row_number().over(by).alias("r")).where("r <= 3").drop("r")


@query("k3_top_worst", f"SELECT {ALL} FROM lineitem ORDER BY CASE WHEN l_returnflag = 'A' THEN l_discount ELSE l_tax END DESC, {T} LIMIT 25")
def k3_top_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.coalesce(F.when(F.col("l_returnflag") == "A", F.col("l_discount")), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").orderBy(F.desc_nulls_last(score), *TOTAL).limit(25).select(*TOTAL[:5])


@query("k4_top_per_group", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, {T}) AS r FROM lineitem) SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY r) AS worst FROM r WHERE r <= 5 GROUP BY 1")
def k4_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), *TOTAL)
    top = _lines(spark, sf_dir).withColumn("r", F.row_number().over(by)).where("r <= 5")
    listed = F.sort_array(F.collect_list(F.struct("r", F.concat_ws(":", "l_linenumber", "l_partkey").alias("x"))))
    return top.groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda s: s["x"]), " ").alias("worst"))


@query("k5_first_n", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5")
def k5_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", r.alias("r")).where("r <= 5").drop("r")


HASH = "(('0x' || substr(sha256({g}::VARCHAR), 1, 8))::BIGINT % 1000)"
NAMED = "CASE WHEN {b} < {v} THEN 'val' WHEN {b} < {t} THEN 'test' ELSE 'train' END"


@query("k6_hash_split", f"SELECT doc_id, {NAMED.format(b=HASH.format(g='doc_id'), v=20, t=40)} AS split FROM documents")
def k6_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.split_of(F.col("doc_id")).alias("split"))


@query(
    "k7_empty_split_repair",
    f"""WITH s AS (SELECT source, any_value({NAMED.format(b=HASH.format(g='source'), v=20, t=40)}) AS split FROM documents GROUP BY 1), m AS (SELECT split FROM (SELECT unnest(['val', 'test']) AS split) WHERE split NOT IN (SELECT split FROM s)),
    v AS (SELECT arg_min(source, sha256('0:val:' || source)) AS g FROM s WHERE split = 'train'), t AS (SELECT arg_min(source, sha256('0:test:' || source)) AS g FROM s WHERE split = 'train' AND source <> (SELECT g FROM v))
    SELECT source, CASE WHEN source = (SELECT g FROM v) AND 'val' IN (SELECT split FROM m) THEN 'val' WHEN source = (SELECT g FROM t) AND 'test' IN (SELECT split FROM m) THEN 'test' ELSE split END AS split FROM s""",
)
def k7_empty_split_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by hash split; a held-out split without a group gets the group of train that hashes lowest for it."""
    groups = table(spark, sf_dir, "documents").select("source").distinct().withColumn("split", R.split_of(F.col("source")))
    chosen: list[str] = []
    for name in ("val", "test"):
        if groups.where(F.col("split") == name).limit(1).count() == 0:
            own = W.hash_order(F.lit(name), F.col("source"))
            first = groups.where((F.col("split") == "train") & ~F.col("source").isin(chosen)).agg(F.min_by("source", own)).first()[0]
            chosen.append(first)
            groups = groups.withColumn("split", F.when(F.col("source") == first, name).otherwise(F.col("split")))
    return groups


@query("k8_group_ratio_split", f"WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), r AS (SELECT k, row_number() OVER (ORDER BY {_order('k', 's')}, k) AS r, count(*) OVER () AS n FROM k) SELECT k, CASE WHEN r <= floor(n * 0.9) THEN 'train' ELSE 'val' END AS split FROM r")
def k8_group_ratio_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("h", W.hash_order(F.col("k"), seed="s")).withColumn("one", F.lit(1))
    ranked = W.global_running_sum(keys, ["h", "k"], "one", "r")
    n = keys.count()
    return ranked.select("k", F.when(F.col("r") <= int(n * 0.9), "train").otherwise("val").alias("split"))


@query("k9_row_ratio_split", f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_order(seed='r')}, doc_id) <= floor((SELECT count(*) FROM documents) * 0.95) THEN 'train' ELSE 'val' END AS split FROM documents")
def k9_row_ratio_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", W.hash_order(F.col("doc_id"), seed="r").alias("h"), F.lit(1).alias("one"))
    n = rows.count()
    return W.global_running_sum(rows, ["h", "doc_id"], "one", "r").select("doc_id", F.when(F.col("r") <= int(n * 0.95), "train").otherwise("val").alias("split"))


@query(
    "k10_group_union",
    f"SELECT doc_id, 'presplit' AS origin, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'split', {NAMED.format(b=HASH.format(g='doc_id'), v=20, t=40)} FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT item_id, 'raw', 'train' FROM benchmark",
)
def k10_group_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fixed = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("presplit").alias("origin"), F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"))
    cut = docs.where("doc_id % 2 = 1").select("doc_id", F.lit("split").alias("origin"), R.split_of(F.col("doc_id")).alias("split"))
    raw = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("raw").alias("origin"), F.lit("train").alias("split"))
    return fixed.unionByName(cut).unionByName(raw)


@query("k11_oversample", "SELECT doc_id, unnest(range(1, 4))::INT AS copy FROM documents WHERE lang = 'es'")
def k11_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'es'").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))


@query(
    "k12_quota_sample",
    f"""WITH b AS (SELECT unnest([{{'l_returnflag': 'A', 'share': 0.3}}, {{'l_returnflag': 'N', 'share': 0.3}}, {{'l_returnflag': 'R', 'share': 0.4}}], recursive := true)), e AS (SELECT *, share::DOUBLE * 1001 AS x FROM b),
    q AS (SELECT l_returnflag, floor(x)::BIGINT + (row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, l_returnflag DESC) <= 1001 - sum(floor(x)) OVER ())::INT AS quota FROM e),
    r AS (SELECT l.*, row_number() OVER (PARTITION BY l_returnflag ORDER BY (l_linestatus <> 'F'), sha256('q:' || {KEYS}), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem l)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r JOIN q ON r.l_returnflag = q.l_returnflag WHERE r <= quota""",
)
def k12_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = spark.createDataFrame([("A", 0.3, 0), ("N", 0.3, 0), ("R", 0.4, 0)], "l_returnflag string, share double, one int")
    quotas = W.largest_remainder(shares, ["one"], "l_returnflag", "share", 1001).select("l_returnflag", "quota")
    rows = _lines(spark, sf_dir).withColumn("frames", F.col("l_quantity").cast("int")).withColumn("second", (F.col("l_linestatus") != "F").cast("int"))
    return W.prioritized_sample(rows, quotas, ["l_returnflag"], "second", LINE_KEYS, "q").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("k13_bounded_stop", "WITH r AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) SELECT doc_id, run::BIGINT AS run FROM r WHERE run - n_chars < 500000")
def k13_bounded_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return W.global_running_sum(rows, ["doc_id"], "n_chars", "run").where(F.col("run") - F.col("n_chars") < 500_000).select("doc_id", "run")


@query("k14_systematic", "SELECT doc_id FROM documents QUALIFY (row_number() OVER (ORDER BY doc_id) - 1) % 100 = 0")
def k14_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("one"))
    return W.global_running_sum(rows, ["doc_id"], "one", "r").where((F.col("r") - 1) % 100 == 0).select("doc_id")


@query("k15_sort_keys", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 1, 2")
def k15_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderpriority", "o_orderstatus")
