"""Queries of aggregations and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stats as A
from ..operators import windows as W
from ..registry import query
from .session import table

PERCENTS = (0.01, 0.05, 0.5, 0.95, 0.99)
NAMES = ("p01", "p05", "p50", "p95", "p99")
PCT = ", ".join(f"quantile_cont(l_quantity, {p}) AS {n}" for p, n in zip(PERCENTS, NAMES, strict=True))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query("a1_duration_stats", f"SELECT l_partkey % 97 AS token, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, {PCT}, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def a1_duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duration_stats(_lines(spark, sf_dir).withColumn("token", F.col("l_partkey") % 97), ["token"], "l_quantity", dict(zip(NAMES, PERCENTS, strict=True)))


@query("a1_duration_stats_approx")
def a1_duration_stats_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a1, by sketches of bounded size: for groups too large to sort."""
    return A.duration_stats(_lines(spark, sf_dir).withColumn("token", F.col("l_partkey") % 97), ["token"], "l_quantity", dict(zip(NAMES, PERCENTS, strict=True)), exact=False)


@query("a1_percentiles_by_ranges", f"SELECT l_partkey % 97 AS token, count(*) AS n, {PCT} FROM lineitem GROUP BY 1")
def a1_percentiles_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact percentiles of a1 where one token may hold most of the rows."""
    return W.exact_percentiles(_lines(spark, sf_dir).withColumn("token", F.col("l_partkey") % 97), ["token"], "l_quantity", dict(zip(NAMES, PERCENTS, strict=True)))


NINE = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query(
    "a2_percentile_row",
    "SELECT l_returnflag, " + ", ".join(f"quantile_cont(l_quantity, {p}) AS q{int(p * 100):02d}" for p in NINE)
    + ", round(avg((l_quantity < 1)::INT), 6) AS lt_1, round(avg((l_quantity < 2)::INT), 6) AS lt_2, round(avg((l_quantity >= 10)::INT), 6) AS ge_10 FROM lineitem GROUP BY 1",
)
def a2_percentile_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = _lines(spark, sf_dir).groupBy("l_returnflag").agg(
        F.percentile("l_quantity", F.array(*(F.lit(p) for p in NINE))).alias("q"),
        *(F.round(F.avg(c.cast("int")), 6).alias(n) for n, c in (("lt_1", q < 1), ("lt_2", q < 2), ("ge_10", q >= 10))),
    )
    return rows.select("l_returnflag", *(F.get("q", F.lit(i)).alias(f"q{int(p * 100):02d}") for i, p in enumerate(NINE)), "lt_1", "lt_2", "ge_10")


@query(
    "a3_floor_and_cap",
    """SELECT l_partkey AS token, CASE WHEN count(*) >= 20 THEN greatest(1, quantile_cont(l_quantity, 0.01)) END AS floor,
    CASE WHEN count(*) >= 20 THEN greatest(1.5 * quantile_cont(l_quantity, 0.99), quantile_cont(l_quantity, 0.95) + 6, 8) END AS cap FROM lineitem GROUP BY 1""",
)
def a3_floor_and_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.duration_stats(_lines(spark, sf_dir), ["l_partkey"], "l_quantity", {"p01": 0.01, "p95": 0.95, "p99": 0.99})
    enough = F.col("n") >= 20
    cap = F.greatest(F.col("p99") * 1.5, F.col("p95") + 6, F.lit(8.0))
    return stats.select(F.col("l_partkey").alias("token"), F.when(enough, F.greatest(F.lit(1.0), "p01")).alias("floor"), F.when(enough, cap).alias("cap"))


@query("a4_counters", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a4_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("a5_pass_rate", "SELECT lang, count(*) AS n, count(quality) AS scored, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 6) AS pass_rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def a5_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rate = F.try_divide(F.count_if(F.col("quality") == 1), F.count("quality"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("scored"), F.round(rate, 6).alias("pass_rate"))


@query("a6_json_groups", "SELECT coalesce(json_extract_string(props, '$.k'), 'none') AS k, count(*) AS n, count(*) FILTER (value > 50) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a6_json_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.get_json_object("props", "$.k"), F.lit("none"))
    return table(spark, sf_dir, "events").groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "a7_distribution_audit",
    """WITH b AS (SELECT d.doc_id, lang, source, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS size, CASE WHEN quality = 1 THEN 'accepted' WHEN quality = 0 THEN 'rejected' ELSE 'pending' END AS state
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    u AS (SELECT lang, 'source' AS dimension, source AS bucket, state FROM b UNION ALL SELECT lang, 'size', size, state FROM b),
    g AS (SELECT lang, dimension, bucket, count(*) AS n, count(*) FILTER (state = 'accepted') AS accepted, count(*) FILTER (state = 'rejected') AS rejected, count(*) FILTER (state = 'pending') AS pending FROM u GROUP BY ALL)
    SELECT *, round(accepted / nullif(accepted + rejected, 0), 6) AS rate, round(100 * (accepted / nullif(sum(accepted) OVER w, 0) - n / sum(n) OVER w), 6) AS change FROM g WINDOW w AS (PARTITION BY lang, dimension)""",
)
def a7_distribution_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected").otherwise("pending")
    size = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    return A.distribution_audit(rows.select("lang", "source", size.alias("size"), state.alias("state")), "lang", ["source", "size"], "state")


@query("a8_micro_rate", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 6) AS rate FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def a8_micro_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).where("l_quantity > 0")
    return rows.groupBy("l_returnflag").agg(F.round(A.micro_rate("l_discount", "l_quantity"), 6).alias("rate"))


@query("a9_finite_means", "SELECT event_type, round(avg(value) FILTER (NOT isnan(value)), 6) AS mean, count(*) FILTER (value IS NULL OR isnan(value)) AS failures FROM events GROUP BY 1")
def a9_finite_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(F.when(~F.isnan(v), v)), 6).alias("mean"), F.count_if(v.isNull() | F.isnan(v)).alias("failures"))


@query(
    "a10_array_moments",
    """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, count(*) AS n, round(avg(v), 6) AS mean, round(sqrt(avg(v * v) - avg(v) * avg(v)), 6) AS std FROM x GROUP BY label""",
)
def a10_array_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.array_moments(table(spark, sf_dir, "embeddings"), ["label"], "embedding")


@query(
    "a11_pair_agreement",
    """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(stddev_pop(l_quantity) / nullif(stddev_pop(l_extendedprice), 0), 6) AS std_ratio,
    round(avg(l_quantity) / nullif(avg(l_extendedprice), 0), 6) AS mean_ratio, round(avg(abs(l_quantity - l_extendedprice)), 4) AS mae FROM lineitem GROUP BY 1""",
)
def a11_pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pair_agreement(_lines(spark, sf_dir), ["l_returnflag"], "l_quantity", "l_extendedprice")


@query(
    "a12_two_level",
    """WITH o AS (SELECT l_orderkey, l_returnflag, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, quantile_cont(m, 0.1) AS mean_p10, quantile_cont(m, 0.5) AS mean_p50, quantile_cont(m, 0.9) AS mean_p90, round(quantile_cont(s / m, 0.5), 6) AS cv_p50 FROM o GROUP BY 1""",
)
def a12_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = _lines(spark, sf_dir).groupBy("l_orderkey", "l_returnflag").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    return inner.groupBy("l_returnflag").agg(
        *(F.percentile("m", F.lit(p)).alias(f"mean_p{int(p * 100)}") for p in (0.1, 0.5, 0.9)), F.round(F.percentile(F.col("s") / F.col("m"), F.lit(0.5)), 6).alias("cv_p50")
    )


@query("a13_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS frames FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus, l_returnflag), ())")
def a13_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus"), F.col("l_returnflag")], []]
    return _lines(spark, sf_dir).groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("frames"))


@query("a14_histogram", "WITH h AS (SELECT l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT value, n, round(n / (SELECT sum(n) FROM h), 6) AS share, (SELECT round(avg((l_linenumber > 3)::INT), 6) FROM lineitem) AS over_3 FROM h")
def a14_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _lines(spark, sf_dir).groupBy(F.col("l_linenumber").alias("value")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("value") > 3, F.col("n"))).alias("high"))
    return counts.join(F.broadcast(whole)).select("value", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), F.round(F.col("high") / F.col("all"), 6).alias("over_3"))


@query(
    "a15_robust_scale",
    """WITH m AS (SELECT l_partkey, median(l_quantity) AS centre, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1),
    d AS (SELECT l.l_partkey, any_value(centre) AS centre, any_value(s) AS s, 1.4826 * median(abs(l_quantity - centre)) AS mad FROM lineitem l JOIN m ON l.l_partkey = m.l_partkey GROUP BY 1)
    SELECT l_partkey, centre, round(CASE WHEN mad >= 1e-8 THEN mad WHEN s >= 1e-8 THEN s ELSE 1.0 END, 6) AS scale FROM d""",
)
def a15_robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.robust_scale(_lines(spark, sf_dir), ["l_partkey"], "l_quantity").select("l_partkey", "centre", F.round("scale", 6).alias("scale"))


LEVELS = (("l_returnflag", "p_brand", "l_linenumber"), ("l_returnflag", "p_brand"), ("l_returnflag",), ())


@query(
    "a16_reference_groups",
    """WITH b AS (SELECT l.*, p_brand FROM lineitem l JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, coalesce(CASE WHEN count(*) OVER a >= 30 THEN avg(l_quantity) OVER a END, CASE WHEN count(*) OVER c >= 30 THEN avg(l_quantity) OVER c END, CASE WHEN count(*) OVER d >= 30 THEN avg(l_quantity) OVER d END, avg(l_quantity) OVER ()).round(6) AS reference
    FROM b WINDOW a AS (PARTITION BY l_returnflag, p_brand, l_linenumber), c AS (PARTITION BY l_returnflag, p_brand), d AS (PARTITION BY l_returnflag)""",
)
def a16_reference_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    out = A.with_reference(rows, LEVELS, "l_quantity", 30)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round("reference", 6).alias("reference"))


@query(
    "a17_outlier_ratios",
    """WITH b AS (SELECT l_partkey, greatest(1, quantile_cont(l_quantity, 0.05)) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(count(*) FILTER (l_quantity < lo) / greatest(count(*), 1), 6) AS too_short, round(count(*) FILTER (l_quantity > hi) / greatest(count(*), 1), 6) AS too_long,
    round(count(*) FILTER (l_quantity < lo OR l_quantity > hi) / greatest(count(*), 1), 6) AS either FROM lineitem l JOIN b ON l.l_partkey = b.l_partkey GROUP BY 1""",
)
def a17_outlier_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    bounds = A.duration_stats(rows, ["l_partkey"], "l_quantity", {"p05": 0.05, "hi": 0.95}).select("l_partkey", F.greatest(F.lit(1.0), "p05").alias("lo"), "hi")
    short, long_ = F.col("l_quantity") < F.col("lo"), F.col("l_quantity") > F.col("hi")
    n = F.greatest(F.count("*"), F.lit(1))
    return rows.join(bounds, "l_partkey").groupBy("l_returnflag").agg(
        *(F.round(F.count_if(c) / n, 6).alias(name) for name, c in (("too_short", short), ("too_long", long_), ("either", short | long_)))
    )


@query("a18_run_summary", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE NOT isnan(value)")
def a18_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(~F.isnan("value"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("a19_corpus_summary", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice) / 3600, 6) AS hours FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a19_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice") / 3600, 6).alias("hours"))


@query("a20_group_qualification", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 4) AS seconds FROM orders GROUP BY 1 HAVING min(o_orderstatus) = 'F' AND max(o_orderstatus) = 'F' AND count(*) >= 2 AND sum(o_totalprice) >= 3600")
def a20_group_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(s).alias("a"), F.max(s).alias("b"), F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return rows.where("a = 'F' and b = 'F' and n >= 2 and t >= 3600").select("o_custkey", "n", F.round("t", 4).alias("seconds"))


@query("a21_distinct_counts", "SELECT count(DISTINCT text) AS texts, count(DISTINCT doc_id) AS ids, count(DISTINCT source) AS sources FROM documents")
def a21_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count_distinct("text").alias("texts"), F.count_distinct("doc_id").alias("ids"), F.count_distinct("source").alias("sources"))


@query("a21_distinct_counts_approx")
def a21_distinct_counts_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(*(F.approx_count_distinct(c).alias(c) for c in ("text", "doc_id", "source")))


@query(
    "a22_inventory",
    """SELECT lang, CASE WHEN n_chars < 2000 THEN 'a' ELSE 'b' END AS part, round(sum(n_chars) / 15.0 / 3600, 6) AS available, round(sum(n_chars) FILTER (quality = 1) / 15.0 / 3600, 6) AS original,
    round((sum(n_chars) FILTER (quality = 1) + 0.5 * sum(n_chars)) / 15.0 / 3600, 6) AS bound FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""",
)
def a22_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    hours = 15.0 * 3600
    own = F.sum(F.when(F.col("quality") == 1, F.col("n_chars")))
    return rows.groupBy("lang", F.when(F.col("n_chars") < 2000, "a").otherwise("b").alias("part")).agg(
        F.round(F.sum("n_chars") / 15.0 / 3600, 6).alias("available"), F.round(own / 15.0 / 3600, 6).alias("original"), F.round((own + 0.5 * F.sum("n_chars")) / 15.0 / 3600, 6).alias("bound")
    )


@query(
    "a23_step_windows",
    "WITH r AS (SELECT floor(event_id / 1000)::BIGINT * 1000 AS lo, value FROM events WHERE event_id IS NOT NULL) SELECT lo, lo + 1000 AS hi, count(*) AS n, round(avg(value), 6) AS mean FROM r GROUP BY 1",
)
def a23_step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = (F.floor(F.col("event_id") / 1000) * 1000).cast("bigint")
    rows = table(spark, sf_dir, "events").where("event_id is not null").withColumn("lo", lo)
    return rows.groupBy("lo", (F.col("lo") + 1000).alias("hi")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("a24_bootstrap")
def a24_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean difference of two scores per order, by Poisson resampling from hashes."""
    pairs = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    return A.bootstrap_interval(pairs, "l_orderkey", F.col("a") - F.col("b"), 400)


@query(
    "a25_stratum_seconds",
    """WITH s AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount < 0.05 AS taken FROM lineitem) SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS before, round(coalesce(sum(l_quantity) FILTER (taken), 0), 4) AS after FROM s GROUP BY 1, 2""",
)
def a25_stratum_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sum(F.when(F.col("l_discount") < 0.05, F.col("l_quantity")))
    return _lines(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("before"), F.round(F.coalesce(kept, F.lit(0.0)), 4).alias("after"))


@query(
    "a26_plan_shares",
    "WITH g AS (SELECT source, count(*) AS n, sum(n_chars) AS c FROM documents GROUP BY 1) SELECT source, n, round(n / sum(n) OVER (), 6) AS row_share, round(c / sum(c) OVER (), 6) AS char_share, n // 16 AS steps FROM g",
)
def a26_plan_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    every = Window.partitionBy()  # one row per source by now
    return groups.select("source", "n", F.round(F.col("n") / F.sum("n").over(every), 6).alias("row_share"), F.round(F.col("c") / F.sum("c").over(every), 6).alias("char_share"), F.expr("n div 16").alias("steps"))


@query(
    "a27_alerts",
    """WITH g AS (SELECT event_type, count(*) AS n, count(*) FILTER (value > 90) AS passed FROM events GROUP BY 1),
    top AS (SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE value <= 90 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, json_extract_string(props, '$.k')) <= 3)
    SELECT 'deficit' AS alert, event_type AS subject, (2000 - n)::BIGINT AS amount FROM g WHERE n < 2000 UNION ALL SELECT 'low_pass_rate', event_type, passed FROM g WHERE n >= 100 AND passed / n < 0.1
    UNION ALL SELECT 'top_reason', event_type || ':' || k, n FROM top""",
)
def a27_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    groups = events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("passed"))
    short = groups.where("n < 2000").select(F.lit("deficit").alias("alert"), F.col("event_type").alias("subject"), (2000 - F.col("n")).alias("amount"))
    low = groups.where("n >= 100 and passed / n < 0.1").select(F.lit("low_pass_rate").alias("alert"), F.col("event_type").alias("subject"), F.col("passed").alias("amount"))
    reasons = events.where("value <= 90").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))
    ranked = reasons.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "k"))).where("r <= 3")
    return short.unionByName(low).unionByName(ranked.select(F.lit("top_reason").alias("alert"), F.concat_ws(":", "event_type", "k").alias("subject"), F.col("n").alias("amount")))


@query(
    "a28_language_tallies",
    "WITH r AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) AS x FROM documents) SELECT CASE WHEN regexp_matches(x, '^[A-Za-z]') THEN 'en' ELSE 'other' END AS lang, sum(CASE WHEN regexp_matches(x, '^[A-Za-z]') THEN length(x) // 2 ELSE length(x) END)::BIGINT AS chars, count(*) AS runs FROM r GROUP BY 1",
)
def a28_language_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))).alias("x"))
    latin = F.col("x").rlike("^[A-Za-z]")
    return runs.groupBy(F.when(latin, "en").otherwise("other").alias("lang")).agg(
        F.sum(F.when(latin, F.floor(F.length("x") / 2)).otherwise(F.length("x"))).alias("chars"), F.count("*").alias("runs")
    )


@query(
    "a29_paired_wins",
    """WITH g AS (SELECT l_partkey, avg(l_discount) FILTER (l_returnflag = 'A') AS a, avg(l_discount) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1) SELECT count(*) AS pairs, count(*) FILTER (a > b + 1e-9) AS wins FROM g WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def a29_paired_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, d = F.col("l_returnflag"), F.col("l_discount")
    groups = _lines(spark, sf_dir).groupBy("l_partkey").agg(F.avg(F.when(flag == "A", d)).alias("a"), F.avg(F.when(flag == "R", d)).alias("b"))
    return groups.where("a is not null and b is not null").agg(F.count("*").alias("pairs"), F.count_if(F.col("a") > F.col("b") + 1e-9).alias("wins"))
