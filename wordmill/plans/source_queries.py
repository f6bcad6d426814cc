"""Queries of sources and sinks, and the batch twins of the streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as W
from ..registry import query
from ..sources import readers as S
from ..streaming import jobs
from .session import epoch_seconds, table


@query(
    "s1_manifest",
    "SELECT source AS wav, try_cast(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE doc_id::VARCHAR END AS INT) AS spk, trim(replace(replace(text, '|', ' '), chr(10), ' ')) AS text FROM documents WHERE doc_id % 7 <> 0",
)
def s1_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents written as wav|speaker|text lines and read again; one in seven has no number for a speaker."""
    speaker = F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("doc_id").cast("string"))
    line = F.concat_ws("|", "source", speaker, F.translate("text", "|\n", "  "))
    return S.manifest(table(spark, sf_dir, "documents").select(line.alias("value")), True).where("error is null").select("wav", "spk", "text")


@query(
    "s8_spans",
    "WITH e AS (SELECT event_id AS utt, CASE WHEN event_id % 3 = 0 THEN event_id END AS f, CASE WHEN event_id % 3 = 1 THEN value END AS s, CASE WHEN event_id % 3 = 2 THEN value * 1000 END AS m FROM events), b AS (SELECT utt, coalesce(f, round(s * 62.5)::BIGINT, round(m * 62.5 / 1000)::BIGINT) AS start, coalesce(f + 5, round((s + 0.1) * 62.5)::BIGINT, round((m - 20) * 62.5 / 1000)::BIGINT) AS stop FROM e) SELECT utt, start, stop FROM b WHERE stop > start",
)
def s8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, v, i = F.col("event_id") % 3, F.col("value"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        i.alias("utt"), F.when(kind == 0, i).alias("start_frame"), F.when(kind == 0, i + 5).alias("end_frame"), F.when(kind == 1, v).alias("start_sec"),
        F.when(kind == 1, v + 0.1).alias("end_sec"), F.when(kind == 2, v * 1000).alias("start_ms"), F.when(kind == 2, v * 1000 - 20).alias("end_ms"),
    )
    return S.spans(rows, 24_000, 384).withColumnRenamed("end", "stop")


@query("s10_lexicon_override", "SELECT word, reading FROM (SELECT p_name AS word, p_brand AS reading, 0 AS prio, p_partkey AS k FROM part UNION ALL SELECT p_name, 'user', 1, p_partkey FROM part WHERE p_partkey % 10 = 0) QUALIFY row_number() OVER (PARTITION BY word ORDER BY prio DESC, k DESC) = 1")
def s10_lexicon_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    base = part.select(F.col("p_name").alias("word"), F.col("p_brand").alias("reading"), F.lit(0).alias("prio"), "p_partkey")
    user = part.where("p_partkey % 10 = 0").select(F.col("p_name").alias("word"), F.lit("user").alias("reading"), F.lit(1).alias("prio"), "p_partkey")
    return base.unionByName(user).groupBy("word").agg(F.max_by("reading", F.struct("prio", "p_partkey")).alias("reading"))


@query("s11_stat_table", "SELECT l_partkey AS token, count(*) AS n, min(l_quantity) AS lower FROM lineitem GROUP BY 1 HAVING count(*) >= 20 AND min(l_quantity) IS NOT NULL")
def s11_stat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics written as a report and read again with the columns that are asked for; a missing one is an error before any row is read."""
    stats = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("token")).agg(F.count("*").alias("n"), F.min("l_quantity").alias("lower"))
    folder = f"{W.shared_folder(spark)}/stats-{uuid.uuid4().hex}"
    S.write_report(stats, folder)
    found = S.stat_table(spark, folder, ["n", "lower"], least=20).where("error is null")
    return found.select(F.col("token").cast("bigint").alias("token"), F.col("n").cast("bigint").alias("n"), "lower")


@query("s13_json_field", "SELECT event_id, (props ->> '$.k')::INT AS k FROM events WHERE (props ->> '$.k')::INT > 90")
def s13_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").cast("int") > 90)
    return rows.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("s14_last_column", "SELECT page_id, list_last(string_split(url, '/')) AS tail FROM pages")
def s14_last_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("tail"))


@query("s17_rejection_log", "SELECT coalesce(CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars > 9000 THEN 'long' END, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def s17_rejection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars")
    kept, rejected = S.fork(table(spark, sf_dir, "documents").select("n_chars"), F.when(size < 500, "short").when(size > 9000, "long"))
    both = kept.select(F.lit("kept").alias("reason")).unionByName(rejected.select("reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n"))


@query("s18_rounded_report", "SELECT l_partkey AS token, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(avg(l_quantity), 3) END AS mean FROM lineitem GROUP BY 1")
def s18_rounded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("token")).agg(F.count("*").alias("n"), F.when(F.count("*") >= 30, F.round(F.avg("l_quantity"), 3)).alias("mean"))


@query("s20_path_rewrite", "SELECT page_id, '/new/' || list_last(string_split(url, '/')) AS path FROM pages")
def s20_path_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/new/"), F.substring_index("url", "/", -1)).alias("path"))


@query("t1_last_states", "SELECT user_id AS candidate, arg_max(event_type, ts) AS state FROM (SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1) GROUP BY 1")
def t1_last_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min_by("event_type", "event_id").alias("state"))
    return jobs.last_states(first.select(F.col("user_id").alias("candidate"), "state", "ts"))


@query(
    "t3_round_winners",
    """WITH e AS (SELECT l_orderkey AS text, l_partkey AS candidate, max(l_returnflag <> 'R') AS passed, max(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) AS score, max(l_linenumber) AS n FROM lineitem GROUP BY 1, 2),
    r AS (SELECT text, count(*) AS ended, max(n) AS expected, bool_or(passed) AS any_passed, arg_min(candidate, (-score, candidate)) FILTER (passed) AS best FROM e GROUP BY 1)
    SELECT text, best AS winner, NOT any_passed AS retry FROM r WHERE ended >= expected""",
)
def t3_round_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rounds, their lines as ended candidates; a part that an order has twice is one candidate, so that order's round is open."""
    passed = F.col("l_returnflag") != "R"
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("text"), F.col("l_partkey").alias("candidate"), F.col("l_linenumber").alias("expected"), passed.alias("passed"), F.when(passed, F.col("l_extendedprice").cast("double")).alias("score")
    )
    return jobs.ended_rounds(rows)


@query("t5_progress", "SELECT event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY 1")
def t5_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.progress(table(spark, sf_dir, "events"))


@query(
    "t5_quota_progress",
    "WITH t AS (SELECT l_returnflag AS split, l_linestatus AS language, sum(l_quantity)::DOUBLE AS seconds, count(*) AS n FROM lineitem WHERE l_linenumber < 5 GROUP BY 1, 2), q AS (SELECT l_returnflag AS split, l_linestatus AS language, count(*) * 20.0::DOUBLE AS target FROM lineitem GROUP BY 1, 2) SELECT split, language, target, coalesce(seconds, 0) AS seconds, coalesce(n, 0) AS n, greatest(target - coalesce(seconds, 0), 0) AS missing, coalesce(seconds, 0) >= target AS complete FROM q LEFT JOIN t USING (split, language)",
)
def t5_quota_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted hours by split and language against their quotas, as a stream of accepted rows reports them."""
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "split", "l_linestatus": "language"})
    totals = rows.where("l_linenumber < 5").groupBy("split", "language").agg(F.sum(F.col("l_quantity").cast("double")).alias("seconds"), F.count("*").alias("n"))
    quotas = rows.groupBy("split", "language").agg((F.count("*") * F.lit(20.0)).alias("target"))
    return jobs.quota_state(totals, quotas, ["split", "language"])


@query("t6_status_windows", "SELECT epoch(time_bucket(INTERVAL 5 MINUTES, ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t6_status_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.status_windows(table(spark, sf_dir, "events")).select(epoch_seconds("start").alias("start"), "event_type", "n")


@query(
    "t7_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, s",
)
def t7_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sessions(table(spark, sf_dir, "events"), "1 day").select("user_id", epoch_seconds("start").alias("start"), "n")


@query("t8_emit_if_advanced")
def t8_emit_if_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin: in order of a user's events, those at least 500 past the last one kept."""
    return jobs.advanced_rows(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("step")), 500)


@query("t9_drain", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def t9_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "t7_sessions_by_ranges",
    "WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w >= 86400 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS s FROM g) SELECT user_id, s::BIGINT AS session, min(t) AS start, max(t) AS stop, count(*) AS n FROM s GROUP BY user_id, s",
)
def t7_sessions_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users of whom one may have most of the events."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", epoch_seconds("ts").alias("t"))
    return W.gap_sessions(rows, "user_id", "t", "event_id", 86_400).withColumnRenamed("end", "stop")
