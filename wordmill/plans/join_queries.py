"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import text_key
from ..operators import joins as J
from ..operators import rules as R
from ..registry import query
from .rule_queries import BUCKET, KEY, SENTENCES, SPLIT
from .session import epoch_seconds, table

SENTENCE_KEY = KEY.format(t="sentence", L="{L}", N="{N}")
BENCH = f"b AS (SELECT DISTINCT {KEY.format(t='x', L='{L}', N='{N}')} AS key FROM (SELECT unnest(regexp_extract_all(translate(text, chr(10), ' '), '[^.!?]+[.!?]')) AS x FROM benchmark))"


def keyed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sentences(table(spark, sf_dir, "documents"), ["doc_id", "source"]).withColumn("key", text_key(F.col("sentence")))


def held_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sentences(table(spark, sf_dir, "benchmark"), ["item_id"]).select(text_key(F.col("sentence")).alias("key")).distinct()


@query(
    "j1_exclusion",
    f"WITH {SENTENCES}, {BENCH}, k AS (SELECT *, {SENTENCE_KEY} AS key FROM t) SELECT doc_id, count(*) AS kept FROM k WHERE key NOT IN (SELECT key FROM b) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1",
)
def j1_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.exclude(keyed_sentences(spark, sf_dir), held_keys(spark, sf_dir), ["key"])
    rows = J.exclude(rows, table(spark, sf_dir, "labels").where("toxic = 1"), ["doc_id"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("kept"))


TAGGED = f"WITH {SENTENCES}, k AS (SELECT *, {SENTENCE_KEY} AS key, {SPLIT.format(b=BUCKET.format(g='doc_id'))} AS split FROM t)"


@query(
    "j2_train_minus_held",
    f"{TAGGED} SELECT split, count(*) AS n FROM k WHERE NOT (split = 'train' AND key IN (SELECT key FROM k WHERE split <> 'train')) AND NOT (split = 'val' AND key IN (SELECT key FROM k WHERE split = 'test')) GROUP BY 1",
)
def j2_train_minus_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed_sentences(spark, sf_dir).withColumn("split", R.split_of(F.col("doc_id"))).select("key", "split")
    train, val, test = (rows.where(F.col("split") == s) for s in ("train", "val", "test"))
    out = J.exclude(train, val.unionByName(test), ["key"]).unionByName(J.exclude(val, test, ["key"])).unionByName(test)
    return out.groupBy("split").agg(F.count("*").alias("n"))


@query("j3_cross_split_overlap", f"{TAGGED} SELECT key, array_to_string(list_sort(list(DISTINCT split)), ',') AS parts FROM k GROUP BY key HAVING count(DISTINCT split) > 1")
def j3_cross_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.overlaps(keyed_sentences(spark, sf_dir).withColumn("split", R.split_of(F.col("doc_id"))), "key", "split")


@query("j4_residual_overlap", f"WITH {SENTENCES}, {BENCH} SELECT count(*) AS n FROM t WHERE {SENTENCE_KEY} IN (SELECT key FROM b)")
def j4_residual_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_sentences(spark, sf_dir).join(held_keys(spark, sf_dir), "key", "left_semi").agg(F.count("*").alias("n"))


@query("j5_accepted_join", "SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS seconds FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def j5_accepted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("seconds"))


@query(
    "j6_quota_gap",
    """WITH g AS (SELECT n_nationkey, unnest(['AUTOMOBILE', 'BUILDING', 'NOWHERE']) AS segment FROM nation), c AS (SELECT c_nationkey, c_mktsegment, count(*) AS got FROM customer GROUP BY 1, 2)
    SELECT n_nationkey, segment, coalesce(got, 0)::BIGINT AS got, greatest(0, 15 - coalesce(got, 0))::BIGINT AS gap FROM g LEFT JOIN c ON n_nationkey = c_nationkey AND segment = c_mktsegment""",
)
def j6_quota_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*(F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "NOWHERE")))).alias("segment"))
    got = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("got"))
    joined = goals.join(got, ["n_nationkey", "segment"], "left").withColumn("got", F.coalesce("got", F.lit(0).cast("bigint")))
    return joined.withColumn("gap", F.greatest(F.lit(0).cast("bigint"), 15 - F.col("got")))


@query(
    "j7_paired_keys",
    """WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1)
    SELECT count(*) FILTER (o.k IS NULL) AS only_left, count(*) FILTER (l.k IS NULL) AS only_right, count(*) FILTER (o.n > 1) AS repeated, count(*) FILTER (l.k IS NOT NULL AND o.k IS NOT NULL) AS paired FROM l FULL JOIN o ON l.k = o.k""",
)
def j7_paired_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n_left"))
    right = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("n_right"))
    a, b = F.col("n_left").isNotNull(), F.col("n_right").isNotNull()
    return left.join(right, "k", "full_outer").agg(
        F.count_if(~b).alias("only_left"), F.count_if(~a).alias("only_right"), F.count_if(F.col("n_right") > 1).alias("repeated"), F.count_if(a & b).alias("paired")
    )


@query(
    "j8_stage_merge",
    """SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN 'label' ELSE 'document' END AS origin, coalesce(l.quality::VARCHAR, d.lang) AS value, b.item_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON d.doc_id = b.item_id""",
)
def j8_stage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    out = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").join(table(spark, sf_dir, "benchmark").select("item_id"), F.col("doc_id") == F.col("item_id"), "left")
    origin = F.when(F.col("quality").isNotNull(), "label").otherwise("document")
    return out.select("doc_id", origin.alias("origin"), F.coalesce(F.col("quality").cast("string"), "lang").alias("value"), "item_id")


@query(
    "j9_delta_report",
    """WITH a AS (SELECT l_linenumber AS k, quantile_cont(l_quantity, 0.95) AS p FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_linenumber AS k, quantile_cont(l_quantity, 0.95) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT a.k, a.p AS baseline, b.p AS current, round(CASE WHEN a.p <> 0 THEN (b.p - a.p) / a.p * 100 ELSE 0 END, 6) AS delta_pct FROM a JOIN b ON a.k = b.k""",
)
def j9_delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")

    def side(flag: str, name: str) -> DataFrame:
        return lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_linenumber").alias("k")).agg(F.percentile("l_quantity", F.lit(0.95)).alias(name))

    change = F.when(F.col("baseline") != 0, (F.col("current") - F.col("baseline")) / F.col("baseline") * 100).otherwise(0.0)
    return side("A", "baseline").join(side("R", "current"), "k").withColumn("delta_pct", F.round(change, 6))


@query(
    "j10_span_pairing",
    """WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'assistant')
    SELECT a.conv_id, a.turn, b.turn AS other_start FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.place = b.turn""",
)
def j10_span_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns by place against assistants' turns, whose indexes are unique."""
    turns = table(spark, sf_dir, "conversations")
    own = Window.partitionBy("conv_id").orderBy("turn")
    left = turns.where("role = 'user'").select("conv_id", "turn", F.row_number().over(own).cast("bigint").alias("index"), F.col("turn").alias("start"))
    right = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("index"), F.col("turn").alias("start"))
    return J.pair_by_index(left, right, "conv_id", "index").select("conv_id", "turn", "other_start")


SPAN = "SELECT user_id, event_id, epoch_ms(ts) // 1000 AS s, epoch_ms(ts) // 1000 + 1 + (event_id % 7) * 3600 AS e FROM events WHERE event_type = '{}'"


def _spans(spark: SparkSession, sf_dir: str, kind: str, side: str) -> DataFrame:
    start = epoch_seconds("ts")
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(
        "user_id", F.col("event_id").alias(f"id_{side}"), start.alias(f"start_{side}"), (start + 1 + (F.col("event_id") % 7) * 3600).alias(f"end_{side}")
    )


KINDS = ("click", "view")


@query(
    "j11_interval_overlap",
    f"""WITH a AS ({SPAN.format('click')}), b AS ({SPAN.format('view')}) SELECT a.event_id AS id_l, b.event_id AS id_r,
    round((least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)), 6) AS iou FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e""",
)
def j11_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = J.interval_join(_spans(spark, sf_dir, "click", "l"), _spans(spark, sf_dir, "view", "r"), ["user_id"], 21_600)
    iou = J.intersection_over_union(F.col("start_l"), F.col("end_l"), F.col("start_r"), F.col("end_r"))
    return pairs.select("id_l", "id_r", F.round(iou, 6).alias("iou"))


@query(
    "j12_points_in_spans",
    f"""WITH a AS ({SPAN.format('click')}), p AS (SELECT user_id, epoch_ms(ts) // 1000 AS x, value FROM events WHERE event_type = 'view')
    SELECT event_id AS id_l, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM a JOIN p ON a.user_id = p.user_id AND x >= s AND x < e GROUP BY 1""",
)
def j12_points_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir, "click", "l").withColumnsRenamed({"start_l": "start", "end_l": "end"})
    points = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", epoch_seconds("ts").alias("x"), "value")
    held = J.point_join(points, spans, ["user_id"], "x", 21_600)
    return held.groupBy("id_l").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "j13_fallback_key",
    "SELECT o_orderkey, coalesce(c_name, 'default-' || (o_custkey % 3)::VARCHAR) AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey",
)
def j13_fallback_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select("c_custkey", "c_name")
    rows = table(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("default-"), (F.col("o_custkey") % 3).cast("string"))).alias("name"))


@query(
    "j14_clamped_lookup",
    """WITH t AS (SELECT l_returnflag AS f, l_linenumber AS n, avg(l_quantity) AS v FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), o AS (SELECT l_returnflag AS f, avg(l_quantity) AS v FROM lineitem GROUP BY 1)
    SELECT l_returnflag, l_linenumber, count(*) AS n, round(any_value(coalesce(t.v, o.v)), 6) AS bound FROM lineitem LEFT JOIN t ON t.f = l_returnflag AND t.n = least(greatest(l_linenumber, 0), 4) LEFT JOIN o ON o.f = l_returnflag GROUP BY 1, 2""",
)
def j14_clamped_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    fine = lines.where("l_linenumber <= 4").groupBy("l_returnflag", F.col("l_linenumber").alias("at")).agg(F.avg("l_quantity").alias("v2"))
    coarse = lines.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("v1"))
    rows = lines.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n")).withColumn("at", F.least(F.greatest("l_linenumber", F.lit(0)), F.lit(4)))
    return rows.join(fine, ["l_returnflag", "at"], "left").join(coarse, "l_returnflag", "left").select("l_returnflag", "l_linenumber", "n", F.round(F.coalesce("v2", "v1"), 6).alias("bound"))


@query(
    "j15_inventory_lookup",
    """SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: coalesce((list_position(['the', 'of', 'and', 'to', 'in'], x) - 1)::VARCHAR, '5')), ' ') AS ids FROM documents""",
)
def j15_inventory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.create_map(*(x for i, w in enumerate(("the", "of", "and", "to", "in")) for x in (F.lit(w), F.lit(i))))
    tokens = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(5)).cast("string")), " ").alias("ids"))


@query(
    "j16_lexicon_precedence",
    "SELECT p_partkey AS k, p_name AS name, 'primary' AS origin FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, 'supplement' FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)",
)
def j16_lexicon_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    return J.primary_or_supplement(primary, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), "k")


@query("j17_near_matches")
def j17_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents that nearly equal a sentence of benchmark; each distinct key once."""
    left = keyed_sentences(spark, sf_dir).select(F.col("key").alias("lkey")).distinct().withColumn("lid", F.xxhash64("lkey"))
    right = held_keys(spark, sf_dir).select(F.col("key").alias("rkey")).withColumn("rid", F.xxhash64("rkey"))
    return J.near_matches(left, right)


@query(
    "j17_containment",
    f"WITH {SENTENCES}, {BENCH}, k AS (SELECT DISTINCT {SENTENCE_KEY} AS lkey FROM t) SELECT lkey, key AS rkey FROM k JOIN b ON contains(lkey, key) AND length(key) >= 20 AND length(key) >= 0.65 * length(lkey)",
)
def j17_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containment arm alone: a benchmark key of 20 characters or more inside a sentence's key.

    The contained key has 0.65 of the length, so it starts within the first 0.35, where its first 20 characters are an
    equi-join key, and holds what stands between 0.35 and 0.65: in keys of 80 characters and more these are more than 20, and 20 of them are
    met with all stretches of 20 characters of the benchmark's keys, one row for each key.
    """
    left = keyed_sentences(spark, sf_dir).select(F.col("key").alias("lkey")).distinct().where(F.length("lkey") >= 20)
    size = F.length("lkey")

    def cuts(key: str, last: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), last.cast("int")), lambda i: F.substr(key, i, F.lit(20)))

    inner = F.array(F.substr("lkey", (F.ceil(0.35 * size) + 2).cast("int"), F.lit(20)))
    probes = F.when(size >= 80, inner).otherwise(F.array_distinct(cuts("lkey", F.least(size - 19, F.floor(0.35 * size) + 2))))
    keys = held_keys(spark, sf_dir).where(F.length("key") >= 20).select(F.col("key").alias("rkey"))
    stretches = keys.select("rkey", F.explode(F.array_distinct(cuts("rkey", F.length("rkey") - 19))).alias("s"), F.lit(True).alias("long"))
    right = stretches.unionByName(keys.select("rkey", F.substring("rkey", 1, 20).alias("s"), F.lit(False).alias("long")))
    met = left.select("lkey", F.explode(probes).alias("s"), (size >= 80).alias("long")).join(right, ["s", "long"])
    return met.where(F.contains("lkey", "rkey") & (F.length("rkey") >= 0.65 * F.length("lkey"))).select("lkey", "rkey").distinct()


@query(
    "j18_existence",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_any, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS none_open,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_passed FROM customer""",
)
def j18_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(s == "P").alias("open"), F.bool_or(s == "F").alias("passed"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(found, "c_custkey", "left")
    return rows.select("c_custkey", F.col("open").isNotNull().alias("has_any"), (~F.coalesce("open", F.lit(False))).alias("none_open"), F.coalesce("passed", F.lit(False)).alias("has_passed"))


@query(
    "j19_coverage",
    """WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations)
    SELECT coalesce(a.w, b.w) AS word, CASE WHEN b.w IS NULL THEN 'missing' ELSE 'extra' END AS side FROM a FULL JOIN b ON a.w = b.w WHERE a.w IS NULL OR b.w IS NULL""",
)
def j19_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    def vocabulary(name: str, side: str) -> DataFrame:
        words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
        return table(spark, sf_dir, name).select(words.alias("word")).distinct().withColumn(side, F.lit(True))

    both = vocabulary("benchmark", "needed").join(vocabulary("conversations", "there"), "word", "full_outer")
    side = F.when(F.col("there").isNull(), "missing").otherwise("extra")
    return both.where("needed is null or there is null").select("word", side.alias("side"))


@query(
    "j20_parallel_compare",
    """WITH p AS (SELECT a.conv_id, a.turn, string_split(a.text, ' ') AS x, string_split(b.text, ' ') AS y, a.text = b.text AS exact, replace(lower(a.text), ' ', '') = replace(lower(b.text), ' ', '') AS relaxed
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, exact, relaxed, list_min(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: x[i] IS DISTINCT FROM y[i])) AS first_diff FROM p""",
)
def j20_parallel_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("x"))
    b = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    unequal = F.zip_with(F.split("x", " "), F.split("y", " "), lambda p, q: ~p.eqNullSafe(q))
    place = F.array_position(unequal, F.lit(True))
    bare = [F.replace(F.lower(c), F.lit(" "), F.lit("")) for c in ("x", "y")]
    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn", (F.col("x") == F.col("y")).alias("exact"), (bare[0] == bare[1]).alias("relaxed"), F.when(place > 0, place).alias("first_diff")
    )


@query(
    "u1_exclusion_union",
    """WITH u AS (SELECT text, 'benchmark' AS origin, 1 AS rank FROM benchmark UNION ALL SELECT text, 'documents', 2 FROM documents UNION ALL SELECT url, 'pages', 3 FROM pages),
    f AS (SELECT text, arg_min(origin, rank) AS origin FROM u GROUP BY text) SELECT origin, count(*) AS n FROM f GROUP BY 1""",
)
def u1_exclusion_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, n).select(F.col(c).alias("text"), F.lit(n).alias("origin"), F.lit(r).alias("rank")) for r, (n, c) in enumerate((("benchmark", "text"), ("documents", "text"), ("pages", "url")), 1)]
    merged = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return merged.groupBy("text").agg(F.min_by("origin", "rank").alias("origin")).groupBy("origin").agg(F.count("*").alias("n"))


@query("u2_empty_intersection", "SELECT count(*) AS n FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)")
def u2_empty_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("text").intersect(table(spark, sf_dir, "benchmark").select("text")).agg(F.count("*").alias("n"))


@query(
    "u3_difference",
    """WITH a AS (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders), b AS (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer)
    SELECT 'left' AS side, count(*) AS n, coalesce(array_to_string(list_sort(min(k, 3)), ','), '') AS sample FROM a UNION ALL SELECT 'right', count(*), coalesce(array_to_string(list_sort(min(k, 3)), ','), '') FROM b""",
)
def u3_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))

    def report(side: str, rows: DataFrame) -> DataFrame:
        least = rows.orderBy("k").limit(3).agg(F.array_join(F.transform(F.sort_array(F.collect_list("k")), lambda x: x.cast("string")), ",").alias("sample"))
        return rows.agg(F.count("*").alias("n")).join(F.broadcast(least)).select(F.lit(side).alias("side"), "n", "sample")

    return report("left", a.subtract(b)).unionByName(report("right", b.subtract(a)))


@query("u4_key_union", "WITH a AS (SELECT l_partkey AS k, count(*) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS y FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, x, y FROM a FULL JOIN b ON a.k = b.k WHERE x IS NOT NULL AND y IS NOT NULL")
def u4_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count_if(flag == "A").alias("x"), F.count_if(flag == "N").alias("y"))
    return counts.where("x > 0 and y > 0")


@query("u5_distinct_first_seen", "WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM w), f AS (SELECT doc_id, x, min(p) AS p FROM e GROUP BY ALL), j AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS words FROM f GROUP BY 1) SELECT doc_id, coalesce(words, '') AS words FROM w LEFT JOIN j USING (doc_id)")
def u5_distinct_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(words), " ").alias("words"))
