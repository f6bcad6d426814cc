"""Queries of the validation rules, and the flagship slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import text_key
from ..operators import rules as R
from ..registry import query
from .session import table

KEY = r"regexp_replace(lower({t}), '[^\p{L}\p{N}]', '', 'g')"
SPLIT = "CASE WHEN {b} < 20 THEN 'val' WHEN {b} < 40 THEN 'test' ELSE 'train' END"
BUCKET = "(('0x' || substr(sha256({g}::VARCHAR), 1, 8))::BIGINT % 1000)"
SENTENCES = (
    "s AS (SELECT doc_id, source, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos FROM "
    "(SELECT doc_id, source, regexp_extract_all(translate(text, chr(10), ' '), '[^.!?]+[.!?]') AS l FROM documents)), "
    "t AS (SELECT doc_id, source, pos, trim(raw) AS sentence, len(regexp_extract_all(raw, '[A-Za-z]+')) AS words FROM s)"
)


def clean_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents that pass the rules, first of each text key, none that is in benchmark."""
    docs = R.sentences(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    docs = docs.withColumn("seconds", R.speech_seconds(F.col("sentence"))).withColumn("key", text_key(F.col("sentence")))
    words = R.words(F.col("sentence"))
    reason = R.first_issue((F.col("sentence").contains("|"), "format"), (~words.between(8, 55), "length"), (~F.col("seconds").between(3, 20), "estimated_length"))
    fit = docs.where(reason.isNull()).select("key", "doc_id", "pos", "source", "seconds")
    first = R.first_by_key(fit, "key", ["doc_id", "pos"])
    held = R.sentences(table(spark, sf_dir, "benchmark"), ["item_id"]).select(text_key(F.col("sentence")).alias("key")).distinct()
    return first.join(held, "key", "left_anti")


@query(
    "slice_hours_by_source",
    f"""WITH {SENTENCES},
    f AS (SELECT *, {KEY.format(t='sentence', L='{L}', N='{N}')} AS key, words / 2.5 AS seconds FROM t WHERE NOT contains(sentence, '|') AND words BETWEEN 8 AND 55 AND words / 2.5 BETWEEN 3 AND 20),
    d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) = 1),
    b AS (SELECT DISTINCT {KEY.format(t='x', L='{L}', N='{N}')} AS key FROM (SELECT unnest(regexp_extract_all(translate(text, chr(10), ' '), '[^.!?]+[.!?]')) AS x FROM benchmark)),
    k AS (SELECT *, {SPLIT.format(b=BUCKET.format(g='doc_id'))} AS split, CASE WHEN seconds < 7 THEN 'short' WHEN seconds < 12 THEN 'medium' ELSE 'long' END AS length_bin FROM d WHERE key NOT IN (SELECT key FROM b))
    SELECT split, source, length_bin, count(*) AS n, round(sum(seconds) / 3600, 6) AS hours FROM k GROUP BY ROLLUP (split, source, length_bin)""",
)
def slice_hours_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_sentences(spark, sf_dir).withColumn("split", R.split_of(F.col("doc_id"))).withColumn("length_bin", R.length_bin(F.col("seconds")))
    return rows.rollup("split", "source", "length_bin").agg(F.count("*").alias("n"), F.round(F.sum("seconds") / 3600, 6).alias("hours"))


@query(
    "p1_health_report",
    """WITH i AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars > 6000 THEN 'too_long' END, CASE WHEN n_chars < 300 THEN 'too_short' END,
    CASE WHEN trim(text) = '' THEN 'empty_text' END, CASE WHEN contains(text, '|') THEN 'bad_format' END, CASE WHEN contains(text, '$$$') THEN 'extreme' END], lambda x: x IS NOT NULL)) AS issue FROM documents)
    SELECT issue, count(*) AS n, array_to_string(list_sort(min(doc_id, 10)), ',') AS examples FROM i GROUP BY issue""",
)
def p1_health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, size = F.col("text"), F.col("n_chars")
    found = R.issues((size > 6000, "too_long"), (size < 300, "too_short"), (F.trim(text) == "", "empty_text"), (text.contains("|"), "bad_format"), (text.contains("$$$"), "extreme"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("issue"))
    counts = rows.groupBy("issue").agg(F.count("*").alias("n"))

    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("issue").orderBy("doc_id"))).where("r <= 10")
    first = ranked.groupBy("issue").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return counts.join(first, "issue")


@query(
    "p2_status_split",
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN l_quantity IS NULL THEN 'missing' WHEN l_quantity <= 0 THEN 'error' WHEN l_quantity > 40 THEN 'long' ELSE 'kept' END AS status FROM lineitem) GROUP BY status""",
)
def p2_status_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    status = F.when(q.isNull(), "missing").when(q <= 0, "error").when(q > 40, "long").otherwise("kept")
    return table(spark, sf_dir, "lineitem").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "p3_eligibility",
    f"""WITH {SENTENCES}, u AS (SELECT *, CASE WHEN regexp_matches(sentence, '[|<>{{}}]') THEN 'format' WHEN regexp_matches(sentence, '[*#$%&]') THEN 'nonspoken_markup'
    WHEN NOT regexp_matches(sentence, '[.!?]$') THEN 'unfinished_punctuation' WHEN words < 8 OR words > 55 THEN 'length' WHEN words / 2.5 < 3 OR words / 2.5 > 20 THEN 'estimated_length' END AS reason FROM t)
    SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM u GROUP BY 1""",
)
def p3_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.sentences(table(spark, sf_dir, "documents"), ["doc_id"])
    s = F.col("sentence")
    reason = R.first_issue(
        (s.rlike("[|<>{}]"), "format"), (s.rlike("[*#$%&]"), "nonspoken_markup"), (~s.rlike("[.!?]$"), "unfinished_punctuation"),
        (~R.words(s).between(8, 55), "length"), (~R.speech_seconds(s).between(3, 20), "estimated_length"),
    )
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("p3_whole_cascade")
def p3_whole_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by the first reason of the whole cascade; a sentence's tokens are its characters, those over U+007F unknown."""
    rows = R.sentences(table(spark, sf_dir, "documents"), ["doc_id"])
    ids = F.transform(F.split(F.left("sentence", F.lit(400)), ""), lambda c: F.when(F.ascii(c) > 127, 2).otherwise(3))
    reason = R.eligibility(F.col("sentence"), ids, 2)
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("p3_repetition")
def p3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences in which 4 to 12 characters stand three times in a row."""
    rows = R.sentences(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.where(F.col("sentence").rlike(r"(.{4,12})\1\1")).select("doc_id", "pos", "sentence")


@query(
    "p4_admission",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 2 OR l_quantity > 45 THEN 'duration' WHEN l_tax > 0.07 THEN 'rate' WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 'channels'
    WHEN l_linenumber > l_quantity THEN 'ids_over_frames' END AS reason FROM lineitem) GROUP BY reason""",
)
def p4_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    reason = R.first_issue((~q.between(2, 45), "duration"), (F.col("l_tax") > 0.07, "rate"), (~F.col("l_returnflag").isin("A", "N", "R"), "channels"), (F.col("l_linenumber") > q, "ids_over_frames"))
    return table(spark, sf_dir, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "p5_candidate_gate",
    """SELECT d.doc_id, array_to_string(list_filter([CASE WHEN quality IS NULL OR quality < 1 THEN 'quality' END, CASE WHEN toxic IS NULL OR toxic > 0 THEN 'toxic' END,
    CASE WHEN lang = 'en' AND n_chars > 4000 THEN 'asr_en' WHEN lang <> 'en' AND n_chars > 3000 THEN 'asr_other' END], lambda x: x IS NOT NULL), ';') AS failed
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def p5_candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    other = F.when((F.col("lang") == "en") & (F.col("n_chars") > 4000), "asr_en").when((F.col("lang") != "en") & (F.col("n_chars") > 3000), "asr_other")
    failed = F.array_compact(F.array(F.when(R.below(F.col("quality"), 1), F.lit("quality")), F.when(R.below(-F.col("toxic"), 0), F.lit("toxic")), other))
    return rows.select("doc_id", F.array_join(failed, ";").alias("failed"))


@query("p6_weighted_score", "SELECT l_orderkey, l_linenumber, l_partkey, round(2 * l_discount + l_tax + 0.25 * l_quantity, 6) AS score FROM lineitem")
def p6_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = 2 * F.col("l_discount") + F.col("l_tax") + 0.25 * F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 6).alias("score"))


@query(
    "p7_synthetic_sanity",
    """SELECT doc_id, n_chars / 15.0 BETWEEN 0.25 AND 120 AND n_chars / 15.0 >= greatest(0.25, CASE WHEN lang = 'en' THEN 0.02 ELSE 0.045 END * length(text)) AND n_chars / 15.0 <= greatest(15, length(text)) AS sane FROM documents""",
)
def p7_synthetic_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds, size = F.col("n_chars") / 15.0, F.length("text")
    least = F.greatest(F.lit(0.25), F.when(F.col("lang") == "en", 0.02).otherwise(0.045) * size)
    sane = seconds.between(0.25, 120) & (seconds >= least) & (seconds <= F.greatest(F.lit(15), size))
    return table(spark, sf_dir, "documents").select("doc_id", sane.alias("sane"))


@query(
    "p8_held_out_filter",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN source IS NULL THEN 'missing_group' WHEN source IN ('src3', 'src7') THEN 'held_out_group'
    WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'held_out_text' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unknown_type' ELSE 'kept' END AS reason FROM documents d) GROUP BY reason""",
)
def p8_held_out_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("held")).distinct()
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(held, "doc_id", "left")
    reason = R.first_issue((F.col("source").isNull(), "missing_group"), (F.col("source").isin("src3", "src7"), "held_out_group"), (F.col("held"), "held_out_text"), (~F.col("lang").isin("en", "de", "fr"), "unknown_type"))
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("p9_letter_dot_filter")
def p9_letter_dot_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text holds two or more letter-dot pairs written apart by slashes, with all of them for audit."""
    found = F.regexp_extract_all("slashed", F.lit(r"(?:^|/)([A-Za-z]/\./[A-Za-z]/\.)(?=/|$)"), F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+", "/").alias("slashed"))
    return rows.withColumn("matches", found).where(F.size("matches") > 0).select("doc_id", F.array_join("matches", ";").alias("matches"))


@query(
    "p10_script_predicates",
    r"""SELECT doc_id, regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS has_han, regexp_matches(text, '[A-Za-z]') AS has_latin, regexp_matches(text, '^[A-Z]{1,2}[0-2]?( [A-Z]{1,2}[0-2]?)*$') AS is_arpabet FROM documents""",
)
def p10_script_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.rlike(R.HAN).alias("has_han"), t.rlike("[A-Za-z]").alias("has_latin"), t.rlike(r"\A[A-Z]{1,2}[0-2]?( [A-Z]{1,2}[0-2]?)*\z").alias("is_arpabet")
    )


@query(
    "p11_unknown_symbols",
    """WITH c AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(text), ''), lambda x: NOT contains('abcdefghijklmnopqrstuvwxyz .,' || chr(10), x))) AS l FROM documents)
    SELECT doc_id, len(l)::INTEGER AS n_unknown, array_to_string(list_sort(l), '') AS unknown FROM c WHERE len(l) > 0""",
)
def p11_unknown_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(*(F.lit(x) for x in "abcdefghijklmnopqrstuvwxyz .,\n"))
    unknown = F.array_except(F.split(F.lower("text"), ""), F.array_append(known, F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", unknown.alias("u")).where(F.size("u") > 0)
    return rows.select("doc_id", F.size("u").alias("n_unknown"), F.array_join(F.sort_array("u"), "").alias("unknown"))


@query(
    "p12_contract_asserts",
    """SELECT 'negative_price' AS name, count(*) FILTER (o_totalprice < 0) AS violations FROM orders UNION ALL SELECT 'no_customer', count(*) FILTER (o_custkey IS NULL) FROM orders
    UNION ALL SELECT 'unknown_status', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders UNION ALL SELECT 'repeated_key', count(*) - count(DISTINCT o_orderkey) FROM orders""",
)
def p12_contract_asserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "orders").agg(
        F.count_if(F.col("o_totalprice") < 0).alias("negative_price"), F.count_if(F.col("o_custkey").isNull()).alias("no_customer"),
        F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("unknown_status"), (F.count("*") - F.count_distinct("o_orderkey")).alias("repeated_key"),
    )
    return one.unpivot([], ["negative_price", "no_customer", "unknown_status", "repeated_key"], "name", "violations")


@query(
    "p13_text_counts",
    r"""SELECT doc_id, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]'))::INTEGER AS han, len(regexp_extract_all(text, '[A-Za-z]+'))::INTEGER AS words, len(regexp_extract_all(text, '[A-Za-z]'))::INTEGER AS letters,
    CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'mixed' ELSE 'zh' END WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'other' END AS label FROM documents""",
)
def p13_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    some_han, some_latin = t.rlike(R.HAN), t.rlike("[A-Za-z]")
    label = F.when(some_han & some_latin, "mixed").when(some_han, "zh").when(some_latin, "en").otherwise("other")
    return table(spark, sf_dir, "documents").select("doc_id", R.han(t).alias("han"), R.words(t).alias("words"), F.regexp_count(t, F.lit("[A-Za-z]")).alias("letters"), label.alias("label"))


@query(
    "p14_speech_estimate",
    f"WITH {SENTENCES} SELECT doc_id, pos::INTEGER AS pos, round(words / 2.5, 6) AS seconds, CASE WHEN words / 2.5 < 7 THEN 'short' WHEN words / 2.5 < 12 THEN 'medium' ELSE 'long' END AS length_bin FROM t",
)
def p14_speech_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = R.speech_seconds(F.col("sentence"))
    return R.sentences(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "pos", F.round(seconds, 6).alias("seconds"), R.length_bin(seconds).alias("length_bin"))


@query(
    "p15_duration_bucket",
    """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN l_quantity IS NULL OR isnan(l_quantity) THEN 'unknown' WHEN l_quantity <= 2 THEN '1-2' WHEN l_quantity <= 5 THEN '3-5' WHEN l_quantity <= 10 THEN '6-10'
    WHEN l_quantity <= 20 THEN '11-20' ELSE '21+' END AS bucket FROM lineitem) GROUP BY bucket""",
)
def p15_duration_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(R.duration_bucket(F.col("l_quantity")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "p16_word_bucket",
    f"WITH {SENTENCES} SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN length(sentence) - length(replace(sentence, ' ', '')) <= 3 THEN 'short' WHEN length(sentence) - length(replace(sentence, ' ', '')) <= 8 THEN 'medium' ELSE 'long' END AS bucket FROM t) GROUP BY bucket",
)
def p16_word_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = F.length("sentence") - F.length(F.replace(F.col("sentence"), F.lit(" "), F.lit("")))
    bucket = F.when(gaps <= 3, "short").when(gaps <= 8, "medium").otherwise("long")
    return R.sentences(table(spark, sf_dir, "documents"), ["doc_id"]).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "p17_switch_bins",
    """WITH r AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+|[0-9]+'), lambda x: regexp_matches(x, '^[0-9]')) AS l FROM documents),
    s AS (SELECT doc_id, len(list_filter(range(1, len(l)), lambda i: l[i] <> l[i + 1]))::BIGINT AS switches FROM r)
    SELECT doc_id, switches, CASE WHEN switches = 0 THEN '0' WHEN switches <= 2 THEN '1-2' ELSE '3+' END AS bin FROM s""",
)
def p17_switch_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)), lambda x: x.rlike("^[0-9]"))
    rows = table(spark, sf_dir, "documents").select("doc_id", runs.alias("l"))
    pairs = F.arrays_zip(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))).alias("a"), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))).alias("b"))
    rows = rows.withColumn("switches", F.size(F.filter(pairs, lambda p: p["a"] != p["b"])).cast("bigint"))
    return rows.select("doc_id", "switches", F.when(F.col("switches") == 0, "0").when(F.col("switches") <= 2, "1-2").otherwise("3+").alias("bin"))
