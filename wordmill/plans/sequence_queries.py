"""Queries of array functions and sequence jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as Y
from ..functions.tables import register
from ..functions.text import text_key
from ..operators import sequences as D
from ..registry import query
from .rule_queries import KEY
from .session import epoch_seconds, table

WORDS = "regexp_extract_all(text, '[A-Za-z]+')"


def _words():
    return F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("y1_tone_backfill", f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, array_to_string(list_filter(w, lambda x: x NOT IN ('the', 'of')), ' ') AS tokens, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] NOT IN ('the', 'of')), lambda i: CASE WHEN w[i + 1] = 'the' THEN 1 WHEN w[i + 1] = 'of' THEN 2 ELSE 0 END), ' ') AS tones FROM w")
def y1_tone_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", _words().alias("w"))
    tokens, tones = Y.tone_backfill(F.col("w"), {"the": 1, "of": 2})
    return rows.select("doc_id", F.array_join(tokens, " ").alias("tokens"), F.array_join(F.transform(tones, lambda x: x.cast("string")), " ").alias("tones"))


@query("y2_prepend_marker", f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, array_to_string(CASE WHEN w[1] = 'The' THEN w ELSE list_concat(['The'], w) END, ' ') AS tokens FROM w")
def y2_prepend_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(Y.prepend_if_absent(_words(), "The"), " ").alias("tokens"))


@query("y3_intersperse", f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, array_to_string(list_concat(['_'], flatten(list_transform(w, lambda x: [x, '_']))), ' ') AS tokens FROM w")
def y3_intersperse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(Y.intersperse(_words(), "_"), " ").alias("tokens"))


@query("y4_parallel_checks", f"WITH w AS (SELECT doc_id, {WORDS} AS a, string_split(text, ' ') AS b FROM documents) SELECT doc_id, len(a) = len(b) AS same_size, len(list_filter(a, lambda x: length(x) > 1)) = len(a) AS all_long FROM w")
def y4_parallel_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", _words().alias("a"), F.split("text", " ").alias("b"))
    return rows.select("doc_id", (F.size("a") == F.size("b")).alias("same_size"), F.forall("a", lambda x: F.length(x) > 1).alias("all_long"))


@query("y5_slice_together", f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, array_to_string(list_slice(w, 3, 6), ' ') AS tokens, array_to_string(list_transform(list_slice(w, 3, 6), lambda x: length(x)), ' ') AS sizes FROM w")
def y5_slice_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.slice(_words(), 3, 4)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(cut, " ").alias("tokens"), F.array_join(F.transform(cut, lambda x: F.length(x).cast("string")), " ").alias("sizes"))


@query("y6_run_lengths", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, repeat(l_returnflag, l_quantity::INT) || repeat(l_linestatus, l_linenumber::INT) AS frames FROM lineitem")
def y6_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = Y.run_lengths(F.array("l_returnflag", "l_linestatus"), F.array("l_quantity", F.col("l_linenumber").cast("double")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(spread, "").alias("frames"))


@query("y7_character_grams", "WITH k AS (SELECT doc_id, string_split(text, '') AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS c, generate_subscripts(t, 1) AS i FROM k), g AS (SELECT doc_id, c || lead(c) OVER w || lead(c, 2) OVER w || lead(c, 3) OVER w AS g FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, count(DISTINCT g) AS n FROM g GROUP BY 1 HAVING count(g) > 0")
def y7_character_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).where(F.length("text") >= 4)
    return rows.select("doc_id", Y.count_grams(F.col("text"), 4).alias("n"))


@query("y8_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def y8_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    cosine = Y.dot(F.col("a"), F.col("b")) / (Y.norm(F.col("a")) * Y.norm(F.col("b")))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine, 6).alias("cosine"))


@query("y9_vector_levels", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)), 6) AS rms, round(list_max(list_transform(e, lambda x: abs(x))), 6) AS peak, round(len(list_filter(e, lambda x: abs(x) > 0.1)) / len(e), 6) AS active FROM v")
def y9_vector_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", F.round(Y.rms(e), 6).alias("rms"), F.round(Y.peak(e), 6).alias("peak"), F.round(Y.share_above(e, F.lit(0.1)), 6).alias("active"))


@query("y10_z_scores", "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM v) SELECT vec_id, round(sum((x - m) / s), 4) AS total FROM v, m GROUP BY 1")
def y10_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    sums = [F.sum(F.aggregate("e", F.lit(0.0), (lambda a, x: a + x) if p == 1 else (lambda a, x: a + x * x))) for p in (1, 2)]
    moments = rows.agg(F.sum(F.size("e")).alias("n"), sums[0].alias("s"), sums[1].alias("ss")).select((F.col("s") / F.col("n")).alias("m"), F.sqrt(F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2).alias("d"))
    scored = rows.join(F.broadcast(moments))  # one row
    return scored.select("vec_id", F.round(F.aggregate(F.transform("e", lambda x: (x - F.col("m")) / F.col("d")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("y11_frames", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS from_frames, round_even(l_quantity / 7.0 * 24000 / 384, 0)::BIGINT AS from_sec FROM lineitem")
def y11_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", Y.frames(q, F.lit("frame")).alias("from_frames"), Y.frames(q / 7.0, F.lit("sec")).alias("from_sec"))


@query("y12_hash_ids", "SELECT doc_id, sha256(text) AS key, -(('0x' || substr(sha256(text), 1, 15))::BIGINT) AS id FROM documents")
def y12_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("key"), Y.negative_id(F.col("text")).alias("id"))


@query(
    "y13_anomaly",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount * 40 AS z, l_quantity / 20 AS r FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(greatest(z, abs(ln(greatest(r, 1e-8)))), 6) AS score,
    array_to_string(list_filter([CASE WHEN z > 2 THEN 'acoustic' END, CASE WHEN r < 0.5 THEN 'short' END, CASE WHEN r > 2 THEN 'long' END], lambda x: x IS NOT NULL), ';') AS flags FROM x""",
)
def y13_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, flags = Y.anomaly(F.col("l_discount") * 40, F.col("l_quantity") / 20)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(score, 6).alias("score"), flags.alias("flags"))


@query("y14_json", """SELECT event_id, (props ->> '$.k')::INT AS k, '{"k":' || (props ->> '$.k') || ',"type":"' || event_type || '"}' AS payload FROM events""")
def y14_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("payload"))


@query("y15_unix_time", "SELECT event_id, floor(epoch(ts))::BIGINT AS t, floor(epoch(ts))::BIGINT < (SELECT max(floor(epoch(ts))::BIGINT) FROM events) - 86400 AS older FROM events")
def y15_unix_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", epoch_seconds("ts").alias("t"))
    return rows.join(F.broadcast(rows.agg(F.max("t").alias("last")))).select("event_id", "t", (F.col("t") < F.col("last") - 86_400).alias("older"))


@query("y17_language_runs", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) AS runs, len(list_filter(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), lambda x: regexp_matches(x, '^[A-Za-z]'))) AS latin FROM documents")
def y17_language_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", Y.language_runs(F.col("text")).alias("r"))
    return rows.select("doc_id", F.size("r").cast("bigint").alias("runs"), F.size(F.filter("r", lambda x: x["lang"] == "en")).cast("bigint").alias("latin"))


@query("y18_phone_units")
def y18_phone_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(Y.phone_units(F.regexp_replace("text", r"\s+", " / "))).alias("units"))


@query("y20_third_tones", "WITH w AS (SELECT l_orderkey, list('a' || (l_linenumber % 2 + 2)::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS w FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] = 'a3' AND w[i + 1] = 'a3' THEN 'a2' ELSE w[i] END), ' ') AS tones FROM w")
def y20_third_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.concat(F.lit("a"), (F.col("l_linenumber") % 2 + 2).cast("string")).alias("x"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(one)), lambda s: s["x"]).alias("w"))
    return rows.select("l_orderkey", F.array_join(Y.third_tones(F.col("w")), " ").alias("tones"))


#: The SQL twin's distance counts bytes: accented letters of the given languages become capitals, which a key does not hold.
ACCENTED, PLAIN = "àâçèéêëîïôùûüäößñóíáú", "ABCDEFGHIJKLMNOPQRSTU"
ADJACENT = "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("x"))
    b = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return a.join(b, ["conv_id", "turn"])


@query("d1_cer", f"WITH k AS (SELECT a.conv_id, a.turn, {KEY.format(t="a.text", L="{L}", N="{N}")} AS x, {KEY.format(t="b.text", L="{L}", N="{N}")} AS y {ADJACENT}) SELECT conv_id, turn, round(levenshtein(translate(x, '{ACCENTED}', '{PLAIN}'), translate(y, '{ACCENTED}', '{PLAIN}')) / greatest(length(x), 1), 6) AS cer FROM k")
def d1_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjacent(spark, sf_dir).select("conv_id", "turn", F.round(D.cer(text_key(F.col("x")), text_key(F.col("y"))), 6).alias("cer"))


@query("d2_wer")
def d2_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjacent(spark, sf_dir).select("conv_id", "turn", F.round(D.wer(F.col("x"), F.col("y")), 6).alias("wer"))


@query("d3_restricted_cer")
def d3_restricted_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate over letters with accents alone, as over one script of mixed text."""
    own = [F.array_join(F.regexp_extract_all(c, F.lit("[^\\x{00}-\\x{7F}]"), F.lit(0)), "") for c in ("x", "y")]
    return _adjacent(spark, sf_dir).select("conv_id", "turn", F.round(D.cer(*own), 6).alias("cer"), (own[0] == own[1]).alias("exact"))


@query("d4_dtw")
def d4_dtw(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair"), F.col("embedding").alias("x"))
    b = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("pair"), F.col("embedding").alias("y"))
    return D.dtw_costs(a.join(b, "pair"), 6)


LEXICON = "l AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark))"


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return table(spark, sf_dir, "benchmark").select(words.alias("word")).distinct().withColumn("reading", F.upper("word"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    lexicon = _lexicon(spark, sf_dir)
    main, more = lexicon.where(F.length("word") % 2 == 0), lexicon.where(F.length("word") % 2 == 1)
    return words.groupBy("word").agg(F.count("*").alias("n")).join(D.lookup(words, main, more), "word")


@query(
    "d6_lexicon_lookup",
    f"WITH {LEXICON}, w AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1) SELECT CASE WHEN l.word IS NULL THEN 'spell' WHEN length(l.word) % 2 = 0 THEN 'lexicon' ELSE 'supplement' END AS origin, count(*) AS words, sum(n)::BIGINT AS tokens FROM w LEFT JOIN l ON w.word = l.word GROUP BY 1",
)
def d6_lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))


@query("d7_context_variant", "SELECT conv_id, turn, CASE WHEN lag(role) OVER w = 'system' THEN 'a' WHEN lead(role) OVER w = 'assistant' THEN 'b' WHEN lead(role) OVER w IS NULL THEN 'c' ELSE 'd' END AS variant FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def d7_context_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id").orderBy("turn")
    variant = F.when(F.lag("role").over(own) == "system", "a").when(F.lead("role").over(own) == "assistant", "b").when(F.lead("role").over(own).isNull(), "c").otherwise("d")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", variant.alias("variant"))


#: Rules of two words that have more than one reading, and the lists that they name.
VARIANTS = {
    "THE": [{"pick": 1, "when": {"next_vowel": True}}, {"pick": 2, "when": {"next_end": True}}, {"pick": 0}],
    "A": [{"pick": 2, "when": {"prev_in": "small"}}, {"pick": 1, "when": {"next_suffix": "ing"}}, {"pick": 3, "when": {"prev_matches": "^[m-z]", "prev_not_in": "small"}}],
}
VARIANT_LISTS = {"small": ("is", "of", "in", "to")}


@query(
    "d7_rule_variants",
    r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+|[.,!?]') AS w FROM conversations), e AS (SELECT conv_id, turn, unnest(w) AS token, unnest(range(len(w))) AS pos FROM t),
    b AS (SELECT *, CASE WHEN regexp_matches(token, '[A-Za-z]') THEN lower(token) END AS word FROM e),
    n AS (SELECT *, last_value(word IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
        first_value(word IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next, lead(token) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS following FROM b)
    SELECT conv_id, turn, pos::INT AS pos, CASE WHEN upper(token) = 'THE' AND regexp_matches(next, '^[aeiou]') THEN 1 WHEN upper(token) = 'THE' AND (following IS NULL OR following IN ('.', ',', '!', '?')) THEN 2 WHEN upper(token) = 'THE' THEN 0
        WHEN upper(token) = 'A' AND prev IN ('is', 'of', 'in', 'to') THEN 2 WHEN upper(token) = 'A' AND ends_with(next, 'ing') THEN 1
        WHEN upper(token) = 'A' AND regexp_matches(prev, '^[m-z]') AND coalesce(prev NOT IN ('is', 'of', 'in', 'to'), true) THEN 3 END AS variant FROM n WHERE upper(token) IN ('THE', 'A')""",
)
def d7_rule_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of two words by a table of rules over their neighbours; a turn is a sentence."""
    tokens = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[.,!?]"), F.lit(0))).alias("pos", "token"))
    chosen = D.context_variants(tokens, ["conv_id", "turn"], "pos", "token", VARIANTS, VARIANT_LISTS)
    return chosen.where(F.upper("token").isin(*VARIANTS)).select("conv_id", "turn", "pos", "variant")


@query("d8_missing_words", f"WITH {LEXICON}, w AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1) SELECT word, n FROM w WHERE word NOT IN (SELECT word FROM l) AND n >= 5")
def d8_missing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(spark, sf_dir).where("origin = 'spell' and n >= 5").select("word", "n")


@query("d9_phrase_tags")
def d9_phrase_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tag_phrases(_docs(spark, sf_dir), "doc_id", "text", ["of the", "of", "in the", "the and of"])


def benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase of two and three words of the benchmark's texts: a lexicon of tens of thousands."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))

    return table(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.explode(F.concat(grams(2), grams(3))).alias("phrase")).where(F.contains("phrase", F.lit(" "))).distinct()


@query("d9_lexicon_tags")
def d9_lexicon_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest phrases of the benchmark in documents, with vetoes of what stands before and of what the last word begins."""
    return D.tag_phrases(_docs(spark, sf_dir), "doc_id", "text", benchmark_phrases(spark, sf_dir), {"of the": ("the",)}, overlaps=True)


@query("d11_lexicon_validation", "SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM (SELECT len(list_filter(string_split(p_name, ' '), lambda x: regexp_matches(x, '^[a-z#0-9]+$'))) = len(string_split(p_name, ' ')) AS ok FROM part)")
def d11_lexicon_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.forall(F.split("p_name", " "), lambda x: x.rlike("^[a-z#0-9]+$"))
    return table(spark, sf_dir, "part").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query("d14_chunks")
def d14_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.chunks(_docs(spark, sf_dir), "doc_id", "text", 40)


@query("d14_text_chunks")
def d14_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As d14, by the table function that SQL calls for every row."""
    register(spark)
    return spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL text_chunks(d.text, 40) c", docs=_docs(spark, sf_dir))


@query("d15_token_chunks")
def d15_token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and marks of texts as encoded utterances, cut at sentence, clause and word boundaries."""
    register(spark)
    tokens = F.regexp_extract_all(F.regexp_replace("text", " ", "_"), F.lit("_|[^_\\s.,!?]+|[.,!?]"), F.lit(0))
    rows = _docs(spark, sf_dir).select("doc_id", tokens.alias("tokens")).withColumn("ids", F.transform("tokens", lambda t: F.length(t)))
    return spark.sql("SELECT d.doc_id, c.chunk, c.tokens, c.ids, c.cut FROM {rows} d, LATERAL token_chunks(d.tokens, d.ids, CAST(NULL AS ARRAY<INT>), 60) c", rows=rows)


@query("d16_reassemble", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1 HAVING count(*) = max(turn) + 1")
def d16_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("chunk"), F.col("text").alias("part"))
    return D.reassemble(rows.withColumn("n_chunks", F.max("chunk").over(Window.partitionBy("conv_id")) + 1), "conv_id")


@query("d17_sql_functions", "SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS bin FROM documents")
def d17_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION size_bin(n BIGINT) RETURNS STRING RETURN CASE WHEN n < 1000 THEN 'short' WHEN n < 3000 THEN 'medium' ELSE 'long' END")
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("size_bin(n_chars)").alias("bin"))


@query("d19_near_threshold", "SELECT vec_id FROM embeddings WHERE abs(embedding[1]::DOUBLE - 0.1) <= 0.02")
def d19_near_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose first score lies so near the threshold that it must be scored again."""
    return table(spark, sf_dir, "embeddings").where(F.abs(F.get("embedding", F.lit(0)).cast("double") - 0.1) <= 0.02).select("vec_id")


@query("d5_interval_tokens")
def d5_interval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns' words as tokens against their letters as spoken intervals, of which one in seven was not spoken."""
    words = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("utt"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("pos", "token"))
    phones = words.select("utt", F.col("pos").cast("bigint").alias("pos"), "token", F.regexp_extract_all("token", F.lit("[^aeiou]+|[aeiou]"), F.lit(0)).alias("phones"))
    spoken = phones.select("utt", F.col("pos").alias("word"), F.posexplode("phones").alias("at", "label")).withColumn("pos", F.col("word") * 100 + F.col("at"))
    heard = spoken.where(F.pmod(F.xxhash64("utt", "pos"), F.lit(7)) > 0).select("utt", "pos", "label", F.col("pos").cast("double").alias("start"), (F.col("pos") + F.length("label")).cast("double").alias("end"))
    return D.assign_intervals(phones, heard, ("w", "y", "h"), ("a", "e", "i", "o", "u"), 1.0, codas=("r", "n"), same={"c": ("k", "s")})


@query(
    "d19_scored_in_batches",
    "WITH m AS (SELECT vec_id, list_avg(embedding::DOUBLE[]) AS mean FROM embeddings) SELECT vec_id, round(mean, 6) AS mean, abs(mean - 0.01) < 0.002 AS again FROM m",
)
def d19_scored_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through an outside scorer in batches of one length; those near the threshold are scored again, alone."""
    scored = D.score_in_batches(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda x: {"mean": x.mean(axis=1)}, {"mean": 0.01})
    return scored.select("vec_id", F.round("mean", 6).alias("mean"), "again")
