"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, jaccard, licenses, mixing, phrases, quality, runs, sstable, toxicity, urls
from .common import small_batches
from .simhash import simhash_groups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


QUERIES["op1_toxicity"] = op1_toxicity
QUERIES["op2_quality"] = op2_quality
QUERIES["op3_simhash"] = op3_simhash


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op4_bpe"] = op4_bpe


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES["op6_sstable"] = op6_sstable


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


QUERIES["op9_licenses"] = op9_licenses


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


QUERIES["op8_ann"] = op8_ann


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


QUERIES["op10_urls"] = op10_urls


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op7_mixing"] = op7_mixing


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


QUERIES["op5_chat"] = op5_chat


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op11's contract: of every tenth id by hash, the words from a place on are repeated with a period."""
    h = crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(_table(spark, sf_dir, "documents"), change=planted)


QUERIES["op11_runs"] = op11_runs


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES["op12_phrases"] = op12_phrases
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op12_phrases"] = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), f AS MATERIALIZED (
    SELECT lang, p, count(*) AS f
    FROM (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])))) AS p FROM words)
    GROUP BY lang, p
    HAVING count(*) >= 30 OR len(p) = 1
), candidates AS (
    SELECT lang, p, f AS a FROM f WHERE len(p) > 1
), cuts AS (
    SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, (2000000 * c.a::HUGEINT // (x.f + y.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, len(p))) AS k FROM candidates) c
    JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : k]
    JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 :]
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inside AS (
    SELECT lang, q, max(a) AS longer
    FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, len(p)), lambda k: list_transform(range(1, len(p) - k + 2), lambda i: p[i : i + k - 1])))) AS q FROM candidates)
    GROUP BY lang, q
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY lang
), ranked AS (
    SELECT lowest.lang, array_to_string(lowest.p, ' ') AS phrase, a, l, r, score,
           row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, array_to_string(lowest.p, ' ')) AS rank
    FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.q = lowest.p
    WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents"))


QUERIES["op13_jaccard"] = op13_jaccard
SQL["op13_jaccard"] = rf"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
    SELECT row_no, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM words
), shingles AS MATERIALIZED (
    SELECT row_no, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS MATERIALIZED (
    SELECT x.row_no AS u, y.row_no AS v
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.row_no <> y.row_no
    GROUP BY x.row_no, y.row_no, x.n, y.n
    HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reached(u, v) AS (
    SELECT row_no, row_no FROM sets UNION SELECT reached.u, links.v FROM reached JOIN links ON links.u = reached.v
)
SELECT any_value(a.doc_id) AS doc_id, any_value(len(a.s))::BIGINT AS n_shingles, min(b.doc_id) AS component_id
FROM reached JOIN sets a ON a.row_no = reached.u JOIN sets b ON b.row_no = reached.v
GROUP BY reached.u
"""


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 counts before its method decides, which SQL can count as well."""
    return op2_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES["base_quality"] = base_quality
SQL["base_quality"] = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents
), w AS MATERIALIZED (
    SELECT row_no, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), windows AS (
    SELECT row_no, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT row_no, w, unnest(range(1, len(w) - 6)) AS i FROM w)
), twice AS (
    SELECT row_no, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_no, g) > 1
), covered AS (
    SELECT row_no, count(DISTINCT p) AS n FROM (SELECT row_no, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY row_no
), lines AS (
    SELECT row_no, line FROM (SELECT row_no, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), copied AS (
    SELECT row_no, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY row_no
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(copied.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
       len(w) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(w) AS base_failed
FROM w LEFT JOIN covered USING (row_no) LEFT JOIN copied USING (row_no)
"""


def nearest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's neighbours, which an exact search must agree with; scores in six places."""
    return op8_ann(spark, sf_dir).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


QUERIES["nearest_ids"] = nearest_ids
SQL["nearest_ids"] = """
WITH v AS MATERIALIZED (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id)::INT AS rank, vec_id, round(score, 6) AS score
FROM pairs QUALIFY rank <= 5
"""


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where op9 finds whole phrases, before its templates add their labels."""
    return op9_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES["base_licenses"] = base_licenses
SQL["base_licenses"] = rf"""
WITH phrases(p, label) AS (
    VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')
), d AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
    SELECT row_no, i - 1 AS place, label FROM (SELECT row_no, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN phrases ON w[i] = p[1] AND w[i : i + len(p) - 1] = p
), found AS (
    SELECT row_no, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY row_no
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN found USING (row_no)
"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's hosts, paths and rules; what no rule decides is left to its trees."""
    return op10_urls(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


QUERIES["url_rules"] = url_rules
SQL["url_rules"] = r"""
WITH rules(host, path, verdict, name) AS (
    VALUES ('org', '/', 'allow', 'org/'), ('example.org', '/es/', 'block', 'example.org/es/'), ('example.org', '/en/1', 'block', 'example.org/en/1'), ('com', '/fr/', 'allow', 'com/fr/'), ('com', '/de/', 'block', 'com/de/')
), cut AS (
    SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fits AS (
    SELECT row_no, name, verdict FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY length(name) DESC, name) = 1
)
SELECT page_id, host, path, name AS rule, verdict AS ruled FROM parts LEFT JOIN fits USING (row_no)
"""
