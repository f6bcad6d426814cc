"""Queries of the text functions over documents and pages."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from .session import table


def over_documents(name: str, function: Callable[[Column], Column], sql: str | None) -> None:
    """Registers doc_id and a function of its text, with SQL for the same over {t}."""

    @query(name, sql and f"SELECT doc_id, {sql.replace('{t}', 'text')} AS out FROM documents")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", function(F.col("text")).alias("out"))


def _sub(inner: str, pattern: str, put: str) -> str:
    return f"regexp_replace({inner}, '{pattern}', '{put}', 'g')"


BLANK = r"[ \t\n\r\f\x{0B}]"
over_documents("x1_nfkc", T.nfkc, None)
over_documents("x2_strip_emojis", T.strip_emojis, _sub("{t}", T.EMOJI, ""))
over_documents("x3_strip_control_chars", T.strip_control_chars, _sub("{t}", T.CONTROL, ""))
over_documents("x4_line_break_escapes", T.strip_line_break_escapes, _sub("{t}", r"(\\r\\n|\\n|\\r)", " "))
over_documents("x5_trailing_backslash", T.strip_trailing_backslash, _sub("{t}", r"\\( *)$", r"\1"))
over_documents("x6_clause_breaks", T.clause_breaks, None)
over_documents("x7_structural_quotes", T.strip_structural_quotes, None)
over_documents("x8_slash_segments", T.collapse_empty_slash_segments, _sub(_sub("{t}", "/( */)+", "/"), "^ */|/ *$", ""))
over_documents("x9_letter_dots", T.collapse_letter_dots, None)
over_documents("x10_dash_ranges", T.dash_ranges, None)
over_documents("x11_vertical_lines", T.replace_vertical_lines, _sub("translate({t}, '|｜', ',,')", "( *,)+", ","))
over_documents("x12_remove_dashes", T.remove_dashes, f"translate({{t}}, '{T.DASHES}', '')")
over_documents("x13_collapse_whitespace", T.collapse_whitespace, f"trim({_sub('{t}', BLANK + '+', ' ')})")
over_documents("x14_trailing_punct", T.dedupe_trailing_punct, None)
over_documents(
    "x15_sentence_end", T.ensure_sentence_end,
    "CASE WHEN {t} = '' THEN {t} WHEN right({t}, 1) IN ('.', '!', '?', '。', '！', '？') THEN {t} "
    r"WHEN regexp_matches({t}, '[\p{L}\p{N}]$') THEN {t} || ' .' ELSE {t} || '.' END",
)
over_documents("x16_ellipsis", T.normalize_ellipsis, _sub("replace(replace({t}, '……', '...'), '…', '...')", r"\.{3,}", "..."))
over_documents("x17_markdown_asterisks", T.strip_markdown_asterisks, None)
over_documents("x18_code_ticks", T.strip_code_ticks, "replace(replace({t}, '```', ' '), '`', ' ')")
over_documents("x19_underscore_runs", T.collapse_underscore_runs, _sub("{t}", "_{2,}", " "))
over_documents("x20_identifier_underscores", T.expand_identifier_underscores, None)
over_documents("x21_programming_tokens", T.programming_tokens, "replace(replace({t}, 'C++', 'C plus plus'), 'C#', 'C sharp')")
over_documents("x22_sql_glued", T.split_sql_glued, reduce(lambda t, p: _sub(t, rf"(?i)\b{p[0]}{p[1]}\b", f"{p[0]} {p[1]}"), [(a, b) for a, rest in T.SQL_GLUED for b in rest], "{t}"))
over_documents("x23_translate_chars", lambda c: T.translate_chars(c, "éèêäöü", "eeeaou"), "translate({t}, 'éèêäöü', 'eeeaou')")
over_documents("x24_double_hyphen", T.collapse_double_hyphen, _sub("{t}", "-{2,}", "-"))
over_documents("x25_sentence_punct", T.dedupe_sentence_punct, _sub(_sub(_sub(_sub("{t}", r"\.{2,}", "."), "!{2,}", "!"), r"\?{2,}", "?"), ",{2,}", ","))
over_documents("x26_brackets_to_pauses", T.brackets_to_pauses, None)
over_documents("x27_full_to_half_width", T.full_to_half_width, f"""translate({{t}}, '{T.FULL_WIDTH}', '{T.HALF_WIDTH.replace("'", "''")}')""")
over_documents("x28_inner_commas", T.split_inner_commas, _sub("{t}", "([A-Za-z])([,;])([A-Za-z])", r"\1 \2 \3"))
over_documents("x29_text_key", T.text_key, _sub("lower({t})", r"[^\p{L}\p{N}]", ""))
RULES = (("{{WH}}", "Q"), ("[aeiou]{2}", "_"), ("_+", "_"))
over_documents("x31_rule_table", lambda c: T.rewrite(c, RULES, {"WH": "wh[a-z]"}), _sub(_sub(_sub("{t}", "wh[a-z]", "Q"), "[aeiou]{2}", "_"), "_+", "_"))
over_documents("x33_rhythm_marks", T.strip_rhythm_marks, _sub("{t}", "#[0-9]", ""))
over_documents("x34_abbreviations", lambda c: T.expand_abbreviations(c, {"the": "that one", "and the": "plus the", "of": "from"}), None)
over_documents(
    "x35_text_to_slash", T.text_to_slash,
    f"array_to_string(list_filter(regexp_split_to_array({{t}}, '{BLANK}+'), lambda x: x <> ''), '/')",
)
over_documents("x35_slash_to_text", lambda c: T.slash_to_text(T.text_to_slash(c)), f"array_to_string(list_filter(regexp_split_to_array({{t}}, '{BLANK}+'), lambda x: x <> ''), ' ')")
over_documents(
    "x36_spell_acronyms", T.spell_acronyms,
    r"array_to_string(list_transform(string_split({t}, ' '), lambda w: CASE WHEN regexp_matches(w, '^[A-Z]{2,5}$') THEN trim(regexp_replace(w, '([A-Z])', '\1 ', 'g')) ELSE w END), ' ')",
)
over_documents("x37_acronym_segments", lambda c: F.to_json(T.acronym_segments(c)), None)
over_documents("x38_space_out", T.space_out, f"trim({_sub(_sub('{t}', BLANK + '+', ''), '(.)', chr(92) + '1 ')})")


@query("x30_file_stem", "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS stem FROM pages")
def x30_file_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.file_stem(F.col("url")).alias("stem"))


@query(
    "x31_rule_hits",
    r"SELECT lang, sum(len(regexp_extract_all(text, 'wh[a-z]')))::BIGINT AS wh, sum(len(regexp_extract_all(text, '[aeiou]{2}')))::BIGINT AS vowels FROM documents GROUP BY lang",
)
def x31_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = {"wh": "wh[a-z]", "vowels": "[aeiou]{2}"}
    return docs.groupBy("lang").agg(*(F.sum(F.regexp_count("text", F.lit(p))).alias(n) for n, p in hits.items()))
