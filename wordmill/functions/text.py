"""Text normalisation as column functions, and a fold of named stages over a column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Collection, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Classes of characters, as regular expressions.
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2300}-\\x{23FF}\\x{1F000}-\\x{1F2FF}\\x{E0020}-\\x{E007F}\\x{20E3}\\x{FE0F}\\x{200D}]"
CONTROL = "[\\x{00}-\\x{1F}\\x{7F}-\\x{9F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{FEFF}\\x{FFF9}-\\x{FFFB}]"
BLANK = "[ \\t\\n\\r\\f\\x{0B}]"
DASHES = "-‐‑‒–—―−"
FULL_WIDTH = "，。！？；：（）【】《》“”‘’、"
HALF_WIDTH = ",.!?;:()[]<>\"\"'',"
#: Query words that are written glued together, first words and what follows each.
SQL_GLUED = (
    ("TRUNC", ("DATE", "MONTH", "YEAR", "DAY", "HOUR", "MINUTE", "SECOND")), ("COUNT", ("DISTINCT",)), ("GROUP", ("BY",)), ("ORDER", ("BY",)),
    ("INNER", ("JOIN",)), ("LEFT", ("JOIN",)), ("RIGHT", ("JOIN",)), ("OUTER", ("JOIN",)), ("CROSS", ("JOIN",)), ("FULL", ("JOIN",)),
    ("LEN", ("STRING",)), ("TO", ("CHAR", "DATE", "NUMBER")), ("NVL", ("2",)),
)
#: Whatever NFKC can change: all but ASCII and the accented letters that it leaves alone.
UNSETTLED = "[^\\x{00}-\\x{7F}\\x{C0}-\\x{131}]"


def strip_emojis(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


def strip_control_chars(c: Column) -> Column:
    """Drops C0 and C1 controls, line ends and tabs too, zero-width and direction marks."""
    return F.regexp_replace(c, CONTROL, "")


def strip_line_break_escapes(c: Column) -> Column:
    """A written-out backslash-n or backslash-r becomes a space."""
    return F.regexp_replace(c, r"(\\r\\n|\\n|\\r)", " ")


def strip_trailing_backslash(c: Column) -> Column:
    return F.regexp_replace(c, r"\\( *)$", "$1")


def collapse_empty_slash_segments(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"/( */)+", "/"), r"^ */|/ *$", "")


def replace_vertical_lines(c: Column) -> Column:
    """Vertical lines become commas, runs of them one comma."""
    return F.regexp_replace(F.translate(c, "|｜", ",,"), "( *,)+", ",")


def remove_dashes(c: Column) -> Column:
    return F.translate(c, DASHES, "")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def ensure_sentence_end(c: Column) -> Column:
    """Adds " ." after a letter or digit and "." after anything else but a sentence end; empty stays empty."""
    return (
        F.when(c == "", c)
        .when(F.right(c, F.lit(1)).isin(".", "!", "?", "。", "！", "？"), c)
        .when(c.rlike(r"[\p{L}\p{N}]$"), F.concat(c, F.lit(" .")))
        .otherwise(F.concat(c, F.lit(".")))
    )


def normalize_ellipsis(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(c, F.lit("……"), F.lit("...")), F.lit("…"), F.lit("...")), r"\.{3,}", "...")


def strip_code_ticks(c: Column) -> Column:
    """Code marks become a space, three together one."""
    return F.replace(F.replace(c, F.lit("```"), F.lit(" ")), F.lit("`"), F.lit(" "))


def collapse_underscore_runs(c: Column) -> Column:
    return F.regexp_replace(c, "_{2,}", " ")


def programming_tokens(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("C++"), F.lit("C plus plus")), F.lit("C#"), F.lit("C sharp"))


def split_sql_glued(c: Column) -> Column:
    """Glued query words of any case, standing alone, become two upper-case words."""
    pairs = [(first, then) for first, rest in SQL_GLUED for then in rest]
    out = c
    for first, then in pairs:
        out = F.regexp_replace(out, rf"(?i)\b{first}{then}\b", f"{first} {then}")
    return F.when(c.rlike(rf"(?i)\b({'|'.join(a + b for a, b in pairs)})\b"), out).otherwise(c)


def translate_chars(c: Column, source: str, target: str) -> Column:
    return F.translate(c, source, target)


def collapse_double_hyphen(c: Column) -> Column:
    return F.regexp_replace(c, "-{2,}", "-")


def dedupe_sentence_punct(c: Column) -> Column:
    out = c
    for mark in (r"\.", "!", r"\?", ","):
        out = F.regexp_replace(out, f"{mark}{{2,}}", mark.strip("\\"))
    return out


def full_to_half_width(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def split_inner_commas(c: Column) -> Column:
    """Latin words glued by a comma or semicolon come apart."""
    return F.regexp_replace(c, "([A-Za-z])([,;])([A-Za-z])", "$1 $2 $3")


def text_key(c: Column) -> Column:
    """NFKC, lower case, letters and digits only: equal for texts that differ in form, spacing and punctuation.

    Only texts that NFKC may change are sent to Python.
    """
    unsettled = c.rlike(UNSETTLED)
    settled = F.when(unsettled, nfkc(F.when(unsettled, c))).otherwise(c)
    return F.regexp_replace(F.lower(settled), r"[^\p{L}\p{N}]", "")


def file_stem(c: Column) -> Column:
    """A safe file name: runs of other characters become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def rewrite(c: Column, rules: Sequence[tuple[str, str]], names: dict[str, str] | None = None) -> Column:
    """Ordered (pattern, replacement) rules; {{NAME}} in a pattern stands for names[NAME]."""
    out = c
    for pattern, put in rules:
        for name, value in (names or {}).items():
            pattern = pattern.replace("{{" + name + "}}", value)
        out = F.regexp_replace(out, pattern, put)
    return out


def strip_rhythm_marks(c: Column) -> Column:
    return F.regexp_replace(c, "#[0-9]", "")


def slash_to_text(c: Column) -> Column:
    """"a/b//c" as "a b c"."""
    return F.array_join(F.filter(F.split(c, "/"), lambda x: F.trim(x) != ""), " ")


def text_to_slash(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, BLANK + "+"), lambda x: x != ""), "/")


#: Punctuation at a word's ends that its acronym key leaves out.
EDGES = r"""[\p{P}$+<=>^`|~]"""


def acronym_key(word: Column) -> Column:
    """A word in capitals, without white space and the punctuation around it."""
    return F.upper(F.regexp_replace(F.regexp_replace(word, rf"^{EDGES}+|{EDGES}+$", ""), r"\s+", ""))


def is_acronym(word: Column, common: Collection[str] = ()) -> Column:
    """Words of 2 to 5 capitals, and those with a capital whose key is in a list of common acronyms."""
    plain = word.rlike("^[A-Z]{2,5}$")
    return (plain | (word.rlike(r"\p{Lu}") & acronym_key(word).isin(*sorted({k.upper() for k in common})))) if common else plain


def spell_acronyms(c: Column, common: Collection[str] = ()) -> Column:
    """Acronyms as single characters, runs of digits whole; other words as they are."""
    spelled = F.transform(F.split(c, " "), lambda w: F.when(is_acronym(w, common), F.array_join(F.regexp_extract_all(w, F.lit(r"\d+|\S"), F.lit(0)), " ")).otherwise(w))
    return F.array_join(spelled, " ")


def space_out(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, BLANK + "+", ""), "(.)", "$1 "))


#: Quotes that go everywhere, and those that stay between two letters.
QUOTES, APOSTROPHES = "\"“”「」《》【】『』", "'‘’"


def strip_structural_quotes(c: Column) -> Column:
    """Quotes go, but an apostrophe between two letters stays."""
    return F.regexp_replace(F.translate(c, QUOTES, ""), rf"(?<!\p{{L}})[{APOSTROPHES}]|[{APOSTROPHES}](?!\p{{L}})", "")


#: An abbreviation of capitals with dots, and a range of one- and two-digit numbers that is no date, time, version or angle.
LETTER_DOTS = r"\b(?:[A-Z][a-z]?\.)+(?:[A-Z][a-z]?)?\."
NUMBER_RANGE = r"(?<!\d)(?<!:)(\d{1,2})\s*[-–—]\s*(\d{1,2})(?!\d)(?!\s*[/\.])(?!\s*°)"


def collapse_letter_dots(c: Column) -> Column:
    """U.S. as US and Ph.D. as PhD, the last dot included."""
    runs = F.regexp_extract_all(c, F.lit(rf"{LETTER_DOTS}|(?s:(?!{LETTER_DOTS}).)+"), F.lit(0))
    joined = F.array_join(F.transform(runs, lambda x: F.when(x.rlike(rf"^{LETTER_DOTS}$"), F.replace(x, F.lit("."), F.lit(""))).otherwise(x)), "")
    return F.when(c.rlike(LETTER_DOTS), joined).otherwise(c)


def dash_ranges(c: Column) -> Column:
    return F.regexp_replace(c, NUMBER_RANGE, "$1 to $2")


def expand_identifier_underscores(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=[A-Za-z0-9])_(?=[A-Za-z0-9])", " underscore ")


def dedupe_trailing_punct(c: Column, keep: str = ".") -> Column:
    """A run of one mark at the end, spaces between them or not, becomes one mark; different marks stay. Marks in keep don't count."""
    tail = F.regexp_extract(c, r"(?U)\W+$", 0)
    marks = F.translate(F.regexp_replace(tail, r"(?U)\s", ""), keep, "")
    return F.when(marks.rlike(r"(?s)^(.)\1+$"), F.concat(F.left(c, F.length(c) - F.length(tail)), F.left(marks, F.lit(1)))).otherwise(c)


#: Fixed value: marks after which a list's asterisk needs no comma.
BEFORE_BULLET = ",.;:!?。，；：！？…"
#: Asterisks that are no list's and what stays of them, in order: bold, italic, empty arguments, marks of choice, wildcards.
ASTERISKS = (
    (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\(\s*\*\s*\)", "()"), (r"([А-ЯЁа-яё])\)\s*\*(?=\s)", "$1)"), (r"(?<=[A-Za-z0-9])\*(?=[),.\s;]|$)", ""),
)


def strip_markdown_asterisks(c: Column) -> Column:
    """Asterisks of lists become commas, none at the start and after a mark; emphasis and wildcards lose theirs."""
    out = F.regexp_replace(c, r"^\s*\*\s+(?=\p{L})", "")
    out = F.regexp_replace(out, rf"([{BEFORE_BULLET}])\s*\*\s+(?=\p{{L}})", "$1 ")
    out = F.regexp_replace(out, r"(\S)\s+\*\s+(?=\p{L})", "$1, ")
    for pattern, stays in ASTERISKS:
        out = F.regexp_replace(out, pattern, stays)
    return out


def clause_breaks(c: Column) -> Column:
    """Line ends become punctuation: nothing after a sentence end, a comma after a word, a full stop for a paragraph (a wide one after a Chinese character)."""
    out = F.regexp_replace(c, r"([.!?。！？])\s*\n+\s*", "$1 ")
    out = F.regexp_replace(out, r"(?<=[\x{4E00}-\x{9FFF}])\s*\n\s*\n\s*", "。")
    out = F.regexp_replace(out, r"(?<=[\p{L}\p{N}])\s*\n\s*\n\s*", ". ")
    return F.regexp_replace(out, r"(?<=[\p{L}\p{N}])\s*\n\s*", ", ")


def brackets_to_pauses(c: Column) -> Column:
    """Text in brackets stands between commas; brackets without text go."""
    out = F.regexp_replace(c, r"[(（\[【]\s*[)）\]】]", "")
    out = F.regexp_replace(out, r"\s*[(（\[【]\s*([^()（）\[\]【】]*?)\s*[)）\]】](?=\s*[,.;:!?，。；：！？]|\s*$)", ", $1")
    return F.regexp_replace(out, r"\s*[(（\[【]\s*([^()（）\[\]【】]*?)\s*[)）\]】]\s*", ", $1, ")


def expand_abbreviations(c: Column, table: dict[str, str]) -> Column:
    """Whole phrases by their expansion, longest first, a capital at the start kept."""
    out = c
    for short, full in sorted(table.items(), key=lambda x: (-len(x[0]), x[0])):
        quoted = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in short)
        out = F.regexp_replace(out, rf"(?<!\w){quoted[:1].upper()}{quoted[1:]}(?!\w)", full[:1].upper() + full[1:])
        out = F.regexp_replace(out, rf"(?<!\w){quoted}(?!\w)", full)
    return out


def acronym_segments(c: Column) -> Column:
    """Runs of capitals and other runs in order, as (text, acronym)."""
    runs = F.regexp_extract_all(c, F.lit(r"\b[A-Z]{2,}\b|(?:(?!\b[A-Z]{2,}\b).)+"), F.lit(0))
    return F.transform(runs, lambda x: F.struct(x.alias("text"), x.rlike("^[A-Z]{2,}$").alias("acronym")))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def normalize(df: DataFrame, column: str, stages: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """df with a column rewritten by the stages in order; built-in stages stay one projection."""
    out = F.col(column)
    for stage in stages:
        out = stage(out)
    return df.withColumn(column, out)
