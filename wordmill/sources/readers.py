"""Readers and writers of manifests, dictionaries, spans and reports; bad rows keep their reason."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import wave_facts


def manifest(lines: DataFrame, speakers: bool) -> DataFrame:
    """(wav, spk, start, end, text, error) of lines (value) wav|text up to wav|spk|start|end|text.

    The number of fields says which are there; bounds come in pairs, start is not negative and end is
    past it. A bad line has its error and null fields.
    """
    parts = F.split("value", r"\|")
    n, lead = F.size(parts), 1 if speakers else 0
    timed = n == 4 + lead
    at = [F.trim(F.get(parts, F.lit(i))) for i in range(5)]
    spk = at[1].try_cast("int") if speakers else F.lit(None).cast("int")
    start, end = (F.when(timed, at[1 + lead + i].try_cast("double")) for i in range(2))
    text = F.trim(F.element_at(parts, -1))
    error = (
        F.when(~n.isin(2 + lead, 4 + lead), "fields")
        .when(F.lit(speakers) & spk.isNull(), "speaker")
        .when(timed & (start.isNull() | end.isNull()), "bounds")
        .when(start < 0, "start")
        .when(end <= start, "end")
        .when(text == "", "text")
    )
    ok = error.isNull()
    return lines.select(
        *(F.when(ok, c).alias(name) for name, c in (("wav", at[0]), ("spk", spk), ("start", start), ("end", end), ("text", text))), error.alias("error")
    )


def real_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) of a text file's lines without blank ones and comments."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(~F.col("value").rlike(r"^\s*(#|$)"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1; a window holds the lines of one block of a file at most."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seen"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("seen"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n")).withColumn("before", earlier)
    return rows.withColumn("inside", inside).join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("inside")).alias("line"), "value")


def file_list(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(file, line, wav, spk, tail, error) of wav|speaker|tail lines; blank lines and comments go.

    tail is all that follows the speaker, with its bars. A bad line keeps its number and value as tail
    and has its error: fields or speaker; fork() parts them off. strict raises at the first of them.
    """
    rows = numbered_lines(spark, path).withColumn("value", F.trim("value")).where(~F.col("value").rlike(r"^(#|$)"))
    parts = F.split("value", r"\|", 3)
    spk = F.trim(F.get(parts, F.lit(1))).try_cast("int")
    error = F.when(F.size(parts) < 3, "fields").when(spk.isNull(), "speaker")
    out = rows.select(
        "file", "line", F.when(error.isNull(), F.get(parts, F.lit(0))).alias("wav"), F.when(error.isNull(), spk).alias("spk"),
        F.when(error.isNull(), F.get(parts, F.lit(2))).otherwise(F.col("value")).alias("tail"), error.alias("error"),
    )
    if strict:
        bad = out.where("error is not null").orderBy("file", "line").first()
        if bad:
            raise ValueError(f"{bad['file']}:{bad['line']}: {bad['error']}")
    return out


#: Columns of a chunk plan in their order; the last one may be absent.
PLAN = ("synth_line", "orig_line", "chunk_idx", "n_chunks", "n_tokens", "had_hard_split", "text", "orig_text")


def chunk_plan(spark: SparkSession, path: str) -> DataFrame:
    """The columns of PLAN, file and error of tab-separated chunk plans with a header; files without orig_text have it null.

    Tabs in the last column belong to it. Rows with too few fields or bad numbers have an error and null fields.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    heads = lines.where(F.col("value").startswith("synth_line\t")).select("file", F.col("value").endswith("\torig_text").alias("full")).distinct()
    rows = lines.where(~F.col("value").startswith("synth_line\t")).join(heads, "file")
    parts = F.when(F.col("full"), F.split("value", "\t", 8)).otherwise(F.split("value", "\t", 7))
    fields = [F.get(parts, F.lit(i)) for i in range(8)]
    numbers = [f.try_cast("bigint") for f in fields[:6]]
    short = F.size(parts) < F.when(F.col("full"), 8).otherwise(7)
    error = F.when(short, "fields").when(F.greatest(*(n.isNull() for n in numbers)), "number")
    typed = [*numbers[:5], numbers[5] != 0, fields[6], F.nullif(fields[7], F.lit(""))]
    return rows.select(*(F.when(error.isNull(), c).alias(n) for n, c in zip(PLAN, typed, strict=True)), "file", error.alias("error"))


def write_chunk_plan(rows: DataFrame, path: str) -> None:
    """rows with the columns of PLAN as chunk_plan() reads them; tabs and line ends inside texts become spaces."""
    cells = [F.col(c).cast("int").cast("string") if c == "had_hard_split" else F.col(c).cast("string") for c in PLAN]
    plain = [F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]", " ").alias(n) for c, n in zip(cells, PLAN, strict=True)]
    options = {"sep": "\t", "header": True, "quote": "\u0000", "escape": "\u0000", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.select(*plain).write.mode("overwrite").options(**options).csv(path)


def text_manifest(lines: DataFrame, default_speaker: int) -> DataFrame:
    """(spk, text) of lines whose leading fields may be a path, numbers and a speaker; the last field is the text."""
    parts = F.split("value", r"\|")
    heads = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    whole = F.filter(heads, lambda x: x.rlike(r"^\s*\d+\s*$"))
    return lines.select(F.coalesce(F.get(whole, F.lit(0)).try_cast("int"), F.lit(default_speaker)).alias("spk"), F.element_at(parts, -1).alias("text"))


def tabular(spark: SparkSession, path: str) -> DataFrame:
    """A table whose form its first line shows: JSON lines, tabs, pipes or commas; all columns are text."""
    first = spark.read.text(path).first()
    head = first["value"] if first else ""
    if head.lstrip().startswith("{"):
        return spark.read.option("primitivesAsString", True).json(path)
    mark = max("\t|,", key=head.count)
    return spark.read.option("header", True).option("sep", mark).csv(path)


def first_present(columns: Sequence[str], names: Sequence[str]) -> Column:
    """The first of the aliases that is there and not blank."""
    found = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


ENCODED = "phonemes string, token_ids array<int>, tone_ids array<int>, spk int, _bad string"


def encoded(spark: SparkSession, path: str, tokens: int, tones: int, speakers: Sequence[int]) -> DataFrame:
    """JSON lines of encoded utterances with error: what the first broken rule is, null if none."""
    rows = spark.read.schema(ENCODED).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    ids, tone = F.col("token_ids"), F.col("tone_ids")
    error = (
        F.when(F.col("_bad").isNotNull(), "json")
        .when(F.coalesce(F.size(ids), F.lit(0)) <= 0, "empty")
        .when(F.coalesce(F.exists(ids, lambda x: ~x.between(0, tokens - 1)), F.lit(True)), "token")
        .when(tone.isNotNull() & (F.size(tone) != F.size(ids)), "length")
        .when(tone.isNotNull() & F.exists(tone, lambda x: ~x.between(0, tones - 1)), "tone")
        .when(F.col("spk").isNotNull() & ~F.col("spk").isin(*speakers), "speaker")
    )
    return rows.withColumn("error", error).drop("_bad")


def two_line_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, text, phones) of files with "id<tab>text" lines, each followed by a line of phones; without one, null.

    A record's lines meet by their numbers, so a file may be read in any number of blocks, and a record may lie across two of them.
    """
    lines = numbered_lines(spark, path)
    heads = lines.where(F.col("value").rlike(r"^\d"))
    next_line = lines.where(~F.col("value").rlike(r"^\d+\t|^\s*$")).select("file", (F.col("line") - 1).alias("line"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("phones"))
    parts = F.split("value", "\t", 2)
    return heads.join(next_line, ["file", "line"], "left").select("file", F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("text"), "phones")


INTERVAL = r'xmin\s*=\s*([\d.]+)\s*xmax\s*=\s*([\d.]+)\s*text\s*=\s*"([^"]*)"'


def alignment_intervals(spark: SparkSession, path: str, tier: str = "phones") -> DataFrame:
    """(file, pos, label, start, end) of one tier of alignment files; silences are left out. One job for a directory."""
    body = F.regexp_extract("value", rf'(?s)name\s*=\s*"{tier}"(.*?)(?:item\s*\[|$)', 1)
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), body.alias("b"))
    rows = whole.select("file", F.posexplode(F.regexp_extract_all("b", F.lit(INTERVAL), F.lit(0))).alias("pos", "x"))
    cut = rows.select("file", "pos", F.regexp_extract("x", INTERVAL, 3).alias("label"), *(F.regexp_extract("x", INTERVAL, i).cast("double").alias(n) for i, n in ((1, "start"), (2, "end"))))
    return cut.where(~F.col("label").isin("", "sil", "sp", "spn"))


def spans(rows: DataFrame, rate: int, hop: int) -> DataFrame:
    """Spans (utt, start, end in frames) from whichever of frames, seconds and milliseconds a row has; empty ones go."""
    def bound(side: str) -> Column:
        per = rate / hop
        return F.coalesce(F.col(f"{side}_frame").cast("bigint"), F.round(F.col(f"{side}_sec") * per).cast("bigint"), F.round(F.col(f"{side}_ms") * per / 1000).cast("bigint"))

    return rows.select("utt", bound("start").alias("start"), bound("end").alias("end")).where(F.col("end") > F.col("start"))


def pronouncing_dictionary(lines: DataFrame) -> DataFrame:
    """(word, variant, phones) of dictionary lines: comments go, WORD(2) is variant 2, gaps between variants stay."""
    rows = lines.where(~F.col("value").rlike(r"^\s*(;;;|$)"))
    parts = F.split(F.trim("value"), r"\t|\s{2,}", 2)
    head = F.get(parts, F.lit(0))
    variant = F.coalesce(F.nullif(F.regexp_extract(head, r"\((\d+)\)$", 1), F.lit("")).cast("int"), F.lit(0))
    return rows.select(F.upper(F.regexp_replace(head, r"\(\d+\)$", "")).alias("word"), variant.alias("variant"), F.split(F.trim(F.get(parts, F.lit(1))), r"\s+").alias("phones"))


WAVE = "path string, rate bigint, channels bigint, bits bigint, frames bigint, error string"


def wave_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, bits, frames, error) of RIFF files in a directory that any store of Spark's holds.

    The files come whole, a batch at a time, and Spark leaves out those without a byte; where the store is one
    that the `file_facts` source opens itself, that reads the headers' ranges alone and has a row for every file.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, *wave_facts(lambda at, size, data=data: data[at : at + size], len(data))) for name, data in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "bits", "frames", "error"]).astype({c: "Int64" for c in ("rate", "channels", "bits", "frames")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, WAVE)


def content_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files in a directory."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def stat_table(spark: SparkSession, path: str, numbers: Sequence[str], token: str = "token", least: int = 0) -> DataFrame:
    """token and numbers of a tab-separated table of statistics with a header, with error: what a row lacks, null if nothing.

    A column that the header lacks is an error before any row is read; blank and unreadable numbers are null. Rows of
    fewer than `least` in the first of numbers have the error few.
    """
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    missing = [c for c in (token, *numbers) if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    typed = rows.select(F.nullif(F.trim(token), F.lit("")).alias(token), *(F.trim(F.col(c)).try_cast("double").alias(c) for c in numbers))
    lacking = F.coalesce(*(F.when(F.col(c).isNull(), c) for c in numbers))
    return typed.withColumn("error", F.when(F.col(token).isNull(), token).when(lacking.isNotNull(), lacking).when(F.col(numbers[0]) < least, "few"))


def fork(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected rows with reason) of one plan."""
    named = rows.withColumn("reason", reason)
    return named.where("reason is null").drop("reason"), named.where("reason is not null")


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """One folder of JSON lines per split; the committer makes it appear whole."""
    rows.write.partitionBy(split).mode("overwrite").json(path)


def write_split_lists(rows: DataFrame, path: str, columns: Sequence[str], split: str = "split") -> None:
    """One folder of text lines per split, the columns joined by bars; line ends and bars inside become spaces."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\r\n]", " ") for c in columns]
    rows.select(split, F.concat_ws("|", *cells).alias("value")).write.partitionBy(split).mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str, decimals: int = 6) -> None:
    """Tab-separated with a header; numbers rounded, null and NaN blank."""
    cells = [F.when(~F.isnan(F.col(c)), F.round(F.col(c), decimals)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*cells).write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "").csv(path)
