"""Projections, predicates and validation rules as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_key

HAN = "[\\x{4e00}-\\x{9fff}]"
SENTENCE_END = "(?<=[.!?])"


def issues(*named: tuple[Column, str]) -> Column:
    """Names of all conditions that hold, in order; a condition that is null counts as not met."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(name)) for condition, name in named)))


def first_issue(*named: tuple[Column, str]) -> Column:
    """Name of the first condition that holds, else null."""
    return F.coalesce(*(F.when(condition, F.lit(name)) for condition, name in named))


def below(value: Column, limit: float) -> Column:
    """Whether a metric fails its limit; null and NaN fail closed."""
    return value.isNull() | F.isnan(value.cast("double")) | (value < limit)


def sentences(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """One row per sentence: keep, its position and the sentence.

    A split after sentence ends is linear in the text's length; matching sentences would not be.
    """
    parts = F.split(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), SENTENCE_END)
    found = F.filter(parts, lambda x: (F.length(x) > 1) & F.right(x, F.lit(1)).isin(".", "!", "?"))
    return docs.select(*keep, F.posexplode(found).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence"))


def han(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HAN))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]+"))


def speech_seconds(text: Column) -> Column:
    """Estimated length when spoken."""
    return han(text) / 4.5 + words(text) / 2.5


def length_bin(seconds: Column) -> Column:
    return F.when(seconds < 7, "short").when(seconds < 12, "medium").otherwise("long")


def duration_bucket(frames: Column) -> Column:
    known = frames.isNotNull() & ~F.isnan(frames.cast("double"))
    return (
        F.when(~known, "unknown").when(frames <= 2, "1-2").when(frames <= 5, "3-5").when(frames <= 10, "6-10").when(frames <= 20, "11-20").otherwise("21+")
    )


def hash_bucket(group: Column, buckets: int = 1000) -> Column:
    """A number under buckets from the first 32 bits of the group's sha256: the same on any cluster."""
    return F.pmod(F.conv(F.substring(F.sha2(group.cast("string"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def split_of(group: Column, val: int = 20, test: int = 40) -> Column:
    """train, val or test, the same for all rows of a group."""
    bucket = hash_bucket(group)
    return F.when(bucket < val, "val").when(bucket < test, "test").otherwise("train")


def first_by_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key by an order: an aggregation, so a hot key is reduced before the shuffle."""
    others = [c for c in rows.columns if c not in (key, *order)]
    least = rows.groupBy(key).agg(F.min(F.struct(*order, *others)).alias("s"))
    return least.select(key, "s.*")


def eligibility(text: Column, ids: Column, unknown: int) -> Column:
    """The first reason for which a text can't be spoken as it is, null if there is none.

    ids are its token numbers, `unknown` the one of what the inventory lacks. Text without Han characters or Latin
    words is English that is too short. The bounds are fixed values.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    chinese, english = han(t), words(t)
    letters = F.length(F.array_join(F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0)), ""))
    # an array of one array, so that ids are made once
    bad_ids = F.get(F.transform(F.array(ids), lambda x: ~F.coalesce(F.size(x), F.lit(0)).between(18, 340) | F.coalesce(F.array_contains(x, unknown), F.lit(True))), F.lit(0))
    only_han, mixed = (chinese > 0) & (english == 0), (chinese > 0) & (english > 0)
    return first_issue(
        ((t == "") | t.rlike(r"[|\n]"), "format"),
        (t.rlike(r"https?://|www\.|@|[<>\[\]{}]"), "nonspoken_markup"),
        (~t.rlike("[。！？.!?][”\"’']?$"), "unfinished_punctuation"),
        (bad_ids, "token_length_or_unknown"),
        (text_key(t).rlike(r"(.{4,12})\1\1"), "repetition"),
        (F.regexp_count(t, F.lit("[呃嗯]")) > 2, "disfluency"),
        (only_han & ~chinese.between(12, 95), "zh_length"),
        ((chinese == 0) & ~english.between(8, 55), "en_length"),
        (mixed & ~(chinese.between(5, 90) & (english <= 45) & (letters >= 3)), "mixed_content"),
        (~speech_seconds(t).between(3, 22), "estimated_length"),
    )
