"""Array, vector, hash, JSON and time functions as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def prepend_if_absent(tokens: Column, marker: str) -> Column:
    return F.when(F.coalesce(F.get(tokens, F.lit(0)) == marker, F.lit(False)), tokens).otherwise(F.concat(F.array(F.lit(marker)), tokens))


def intersperse(tokens: Column, blank: str) -> Column:
    """n tokens become 2n + 1, the blank around each."""
    return F.concat(F.array(F.lit(blank)), F.flatten(F.transform(tokens, lambda x: F.array(x, F.lit(blank)))))


def run_lengths(tokens: Column, durations: Column) -> Column:
    """Each token repeated by its duration."""
    return F.flatten(F.zip_with(tokens, durations, lambda t, n: F.array_repeat(t, n.cast("int"))))


def grams(text: Column, n: int) -> Column:
    """Distinct n-grams of characters in order of their first place."""
    letters = F.split(text, "")
    every = letters
    for k in range(1, n):  # a letter with the next n - 1: null where the text ends before
        every = F.zip_with(every, F.slice(letters, k + 1, F.greatest(F.length(text), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.when(F.length(text) >= n, F.array_distinct(F.filter(every, lambda x: x.isNotNull()))).otherwise(F.array().cast("array<string>"))


def count_grams(text: Column, n: int) -> Column:
    """The number of distinct n-grams of characters, as grams() lists them; null for a null text."""
    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        found = [None if t is None else len({t[i : i + n] for i in range(len(t) - n + 1)}) for t in texts]
        return pd.Series(found, dtype="Int64")

    return count(text)


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of different lengths are an error."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors of different lengths")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def rms(a: Column) -> Column:
    return norm(a) / F.sqrt(F.size(a))


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def share_above(a: Column, limit: Column) -> Column:
    return F.size(F.filter(a, lambda x: F.abs(x) > limit)) / F.size(a)


def frames(value: Column, unit: Column, rate: int = 24_000, hop: int = 384) -> Column:
    """Frames from frames, seconds or milliseconds; halves go to the even side."""
    seconds = F.when(unit == "sec", value).when(unit == "ms", value / 1000)
    return F.coalesce(F.bround(seconds * rate / hop), F.when(unit == "frame", value)).cast("bigint")


def negative_id(text: Column) -> Column:
    """A negative 60-bit id from a text's sha256: never meets a positive id."""
    return -F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def anomaly(z: Column, ratio: Column) -> tuple[Column, Column]:
    """(score, flags): the larger of the acoustic score and the log ratio's size, and what is out of bounds."""
    away = F.abs(F.log(F.greatest(ratio, F.lit(1e-8))))
    flags = F.concat_ws(";", F.array_compact(F.array(F.when(z > 2, F.lit("acoustic")), F.when(ratio < 0.5, F.lit("short")), F.when(ratio > 2, F.lit("long")))))
    return F.greatest(z, away), flags


def language_runs(text: Column) -> Column:
    """(text, lang) of runs of Latin letters and of everything else, in order."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.transform(runs, lambda x: F.struct(x.alias("text"), F.when(x.rlike("^[A-Za-z]"), "en").otherwise("other").alias("lang")))


def phone_units(text: Column) -> Column:
    """"A B / C / ." as units, closing marks apart."""
    return F.filter(F.split(F.regexp_replace(text, r"\s*([.,!?])", " / $1"), r"\s*/\s*"), lambda x: x != "")


def third_tones(syllables: Column) -> Column:
    """A third tone before another becomes a second one; the next syllable is read as it was."""
    def one(x: Column, i: Column) -> Column:
        following = F.coalesce(F.get(syllables, i + 1), F.lit(""))
        return F.when(x.endswith("3") & following.endswith("3"), F.concat(F.regexp_replace(x, "3$", ""), F.lit("2"))).otherwise(x)

    return F.transform(syllables, one)


def tone_backfill(tokens: Column, marks: dict[str, int]) -> tuple[Column, Column]:
    """(tokens, tones): tone marks are taken out and given to the token before them, 0 for none."""
    table = F.create_map(*(x for k, v in marks.items() for x in (F.lit(k), F.lit(v))))
    plain = F.filter(tokens, lambda t: F.try_element_at(table, t).isNull())
    tones = F.filter(
        F.transform(tokens, lambda t, i: F.when(F.try_element_at(table, t).isNull(), F.coalesce(F.try_element_at(table, F.get(tokens, i + 1)), F.lit(0)))), lambda x: x.isNotNull()
    )
    return plain, tones
