"""License scans by diagonal voting, with DataFrame functions only.

Every pair of consecutive words of every text (a rolling k-gram, k = 2, so that two-word phrases
have one) is joined by its hash, and then by its words, to the places it has in the templates. A hit votes for
the diagonal "place in the text minus place in the template": a whole copy puts all its votes on one.
Neighbouring diagonals merge to islands, so that a word put in or left out doesn't split a copy in two.
Every span of few enough words inside an island is verified: one whose votes cover enough of the template
is a copy, whatever else the island holds.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: The phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Wordings of notices and grants, and the labels that this method gives.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-notice",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
    " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
    " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
    " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of"
    " merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any"
    " claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software"
    " or the use or other dealings in the software": "mit-text",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain"
    " a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software"
    " distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see"
    " the license for the specific language governing permissions and limitations under the license": "apache-2.0-header",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by"
    " the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope"
    " that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
    " see the gnu general public license for more details": "gpl-3.0-or-later-header",
}
#: The least share of a template's word pairs, the furthest that merged diagonals lie apart, the longest span (in pairs of the template).
COVERAGE = 0.8
MERGE = 2
LONGEST = 1.5
UNIT = 1 << 20
#: Places of a template in one number.
BITS = 62
#: Fixed value: what stands between words once A-Z are lower-case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def seeds(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """One row for every word pair of every phrase and template; a pair of empty words stands for "a document"."""
    rows = [("", "", 0, 0, "", False)]
    for kind, group in ((True, phrases), (False, templates)):
        for text, label in group.items():
            own = text.split()
            if len(own) < 2:
                raise ValueError("a phrase or template has two words at least")
            rows += [(a, b, i, len(own) - 1, label, kind) for i, (a, b) in enumerate(zip(own, own[1:], strict=False))]
    return spark.createDataFrame(rows, "a string, b string, at int, pairs int, label string, phrase boolean")


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base, first_word, last_word and base_labels speak of whole, unbroken phrases; labels adds the
    templates'. score is the largest share of a template or phrase that a span covers, 1 for an
    unbroken one and 0 without a hit. Null and empty texts have no words. A row's key is its id with
    its text, null ids included; equal rows come out as often as they came in. Other columns of docs are
    not read.
    """
    spark = docs.sparkSession
    pair = F.struct(F.lit("").alias("a"), F.lit("").alias("b"))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), words(F.col(text_col)).alias("w"))
    pairs = F.arrays_zip(
        F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b")
    )
    rolled = own.select("id", "key", F.size("w").cast("bigint").alias("n_words"), F.posexplode(F.concat(F.array(pair), pairs)).alias("p", "g"))
    rolled = rolled.select("id", "key", "n_words", (F.col("p") - 1).alias("p"), F.col("g.a").alias("ga"), F.col("g.b").alias("gb"))
    rolled = rolled.withColumn("h", F.xxhash64("ga", "gb"))
    table = seeds(spark, phrases, templates).withColumn("h", F.xxhash64("a", "b"))
    hits = rolled.join(F.broadcast(table), "h").where("ga = a and gb = b")  # the templates above: some dozens of rows

    # one row for a vote, however often the row of docs repeats; ("", "", 0) votes for the document itself
    votes = hits.groupBy("id", "key", "n_words", "label", "phrase", "pairs", "p", "at").agg(F.count("*").alias("rows"))
    votes = votes.withColumn("diagonal", F.col("p") - F.col("at"))
    sorted_ = Window.partitionBy("id", "key", "label", "phrase").orderBy("diagonal", "p")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(sorted_) > MERGE, F.lit(True))
    votes = votes.withColumn("far", far.cast("int"))
    votes = votes.withColumn("island", F.when(F.col("phrase"), F.col("diagonal")).otherwise(F.sum("far").over(sorted_)))
    # a span begins at a vote and has room for LONGEST times the template's pairs: with that room as UNIT it is shorter than UNIT
    room = F.greatest(F.ceil(F.col("pairs") * LONGEST), F.lit(1))
    longest = max(math.ceil((len(text.split()) - 1) * LONGEST) for text in (*phrases, *templates))
    span = Window.partitionBy("id", "key", "label", "phrase", "island").orderBy("place").rangeBetween(0, UNIT - UNIT // (2 * longest))
    spans = votes.withColumn("place", F.floor(F.col("p").cast("bigint") * UNIT / room))
    # the places of a template that a span votes for, BITS of them in a number
    parts = [F.bit_or(F.when(F.floor(F.col("at") / BITS) == i, F.expr(f"shiftleft(1L, at % {BITS})")).otherwise(F.lit(0).cast("bigint"))).over(span) for i in range(-(-longest // BITS))]
    spans = spans.withColumn("cover", reduce(add, (F.bit_count(x) for x in parts)))
    share = F.try_divide(F.col("cover"), F.col("pairs"))
    whole = F.col("phrase") & (F.col("at") == 0) & (F.col("cover") == F.col("pairs")) & (F.col("pairs") > 0)
    taken = ~F.col("phrase") & (F.col("pairs") > 0) & (share >= COVERAGE)
    found = spans.groupBy("id", "key", "n_words").agg(
        F.max(F.when(F.col("pairs") == 0, F.col("rows"))).alias("copies"),
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("p").cast("bigint"))).alias("first_word"),
        F.max(F.when(whole, F.col("p").cast("bigint"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole | taken, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("pairs") > 0, share)), F.lit(0.0)).alias("score"),
    )
    once = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return once.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
