"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Rules decide what they fit. URLs that a rule decides are the labelled ones: trees are fitted on a
bounded sample of them and judge all others, from length, depth, digits, entropy, parameters and
from statistics of host suffixes over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_type, written

#: Verdict, host and path of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Labelled URLs that the trees are fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 60, 3, 32, 0.15, 10
THRESHOLD = 0.5
#: Weight of the overall share of blocked URLs in a suffix's share.
PRIOR = 10.0
#: Suffix rows that may be broadcast; with more, they are joined by a salted key.
BROADCAST_ROWS = 50_000
SALTS = 16
#: A labelled row's suffix shares come from the hosts of the other folds, so its own label is not in them.
FOLDS = 4
FEATURES = (
    "url length", "host length", "path length", "query length", "depth", "host labels", "digit ratio", "path digits", "entropy", "host entropy",
    "parameters", "dashes", "fragment", "secure", "html", "short segment", "tail pages", "tail blocked", "top pages", "top blocked",
)


def host(url: Column) -> Column:
    """What stands after the first :// up to /, ? or #, A-Z lower-cased; empty for a null url or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What stands after the host up to ? or #; empty for a null url or without ://."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does. Of equally long ones the first by text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8))
    share = counts[counts > 0] / counts.sum()
    return float(-(share * np.log2(share)).sum())


def features(urls: list[str | None], hosts: list[str], paths: list[str], suffix: np.ndarray) -> np.ndarray:
    """Lexical features of every URL, followed by the statistics of its host's suffixes."""
    rows = []
    for url, h, p in zip(urls, hosts, paths, strict=True):
        url = url or ""
        query = url.partition("?")[2].partition("#")[0]
        parts = [x for x in p.split("/") if x]
        digits = sum(map(url.count, "0123456789"))
        rows.append((
            len(url), len(h), len(p), len(query), len(parts), h.count(".") + 1, digits / max(len(url), 1), sum(map(p.count, "0123456789")),
            _entropy(url), _entropy(h), query.count("=") + query.count("&"), url.count("-"), float("#" in url), float(url.startswith("https")),
            float(p.endswith(".html")), min(map(len, parts), default=0),
        ))
    return np.concatenate([np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES) - 4), suffix], axis=1)


@dataclass
class Trees:
    """Complete binary trees: feature and limit of every inner node, value of every leaf."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss over binned features; without both classes, a constant."""
    share = float(y.mean()) if len(y) else 0.0
    base = float(np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if share in (0.0, 1.0):
        return none
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total = np.full(len(y), base)
    forest = []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = chance - y, chance * (1 - chance)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for at in range(inner):
            own = np.flatnonzero(node == at)
            best, g, h = (1e-6, 0, np.inf), slope[own].sum(), bend[own].sum()
            if len(own) >= 2 * LEAST_ROWS:
                for f in range(x.shape[1]):
                    size = len(edges[f]) + 1
                    left_g = np.cumsum(np.bincount(binned[own, f], slope[own], size))[:-1]
                    left_h = np.cumsum(np.bincount(binned[own, f], bend[own], size))[:-1]
                    left_n = np.cumsum(np.bincount(binned[own, f], minlength=size))[:-1]
                    gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                    gain[(left_n < LEAST_ROWS) | (len(own) - left_n < LEAST_ROWS)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = float(gain.max()), f, float(edges[f][gain.argmax()])
            feature[at], limit[at] = best[1], best[2]
            node[own] = 2 * at + 1 + (x[own, feature[at]] > limit[at])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, bend, leaves) + 1)
        total += value[leaf]
        forest.append((feature, limit, value))
    return Trees(base, *(np.stack(part) for part in zip(*forest, strict=True)))


def _with_suffixes(pages: DataFrame) -> DataFrame:
    """pages with tail (last two labels of the host), top (last label) and statistics of both over all rows."""
    named = pages.withColumn("tail", F.substring_index("host", ".", -2)).withColumn("top", F.substring_index("host", ".", -1))
    blocked, known = F.col("verdict") == "block", F.col("verdict").isNotNull()
    named = named.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    overall = named.agg(F.avg(F.when(known, blocked.cast("double")))).first()[0] or 0.0
    out = named
    for level in ("tail", "top"):
        counts = named.groupBy(F.col(level).alias("s")).agg(
            F.count("*").alias(f"{level}_pages"),
            F.array(*(F.count_if(known & (F.col("fold") == k)) for k in range(FOLDS))).alias(f"{level}_known"),
            F.array(*(F.count_if(blocked & (F.col("fold") == k)) for k in range(FOLDS))).alias(f"{level}_blocked"),
        )
        counts = written(counts, "url-suffixes")
        if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            out = out.join(F.broadcast(counts), F.col(level) == F.col("s"), "left").drop("s")
        else:
            salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            out = out.withColumn("own", F.pmod(F.xxhash64("url", "id"), F.lit(SALTS)).cast("int"))
            out = out.join(salted, (F.col(level) == F.col("s")) & (F.col("own") == F.col("salt")), "left").drop("s", "own", "salt")
    for level in ("tail", "top"):
        seen, bad = (
            F.aggregate(f"{level}_{part}", F.lit(0).cast("bigint"), lambda total, x: total + x) - F.when(known, F.get(f"{level}_{part}", F.col("fold"))).otherwise(0)
            for part in ("known", "blocked")
        )
        out = out.withColumn(f"{level}_share", (bad + F.lit(PRIOR * overall)) / (seen + F.lit(PRIOR))).withColumn(f"{level}_size", F.log1p(f"{level}_pages"))
    return out


#: Statistics of suffixes that follow the lexical features.
SUFFIX_COLUMNS = ["tail_size", "tail_share", "top_size", "top_share"]


def fit(table: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most so many rows with a verdict (url, host, path, verdict, suffix statistics), by the hash of the url.

    Features alone come to the driver, len(FEATURES) numbers for a row, whatever the urls' lengths.
    """

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = features(batch["url"].tolist(), batch["host"].tolist(), batch["path"].tolist(), batch[SUFFIX_COLUMNS].to_numpy(float))
            yield pd.DataFrame({"h": batch["h"], "y": batch["y"], "x": list(x)})

    own = table.where("verdict is not null").select("url", "host", "path", *SUFFIX_COLUMNS, F.xxhash64("url").alias("h"), (F.col("verdict") == "block").cast("int").alias("y"))
    rows = own.orderBy("h", "url").limit(sample).mapInPandas(measured, "h bigint, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["h"], r["y"], r["x"]))
    return train(np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], dtype=float))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, score) for every row of pages.

    rule and its verdict come from the longest rule that fits; elsewhere rule is null and the trees
    decide (block from THRESHOLD of score on). Null and odd URLs have empty parts and are judged like
    any other, very long ones whole. Of equally long rules that fit, the first by text decides. Without labelled
    URLs of both kinds the trees give the overall share. Repeated rows are judged each; other columns are
    not read.
    """
    kind = id_type(pages, id_col)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    base = base.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    base = base.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", "fit.rule", "fit.verdict")
    table = written(_with_suffixes(base).select("id", "url", "host", "path", "rule", "verdict", *SUFFIX_COLUMNS), "url-features")
    model = fit(table, sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = features(batch["url"].tolist(), batch["host"].tolist(), batch["path"].tolist(), batch[SUFFIX_COLUMNS].to_numpy(float))
            score = model.score(rows)
            guess = pd.Series(np.where(score >= THRESHOLD, "block", "allow"), index=batch.index)
            yield batch[["id", "host", "path", "rule"]].assign(verdict=batch["verdict"].where(batch["verdict"].notna(), guess), score=score)

    out = table.mapInPandas(run, f"id {kind}, host string, path string, rule string, verdict string, score double")
    return out.withColumnRenamed("id", id_col)
