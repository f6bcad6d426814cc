"""Mixing sources to target weights by soft membership, with DataFrame and SQL functions only.

1. A classifier learns domains from the labelled table. Its features are character n-grams, picked
   from a bounded sample of labelled texts by how much more often a domain has them than the others;
   multinomial naive Bayes over their counts gives posteriors. One aggregation gives the counts per
   class, a number of classes times features.
2. Every document gets posteriors over the domains and its number of words (tokens).
3. Nonnegative rates per document are fitted by projected gradient on a weighted least squares of
   the expected token totals of the domains against their targets. A step needs the totals alone, so
   it is one aggregation; rates stay a column. Steps end when the totals meet the targets or come
   to rest at bounds, and the gap that is left is reported.
4. A rate becomes whole copies: its integer part, and one more if the document's hash falls under
   the rest. Hashes make this the same for any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Domains and their target shares: four languages in good quality, and everything of low quality.
TARGETS = {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.14, "rough": 0.01}
#: Labelled texts of each domain that n-grams are picked from, at most, and that the classifier is fitted on.
PICKED_FROM, SAMPLE_PER_DOMAIN = 300, 20_000
#: N-grams picked for each domain, and the longest; a space stands for a word's edge.
GRAMS_PER_DOMAIN, LONGEST_GRAM = 6, 4
LARGEST_RATE = 4.0
#: Characters of a word whose n-grams are taken at once.
BLOCK = 64
#: Largest distance of met targets as a share of all tokens; loss after a step, as a share of that before, from which totals rest;
#: share of the goals that is added to the moving documents' matrix; steps tried at most.
MET, RESTS, DAMPING, TRIALS = 1e-6, 0.98, 0.02, 40
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def _count(text: Column, mark: str) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark.encode())


def measured(docs: DataFrame, id_col: str, text_col: str, marks: Sequence[str], whole_row: bool = False) -> DataFrame:
    """(id, key, n_tokens, m): a row's words and mark counts; key is the hash of its text. whole_row adds row, all columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        *([F.struct("*").alias("row")] if whole_row else []),
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_tokens"),
        F.array(*(_count(text, m) for m in marks)).cast("array<double>").alias("m"),
    )


def learned_marks(known: DataFrame, domains: Sequence[str], each: int = GRAMS_PER_DOMAIN, longest: int = LONGEST_GRAM) -> list[str]:
    """N-grams that tell the domains apart, from labelled texts (domain, t): at most `each` for a domain.

    Every text weighs the same. A gram's worth for a domain is its rate there times the log of how far
    that is above the mean rate of the domains; of two grams of which one holds the other, only the better stays.
    Ties go to the gram that sorts first. Without a labelled text there are none.
    """
    words = known.select("domain", F.array_remove(F.split("t", BLANKS), "").alias("w")).where(F.size("w") > 0)
    rows = words.select("domain", F.explode("w").alias("w"), (1 / F.size("w")).alias("weight"))
    counted = rows.groupBy("domain", "w").agg(F.sum("weight").alias("weight"))
    edged = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    # a word of any length is taken block by block: every gram begins in one of its blocks, and in one only
    blocks = counted.select("domain", "weight", F.explode(F.transform(F.sequence(F.lit(1), F.length(edged), F.lit(BLOCK)), lambda i: F.substr(edged, i, F.lit(BLOCK + longest - 1)))).alias("b"))

    def grams_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.least(F.length("b") - (n - 1), F.lit(BLOCK)), F.lit(1)))
        cut = F.transform(starts, lambda i: F.substr("b", i, F.lit(n)))
        return F.filter(cut, lambda x: F.length(x) == n)

    every = F.flatten(F.array(*(grams_of(n) for n in range(1, longest + 1))))
    grams = blocks.select("domain", "weight", F.explode(every).alias("gram")).where("trim(gram) <> ''").groupBy("gram", "domain").agg(F.sum("weight").alias("weight"))
    texts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # one row per domain
    present = [d for d in domains if d in texts]
    if not present:
        return []
    rate = [F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("weight"))), F.lit(0.0)) / texts[d] for d in present]
    rates = grams.groupBy("gram").agg(F.array(*rate).alias("rates"))
    mean = F.aggregate("rates", F.lit(1e-6), lambda total, x: total + x) / len(present)
    worth = rates.select("gram", F.posexplode(F.transform("rates", lambda x: x * F.log((x + 1e-6) / mean))).alias("at", "worth")).where("worth > 0")
    best = Window.partitionBy("at").orderBy(F.desc(F.round("worth", 9)), "gram")
    found = worth.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 20 * each).orderBy("at", "rank").collect()  # 20 times the grams wanted
    out: list[str] = []
    for at in range(len(present)):
        own: list[str] = []
        for r in found:
            if r["at"] == at and len(own) < each and not any(r["gram"] in o or o in r["gram"] for o in own):
                own.append(r["gram"])
        out += [g for g in own if g not in out]
    return out


def classifier(known: DataFrame, domains: Sequence[str], marks: Sequence[str]) -> dict[str, tuple[float, list[float]]]:
    """Log prior and log rates of the marks of each domain, from rows (domain, m)."""
    # marks count by their share of the text's, so that a long text teaches as much as a short one
    total = F.aggregate("m", F.lit(1e-9), lambda a, x: a + x)
    rows = known.groupBy("domain").agg(F.count("*").alias("n"), *(F.sum(F.get("m", F.lit(i)) / total).alias(f"m{i}") for i in range(len(marks))))
    found = {r["domain"]: r for r in rows.collect()}  # one row per domain
    whole = sum(r["n"] for r in found.values()) + len(domains)
    out = {}
    for d in domains:
        counts = [(found[d][f"m{i}"] if d in found else 0.0) + 0.01 for i in range(len(marks))]
        n = found[d]["n"] if d in found else 0
        out[d] = math.log((n + 1) / whole), [math.log(c / sum(counts)) for c in counts]
    return out


def posteriors(rows: DataFrame, model: Mapping[str, tuple[float, list[float]]]) -> DataFrame:
    """rows with p: an array of the domains' posteriors, which add up to one.

    Marks of one text are far from independent, so the evidence counts by the root of their number
    in place of the number: that keeps memberships soft.
    """
    logs = [F.lit(float(prior)) + sum((F.get("m", F.lit(i)) * w for i, w in enumerate(weights)), F.lit(0.0)) / F.col("root") for prior, weights in model.values()]
    rows = _once(rows, "m", F.col("m"))
    rows = _once(rows, "root", F.sqrt(F.greatest(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), F.lit(1.0))))
    rows = _once(rows, "l", F.array(*logs))
    l = [F.get("l", F.lit(i)) for i in range(len(model))]
    p = [1 / sum((F.exp(F.least(other - own, F.lit(700.0))) for other in l), F.lit(0.0)) for own in l]
    return _once(rows, "p", F.array(*p)).drop("root", "l", "m")


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once for a row, however often later columns name it."""
    return rows.select(*(c for c in rows.columns if c != name), F.explode(F.array(value)).alias(name))


@dataclass
class Fit:
    """Steps of the rates, and the expected token totals of the domains against their targets."""

    steps: list[list[float]] = field(default_factory=list)
    trials: int = 0
    totals: list[float] = field(default_factory=list)
    goals: list[float] = field(default_factory=list)

    @property
    def gap(self) -> float:
        """The largest distance of a total from its target, as a share of all tokens."""
        return max((abs(t - g) for t, g in zip(self.totals, self.goals, strict=True)), default=0.0) / max(sum(self.goals), 1.0)


def fitted_rates(rows: DataFrame, targets: Sequence[float], largest: float = LARGEST_RATE, trials: int = TRIALS) -> Fit:
    """Steps to the rates by projected gradient over rows (n_tokens, p).

    With r the rates, n the tokens and P the posteriors, the loss is half the sum over domains of
    (total - goal)^2 / goal, the totals being P'nr. In the metric that counts a document by its tokens the
    gradient is P (total - goal) / goal, and a step of one over the largest curvature never overshoots. A
    longer step is tried first: the one that would meet the goals if no document that moves met a bound,
    damped so that a domain of hardly any tokens can't move all others. A trial is one aggregation, of
    totals and of the moving documents' matrix P'nP. The goals add up to the tokens there are. rated()
    turns steps into a column.

    Where bounds keep a target out of reach the totals come to rest: steps end once neither kind lowers the
    loss to RESTS of what it was, or after so many trials. gap then says how far from the targets they are.
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    p = [F.get("p", F.lit(i)) for i in range(k)]

    def sums(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rate = F.col("rate")
        moves = F.when((rate > 0) & (rate < largest), F.col("n_tokens")).otherwise(0.0)
        got = rated(rows, steps, largest).agg(*(F.sum(F.col("n_tokens") * rate * x) for x in p), *(F.sum(moves * p[i] * p[j]) for i, j in pairs)).first()
        matrix = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k:], strict=True):
            matrix[i, j] = matrix[j, i] = float(x or 0.0)
        return np.array([float(x or 0.0) for x in got[:k]]), matrix

    now, moving = sums([])
    whole = float(now.sum())
    fit = Fit(totals=now.tolist(), goals=[t * whole / sum(targets) for t in targets])
    weight = np.array([1 / g if g > 0 else 0.0 for g in fit.goals])
    curvature = max(float(np.linalg.eigvalsh(np.sqrt(weight)[:, None] * moving * np.sqrt(weight)).max()), 1e-12)
    goal = np.array(fit.goals)
    while fit.gap > MET and fit.trials < trials:
        off = np.array(fit.totals) - goal
        loss = off @ (weight * off)
        for step in (np.linalg.pinv(moving + DAMPING * np.diag(goal), hermitian=True) @ off, weight * off / curvature):
            fit.trials += 1
            now, moving = sums([*fit.steps, step.tolist()])
            left = (now - goal) @ (weight * (now - goal))
            if left < RESTS * loss:
                break
        if left >= loss:
            break
        fit.steps.append(step.tolist())
        fit.totals = now.tolist()
        if left >= RESTS * loss:
            break
    return fit


def rated(rows: DataFrame, steps: Sequence[Sequence[float]], largest: float = LARGEST_RATE) -> DataFrame:
    """rows (with p) and their rate after the steps, each followed by the projection on 0 to largest."""
    if not steps:
        return rows.withColumn("rate", F.lit(1.0))
    taken = F.array(*(F.array(*(F.lit(x) for x in s)) for s in steps))

    def step(rate: Column, slope: Column) -> Column:
        along = F.aggregate(F.zip_with("p", slope, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.least(F.greatest(rate - along, F.lit(0.0)), F.lit(largest))

    return _once(rows, "rate", F.aggregate(taken, F.lit(1.0), step))


def labelled_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", domains: Sequence[str] = tuple(TARGETS)) -> DataFrame:
    """(key, domain) from the labelled table: the language of a good text, "rough" for a poor one.

    A text labelled more than once takes its best label, an id of several languages the first of them;
    languages that are no domain teach nothing.
    """
    best = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.max("quality").alias("quality"))
    langs = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(lang_col).alias("lang"))
    named = F.when(F.col("quality") == 0, F.lit("rough")).when(F.col("quality") == 1, F.col("lang"))
    return langs.join(best, F.col("id") == F.col("key")).select("key", named.alias("domain")).where(F.col("domain").isin(*domains))


def _sampled(named: DataFrame, domains: Sequence[str], each: int) -> DataFrame:
    """At most so many rows (key, domain) of each domain, by the hash of the key."""
    parts = [named.where(F.col("domain") == d).orderBy(F.xxhash64("key"), "key").limit(each) for d in domains]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mixture(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: (id_col, n_tokens, p_<domain> ..., domain, rate, copies).

    domain is the likeliest, the first of targets among equals. Null and empty texts have no tokens; their
    posteriors are the priors and their rate is what those give. Very long texts are measured whole. Without
    labels all domains have the same posterior. Rates lie in 0 to LARGEST_RATE: where a domain has too few
    tokens for its target, its documents stand at the bound and the total falls short; totals() says by
    how much. Repeated rows are mixed each; equal rows get the same copies. Extra columns are not read.
    """
    domains = list(targets)
    scored, _, _, fit = _fit(docs, labels, targets, id_col, text_col, lang_col)
    return _copied(scored, fit.steps).select(
        F.col("id").alias(id_col), "n_tokens",
        *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)),
        F.get(F.array(*(F.lit(d) for d in domains)), F.array_position("p", F.array_max("p")).cast("int") - 1).alias("domain"), "rate", "copies",
    )


def totals(mixed: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """(domain, target_tokens, expected_tokens, copied_tokens) of the rows that mixture() gives, one row for each domain.

    expected counts rates, copied the whole copies; both count a document in all domains by its posteriors.
    """
    whole = float(sum(targets.values()))
    sums = mixed.agg(
        F.sum("n_tokens").alias("all"),
        *(F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")).alias(f"e_{i}") for i, d in enumerate(targets)),
        *(F.sum(F.col("n_tokens") * F.col("copies") * F.col(f"p_{d}")).alias(f"c_{i}") for i, d in enumerate(targets)),
    )
    each = [
        F.struct(F.lit(d).alias("domain"), (F.col("all") * (t / whole)).alias("target_tokens"), F.col(f"e_{i}").alias("expected_tokens"), F.col(f"c_{i}").alias("copied_tokens"))
        for i, (d, t) in enumerate(targets.items())
    ]
    return sums.select(F.inline(F.array(*each)))


def _fit(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], id_col: str, text_col: str, lang_col: str):
    """(rows with posteriors, marks, classifier, fit of the rates), all that mixture() and mix() need."""
    domains = list(targets)
    named = written(_sampled(labelled_domains(docs, labels, id_col, lang_col, domains), domains, SAMPLE_PER_DOMAIN), "mixing-labels")
    few = F.broadcast(_sampled(named, domains, PICKED_FROM))  # PICKED_FROM rows for each domain at most
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(few, F.col("id") == F.col("key"))
    texts = own.groupBy("key", "domain").agg(F.min("t").alias("t"))  # one text for a repeated id
    marks = learned_marks(written(texts.select("domain", "t"), "mixing-texts"), domains)
    rows = written(measured(docs, id_col, text_col, marks), "mixing-rows")
    few = F.broadcast(named)  # SAMPLE_PER_DOMAIN rows for each domain at most
    model = classifier(rows.select("id", "m").join(few, F.col("id") == F.col("key")).select("domain", "m"), domains, marks)
    scored = written(posteriors(rows, model), "mixing-posteriors")
    return scored, marks, model, fitted_rates(scored, list(targets.values()))


def _copied(scored: DataFrame, steps: Sequence[Sequence[float]]) -> DataFrame:
    chance = F.pmod(F.xxhash64(F.col("id").cast("string"), "key"), F.lit(1 << 30)) / float(1 << 30)
    more = (chance < F.col("rate") - F.floor("rate")).cast("int")
    return rated(scored, steps).withColumn("copies", (F.floor("rate") + more).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, each as often as its copies say; cases are those of mixture().

    Classifier and rates are small expressions by then, so texts are measured again in place of being
    shuffled to meet their copies.
    """
    _, marks, model, fit = _fit(docs, labels, targets, id_col, text_col, lang_col)
    scored = posteriors(measured(docs, id_col, text_col, marks, whole_row=True), model)
    copied = _copied(scored, fit.steps).where("copies > 0")
    return copied.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
