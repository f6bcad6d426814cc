"""Toxicity, quality rules, SimHash, mixing and the pipeline on small tables, against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from wordmill.llm import mixing, quality, simhash, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, fp string, m string"
LABELS = "doc_id bigint, quality int, toxic int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x") for i, t in rows], SCHEMA)


ODD = [(None, "some words here and there"), (1, None), (2, ""), (3, " \n\t "), (4, "tie"), (4, "tie"), (5, "long " * 30_000), (6, "É\u00a0ß ünï\x1ccode")]


def prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "green", "walks", "under", "light", "seven", "paper", "window", "garden"]) + rng.choice(["", "s", "ed"]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(rng, 60)
        if bad:
            words = text.split()
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "scumbag"])
            text = " ".join(words)
        junk = i % 5 == 0
        if junk:
            text = "\n".join(" | ".join(text.split()[k : k + 9]) for k in range(0, 60, 9))
        rows.append((i, text))
        labels.append((i, int(not junk), int(bad)))
    return docs_frame(spark, rows), spark.createDataFrame(labels, LABELS)


def test_toxicity_learns_and_generalises(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.95
    misspelt, clean = toxicity.score_texts(["river stone idiott green walks moronn", "river stone green walks under light"], model)
    assert misspelt > clean


def test_toxicity_scores_match_vectors(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    text = "river stoneses idiot river, moron! green"
    total = np.zeros(toxicity.SIZE)
    for word in text.lower().split():
        index, _ = toxicity.grams([word])
        total += model.vectors[index].astype(float).mean(axis=0)
    logits = toxicity.GAIN * (total / len(text.split())) @ model.weights + model.bias
    assert abs(toxicity.score_texts([text], model)[0] - np.exp(logits[1]) / np.exp(logits).sum()) < 1e-5


def test_toxicity_sample_keeps_rare_shares():
    index, share = toxicity.bag("a " * 2_000_000 + "idiot")
    index2, share2 = toxicity._unpacked(toxicity._packed(index, share))
    assert np.array_equal(index, index2) and np.array_equal(share, share2) and (share2 > 0).all()


def test_toxicity_edges(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    out = toxicity.toxicity(docs_frame(spark, ODD), model).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in ODD)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity(docs_frame(spark, []), model).count() == 0
    empty = toxicity.fit(docs_frame(spark, []), spark.createDataFrame([], LABELS))
    assert toxicity.score_texts(["x"], empty)[0] < 0.7


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    lines = (text or "").split("\n")
    twice = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, len(covered), failed


def test_quality_statistics_match_brute_force(spark, labelled):
    docs, labels = labelled
    field = quality.fit(docs, labels)
    rng = random.Random(5)
    rows = [*ODD[:6], (5, "long " * 3_000), *ODD[7:]] + [(100 + k, "\n".join(rng.choice(["a b c", "a b c d e f g h i", "x # y", "", " "]) for _ in range(rng.randrange(1, 30)))) for k in range(60)]
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality(docs_frame(spark, rows), field).collect())
    assert got == Counter((i, *brute_quality(t)) for i, t in rows)
    assert quality.quality(docs_frame(spark, []), field).count() == 0


def test_quality_keeps_prose_and_drops_tables(spark, labelled):
    docs, labels = labelled
    field = quality.fit(docs, labels)
    kept = {r["doc_id"] for r in quality.keep_good(docs, field).select("doc_id").collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert np.mean([(i in kept) == bool(truth[i]) for i in truth]) > 0.95


def test_quality_labels_lines_of_mixed_texts(spark):
    rng = random.Random(8)

    def lines(good, n):
        return [prose(rng, 12) if good else " | ".join(prose(rng, 9).split()) for _ in range(n)]

    rows = [(i, "\n".join(lines(True, rng.randrange(1, 9)) if i % 2 else lines(True, 1) + lines(False, rng.randrange(3, 9)))) for i in range(200)]
    field = quality.fit(docs_frame(spark, rows), spark.createDataFrame([(i, i % 2, 0) for i in range(200)], LABELS))
    good, poor = ["\n".join(prose(rng, 12) for _ in range(6)) for _ in range(2)], "\n".join(" | ".join(prose(rng, 9).split()) for _ in range(6))
    for text, first in ((good[0] + "\n" + poor, 1), (poor + "\n" + good[1], 0)):
        found = field.viterbi(quality.line_features(text.split("\n"))[0]).tolist()
        assert sum(x == first for x in found[:6]) >= 5 and sum(x != first for x in found[6:]) >= 5
        assert 0 < quality.judge(text, field)[6] < 1


def test_quality_expectations_match_all_paths():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4, len(quality.FEATURES)))
    held = quality._Sequences([x, x[:2]])
    steps, start, w = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=len(quality.FEATURES))
    chance, hops = held.expected(held.x @ w, steps, start, np.array([1.0, 0.0]))
    gain = x @ w
    paths = list(product((0, 1), repeat=4))
    weight = np.array([np.exp(start[p[0]] + sum(gain[i] for i in range(4) if p[i]) + sum(steps[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths])
    weight /= weight.sum()
    assert np.allclose(chance[0], [sum(k for k, p in zip(weight, paths, strict=True) if p[i]) for i in range(4)])
    assert np.isclose(hops[1], sum(k * sum((a, b) == (0, 1) for a, b in zip(p, p[1:], strict=False)) for k, p in zip(weight, paths, strict=True)))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    field = quality.Field(rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))
    x = rng.normal(size=(7, len(quality.FEATURES)))

    def value(path):
        gain = x @ field.weights
        return field.first[path[0]] + sum(gain[i] for i, y in enumerate(path) if y) + sum(field.steps[a, b] for a, b in zip(path, path[1:], strict=False))

    best = max((tuple(int(b) for b in f"{n:07b}") for n in range(128)), key=value)
    assert tuple(field.viterbi(x)) == best


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    out = {v: v for v in values}

    def root(v):
        while out[v] != v:
            v = out[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                out[root(a)] = root(b)
    return {v: root(v) for v in values}


def test_golay_keys_find_every_near_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for j in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(j)
    for one, other in ((a, b), (b, a)):
        (rows, keys), _ = simhash.candidate_keys(one)
        _, (rows2, keys2) = simhash.candidate_keys(other)
        left = set(zip(rows.tolist(), keys.tolist(), strict=True))
        assert {r for r, k in zip(rows2.tolist(), keys2.tolist(), strict=True) if (r, k) in left} == set(range(len(a)))


def test_simhash_groups_match_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, 120) for _ in range(15)]
    rows = list(ODD)
    for k in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["changed", "other"])
        rows.append((10 + k, " ".join(words)))
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    roots = brute_components(sorted({f for _, f in prints}))
    least = {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs_frame(spark, rows)).collect())
    assert got == Counter((i, f"{f:016x}", least.get(roots[f])) for i, f in prints)
    kept = simhash.first_of_groups(docs_frame(spark, rows))
    assert kept.columns == docs_frame(spark, []).columns
    assert kept.count() == len({roots[f] for _, f in prints})
    assert simhash.simhash_groups(docs_frame(spark, [])).count() == 0


def test_simhash_hubs_connect_crowded_keys(spark):
    rng = np.random.default_rng(0)
    base, bits = int(rng.integers(0, 1 << 62)), [1, 5, 9, 20, 33, 41, 50, 62]
    values = {base ^ sum(1 << b for i, b in enumerate(bits) if m >> i & 1) for m in range(256)} | {int(x) for x in rng.integers(0, 1 << 62, 60)}
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    few, every = simhash.links(df, heavy=20), simhash.links(df)
    assert few.where("bit_count(u ^ v) > 3").count() == 0
    one, other = (Counter(simhash.components(x).collect()) for x in (few, every))
    assert one == other


def test_first_of_groups_does_not_depend_on_partitions(spark):
    rows = [(1, "same text here today", "en", f"s{i}", i, "x", "x", "x", "x") for i in range(40)]
    kept = [simhash.first_of_groups(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect() for n in (1, 5)]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_mixing_posteriors_and_bounds_match_brute_force(spark):
    docs = spark.createDataFrame([(i, ("the house and " if i % 10 else "der hund und ") * 5, "en" if i % 10 else "de", "s", 1) for i in range(100)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], LABELS)
    targets = {"en": 0.2, "de": 0.8}  # more German than LARGEST_RATE copies give
    scored, marks, model, fit = mixing._fit(docs, labels, targets, "doc_id", "text", "lang")
    text = "the house and " * 5
    counts = np.array([text.count(m) for m in marks], float)
    logs = np.array([prior + (np.array(w) @ counts) / np.sqrt(max(counts.sum(), 1)) for prior, w in model.values()])
    assert np.allclose(scored.where("id = 1").first()["p"], np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum())
    rows = mixing.rated(scored, fit.steps).toPandas()
    p, n = np.array(rows.p.tolist()), rows.n_tokens.to_numpy(float)
    weight = 1 / np.array(fit.goals)
    rate = np.ones(len(n))
    for _ in range(20_000):
        rate = np.clip(rate - 0.05 * p @ (weight * (p.T @ (n * rate) - fit.goals)), 0, mixing.LARGEST_RATE)
    assert np.allclose(p.T @ (n * rate), fit.totals, atol=2e-2 * n.sum()) and fit.gap > 0.3
    report = {r["domain"]: r for r in mixing.totals(mixing.mixture(docs, labels, targets), targets).collect()}
    assert np.isclose(report["de"]["target_tokens"], 0.8 * n.sum()) and np.isclose(report["de"]["expected_tokens"], fit.totals[1], rtol=1e-6)


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        lang = "en" if i % 3 else "de"
        text = prose(rng, 40) if lang == "en" else " ".join(rng.choice(["schön", "möglichkeit", "wäre", "straße"]) for _ in range(40))
        rows.append((i, text, lang, "s", 1))
        labels.append((i, 1, 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = mixing.mixture(docs, spark.createDataFrame(labels, LABELS), {"en": 0.5, "de": 0.5}).toPandas()
    total = out.n_tokens.sum()
    assert abs((out.n_tokens * out.rate * out.p_de).sum() / total - 0.5) < 1e-3
    truth = {r[0]: r[2] for r in rows}
    assert (out.domain == out.doc_id.map(truth)).mean() > 0.98
    assert ((out.copies - out.rate).abs() < 1).all()
    mixed = mixing.mix(docs, spark.createDataFrame(labels, LABELS), {"en": 0.5, "de": 0.5})
    assert mixed.columns == docs.columns and mixed.count() == out.copies.sum()


def test_mixing_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], LABELS)
    out = mixing.mixture(docs_frame(spark, ODD), labels).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in ODD)
    assert mixing.mix(docs_frame(spark, ODD), labels).columns == docs_frame(spark, []).columns
    assert mixing.mixture(docs_frame(spark, []), labels.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(out.columns)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path, labelled):
    """Nulls, empty, repeated and very long texts and clashing columns; every stage holds what the operator alone decides."""
    docs, labels = labelled
    docs = docs.unionByName(docs_frame(spark, [*((None if i is None else i + 1000, t) for i, t in ODD), (1007, prose(random.Random(1), 30_000)), (1900, None), (1900, None)]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = simhash.written(stage(spark, now, str(tmp_path)), "test-stage")
        ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        before = Counter(r["doc_id"] for r in now.select("doc_id").collect())
        if name == "toxicity":
            got = toxicity.toxicity(now, toxicity.fit(now, labels))
            assert ids == Counter(r["doc_id"] for r in got.where("predicted = 0").collect())
        elif name == "quality_rules":
            got = quality.quality(now, quality.fit(now, labels))
            assert ids == Counter(r["doc_id"] for r in got.where("kept").collect()) and not {None, 1001, 1002, 1900} & set(ids)
        elif name == "near_dedup":
            assert set(ids) == {r["component_id"] for r in simhash.simhash_groups(now).collect()} and max(ids.values()) == 1
        elif name == "mixing":
            got = mixing.mixture(now, labels).where("copies > 0").collect()
            assert ids == Counter({r["doc_id"]: r["copies"] for r in got})
        else:
            assert ids == before and all(r["n_tokens"] > 0 for r in out.collect())
        assert name == "bpe" or out.columns == docs.columns
        now = out


def test_marks_are_grams_of_whole_words(spark):
    """Against a plain count of all n-grams; one word is longer than a block."""
    long = "q" * 100
    texts = [("en", f"{long}xyz{long} thing thong"), ("en", "the thing"), ("de", f"{long}{long} ung zeit"), ("de", "zeitung")]
    marks = mixing.learned_marks(spark.createDataFrame(texts, "domain string, t string"), ["en", "de"], each=12, longest=4)
    weight = {}
    for domain, text in texts:
        words = text.split()
        for word in words:
            edged = f" {word} "
            for n in range(1, 5):
                for i in range(len(edged) - n + 1):
                    gram = edged[i : i + n]
                    if gram.strip():
                        weight[domain, gram] = weight.get((domain, gram), 0) + 1 / len(words)
    want = []
    for d in ("en", "de"):
        worth = {}
        for gram in {g for _, g in weight}:
            rates = [weight.get((x, gram), 0.0) / 2 for x in ("en", "de")]
            mean = (sum(rates) + 1e-6) / 2
            own = weight.get((d, gram), 0.0) / 2
            worth[gram] = own * np.log((own + 1e-6) / mean)
        kept = []
        for gram in sorted((g for g in worth if worth[g] > 0), key=lambda g: (-round(worth[g], 9), g)):
            if len(kept) < 12 and not any(gram in o or o in gram for o in kept):
                kept.append(gram)
        want += [g for g in kept if g not in want]
    assert marks == want and any("x" in m for m in marks)
