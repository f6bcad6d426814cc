"""BPE, shards, licenses, chats, nearest neighbours and URLs on small tables, against brute force."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from tokenizers import Tokenizer

from wordmill.llm import ann, bpe, chat, licenses, sstable, urls
from wordmill.llm.common import shared_folder

TEXTS = [
    (7, "Hello World, don't stop. It's 123½ é"), (None, "no id"), (1, None), (2, ""), (3, "  \n\t "), (4, "tie tie"), (4, "tie tie"),
    (5, "A <|startoftext|>b <|ENDOFTEXT|> c<|endoftext|>d."), (6, "x" * 3000), (8, "a  b   c \n d\n e\u3000f \x1c g "), (9, "line one.\nLine two,\n\nthree"), (-5, "İstanbul ΣΑΣ 가 é"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "doc_id bigint, text string, id string, t string")


def library(name):
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


def test_bpe_matches_the_library(spark):
    tokenizer = library("word_bpe_49k.json")
    file = public_tokenizers.path("word_bpe_49k.json")
    want = Counter()
    for i, t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(frame(spark, TEXTS), file).collect())
    assert got == want
    coded = bpe.encode(frame(spark, TEXTS), file)
    assert Counter(r["decoded"] for r in bpe.decode(coded, file).collect()) == Counter(tokenizer.decode(tokenizer.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t in TEXTS)
    assert bpe.encode(frame(spark, []), file).count() == 0


def test_bpe_chunks_span_batches_of_rows(spark):
    texts = [(i, f"the of the {i % 7} w{i}") for i in range(95)] + [(95, None), (96, ""), (97, "  ")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = bpe._split(spark.createDataFrame(texts, "id bigint, t string").coalesce(1), 3, False).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [list(r["ids"]) for r in rows] == [[i for i, _ in texts]]
    held = [zstandard.decompress(bytes(b)).split(b" ") for b in rows[0]["words"]]
    order = bpe.by_rank(np.array([len(h) for h in held]))
    flat = [w.decode() for h in held for w in h]
    met = [flat[order[p]] for p in bpe.unsqueeze(bytes(rows[0]["places"]))]
    assert [w for w in met if w != "\n"] == [w for _, t in texts for w in (t or "").split()]
    assert [h[0] for h in held if b"the" in h] == [b"the"] and bpe.by_rank(np.array([2, 0, 3])).tolist() == [0, 2, 1, 3, 4]


def test_bpe_is_exact_for_other_files(spark, tmp_path):
    cased = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    cased["normalizer"]["normalizers"] = [n for n in cased["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    file = f"{tmp_path}/cased.json"
    with open(file, "w", encoding="utf-8") as out:
        json.dump(cased, out)
    for name in (file, public_tokenizers.path("byte_bpe_50k.json")):
        own = Tokenizer.from_file(name)
        own.no_truncation()
        own.no_padding()
        got = Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in bpe.encode(frame(spark, TEXTS), name, with_text=True).collect())
        ids = [(i, own.encode(t or "", add_special_tokens=False).ids) for i, t in TEXTS]
        assert got == Counter((i, struct.pack(f"<{len(x)}I", *x), own.decode(x, skip_special_tokens=False)) for i, x in ids)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bpe_")]


def test_byte_level_forms_match_the_library():
    tokenizer, text = library("byte_bpe_50k.json"), open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    rng = np.random.default_rng(5)
    parts = ["a", "B", "é", "1", ".", " ", "\n", ",", " ", "\t", "'s", "<|endoftext|>", "\x01", "\r", "가", "\u3000", "!", "  ", "\n\n", "word"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(5000)] + ["long words, here.\nAnd there " * 40_000, None]
    ids, sizes = sstable.encode_texts(pa.array(texts, pa.string()), text, 0)
    want = [[*e.ids, 0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert not sstable.cuts_at_spaces(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_lookup_opens_only_shards_in_range():
    shards = [sstable.Shard("a", 1, 1, None, 4), sstable.Shard("b", 1, 1, 4, 4), sstable.Shard("c", 1, 1, 5, 9)]
    assert [[s.name for s in shards if s.may_hold(i)] for i in (None, -7, 4, 6, 10)] == [["a"], ["a"], ["a", "b"], ["c"], []]


def test_shards_round_trip_and_lookup(spark):
    tokenizer = library("byte_bpe_50k.json")
    file = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{shared_folder(spark)}/shards-test"
    shards = sstable.write_shards(frame(spark, TEXTS), file, folder)
    got = sorted(sstable.read_shards(spark, folder, shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in TEXTS}
    at = 0
    for r in got:
        assert r["start"] == at and list(np.frombuffer(r["ids"], "<u4")) == ids[r["doc_id"]]
        at += len(ids[r["doc_id"]])
    for i in ids:
        assert [list(x) for x in sstable.lookup(folder, shards, i)] == [ids[i]] * sum(j == i for j, _ in TEXTS)
    assert sstable.lookup(folder, shards, 10**9) == []
    digest = {r["doc_id"]: r["ids_crc32"] for r in sstable.digests(frame(spark, TEXTS), file).collect()}
    assert all(digest[i] == zlib.crc32(struct.pack(f"<{len(x)}I", *x)) for i, x in ids.items())
    assert sstable.digests(frame(spark, []), file).count() == 0


def test_licenses_match_brute_force(spark):
    rows = [
        (None, "MIT license, mit-license CC BY cc by cc by gnu general public license"), (1, None), (2, ""), (3, "mit"), (4, "MIT license"), (4, "MIT license"),
        (5, "This is licensed, kindly, under the Apache License, Version 2.0 today"), (6, "Être É1 apache\nlicense " + "mit license " * 300),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ]

    def brute(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))

    found = licenses.scan(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == Counter((i, *brute(t)) for i, t in rows)
    labels = {r["doc_id"]: r["labels"] for r in found}
    assert labels[5] == "apache,apache-2.0-notice" and labels[7] == "mit-grant"
    assert all(0 <= r["score"] <= 1 for r in found)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_long_templates_with_gaps_and_changed_words(spark):
    """Whole texts of over a hundred words count as a template does that fits one number, whether or not a base phrase is there."""
    mit = next(t for t, label in licenses.TEMPLATES.items() if label == "mit-text").split()
    gap = mit[:60] + ["or", "so"] + mit[61:]
    swapped = [w if i % 21 else "other" for i, w in enumerate(mit)]
    third = [w if i % 3 else "other" for i, w in enumerate(mit)]
    rows = [(1, " ".join(mit)), (2, "so. " * 40 + " ".join(gap)), (3, " ".join(swapped)), (4, " ".join(third)), (5, " ".join(mit[:90])), (6, " ".join(mit) + " x " + " ".join(mit))]
    found = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert all(found[i]["labels"].split(",") == ["mit-grant", "mit-text"] and found[i]["n_base"] == 0 for i in (1, 2, 6))
    assert "mit-text" in found[3]["labels"] and found[4]["labels"] == "" and "mit-text" not in found[5]["labels"]
    assert found[1]["score"] == 1.0 and 0.5 < found[5]["score"] <= 1.0 and found[4]["score"] < 0.8


def test_license_spans_inside_long_islands(spark):
    rows = [
        (1, "licensed under " * 10 + "licensed under cc by sa 4 0"), (2, "licensed under cc by sa 4 0 " + "4 0 " * 10), (3, "under the licensed " * 50),
        (4, "a " * 60_000 + "licensed kindly under the apache license version 2 0"), (5, "\u212a\u0130 mit license"), (None, "released under the mit license " * 3),
    ]
    found = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert "cc-by-sa-4.0-notice" in found[1]["labels"] and "cc-by-sa-4.0-notice" in found[2]["labels"]
    assert found[3]["labels"] == "" and 0 < found[3]["score"] < 0.8
    assert found[4]["labels"] == "apache,apache-2.0-notice" and found[4]["first_word"] == 60_004
    assert found[5]["n_words"] == 3 and found[5]["labels"] == "mit" and found[None]["n_base"] == 3


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 16)))]
    rows += [(1000 + i, rows[3][1]) for i in range(20)]  # equal vectors
    odd = [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0, None] * 8), (None, [1.0] * 16), (750, [float("inf")] * 16), (800, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id bigint, embedding array<float>, v string")
    got = ann.nearest(df, block=200).collect()
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect() if r["vec_id"] in {i for i, _ in rows}}
    hits = 0
    queries = [i for i in data if i % 50 == 0]
    for q in queries:
        score = {i: v @ data[q] / np.sqrt((v @ v) * (data[q] @ data[q])) for i, v in data.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-12 for r in own)
        hits += len({r["vec_id"] for r in own} & set(best))
        assert all(a["score"] > b["score"] or a["vec_id"] < b["vec_id"] for a, b in zip(own, own[1:], strict=False))
    assert hits >= 0.9 * 5 * len(queries)
    assert {r["query_id"] for r in got} == set(queries)
    assert ann.nearest(df.limit(0)).count() == 0


def test_neighbours_among_close_copies(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(1500, 16))
    copies = rng.choice(1500, 700, replace=False)
    data[copies] = data[copies[0]] + 0.001 * rng.normal(size=(700, 16))
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>"), block=800).collect()
    unit = data / np.sqrt((data * data).sum(axis=1, keepdims=True))
    for q in range(0, 1500, 50):
        score = unit @ unit[q]
        score[q] = -np.inf
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == np.argsort(-score)[:5].tolist()


def test_url_rules_and_trees(spark):
    rows = [(None, "http://Example.ORG/es/x"), (1, None), (2, ""), (3, "no url"), (4, "http://org"), (5, "ftp://a.com/de/1?x#y"), (6, "http://org/"), (7, "x://b.example.org/en/19"), (7, "x://b.example.org/en/19"), (8, "a://net/fr/")]
    rows += [(100 + i, f"https://h{i % 7}.example.com/{'fr' if i % 2 else 'de'}/{i}") for i in range(200)]
    out = urls.judge(spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id bigint, url string, host string")).collect()
    assert Counter(r["page_id"] for r in out) == Counter(i for i, _ in rows)
    by = {r["page_id"]: r for r in out}
    assert (by[None]["host"], by[None]["path"], by[None]["rule"], by[None]["verdict"]) == ("example.org", "/es/x", "example.org/es/", "block")
    assert by[4]["rule"] is None and by[4]["path"] == "" and by[6]["rule"] == "org/"
    assert (by[5]["rule"], by[5]["verdict"], by[5]["path"]) == ("com/de/", "block", "/de/1")
    assert by[7]["rule"] == "example.org/en/1" and by[1]["host"] == by[3]["host"] == ""
    assert all(r["verdict"] in ("allow", "block") for r in out)
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_url_trees_on_hosts_not_seen(spark):
    """Labels by a rule on the path alone; hosts without the rule's reach are judged by form."""
    rules = (("block", "seen.net", "/ads/"), ("allow", "seen.net", "/"))
    rows = [(i, f"http://h{i % 40}.{'seen' if i % 3 else 'new'}.net/{'ads/' + 'x1' * 9 + '?a=1&b=2' if i % 2 else 'page'}") for i in range(1200)]
    rows += [(5000, "http://new.net/" + "y" * 200_000), (5001, None)]
    out = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()
    assert len(out) == len(rows)
    unseen = [r for r in out if r["rule"] is None and r["page_id"] < 5000]
    assert len(unseen) == 400 and np.mean([(r["verdict"] == "block") == bool(r["page_id"] % 2) for r in unseen]) > 0.95


def test_tree_scores_match_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    model = urls.train(x, (x[:, 0] + x[:, 1] > 0).astype(float))

    def walk(row):
        total = model.base
        for feature, limit, value in zip(model.feature, model.limit, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x), [walk(r) for r in x])


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = urls.train(x[:1000], y[:1000])
    assert ((model.score(x[1000:]) > 0.5) == (y[1000:] > 0.5)).mean() > 0.9


def spoken(spark, talk):
    lines = chat.written(chat.transcripts(talk), "test-lines")
    model = chat.fit(lines.where("not held_out"))
    return lines, model, chat.speakers(lines, model, lines.agg({"number": "max"}).first()[0] + 1)


def test_chat_roles_are_recovered(spark):
    lines, _, found = spoken(spark, spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    both = lines.join(found.withColumnsRenamed({"role": "got", "begins": "b2"}), ["run", "pos"]).where("held_out")
    assert both.where("role = got").count() > 0.85 * both.count()


def test_chat_decoding_is_the_best_path_across_blocks(spark):
    """A transcript of several blocks and groups scores as well as plain Viterbi decoding of all its lines."""
    rows = [(1, i, ("user", "assistant")[i * i % 7 % 2], f"text {i * i % 13}" + "?" * (i % 3 == 0) + "\nmore" * (i % 5 == 0)) for i in range(400)]
    rows += [(2, 0, "user", "one")]
    lines, model, found = spoken(spark, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    own = lines.where("conv = '1'").select("run", "pos", chat.symbol(lines["line"], lines["opens"]).alias("symbol")).join(found, ["run", "pos"]).orderBy("pos").collect()
    assert len({r["run"] for r in own}) > 5
    states = [chat.STATES.index((r["role"], r["begins"])) for r in own]
    symbols = [r["symbol"] for r in own]
    best = model.first + model.shows[:, symbols[0]]
    for s in symbols[1:]:
        best = (best[:, None] + model.steps).max(axis=0) + model.shows[:, s]
    value = model.first[states[0]] + model.shows[states, symbols].sum() + model.steps[states[:-1], states[1:]].sum()
    assert np.isclose(value, best.max(), rtol=0, atol=1e-6)


def test_chat_products_match_all_paths():
    rng = np.random.default_rng(3)
    k, n = len(chat.STATES), 4
    model = chat.Model(np.log(np.full(k, 1 / k)), np.log(rng.dirichlet(np.ones(k), k)), np.log(rng.dirichlet(np.ones(chat.SYMBOLS), k)))
    symbols = rng.integers(0, chat.SYMBOLS, n)
    matrices = chat.line_matrices(model)[symbols][None]
    score = {p: model.first[p[0]] + sum(model.shows[s, x] for s, x in zip(p, symbols, strict=True)) + sum(model.steps[a, b] for a, b in zip(p, p[1:], strict=False)) for p in product(range(k), repeat=n)}
    best = max(score, key=score.get)
    scores = chat.combined(matrices.copy(), np.array([n]))[0, -1]
    assert np.isclose(scores.max(), score[best])
    assert tuple(chat.traced(matrices, np.array([n]), np.array([-1]), np.array([scores.argmax()]))[0]) == best


def test_chat_is_the_same_for_any_partitioning(spark):
    rows = [(None, None, "user", f"n{i}\nx") for i in range(90)] + [(-2, 0, "user", "a\nb")] * 90 + [(3, 1, "assistant", "word " * 30_000), (3, 0, "user", "q?")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = [Counter(chat.format_chats(df.repartition(n)).collect()) for n in (1, 7, 31)]
    assert found[0] == found[1] == found[2]


def test_chat_edges(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, None, None), (-1, 0, "assistant", "x\n\ny"), (-2, 0, "user", "a"), (-2, 0, "user", "a"), (-3, 200, "user", "far")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, line string")
    out = chat.format_chats(df).collect()
    assert sum(r["n_lines"] for r in out) == 8
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_rows_of_one_turn_stay_apart(spark):
    rows = [(None, None, "user", f"n{i}\nx") for i in range(150)] + [(-2, 0, "user", "a\nb")] * 150 + [(-3, 200, "assistant", "far\nx"), (-3, -1, "user", "first\nx")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    lines = chat.written(chat.transcripts(df), "test-lines")
    assert lines.select("conv", "pos").distinct().count() == lines.count() == 2 * len(rows)
    assert lines.where("begins").groupBy("run").count().agg({"count": "max"}).first()[0] <= 64
    assert lines.where("opens").select("conv").count() == 3
    assert [r["turn"] for r in lines.where("conv = '-3' and begins").orderBy("pos").collect()] == [-1, 200]
    told = chat.turns(lines.withColumn("first_pos", lines["pos"] - lines["pos"] % (1 << chat.LINE_BITS))).collect()
    assert len(told) == len(rows) and all(r["n_lines"] == 2 for r in told)
    assert sum("\nn7\nx" in r["rendered"] for r in told) == 1
    out = chat.format_chats(df).collect()
    assert sum(r["n_lines"] for r in out) == 2 * len(rows)


def test_vectors_of_every_length_are_searched(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=(4, 3, 7)[i % 3]).tolist()) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(vectors, k=3, every=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 200, 10):
        own = np.array(rows[q][1])
        near = sorted(((-np.dot(own, v) / np.linalg.norm(own) / np.linalg.norm(v), i) for i, v in rows if i != q and len(v) == len(own)))[:3]
        assert sorted(got[q]) == [(n, i) for n, (_, i) in enumerate(near, 1)]
