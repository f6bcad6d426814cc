"""Operators without a SQL twin, and invariants of those with one."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordmill.functions import arrays as Y
from wordmill.functions import text as T
from wordmill.operators import joins as J
from wordmill.operators import sequences as D
from wordmill.operators import windows as W


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (T.nfkc, "ﬁ①", "fi1"), (T.clause_breaks, "One.\nTwo\nthree\n\nfour", "One. Two, three. four"), (T.strip_structural_quotes, "'don't' \"x\"", "don't x"),
        (T.collapse_letter_dots, "the U.S. army", "the US army"), (T.dash_ranges, "6-8 and a-b", "6 to 8 and a-b"), (T.dedupe_trailing_punct, "what!! !", "what!"),
        (T.dedupe_trailing_punct, "so...", "so..."), (T.strip_markdown_asterisks, "* item **bold** *it*", "item bold it"), (T.expand_identifier_underscores, "a_b _c", "a underscore b _c"),
        (T.brackets_to_pauses, "a (b c) d", "a, b c, d"), (T.brackets_to_pauses, "a () d.", "a  d."), (T.ensure_sentence_end, "", ""), (T.ensure_sentence_end, "a)", "a)."),
        (lambda c: T.expand_abbreviations(c, {"dr.": "doctor"}), "Dr. Who and dr. No", "Doctor Who and doctor No"),
    ],
)
def test_text(spark, function, value, want):
    assert one(spark, value, function) == want


def test_segments_and_units(spark):
    assert [tuple(x) for x in one(spark, "the NASA team", T.acronym_segments)] == [("the ", False), ("NASA", True), (" team", False)]
    assert one(spark, "A B / C.", Y.phone_units) == ["A B", "C", "."]
    assert T.normalize(spark.createDataFrame([(" a  b ",)], "t string"), "t", [T.collapse_whitespace, T.ensure_sentence_end]).first()["t"] == "a b ."


def test_vectors_of_different_lengths_fail(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="different lengths"):
        df.select(Y.dot(F.col("a"), F.col("b"))).collect()


def brute_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_wer_both_ways(spark):
    rng = random.Random(1)
    pairs = [(" ".join(rng.choices("abcdef", k=rng.randrange(0, 12))), " ".join(rng.choices("abcdef", k=rng.randrange(0, 12)))) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", D.wer(F.col("a"), F.col("b")).alias("w"), D._long_wer("a", "b").alias("l")).collect()
    for r in rows:
        want = brute_edit(r["a"].split(), r["b"].split()) / max(len(r["a"].split()), 1)
        assert abs(r["w"] - want) < 1e-9 and abs(r["l"] - want) < 1e-9


def test_near_matches(spark):
    left = spark.createDataFrame([(1, "thequickbrownfoxjumpsover"), (2, "short"), (3, "completelydifferentwords")], "lid bigint, lkey string")
    right = spark.createDataFrame([(7, "thequickbrownfoxjumpedover"), (8, "quickbrownfoxjumpsove")], "rid bigint, rkey string")
    assert {(r["lid"], r["rid"]) for r in J.near_matches(left, right).collect()} == {(1, 7), (1, 8)}


def test_containment_of_every_place(spark, tmp_path):
    from wordmill.plans.join_queries import j17_containment

    rng = random.Random(8)
    keys = ["".join(rng.choices("abcdefghij", k=n)) for n in (20, 21, 26, 40, 52, 53, 70, 104, 200)]
    longer = [rng.choice("kl") * a + k + "m" * b for k in keys for a in range(0, 70, 3) for b in (0, 1, 11, 40)] + keys
    spark.createDataFrame([(i, k + ".") for i, k in enumerate(keys)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, k + ".", "s") for i, k in enumerate(longer)], "doc_id bigint, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = j17_containment(spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {(x, k) for x in longer for k in keys if k in x and len(k) >= 0.65 * len(x)}
    assert "long" in out._jdf.queryExecution().analyzed().toString()  # long keys have one probe


def test_near_matches_are_all_pairs(spark):
    rng = random.Random(4)
    held = "theharbourmasterkeptalongledgerofeveryboat"
    variants = {held[:i] + c + held[i + 1 :] for i in range(len(held)) for c in "qxzjkvwbpfghm"}
    others = ["".join(rng.choices("etaoin", k=rng.randrange(12, 40))) for _ in range(150)]
    right = sorted(variants)[:520] + ["abcdefghijkl", held[4:36], *others[:50]]
    left = [held, "abcdexghijkl", "elevencharx", *others[40:]]
    left += [x[:i] + rng.choice("etaoin") + x[i + rng.randrange(2) :] for x in others for i in [rng.randrange(len(x))]]

    def near(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y, 1):
                new.append(row[j - 1] + 1 if c == d else max(new[-1], row[j]))
            row = new
        n, m = sorted((len(x), len(y)))
        return n >= 12 and (200.0 * row[-1] / (n + m) >= 88 or (n >= 20 and n >= 0.65 * m and (x in y or y in x)))

    want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if near(x, y)}
    got = J.near_matches(spark.createDataFrame(list(enumerate(left)), "lid bigint, lkey string"), spark.createDataFrame(list(enumerate(right)), "rid bigint, rkey string")).collect()
    assert len(got) == len(want) and {(r["lid"], r["rid"]) for r in got} == want
    assert sum(i == 0 for i, _ in want) > 500 and any(left[i] == "abcdexghijkl" for i, _ in want)


def test_common_lengths_of_many_pairs():
    rng = random.Random(5)
    letters = ("ab", "etaoinshr", "".join(map(chr, range(0x4E00, 0x4E00 + 3000))) + "\U0001f600")
    sizes = (0, 1, 12, 63, 64, 65, 127, 128, 129, 300, 511, 512, 513, 700)
    pairs = [tuple("".join(rng.choices(a, k=rng.choice(sizes))) for _ in range(2)) for a in letters for _ in range(60)]
    pairs += [(x, x) for x, _ in pairs[::7]] + [(x[: len(x) // 2] + "z" + x[len(x) // 2 :], x) for x, _ in pairs[::5]]
    assert J._common_lengths(pairs).tolist() == [J.common_length(x, y) for x, y in pairs]
    assert J._common_lengths([]).tolist() == []


def test_near_pairs_of_all_sizes_and_places():
    rng = random.Random(6)
    right = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (*range(12, 90), 130, 200, 300, 600) for _ in range(2)]
    left = [x for x in right[::3]]
    for x in right:  # up to a quarter of the characters put in, taken out or both
        y = list(x)
        for _ in range(rng.randrange(len(x) // 4 + 1)):
            at = rng.randrange(len(y))
            y[at : at + rng.randrange(2)] = rng.choice(("", "e", "q"))
        left.append("".join(y))
        more = int(len(x) / 0.65) - len(x)  # whole keys within longer ones, and parts of keys, at every end
        for before in (0, more // 2, more):
            left.append("".join(rng.choices("etaoinq", k=before)) + x + "".join(rng.choices("etaoinq", k=more - before)))
            left.append(x[min(before, int(len(x) * 0.35)) :][: -(-len(x) * 65 // 100)])
    left = [x for x in left if len(x) >= 12]
    right.sort(key=len)
    for ratio in (88.0, 70.0):
        want = set()
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                short, long = sorted((x, y), key=len)
                holds = len(short) >= 20 and len(short) >= 0.65 * len(long) and short in long
                if holds or (2.0 * len(short) / (len(x) + len(y)) * 100 >= ratio - 1 and 200.0 * J.common_length(x, y) / (len(x) + len(y)) >= ratio):
                    want.add((i, j))
        got = list(J._near_pairs(left, J.known(right), ratio))
        assert len(got) == len(want) and set(got) == want and len(want) > 800


def test_near_pairs_verify_few(monkeypatch):
    """Long keys of few syllables have like counts of letters; those of three in a row tell them apart."""
    rng = random.Random(7)
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as".split()
    keys = ["".join(rng.choices(syllables, k=70)) for _ in range(1000)]
    judged, many = [], J._common_lengths
    monkeypatch.setattr(J, "_common_lengths", lambda pairs: judged.extend(pairs) or many(pairs))
    assert list(J._near_pairs(keys[500:], J.known(sorted(keys[:500], key=len)), 88.0)) == []
    assert len(judged) < 500, len(judged)


def test_near_matches_in_sets_and_with_short_keys(spark, monkeypatch):
    monkeypatch.setattr(J, "CHARS_AT_ONCE", 120)
    rng = random.Random(9)
    right = ["".join(rng.choices("etaoinshr", k=30)) for _ in range(12)]
    left = [*(x[:14] + "q" + x[15:] for x in right), "short", None, "", *(x + "ab" for x in right)]
    a = spark.createDataFrame(list(enumerate(left)), "lid bigint, lkey string")
    b = spark.createDataFrame([*enumerate(right), (98, None), (99, "short")], "rid bigint, rkey string")
    got = [(r["lid"], r["rid"]) for r in J.near_matches(a, b).collect()]
    assert sorted(got) == sorted([(i, i) for i in range(12)] + [(15 + i, i) for i in range(12)])


def test_near_matches_make_keys_once(spark):
    from wordmill.plans.join_queries import j17_near_matches

    plan = j17_near_matches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # the keys' normalisation


def test_interval_join_is_all_pairs(spark):
    rng = random.Random(2)
    spans = [(rng.randrange(3), s, s + rng.randrange(1, 50)) for s in (rng.randrange(200) for _ in range(60))]
    a, b = spans[:30], spans[30:]
    got = J.interval_join(
        spark.createDataFrame(a, "k int, start_l bigint, end_l bigint"), spark.createDataFrame(b, "k int, start_r bigint, end_r bigint"), ["k"], 16
    ).count()
    assert got == sum(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for x in a for y in b)


def test_chunks_keep_words_and_budget(spark):
    texts = [(1, "a b c. d e f g h, i j k l m n o p q r s t"), (2, ""), (3, None), (4, "w " * 57)]
    df = spark.createDataFrame(texts, "id bigint, t string")
    parts = D.chunks(df, "id", "t", 6)
    rows = parts.collect()
    assert all(r["n_words"] <= 6 for r in rows)
    back = {r["id"]: r["text"] for r in D.reassemble(parts, "id").collect()}
    assert back == {i: " ".join(t.split()) for i, t in texts if t and t.split()}
    assert D.reassemble(parts.where("not (id = 4 and chunk = 0)"), "id").count() == len(back) - 1


def test_dtw(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0], [0.0, 1.0, 1.0, 2.0]), (2, [0.0] * 50, [1.0] * 50)], "pair bigint, x array<double>, y array<double>")
    rows = {r["pair"]: r for r in D.dtw_costs(df, 5, 1000).collect()}
    assert rows[1]["cost"] == 0 and rows[2]["cost"] is None


def test_phrase_tags(spark):
    df = spark.createDataFrame([(1, "of the end of it in the")], "id bigint, t string")
    assert [(r["at"], r["phrase"]) for r in D.tag_phrases(df, "id", "t", ["of", "of the", "in the"]).orderBy("at").collect()] == [(0, "of the"), (3, "of"), (5, "in the")]


def test_quota_overshoots_by_one_row_at_most(spark):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], rng.randrange(1, 20)) for i in range(300)]
    got = W.stratified_quota(spark.createDataFrame(rows, "id bigint, g string, v bigint"), ["g"], ["id"], "v", 400, "s").collect()
    total = sum(r["v"] for r in got)
    assert total >= 400 and total - max(r["v"] for r in got) < 400


def test_draws_sort_only_what_can_be_drawn(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(3) or None, rng.randrange(0, 20)) for i in range(4000)] + [(4000, "a", 1, None)]
    df = spark.createDataFrame(rows, "id bigint, g string, p int, v bigint")
    sorted_rows, plain = [], W.running_in_groups

    def counted(part, groups, order, value, into):
        if "h_" in order:
            sorted_rows.append(part.count())
        return plain(part, groups, order, value, into)

    monkeypatch.setattr(W, "running_in_groups", counted)
    digest = {i: hashlib.sha256(f"s:{i}".encode()).hexdigest() for i, *_ in rows}
    for low in (0, -1):
        sample = [(i, g, v) for i, g, _, v in rows if v is not None] + ([(5000, "b", -3)] if low else [])
        digest[5000] = hashlib.sha256(b"s:5000").hexdigest()
        totals, runs, placed = {g: sum(v for _, x, v in sample if x == g) for g in ("a", "b", None)}, Counter(), []
        for i, g, v in sorted(sample, key=lambda r: digest[r[0]]):
            runs[g] += v
            placed.append((int((2 * runs[g] - v) * 1_000_000_000 / (2 * totals[g])), digest[i], i, v))
        for target in (400, 10**9):
            want, run = set(), 0
            for *_, i, v in sorted(placed):
                run += v
                if run - v < target:
                    want.add(i)
            got = W.stratified_quota(spark.createDataFrame(sample, "id bigint, g string, v bigint").union(df.where("v is null").select("id", "g", "v")), ["g"], ["id"], "v", target, "s").collect()
            assert len(got) == len(want) and {r["id"] for r in got} == want
            assert target > 400 or low or sorted_rows[-1] < 200
    quotas = spark.createDataFrame([("a", 30), ("b", 5000), ("c", 3)], "g string, quota bigint")
    got = {r["id"] for r in W.prioritized_sample(df, quotas, ["g"], "p", ["id"], "s").collect()}
    order = sorted(rows, key=lambda r: (-1 if r[2] is None else r[2], digest[r[0]]))
    assert got == {r[0] for r in [r for r in order if r[1] == "a"][:30]} | {r[0] for r in rows if r[1] == "b"}
    assert sorted_rows[-1] < 1000
    huge = spark.createDataFrame([(1, "a", 6_000_000_000), (2, "a", 7_000_000_000), (3, "b", 1)], "id bigint, g string, v bigint")
    assert W.stratified_quota(huge, ["g"], ["id"], "v", 10**11, "s").count() == 3


def test_running_sum_and_dense_ids(spark):
    rows = [(i % 5, i) for i in range(100)]
    got = W.global_running_sum(spark.createDataFrame(rows, "v bigint, i bigint"), ["i"], "v", "run").orderBy("i").collect()
    total = 0
    for r in got:
        total += r["v"]
        assert r["run"] == total
    sparse = spark.createDataFrame([("a", 0), ("a", 5), ("b", 0), ("b", 1)], "g string, i bigint")
    assert len({r["d"] for r in W.dense_ids(sparse, "g", "i", "d").collect()}) == 4


def test_intervals_to_tokens(spark):
    tokens = [("u", 0, "pa", ["p", "a"]), ("u", 1, "wei", ["w", "ei"]), ("u", 2, "ma", ["m", "a"]), ("u", 3, "no", ["n", "o"])]
    labels = [("p", 0.0, 0.1), ("a", 0.1, 0.3), ("ei", 0.3, 0.4), ("x", 0.4, 0.5), ("m", 0.5, 0.6), ("a", 0.6, 0.9)]
    spoken = spark.createDataFrame([("u", i, *x) for i, x in enumerate(labels)], "utt string, pos bigint, label string, start double, end double")
    df = spark.createDataFrame(tokens, "utt string, pos bigint, token string, phones array<string>")
    rows = {r["token"]: r["frames"] for r in D.assign_intervals(df, spoken, frozenset({"w"}), frozenset({"a", "ei", "o"}), 10.0).collect()}
    assert {k: v and round(v, 6) for k, v in rows.items()} == {"pa": 3.0, "wei": 1.0, "ma": 4.0, "no": None} or rows["no"] != rows["no"]


def test_encoded_chunks(spark):
    df = spark.createDataFrame([(1, list("ab.cdefg,hi"), list(range(11)))], "id bigint, tokens array<string>, ids array<int>")
    rows = D.encoded_chunks(df, "id", 6, frozenset("."), frozenset(",")).orderBy("chunk").collect()
    assert ["".join(r["tokens"]) for r in rows] == ["ab.", "cdefg,", "hi"]
    assert [i for r in rows for i in r["ids"]] == list(range(11))


def test_reference_mismatches(spark):
    lines = spark.createDataFrame([(1, ["hi", "you", "zz", "hi"], ["HH", "AY", "Y", "AH", "Q"]), (2, ["hi"], ["HH", "AY"])], "line bigint, words array<string>, units array<string>")
    lexicon = spark.createDataFrame([("hi", ["HH", "AY"]), ("you", ["Y", "UW"])], "word string, phones array<string>")
    assert [(r["line"], r["word"], r["got"]) for r in D.reference_mismatches(lines, lexicon).collect()] == [(1, "you", ["Y", "AH"])]


def test_step_windows_cover_every_event(spark, tmp_path):
    from wordmill.plans.stat_queries import a23_step_windows

    rows = [(0, 1.0), (999, 3.0), (9999, 5.0), (10000, 7.0), (99999, 9.0), (None, 2.0)]
    spark.createDataFrame(rows, "event_id bigint, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r["lo"], r["hi"], r["n"], r["mean"]) for r in a23_step_windows(spark, str(tmp_path)).collect())
    assert got == [(0, 1000, 2, 2.0), (9000, 10000, 1, 5.0), (10000, 11000, 1, 7.0), (99000, 100000, 1, 9.0)]


def test_step_windows_sql_covers_every_event(spark, tmp_path):
    import duckdb

    from wordmill.plans.stat_queries import a23_step_windows
    from wordmill.registry import SQL

    rows = [(-1, 4.0), (0, 1.0), (999, 3.0), (9999, 5.0), (10000, 7.0), (99999, 9.0), (None, 2.0), (5_999_999, None)]
    events = spark.createDataFrame(rows, "event_id bigint, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as own:
        own.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        expected = sorted(own.execute(SQL["a23_step_windows"]).fetchall())
    assert len(expected) == 6
    assert sorted(tuple(r) for r in a23_step_windows(spark, str(tmp_path)).collect()) == expected


def test_text_rules_in_full(spark):
    cases = [
        (T.text_key, "\uff21\ufb01 \u2460 \u00c9!", "afi1\u00e9"), (T.text_key, None, None), (T.split_sql_glued, "groupby truncDATE NVL2 ToNumberX", "GROUP BY TRUNC DATE NVL 2 ToNumberX"),
        (T.strip_emojis, "a\u231a1\ufe0f\u20e3b\U0001f3f4\U000e0067\U000e007f", "a1b"), (T.strip_control_chars, "a\ufff9b\ufffbc\u200b", "abc"),
        (T.clause_breaks, "\u597d\n\n\u597d", "\u597d\u3002\u597d"),
    ]
    for function, text, want in cases:
        row = spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("out")).first()
        assert row["out"] == want, (function.__name__, text)


def test_character_grams(spark):
    texts = ["abcabcd", "abc", "", None, "\u00e9\U0001f600xyz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["g"] for r in df.select(Y.grams(F.col("t"), 4).alias("g")).collect()]
    assert got[0] == ["abca", "bcab", "cabc", "abcd"] and got[1] == [] and got[2] == [] and not got[3]
    assert got[4] == ["\u00e9\U0001f600xy", "\U0001f600xyz"]


def test_character_grams_are_counted(spark):
    texts = ["abcabcd", "abc", "", None, "\u00e9\U0001f600xyz", "aaaaaaa"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(Y.count_grams(F.col("t"), 4).alias("n"), F.size(Y.grams(F.col("t"), 4)).alias("g"), "t").collect()
    assert [r["n"] for r in rows] == [4, 0, 0, None, 2, 1]
    assert all(r["n"] == r["g"] for r in rows if r["t"] is not None)


def test_running_sums_in_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(9)) for i in range(400)]
    rng.shuffle(rows)
    got = W.running_in_groups(spark.createDataFrame(rows, "g string, i bigint, v bigint"), ["g"], ["i"], "v", "run").collect()
    sums = {g: sum(v for x, _, v in rows if x == g) for g in ("a", "b", None)}
    assert len(got) == 400
    for r in got:
        assert r["run"] == sum(v for g, i, v in rows if g == r["g"] and i <= r["i"]) and r["total_"] == sums[r["g"]]


@pytest.mark.parametrize("metric", ["l1", "l2", "cosine"])
def test_dtw_metrics_and_path(spark, metric):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=(n, 3)).tolist(), rng.normal(size=(m, 3)).tolist()) for k, (n, m) in enumerate([(1, 1), (3, 4), (5, 2), (4, 5)])]
    pairs = spark.createDataFrame([*rows, (9, rows[3][1] * 3, rows[3][1] * 3)], "pair long, x array<array<double>>, y array<array<double>>")
    got = {r["pair"]: r for r in D.dtw_costs(pairs, None, 100, metric, True).collect()}
    assert got[9]["cost"] is None and got[9]["path"] is None  # 144 cells

    for k, x, y in rows:
        def apart(i: int, j: int) -> float:
            a, b = np.array(x[i]), np.array(y[j])
            if metric == "cosine":
                return 1 - a @ b / np.sqrt(a @ a * (b @ b))
            return np.abs(a - b).sum() if metric == "l1" else np.sqrt(((a - b) ** 2).sum())

        def least(i: int, j: int) -> float:  # over all paths
            before = [least(p, q) for p, q in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p >= 0 and q >= 0]
            return apart(i, j) + (min(before) if before else 0)

        path = [(s["i"], s["j"]) for s in got[k]["path"]]
        assert got[k]["cost"] == pytest.approx(least(len(x) - 1, len(y) - 1)) and len(path) == got[k]["steps"]
        assert path[0] == (0, 0) and path[-1] == (len(x) - 1, len(y) - 1)
        assert sum(apart(i, j) for i, j in path) == pytest.approx(got[k]["cost"])


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (T.collapse_letter_dots, "the U.S. army", "the US army"),
        (T.collapse_letter_dots, "a Ph.D. in the U.K.", "a PhD in the UK"),
        (T.collapse_letter_dots, "Vitamin C. It", "Vitamin C. It"),
        (T.collapse_letter_dots, "U.S.A.F. and e.g. this", "USAF and e.g. this"),
        (T.collapse_letter_dots, "line\nN.A.S.A.\nend", "line\nNASA\nend"),
        (T.collapse_letter_dots, None, None),
        (T.dash_ranges, "6-8 weeks", "6 to 8 weeks"),
        (T.dash_ranges, "6 – 8 or 10—12", "6 to 8 or 10 to 12"),
        (T.dash_ranges, "2020-2024", "2020-2024"),
        (T.dash_ranges, "555-12", "555-12"),
        (T.dash_ranges, "12:30-45 and 3-4/5 and 1-2.5 and 3-4 °", "12:30-45 and 3-4/5 and 1-2.5 and 3-4 °"),
        (T.expand_identifier_underscores, "date_column", "date underscore column"),
        (T.expand_identifier_underscores, "a_b_c _x y_", "a underscore b underscore c _x y_"),
        (T.dedupe_trailing_punct, "what!!!", "what!"),
        (T.dedupe_trailing_punct, "what ! ! ", "what!"),
        (T.dedupe_trailing_punct, "what?!", "what?!"),
        (T.dedupe_trailing_punct, "so...", "so..."),
        (T.dedupe_trailing_punct, "好。。", "好。"),
        (T.dedupe_trailing_punct, "a!! b", "a!! b"),
        (T.dedupe_trailing_punct, "x_ _", "x_ _"),
        (T.dedupe_trailing_punct, "end  ", "end  "),
        (T.strip_markdown_asterisks, "Love * Learn * Laugh", "Love, Learn, Laugh"),
        (T.strip_markdown_asterisks, "Buy:\n* milk\n* eggs", "Buy: milk, eggs"),
        (T.strip_markdown_asterisks, "a **b c** *d*", "a b c d"),
        (T.strip_markdown_asterisks, "SELECT COUNT( * ) y", "SELECT COUNT() y"),
        (T.strip_markdown_asterisks, "tables a.x*, b", "tables a.x, b"),
        (T.strip_markdown_asterisks, "3 * 4 and 5", "3 * 4 and 5"),
        (T.strip_structural_quotes, "I'm \u201cfine\u201d, don\u2019t 'worry' \u300e\u597d\u300f", "I'm fine, don\u2019t worry \u597d"),
        (T.strip_code_ticks, "run ```x``` and `y`", "run  x  and  y "),
    ],
)
def test_text_rules_by_expected_rows(spark, function, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("out")).first()["out"] == want
