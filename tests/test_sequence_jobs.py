"""Interval assignment, variants by rules, phrase tags, scoring, table functions and range-cut groups against plain computations."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordmill.functions import tables
from wordmill.functions import text as T
from wordmill.operators import rules as R
from wordmill.operators import sequences as D
from wordmill.operators import windows as W
from wordmill.plans import sequence_queries as Q

NUCLEI = ("a", "o", "ei", "e", "er", "u", "ow")


def assigned(spark, spoken, tokens, **more):
    """spoken: (label, frames) in order; tokens: (token, phones). What each token got, rounded; None if it failed."""
    at, rows = 0.0, []
    for i, (label, frames) in enumerate(spoken):
        rows.append(("u", i, label, at, at + frames))
        at += frames
    left = spark.createDataFrame([("u", i, t, list(p)) for i, (t, p) in enumerate(tokens)], "utt string, pos bigint, token string, phones array<string>")
    right = spark.createDataFrame(rows, "utt string, pos bigint, label string, start double, end double")
    options = {"onsets": ("q", "w", "j"), "nuclei": NUCLEI, "codas": ("r",), "same": {"k": ("c",)}} | more
    found = D.assign_intervals(left, right, options["onsets"], options["nuclei"], 1.0, options.get("ahead", 6), options["codas"], options["same"]).orderBy("pos").collect()
    return [(r["token"], None if r["frames"] is None or r["frames"] != r["frames"] else round(r["frames"], 6)) for r in found]


@pytest.mark.parametrize(
    ("spoken", "tokens", "want"),
    [
        ([("o", 5)], [("wo", "wo")], [("wo", 5)]),  # an optional onset may be missing
        ([("w", 4), ("o", 5)], [("wo", "wo")], [("wo", 9)]),  # and counts where it stands
        ([("s", 6), ("w", 4), ("o", 5)], [("s", "s"), ("wo", "wo")], [("s", 6), ("wo", 9)]),  # it belongs to the token that asks for it
        ([("s", 4), ("ei", 6), ("q", 2), ("o", 5)], [("s", "s"), ("e", "e"), ("qo", "qo")], [("s", 4), ("e", None), ("qo", 7)]),  # no reaching past another nucleus, which is passed
        ([("m", 3), ("e", 5), ("n", 3), ("o", 4), ("r", 3)], [("m", "m"), ("en", "en"), ("or", "or")], [("m", 3), ("en", 8), ("or", 7)]),  # a coda that is there
        ([("w", 3), ("a", 6), ("n", 3), ("o", 4), ("t", 3), ("ow", 5)], [("wan", "wan"), ("or", "or"), ("t", "t"), ("ow", ["ow"])], [("wan", 12), ("or", 4), ("t", 3), ("ow", 5)]),  # one that is not
        ([("c", 2), ("x", 1), ("a", 3)], [("ka", "ka")], [("ka", 5)]),  # spoken otherwise, and what lies between is no token's
        ([("k", 2), ("t", 1), ("u", 3), ("m", 4)], [("kan", "kan"), ("m", "m")], [("kan", None), ("m", None)]),  # what a failed token took stays taken, and the nucleus bars the next
        ([("u", 3), ("m", 4), ("a", 2)], [("ka", "ka"), ("ma", "ma")], [("ka", None), ("ma", 6)]),  # nothing taken: the nucleus in its way goes
        ([], [("a", "a")], [("a", None)]),
        ([("x", 1)] * 7 + [("a", 2)], [("a", "a")], [("a", None)]),  # out of reach
    ],
)
def test_interval_cases(spark, spoken, tokens, want):
    assert assigned(spark, spoken, tokens) == want


def test_phones_in_context(spark):
    rows = [("u", 0, "J", ["j"]), ("u", 1, "yong", ["y", "u", "ng"]), ("u", 2, "yong", ["y", "u", "ng"]), ("v", 0, "yong", ["y", "u", "ng"]), ("v", 1, "D", ["d"]), ("v", 2, "e0", ["q", "o"]), ("w", 0, "J", ["j"]), ("w", 1, "yo", ["y"])]
    rules = [{"after": {"J", "Q"}, "starts": "yo", "drop": {"y"}}, {"after": {"D"}, "is": "e0", "phones": ["e"]}]
    got = D.in_context(spark.createDataFrame(rows, "utt string, pos bigint, token string, phones array<string>"), rules).orderBy("utt", "pos").collect()
    assert ["".join(r["phones"]) for r in got] == ["j", "ung", "yung", "yung", "d", "e", "j", "y"]


def test_variants_by_rules(spark):
    table = {
        "READ": [{"pick": 1, "when": {"prev_in": "past"}}, {"pick": 2, "when": {"prev_matches": "ly$"}}],
        "THE": [{"pick": 1, "when": {"next_vowel": True}}, {"pick": 2, "when": {"next_end": True}}],
        "USE": [{"pick": 1, "when": {"prev_suffix": "'s", "next_in": "of"}}, {"pick": 3, "when": {"prev_not_in": "past", "next_suffix": "ed"}}],
    }
    lists = {"past": ("had", "was"), "of": ("of",)}
    sentences = ["had read", "had , read", "quickly read", "will read", "the apple the pear the", "the . apple", "one's use of", "use needed", "was use needed", "READ", "the !"]
    rows = [(i, k, t) for i, s in enumerate(sentences) for k, t in enumerate(s.split())]
    got = D.context_variants(spark.createDataFrame(rows, "s int, k int, t string"), ["s"], "k", "t", table, lists).where("upper(t) in ('READ', 'THE', 'USE')").orderBy("s", "k").collect()
    assert [(r["s"], r["variant"]) for r in got] == [(0, 1), (1, 1), (2, 2), (3, None), (4, 1), (4, None), (4, 2), (5, 1), (6, 1), (7, 3), (8, None), (9, None), (10, 2)]
    with pytest.raises(ValueError):
        D.context_variants(spark.createDataFrame(rows, "s int, k int, t string"), ["s"], "k", "t", {"A": [{"pick": 1, "when": {"sometimes": 1}}]}, {})


def brute_tags(words, lexicon, not_after, overlaps):
    at, out = 0, []
    longest = max(len(p) for p in lexicon)
    while at < len(words):
        for n in range(min(longest, len(words) - at), 0, -1):
            phrase = tuple(words[at : at + n])
            if phrase not in lexicon or (at and words[at - 1] in not_after.get(" ".join(phrase), ())):
                continue
            follows = any(tuple(words[at + n - 1 : at + n - 1 + m]) in lexicon and at + n - 1 + m <= len(words) for m in range(2, longest + 1))
            if overlaps and n > 1 and phrase[:-1] in lexicon and follows:
                continue
            out.append((at, " ".join(phrase)))
            at += n
            break
        else:
            at += 1
    return out


def test_tags_of_a_large_lexicon_match_brute_force(spark):
    rng = random.Random(2)
    letters = [f"w{i}" for i in range(30)]
    lexicon = {tuple(rng.choices(letters, k=rng.choice([1, 2, 2, 3, 4]))) for _ in range(30_000)}
    texts = [(i, " ".join(rng.choices(letters, k=rng.randrange(0, 60)))) for i in range(60)] + [(60, None), (61, " ")]
    frame = spark.createDataFrame(texts, "id bigint, t string")
    phrases = spark.createDataFrame([(" ".join(p),) for p in lexicon], "phrase string")
    veto = {" ".join(p): (letters[0], letters[1]) for p in sorted(lexicon)[:2000]}
    for overlaps in (False, True):
        want = {(i, at, p) for i, t in texts for at, p in brute_tags((t or "").split(), lexicon, veto, overlaps)}
        for tree in (100_000, 10):  # as a tree, and by the join
            got = D.tag_phrases(frame, "id", "t", phrases, veto, overlaps, tree).collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_scorer_gets_batches_of_one_length(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([3, 3, 3, 5, 9]))]) for i in range(200)] + [(200, []), (201, None)]
    folder = str(tmp_path)

    def scorer(x):
        import uuid
        from pathlib import Path

        Path(folder, uuid.uuid4().hex).write_text(f"{x.shape[0]} {x.shape[1]}")
        return {"mean": x.mean(axis=1), "top": x.max(axis=1)}

    def careful(x):
        assert x.shape[0] == 1
        return {"mean": x.mean(axis=1) + 10, "top": x.max(axis=1)}

    frame = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {r["id"]: r for r in D.score_in_batches(frame, "id", "v", scorer, {"mean": 0.0, "top": 2.0}, margin=0.1, careful=careful).collect()}
    shapes = [tuple(map(int, p.read_text().split())) for p in tmp_path.iterdir()]
    assert {n for n, _ in shapes} <= set(range(1, 9)) and sum(n for n, _ in shapes) == 200 and {m for _, m in shapes} == {3, 5, 9} and max(n for n, _ in shapes) == 8
    for i, v in rows[:200]:
        near = abs(np.mean(v)) < 0.1
        assert got[i]["again"] == near and abs(got[i]["mean"] - (np.mean(v) + 10 * near)) < 1e-9 and abs(got[i]["top"] - max(v)) < 1e-9
    assert got[200]["mean"] is None and got[201]["mean"] is None and len(got) == 202


def test_table_functions_keep_words_and_budgets(spark):
    tables.register(spark)
    texts = [(1, "a b c. d e f g h, i j k l m n o p q r s t"), (2, ""), (3, None), (4, "w " * 57), (5, "one. two. three four five six seven. eight")]
    spark.createDataFrame(texts, "id bigint, t string").createOrReplaceTempView("texts_to_cut")
    rows = spark.sql("SELECT id, c.* FROM texts_to_cut, LATERAL text_chunks(t, 6) c").collect()
    parts = {i: [r for r in sorted(rows, key=lambda r: r["chunk"]) if r["id"] == i] for i, _ in texts}
    for i, t in texts:
        assert " ".join(r["part"] for r in parts[i]) == " ".join((t or "").split())
        assert all(r["n_words"] <= 6 and r["n_chunks"] == len(parts[i]) for r in parts[i])
    assert [r["part"] for r in parts[5]] == ["one. two.", "three four five six seven. eight"] and not any(r["hard"] for r in parts[5])
    assert all(r["hard"] for r in parts[4])


@pytest.mark.parametrize(
    ("tokens", "budget", "want"),
    [
        ("a b . _ c d , e f g", 5, ["a b . _", "c d ,", "e f g"]),  # a separator goes with the mark before it
        ("a b c . _ d", 4, ["a b c .", "_ d"]),  # unless it doesn't fit
        ("a b _ c d e", 4, ["a b _", "c d e"]),
        ("_ a b c d", 3, ["_ a b", "c d"]),  # a separator at the start is no boundary
        ("p aˉ p oˊ p iˋ", 3, ["p aˉ", "p oˊ", "p iˋ"]),  # complete tones, where nothing else is
        ("x , y . z w v", 5, ["x , y .", "z w v"]),  # strong before weak, though earlier
        ("a b c", 5, ["a b c"]),
    ],
)
def test_token_boundaries(tokens, budget, want):
    tokens, start, got = tokens.split(), 0, []
    for end, _ in tables.token_ends(tokens, budget):
        got.append(" ".join(tokens[start:end]))
        start = end
    assert got == want


def test_token_chunks_cut_arrays_alike(spark):
    tables.register(spark)
    rows = [(1, list("ab.cdefg,hi"), list(range(11)), list(range(11, 22))), (2, [], [], None), (3, None, None, None), (4, ["x"], [7], None)]
    spark.createDataFrame(rows, "id bigint, tokens array<string>, ids array<int>, tones array<int>").createOrReplaceTempView("utterances_to_cut")
    got = spark.sql("SELECT id, c.* FROM utterances_to_cut, LATERAL token_chunks(tokens, ids, tones, 6) c ORDER BY id, chunk").collect()
    assert ["".join(r["tokens"]) for r in got if r["id"] == 1] == ["ab.", "cdefg,", "hi"] and [r["cut"] for r in got if r["id"] == 1] == ["strong", "weak", "end"]
    assert [i for r in got if r["id"] == 1 for i in r["ids"]] == list(range(11)) and [i for r in got if r["id"] == 1 for i in r["tones"]] == list(range(11, 22))
    assert [(r["id"], r["ids"], r["tones"]) for r in got if r["id"] > 1] == [(4, [7], None)]


def test_groups_cut_by_ranges(spark):
    """One user with nine tenths of the rows, a null user, and users of one row."""
    rng = random.Random(5)
    rows = [("big", rng.randrange(100_000), i) for i in range(1800)] + [(None, rng.randrange(1000), i) for i in range(1800, 1900)] + [(f"u{i}", i, i) for i in range(1900, 2000)]
    frame = spark.createDataFrame(rows, "user string, ts bigint, id bigint")
    by = {}
    for user, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(user, []).append((ts, i))
    want = {i: (own[k - 1][0] if k else None) for own in by.values() for k, (_, i) in enumerate(own)}
    assert {r["id"]: r["earlier"] for r in W.lagged(frame, ["user"], ["ts", "id"], {"ts": "earlier"}).collect()} == want

    sessions = set()
    for user, own in by.items():
        number, start, before, n = 1, own[0][0], own[0][0], 0
        for ts, _ in own:
            if ts - before >= 90:
                sessions.add((user, number, start, before, n))
                number, start, n = number + 1, ts, 0
            before, n = ts, n + 1
        sessions.add((user, number, start, before, n))
    got = W.gap_sessions(frame, "user", "ts", "id", 90)
    assert {tuple(r) for r in got.collect()} == sessions

    points = {"p05": 0.05, "p50": 0.5, "p99": 0.99}
    found = {r["user"]: r for r in W.exact_percentiles(frame, ["user"], "ts", points).collect()}
    for user, own in by.items():
        assert found[user]["n"] == len(own) and all(abs(found[user][name] - np.quantile([t for t, _ in own], p)) < 1e-6 for name, p in points.items())
    odd = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), ("b", None)], "g string, v double")
    assert [tuple(r) for r in W.exact_percentiles(odd, ["g"], "v", {"half": 0.5}).collect()] == [("a", 2, 2.0)]


def test_a_hot_group_is_many_tasks(spark):
    rows = spark.range(40_000).select(F.lit("big").alias("user"), (F.col("id") * 7 % 40_000).alias("ts"), "id")
    ranges = W.fixed(rows.repartitionByRange(4, "user", "ts", "id").withColumn("part", F.spark_partition_id()))
    assert ranges.groupBy("part").count().agg(F.max("count")).first()[0] < 20_000
    assert W.lagged(rows, ["user"], ["ts", "id"], {"ts": "earlier"}).where("earlier is null or earlier = ts - 1").count() == 40_000


def test_pronunciations_from_every_source(spark):
    lexicon = spark.createDataFrame([("READ", 0, "R IY D"), ("READ", 1, "R EH D"), ("CAT", 0, "K AE T"), ("'CAUSE", 0, "K AH Z"), ("DOGS", 0, "D AO G Z"), ("WELL", 0, "W EH L"), ("UNDER", 0, "AH N D ER"), ("CAT'S", 0, "K AE T S")], "word string, variant int, reading string")
    supplement = spark.createDataFrame([("zed", "Z EH D"), ("cat", "never")], "word string, reading string")
    letters = {"A": "EY", "B": "B IY", "X": "EH K S"}
    asked = [("Read", None), ("read", 1), ("read", 7), ("cat", None), ("cause", None), ("dogs'", None), ("well's", None), ("cat’s", None), ("zed", None), ("well-read", None), ("well-qq", None), ("cat_zed", None), ("UnderCat", None), ("ab", None), ("axq", None), ("", None), (None, None), ("read", 1)]
    got = {(r["word"], r["pick"]): (r["reading"], r["origin"]) for r in D.pronounce(spark.createDataFrame(asked, "word string, pick int"), lexicon, supplement, letters).collect()}
    assert got == {
        ("Read", None): ("R IY D", "lexicon"), ("read", 1): ("R EH D", "lexicon"), ("read", 7): ("R IY D", "lexicon"), ("cat", None): ("K AE T", "lexicon"), ("cause", None): ("K AH Z", "lexicon"),
        ("dogs'", None): ("D AO G Z", "lexicon"), ("well's", None): ("W EH L", "lexicon"), ("cat’s", None): ("K AE T S", "lexicon"), ("zed", None): ("Z EH D", "supplement"),
        ("well-read", None): ("W EH L R IY D", "hyphen"), ("well-qq", None): (None, "missing"), ("cat_zed", None): ("K AE T Z EH D", "underscore"), ("UnderCat", None): ("AH N D ER K AE T", "compound"),
        ("ab", None): ("EY B IY", "spell"), ("axq", None): (None, "missing"), ("", None): (None, "missing"),
    }


def test_warping_matches_a_plain_table():
    rng = np.random.default_rng(1)
    for band in (None, 2, 5):
        for n, m in ((7, 9), (1, 4), (12, 5), (6, 6)):
            apart = rng.integers(0, 4, (n, m)).astype(float)
            best = {(0, 0): (0.0, 0)}
            for i in range(1, n + 1):
                for j in range(1, m + 1):
                    if band is None or abs(j - i * m // n) <= band:
                        cost, steps = min(best.get(k, (np.inf, 0)) for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
                        best[i, j] = (cost + apart[i - 1, j - 1], steps + 1)
            cost, steps = D.warped(apart, band)
            want = best.get((n, m), (np.inf, 0))
            assert cost[n, m] == want[0] and (np.isinf(want[0]) or steps[n, m] == want[1])


def test_common_acronyms_and_programming_tokens(spark):
    def one(text, function):
        return spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("o")).first()["o"]

    assert one("the GPU and Wifi6, MP3! or mp3 ABCDEF NBA", lambda c: T.spell_acronyms(c, {"wifi6", "MP3"})) == "the G P U and W i f i 6 , M P 3 ! or mp3 ABCDEF N B A"
    assert one("C++ C# F#", T.programming_tokens) == "C plus plus C sharp F#"


def test_eligibility_cascade(spark):
    ids = list(range(3, 40))
    english = "the quick brown fox jumps over lazy dogs in the park today."
    cases = [
        (english, ids, None), ("", ids, "format"), (None, ids, "format"), ("a | b.", ids, "format"), ("see www.example.org now.", ids, "nonspoken_markup"), ("no end here", ids, "unfinished_punctuation"),
        (english, [3] * 10, "token_length_or_unknown"), (english, [*ids, 2], "token_length_or_unknown"), (english, None, "token_length_or_unknown"),
        ("haha haha haha we laughed all day long in the old house.", ids, "repetition"), ("呃嗯呃今天天气很好我们一起去公园吧。", ids, "disfluency"), ("今天很好。", ids, "zh_length"), ("too short here.", ids, "en_length"),
        ("今天hi。", ids, "mixed_content"), ("今天天气很好我们一起去公园散步吧好吗。", ids, None), ("one two three four five six seven eight nine ten \u201cend.\u201d", ids, None), ("the " * 9 + "end " * 46 + "x.", ids, "repetition"),
    ]
    rows = [(k, t, i) for k, (t, i, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, "k int, t string, ids array<int>").select("k", R.eligibility(F.col("t"), F.col("ids"), 2).alias("reason")).orderBy("k").collect()
    assert [r["reason"] for r in got] == [want for _, _, want in cases]


def test_word_distances(spark):
    rng = random.Random(7)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for most in (3, 20, 150):
        for _ in range(60):
            a, b = (rng.choices("abcd", k=rng.randrange(most)) for _ in "ab")
            assert D.word_distance(a, b) == plain(a, b)
    # a blank that is no white space of regular expressions joins words, however many words a pair has
    rows = [("a\u00a0b", "a b"), ("a\tb ", " a b"), ("", "x y"), (None, "x"), ("x", None), (" ".join(map(str, range(7000))), " ".join(map(str, range(1, 7001))))]
    got = [r["w"] for r in spark.createDataFrame(rows, "a string, b string").select(D.wer(F.col("a"), F.col("b")).alias("w")).collect()]
    assert got == [2.0, 0.0, 2.0, None, None, 2 / 7000]
    assert [r["l"] for r in spark.createDataFrame(rows[:1], "a string, b string").select(D._long_wer("a", "b").alias("l")).collect()] == [2.0]


def test_tables_are_warped_together(spark):
    rng = np.random.default_rng(2)
    apart = rng.integers(0, 5, (6, 9, 7)).astype(float)
    for band in (None, 2):
        cost, steps = D.warped(apart, band)
        for k in range(7):
            one, counts = D.warped(apart[:, :, k], band)
            assert np.array_equal(cost[:, :, k], one) and np.array_equal(steps[:, :, k], counts)
    pairs = [(i, rng.integers(0, 9, 3 + i % 4).astype(float).tolist(), rng.integers(0, 9, 2 + i % 3).astype(float).tolist()) for i in range(60)] + [(60, [], []), (61, [1.0], [])]
    df = spark.createDataFrame(pairs, "pair bigint, x array<double>, y array<double>")
    for metric in ("l1", "l2"):
        got = {r["pair"]: r for r in D.dtw_costs(df, None, 1000, metric, True).collect()}
        for pair, x, y in pairs:
            cost, steps = D.warped(np.abs(np.array(x)[:, None] - np.array(y)[None, :]), None)
            assert (got[pair]["cost"], got[pair]["steps"]) == (cost[-1, -1], steps[-1, -1]) and len(got[pair]["path"]) == steps[-1, -1]


@pytest.mark.parametrize("metric", ["l1", "l2", "cosine"])
def test_long_pairs_are_warped_by_diagonals(metric, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(D, "CELLS_AT_ONCE", 25)
    for n, m, band in ((1, 40, None), (40, 1, None), (23, 31, None), (31, 23, 3), (30, 30, 0), (12, 40, 1), (5, 90, 2), (90, 5, 2)):
        x, y = (rng.integers(-2, 3, (k, 2)).astype(float) for k in (n, m))
        cost, steps = D.warped(D.frame_distances(x, y, metric), band)
        long = D.LongPair(x, y, band, metric)
        got, path = long.warped(), long.path()
        assert got[0] == pytest.approx(cost[-1, -1])
        if metric != "cosine":  # there, sums of products are rounded otherwise
            assert got == (cost[-1, -1], steps[-1, -1])
        if np.isfinite(got[0]):
            assert len(path) == got[1] and path[0] == {"i": 0, "j": 0} and path[-1] == {"i": n - 1, "j": m - 1}
            assert all((b["i"] - a["i"], b["j"] - a["j"]) in {(1, 1), (1, 0), (0, 1)} for a, b in zip(path, path[1:], strict=False))
            assert sum(D.frame_distances(x[[s["i"]]], y[[s["j"]]], metric)[0, 0] for s in path) == pytest.approx(got[0])


def test_no_pair_is_left_out(spark):
    rng = np.random.default_rng(9)
    rows = [(0, [1.0, 2.0], [1.0, 2.0, 4.0]), (1, rng.integers(0, 9, 1100).astype(float).tolist(), rng.integers(0, 9, 1000).astype(float).tolist()), (2, None, [1.0]), (3, [0.0] * 101, [1.0] * 101), (4, [], [1.0])]
    df = spark.createDataFrame(rows, "pair bigint, x array<double>, y array<double>")
    for band in (None, 6):
        got = {r["pair"]: r for r in D.dtw_costs(df, band, None, "l1", True).collect()}
        cost, steps = D.warped(np.abs(np.array(rows[1][1])[:, None] - np.array(rows[1][2])[None, :]), band)
        assert sorted(got) == [0, 1, 2, 3, 4]
        assert (got[1]["cost"], got[1]["steps"], len(got[1]["path"])) == (cost[-1, -1], steps[-1, -1], steps[-1, -1])
        assert got[3]["cost"] == 101 and got[0]["cost"] == 2 and got[2]["cost"] is None and got[4]["cost"] == float("inf")
    part = {r["pair"]: r["cost"] for r in D.dtw_costs(df, None, 1_100_000).collect()}
    assert part == {r["pair"]: r["cost"] for r in D.dtw_costs(df, None).collect()}


def test_vectors_of_any_length_have_a_cost(spark, tmp_path):
    rows = [(k, [float((k * i) % 7) for i in range(n)]) for k, n in enumerate([64, 64, 101, 120])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["pair"]: r["cost"] for r in Q.d4_dtw(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2] and None not in got.values()


def test_texts_are_cut_in_bounded_slices(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "TEXT_AT_ONCE", 100)
    texts = [None, "", "x" * 250, *("y" * 30 for _ in range(10)), None]
    batch = pa.record_batch({"k": list(range(len(texts))), "t": pa.array(texts)})
    slices = list(D._bounded(batch, "t"))
    assert [k for piece in slices for k in piece.column("k").to_pylist()] == list(range(len(texts)))
    assert all(len(piece) == 1 or sum(len(t or "") for t in piece.column("t").to_pylist()) <= 100 for piece in slices)
    got = D.chunks(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", 4)
    assert got.dtypes == [("id", "int"), ("chunk", "int"), ("n_chunks", "int"), ("n_words", "int"), ("hard", "boolean"), ("part", "string")]
    assert sorted((r["id"], r["part"]) for r in got.collect()) == [(i, t) for i, t in enumerate(texts) if t]


def test_intervals_of_many_utterances(spark):
    words = spark.createDataFrame([(u, i, t, [t]) for u in ("u", "v", None, "w") for i, t in enumerate("ab")], "utt string, pos int, token string, phones array<string>")
    rows = [("u", 1, "b", 1.0, 3.0), ("u", 0, "a", 0.0, 1.0), (None, 0, "a", 0.0, 4.0), (None, 1, "b", None, 5.0), ("x", 0, "a", 0.0, 1.0)]
    spoken = spark.createDataFrame(rows, "utt string, pos int, label string, start double, end double")
    out = D.assign_intervals(words, spoken, (), ("a",), 2.0)
    assert out.dtypes == [("utt", "string"), ("pos", "bigint"), ("token", "string"), ("frames", "double")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan  # no pandas frame for each utterance
    got = {(r["utt"], r["pos"]): r["frames"] for r in out.collect()}
    assert {k: v for k, v in got.items() if v is not None and v == v} == {("u", 0): 2.0, ("u", 1): 4.0, (None, 0): 8.0} and len(got) == 8


def test_eligibility_makes_ids_once(spark):
    assert str(R.eligibility(F.col("t"), F.col("token_ids"), 2)).count("token_ids") == 1
    rows = [("x", None), ("Words that are said. ", list(range(3, 30))), ("Words that are said.", [2] * 20), ("Words that are said.", [3, None] * 10)]
    got = [r["reason"] for r in spark.createDataFrame(rows, "t string, ids array<int>").select(R.eligibility(F.col("t"), F.col("ids"), 2).alias("reason")).collect()]
    assert got == ["unfinished_punctuation", "en_length", "token_length_or_unknown", "token_length_or_unknown"]
