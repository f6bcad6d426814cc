"""The Jaccard join against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from wordmill.llm import jaccard


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text):
    w = words_of(text)
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} or ({" ".join(w)} if w else set())


def brute_groups(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)] = min(key, ids.get(find(i), key))
    return [(key, len(sets[i]), ids.get(find(i))) for i, (key, _) in enumerate(rows)]


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.5:
            words[at] = f"new{rng.randrange(1000)}"
        elif kind < 0.75:
            words.insert(at, f"more{rng.randrange(1000)}")
        else:
            del words[at]
    return words


@pytest.mark.parametrize("percent", [60, 80, 90, 97])
def test_linked_sets_share_a_region(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        pool = np.unique(rng.integers(0, 1 << 63, n + 200, dtype=np.uint64))
        rng.shuffle(pool)
        out, more = int(rng.integers(0, n // 6 + 2)), int(rng.integers(0, n // 6 + 2))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[min(out, n) : n], pool[n : n + more]]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
            assert np.intersect1d(jaccard.part_keys(a, percent), jaccard.part_keys(b, percent)).size


def test_groups_match_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([8, 12, 30, 120, 300]))] for _ in range(20)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    rows = [(None, "some words here and there"), (None, "some words here and there"), (1, None), (2, ""), (3, " \n\t "), (4, "tie"), (4, "tie"), (5, "Tie"), (6, "two words"), (7, "É ß ünï\x1ccode"), (8, "long " * 30_000)]
    rows += [(10 + k, " ".join(edited(rng, rng.choice(base), rng.randrange(0, 6)))) for k in range(250)]
    rows += [(300 + k, " ".join([rng.choice(vocabulary) for _ in range(20)] + passage)) for k in range(40)]
    chain = list(base[3] * 3)
    for k in range(60):
        rows.append((400 + (k * 37) % 61, " ".join(chain)))
        chain = edited(rng, chain, 2)
    frame = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "doc_id bigint, text string, node string, s0 string")
    got = sorted(map(repr, (tuple(r) for r in jaccard.jaccard_groups(frame).collect())))
    assert got == sorted(map(repr, brute_groups(rows)))


def test_large_regions_split_and_end(spark):
    """More than LEAF different texts that agree in parts: several families at middling distances, none of them one group."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    families = [edited(rng, base, 9) for _ in range(8)]
    rows = [(k, " ".join(edited(rng, families[k % 8], rng.randrange(0, 7)))) for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for leaf in (jaccard.LEAF, 10):
        found = {tuple(r) for r in jaccard.jaccard_groups(frame, leaf=leaf).collect()}
        assert found == set(brute_groups(rows)) and len({c for _, _, c in found}) > 8


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) * np.uint64(2)
        a, b = pool[: rng.integers(1, 300)], pool[rng.integers(0, 200) :]
        assert sum(int(x).bit_count() for x in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_empty_and_unlinked_tables(spark):
    frame = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "doc_id bigint, text string")
    assert jaccard.jaccard_groups(frame.limit(0)).collect() == []
    assert sorted(tuple(r) for r in jaccard.jaccard_groups(frame).collect()) == [(1, 1, 1), (2, 1, 2)]
    with pytest.raises(ValueError):
        jaccard.jaccard_groups(frame, percent=10)
