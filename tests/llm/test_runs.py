"""Periodic runs against brute force."""

from __future__ import annotations

import random
import re
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import pytest

from wordmill.llm import queries, runs


def brute_runs(w, least=24, times=3):
    n, out = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            s = w[i : i + length]
            if length >= max(least, times * q) and not any(all(s[t] == s[t + p] for t in range(length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_with_runs(rng):
    letters, w = "abcd"[: rng.choice([1, 2, 3, 4])], []
    for _ in range(rng.randrange(8)):
        if rng.random() < 0.5:
            w += ([rng.choice(letters) for _ in range(rng.randrange(1, 12))] * 40)[: rng.randrange(1, 90)]
        else:
            w += [rng.choice(letters) for _ in range(rng.randrange(1, 30))]
    return w


@pytest.mark.parametrize(("least", "times"), [(24, 3), (10, 2), (6, 4), (3, 2)])
def test_runs_match_brute_force(least, times):
    rng = random.Random(least)
    texts = [words_with_runs(rng) for _ in range(150)]
    assert runs.runs_of(texts, least, times) == [brute_runs(w, least, times) for w in texts]


def test_very_long_texts():
    assert runs.runs_of([["long"] * 30_000]) == [[(0, 30_000, 1)]]
    rng = random.Random(0)
    once = [str(rng.randrange(10**6)) for _ in range(3_000)]
    assert runs.runs_of([once * 8, once]) == [[(0, 24_000, 3_000)], []]
    boilerplate = [x for i in range(4_000) for x in ["b", "o", "i", "l"] * 5 + [str(i)]]
    assert runs.runs_of([boilerplate]) == [[]]


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and (h := crc32(str(doc_id).encode())) % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    rest = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *numbers, sha256(lines.encode()).hexdigest(), sha256(rest.encode()).hexdigest())


def test_digests_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(words_with_runs(rng)), "x", 0) for i in range(300)]
    rows += [(None, "tick tock " * 20, "x", 0), (300, None, None, None), (301, "", "x", 0), (302, " \n\t", "x", 0), (7, rows[7][1], "x", 0), (2**60 + 1, "é ü ß " * 40, "x", 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, start int")
    got = [tuple(r) for r in runs.digests(frame, change=queries.planted).collect()]
    key = repr
    assert sorted(got, key=key) == sorted((brute_row(i, t) for i, t, *_ in rows), key=key)
    empty = runs.digests(frame.limit(0)).collect()
    assert empty == []


def test_spans_and_collapsed_text(spark):
    frame = spark.createDataFrame([("a", "so " + "he said " * 15 + "no")], "key string, body string")
    row = runs.period_runs(frame, "key", "body").first()
    assert [tuple(r) for r in row["runs"]] == [(1, 30, 2)] and row["collapsed"] == "so he said no" and row["key"] == "a"
