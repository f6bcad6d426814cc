"""Collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from wordmill.llm import common, phrases


def brute(rows, least, first):
    out = []
    for lang in sorted({lang or "und" for lang, _ in rows}):
        f, n = Counter(), 0
        for own, text in rows:
            if (own or "und") != lang:
                continue
            lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            longer = [f[q] for q in f if len(p) < len(q) and f[q] >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * x >= 80 * a for x in longer):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def rows_of(rng):
    rows = []
    for k in range(300):
        w = [rng.choice(["Red", "red", "blue", "é", "ü", "the", "of", "x\x00y"]) for _ in range(rng.randrange(1, 25))]
        if rng.random() < 0.4:
            w += ["new", "york", "city", "hall"][: rng.randrange(1, 5)] * rng.randrange(1, 3)
        text = "".join(x + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "\x0b", " "]) for x in w)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [("en", None), ("en", ""), (None, " . , "), ("fr", "only one"), ("en", "long " * 30_000)]


def test_collocations_match_brute_force(spark):
    rows = rows_of(random.Random(3))
    frame = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, word string, h0 int")
    for chunk_words, least, first in ((1_000_000, 30, 2000), (200, 5, 7)):
        got = sorted(tuple(r) for r in phrases.collocations(frame, least=least, first=first, chunk_words=chunk_words).collect())
        assert got == sorted(brute(rows, least, first))
    assert phrases.collocations(frame.limit(0)).collect() == []


def test_filter_takes_every_group_and_few_others(spark):
    rng = np.random.default_rng(1)
    inside, outside = rng.integers(-(2**62), 2**62, (2, 5000, 2))
    groups = spark.createDataFrame([tuple(map(int, r)) for r in inside], "h0 bigint, h1 bigint")
    held = phrases.Filter(groups, 2, bits=18)
    assert held.has(list(inside.T.copy())).all()
    assert held.has(list(outside.T.copy())).mean() < 0.01


def test_merge_join_keeps_to_pieces():
    places, items = np.array([0, 1, 2, 4, 5, 9]), np.arange(6).reshape(-1, 1)
    at, joined = phrases.merge_join(places, items)
    assert at.tolist() == [0, 1, 4] and joined.tolist() == [[0, 1], [1, 2], [3, 4]]


def test_a_task_holds_few_records_of_a_relation(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RECORD_BYTES", 1 << 20)
    frame = spark.createDataFrame([("en", f"{k} new york " * 20_000) for k in range(24)], "lang string, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with common.bytes_at_once(spark, 1 << 20):
        relation, _ = phrases._words(frame, "text", "lang", 30, 60_000)
        sizes = relation.select("place", "items").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint").collect()
    groups = [f.metadata.row_group(g) for path in relation.inputFiles() for f in [pq.ParquetFile(path.removeprefix("file://"))] for g in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == sum(r["n"] for r in sizes) == relation.count() == 24
    assert max(g.total_byte_size for g in groups) < 2 << 20 and max(g.num_rows for g in groups) < 12
    assert max(r["n"] for r in sizes) <= 3
    assert spark.conf.get(name) == before
