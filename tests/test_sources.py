"""Sources on small files."""

from __future__ import annotations

import json
import struct
from hashlib import sha256

import pytest

from wordmill.sources import readers as S
from wordmill.sources.files import FileFacts


def test_manifest_arity_and_bounds(spark):
    lines = ["a.wav|3|hello", "a.wav|0.5|1.5|timed", "a.wav|3|0.5|1.5|both", "a.wav|x|hello", "a.wav|3|-1|2|text", "a.wav|3|2|2|text", "one", "a.wav|3| "]
    rows = S.manifest(spark.createDataFrame([(x,) for x in lines], "value string"), True).collect()
    assert [r["error"] for r in rows] == [None, "fields", None, "speaker", "start", "end", "fields", "text"]
    assert (rows[2]["wav"], rows[2]["spk"], rows[2]["start"], rows[2]["end"], rows[2]["text"]) == ("a.wav", 3, 0.5, 1.5, "both")
    plain = S.manifest(spark.createDataFrame([("a.wav|hi",), ("a.wav|1|2|hi",)], "value string"), False).collect()
    assert [r["error"] for r in plain] == [None, None] and plain[1]["end"] == 2.0


def test_comments_and_text_manifest(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# note\n\nwav|4|1.5|hello\nplain\n7|hi\n")
    lines = S.real_lines(spark, str(tmp_path / "m.txt"))
    assert [(r["spk"], r["text"]) for r in S.text_manifest(lines, 9).collect()] == [(4, "hello"), (9, "plain"), (7, "hi")]


def test_tabular_is_sniffed(spark, tmp_path):
    for name, body in (("a", "x,y\n1,2\n"), ("b", "x\ty\n1\t2\n"), ("c", "x|y\n1|2\n"), ("d", json.dumps({"x": 1, "y": 2}) + "\n")):
        (tmp_path / name).write_text(body)
        df = S.tabular(spark, str(tmp_path / name))
        got = df.select(S.first_present(df.columns, ["z", "y"]).alias("v")).first()["v"]
        assert got == "2"


def test_encoded_rows(spark, tmp_path):
    rows = [{"phonemes": "a", "token_ids": [1, 2], "tone_ids": None}, {"token_ids": []}, {"token_ids": [1, 99]}, {"token_ids": [1], "tone_ids": [0, 1]}, {"token_ids": [1], "tone_ids": [9]}, {"token_ids": [1], "spk": 5}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    assert [r["error"] for r in S.encoded(spark, str(tmp_path / "e.jsonl"), 10, 6, [0, 1]).collect()] == [None, "empty", "token", "length", "tone", "speaker", "json"]


def test_two_line_records(spark, tmp_path):
    (tmp_path / "r.txt").write_text("001\thello there\n\tHH AH\n002\tno phones\n003\tlast\n\n")
    rows = {r["id"]: (r["text"], r["phones"]) for r in S.two_line_records(spark, str(tmp_path / "r.txt")).collect()}
    assert rows == {"001": ("hello there", "HH AH"), "002": ("no phones", None), "003": ("last", None)}


def test_alignment_intervals(spark, tmp_path):
    body = 'item [1]:\n name = "words"\n xmin = 0\n xmax = 1\n text = "w"\nitem [2]:\n name = "phones"\n' + "".join(f' xmin = {i}\n xmax = {i + 1}\n text = "{t}"\n' for i, t in enumerate(["sil", "a", "", "b"]))
    (tmp_path / "x.TextGrid").write_text(body)
    assert [(r["label"], r["start"], r["end"]) for r in S.alignment_intervals(spark, str(tmp_path)).orderBy("pos").collect()] == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]


def test_pronouncing_dictionary(spark):
    lines = [";;; note", "hello  HH AH0", "HELLO(2)\tHH EH0", "word(1)  W"]
    rows = S.pronouncing_dictionary(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["word"], r["variant"], r["phones"]) for r in rows] == [("HELLO", 0, ["HH", "AH0"]), ("HELLO", 2, ["HH", "EH0"]), ("WORD", 1, ["W"])]


def test_wave_headers_and_digests(spark, tmp_path):
    audio = b"RIFF" + struct.pack("<I", 36 + 8) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 24000, 48000, 2, 16) + b"data" + struct.pack("<I", 8) + b"\0" * 8
    (tmp_path / "a.wav").write_bytes(audio)
    (tmp_path / "b.wav").write_bytes(b"nothing")
    rows = sorted(S.wave_headers(spark, str(tmp_path)).collect(), key=lambda r: r["path"])
    assert (rows[0]["rate"], rows[0]["channels"], rows[0]["bits"], rows[0]["frames"], rows[1]["error"]) == (24000, 1, 16, 4, "header")
    assert S.content_digests(spark, str(tmp_path)).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", 1.23456789), ("val", float("nan"))], "split string, x double")
    S.write_splits(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).groupBy("split").count().count() == 2
    S.write_report(df, str(tmp_path / "r"), 3)
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv"))
    assert "train\t1.235" in text and "val\t\n" in text


def test_file_list_numbers_and_strict_mode(spark, tmp_path):
    body = ["# note", "", "a.wav|3|hi", "a.wav|x|hi", "b.wav|4|0.5|1|both", "broken"] + [f"w{i}.wav|1|t" for i in range(300)] + ["last"]
    (tmp_path / "m.txt").write_text("\n".join(body) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = S.file_list(spark, str(tmp_path / "m.txt")).orderBy("line").collect()
        with pytest.raises(ValueError, match="m.txt:4: speaker"):
            S.file_list(spark, str(tmp_path / "m.txt"), strict=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["line"], r["error"]) for r in rows if r["error"]] == [(4, "speaker"), (6, "fields"), (307, "fields")]
    assert (rows[2]["line"], rows[2]["wav"], rows[2]["spk"], rows[2]["tail"]) == (5, "b.wav", 4, "0.5|1|both") and rows[250]["line"] == 253 and len(rows) == 305


def test_chunk_plan_round_trip(spark, tmp_path):
    rows = [(1, 1, 0, 2, 5, False, 'say "a b', "whole text"), (2, 1, 1, 2, 4, True, " c", None)]
    S.write_chunk_plan(spark.createDataFrame(rows, "synth_line bigint, orig_line bigint, chunk_idx bigint, n_chunks bigint, n_tokens bigint, had_hard_split boolean, text string, orig_text string"), str(tmp_path / "p"))
    got = S.chunk_plan(spark, str(tmp_path / "p")).orderBy("synth_line").collect()
    assert [tuple(r)[:8] for r in got] == rows and all(r["error"] is None for r in got)
    (tmp_path / "q.tsv").write_text("\t".join(S.PLAN[:7]) + "\n1\t1\t0\t1\t3\t0\ta\tb\n1\t1\t0\n1\tx\t0\t1\t3\t0\ta\n\n")
    got = S.chunk_plan(spark, str(tmp_path / "q.tsv")).collect()
    assert [(r["text"], r["orig_text"], r["error"]) for r in got] == [("a\tb", None, None), (None, None, "fields"), (None, None, "number")]


def test_split_lists(spark, tmp_path):
    S.write_split_lists(spark.createDataFrame([("val", 1, "a|b\nc"), ("train", 2, None)], "split string, k int, t string"), str(tmp_path / "l"), ["k", "t"])
    assert {(r["split"], r["value"]) for r in spark.read.text(str(tmp_path / "l")).collect()} == {("val", "1|a b c"), ("train", "2|")}


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def wave(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wave_facts_walk_chunks(spark, tmp_path):
    form = chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, 16000, 64000, 4, 16))
    data = chunk(b"data", b"\1" * 40)
    files = {
        "plain": (wave(form, data), (16000, 2, 16, 10, None)),
        "list_first": (wave(chunk(b"LIST", b"INFO" + b"x" * 6_001), form, data), (16000, 2, 16, 10, None)),
        "large_header": (wave(form, chunk(b"JUNK", b"\0" * 6_000_001), data), (16000, 2, 16, 10, None)),
        "word_inside": (wave(form, chunk(b"LIST", b"metadata fmt data" + struct.pack("<I", 9)), data), (16000, 2, 16, 10, None)),
        "data_first": (wave(data, form), (16000, 2, 16, 10, None)),
        "extended": (wave(chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8) + b"\0\0"), chunk(b"data", b"\1" * 7)), (8000, 1, 8, 7, None)),
        "unfinished": (wave(form) + b"data" + struct.pack("<I", 0xFFFFFFFF) + b"\1" * 16, (16000, 2, 16, 4, None)),
        "no_data": (wave(form), (None, None, None, None, "data")),
        "no_form": (wave(data), (None, None, None, None, "fmt")),
        "zero_block": (wave(chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 8000, 0, 8)), data), (None, None, None, None, "block")),
        "not_riff": (b"OggS" + b"\0" * 40, (None, None, None, None, "header")),
        "empty": (b"", (None, None, None, None, "header")),
    }
    for name, (body, _) in files.items():
        (tmp_path / f"{name}.wav").write_bytes(body)
    want = {f"{name}.wav": facts for name, (_, facts) in files.items()}
    spark.dataSource.register(FileFacts)
    source = spark.read.format("file_facts").option("files", 5).load(str(tmp_path))
    assert source.rdd.getNumPartitions() == 3
    assert {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in source.collect()} == want
    whole = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in S.wave_headers(spark, str(tmp_path)).collect()}
    assert whole == {name: facts for name, facts in want.items() if name != "empty.wav"}
    digests = spark.read.format("file_facts").option("kind", "sha256").load(str(tmp_path)).collect()
    assert {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in digests} == {f"{n}.wav": (len(b), sha256(b).hexdigest()) for n, (b, _) in files.items()}


def test_two_line_records_of_many_blocks(spark, tmp_path):
    lines, want = [], {}
    for i in range(3000):
        lines.append(f"{i:05d}\ttext {i}")
        if i % 7:
            lines.append(f"\tP{i} Q")
        want[f"{i:05d}"] = f"P{i} Q" if i % 7 else None
    (tmp_path / "r.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1k", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = S.two_line_records(spark, str(tmp_path / "r.txt")).collect()
        assert len(rows) == 3000 and {r["id"]: r["phones"] for r in rows} == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stat_table(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("token\tcount\tmean\na\t50\t1.5\nb\t3\t2\n\t60\t1\nc\t70\tx\n")
    rows = {r["token"]: (r["count"], r["mean"], r["error"]) for r in S.stat_table(spark, str(tmp_path / "t.tsv"), ["count", "mean"], least=20).collect()}
    assert rows == {"a": (50.0, 1.5, None), "b": (3.0, 2.0, "few"), None: (60.0, 1.0, "token"), "c": (70.0, None, "mean")}
    with pytest.raises(ValueError, match="p99"):
        S.stat_table(spark, str(tmp_path / "t.tsv"), ["count", "p99"])
