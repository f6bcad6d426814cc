"""Streaming jobs over files that arrive one by one."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wordmill.streaming import jobs

T0 = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def _only_batches_with_rows(spark):
    """Timers by processing time ask for batch after batch, so a run over what is there would never end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def ran(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(60)
    return df.sparkSession.table(name).collect()


def files(spark, path, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_state_machine(spark, tmp_path):
    schema = "candidate bigint, state string, ts timestamp"
    at = [T0 + timedelta(minutes=i) for i in range(9)]
    legal = [(1, s, t) for s, t in zip(("queued", "synthesizing", "synthesized", "asr", "done", "passed"), at, strict=False)]
    files(spark, tmp_path, schema, legal, [(2, "queued", at[0]), (2, "done", at[1])])
    out = ran(jobs.candidate_states(jobs.stream(spark, str(tmp_path), schema), 60_000), "states")
    assert {(r["candidate"], r["state"]) for r in out if not r["legal"]} == {(2, "done")}
    last = {r["candidate"]: r["state"] for r in sorted((r for r in out if r["legal"]), key=lambda r: r["ts"])}
    twin = jobs.last_states(spark.read.schema(schema).parquet(str(tmp_path)).where("candidate = 1")).first()
    assert last == {1: "passed", 2: "queued"} and twin["state"] == last[1]


def stepwise(df, path, folder, schema, name, *batches):
    """What a stream gives batch by batch, started anew from its checkpoint for each of them."""
    out = []
    for number, rows in enumerate(batches):
        files(df.sparkSession, path, schema, rows)
        query = df.writeStream.foreachBatch(lambda part, _: out.extend(part.collect())).option("checkpointLocation", str(folder)).outputMode("append").trigger(availableNow=True).queryName(f"{name}{number}").start()
        query.awaitTermination(60)
        assert query.exception() is None
    return out


def test_round_winners_survive_restarts_and_repeats(spark, tmp_path):
    schema = "text bigint, candidate bigint, expected int, passed boolean, score double"
    path = tmp_path / "in"
    files(spark, path, schema, [(9, 1, 2, True, 0.5)])
    df = jobs.round_winners(jobs.stream(spark, str(path), schema, 10))
    out = stepwise(
        df, path, tmp_path / "cp", schema, "rounds",
        [(1, 5, 4, True, 0.5), (1, 5, 4, True, 0.5), (1, 4, 4, True, 0.5), (2, 1, 1, False, 0.9), (3, 8, 2, True, 0.1), (3, 8, 2, True, 0.1)],
        [(1, 5, 4, True, 0.5), (1, 9, 4, False, 2.0), (1, 2, 4, True, 1.0), (2, 1, 1, True, 1.0)],
        [(3, 8, 2, True, 0.1), (3, 7, 2, True, 0.1)],
    )
    assert sorted((r["text"], r["winner"], r["retry"]) for r in out) == [(1, 2, False), (2, None, True), (3, 7, False)]


def test_rounds_equal_their_batch_twin(spark, tmp_path):
    schema = "text bigint, candidate bigint, expected int, passed boolean, score double"
    rows = [(t, c, 4, (t + c) % 3 > 0 and t % 5 > 0, float((t * c) % 4)) for t in range(40) for c in range(3 + t % 2)]
    files(spark, tmp_path / "in", schema, rows, rows[:50])
    streamed = ran(jobs.round_winners(jobs.stream(spark, str(tmp_path / "in"), schema, 1)), "twin_rounds")
    batch = jobs.ended_rounds(spark.read.schema(schema).parquet(str(tmp_path / "in")))
    assert sorted(map(repr, map(tuple, streamed))) == sorted(map(repr, map(tuple, batch.collect()))) and len(streamed) == 20


def test_ended_lease_sends_back_and_violations_are_kept(spark, tmp_path):
    schema = "candidate bigint, state string, ts timestamp"
    path = tmp_path / "in"
    files(spark, path, schema, [(1, "queued", T0), (1, "synthesizing", T0 + timedelta(minutes=1)), (2, "done", T0)])
    steps = jobs.candidate_states(jobs.stream(spark, str(path), schema), 1)
    for more in ([(3, "queued", T0)], [(1, "synthesizing", T0 + timedelta(minutes=2)), (1, "synthesized", T0 + timedelta(minutes=3))]):
        query = jobs.recorded(steps, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        files(spark, path, schema, more)
        time.sleep(0.1)
    query = jobs.recorded(steps, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    legal = {(r["candidate"], r["state"]) for r in spark.read.parquet(str(tmp_path / "out" / "steps")).collect()}
    assert {(1, "queued"), (1, "synthesizing"), (3, "queued")} <= legal
    back = spark.read.parquet(str(tmp_path / "out" / "steps")).where("candidate = 1 and state = 'queued' and ts is null").count()
    assert back >= 1
    assert {(r["candidate"], r["state"]) for r in spark.read.parquet(str(tmp_path / "out" / "violations")).collect()} == {(2, "done")}


def test_advanced(spark, tmp_path):
    schema = "key bigint, step bigint"
    files(spark, tmp_path, schema, [(1, 10), (1, 14), (1, 25), (2, 3)])
    assert {(r["key"], r["step"]) for r in ran(jobs.advanced(jobs.stream(spark, str(tmp_path), schema), 10), "advanced")} == {(1, 10), (1, 25), (2, 3)}


def test_windows_equal_their_batch_twin(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, event_type string"
    rows = [(i, T0 + timedelta(minutes=i), "ab"[i % 2]) for i in range(60)]
    files(spark, tmp_path, schema, rows)
    batch = jobs.status_windows(spark.read.schema(schema).parquet(str(tmp_path)))
    streamed = ran(jobs.status_windows(jobs.stream(spark, str(tmp_path), schema)), "windows", "complete")
    assert {tuple(r) for r in streamed} == {tuple(r) for r in batch.collect()}
    counts = ran(jobs.progress(jobs.stream(spark, str(tmp_path), schema)), "progress", "complete")
    assert {(r["event_type"], r["n"]) for r in counts} == {("a", 30), ("b", 30)}


def test_admission(spark, tmp_path):
    schema = "key string, ts timestamp"
    files(spark, tmp_path / "in", schema, [("a", T0), ("b", T0), ("a", T0)], [("c", T0 + timedelta(minutes=1)), ("b", T0 + timedelta(minutes=1))])
    excluded = spark.createDataFrame([("b",)], "key string")
    query = jobs.admit(jobs.stream(spark, str(tmp_path / "in"), schema), excluded, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("key")).collect()) == ["a", "c"]


def test_admission_keeps_near_copies_out(spark, tmp_path):
    schema = "key string, ts timestamp"
    held, base = "thequickbrownfoxjumpsoverthedog", "theharbourmasterkeptalongledger"
    chain = [base, base[:-2] + "xx", base[:-4] + "yyxx"]  # each is near the next, the first not near the last
    files(spark, tmp_path / "in", schema, [(held[:-1] + "s", T0), *((k, T0) for k in chain), ("short", T0)], [(base[:-1] + "q", T0 + timedelta(minutes=1)), ("anothersentencealtogether", T0 + timedelta(minutes=1))])
    excluded = spark.createDataFrame([(held,)], "key string")
    query = jobs.admit(jobs.stream(spark, str(tmp_path / "in"), schema), excluded, str(tmp_path / "out"), str(tmp_path / "cp"), 88.0).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"short", "anothersentencealtogether", chain[0], chain[2]}


def test_advanced_rows_equal_the_stream(spark, tmp_path):
    rows = [(k, s) for k in (1, 2) for s in range(k, 400, 7)] + [(3, 5), (3, 5), (None, 1), (4, None)]
    want, last = set(), {}
    for k, s in sorted(r for r in rows if None not in r):
        if k not in last or s >= last[k] + 50:
            last[k] = s
            want.add((k, s))
    assert sorted(tuple(r) for r in jobs.advanced_rows(spark.createDataFrame(rows, "key bigint, step bigint"), 50).collect()) == sorted(want)


def test_quotas_are_followed_and_the_flag_is_written_once(spark, tmp_path):
    schema = "split string, language string, seconds double"
    quotas = spark.createDataFrame([("train", "en", 10.0), ("train", "de", 5.0)], "split string, language string, target double")
    path, out = tmp_path / "in", str(tmp_path / "out")
    flags, reports = [], []
    for rows in ([("train", "en", 6.0)], [("train", "en", 6.0), ("val", "en", 1.0)], [("train", "de", 5.0)], [("train", "de", 9.0)]):
        files(spark, path, schema, rows)
        query = jobs.follow_quotas(jobs.stream(spark, str(path), schema), quotas, ["split", "language"], out, str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        reports.append({(r["language"], r["seconds"], r["missing"], r["complete"]) for r in spark.read.parquet(f"{out}/report").collect()})
        flags.append([r["batch"] for r in spark.read.parquet(f"{out}/ready").collect()] if (tmp_path / "out" / "ready").exists() else None)
    assert reports[0] == {("en", 6.0, 4.0, False), ("de", 0.0, 5.0, False)} and reports[1] == {("en", 12.0, 0.0, True), ("de", 0.0, 5.0, False)}
    assert reports[3] == {("en", 12.0, 0.0, True), ("de", 14.0, 0.0, True)}
    assert flags[:2] == [None, None] and len(flags[2]) == 1 and flags[3] == flags[2]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    schema = "event_id bigint, ts timestamp, event_type string"
    files(spark, tmp_path, schema, [(1, T0 + timedelta(hours=2), "a")], [(2, T0 + timedelta(hours=3), "a")], [(3, T0, "a"), (4, T0 + timedelta(hours=3), "a")])
    df = jobs.status_windows(jobs.stream(spark, str(tmp_path), schema))
    query = df.writeStream.format("memory").queryName("late_rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert jobs.dropped_late(query) == 1
    assert all(r["start"] > T0 for r in spark.table("late_rows").collect())
