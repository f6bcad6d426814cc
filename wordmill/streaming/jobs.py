"""Structured Streaming jobs over candidate events, with the batch twins that they must agree with."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.joins import near_matches
from ..operators.windows import fixed

#: Order of a candidate's states; a step may go one state on, or end.
STATES = ("queued", "synthesizing", "synthesized", "asr", "done", "passed", "rejected")
LEGAL = {"queued": {"synthesizing"}, "synthesizing": {"synthesized", "queued"}, "synthesized": {"asr"}, "asr": {"done", "synthesized"}, "done": {"passed", "rejected"}}
#: States in which a worker holds a candidate, and what it goes back to when the lease ends.
LEASED = {"synthesizing": "queued", "asr": "synthesized"}
WATERMARK = "10 minutes"
DAY = 86_400_000


def stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of Parquet files as they arrive; how many at once replaces a cap on outstanding work."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def status_windows(events: DataFrame, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events by window and type; as a stream, later rows than the watermark allows are dropped and counted by Spark."""
    rows = events.withWatermark("ts", WATERMARK) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of a user that end with a gap of inactivity."""
    rows = events.withWatermark("ts", WATERMARK) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def progress(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def _keeps_state(rows: DataFrame) -> None:
    """Typed state with time to live needs the RocksDB store; a session that names another keeps it for its other queries."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class CandidateSteps(StatefulProcessor):
    """The state of one candidate: where it is, and until when it is leased."""

    def __init__(self, lease: int, keep: int) -> None:
        self.lease, self.keep = lease, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, due bigint", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, due = self.now.get() or (None, None)
        out = []
        whole = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for ts, new in zip(whole["ts"], whole["state"], strict=True):
            legal = (now is None and new == "queued") or new in LEGAL.get(now, ())
            now = new if legal else now
            out.append((key[0], new, legal, ts))
        if now is not None:
            if due is not None:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.lease if now in LEASED else None
            if due is not None:
                self.handle.registerTimer(due)
            self.now.update((now, due))
        yield pd.DataFrame(out, columns=["candidate", "state", "legal", "ts"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, due = self.now.get() or (None, None)
        if now in LEASED and due == expiredTimerInfo.getExpiryTimeInMs():
            self.now.update((LEASED[now], None))
            yield pd.DataFrame({"candidate": [key[0]], "state": [LEASED[now]], "legal": [True], "ts": [pd.NaT]}).astype({"ts": "datetime64[us]"})


def candidate_states(events: DataFrame, lease: int, keep: int = 7 * DAY) -> DataFrame:
    """(candidate, state, legal, ts) for every event (candidate, state, ts) of a stream, kept per candidate.

    A step that LEGAL doesn't know is emitted with legal false and changes nothing. A candidate whose worker is
    silent for `lease` milliseconds of processing time in a state of LEASED goes back to the state before.
    A candidate without events for `keep` milliseconds leaves the state, ended ones too.
    """
    _keeps_state(events)
    return events.groupBy("candidate").transformWithStateInPandas(
        CandidateSteps(lease, keep), "candidate bigint, state string, legal boolean, ts timestamp", "append", "processingTime"
    )


def recorded(steps: DataFrame, path: str, checkpoint: str):
    """Writes the legal steps of candidate_states() to path/steps and the others to path/violations, once for each micro-batch, however often it is tried."""

    def write(batch: DataFrame, number: int) -> None:
        for name, part in (("steps", batch.where("legal")), ("violations", batch.where("not legal"))):
            rows = part.drop("legal").withColumn("batch", F.lit(number))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")

    return steps.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def last_states(events: DataFrame) -> DataFrame:
    """The batch twin where all steps are legal: the last state of each candidate."""
    return events.groupBy("candidate").agg(F.max_by("state", "ts").alias("state"))


class Rounds(StatefulProcessor):
    """The ended candidates of one text's round, and whether it is decided."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ended = handle.getMapState("ended", "candidate bigint", "passed boolean, score double", self.keep)
        self.decided = handle.getValueState("decided", "winner bigint", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if self.decided.exists():
            return
        expected = 0
        for batch in rows:
            for candidate, wanted, passed, score in zip(batch["candidate"], batch["expected"], batch["passed"], batch["score"], strict=True):
                expected = max(expected, int(wanted))
                if not self.ended.containsKey((int(candidate),)):  # a repeated delivery is one candidate
                    self.ended.updateValue((int(candidate),), (bool(passed), float(score)))
        found = [(candidate, passed, score) for (candidate,), (passed, score) in self.ended.iterator()]
        if len(found) < expected:
            return
        best = min(((-score, candidate) for candidate, passed, score in found if passed), default=None)
        winner = None if best is None else best[1]
        self.decided.update((-1 if winner is None else winner,))
        self.ended.clear()
        yield pd.DataFrame({"text": [key[0]], "winner": pd.array([winner], dtype="Int64"), "retry": [winner is None]})


def round_winners(events: DataFrame, keep: int = DAY) -> DataFrame:
    """(text, winner, retry) as rounds finish: events (text, candidate, expected, passed, score) of a stream.

    Once `expected` different candidates of a text have ended, the best passed one wins, ties to the smaller
    id; without one the text asks for a retry. A candidate that is delivered again counts once, with what it
    brought first. Events after the decision change nothing; the candidates leave the state with it, the
    decision itself after `keep` milliseconds.
    """
    _keeps_state(events)
    return events.groupBy("text").transformWithStateInPandas(Rounds(keep), "text bigint, winner bigint, retry boolean", "append", "processingTime")


def ended_rounds(events: DataFrame) -> DataFrame:
    """The batch twin of round_winners(): each text whose candidates have all ended, its winner, and whether it asks for a retry."""
    once = events.groupBy("text", "candidate").agg(F.max("expected").alias("expected"), F.max(F.struct("passed", "score")).alias("s"))
    best = F.min_by("candidate", F.when(F.col("s.passed"), F.struct(-F.col("s.score"), "candidate")))
    rounds = once.groupBy("text").agg(F.max("expected").alias("expected"), F.count("*").alias("ended"), F.max("s.passed").alias("any"), best.alias("best"))
    return rounds.where("ended >= expected").select("text", F.when(F.col("any"), F.col("best")).alias("winner"), (~F.col("any")).alias("retry"))


def advanced(events: DataFrame, every: int) -> DataFrame:
    """(key, step) of events that are at least `every` steps past the last one emitted for the key, in order."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for number in sorted(int(n) for rows in batches for n in rows["step"]):
            if last is None or number >= last + every:
                last = number
                yield pd.DataFrame({"key": [key[0]], "step": [number]})
        if last is not None:
            state.update((last,))

    return events.groupBy("key").applyInPandasWithState(step, "key bigint, step bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def advanced_rows(events: DataFrame, every: int) -> DataFrame:
    """The batch twin of advanced(): each key's steps in order, those at least `every` past the last one kept.

    Sorted partitions are walked with the last kept step as the only state, so a key of any size fits.
    """
    kind = events.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = object(), None
        for rows in batches:
            keys, steps = rows["key"].tolist(), rows["step"].tolist()
            kept = []
            for at, (key, step) in enumerate(zip(keys, steps, strict=True)):
                if key != now:
                    now, last = key, None
                if last is None or step >= last + every:
                    last = step
                    kept.append(at)
            yield rows.iloc[kept]

    whole = events.where("key is not null and step is not null").select("key", F.col("step").cast("bigint").alias("step"))
    return whole.repartition("key").sortWithinPartitions("key", "step").mapInPandas(run, f"key {kind}, step bigint")


def near_admitted(fresh: DataFrame, held: DataFrame, ratio: float) -> DataFrame:
    """Rows of fresh (key, ...) whose key is near none of held (key) and none of fresh that stays itself.

    Keys of fresh are judged in their order: one that is near an earlier one goes if that one stays.
    """
    def named(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(F.col("key").alias(f"{side}id"), F.col("key").alias(f"{side}key"))

    close = near_matches(named(held, "l"), named(fresh, "r"), ratio).select(F.col("rid").alias("key")).distinct()
    left = fixed(fresh.join(close, "key", "left_anti"))
    pairs = fixed(near_matches(named(left, "l"), named(left, "r"), ratio).where("lid < rid").select("lid", "rid"))
    while not pairs.isEmpty():  # the smallest key of all pairs is decided in every round, and all others without an earlier neighbour
        stay = pairs.select("lid").distinct().join(pairs.select(F.col("rid").alias("lid")), "lid", "left_anti")
        gone = fixed(pairs.join(stay, "lid", "left_semi").select("rid").distinct())
        left = fixed(left.join(gone.withColumnRenamed("rid", "key"), "key", "left_anti"))
        open_pairs = pairs.join(stay, "lid", "left_anti").join(gone, "rid", "left_anti")
        pairs = fixed(open_pairs.join(gone.withColumnRenamed("rid", "lid"), "lid", "left_anti").select("lid", "rid"))
    return left


def admit(texts: DataFrame, excluded: DataFrame, path: str, checkpoint: str, ratio: float | None = None):
    """Writes texts (key, ts, ...) of a stream once per key and none that is excluded; each micro-batch also drains against what is there.

    With a ratio, as near_matches() takes it, keys that are near an excluded or admitted one stay out as well.
    """
    once = texts.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["key"])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh, held = batch.join(excluded, "key", "left_anti"), excluded.select("key")
        if _there(spark, path):  # the first batch finds no table
            there = spark.read.schema("key string, batch bigint").parquet(path).where(F.col("batch") != number).select("key")
            fresh, held = fresh.join(there, "key", "left_anti"), held.unionByName(there)
        if ratio is not None:
            fresh = near_admitted(fixed(fresh), held, ratio)
        fresh.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def quota_state(totals: DataFrame, quotas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, target, seconds, n, missing, complete) of every quota, what nothing was accepted for included."""
    rows = quotas.join(totals, list(keys), "left").withColumns({"seconds": F.coalesce("seconds", F.lit(0.0)), "n": F.coalesce("n", F.lit(0))})
    missing = F.greatest(F.col("target") - F.col("seconds"), F.lit(0.0))
    return rows.select(*keys, "target", "seconds", "n", missing.alias("missing"), (F.col("seconds") >= F.col("target")).alias("complete"))


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def follow_quotas(accepted: DataFrame, quotas: DataFrame, keys: Sequence[str], path: str, checkpoint: str):
    """Keeps path/report, the state of all quotas (keys, target) over a stream accepted (keys, seconds), and writes path/ready once.

    Every micro-batch replaces the report by what has been accepted so far. When all quotas are complete for
    the first time path/ready gets the number of that batch; it is written after the report, so it never speaks of an older one.
    """
    totals = accepted.groupBy(*keys).agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        quota_state(batch, quotas, keys).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/report")
        if not _there(spark, f"{path}/ready/_SUCCESS") and spark.read.parquet(f"{path}/report").where("not complete").isEmpty():
            spark.range(1).select(F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{path}/ready")

    return totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)


def dropped_late(query: StreamingQuery) -> int:
    """How many rows a query's windows have dropped as later than the watermark allows, over all progress that it still holds."""
    return sum(int(op["numRowsDroppedByWatermark"]) for progress in query.recentProgress for op in progress["stateOperators"])
