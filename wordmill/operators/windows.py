"""Ordered work: running sums over all rows, quotas, batches, renumbering, islands."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a table of groups that is broadcast, at most.
FEW_GROUPS = 10_000
#: Fixed value: digits of a hash that part a group into buckets.
BUCKET_DIGITS = 3


def hash_order(*parts: Column, seed: str = "0") -> Column:
    """A stable random order: the sha256 of a seed and a key, never rand()."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts)), 256)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, spark.checkpoint.dir.

    Where a session on one machine names none, a new local one is set; on a cluster, where no executor could
    read it, that is an error.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wordmill-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def fixed(rows: DataFrame) -> DataFrame:
    """rows written to the checkpoint folder, as columns: all that follows sees the same ones, reads those it needs, and survives lost executors."""
    path = f"{shared_folder(rows.sparkSession)}/fixed-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def global_running_sum(rows: DataFrame, order: Sequence[str], value: str, into: str) -> DataFrame:
    """rows with the running sum of an integer value over a total order of all rows.

    Rows are dealt by ranges of the order; each range sums up on its own and starts from the sum of
    those before it. Only one number per range comes to the driver, and no window spans all rows.
    """
    ranges = fixed(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))  # both passes must see the same ranges
    sums = sorted((r["range_"], r["s"] or 0) for r in ranges.groupBy("range_").agg(F.sum(value).alias("s")).collect())
    if not sums:
        return rows.withColumn(into, F.lit(0).cast("bigint"))
    before = zip((n for n, _ in sums), accumulate((s for _, s in sums), initial=0), strict=False)
    starts = rows.sparkSession.createDataFrame(list(before), "range_ int, start_ bigint")
    by = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = ranges.withColumn(into, F.sum(value).over(by)).join(F.broadcast(starts), "range_")  # one row for each range
    return met.withColumn(into, (F.col(into) + F.col("start_")).cast("bigint")).drop("range_", "start_")


def running_in_groups(rows: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, into: str) -> DataFrame:
    """rows with the running sum of an integer value within their group, and the group's sum as total_.

    A group may hold any share of the rows: it is cut into ranges of the order, as global_running_sum()
    does for all rows. Null group keys are a group. The table of groups is broadcast up to FEW_GROUPS rows.
    """
    totals = rows.groupBy(*groups).agg(F.sum(value).cast("bigint").alias("total_"))
    ends = fixed(global_running_sum(totals, groups, "total_", "end_"))
    starts = ends.select(*(F.col(g).alias(f"{g}_of_") for g in groups), "total_", (F.col("end_") - F.col("total_")).alias("before_"))
    starts = F.broadcast(starts) if ends.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else starts
    summed = global_running_sum(rows, [*groups, *order], value, into)
    same = [F.col(g).eqNullSafe(F.col(f"{g}_of_")) for g in groups]
    return summed.join(starts, same).withColumn(into, F.col(into) - F.col("before_")).drop("before_", *(f"{g}_of_" for g in groups))


def lagged(rows: DataFrame, groups: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """rows with the values that columns names from the row before in the group, null for its first row.

    A group may hold any share of the rows: they are dealt by ranges of (groups, order), each range looks back
    within itself, and its first row looks at the last row of the range before. One row per range comes to the driver.
    columns maps names to new names; order must leave no ties that matter. Null group keys are a group.
    """
    ranges = fixed(rows.repartitionByRange(*groups, *order).withColumn("range_", F.spark_partition_id()))
    own = [*groups, *columns]
    place = F.struct(*(F.struct(F.col(c).isNotNull().alias("is"), F.col(c).alias("v")) for c in [*groups, *order]))  # nulls come first, as they are sorted
    ends = ranges.groupBy("range_").agg(F.max_by(F.struct(*own), place).alias("end_")).orderBy("range_").collect()
    by = Window.partitionBy("range_").orderBy(*groups, *order)
    before = F.lag(F.struct(*own)).over(by)
    kind = ranges.select(F.struct(*own).alias("end_")).schema["end_"].dataType.simpleString()
    shifted = [(b["range_"], a["end_"]) for a, b in zip(ends, ends[1:], strict=False)]
    earlier = rows.sparkSession.createDataFrame(shifted, f"range_ int, end_ {kind}")
    met = ranges.withColumn("before_", before).join(F.broadcast(earlier), "range_", "left")  # one row for each range
    met = met.withColumn("before_", F.coalesce("before_", "end_"))
    same = [F.col(f"before_.{g}").eqNullSafe(F.col(g)) for g in groups]
    inside = F.col("before_").isNotNull()
    for s in same:
        inside = inside & s
    return met.select(*rows.columns, *(F.when(inside, F.col(f"before_.{c}")).alias(new) for c, new in columns.items()))


def islands(rows: DataFrame, groups: Sequence[str], order: Sequence[str], begins: Column, into: str) -> DataFrame:
    """rows with the number, from 1, of the stretch of their group that they are in; begins says which rows begin one, and may use what lagged() gave."""
    return running_in_groups(rows.withColumn("begins_", begins.cast("int")), groups, order, "begins_", into).drop("begins_", "total_")


def gap_sessions(events: DataFrame, user: str, ts: str, tie: str, gap: float) -> DataFrame:
    """(user, session, start, end, n) of sessions that end with `gap` or more between two events; a user of any share of the events is many tasks."""
    back = lagged(events.select(user, ts, tie), [user], [ts, tie], {ts: "earlier_"})
    numbered = islands(back, [user], [ts, tie], F.col("earlier_").isNull() | (F.col(ts) - F.col("earlier_") >= gap), "session")
    return numbered.groupBy(user, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def exact_percentiles(rows: DataFrame, groups: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """(groups, n, name ...) with interpolated percentiles; a group of any share of the rows is many tasks.

    Equal values are counted first. The counts are added up by ranges of (group, value), and each percentile lies
    between the values at its two ranks, which are minima over the group: nothing holds all its values. Null and NaN
    values count for nothing; a group without another value is left out.
    """
    some = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counted = some.groupBy(*groups, value).agg(F.count("*").alias("n_"))
    upto = running_in_groups(counted, groups, [value], "n_", "upto_")
    at = {name: p * (F.col("total_") - 1) for name, p in points.items()}
    ranks = [F.min(F.when(F.col("upto_") > side(at[name]), F.col(value).cast("double"))).alias(f"{name}_{end}") for name in points for end, side in (("low", F.floor), ("high", F.ceil))]
    found = upto.groupBy(*groups).agg(F.max("total_").alias("n"), *ranks)
    share = {name: p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1)) for name, p in points.items()}
    return found.select(*groups, "n", *((F.col(f"{name}_low") + share[name] * (F.col(f"{name}_high") - F.col(f"{name}_low"))).alias(name) for name in points))


def _in_buckets(rows: DataFrame, groups: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(groups, order, bucket_, sum_, upto_, total_): sums of a value over the buckets of h_ in each group, by order and then by bucket.

    A bucket is the first BUCKET_DIGITS digits of the hash h_, so the table has some thousands of rows for each group and each
    value of order, or one for each row of the input if that is less. upto_ runs up to the end of the bucket.
    """
    sums = rows.groupBy(*groups, *order, F.substring("h_", 1, BUCKET_DIGITS).alias("bucket_")).agg(F.sum(value).cast("bigint").alias("sum_"))
    return fixed(running_in_groups(sums, groups, [*order, "bucket_"], "sum_", "upto_"))


def _up_to(rows: DataFrame, last: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows in buckets up to the last of their group; last: (groups, last_: struct of order and bucket_, more ...), one row for each group that may have some."""
    last = last.select(*(F.col(g).alias(f"{g}_of_") for g in groups), *(c for c in last.columns if c not in groups))
    last = F.broadcast(last) if last.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else last
    own = F.struct(*order, F.substring("h_", 1, BUCKET_DIGITS).alias("bucket_"))
    met = rows.join(last, [F.col(g).eqNullSafe(F.col(f"{g}_of_")) for g in groups])
    return fixed(met.where(own <= F.col("last_")).drop("last_", *(f"{g}_of_" for g in groups)))  # so that no hash is taken again


def stratified_quota(rows: DataFrame, strata: Sequence[str], key: Sequence[str], value: str, target: int, seed: str) -> DataFrame:
    """rows of a proportional draw: in each stratum by hash, all strata in step, until the target is passed by one row at most.

    A row's position is the middle of its value within its stratum's total. value is an integer. Sums over buckets of the
    hash bound the position that the target is reached at, so that only rows of buckets that begin before it are sorted; values
    below zero bound nothing, and all rows are sorted.
    """
    keyed = rows.where(F.col(value).isNotNull()).withColumn("h_", hash_order(*(F.col(k) for k in key), seed=seed))
    buckets = _in_buckets(keyed, strata, [], value)
    share = F.coalesce(F.try_divide(F.lit(1_000_000_000), F.col("total_")), F.lit(0.0))  # a stratum without any value is at the start
    ends = buckets.withColumns({"low_": F.floor((F.col("upto_") - F.col("sum_")) * share) - 1, "high_": F.ceil(F.col("upto_") * share) + 1})  # one more for rounding
    reached = global_running_sum(ends, ["high_", *strata, "bucket_"], "sum_", "all_").where(F.col("all_") >= target).agg(F.min("high_").alias("m")).first()["m"]
    plain = keyed.where(F.col(value) < 0).limit(1).count() == 0
    begun = ends if reached is None or not plain else ends.where(F.col("low_") <= reached)
    last = begun.groupBy(*strata).agg(F.max(F.struct("bucket_")).alias("last_"), F.max("total_").alias("whole_"))
    run = running_in_groups(_up_to(keyed, last, strata, []), strata, ["h_", *key], value, "in_")
    middle = ((2 * F.col("in_") - F.col(value)).cast("decimal(20,0)") * 1_000_000_000).cast("double")
    placed = run.withColumn("at_", (middle / (2 * F.col("whole_"))).cast("bigint")).drop("in_", "total_", "whole_")
    summed = global_running_sum(placed, ["at_", "h_", *key], value, "run_")
    return summed.where(F.col("run_") - F.col(value) < target).drop("h_", "at_", "run_")


def length_batches(rows: DataFrame, key: str, length: str, batch: int, per_window: int, seed: str) -> DataFrame:
    """rows with window, batch and place: shuffled by hash, sorted by length inside windows, cut into whole batches.

    The tail that fills no batch is dropped. The order of all rows comes from global_running_sum().
    """
    shuffled = rows.withColumn("h_", hash_order(F.col(key), seed=seed)).withColumn("one_", F.lit(1))
    ranked = global_running_sum(shuffled, ["h_", key], "one_", "rank_").withColumn("window", F.floor((F.col("rank_") - 1) / (batch * per_window)))
    inside = ranked.withColumn("n_", F.row_number().over(Window.partitionBy("window").orderBy(length, key)) - 1)
    cut = inside.withColumn("batch", F.floor(F.col("n_") / batch)).withColumn("place", F.col("n_") % batch)
    whole = cut.groupBy("window", "batch").agg(F.count("*").alias("size_")).where(F.col("size_") == batch).drop("size_")
    return cut.join(whole, ["window", "batch"], "left_semi").drop("h_", "one_", "rank_", "n_")


def balanced(rows: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """Every group repeated until it has as many rows as the largest: whole rounds, the last one by hash."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n_"))
    sizes = sizes.join(F.broadcast(sizes.agg(F.max("n_").alias("top_"))))
    rounds = rows.join(sizes, group).withColumn("round", F.explode(F.sequence(F.lit(0), F.ceil(F.col("top_") / F.col("n_")).cast("int") - 1)))
    placed = rounds.withColumn("h_", hash_order(F.col("round"), F.col(key), seed=seed)).withColumn("one_", F.lit(1))
    rest = running_in_groups(placed, [group, "round"], ["h_", key], "one_", "r_")
    return rest.where(F.col("round") * F.col("n_") + F.col("r_") <= F.col("top_")).drop("n_", "top_", "r_", "h_", "one_", "total_")


def dense_ids(rows: DataFrame, group: str, ident: str, into: str) -> DataFrame:
    """Group-local ids moved to ranges of their own: each group starts after the span of those before it."""
    spans = rows.groupBy(group).agg(F.min(ident).alias("low_"), (F.max(ident) - F.min(ident) + 1).alias("width_"))
    starts = global_running_sum(spans, [group], "width_", "end_").withColumn("start_", F.col("end_") - F.col("width_"))
    return rows.join(starts.select(group, "low_", "start_"), group).withColumn(into, F.col("start_") + F.col(ident) - F.col("low_")).drop("low_", "start_")


def largest_remainder(counts: DataFrame, group: Sequence[str], bucket: str, share: str, total: int) -> DataFrame:
    """counts with quota: total parted by share, what floors leave going to the largest fractions, ties to the later bucket."""
    exact = F.col(share) * total
    parted = counts.withColumn("floor_", F.floor(exact)).withColumn("part_", F.round(exact - F.floor(exact), 9))
    own = Window.partitionBy(*group)
    ranked = parted.withColumn("r_", F.row_number().over(own.orderBy(F.desc("part_"), F.desc(bucket)))).withColumn("left_", total - F.sum("floor_").over(own))
    return ranked.withColumn("quota", (F.col("floor_") + (F.col("r_") <= F.col("left_")).cast("int")).cast("bigint")).drop("floor_", "part_", "r_", "left_")


def prioritized_sample(rows: DataFrame, quotas: DataFrame, keys: Sequence[str], priority: str, key: Sequence[str], seed: str) -> DataFrame:
    """The quota's number of rows of each group, by priority and then by hash.

    Counts over buckets of the hash tell which buckets the quota ends in, so that only rows up to there are sorted.
    """
    placed = rows.withColumn("h_", hash_order(*(F.col(k) for k in key), seed=seed)).withColumn("one_", F.lit(1))
    most = quotas.groupBy(*keys).agg(F.max("quota").alias("most_"))
    begun = _in_buckets(placed, keys, [priority], "one_").join(most, list(keys)).where(F.col("upto_") - F.col("sum_") < F.col("most_"))
    last = begun.groupBy(*keys).agg(F.max(F.struct(priority, "bucket_")).alias("last_"))
    ranked = running_in_groups(_up_to(placed, last, keys, [priority]), keys, [priority, "h_", *key], "one_", "r_").drop("h_", "one_", "total_")
    return ranked.join(quotas, list(keys)).where(F.col("r_") <= F.col("quota")).drop("r_", "quota")


def mapped(column: Column, table: Mapping[str, int]) -> Column:
    return F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))), column)
