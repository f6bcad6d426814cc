"""Helpers that the training-data operators share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that goes to a Python worker.
TEXTS_AT_ONCE = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    Where a session on one machine names none, as in tests, a new local one is set; on a cluster, where
    no executor could read it, that is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-wordmill-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy", group_bytes: int | None = None) -> DataFrame:
    """df as a table written in the shared folder and read again: what follows survives lost executors.

    group_bytes is for rows of some MB: the bytes after which a row group ends. Parquet else looks at the size
    of a group after a hundred rows, and a task holds whole groups when it writes and when it reads.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    to = df.write.option("compression", compression)
    if group_bytes:
        to = to.options(**{"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})
    to.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Sends whole texts to Python workers TEXTS_AT_ONCE at a time in this session, in place of ten thousand: what a batch takes is held by both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_AT_ONCE))


@contextmanager
def bytes_at_once(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches that go to Python workers end after `most` bytes, or one row, in what runs meanwhile."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fitted(sample: DataFrame, train: Callable[[pd.DataFrame], Any]) -> Any:
    """What train makes of all rows of a sample, which the caller keeps to a fixed bound.

    Training is one task, which another executor can do again, so neither the sample nor what training
    needs is held by the driver; only the model comes back.
    """
    columns = sample.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [batch for batch in batches if len(batch)]
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)
        del parts
        yield pd.DataFrame({"model": [pickle.dumps(train(rows))]})

    found = sample.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(found["model"]) if found else train(pd.DataFrame(columns=columns))


def id_type(df: DataFrame, column: str) -> str:
    """The SQL type of a key column, for the schemas of Python steps that pass it on."""
    return df.schema[column].dataType.simpleString()


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Keys that hold more than 1/HOT of the rows are hot: there can be HOT of them at most, so their side may be broadcast.
HOT = 1000


def join_hot(rows: DataFrame, values: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with values (one row for each key) without sending a hot key's rows to one task.

    size is the column of values that says how many rows the key has, total the number of all rows.
    Hot keys meet their values by a broadcast of HOT rows at most, all others by a shuffle.
    """
    hot = F.broadcast(values.where(F.col(size) > total / HOT).drop(size).withColumn("hot_", F.lit(True)))
    met = rows.join(hot, key, "left")
    rest = met.where("hot_ is null").select(*rows.columns).join(values.where(F.col(size) <= total / HOT).drop(size), key)
    columns = [key, *(c for c in rows.columns if c != key), *(c for c in values.columns if c not in (key, size))]
    return met.where("hot_").select(*columns).unionByName(rest.select(*columns))
