"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Adds this package to the session, once, so that Python workers anywhere can import it."""
    if spark.conf.get("spark.wordmill.shipped", "") == spark.sparkContext.applicationId:
        return
    target = Path(tempfile.mkdtemp(prefix="wordmill-")) / "wordmill.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.conf.set("spark.wordmill.shipped", spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder, read through Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(column: str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, rounded down, whatever the session's zone."""
    gap = f"({column} - timestamp_ntz'1970-01-01 00:00:00')"
    return F.expr(f"cast(extract(DAY FROM {gap}) * 86400L + extract(HOUR FROM {gap}) * 3600L + extract(MINUTE FROM {gap}) * 60L + floor(extract(SECOND FROM {gap})) as bigint)")
