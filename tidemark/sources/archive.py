"""An archive of bars by month: months are written over as a whole, and a study reads only the months around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400


def month_of(t: Column) -> Column:
    """The UTC month of a time in seconds, as yyyymm."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / DAY).cast("int"))
    return F.year(day) * 100 + F.month(day)


def store(bars: DataFrame, path: str) -> None:
    """Writes bars under their month. Months that the bars hold are written over as a whole, all others stay, so that a repeated download
    changes nothing. Files are ranges of month, symbol and time of about one size, so a hot symbol is many files and reads for a symbol
    skip most."""
    rows = bars.withColumn("month", month_of(F.col("t")))
    rows.repartitionByRange("month", "sym", "t").write.partitionBy("month").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def months_around(month: int, back: int, ahead: int) -> tuple[int, int, int, int]:
    """(first month, last month, from, to) that a study of a month reads: `back` seconds before it and `ahead` after it."""
    from datetime import UTC, datetime, timedelta

    start = datetime(month // 100, month % 100, 1, tzinfo=UTC)
    end = datetime(month // 100 + month % 100 // 12, month % 100 % 12 + 1, 1, tzinfo=UTC)
    low, high = start - timedelta(seconds=back), end + timedelta(seconds=ahead)
    last = high - timedelta(seconds=1)
    return low.year * 100 + low.month, last.year * 100 + last.month, int(low.timestamp()), int(high.timestamp())


def study(spark: SparkSession, path: str, month: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Bars of a month with those before and after it that its windows and outcomes reach. Only the partitions of these months are read."""
    first, last, low, high = months_around(month, back, ahead)
    rows = spark.read.parquet(path).where(F.col("month").between(first, last))
    return rows.where((F.col("t") >= low) & (F.col("t") < high))


def checked(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """(name, content) of files; a file whose SHA-256 isn't the catalog's (name, sha256), or that it doesn't know, fails the scan."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = files.join(catalog, "name", "left")
    same = F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))
    return rows.select("name", F.when(same, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("checksum of "), "name"))).alias("content"))
