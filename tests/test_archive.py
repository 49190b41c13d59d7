"""The archive of months: what is written over, what is read, and what fails."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.sources import archive

SCHEMA = "sym string, t long, close double"


def at(spark, *days):
    return [r["t"] for r in spark.createDataFrame([(d,) for d in days], "d string").select(F.unix_seconds(F.to_timestamp("d")).alias("t")).collect()]


def test_months_are_written_over_as_a_whole(spark, tmp_path):
    jan, jan2, feb, dec = at(spark, "2024-01-01", "2024-01-31 23:59:59", "2024-02-01", "2023-12-31")
    path = str(tmp_path / "bars")
    archive.store(spark.createDataFrame([("a", jan, 1.0), ("a", jan2, 2.0), ("b", jan, 3.0), ("a", feb, 4.0), ("a", dec, 5.0)], SCHEMA), path)
    archive.store(spark.createDataFrame([("a", jan, 9.0), ("b", jan, 3.0)], SCHEMA), path)
    rows = {(r["sym"], r["t"], r["close"], r["month"]) for r in spark.read.parquet(path).collect()}
    assert rows == {("a", jan, 9.0, 202401), ("b", jan, 3.0, 202401), ("a", feb, 4.0, 202402), ("a", dec, 5.0, 202312)}
    january = archive.study(spark, path, 202401)
    assert {r["close"] for r in january.collect()} == {9.0, 3.0}
    assert {r["close"] for r in archive.study(spark, path, 202401, back=86400).collect()} == {9.0, 3.0, 5.0}
    assert {r["close"] for r in archive.study(spark, path, 202401, ahead=1).collect()} == {9.0, 3.0, 4.0}


def test_a_study_reads_its_months_only(spark, tmp_path):
    path = str(tmp_path / "bars")
    days = at(spark, *[f"2024-{m:02d}-15" for m in range(1, 13)])
    archive.store(spark.createDataFrame([("a", t, 1.0) for t in days], SCHEMA), path)
    found = archive.study(spark, path, 202406, back=86400, ahead=3600)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line).split("PartitionFilters: ")[1].split("]")[0]
    assert "month" in filters and "202405" in filters and "202407" in filters
    assert found.count() == 1


def test_months_around():
    assert archive.months_around(202401, 1, 0)[:2] == (202312, 202401) and archive.months_around(202412, 0, 1)[:2] == (202412, 202501)
    assert archive.months_around(202402, 0, 0) == (202402, 202402, 1706745600, 1709251200)


def test_a_wrong_checksum_fails_the_scan(spark, tmp_path):
    for name, data in (("a.csv", b"1,2"), ("b.csv", b"3,4")):
        (tmp_path / name).write_bytes(data)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    good = spark.createDataFrame([("a.csv", digest(b"1,2")), ("b.csv", digest(b"3,4"))], "name string, sha256 string")
    assert {bytes(r["content"]) for r in archive.checked(spark, str(tmp_path), good).collect()} == {b"1,2", b"3,4"}
    for bad in ([("a.csv", digest(b"1,2")), ("b.csv", digest(b"x"))], [("a.csv", digest(b"1,2"))]):
        with pytest.raises(Exception, match="checksum of b.csv"):
            archive.checked(spark, str(tmp_path), spark.createDataFrame(bad, "name string, sha256 string")).collect()
