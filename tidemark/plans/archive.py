"""Queries over an archive of months."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..registry import query
from ..shared import shared_dir
from ..sources import archive
from ..sources.tables import TRADE_BARS_SQL, trade_bars
from .bars import rounded


@query(f"{TRADE_BARS_SQL} SELECT sym, t, round(close, 8) AS close, round(q, 4) AS q FROM b WHERE t >= epoch(TIMESTAMP '1995-02-22') AND t < epoch(TIMESTAMP '1995-04-03')")
def archive_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trade bars stored by month, and of these a study of March 1995 with a week before and two days after it."""
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    archive.store(trade_bars(spark, sf_dir).select("sym", "t", "close", "q"), path)
    found = archive.study(spark, path, 199503, back=7 * archive.DAY, ahead=2 * archive.DAY)
    return rounded(found.select("sym", "t", "close", "q"), {"close": 8, "q": 4})
