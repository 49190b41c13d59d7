"""Filter interaction audit over failing-id relations.

One pass over the texts gives each row's verdicts and a digest. From then on only ids move: one table of failing ids a filter, and for
every set of filters the table of its survivors, all bucketed by the same key, so no join shuffles. Level by level, survivors left-semi
failing ids are the removals of the next filter, and survivors left-anti failing ids the survivors of the longer prefix. An order of
filters is a walk through these sets, so 120 orders of five filters need 32 sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shared_dir, written

#: Ids in a bucket of the id tables, about.
BUCKET_ROWS = 1_000_000
KEY = ["k1", "k2"]


def rules(text: Column) -> dict[str, Column]:
    """Failure conditions of the four filters that read one text: short, repetitive, shouting, marked."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", conditions=rules) -> DataFrame:
    """(k1, k2, doc_id, digest, part, n, one boolean a condition, good, toxic): rows of one id, text and part are one with their number n.

    Null texts are empty, a null part is the empty string. A label counts if any row of `labels` with the id has it; null ids have none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = conditions(text)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *[c.alias(f) for f, c in found.items()])
    rows = rows.groupBy("doc_id", "part", "digest", *found).agg(F.count("*").alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left")
    rows = known.unionByName(rows.where(F.col("doc_id").isNull()), allowMissingColumns=True)
    return rows.select(
        F.xxhash64("doc_id").alias("k1"), F.xxhash64("digest", "part").alias("k2"), "doc_id", "digest", "part", "n", *found, (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic")
    )


def copies(found: DataFrame) -> DataFrame:
    """The rows whose text has a smaller id: all but those of the first id of their text. Null ids have no order, so they neither fail nor
    make others fail. The join is by id and text, so a text that a third of all rows share is no hot key."""
    known = found.where(F.col("doc_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return known.join(first, ["doc_id", "digest"], "left_anti")


@contextmanager
def _bucketed(spark, n_buckets: int):
    """A function that writes a frame as a table bucketed by the key; the tables go at the end, with their files."""
    names = []

    def put(df: DataFrame) -> DataFrame:
        names.append(f"tidemark_ids_{uuid.uuid4().hex}")
        df.repartition(n_buckets, *KEY).write.bucketBy(n_buckets, *KEY).sortBy(*KEY).option("path", f"{shared_dir(spark)}/{names[-1]}").saveAsTable(names[-1])
        return spark.table(names[-1])

    try:
        yield put
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(spark, f"{shared_dir(spark)}/{name}")


def prefixes(found: DataFrame, filters: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(removals, survivors) of each set of filters applied before: rows (part, applied, filter, removed, good_lost, toxic_lost) and
    (part, applied, kept), where applied has bit i for filters[i]. Sets and filters without a row have zeros."""
    spark, letters, removed, kept = found.sparkSession, list(filters), [], []
    some = lambda parts: written(reduce(DataFrame.unionByName, parts))
    rows = ["part", "n", "good", "toxic"]
    tally = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    with _bucketed(spark, int(max(4, found.count() // BUCKET_ROWS))) as put:
        failing = {f: put((copies(found) if f == "E" else found.where(f)).select(*KEY)) for f in letters}
        left = put(found.select(*KEY, *rows, F.lit(0).alias("applied")))
        for level in range(len(letters) + 1):
            kept.append(written(left.groupBy("part", "applied").agg(F.sum("n").alias("kept"))))
            if level == len(letters):
                break
            each = []
            for i, f in enumerate(letters):
                gone = left.where(F.col("applied").bitwiseAND(1 << i) == 0).join(failing[f], KEY, "left_semi")
                each.append(gone.groupBy("part", "applied").agg(F.lit(f).alias("filter"), F.sum("n").alias("removed"), tally("good").alias("good_lost"), tally("toxic").alias("toxic_lost")))
            removed.append(some(each))  # by levels, so that no plan is large
            # each set comes once: by the filter of its highest bit
            longer = [left.where(F.col("applied") < 1 << i).join(failing[f], KEY, "left_anti").withColumn("applied", F.col("applied") + (1 << i)) for i, f in enumerate(letters)]
            left = put(reduce(DataFrame.unionByName, longer))
        return some(removed), some(kept)


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step, with zeros: part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    Filters: A to D of rules(), and E, a text that a smaller id has anywhere in the table. Repeated rows each count and don't fail E by
    one another; null and empty texts are one text; an empty table has no rows. Whole texts of any length are read, once. Only columns
    named here are read, so others may have any name.
    """
    letters = "ABCDE"
    removed, kept = prefixes(written(verdicts(docs, labels, id_col, text_col, part_col)), letters)
    steps = []
    for order in map("".join, permutations(letters)):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << letters.index(f)
            steps.append((len(steps), order, step, f, before, before | bit, 31 - bit))
            before |= bit
    # a fixed table of 600 rows, which each part gets whole
    walk = docs.sparkSession.createDataFrame(steps, "place int, filter_order string, step int, filter string, applied int, after int, others int")
    parts = kept.where("applied = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("place"))
    rows = parts.join(F.broadcast(walk), "place")
    alone = removed.select("part", "filter", F.col("applied").alias("others"), F.col("removed").alias("unique_fails"))
    fails = removed.where("applied = 0").select("part", "filter", F.col("removed").alias("fails"))
    rows = rows.join(removed, ["part", "filter", "applied"], "left").join(alone, ["part", "filter", "others"], "left").join(fails, ["part", "filter"], "left")
    rows = rows.join(kept.select("part", F.col("applied").alias("after"), "kept"), ["part", "after"], "left")
    rows = rows.na.fill(0, ["kept", "removed", "unique_fails", "fails", "good_lost", "toxic_lost"])
    return rows.select(
        "part", "filter_order", "step", "filter", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents
), v AS (
  SELECT doc_id, part, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS capitals,
         min(doc_id) OVER (PARTITION BY x) AS first_id
  FROM w
), f AS (
  SELECT part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * capitals > 10 * length(x),
                regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS bad,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = v.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = v.doc_id AND l.toxic = 1) AS toxic
  FROM v
), m AS (
  SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, bad
), l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step] AS filter, list_transform(range(1, step), lambda k: instr('ABCDE', filter_order[k])) AS before,
         list_transform(range(step + 1, 6), lambda k: instr('ABCDE', filter_order[k])) AS behind
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), g AS (
  SELECT part, filter_order, step, filter, n, good, toxic, bad[instr('ABCDE', filter)] AS fails,
         len(list_filter(before, lambda i: bad[i])) > 0 AS earlier, len(list_filter(behind, lambda i: bad[i])) > 0 AS later
  FROM m, s
), r AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails AND NOT earlier AND NOT later), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM g GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
