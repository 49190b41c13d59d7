"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

Tokens are shingles of five words; a window of fewer words is one token. Containment of a whole window means that all of its tokens
are shared, so a prefix of one token is enough: the rarest by its count over all documents. One pass over the texts cuts them into
words, hashes every shingle and keeps the few that any window holds, with their positions; counts, prefixes and matches come from
these hits alone. Hits meet windows at the prefix tokens; the token's offset bounds position and length, and a window is there if
all of its tokens stand at their places, which is word for word, since tokens are compared as strings and overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW, SHINGLE = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are in no word; those from U+0080 on always are.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Tables of tokens and windows are broadcast up to so many rows (some 150 bytes each); beyond, the joins shuffle, salted.
BROADCAST_ROWS = 300_000
SALTS = 16


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z alone; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS))
    return F.array_remove(F.split(spaced, F.lit(" ")), "")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(words, items): each distinct window with the ids, as strings, of the items that hold it."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    rows = rows.where(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("words"))
    return rows.groupBy("words").agg(F.collect_set("item").alias("items"))


def tokens_of(words: Column, shingle: int = SHINGLE) -> Column:
    """(offset, token) of each token of a window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - shingle, F.lit(0)))
    return F.transform(starts, lambda s: F.struct(s.alias("offset"), F.array_join(F.slice(words, s + 1, shingle), " ").alias("token")))


def _met(rows: DataFrame, table: DataFrame, key: str, how: str, small: bool) -> DataFrame:
    """Join on `key`; where the table is too large to broadcast, each of its rows stands once a salt, so that no key is one task's."""
    if small:
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "h", "i"), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


def hits(docs: DataFrame, known: DataFrame, sizes: list[int], small: bool, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, n, i, own, tokens): known tokens that start at word i of a document of n words, and one row `own` a document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), words_of(F.col(text_col)).alias("w"))
    ahead = [F.slice("w", k + 1, 1 << 30).alias(f"w{k}") for k in range(max(sizes, default=1))]
    rows = rows.select("doc_id", "h", F.size("w").cast("long").alias("n"), F.posexplode_outer(F.arrays_zip(*ahead)).alias("i", "x"))
    rows = rows.select("doc_id", "h", "n", F.coalesce("i", F.lit(0)).alias("i"), "x")
    here = {s: [F.col(f"x.w{k}") for k in range(s)] for s in sizes}
    keys = {s: F.when(w[-1].isNotNull(), F.xxhash64(*w)) for s, w in here.items()}
    if small:  # hashes are looked up, and of those that are found the strings are compared
        for s in sizes:
            listed = known.where(F.col("size") == s).groupBy(F.col("key").alias(f"key{s}")).agg(F.collect_list("token").alias(f"known{s}"))
            rows = _met(rows.withColumn(f"key{s}", keys[s]), listed, f"key{s}", "left", True)
        tokens = [F.when(F.array_contains(f"known{s}", F.concat_ws(" ", *w)), F.concat_ws(" ", *w)) for s, w in here.items()]
        tokens = F.array_compact(F.array(*tokens)) if sizes else F.array().cast("array<string>")
        rows = rows.select("doc_id", "h", "n", "i", (F.col("i") == 0).alias("own"), tokens.alias("tokens"))
        return rows.where(F.col("own") | (F.size("tokens") > 0))
    own = rows.where("i = 0").select("doc_id", "h", "n", "i", F.lit(True).alias("own"), F.array().cast("array<string>").alias("tokens"))
    each = rows.select("doc_id", "h", "n", "i", F.inline(F.array(*[F.struct(keys[s].alias("key"), F.concat_ws(" ", *w).alias("t")) for s, w in here.items()])))
    met = _met(each.where("key is not null"), known.select("key", "token"), "key", "inner", False).where("t = token")
    return own.unionByName(met.select("doc_id", "h", "n", "i", F.lit(False).alias("own"), F.array("token").alias("tokens")))


def prefixed(wins: DataFrame, found: DataFrame) -> DataFrame:
    """(token, offset, need, n_words, items): each window all of whose tokens occur, at its rarest one, ties to the first. Counts cover
    all documents."""
    counts = found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = wins.select("window_id", F.inline("need")).join(counts, "token")
    rarest = each.groupBy("window_id").agg(F.min(F.struct("n", "offset", "token")).alias("p"), F.count("*").alias("there"))
    rarest = rarest.join(wins, "window_id").where(F.col("there") == F.size("need"))
    return rarest.select("p.token", "p.offset", "need", F.size("words").alias("n_words"), "items")


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated, and text_hash (xxhash64),
    which tells apart rows of one id.

    Null and empty texts have no words. Repeated rows come back as often as they were given. Items without words match nothing;
    with an empty benchmark, no word is hit. A null item id is written as the empty string. Other columns are not read. Work
    follows the number of words, however they are spread over texts.
    """
    wins = windows(items, item_col, item_text_col, window).select("words", "items", tokens_of(F.col("words")).alias("need"))
    wins = written(wins.withColumn("window_id", F.monotonically_increasing_id()))
    known = wins.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("size"), F.explode("need.token").alias("token")).distinct()
    word = [F.get(F.split("token", F.lit(" ")), F.lit(k)) for k in range(SHINGLE)]
    known = written(known.withColumn("key", F.coalesce(*[F.when(F.col("size") == s, F.xxhash64(*word[:s])) for s in range(1, SHINGLE + 1)])))
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # SHINGLE numbers at most
    found = written(hits(docs, known, sizes, known.count() <= BROADCAST_ROWS, id_col, text_col))
    keys = written(prefixed(wins, found))

    spots = found.select("doc_id", "h", "i", F.explode("tokens").alias("token")).distinct()
    reach = Window.partitionBy("doc_id", "h").orderBy("i").rangeBetween(-(window - 1), window - 1)
    spots = spots.withColumn("near", F.collect_list(F.struct("i", "token")).over(reach))
    met = _met(spots, keys, "token", "inner", keys.count() <= BROADCAST_ROWS).withColumn("start", F.col("i") - F.col("offset"))
    placed = F.transform("need", lambda t: F.struct((t["offset"] + F.col("start")).alias("i"), t["token"].alias("token")))
    met = met.where(F.size(F.array_except(placed, "near")) == 0).withColumn("end", F.col("start") + F.col("n_words"))

    own = found.where("own").select("doc_id", "h", "n", F.lit(1).alias("own"), F.lit(None).cast("struct<start:int,end:int>").alias("span"), F.lit(None).cast("array<string>").alias("items"))
    met = met.select("doc_id", "h", F.lit(None).cast("long").alias("n"), F.lit(0).alias("own"), F.struct("start", "end").alias("span"), "items")
    found = own.unionByName(met).groupBy("doc_id", "h").agg(
        F.max("n").alias("n_words"), F.sum("own").alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    return found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.col("h").alias("text_hash"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "n_words", "n_hit", "n_items", "items", (F.col("n_hit") > 0).alias("contaminated"), "text_hash"
    )


#: The same rows for the query, in DuckDB.
SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS t, len(w[s : s + 9]) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM dw
), hits AS (
  SELECT DISTINCT p.doc_id, p.s, x.k, x.item_id
  FROM (SELECT DISTINCT k FROM win) ks, pos p, win x
  WHERE x.k = ks.k AND p.s + ks.k - 1 <= len(p.w) AND x.t = array_to_string(p.w[p.s : p.s + ks.k - 1], ' ')
), cov AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS q FROM hits) GROUP BY 1
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
