"""Exact top-k by inner product over a bit-sliced index.

Components become whole numbers. The index is a table of blocks: for each component and each bit, one bitmap over the block's rows. A
query's scores are made for a whole block at once: each digit of a query's component adds the component's slices, shifted, and
carry-save adders on bitmaps bring all slices down to one a binary place. The top rows are then taken from the most significant slice
downward; rows that tie at the border are decided by their ids, which order the rows of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows in a block, queries in a chunk, and blocks that a task sees in a row with one chunk, at most.
BLOCK, CHUNK, RUN = 16384, 2048, 64
#: Quantised components beyond this count as this, so that a score of up to 512 components fits a long.
LIMIT = 1 << 27
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, q array<long>): floor(scale * component), in double precision, of the rows that take part: those with an id and a vector
    without null or non-finite components."""
    x = F.col("x")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    most = float(LIMIT)
    return rows.select("vec_id", F.transform("x", lambda c: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(c * scale).cast("double"))).cast("long")).alias("q"))


def _matrices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, ids, values) of up to `most` rows of one vector size, in the order of rows."""
    held: dict[int, list] = {}
    for batch in batches:
        ids, column = batch.column(0).to_numpy(), batch.column(1)
        sizes = np.diff(column.offsets.to_numpy())
        flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
        for dims in np.unique(sizes):
            at = np.flatnonzero(sizes == dims)
            values = flat[starts[at][:, None] + np.arange(dims)] if dims else np.zeros((len(at), 0), np.int64)
            parts = held.setdefault(int(dims), [])
            parts.append((ids[at], values))
            while sum(len(p[0]) for p in parts) >= most:
                i, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                parts[:] = [(i[most:], v[most:])]
                yield int(dims), i[:most], v[:most]
    for dims, parts in held.items():
        i, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if len(i):
            yield dims, i, v


def index(rows: DataFrame) -> DataFrame:
    """The bit-sliced index of vectors(): (dims, n, ids, low, width, slices), a row a block of up to BLOCK vectors of one size.

    ids are sorted and stored as 64-bit numbers; component d has width[d] slices of its values less low[d], from the lowest bit on.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, ids, values in _matrices(batches, BLOCK):
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
            low = values.min(axis=0)
            above = (values - low).astype(np.uint64)
            width = [int(m).bit_length() for m in above.max(axis=0)]
            planes = [np.packbits((above[:, d] >> np.uint64(b)) & np.uint64(1), bitorder="little") for d in range(dims) for b in range(width[d])]
            padded = np.zeros((len(planes), -(-len(ids) // 64) * 8), np.uint8)
            for to, plane in zip(padded, planes, strict=True):
                to[: len(plane)] = plane
            yield pa.RecordBatch.from_pydict({
                "dims": pa.array([dims], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                "low": pa.array([low.astype("<i8").tobytes()], pa.binary()), "width": pa.array([bytes(width)], pa.binary()), "slices": pa.array([padded.tobytes()], pa.binary()),
            })

    return rows.select(F.col("vec_id").cast("long"), "q").mapInArrow(build, "dims int, n int, ids binary, low binary, width binary, slices binary")


def digits(value: int) -> list[tuple[int, int]]:
    """(place, sign) of the non-adjacent form: signed binary digits, a third of which are not zero."""
    out, place = [], 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            out.append((place, sign))
            value -= sign
        value >>= 1
        place += 1
    return out


class Block:
    """One block of the index in memory."""

    def __init__(self, n: int, ids: bytes, low: bytes, width: bytes, slices: bytes) -> None:
        self.n, self.ids, self.low, self.width = n, np.frombuffer(ids, "<i8"), np.frombuffer(low, "<i8").tolist(), list(width)
        self.words = -(-n // 64)
        self.first = np.concatenate([[0], np.cumsum(self.width)]).astype(int).tolist()
        plain = np.frombuffer(slices, "<u8").reshape(self.first[-1], self.words)
        # complements stand behind the slices, for negative digits
        self.slices = np.concatenate([plain, ~plain])
        tail = np.full(self.words, ONES)
        if n % 64:
            tail[-1] = np.uint64((1 << (n % 64)) - 1)
        self.live = tail

    def scores(self, query: list[int]) -> tuple[np.ndarray, int]:
        """(slices of the scores less a constant, lowest bit first; the constant)."""
        constant, places, back = 0, {}, self.first[-1]
        for value, low, width, first in zip(query, self.low, self.width, self.first, strict=False):
            constant += value * low
            for place, sign in digits(value):
                at = first if sign > 0 else first + back
                if sign < 0:  # -u is its complement less 2 ** width - 1
                    constant -= ((1 << width) - 1) << place
                for b in range(width):
                    places.setdefault(place + b, []).append(at + b)
        out, carried, place = [], [], 0
        while carried or any(p >= place for p in places):
            rows = [self.slices[places[place]]] if place in places else []
            pile, carried = np.concatenate([*rows, *carried]) if rows or carried else np.zeros((1, self.words), np.uint64), []
            while len(pile) > 1:
                third = len(pile) // 3
                if third:
                    a, b, c = pile[:third], pile[third : 2 * third], pile[2 * third : 3 * third]
                    both = a ^ b
                    carried.append((a & b) | (c & both))
                    pile = np.concatenate([both ^ c, pile[3 * third :]])
                else:
                    carried.append((pile[:1] & pile[1:2]))
                    pile = pile[:1] ^ pile[1:2]
            out.append(pile[0])
            place += 1
        return np.array(out).reshape(len(out), self.words), constant

    def top(self, query_id: int, query: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k highest scores, of more rows with the border's score those of the smallest ids; none of the query's id."""
        slices, constant = self.scores(query)
        open_, sure = self.live.copy(), np.zeros(self.words, np.uint64)
        a, b = np.searchsorted(self.ids, [query_id, query_id + 1])
        for i in range(a, b):
            open_[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        count = lambda bits: int(np.bitwise_count(bits).sum())
        have = 0
        for plane in slices[::-1]:
            ones = open_ & plane
            n = count(ones)
            if have + n > k:
                open_ = ones
            else:
                sure, have = sure | ones, have + n
                open_ = open_ & ~plane
                if have == k:
                    break
        rows = self._rows(sure)
        if have < k:  # what is left open ties, and rows stand in the order of ids
            rows = np.concatenate([rows, self._rows(open_)[: k - have]])
        words, bits = rows >> 6, (rows & 63).astype(np.uint64)
        found = np.zeros(len(rows), np.int64)
        for place, plane in enumerate(slices):
            found += ((plane[words] >> bits) & np.uint64(1)).astype(np.int64) << place
        return self.ids[rows], found + constant

    def _rows(self, bits: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(bits)
        inside = np.unpackbits(bits[at].view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
        word, bit = np.nonzero(inside)
        return at[word] * 64 + bit


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by falling score, then rising id."""
    return np.lexsort((ids, -scores))[:k]


def search(queries: DataFrame, blocks: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all vectors in the index for each query (rows of vectors()).

    A query meets vectors of its own size, and none of its own id; with fewer than k of these, all are returned. Repeated rows of a query
    are one query, and an id with several vectors has a list for each; repeated vectors of the index are candidates each. Scores are
    whole numbers, exact up to LIMIT. Queries come in chunks and blocks in runs; each pair of these is one unit of work, dealt by hash,
    so no task grows with the data, and each unit returns k rows a query.
    """
    spark = queries.sparkSession
    n_queries, n_blocks = queries.count(), blocks.count()
    chunks = max(1, -(-n_queries // CHUNK))
    width = spark.sparkContext.defaultParallelism
    runs = max(1, -(-n_blocks // RUN), min(n_blocks, -(-4 * width // chunks)))
    empty = F.lit(None).cast("binary")
    asked = queries.dropDuplicates(["vec_id", "q"]).select(
        F.pmod(F.xxhash64("vec_id", "q"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(-1).cast("long").alias("seq"),
        F.size("q").alias("dims"), F.lit(1).alias("n"), *[empty.alias(c) for c in ("ids", "low", "width", "slices")], F.col("vec_id").cast("long").alias("query_id"), "q",
    )
    numbered = blocks.withColumn("seq", F.monotonically_increasing_id())
    there = numbered.select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.pmod(F.xxhash64("seq"), F.lit(runs)).cast("int").alias("run"), "seq",
        "dims", "n", "ids", "low", "width", "slices", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<long>").alias("q"),
    )
    units = asked.unionByName(there).repartition(min(chunks * runs, 20_000), "chunk", "run").sortWithinPartitions("chunk", "run", "seq")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, waiting, found = None, {}, {}

        def answers() -> Iterator[pa.RecordBatch]:
            for (query_id, query), (ids, scores) in found.items():
                key = hash_of(query)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array([query_id] * len(ids), pa.int64()), "key": pa.array([key] * len(ids), pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                at = (c["chunk"][i].as_py(), c["run"][i].as_py())
                if at != unit:
                    yield from answers()
                    unit, waiting, found = at, {}, {}
                dims = c["dims"][i].as_py()
                if c["seq"][i].as_py() < 0:
                    waiting.setdefault(dims, []).append((c["query_id"][i].as_py(), tuple(c["q"][i].as_py())))
                    continue
                if dims not in waiting:
                    continue
                block = Block(*(c[name][i].as_py() for name in ("n", "ids", "low", "width", "slices")))
                for query in waiting[dims]:
                    ids, scores = block.top(query[0], query[1], k)
                    if query in found:
                        ids, scores = np.concatenate([found[query][0], ids]), np.concatenate([found[query][1], scores])
                        first = best(ids, scores, k)
                        ids, scores = ids[first], scores[first]
                    found[query] = ids, scores
        yield from answers()

    parts = units.mapInArrow(work, "query_id long, key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hash_of(query: tuple) -> int:
    """Tells the vectors of one id apart."""
    from hashlib import blake2b

    return int.from_bytes(blake2b(repr(query).encode(), digest_size=8).digest(), "little", signed=True)


def top_k(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """search() for the rows whose id is divisible by `every` against all rows. An empty table gives no rows; other columns aren't read."""
    found = vectors(rows, id_col, vector_col)
    n = found.count()
    blocks = written(index(found.coalesce(max(1, -(-n // BLOCK)))))
    return search(found.where(F.col("vec_id") % every == 0), blocks, k)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
