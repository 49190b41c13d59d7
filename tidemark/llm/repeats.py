"""Repeated byte strings by a blockwise suffix sort with a difference cover.

Strings are compared to a depth of `length` bytes, which is all that removal needs. Positions whose residue modulo V lies in a
difference cover are sample suffixes: any two positions meet in the cover after the same number k < V of bytes, so if they share
`length` bytes, both have a sample suffix k bytes on that shares length - V + 1. Stage one sorts the sample suffixes, one bucket at
a time, and gives ties; stage two sorts, one bucket at a time, only suffixes with a tied sample in reach, for only these can be
tied to the full depth. Suffixes are ordered by digests of their first bytes, which puts equal strings side by side as the order by
bytes does; ties of stage two, which decide what goes, are ties of two independent digests, 96 bits in all. Texts stay where they are: only digests travel, each once a chunk of texts (twice if it repeats within), and
bitmaps come back, so that a string in a third of all documents costs its bucket one row a chunk.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

LENGTH = 400
#: The cover's order: a prime q gives q + 1 residues modulo V = q * q + q + 1.
COVER_ORDER = 11
#: Bytes of text in a chunk: the unit in which texts are held and hashed. Longer texts are a chunk of their own, hashed in blocks.
CHUNK = 1 << 20
#: Bytes of digests that a bucket holds on average, so the memory of sorting one.
BUCKET = 6 << 20
#: Tables of copied texts are broadcast up to so many rows of about 40 bytes; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000
SAMPLE_BYTES = 5
#: Bytes of the two digests by which stage two tells strings apart: eight of one and four of the other.
SUFFIX_BYTES = 12
# Odd bases of the two digests; their tables of byte values are drawn from the seeds.
_BASES, _SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (400, 401)
_TABLES = [np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64) for seed in _SEEDS]


@lru_cache(maxsize=4)
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """V and the residues of a perfect difference set: exponents i of a primitive cubic over GF(q) for which x^i has no square term."""
    v = q * q + q + 1
    order = q**3 - 1
    factors = {p for p in range(2, order) if order % p == 0 and all(p % d for d in range(2, int(p**0.5) + 1))}

    def times(a, b, poly):
        c = [0] * 5
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                c[i + j] += x * y
        for d in (4, 3):
            for j in range(3):
                c[d - 3 + j] += c[d] * poly[j]
        return tuple(x % q for x in c[:3])

    def power(n, poly):
        out, base = (1, 0, 0), (0, 1, 0)
        while n:
            if n & 1:
                out = times(out, base, poly)
            base, n = times(base, base, poly), n >> 1
        return out

    for code in range(1, q**3):
        poly = (code % q, code // q % q, code // q // q)
        if poly[0] and power(order, poly) == (1, 0, 0) and all(power(order // p, poly) != (1, 0, 0) for p in factors):
            break
    found, x = [], (1, 0, 0)
    for i in range(v):
        if x[2] == 0:
            found.append(i)
        x = times(x, (0, 1, 0), poly)
    return v, tuple(found)


@lru_cache(maxsize=4)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        a = np.full(n, base, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def digests(data: np.ndarray, width: int, low: int, high: int, which: int = 0) -> np.ndarray:
    """Digest of the `width` bytes from each position in [low, high); all of them must lie within data."""
    up, down = _powers(CHUNK + 2 * LENGTH, which)
    sums = np.zeros(high - low + width, np.uint64)
    np.cumsum(_TABLES[which][data[low : high + width - 1]] * up[: high - low + width - 1], out=sums[1:])
    out = sums[width:] - sums[:-width]
    out *= down[: high - low]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


class Chunk:
    """Texts laid end to end, with what the stages derive from them. The same chunk always gives the same arrays."""

    def __init__(self, blob: bytes, sizes: list[int], length: int, q: int) -> None:
        self.data, self.sizes, self.length = np.frombuffer(zstandard.decompress(blob), np.uint8), np.array(sizes, np.int64), length
        self.v, self.cover = difference_cover(q)
        self.width = length - self.v + 1
        self.ends = np.cumsum(self.sizes)

    def _at(self, positions: np.ndarray, width: int, n_digests: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Those positions from which `width` bytes stay in their text, and the digests of these bytes."""
        positions = positions[self.ends[np.searchsorted(self.ends, positions, "right")] - positions >= width]
        out = [np.empty(len(positions), np.uint64) for _ in range(n_digests)]
        for low in range(0, len(self.data), CHUNK):
            a, b = np.searchsorted(positions, (low, low + CHUNK))
            if a < b:
                start, stop = int(positions[a]), int(positions[b - 1]) + 1
                for which, keys in enumerate(out):
                    keys[a:b] = digests(self.data, width, start, stop, which)[positions[a:b] - start]
        return positions, out

    def samples(self) -> tuple[np.ndarray, list[np.ndarray]]:
        rows = np.arange(-(-len(self.data) // self.v), dtype=np.int64)[:, None] * self.v + np.array(self.cover)[None, :]
        flat = rows.ravel()
        return self._at(flat[flat < len(self.data)], self.width, 1)

    def suffixes(self, tied: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions with a tied sample suffix less than V bytes on, and the digests of their first `length` bytes."""
        near = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(near, np.maximum(tied - self.v + 1, 0), 1)
        np.add.at(near, tied + 1, -1)
        return self._at(np.flatnonzero(np.cumsum(near[:-1]) > 0), self.length, 2)

    def results(self, starts: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """(bytes removed, runs removed, digest of the rest) of each text, where `starts` are the positions of repeated strings."""
        edges = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + self.length, -1)
        gone = np.cumsum(edges[:-1]) > 0
        for size, end in zip(self.sizes.tolist(), self.ends.tolist(), strict=True):
            out = gone[end - size : end]
            if not out.any():
                yield 0, 0, hashlib.sha256(self.data[end - size : end]).hexdigest()
                continue
            runs = int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1]))
            yield int(out.sum()), runs, hashlib.sha256(self.data[end - size : end][~out].tobytes()).hexdigest()


def _cut(keys: list[np.ndarray], n_bytes: int) -> np.ndarray:
    """The first `n_bytes` of the digests, most significant byte first, as columns of up to eight bytes: (columns, rows)."""
    parts = [n_bytes - 8 * i for i in range(len(keys))]
    return np.stack([k >> np.uint64(64 - 8 * min(8, n)) for k, n in zip(keys, parts, strict=True)])


def _ordered(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by all columns, and whether a row in that order equals the one before it."""
    order = np.argsort(columns[0], kind="stable")
    for _ in range(2):
        own = columns[:, order]
        by_first = own[0, 1:] == own[0, :-1]
        same = (own[:, 1:] == own[:, :-1]).all(axis=0)
        if len(columns) == 1 or (by_first == same).all():
            break
        order = np.lexsort(columns[::-1])  # digests that agree in part, which hardly ever are
    return order, np.r_[False, same] if len(order) else same


def _dealt(keys: list[np.ndarray], n_buckets: int, n_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, keys sorted, with those that repeat twice; index of each of `order` into them; `order`, the rows of the bucket).

    Buckets are even ranges of the keys, so that one sort orders them and what is in them."""
    columns = _cut(keys, n_bytes)
    order, same = _ordered(columns)
    bucket = ((keys[0][order] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for low, high in zip(np.r_[0, edges], np.r_[edges, len(order)], strict=True):
        if low == high:
            continue
        again = same[low:high].copy()
        again[0] = False
        kept = ~again | np.r_[False, ~again[:-1]]
        yield int(bucket[low]), columns[:, order[low:high][kept]], np.cumsum(kept) - 1, order[low:high]


def _packed(columns: np.ndarray, n_bytes: int) -> bytes:
    rows = [c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : min(8, n_bytes - 8 * i)] for i, c in enumerate(columns)]
    return np.concatenate(rows, axis=1).tobytes()


def _unpacked(blob: bytes, n_bytes: int) -> np.ndarray:
    rows, out = np.frombuffer(blob, np.uint8).reshape(-1, n_bytes), []
    for i in range(0, n_bytes, 8):
        own = np.zeros((len(rows), 8), np.uint8)
        own[:, : min(8, n_bytes - i)] = rows[:, i : i + 8]
        out.append(own.reshape(-1).view("<u8"))
    return np.stack(out)


def _tied(n_bytes: int):
    """Sorts one bucket and marks, chunk by chunk, the keys that are there twice or more."""

    def run(group: pa.Table) -> pa.Table:
        blobs = [b.as_py() for b in group.column("keys")]
        sizes = [len(b) // n_bytes for b in blobs]
        order, same = _ordered(_unpacked(b"".join(blobs), n_bytes))
        tied = np.zeros(len(order), bool)
        tied[order] = same | np.r_[same[1:], False]
        maps = [np.packbits(x).tobytes() for x in np.split(tied, np.cumsum(sizes)[:-1])]
        return pa.table({"chunk_id": group.column("chunk_id"), "bucket": group.column("bucket"), "tied": pa.array(maps, pa.binary())})

    return run


def _back(keys: list[np.ndarray], n_buckets: int, n_bytes: int, answers: list[dict] | None) -> np.ndarray:
    """Which of the keys are tied, from the bitmaps of their buckets."""
    maps = {a["bucket"]: np.unpackbits(np.frombuffer(a["tied"], np.uint8)).astype(bool) for a in answers or []}
    out = np.zeros(len(keys[0]), bool)
    for bucket, _, index, rows in _dealt(keys, n_buckets, n_bytes):
        out[rows] = maps[bucket][index]
    return out


def _chunks(rows: DataFrame) -> DataFrame:
    """rows: (doc_id, whole, data). One row a chunk: its id, the documents' ids, flags and sizes, and their bytes."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        ids, whole, texts, size = [], [], [], 0
        packer = zstandard.ZstdCompressor(level=1)

        def row() -> pa.RecordBatch:
            columns = [pa.array([part << 32 | n], pa.int64()), pa.array([ids]), pa.array([whole]), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([packer.compress(b"".join(texts))], pa.binary())]
            return pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.list_(id_type)), *columns[2:]], ["chunk_id", "ids", "whole", "sizes", "blob"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                whole.append(batch.column(1)[i].as_py())
                texts.append(batch.column(2)[i].as_py())
                size += len(texts[-1])
                if size >= CHUNK:
                    yield row()
                    ids, whole, texts, size, n = [], [], [], 0, n + 1
        if ids:
            yield row()

    return rows.mapInArrow(run, f"chunk_id long, ids array<{kind}>, whole array<boolean>, sizes array<long>, blob binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = COVER_ORDER) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are taken whole, as UTF-8; null is the empty text. Texts under `length` bytes lose nothing. Copies of one text (told by two
    64-bit hashes and the size) stand in the sort once; the rest of their result follows: from `length` bytes on, all of it goes.
    Repeated rows are copies like any other; ids may be null. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    rows = rows.withColumn("n", F.length("data").cast("long")).withColumn("h1", F.xxhash64("data")).withColumn("h2", F.xxhash64("data", F.lit("second")))
    copies = rows.groupBy("h1", "h2", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.sum("n").alias("bytes"))
    stats = written(copies)
    total, found = stats.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("copies") > 1)).first()
    twice = stats.where("copies > 1").select("h1", "h2", "n", "copies", "first")
    rows = rows.join(F.broadcast(twice) if found <= BROADCAST_ROWS else twice, ["h1", "h2", "n"], "left")
    plain = (F.col("n") < length) | F.col("copies").isNotNull()
    gone = F.when(F.col("n") >= length, F.col("n")).otherwise(F.lit(0).cast("long"))
    direct = rows.where(plain).select(
        "doc_id", F.col("n").alias("n_bytes"), gone.alias("n_removed"), (gone > 0).cast("long").alias("n_spans"),
        F.sha2(F.when(F.col("n") >= length, F.lit("").cast("binary")).otherwise(F.col("data")), 256).alias("kept_sha256"),
    )
    sorted_in = rows.where((F.col("n") >= length) & (F.col("copies").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))))
    chunks = _chunks(sorted_in.select("doc_id", F.col("copies").isNotNull().alias("whole"), "data"))
    # a bucketed table, so that answers are joined to chunks without moving them again
    name, n_parts = f"tidemark_chunks_{uuid.uuid4().hex}", int(max(8, total // (8 * CHUNK)))
    try:
        chunks.repartition(n_parts, "chunk_id").write.bucketBy(n_parts, "chunk_id").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        return direct.unionByName(_removed(spark.table(name), total, length, q))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _removed(chunks: DataFrame, total: int, length: int, q: int) -> DataFrame:
    """The rows of the documents in the chunks that are not marked whole, written."""
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    v, cover = difference_cover(q)
    n_samples = total * len(cover) / v
    a_buckets = int(max(8, n_samples * SAMPLE_BYTES // BUCKET))
    b_buckets = int(max(8, total * SUFFIX_BYTES // 8 // BUCKET))

    def sort(dealt: DataFrame, n_bytes: int) -> DataFrame:
        tied = dealt.groupBy("bucket").applyInArrow(_tied(n_bytes), "chunk_id long, bucket int, tied binary")
        return written(tied.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "tied")).alias("answers")))

    def forward(chunk_id: int, keys: list[np.ndarray], n_buckets: int, n_bytes: int) -> pa.RecordBatch:
        dealt = [(b, _packed(k, n_bytes)) for b, k, _, _ in _dealt(keys, n_buckets, n_bytes)]
        return pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in dealt], pa.int32()), pa.array([chunk_id] * len(dealt), pa.int64()), pa.array([k for _, k in dealt], pa.binary())], ["bucket", "chunk_id", "keys"]
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Chunk, pa.DataType | None]]:
        for batch in batches:
            id_type = next((f.type.value_type for f in batch.schema if f.name == "ids"), None)
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                yield row, Chunk(row["blob"], row["sizes"], length, q), id_type

    def sample_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk, _ in each(batches):
            yield forward(row["chunk_id"], chunk.samples()[1], a_buckets, SAMPLE_BYTES)

    def candidates(row: dict, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        positions, keys = chunk.samples()
        return chunk.suffixes(positions[_back(keys, a_buckets, SAMPLE_BYTES, row["answers"])])

    def suffix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk, _ in each(batches):
            yield forward(row["chunk_id"], candidates(row, chunk)[1], b_buckets, SUFFIX_BYTES)

    def outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, chunk, id_type in each(batches):
            positions, keys = candidates(row, chunk)
            starts = positions[_back(keys, b_buckets, SUFFIX_BYTES, row["found"])]
            kept = [(i, n, *r) for i, n, w, r in zip(row["ids"], row["sizes"], row["whole"], chunk.results(starts), strict=True) if not w]
            columns = list(zip(*kept, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    dealt = "bucket int, chunk_id long, keys binary"
    samples = sort(chunks.select("chunk_id", "sizes", "blob").mapInArrow(sample_keys, dealt), SAMPLE_BYTES)
    chunks = chunks.join(samples, "chunk_id", "left")
    suffixes = sort(chunks.select("chunk_id", "sizes", "blob", "answers").mapInArrow(suffix_keys, dealt), SUFFIX_BYTES)
    chunks = chunks.join(suffixes.withColumnRenamed("answers", "found"), "chunk_id", "left")
    sorted_out = chunks.select("ids", "whole", "sizes", "blob", "answers", "found").mapInArrow(outcome, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return written(sorted_out)
