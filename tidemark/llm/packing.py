"""Best-fit packing of token pieces by minimum bin slack.

Texts are tokenised and cut in one pass over the documents. Lengths lie between 1 and the sequence size, so the piece counts by length
are a table of bounded size; on it, bins are made one pattern at a time: the longest piece left, plus the fullest combination of the
other lengths, found by subset sums in bitsets; the pattern is taken as often as the counts allow. Pieces then find their places by
their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

SIZE, END_ID = 1024, 2
#: Characters with the Unicode property White_Space; pre-tokens never reach from another character into one of these.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Nor do they reach from a letter or digit into a mark that is no apostrophe, so words and the marks behind them are chunks of their own.
_WORD, _MARK = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-&(-/:-@\\[-`{-~"
_CHUNK = re.compile(f"[{_SPACE}]*+[{_WORD}]++(?=[{_MARK}])|[{_SPACE}]*+[^{_SPACE}]++|[{_SPACE}]++")
_BLANK = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c))
#: Chunks whose ids a worker keeps (some 200 bytes each); beyond, it starts anew.
CACHED = 1_000_000
#: Longer chunks are encoded without being kept.
LONGEST = 64
#: Ranks are counted apart in so many hashed parts of a length at least, with about so many rows in each.
PARTS, PART_ROWS = 256, 20_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _opens(path: str) -> np.ndarray:
    """Which ids stand for text that starts with a space, written U+0120 in byte-level vocabularies."""
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    opens = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        opens[i] = token.startswith("\u0120")
    return opens


_known: dict[str, dict[str, bytes]] = {}


def _encode_chunks(chunks: list[str], path: str) -> Iterator[tuple[str, bytes]]:
    """Chunks of one space and what follows are encoded end to end and told apart by the ids that open with a space; others apart."""
    tokenizer, opens = _tokenizer(path), _opens(path)
    joined, apart = [], []
    for c in chunks:
        (joined if c[0] == " " and c[1:2] not in _BLANK and len(c) > 1 else apart).append(c)
    for start in range(0, len(joined), 2048):
        part = joined[start : start + 2048]
        ids = np.array(tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
        first = np.flatnonzero(opens[ids])
        if len(first) != len(part):  # a tokenizer of another kind
            apart += part
            continue
        blob, stops = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
        yield from zip(part, [blob[a:b] for a, b in pairwise(stops)], strict=True)
    for start in range(0, len(apart), 4096):
        part = apart[start : start + 4096]
        found = tokenizer.encode_batch_fast(part, add_special_tokens=False)
        yield from zip(part, [np.array(f.ids, "<u4").tobytes() for f in found], strict=True)


def encode(texts: list[str | None], path: str) -> Iterator[bytes]:
    """Ids of each whole text as little-endian unsigned 32-bit integers, without the end id; null is the empty text.

    Ids of a chunk (white space and a word, or what else follows up to the next white space) depend on the chunk alone, so each is encoded once.
    """
    known = _known.setdefault(path, {})
    if len(known) > CACHED:
        known.clear()
    rows = []
    missing = set()
    for text in texts:
        chunks = _CHUNK.findall(text or "")
        found = list(map(known.get, chunks))
        if None in found:
            missing.update([c for c, ids in zip(chunks, found, strict=True) if ids is None])
            rows.append((chunks, found))
        else:
            rows.append((None, found))
    fresh = dict(_encode_chunks(list(missing), path))
    known.update((c, ids) for c, ids in fresh.items() if len(c) <= LONGEST)
    for chunks, found in rows:
        if chunks is not None:
            found = [fresh[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        yield b"".join(found)


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than size where n is over size."""
    first = n % size or size
    return [(0, min(n, first)), *((s, size) for s in range(first, n, size))] if n else []


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, 4 bytes an id). Whole texts are read."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for part in slices(batches):
            at, out = [], [[] for _ in kind]
            for i, ids in enumerate(encode(part.column(1).to_pylist(), path)):
                ids += END_ID.to_bytes(4, "little")
                for j, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    piece = ids[4 * start : 4 * (start + length)]
                    at.append(i)
                    for column, value in zip(out, (j, start, length, zlib.crc32(piece), piece), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, f.type) for c, f in zip(out, kind, strict=True))], ["doc_id", *kind.names])

    more = ", ids binary" if with_ids else ""
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long{more}")


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to room: bitset subset sums, long lengths first."""
    steps, reach, whole = [], 1, (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & whole
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces of each length in a bin, number of such bins) that use up all counts. Every step uses up a length or halves it."""
    left, made = {x: n for x, n in counts.items() if n}, []
    while left:
        top = max(left)
        rest = {x: n - (x == top) for x, n in left.items()}
        pattern = fullest(size - top, rest)
        pattern[top] = pattern.get(top, 0) + 1
        times = min(left[x] // n for x, n in pattern.items())
        made.append((pattern, times))
        for x, n in pattern.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return made


def places(made: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, pieces a bin, first sequence, offset in it), by rank."""
    out, used, sequence = {}, {}, 0
    for pattern, times in made:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return out


def pack(cuts: DataFrame, size: int = SIZE) -> DataFrame:
    """cuts: rows of pieces(). Adds sequence_id and offset; every sequence is filled without gaps from 0 and holds at most size ids.

    Repeated rows, null ids and equal texts are pieces like any other. No pieces give no rows. The driver sees piece counts by length
    (at most `size` numbers) and sends back the patterns, whose number is bounded by the lengths too.
    """
    n = cuts.count()
    parts = max(PARTS, n // PART_ROWS)
    rows = cuts.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    groups = rows.groupBy("length", "__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    groups = written(groups.select("length", "__part", "n", F.coalesce(before, F.lit(0)).alias("before")))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = cuts.sparkSession.sparkContext.broadcast(places(plan(counts, size)))
    local = F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("__rank", local.cast("long")).join(groups.select("length", "__part", "before"), ["length", "__part"])
    ranked = ranked.select(*cuts.columns, (F.col("before") + F.col("__rank")).alias("__rank"))
    index = cuts.columns.index("length")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.schema.fields), "sequence_id long", "offset long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = {length: ([r[0] for r in x], x) for length, x in table.value.items()}
        for batch in batches:
            found = []
            for length, rank in zip(batch.column(index).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                starts, x = ranges[length]
                first, each, sequence, offset = x[bisect.bisect_right(starts, rank) - 1]
                bin_, slot = divmod(rank - first, each)
                found.append((sequence + bin_, offset + slot * length))
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, from pieces packed with their ids. A sequence holds at most `size` pieces."""
    each = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return each.select("sequence_id", F.expr("aggregate(x, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
