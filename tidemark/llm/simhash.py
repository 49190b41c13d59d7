"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are cut into k blocks. Anchors are the words that are constant on each block: a direct sum of repetition
codes, which covers the space with radius floor(length / 2) a block. A fingerprint is at home at the anchor of its blockwise
majorities, within that radius. If two fingerprints differ in at most t bits, the second lies within the first one's home radius
plus t, counted block by block; so each fingerprint is also replicated to all anchors whose excess over the radius is t at most
(every set of blocks whose majorities can be turned by t flips in all), and home rows meet replicas anchor by anchor. No link is lost.

Wide thresholds use a denser code. The 64 bits are cut into segments of 23, 23 and 18; of t differing bits, one segment has no more
than its share. Anchors of a segment are the words of the perfect binary Golay code, whose covering radius is 3: a fingerprint is at
home at the one within 3 bits of its segment, and replicated to all within 3 bits plus the segment's share. Where chance would link
fingerprints, a second one, of other hashes of the same shingles, has to be near as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .components import connected_components

SEED = 42
#: Home rows that an anchor holds on average; it sets the number of anchors.
HOME_ROWS = 16
#: From this threshold on, Golay anchors are used.
WIDE = 5
#: Home rows that one task holds; anchors with more are cut, and their replicas meet each part.
SPLIT = 50_000
# Generator of the Golay code, and the segments it covers.
GOLAY, SEGMENTS = 0b101011100011, ((0, 23), (23, 23), (46, 18))
#: Fingerprints compared at once: bounds the work space of a comparison.
BLOCK = 1 << 20


def _bits(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[start : start + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str | None, words_per_shingle: int = 3) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if there are fewer words; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        return np.array([digest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first = (ends - sizes)[: len(words) - words_per_shingle + 1].tolist()
    last = ends[words_per_shingle - 1 :].tolist()
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first))


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Bit i is set if it is set in over half the shingles' XXH64. Null is read as the empty text, whose fingerprint is zero."""
    return _bits(shingle_hashes(text, words_per_shingle))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of what was hashed, for the second fingerprint."""
    out = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, second: bool = False) -> DataFrame:
    """(doc_id, fp long, fp2 long) of each row: whole texts, null as empty; fp2 is zero unless asked for. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes = [shingle_hashes(t, words_per_shingle) for t in part.column(1).to_pylist()]
            prints = np.array([_bits(h) for h in hashes], np.uint64)
            others = np.array([_bits(mixed(h)) if second else 0 for h in hashes], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64)), pa.array(others.view(np.int64))], ["doc_id", "fp", "fp2"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, fp2 long")


def blocks_for(n: int) -> int:
    """Number of blocks, so of bits of an anchor, for n distinct fingerprints."""
    return max(4, min(40, math.ceil(math.log2(max(2, n) / HOME_ROWS))))


def _blocks(k: int) -> list[tuple[int, np.uint64]]:
    """(length, mask) of each block; block i takes the bits j with j mod k = i."""
    return [(len(bits), np.uint64(sum(1 << j for j in bits))) for bits in (range(i, 64, k) for i in range(k))]


def anchors(prints: np.ndarray, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchor of each print, index and anchor of each replica)."""
    home = np.zeros(len(prints), np.int64)
    costs = []
    for i, (length, mask) in enumerate(_blocks(k)):
        ones = np.bitwise_count(prints & mask).astype(np.int64)
        major = ones > length // 2
        home |= major.astype(np.int64) << i
        costs.append(np.where(major, ones - length // 2, length // 2 + 1 - ones))
    index, anchor, left = np.arange(len(prints)), home.copy(), np.full(len(prints), threshold)
    for i, cost in enumerate(costs):
        can = cost[index] <= left
        index, anchor, left = (
            np.concatenate([index, index[can]]),
            np.concatenate([anchor, anchor[can] ^ (1 << i)]),
            np.concatenate([left, left[can] - cost[index[can]]]),
        )
    return home, index, anchor


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator, as polynomials over GF(2): 11 bits, zero for the words of the code."""
    out = words.astype(np.int64)
    for i in range(22, 10, -1):
        out = np.where(out >> i & 1, out ^ (GOLAY << (i - 11)), out)
    return out


@lru_cache(maxsize=1)
def _cosets() -> tuple[np.ndarray, list[np.ndarray]]:
    """For each syndrome the lightest word that has it, and all words that have it, by weight, up to weight 8."""
    light = np.concatenate([np.array([sum(1 << i for i in c) for c in combinations(range(23), w)], np.int64) for w in range(4)])
    leaders = np.zeros(2048, np.int64)
    leaders[_syndromes(light)] = light
    code = np.zeros(1, np.int64)
    for i in range(12):
        code = np.concatenate([code, code ^ (GOLAY << i)])
    found = []
    for leader in leaders:
        words = leader ^ code
        words = words[np.argsort(np.bitwise_count(words), kind="stable")]
        found.append(words[np.bitwise_count(words) <= 8])
    return leaders, found


def shares(threshold: int) -> list[int]:
    """Of `threshold` differing bits, at least one segment has no more than its share."""
    return [(threshold - 2 + i) // 3 for i in (2, 1, 0)]


@lru_cache(maxsize=8)
def _reach(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each coset up to a weight, laid end to end: words, starts and counts."""
    near = [w[np.bitwise_count(w) <= radius] for w in _cosets()[1]]
    counts = np.array([len(w) for w in near])
    return np.concatenate(near), np.cumsum(counts) - counts, counts


def golay_homes(prints: np.ndarray) -> np.ndarray:
    """Home anchors, one row a segment. An anchor is a word of the code and its segment."""
    words = [(prints >> np.uint64(low) & np.uint64((1 << length) - 1)).astype(np.int64) for low, length in SEGMENTS]
    return np.stack([w ^ _cosets()[0][_syndromes(w)] | segment << 23 for segment, w in enumerate(words)])


def golay_anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchors, index and anchor of each replica)."""
    index, anchor = [], []
    for segment, ((low, length), share) in enumerate(zip(SEGMENTS, shares(threshold), strict=True)):
        words = (prints >> np.uint64(low) & np.uint64((1 << length) - 1)).astype(np.int64)
        syndromes = _syndromes(words)
        near, starts, counts = _reach(3 + share)
        times = counts[syndromes]
        at = np.repeat(np.arange(len(words)), times)
        within = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        index.append(at)
        anchor.append(words[at] ^ near[np.repeat(starts[syndromes], times) + within] | segment << 23)
    return golay_homes(prints), np.concatenate(index), np.concatenate(anchor)


def near_pairs(home: np.ndarray, other: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs within threshold bits. Large sides go by equal segments (threshold + 1 of them, one must be equal)."""
    if threshold >= WIDE or len(home) * len(other) <= 64 * BLOCK:
        step = max(1, BLOCK // max(1, len(home)))
        for start in range(0, len(other), step):
            j, i = np.nonzero(np.bitwise_count(other[start : start + step, None] ^ home[None, :]) <= threshold)
            yield i, j + start
        return
    cuts = np.linspace(0, 64, threshold + 2).astype(int)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        mask = np.uint64(((1 << int(high)) - 1) ^ ((1 << int(low)) - 1))
        order = np.argsort(home & mask, kind="stable")
        keys, probes = (home & mask)[order], other & mask
        first, last = np.searchsorted(keys, probes, "left"), np.searchsorted(keys, probes, "right")
        ends = np.cumsum(last - first)
        start = 0
        while start < len(other):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK, "right")))
            sizes = (last - first)[start:stop]
            j = np.repeat(np.arange(start, stop), sizes)
            within = np.arange(len(j)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            i = order[np.repeat(first[start:stop], sizes) + within]
            near = np.bitwise_count(home[i] ^ other[j]) <= threshold
            yield i[near], j[near]
            start = stop


class Forest:
    """Union-find over the nodes that have links: keeps a spanning forest, never all pairs of a group."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in self.up if self.root(x) != x]


def _compare(threshold: int, both: int):
    """Rows come sorted by (anchor, part, role), home rows (role 0) first: these are held, replicas pass by in batches. What a row of
    replicas meets is named by its component, so that a group of near copies costs a link a row and not a link a pair."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def out(forest: Forest) -> pa.RecordBatch:
        pairs = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held, forest = None, [], None, Forest()
        for batch in batches:
            at, cut, role, node, fp, fp2 = (batch.column(i).to_numpy() for i in range(6))
            fp, fp2 = fp.view(np.uint64), fp2.view(np.uint64)
            bounds = np.flatnonzero((np.diff(at) != 0) | (np.diff(cut) != 0)) + 1
            for low, high in zip(np.r_[0, bounds], np.r_[bounds, len(at)], strict=True):
                if low == high:
                    continue
                if (at[low], cut[low]) != key:
                    if forest.up:
                        yield out(forest)
                    key, parts, held, forest = (at[low], cut[low]), [], None, Forest()
                split = low + int(np.searchsorted(role[low:high], 1))
                if split > low:
                    parts.append((node[low:split], fp[low:split], fp2[low:split]))
                if split == high or not parts:
                    continue
                if held is None:
                    held = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    component = held[0].copy()
                nodes, prints, seconds = held
                for i, j in near_pairs(prints, fp[split:high], threshold):
                    j = j + split
                    near = (nodes[i] != node[j]) & (np.bitwise_count(prints[i] ^ fp[j]).astype(np.int64) + np.bitwise_count(seconds[i] ^ fp2[j]) <= both)
                    i, j = i[near], j[near]
                    if not len(i):
                        continue
                    names, place = np.unique(component[i], return_inverse=True)
                    for met in np.unique(place * len(node) + j).tolist():
                        forest.link(int(names[met // len(node)]), int(node[met % len(node)]))
                    names, place = np.unique(component, return_inverse=True)
                    component = np.array([forest.root(x) for x in names.tolist()], np.int64)[place]
        if forest.up:
            yield out(forest)

    return run


def links(prints: DataFrame, threshold: int, n: int, both: int = 128) -> DataFrame:
    """prints: (node, fp, fp2), one row a node. Links (a, b) that connect all nodes whose fp are within threshold bits of each other, and
    fp and fp2 within `both` bits in all."""
    k = blocks_for(n)

    def at_anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if threshold >= WIDE:
            return golay_anchors(prints, threshold)
        home, index, anchor = anchors(prints, k, threshold)
        return home[None, :], index, anchor

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            fp = part.column(0).to_numpy().view(np.uint64)
            at, n = np.unique(golay_homes(fp) if threshold >= WIDE else anchors(fp, k, 0)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["anchor", "n"])

    # anchors that hold many: at most one for every SPLIT home rows
    large = prints.select("fp").mapInArrow(homes, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > SPLIT)
    cuts = {r["anchor"]: -(-r["n"] // SPLIT) for r in large.collect()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            node, fp, fp2 = (part.column(i).to_numpy() for i in range(3))
            home, index, anchor = at_anchors(fp.view(np.uint64))
            own = np.tile(np.arange(len(fp)), len(home))
            for at, role, of in ((home.ravel(), 0, own), (anchor, 1, index)):
                cut = np.zeros(len(at), np.int64)
                for hot in np.intersect1d(at, list(cuts)).tolist():
                    here = np.flatnonzero(at == hot)
                    if role == 0:
                        cut[here] = node[of[here]] % cuts[hot]
                    else:
                        more = np.repeat(here, cuts[hot] - 1)
                        at, of = np.r_[at, at[more]], np.r_[of, of[more]]
                        cut = np.r_[cut, np.tile(np.arange(1, cuts[hot]), len(here))]
                columns = [pa.array(at), pa.array(cut), pa.array(np.full(len(at), role, np.int32)), pa.array(node[of]), pa.array(fp[of]), pa.array(fp2[of])]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "part", "role", "node", "fp", "fp2"])

    spread_out = prints.select("node", "fp", "fp2").mapInArrow(spread, "anchor long, part long, role int, node long, fp long, fp2 long")
    return spread_out.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "role").mapInArrow(_compare(threshold, both), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, threshold: int = 2, both: int | None = None
) -> DataFrame:
    """One row a document: doc_id, fp long, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Fingerprints link at `threshold` or fewer differing bits; with `both`, only if they and the second fingerprints differ in so many
    bits in all. Empty and null texts have fingerprint zero and link like any other. Repeated rows and equal texts meet in one
    fingerprint before any comparison, so groups of copies cost one row. A null id takes part, but never becomes a component_id unless
    it is alone. An empty table gives an empty table.
    """
    rows = written(fingerprints(docs, id_col, text_col, words_per_shingle, both is not None))
    prints = rows.groupBy("fp", "fp2").agg(F.min("doc_id").alias("least"))
    prints = written(prints.withColumn("node", F.monotonically_increasing_id()))
    found = connected_components(links(prints, threshold, prints.count(), 128 if both is None else both))
    roots = prints.join(found, "node", "left").select("fp", "fp2", "least", F.coalesce("root", "node").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(roots.join(named, "root").select("fp", "fp2", "component_id"))
    return rows.join(classes, ["fp", "fp2"]).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
