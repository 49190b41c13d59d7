"""Near-duplicate vectors by cosine, over product-quantised inverted lists.

Unit vectors are put into coarse lists by their nearest centroid; what is left of them is coded in sub-spaces. A query looks into every
list that can hold a vector within the distance `reach` of it: the border with its own list is no further than the reach, and the reach
touches the shell between the list's least and largest radius. Both always hold, so no link is lost, whatever the spread of the vectors;
where vectors have no clusters, most lists are looked into. Lists are packed into groups, neighbours together, and a query goes to a
group once; of two groups, the vectors of the lower one ask. In a list, distances to the codes are read from tables; by the triangle
inequality, a code whose distance exceeds the reach by more than its own error cannot be a link, and all others are measured again
exactly, in double precision. Each size of vectors has lists of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components
from .simhash import Forest

THRESHOLD = 0.9
#: Bound of the sample that centroids and codes are fitted on: about so many distinct vectors, chosen by hash.
SAMPLE = 6000
MAX_LISTS = 2048
SUBSPACES, CODES = 16, 64
#: Deviations of the border distance that probes cover; None covers all of them, so that no link is missed.
Z = None
#: Vectors of a group of lists held by one task, and queries that meet them there, about.
TARGETS, QUERIES = 4096, 8192
#: Groups of lists, so that small tables are spread too.
GROUPS = 32
SLACK = 1e-6


def unit(values: list | None) -> np.ndarray | None:
    """The vector over its norm, in doubles; None for what links with nothing: null, empty, zero, null or non-finite components."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / math.sqrt(x @ x)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Index:
    def __init__(self, sample: np.ndarray, n: int, threshold: float, z: float | None = Z) -> None:
        rng = np.random.default_rng(2)
        self.size = sample.shape[1]
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold))
        self.margin = self.reach if z is None else min(1.0, z / math.sqrt(self.size)) * self.reach
        self.centres = _kmeans(sample, min(len(sample), max(1, min(MAX_LISTS, int(math.sqrt(n))))), rng)
        self.parts = [p for p in np.array_split(np.arange(self.size), min(SUBSPACES, self.size)) if len(p)]
        rest = sample - self.centres[self.home(sample)]
        self.books = [_kmeans(rest[:, p], min(CODES, len(rest)), rng) for p in self.parts]
        self.least, self.most = np.zeros(len(self.centres)), np.full(len(self.centres), np.inf)

    def gaps(self, x: np.ndarray) -> np.ndarray:
        return (self.centres**2).sum(1)[None, :] - 2 * x @ self.centres.T

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.gaps(x).argmin(axis=1)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Boolean, vectors x lists: lists whose border with the home list is within the margin, and whose shell is within the reach."""
        gaps, home = self.gaps(x), self.home(x)
        squares, own = (self.centres**2).sum(1), self.centres[home]
        apart = np.sqrt(np.maximum(0.0, squares[home][:, None] + squares[None, :] - 2 * own @ self.centres.T))
        near = gaps - gaps[np.arange(len(x)), home][:, None] <= 2 * apart * self.margin + SLACK
        radius = np.sqrt(np.maximum(0.0, gaps + (x**2).sum(1)[:, None]))
        return near & (radius - self.reach <= self.most + SLACK) & (radius + self.reach >= self.least - SLACK)

    def chain(self) -> list[int]:
        """The lists in an order in which neighbours stand together: each time the nearest of those left."""
        left = np.ones(len(self.centres), bool)
        out, at = [], 0
        while True:
            out.append(at)
            left[at] = False
            if not left.any():
                return out
            at = int(np.where(left, ((self.centres - self.centres[at]) ** 2).sum(1), np.inf).argmin())

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the distance of each vector from what its code says."""
        rest = x - self.centres[home]
        out, error = np.zeros((len(x), len(self.parts)), np.uint8), np.zeros(len(x))
        for m, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            d = (book**2).sum(1)[None, :] - 2 * rest[:, p] @ book.T
            out[:, m] = d.argmin(axis=1)
            error += ((rest[:, p] - book[out[:, m]]) ** 2).sum(1)
        return out, np.sqrt(error) + SLACK

    def near(self, queries: np.ndarray, home: int, codes: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, code) that may be links, by sums of table entries."""
        rest = queries - self.centres[home]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for m, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            table = (rest[:, p] ** 2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * rest[:, p] @ book.T
            total += table.astype(np.float32)[:, codes[:, m]]
        return np.nonzero(total <= ((self.reach + errors + 1e-3) ** 2).astype(np.float32)[None, :])


def _matrix(blobs: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.float64).reshape(-1, size)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, z: float | None = Z
) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (smallest id reachable), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; others link with
    those of their size. Equal vectors, repeated rows among them, link with each other and stand in the search once. Null ids take part and
    get a null component_id only where no other id is reachable. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unit(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else x.tobytes() for x in found], pa.binary())], ["vec_id", "u"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    units = rows.mapInArrow(clean, f"vec_id {id_type}, u binary").withColumn("h1", F.xxhash64("u")).withColumn("h2", F.xxhash64("u", F.lit("second")))
    units = written(units)
    known = units.where("u is not null")
    # equal vectors: one row in the search; u itself is the same for all of a group
    reps = known.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("u").alias("u"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()))
    n = reps.count()
    if n == 0:
        alone = F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
        return units.select("vec_id", *alone)
    sizes = {r["size"]: r["n"] for r in reps.groupBy((F.length("u") / 8).cast("int").alias("size")).agg(F.count("*").alias("n")).collect()}
    share = min(1.0, SAMPLE / n)
    sample = reps.where(F.shiftrightunsigned("h1", 11) / float(1 << 53) < share).select("h1", "u") if share < 1 else reps.select("h1", "u")
    taken: dict[int, list[bytes]] = {size: [] for size in sizes}
    for _, u in sorted((r["h1"], bytes(r["u"])) for r in sample.collect()):
        taken[len(u) // 8].append(u)
    # any centre will do for a size that the sample missed
    indexes = {size: Index(np.frombuffer(b"".join(us) or bytes(8 * size), np.float64).reshape(-1, size), sizes[size], threshold, z) for size, us in taken.items()}
    shipped = spark.sparkContext.broadcast(indexes)

    def by_size(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        """Parts of a batch with vectors of one size: the size, the part and its vectors."""
        lengths = np.array([len(u) for u in batch.column(2).to_pylist()], np.int64) // 8
        for size in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == size)
            for start in range(0, len(at), rows):
                part = batch.take(pa.array(at[start : start + rows]))
                yield size, part, _matrix(part.column(2), size)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part, x in by_size(batch, 1024):
                index = shipped.value[size]
                home = index.home(x)
                codes, errors = index.codes(x, home)
                radius = np.sqrt(((x - index.centres[home]) ** 2).sum(1))
                columns = [pa.array(np.full(len(x), size), pa.int32()), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors), pa.array(radius)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], ["node", "copies", "u", "size", "home", "codes", "error", "radius"])

    placed = written(reps.select("node", "copies", "u").mapInArrow(assign, "node long, copies long, u binary, size int, home int, codes binary, error double, radius double"))
    held = {(r["size"], r["home"]): r for r in placed.groupBy("size", "home").agg(F.count("*").alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most")).collect()}
    for (size, home), r in held.items():
        indexes[size].least[home], indexes[size].most[home] = r["least"], r["most"]
    for size, index in indexes.items():
        index.most[[x for x in range(len(index.centres)) if (size, x) not in held]] = -np.inf  # nothing is there to be found
    # long lists are cut, short ones packed, so that no list is one task
    room = max(1, min(TARGETS, -(-n // GROUPS)))
    where: dict[tuple[int, int], list[int]] = {}
    group, filled = -1, 0
    for size in sorted(indexes):
        filled = room
        for x in indexes[size].chain():
            cuts = -(-held[size, x]["n"] // room) if (size, x) in held else 0
            for _ in range(cuts):
                here = held[size, x]["n"] / cuts
                if filled + here > room:
                    group, filled = group + 1, 0
                filled += here
                where.setdefault((size, x), []).append(group)
    shipped = spark.sparkContext.broadcast(indexes)
    packed = spark.sparkContext.broadcast(where)

    def asking(size: int, part: pa.RecordBatch, x: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Of each vector the place in the part, its own group, and the groups from its own on that it looks into."""
        for i, (node, home, looked) in enumerate(zip(part.column(0).to_pylist(), part.column(4).to_pylist(), shipped.value[size].probes(x), strict=True)):
            cuts = packed.value[size, home]
            own = cuts[hash((node, 1)) % len(cuts)]
            yield i, own, sorted({g for y in np.flatnonzero(looked).tolist() for g in packed.value[size, y] if g > own} | {own})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for size, part, x in by_size(batch, 1024):
                for _, _, groups in asking(size, part, x):
                    found.update(groups)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["g", "n"])

    asked = {r["g"]: r["n"] for r in placed.mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    # much-asked groups meet their queries in parts
    parts = spark.sparkContext.broadcast({g: -(-m // QUERIES) for g, m in asked.items()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Targets have role 0, queries of other groups role 1, of the same group role 2."""
        for batch in batches:
            for size, part, x in by_size(batch, 512):
                out = []
                for i, own, groups in asking(size, part, x):
                    node = part.column(0)[i].as_py()
                    out += [(own, s, 0, i) for s in range(parts.value[own])]
                    out += [(g, hash((node, 2)) % parts.value[g], 1 if g > own else 2, i) for g in groups]
                at = pa.array([o[3] for o in out], pa.int64())
                target = pa.array([o[2] == 0 for o in out])
                columns = [*(part.column(c).take(at) for c in (0, 1, 2, 3, 4)), *(pc.if_else(target, part.column(c).take(at), pa.scalar(None, part.column(c).type)) for c in (5, 6))]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([o[j] for o in out], pa.int32()) for j in range(3)), *columns],
                    ["g", "s", "role", "node", "copies", "u", "size", "home", "codes", "error"],
                )

    keys = ["g", "s"]
    dealt = placed.mapInArrow(deal, "g int, s int, role int, node long, copies long, u binary, size int, home int, codes binary, error double")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Targets of a group (role 0) come first and are held; queries pass by. Gives (node, links, null) and forest links (a, null, b)."""
        key, held, target, forest = None, [], None, Forest()

        def linked() -> pa.RecordBatch:
            edges = forest.edges()
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.nulls(len(edges), pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["node", "n", "other"])

        def counted(nodes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            some = counts > 0
            return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(counts[some]), pa.nulls(int(some.sum()), pa.int64())], ["node", "n", "other"])

        def done() -> Iterator[pa.RecordBatch]:
            if target is not None:
                yield counted(target[0], back)
            if forest.up:
                yield linked()

        for batch in batches:
            at = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1)
            role = batch.column(2).to_numpy()
            bounds = np.flatnonzero((np.diff(at, axis=0) != 0).any(axis=1)) + 1
            for low, high in zip(np.r_[0, bounds], np.r_[bounds, len(at)], strict=True):
                if low == high:
                    continue
                if key != tuple(at[low]):
                    yield from done()
                    key, held, target, forest = tuple(at[low]), [], None, Forest()
                    index = shipped.value[batch.column(6)[int(low)].as_py()]
                split = int(low + np.searchsorted(role[low:high], 1))
                if split > low:
                    part = batch.slice(low, split - low)
                    held.append((part.column(3).to_numpy(), part.column(4).to_numpy(), _matrix(part.column(5), index.size), part.column(7).to_numpy(), np.frombuffer(b"".join(part.column(8).to_pylist()), np.uint8).reshape(part.num_rows, -1), part.column(9).to_numpy()))
                if split == high or not held:
                    continue
                if target is None:
                    target = [np.concatenate(x) for x in zip(*held, strict=True)]
                    back = np.zeros(len(target[0]), np.int64)
                    lists = [(x, np.flatnonzero(target[3] == x)) for x in np.unique(target[3]).tolist()]
                nodes, copies, x, _, codes, errors = target
                for start in range(split, high, 256):
                    part = batch.slice(start, min(256, high - start))
                    asked, times, q = part.column(3).to_numpy(), part.column(4).to_numpy(), _matrix(part.column(5), index.size)
                    looked, other = index.probes(q), role[start : start + part.num_rows] == 1
                    counts = np.zeros(part.num_rows, np.int64)
                    for home, of in lists:
                        by = np.flatnonzero(looked[:, home])
                        i, j = index.near(q[by], home, codes[of], errors[of])
                        i, j = by[i], of[j]
                        good = np.empty(len(i), bool)
                        for a in range(0, len(i), 1 << 16):
                            b = a + (1 << 16)
                            good[a:b] = np.einsum("ij,ij->i", q[i[a:b]], x[j[a:b]]) >= threshold
                        good &= asked[i] != nodes[j]
                        i, j = i[good], j[good]
                        for a, b in zip(asked[i].tolist(), nodes[j].tolist(), strict=True):
                            forest.link(a, b)
                        np.add.at(counts, i, copies[j])
                        # a query of another group is not asked back
                        np.add.at(back, j[other[i]], times[i[other[i]]])
                    yield counted(asked, counts)
        yield from done()

    found = written(dealt.repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(search, "node long, n long, other long"))
    roots = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    classes = reps.select("h1", "h2", "node", "copies", "least").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = written(classes)
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(classes.join(named, "root").select("h1", "h2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.lit(True).alias("known")))
    # a vector that links with nothing has no class
    out = units.withColumn("h1", F.when(F.col("u").isNotNull(), F.col("h1"))).select("vec_id", "h1", "h2").join(classes, ["h1", "h2"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: The same rows, in DuckDB.
SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.9
), reach AS (
  SELECT vec_id AS n, vec_id AS r FROM e UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.n
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN (SELECT n, min(r) AS component_id FROM reach GROUP BY n) c ON c.n = e.vec_id
"""
