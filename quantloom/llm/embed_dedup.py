"""Embedding near-dedup by an inverted multi-index.

Vectors are normalised in double precision; equal vectors form one class and are searched as one. Two independent codebooks,
one for each half of the vector, are fitted by k-means on a bounded sample (sample_rows); their product is a grid of cells
and every class is indexed in its cell. Each class is also a query: the multi-sequence algorithm visits the grid's cells in
the order of their summed distances to the query's halves. How many cells are visited follows from the target recall: sample
vectors are turned until their cosine is exactly the threshold, and the number is the one that finds that share of them.
Every vector found is verified by its cosine, so no link below the threshold is returned.

Queries travel once for each first-half code that they visit and are multiplied with the residents of the cells that they
visit only. The residents of a code are split into blocks of bounded size and so are its queries, so that one cell may hold a
third of all vectors. Each block sends back counts and a spanning forest of its links, never the pairs.

Defined cases: null vectors, zero vectors and vectors with null or non-finite components link with nothing; vectors link only
with vectors of their own dimension; repeated rows link with one another; extra columns are not used; an empty table gives
no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, ship
from .components import connected_components


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (centers**2).sum(1) - 2 * x @ centers.T


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centers).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _first(d: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values in order, ties by place."""
    if n >= len(d):
        return np.argsort(d, kind="stable")
    near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
    return near[np.argsort(d[near], kind="stable")][:n]


def multi_sequence(d1: np.ndarray, d2: np.ndarray, cells: int) -> list[tuple[int, int]]:
    """The `cells` pairs (i, j) of least d1[i] + d2[j], nearest first."""
    o1, o2 = _first(d1, cells).tolist(), _first(d2, cells).tolist()  # a cell of place (i, j) has i * j before it
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap, reached, out = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < cells:
        _, i, j = heapq.heappop(heap)
        out.append((o1[i], o2[j]))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in reached:
                reached.add((p, q))
                heapq.heappush(heap, (a[p] + b[q], p, q))
    return out


class MultiIndex:
    """Codebooks of the two halves and the number of cells a query visits. A codebook has the square root of an eighth of the
    vectors, so that a cell holds about eight, up to `most` (2,048: four million cells, 33 million vectors; beyond that the
    cells hold more each, and their blocks are more)."""

    def __init__(self, sample: np.ndarray, vectors: int, threshold: float, target_recall: float, probes: int = 400, most: int = 2048):
        self.cut = sample.shape[1] // 2
        k = int(np.clip(round((vectors / 8) ** 0.5), 1, most))
        k = min(k, len(sample))
        self.books = [kmeans(half, k) for half in (sample[:, : self.cut], sample[:, self.cut :])]
        rng = np.random.default_rng(11)
        x = sample[rng.choice(len(sample), min(probes, len(sample)), replace=False)]
        u = rng.normal(size=x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
        near = threshold * x + (1 - threshold**2) ** 0.5 * u
        cells = self.cells(near)
        ranks = []
        for d1, d2, (i, j) in zip(*self.distances(x), cells):
            ranks.append(int((d1[:, None] + d2[None, :] < d1[i] + d2[j]).sum()) + 1)
        self.visits = int(min(k * k, np.quantile(ranks, target_recall, method="higher")))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.cut], self.books[0]), distances(x[:, self.cut :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([d.argmin(1) for d in self.distances(x)], 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """A root for each of n vertices, equal exactly for those that the links connect."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(classes: DataFrame, width: int, threshold: float, target_recall: float, sample_rows: int, block: int) -> DataFrame:
    """Rows (id, n) with vectors linked to a class besides its own, and (a, b) with links that connect what is linked."""
    spark = classes.sparkSession
    vectors = classes.count()
    rows = classes.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("embedding").toArrow()
    sample = _matrix(rows.column("embedding"), width)
    index = MultiIndex(sample, vectors, threshold, target_recall)
    k = len(index.books[0])
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        ix = shared.value
        for batch in batches:
            x = _matrix(batch.column(2), width)
            cells = ix.cells(x)
            visited = [[i * k + j for i, j in multi_sequence(d1, d2, ix.visits)] for d1, d2 in zip(*ix.distances(x))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells[:, 0] * k + cells[:, 1], pa.int32()), pa.array(visited, pa.list_(pa.int32()))], ["id", "m", "embedding", "cell", "visited"])

    kind = classes.schema["embedding"].dataType.simpleString()
    placed = materialise(classes.select("id", "m", "embedding").mapInArrow(assign, f"id long, m long, embedding {kind}, cell int, visited array<int>"))
    code = F.floor(F.col("cell") / k).cast("int").alias("code")
    visits = placed.withColumn("code", F.explode(F.array_distinct(F.transform("visited", lambda c: F.floor(c / k).cast("int")))))
    visits = visits.withColumn("visited", F.filter("visited", lambda c: F.floor(c / k) == F.col("code")))
    # numbers of residents and of queries for each first-half code: at most as many rows as the codebook has
    sizes = placed.groupBy(code).agg(F.ceil(F.count("*") / block).cast("int").alias("rb")).join(visits.groupBy("code").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("qb")), "code")
    sizes = F.broadcast(materialise(sizes))
    fields = ["code", "r", "q", "side", "id", "m", "embedding", "cell", "visited"]
    residents = placed.withColumn("code", code).join(sizes, "code").withColumn("r", F.pmod(F.xxhash64("id"), "rb")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).withColumn("side", F.lit(0))
    queries = visits.join(sizes, "code").withColumn("q", F.pmod(F.xxhash64("id"), "qb")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rb") - 1))).withColumn("side", F.lit(1))
    both = residents.select(*fields).unionByName(queries.select(*fields)).withColumn("r", F.col("r").cast("int")).withColumn("q", F.col("q").cast("int"))
    both = both.repartition("code", "r", "q").sortWithinPartitions("code", "r", "q", "side")
    names = ["id", "n", "a", "b"]

    def compare(residents: list[pa.RecordBatch], queries: pa.RecordBatch) -> pa.RecordBatch:
        """Links between a block's residents and the queries that visit their cells; only those are multiplied."""
        r = pa.Table.from_batches(residents).combine_chunks()
        x, y = _matrix(r.column("embedding"), width), _matrix(queries.column(6), width)
        rid, rm, rcell = (r.column(c).to_numpy() for c in ("id", "m", "cell"))
        qid, qm, qcell = (queries.column(i).to_numpy() for i in (4, 5, 7))
        rvis = np.array(r.column("visited").to_pylist(), np.int32).reshape(len(rid), -1)
        cells = queries.column(8)  # of each query, those of this code
        visitor = np.repeat(np.arange(len(qid)), np.diff(cells.offsets.to_numpy()))
        visit = cells.flatten().to_numpy()
        order = np.argsort(visit, kind="stable")
        visitor, visit = visitor[order], visit[order]
        home = np.argsort(rcell, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(rcell[home]) != 0]))
        lows, highs = (np.searchsorted(visit, rcell[home[cuts]], side) for side in ("left", "right"))
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, stop, lo, hi in zip(cuts, [*cuts[1:], len(home)], lows, highs):
            mine = home[start:stop]
            for at in range(lo, hi, 512):
                some = visitor[at : min(at + 512, hi)]
                i, j = np.nonzero(y[some] @ x[mine].T >= threshold)
                found_i.append(some[i])
                found_j.append(mine[j])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        other = qid[i] != rid[j]
        i, j = i[other], j[other]
        # a query counts what it finds; a resident that would not find the query by itself counts it here
        back = np.concatenate([(rvis[j[s : s + 65536]] == qcell[i[s : s + 65536], None]).any(1) for s in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        ids, n = [], []
        for who, counts in ((qid, np.bincount(i, rm[j], len(qid))), (rid, np.bincount(j[~back], qm[i[~back]], len(rid)))):
            some = np.flatnonzero(counts)
            ids.append(who[some])
            n.append(counts[some].astype(np.int64))
        every = np.concatenate([qid, rid])
        root = _forest(i, j + len(qid), len(every))
        child = np.flatnonzero(root != np.arange(len(root)))
        ids, n, a, b = np.concatenate(ids), np.concatenate(n), every[child], every[root[child]]
        nothing = lambda m: pa.nulls(m, pa.int64())
        columns = ((pa.array(ids), nothing(len(a))), (pa.array(n), nothing(len(a))), (nothing(len(ids)), pa.array(a)), (nothing(len(ids)), pa.array(b)))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names)

    def search(batches):
        key, held = None, []
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in range(4)], 1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), len(group)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part, (*now, side) = batch.slice(lo, hi - lo), group[lo].tolist()
                if now != key:
                    key, held = now, []
                if side == 0:
                    held.append(part)
                elif held:
                    yield compare(held, part)

    return materialise(both.mapInArrow(search, "id long, n long, a long, b long"))


def near_dedup(vectors: DataFrame, threshold: float = 0.95, target_recall: float = 0.99, sample_rows: int = 20_000, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("ok", F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("embedding"))
    classes = materialise(rows.filter("ok").groupBy("h", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")))
    found = None
    for (width,) in classes.select(F.size("embedding")).distinct().collect():  # the dimensions in the table
        links = _links(classes.filter(F.size("embedding") == width).select("id", "m", "embedding"), width, threshold, target_recall, sample_rows, block)
        found = links if found is None else found.unionAll(links)
    if found is None:
        found = spark.createDataFrame([], "id long, n long, a long, b long")
    counts = found.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    component = connected_components(found.filter("a is not null").select("a", "b"))
    # written first: a join of two finished tables, which adaptive execution splits where one component is large
    least = broadcast_if_small(materialise(component.groupBy("component").agg(F.min("node").alias("least"))))
    lowest = component.join(least, "component").select(F.col("node").alias("id"), "least")
    table = materialise(classes.join(counts, "id", "left").join(lowest, "id", "left").select(F.col("h").alias("_h"), F.col("embedding").alias("_e"), "id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("least", "id").alias("least")))
    joined = rows.join(table, F.col("ok") & (F.col("h") == F.col("_h")) & (F.col("embedding") == F.col("_e")), "left")
    component_id = F.coalesce("least", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))
