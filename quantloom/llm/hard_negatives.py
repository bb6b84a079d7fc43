"""Hard-negative mining by coordinate pruning over length buckets, exact.

Components become integers (floor of 256 x), a score is an integer inner product. Rows are dealt into buckets by length, longest
first; a bucket holds its rows' unit vectors as one sorted list for each coordinate. A query with a score to reach knows, for a
bucket, the cosine that its rows must reach (a bucket too short to reach it is never visited) and with it, for each coordinate, the
range in which the unit vectors must lie. The ranges of the query's largest coordinates (the focus) are looked up in the
sorted lists and their candidate sets intersected; what is left is scored exactly.

There are two searches, each of all anchors against all rows: for an anchor's nearest rows of its own label (the positives), and for
the best rows of other labels below each positive. The score to reach comes from a bounded sample (`seed_rows`) that every query
meets first: the k-th best score among it is one that the k-th best of all rows reaches, so the sample only prunes. Buckets
stay where they are and anchors travel to the buckets that they may need, as a stream: a task holds one bucket. Each bucket
returns at most k rows a question. Their number grows as the square root of the table up to 16,384 rows a bucket.

Defined cases: rows with a null vec_id, label or vector, with null or non-finite components or with components beyond 2^19 (whose
scores would leave 64 bits) take no part; rows meet only rows of their own dimension; a row is no partner of rows with its own
vec_id; repeated rows are rows of their own as partners, repeated anchors are asked once; ties go by vec_id; an anchor
without positives, or whose positives have negative scores, gives no rows; extra columns are not used; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship

#: Of the scaled components: 2^27 squared, times 64 or 256 components, fits a long.
LARGEST = 1 << 27
_SLACK = 1e-9


def _matrix(column, width: int) -> np.ndarray:
    """Integer vectors as doubles where every inner product of such numbers is exact in them, else as longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy().astype(np.int64).reshape(len(column), width)
    return x.astype(np.float64) if np.abs(x).max(initial=0) < 1 << 20 else x


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if x.dtype != q.dtype or x.shape[1] > 4096:
        x, q = x.astype(np.int64), q.astype(np.int64)
    return (x @ q).astype(np.int64)


class Bucket:
    """Rows of about one length with a sorted list of each coordinate of their unit vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        length = np.linalg.norm(x.astype(np.float64), axis=1)
        self.longest = length.max(initial=0.0)
        self.unit = x / np.where(length > 0, length, 1.0)[:, None]
        self.order = np.argsort(self.unit, axis=0)
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.unit, self.order, 0).T)

    def candidates(self, q: np.ndarray, reach: float, focus: int) -> np.ndarray | None:
        """Places of rows whose score may reach `reach`: a superset; None for all."""
        if reach <= 0:
            return None
        length = np.linalg.norm(q.astype(np.float64))
        if length * self.longest * (1 + _SLACK) < reach:
            return np.zeros(0, np.int64)
        angle = np.arccos(min(1.0, reach / (length * self.longest)))
        unit = q / length
        axes = np.argsort(-np.abs(unit), kind="stable")[:focus]
        own = np.arccos(np.clip(unit[axes], -1, 1))
        low = np.cos(np.minimum(np.pi, own + angle)) - _SLACK
        high = np.cos(np.maximum(0.0, own - angle)) + _SLACK
        spans = [(self.sorted[c].searchsorted(a), self.sorted[c].searchsorted(b, "right")) for c, a, b in zip(axes, low, high)]
        k = int(np.argmin([b - a for a, b in spans]))
        found = self.order[spans[k][0] : spans[k][1], axes[k]]
        for other, c in enumerate(axes):
            if other != k and len(found):
                value = self.unit[found, c]
                found = found[(value >= low[other]) & (value <= high[other])]
        return found

    def scored(self, q: np.ndarray, reach: float, focus: int, label: int, same: bool, own_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of rows of the same label, or of others, whose score is `reach` at least."""
        found = self.candidates(q, reach, focus)
        ids, labels, x = (self.ids, self.labels, self.x) if found is None else (self.ids[found], self.labels[found], None)
        mine = ((labels == label) == same) & (ids != own_id)
        x = self.x[mine] if found is None else self.x[found[mine]]
        score = _scores(x, q)
        good = score >= reach
        return ids[mine][good], score[good]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by id."""
    if len(ids) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def feasible(positive: int) -> tuple[int, int]:
    """Least and greatest score of a negative: half of the positive's to 95 hundredths of it."""
    return -(-positive // 2), 95 * positive // 100


_ANCHOR = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int32())), ("reach", pa.float64()), ("positives", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("last", pa.int32())])
_ANCHORS = "key long, id long, label long, v array<int>, reach double, positives array<long>, scores array<long>, least array<long>, last int"


def _asked(anchors: DataFrame, seeds, levels, width: int, positives: int, negatives: int, focus: int) -> DataFrame:
    """anchors (key, id, label, v, positives, scores) with the score to reach, the least score for each positive, and the last
    bucket that is long enough. Without positives the question is for them."""

    def ask(batches):
        (ids, labels, x), longest = seeds.value, levels.value
        sample = Bucket(ids, labels, x)
        for batch in batches:
            rows = []
            vectors = _matrix(batch.column(3), width)
            lists = [c.to_pylist() for c in batch.columns[4:6]]
            for q, key, id_, label, v, at, scores in zip(vectors, *(c.to_pylist() for c in batch.columns[:4]), *lists):
                least = None
                if at is None:
                    i, s = sample.scored(q, -np.inf, focus, label, True, id_)
                    reach = float(np.sort(s)[-positives]) if len(s) >= positives else -np.inf
                else:
                    i, s = sample.scored(q, -np.inf, focus, label, False, id_)
                    least = []
                    for p in scores:
                        low, high = feasible(p)
                        inside = np.sort(s[(s >= low) & (s <= high)])
                        least.append(int(inside[-negatives]) if len(inside) >= negatives else low)
                    open_ = [low for low, p in zip(least, scores) if p >= 0 and low <= feasible(p)[1]]
                    if not open_:
                        continue
                    reach = float(min(open_))
                length = np.linalg.norm(q.astype(np.float64))
                # lengths fall from bucket to bucket
                last = len(longest) if reach <= 0 else int(np.searchsorted(-longest, -reach / (length * (1 + _SLACK)), "right")) if length else 0
                if last:
                    rows.append((key, id_, label, v, reach, at, scores, least, last - 1))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ANCHOR)], schema=_ANCHOR)

    return anchors.select("key", "id", "label", "v", "positives", "scores").mapInArrow(ask, _ANCHORS)


def _visited(buckets: DataFrame, anchors: DataFrame, parts: int, width: int, answer, schema: str) -> DataFrame:
    """answer(bucket, anchor batch) for every bucket and the anchors that may need it; a task holds one bucket at a time."""
    names = ["key", "reach", "positives", "scores", "least"]
    kinds = {"key": "long", "reach": "double", "positives": "array<long>", "scores": "array<long>", "least": "array<long>"}
    fields = ["bucket", "side", "id", "label", "v", *names]
    residents = buckets.select("bucket", F.lit(0).alias("side"), "id", "label", "v", *[F.lit(None).cast(kinds[n]).alias(n) for n in names])
    queries = anchors.withColumn("bucket", F.explode(F.sequence(F.lit(0), "last"))).withColumn("side", F.lit(1)).select(*fields)
    both = residents.unionByName(queries).repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "side")

    def search(batches):
        now, held, bucket = None, [], None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in range(2)], 1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part, (number, side) = batch.slice(lo, hi - lo), at[lo].tolist()
                if number != now:
                    now, held, bucket = number, [], None
                if side == 0:
                    held.append(part)
                elif held:
                    if bucket is None:
                        rows = pa.Table.from_batches(held)
                        bucket = Bucket(rows.column("id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v"), width))
                    yield answer(bucket, part)

    return both.mapInArrow(search, schema)


def _mined(rows: DataFrame, every: int, positives: int, negatives: int, seed_rows: int, focus: int, width: int) -> DataFrame:
    spark = rows.sparkSession
    n = rows.count()
    size = int(np.clip(4 * n**0.5, 512, 16_384))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    count = max(1, -(-n // size))
    dealt = rows.withColumn("length", F.sqrt(length)).repartitionByRange(count, F.col("length").desc(), "id")
    buckets = materialise(dealt.withColumn("bucket", F.spark_partition_id()))
    top = {r[0]: r[1] for r in buckets.groupBy("bucket").agg(F.max("length")).collect()}  # one number a bucket
    longest = np.maximum.accumulate(np.array([top.get(i, 0.0) for i in range(max(top) + 1)])[::-1])[::-1]
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(seed_rows).toArrow()
    seeds = spark.sparkContext.broadcast((sample.column("id").to_numpy(), sample.column("label").to_numpy(), _matrix(sample.column("v"), width)))
    levels = spark.sparkContext.broadcast(longest)
    parts = min(len(longest), 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    nothing = F.lit(None).cast("array<long>")
    anchors = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "label", "v"]).withColumn("key", F.xxhash64("label", "v"))
    asked = _asked(anchors.withColumns({"positives": nothing, "scores": nothing}), seeds, levels, width, positives, negatives, focus)

    def nearest(bucket: Bucket, part: pa.RecordBatch) -> pa.RecordBatch:
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        for q, id_, label, key, reach in zip(_matrix(part.column(4), width), *(part.column(c).to_pylist() for c in (2, 3, 5, 6))):
            ids, scores = bucket.scored(q, reach, focus, label, True, id_)
            best = _best(ids, scores, positives)
            for column, of in zip(out, (np.full(len(best), key), np.full(len(best), id_), ids[best], scores[best])):
                column.append(of)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["key", "anchor", "id", "score"])

    near = _visited(buckets, asked, parts, width, nearest, "key long, anchor long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("key", "anchor").orderBy(F.col("score").desc(), "id"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= positives).filter("score >= 0")
    listed = near.groupBy("key", "anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    listed = listed.select("key", F.col("anchor").alias("id"), F.col("p.id").alias("positives"), F.col("p.score").alias("scores"))
    asked = _asked(anchors.join(materialise(listed), ["key", "id"]), seeds, levels, width, positives, negatives, focus)

    def below(bucket: Bucket, part: pa.RecordBatch) -> pa.RecordBatch:
        out = [[np.zeros(0, np.int64)] for _ in range(7)]
        for q, id_, label, key, reach, at, of, least in zip(_matrix(part.column(4), width), *(part.column(c).to_pylist() for c in (2, 3, 5, 6, 7, 8, 9))):
            ids, scores = bucket.scored(q, reach, focus, label, False, id_)
            for k, (positive, p, low) in enumerate(zip(at, of, least)):
                inside = np.flatnonzero((scores >= low) & (scores <= feasible(p)[1]))
                best = inside[_best(ids[inside], scores[inside], negatives)]
                fixed = (np.full(len(best), x, np.int64) for x in (key, id_, k, positive, p))
                for column, values in zip(out, (*fixed, ids[best], scores[best])):
                    column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["key", "anchor_id", "k", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = _visited(buckets, asked, parts, width, below, "key long, anchor_id long, k long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("key", "anchor_id", "k").orderBy(F.col("negative_score").desc(), "negative_id"))
    found = found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def integer_rows(vectors: DataFrame) -> DataFrame:
    """id, label, v (integer components) of the rows that take part."""
    scaled = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    sound = ~F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(256 * x.cast("double")) > LARGEST), F.lit(True)))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    v = F.when(whole & sound, scaled.cast("array<int>"))
    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v")).filter("v is not null")


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, seed_rows: int = 2048, focus: int = 4) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (id, label, v): anchors are the rows
    whose id is divisible by `every`, their positives the nearest rows of their label, and for each positive the nearest rows of
    other labels whose score is feasible() below it."""
    spark = rows.sparkSession
    ship(spark)
    rows = materialise(rows)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for (width,) in rows.select(F.size("v")).distinct().collect():  # the dimensions in the table
        out = out.unionByName(_mined(rows.filter(F.size("v") == width), every, positives, negatives, seed_rows, focus, width))
    return out
