"""Best-fit packing: few-document length patterns fitted to the length histogram by non-negative least squares.

1. Every whole text is tokenized once in its own task (no shuffle of texts or ids) and cut into pieces of at most `size`.
2. Pieces are counted by length: a histogram of at most `size` numbers, whatever the corpus.
3. On that histogram alone the driver enumerates patterns of up to four lengths that fill a sequence, fits their repeat
   counts by non-negative least squares (projected accelerated gradients over sparse patterns), rounds them down, and packs
   the residual counts by best fit decreasing, a whole run of equal sequences at a time.
4. Each piece gets its rank among the pieces of its length. Ranks are counted in hash buckets of bounded size, so that a
   length that a third of all pieces share is ranked in many tasks. Rank and length give sequence and offset from the plan.

Defined cases: null text is empty and still has its end token; a text longer than `size` is cut, only its last piece may be
shorter; rows that repeat a doc_id are packed each; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship, text_chunks
from .tokens import word_encoder

SIZE = 2048


def pieces(docs: DataFrame, size: int = SIZE, end: int = 0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids with the end token, cut every `size`."""
    ship(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        encoder = word_encoder(tokenizer)
        for batch in text_chunks(batches, max_bytes=4 << 20):
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(encoder.encode_batch([t or "" for t in batch.column(1).to_pylist()])):
                raw += tail
                for j, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    owner.append(i)
                    piece.append(j)
                    start.append(j * size)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# ---------------------------------------------------------------- planning on the histogram


def patterns(size: int, counts: np.ndarray) -> np.ndarray:
    """Rows of up to four lengths (0: none) that add up to `size`: each length alone or paired, with its complement shared
    between two or three lengths on a grid of 1/16 of the size."""
    have = counts > 0
    step = max(1, size // 16)
    rows = {(size, 0, 0, 0)}
    for a in np.flatnonzero(have).tolist():
        rest = size - a
        for parts in ([rest], *([b, rest - b] for b in range(step, rest // 2 + 1, step)), *([b, b, rest - 2 * b] for b in range(step, rest // 3 + 1, step))):
            row = tuple(sorted([a, *[p for p in parts if p > 0]], reverse=True))
            if all(have[p] for p in row):
                rows.add(row + (0,) * (4 - len(row)))
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def fit(pats: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts| weighted by length; A is never built, each row has four entries."""
    weight = np.arange(len(counts)) / (len(counts) - 1)
    weight[0] = 0
    used = weight[pats] ** 2
    degree = np.bincount(pats.ravel(), minlength=len(counts))
    bound = 4 * max(1.0, float((degree * weight**2).max()))
    x = np.zeros(len(pats))
    y, t = x, 1.0
    for _ in range(rounds):
        over = np.bincount(pats.ravel(), np.repeat(y, 4), len(counts)) - counts
        new = np.maximum(0, y - (used * over[pats]).sum(1) / bound)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan(counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Runs (length, first rank, repeats, first sequence, offset): the piece of that length and rank lies in sequence
    first sequence + (rank - first rank), at that offset."""
    left = counts.astype(np.int64).copy()
    runs: list[tuple[int, int, int, int, int]] = []
    taken = np.zeros(size + 1, np.int64)
    sequence = 0

    def emit(row: list[int], repeats: int) -> None:
        nonlocal sequence
        offset = 0
        for length in row:
            runs.append((length, int(taken[length]), repeats, sequence, offset))
            taken[length] += repeats
            left[length] -= repeats
            offset += length
        sequence += repeats

    if left.sum():
        pats = patterns(size, left)
        x = fit(pats, left)
        for i in np.argsort(-x, kind="stable").tolist():
            row = [v for v in pats[i].tolist() if v]
            repeats = min(int(x[i] + 1e-6), *(int(left[v]) // row.count(v) for v in row))
            if repeats:
                emit(row, repeats)
    live = [v for v in range(size, 0, -1) if left[v]]
    while live:  # best fit decreasing: each round uses up at least one length
        row, room, used = [live[0]], size - live[0], {live[0]: 1}
        while room:
            fits = _at_most(live, room, left, used)
            if not fits:
                break
            row.append(fits)
            used[fits] = used.get(fits, 0) + 1
            room -= fits
        emit(row, min(int(left[v]) // n for v, n in used.items()))
        live = [v for v in live if left[v]]
    return np.array(runs, np.int64).reshape(-1, 5)


def _at_most(live: list[int], room: int, left: np.ndarray, used: dict[int, int]) -> int:
    """Largest length with pieces left that fits; lengths stand in descending order."""
    lo, hi = 0, len(live)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if live[mid] > room else (lo, mid)
    for v in live[lo:]:
        if left[v] > used.get(v, 0):
            return v
    return 0


# ---------------------------------------------------------------- placing the pieces


def pack(cut: DataFrame, size: int = SIZE, bucket_rows: int = 50_000) -> DataFrame:
    """cut (doc_id, piece, start, length, ids_crc32, ...) plus sequence_id and offset."""
    spark = cut.sparkSession
    ship(spark)
    cut = materialise(cut)
    histogram = np.zeros(size + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `size` rows
        histogram[length] = n
    runs = plan(histogram, size)
    buckets = max(1, -(-int(histogram.sum()) // bucket_rows))
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    per = keyed.groupBy("length", "_bucket").count()
    before = per.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_own", F.row_number().over(own) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]  # by length and first rank; its size follows `size`, not the corpus
    shared = spark.sparkContext.broadcast(runs)
    wide = int(histogram.max(initial=0)) + 1
    out = ranked.select(*cut.columns, "_rank")
    schema = out.schema

    def run(batches):
        table = shared.value
        key = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            at = {f: i for i, f in enumerate(batch.schema.names)}
            length, rank = batch.column(at["length"]).to_numpy(), batch.column(at["_rank"]).to_numpy()
            r = table[np.searchsorted(key, length * wide + rank, "right") - 1]
            cols = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(r[:, 3] + rank - r[:, 1]), pa.array(r[:, 4])], [n for n in batch.schema.names if n != "_rank"] + ["sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != "_rank")
    return out.mapInArrow(run, fields + ", sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, size: int = SIZE, end: int = 0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, size, end, tokenizer, with_ids), size)
