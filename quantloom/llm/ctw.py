"""LM scoring by context-tree weighting over binary-decomposed bytes.

A text is its words (A-Z lowered), each followed by a space, and an end byte. Each byte is eight binary decisions; for each
decision and each context of the last 0 to `depth` bytes a Krichevsky-Trofimov estimate is kept, and the estimates of all
depths are mixed by the weights of the context tree: half for a node's own estimate, half for the product of its children.

Training gathers every (context, byte) of every training text:

1. Each task cuts its rows into buckets of about bucket_bytes. A bucket writes its texts once, packed, and its distinct words
   and byte grams (context and byte) with their training counts, also those that it needs only for scoring (count 0), packed
   by shard. This table is written; nothing else reads the documents again.
2. All nodes below a context depend on grams with that context only. Shards are dealt by the last two bytes; a context with
   more than its part of all grams (found on a sample, which moves work and no result) is dealt by its last three bytes, and
   so on, so that no pair of bytes is one task's work. Shards sum the counts and compute their nodes on their own, one shard
   in memory at a time; the nodes above them (depths 0 and 1 and those split contexts, at most 4,096 a depth) are sums of
   theirs. A summed shard is written as one row, with the places of each bucket's keys in it.
3. Each shard answers each bucket with the log probabilities of its grams and the counts of its words, in the order in which
   the bucket will find them again in its texts, and each bucket scores its texts.

So what is gathered grows with the corpus; no table of the model is held whole anywhere, and no sample is taken of what is
learned. A child that training never reached predicts as its parent.

Defined cases: null and empty text is the end byte alone; with nothing to learn from, every decision is one half and the
base score is that of count 0; rows that repeat a doc_id are scored each; a null doc_id is trained on (fold 0); columns other
than doc_id and text are not used, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, materialise_parts, ship, text_chunks, word_list
from .ngram_join import mix, word_hashes

END_WORD = np.uint64(0x5EED_0E4D)
LOG_HALF = np.log(0.5)
WORDS, TEXTS = 0, -1  # kinds of rows; grams have the depth of their shard's root (2 and more)
SMALL = 1 << 14


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument by eight."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_HALVES, _WHOLES = _log_gamma(np.arange(SMALL) + 0.5), _log_gamma(np.arange(SMALL) + 1.0)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the estimator's probability of n0 zeros and n1 ones; small counts are looked up."""
    total = n0 + n1
    low = np.minimum(total, SMALL - 1)
    out = _HALVES[np.minimum(n0, low)] + _HALVES[np.minimum(n1, low)] - _WHOLES[low] - np.log(np.pi)
    big = np.flatnonzero(total >= SMALL)
    if len(big):
        a, b = n0[big].astype(float), n1[big].astype(float)
        out[big] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)
    return out


def weigh(n0: np.ndarray, n1: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes, and the weight of their own estimate; children: sums of the children's logs."""
    own = log_kt(n0, n1)
    if children is None:
        return own, np.ones_like(own)
    both = LOG_HALF + np.maximum(own, children) + np.log1p(np.exp(-np.abs(own - children)))
    return both, np.exp(LOG_HALF + own - both)


def _low(depth: int) -> np.uint64:
    """Mask of a gram's byte and the last `depth` bytes before it."""
    return np.uint64((1 << 8 * (depth + 1)) - 1)


def _steps(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


class Subtrees:
    """All nodes of depth `least` and more below the contexts of some grams (ascending, distinct) with their counts. A gram's
    lowest byte is the byte to predict, the next one the byte before it, and so on."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, least: int = 2):
        self.depth, self.least = depth, least
        self.levels, self.up = {depth: (grams, counts)}, {}
        for d in range(depth - 1, least - 1, -1):  # each level's grams are those below it, cut by a byte
            below, n = self.levels[d + 1]
            ids, self.up[d + 1] = np.unique(below & _low(d), return_inverse=True)
            self.levels[d] = ids, np.bincount(self.up[d + 1], n, len(ids)).astype(np.int64)

    def decision(self, k: int):
        """Per depth, deepest first: (depth, first gram of each node, node of each gram, n0, n1, log weighted, weight) of the
        nodes that take the k-th decision of a byte. Grams of one node stand together."""
        below = None
        for d in range(self.depth, self.least - 1, -1):
            ids, n = self.levels[d]
            start = _steps(ids >> np.uint64(8 - k))
            node = np.repeat(np.arange(len(start)), np.diff(start, append=len(ids)))
            total, ones = np.add.reduceat(n, start), np.add.reduceat(n * (ids >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64), start)
            children = None
            if below is not None:
                first, logs = below
                children = np.bincount(node[self.up[d + 1][first]], logs, len(start))
            logs, weight = weigh(total - ones, ones, children)
            below = start, logs
            yield d, start, node, total - ones, ones, logs, weight

    def roots(self) -> tuple[np.ndarray, ...]:
        """(depth, context << 8 | decision, sum of logs, n0, n1) of the nodes above: sums over the nodes of depth `least`."""
        out = []
        for k in range(8):
            *_, (d, start, _, n0, n1, logs, _) = self.decision(k)
            ids = self.levels[d][0][start]
            out.append(((ids & _low(d - 1)) >> np.uint64(8) << np.uint64(8) | _decided(ids, k), logs, n0, n1))
        key, *values = (np.concatenate(c) for c in zip(*out))
        key, at = np.unique(key, return_inverse=True)
        return np.full(len(key), self.least - 1), key, *(np.bincount(at, v, len(key)) for v in values)

    def log10(self, top: "Top") -> np.ndarray:
        """log10 probability of each gram's byte after its context, mixed over all depths."""
        grams = self.levels[self.depth][0]
        at = {self.depth: np.arange(len(grams))}
        for d in range(self.depth - 1, self.least - 1, -1):
            at[d] = self.up[d + 1][at[d + 1]]
        whole = np.ones(len(grams))
        for k in range(8):
            one, p, below = (grams >> np.uint64(7 - k) & np.uint64(1)).astype(bool), None, None

            def step(p1, n, w, p, below):
                own = np.where(one, p1, 1 - p1)
                return own if p is None else np.where(below, w * own + (1 - w) * p, own), n > 0

            for d, _, node, n0, n1, _, w in self.decision(k):
                mine, n = node[at[d]], n0 + n1
                p, below = step(((n1 + 0.5) / (n + 1))[mine], n[mine], w[mine], p, below)
            for d in range(self.least - 1, -1, -1):
                ids = self.levels[self.least][0]
                n0, n1, w = (v[at[self.least]] for v in top.at(d, (ids & _low(d)) >> np.uint64(8) << np.uint64(8) | _decided(ids, k)))
                p, below = step((n1 + 0.5) / (n0 + n1 + 1), n0 + n1, w, p, below)
            whole *= p
        return np.log10(whole)


def _decided(ids: np.ndarray, k: int) -> np.ndarray:
    """The k bits of the byte that are known, after a leading one."""
    return np.uint64(1 << k) | (ids & np.uint64(255)) >> np.uint64(8 - k)


class Top:
    """The nodes above the shards' roots: sums from below, depth by depth."""

    def __init__(self, depth: np.ndarray, key: np.ndarray, logs: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        self.tables = {}
        above = (np.zeros(0, np.uint64), *[np.zeros(0)] * 3)
        for d in range(int(depth.max(initial=1)), -1, -1):
            mine = depth == d
            keys = np.concatenate([key[mine], above[0]])
            ids, at = np.unique(keys, return_inverse=True)
            below, a, b = (np.bincount(at, np.concatenate([v[mine], u]), len(ids)) for v, u in zip((logs, n0, n1), above[1:]))
            weighted, w = weigh(a.astype(np.int64), b.astype(np.int64), below)
            self.tables[d] = ids, a, b, w
            above = ((ids & _low(d - 1)) >> np.uint64(8) << np.uint64(8) | ids & np.uint64(255), weighted, a, b) if d else above

    def at(self, depth: int, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, *values = self.tables[depth]
        at = np.searchsorted(ids, keys)
        return tuple(v[at] for v in values)


# ---------------------------------------------------------------- texts as words and grams


def read(texts: list[str | None], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and their number per text (the end included, last), grams and their number per text."""
    split = [word_list(t) for t in texts]
    plain = [b" ".join(w) for w in split]
    hashes, n = word_hashes(plain)
    words = np.insert(hashes, np.cumsum(n), END_WORD)
    body = [p + b" \n" if p else b"\n" for p in plain]
    pad = b"\0" * depth
    buf = np.frombuffer(pad + pad.join(body), np.uint8).astype(np.uint64)
    size = np.array([len(b) for b in body])
    at = np.arange(size.sum()) + np.repeat((np.arange(len(body)) + 1) * depth, size)
    grams = np.zeros(len(buf), np.uint64)
    for j in range(depth + 1):
        grams[j:] |= buf[: len(buf) - j] << np.uint64(8 * j)
    return words, n + 1, grams[at], size


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and their summed counts."""
    keys, counts = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(keys)
    keys = keys[order]
    start = _steps(keys)
    return keys[start], np.add.reduceat(counts[order], start)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[_steps(keys)] if len(keys) else keys


def _indexed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the place of each key among them, in half the memory of np.unique's."""
    ids, at = np.unique(keys, return_inverse=True)
    return ids, at.astype(np.int32)


def _counted(keys: np.ndarray, trained: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of trained texts with their counts, and those of the others with 0."""
    other = _distinct(keys[~trained])
    return [np.unique(keys[trained], return_counts=True), (other, np.zeros(len(other), np.int64))]


# ---------------------------------------------------------------- Spark


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed, after their number: small in the JVM as well as on disk."""
    flat = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return flat.nbytes.to_bytes(8, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def _whole(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_whole(data, np.uint64), dtype=np.uint64)


def _dealt(words: np.ndarray, grams: np.ndarray, shards: int, split: dict[int, np.ndarray]):
    """(kind, shard, places) of the distinct words (kind 0, places in words) and grams (by the depth of their root, places in
    grams), places ascending. split: the contexts of each depth whose grams are dealt by one byte more."""
    def parts(kind, keys, places):
        shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, _steps(shard[order])[1:]) if len(order) else ():
            yield kind, int(shard[part[0]]), places[part]

    yield from parts(WORDS, words, np.arange(len(words)))
    left, d = np.arange(len(grams)), 2
    while len(left):
        context = (grams[left] & _low(d)) >> np.uint64(8)
        more = np.isin(context, split[d]) if d in split else np.zeros(len(left), bool)
        yield from parts(d, context[~more] << np.uint64(3) | np.uint64(d), left[~more])
        left, d = left[more], d + 1


def _crowded(rows: DataFrame, total: int, depth: int, most_bytes: int, sample_bytes: int) -> dict[int, np.ndarray]:
    """Contexts by depth (2 to depth - 1) that hold more than about most_bytes of the text, by a sample of about sample_bytes;
    those with less than 1 in 4,096 are never split, so there are at most 4,096 of each depth."""
    share = max(most_bytes / max(total, 1), 1 / 4096)
    if share >= 1:
        return {}
    bound = int((1 << 64) * min(1.0, sample_bytes / total)) - (1 << 63)
    sample = rows.filter(F.xxhash64("doc_id", "text") < F.lit(min(bound, (1 << 63) - 1)))

    def count(batches):
        for batch in text_chunks(batches):
            grams = read(batch.column(batch.schema.get_field_index("text")).to_pylist(), depth)[2]
            out = [(1, 0, len(grams))]
            for d in range(2, depth):
                ids, n = np.unique((grams & _low(d)) >> np.uint64(8), return_counts=True)
                some = n > share / 4 * len(grams)
                out += [(d, i, m) for i, m in zip(ids[some].astype(np.int64).tolist(), n[some].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["d", "context", "n"])

    sums = sample.mapInArrow(count, "d long, context long, n long").groupBy("d", "context").agg(F.sum("n").alias("n"))
    grams = sums.filter("d = 1").select(F.col("n").alias("all"))  # one row
    found = sums.join(F.broadcast(grams)).filter(F.col("n") > F.lit(share) * F.col("all")).filter("d > 1").select("d", "context").toArrow()
    d, context = found.column("d").to_numpy(), found.column("context").to_numpy().astype(np.uint64)
    return {int(x): np.sort(context[d == x]) for x in np.unique(d)}


def score(docs: DataFrame, held_out: Column, depth: int = 6, bucket_bytes: int = 8 << 20, shard_bytes: int = 4 << 20, sample_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), n_bytes and bits_per_byte of each row.

    Texts with held_out true are scored by a model that never saw them. depth: 3 to 7 bytes."""
    if not 3 <= depth <= 7:
        raise ValueError("depth must be 3 to 7: a gram is its context and one byte in 64 bits")
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    shards = max(4, -(-total // shard_bytes))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), shards)
    bucket_bytes = min(bucket_bytes, max(1 << 20, total // (2 * spark.sparkContext.defaultParallelism)))  # work for all cores
    split = spark.sparkContext.broadcast(_crowded(rows, total, depth, shard_bytes, sample_bytes))  # at most 4,096 a depth

    def buckets(batches):
        held, size = [], 0
        for batch in text_chunks(batches, max_bytes=1 << 20):
            held.append(batch)
            size += batch.nbytes
            if size >= bucket_bytes:
                yield held
                held, size = [], 0
        if held:
            yield held

    def gather(batches):
        task = TaskContext.get().partitionId()
        for number, part in enumerate(buckets(batches)):
            words, grams = [], []
            for batch in part:
                w, nw, g, ng = read(batch.column(1).to_pylist(), depth)
                trained = ~np.array(batch.column(2).to_pylist(), bool)
                words += _counted(w, np.repeat(trained, nw))
                grams += _counted(g, np.repeat(trained, ng))
                if len(grams) > 8:  # fold in what has been read, so that memory follows the distinct keys
                    words, grams = [_sums(words)], [_sums(grams)]
            (wk, wn), (gk, gn) = _sums(words), _sums(grams)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for batch in part:
                    writer.write_batch(batch)
            out = [(TEXTS, 0, sink.getvalue().to_pybytes(), b"")]
            for kind, shard, at in _dealt(wk, gk, shards, split.value):
                keys, n = (gk[at], gn[at]) if kind else (wk[at], wn[at])
                out.append((kind, shard, _pack_keys(keys), _planes(n.astype(np.uint32))))  # a bucket's counts are small
            bucket = [task << 32 | number] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((bucket, *zip(*out)), [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])], ["bucket", "kind", "shard", "data", "counts"])

    seen = rows.mapInArrow(gather, "bucket long, kind int, shard int, data binary, counts binary").withColumn("is_text", F.col("kind") == TEXTS)
    parts = materialise_parts(seen, "is_text")
    (texts, _), (gathered, folder) = parts[True], parts[False]

    def shards_of(batches):
        """Per shard: kind, shard, its buckets with their keys, all keys and their total counts."""
        now, parts = None, []
        for batch in batches:
            for b, kind, shard, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (kind, shard) != now:
                    if parts:
                        yield *now, [(b, k) for b, k, _ in parts], *_sums([(k, c) for _, k, c in parts])
                    now, parts = (kind, shard), []
                parts.append((b, _unpack_keys(keys), _whole(counts, np.uint32).astype(np.int64)))
        if parts:
            yield *now, [(b, k) for b, k, _ in parts], *_sums([(k, c) for _, k, c in parts])

    above = pa.schema([("d", pa.int64()), ("key", pa.int64()), ("logs", pa.float64()), ("n0", pa.float64()), ("n1", pa.float64())])
    merged = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("buckets", pa.list_(pa.int64())), ("places", pa.list_(pa.binary()))])

    def roots(batches):
        """Each shard as one row, and rows of what it adds to the nodes above it."""
        for kind, shard, parts, keys, counts in shards_of(batches):
            if kind:
                d, key, *values = Subtrees(keys, counts, depth, kind).roots()
            else:  # training tokens and distinct ones, in a row of their own
                d, key, *values = (np.array([v]) for v in (-1, 0, float(counts.sum()), float((counts > 0).sum()), 0.0))
            sums = [d.astype(np.int64), key.astype(np.int64), *(v.astype(float) for v in values)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, sums), *(pa.nulls(len(d), f.type) for f in merged)], schema=pa.schema([*above, *merged]))
            places = [_planes(np.diff(np.searchsorted(keys, k), prepend=0).astype(np.uint32)) for _, k in parts]
            row = [kind, shard, _pack_keys(keys), _planes(counts), [b for b, _ in parts], places]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in above), *(pa.array([v], f.type) for v, f in zip(row, merged))], schema=pa.schema([*above, *merged]))

    def values(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                kind, shard, keys, counts, owners, places = (c[row].as_py() for c in batch.columns)
                keys, counts = _unpack_keys(keys), _whole(counts, np.int64)
                v = Subtrees(keys, counts, depth, kind).log10(shared.value).astype(np.float32) if kind else counts
                n, data = len(owners), [_planes(v[np.cumsum(_whole(p, np.uint32))]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "shard", "data"])

    by_shard = gathered.repartition(tasks, "kind", "shard").sortWithinPartitions("kind", "shard", "bucket")
    whole = materialise(by_shard.mapInArrow(roots, "d long, key long, logs double, n0 double, n1 double, kind int, shard int, keys binary, counts binary, buckets array<long>, places array<binary>"))
    del by_shard
    discard(spark, folder)  # the shards hold it all now
    # nodes above the shards: 256 x 255, and 255 for each context that is split
    top = whole.filter("d is not null").groupBy("d", "key").agg(*[F.sum(c).alias(c) for c in ("logs", "n0", "n1")]).toArrow()
    d, key, logs, n0, n1 = (top.column(c).to_numpy() for c in ("d", "key", "logs", "n0", "n1"))
    node = d >= 0
    train_tokens, distinct = int(logs[~node].sum()), int(n0[~node].sum())
    shared = spark.sparkContext.broadcast(Top(d[node], key[node].astype(np.uint64), logs[node], n0[node], n1[node]))
    answers = whole.filter("kind is not null").select(*merged.names).mapInArrow(values, "bucket long, kind int, shard int, data binary")
    dealt = texts.select("bucket", "kind", "shard", "data").unionAll(answers).repartition(max(tasks, 2 * -(-total // bucket_bytes)), "bucket").sortWithinPartitions("bucket", "kind", "shard")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]

    def scored(packed: bytes, found: dict):
        """Rows of a bucket from its texts and the answers by (kind, shard)."""
        chunks = []
        for batch in pa.ipc.open_stream(packed):
            w, nw, g, ng = read(batch.column(1).to_pylist(), depth)
            chunks.append((batch, *_indexed(w), nw, *_indexed(g), ng))
        wk, gk = (_distinct(np.concatenate([c[i] for c in chunks])) for i in (1, 4))
        count, log10 = np.zeros(len(wk), np.int64), np.zeros(len(gk))
        for kind, shard, at in _dealt(wk, gk, shards, split.value):
            data = found.pop((kind, shard))
            if kind:
                log10[at] = _whole(data, np.float32)
            else:
                count[at] = _whole(data, np.int64)
        base = np.log10((count + 0.5) / (train_tokens + 0.5 * (distinct + 1)))
        for batch, w, wi, nw, g, gi, ng in chunks:
            mine, at_w, at_g = np.searchsorted(wk, w), np.cumsum(nw) - nw, np.cumsum(ng) - ng
            known = np.add.reduceat((count[mine] > 0).astype(np.int64)[wi], at_w)
            s = np.add.reduceat(log10[np.searchsorted(gk, g)][gi], at_g)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nw, pa.int64()), pa.array(known), pa.array(np.full(len(nw), train_tokens)), pa.array(np.add.reduceat(base[mine][wi], at_w)), pa.array(s), pa.array(ng, pa.int64()), pa.array(-s / np.log10(2) / ng)], names=names)

    def rate(batches):
        now, packed, found = None, b"", {}
        for batch in batches:
            for b, kind, shard, data in zip(*(c.to_pylist() for c in batch.columns)):
                if b != now:
                    if now is not None:
                        yield from scored(packed, found)
                    now, found = b, {}
                if kind == TEXTS:
                    packed = data
                else:
                    found[kind, shard] = data
        if now is not None:
            yield from scored(packed, found)

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return dealt.mapInArrow(rate, schema)
