"""N-gram Jaccard join by prefix trees: all links of at least the given similarity, and their components.

A document's set holds the hashes of its distinct k-word shingles. Equal sets form one class and are joined as one. Sets
are stored in one global order, rare shingles first, so that two similar sets share a shingle among their first few
(n - ceil(t n) + 1); the order needs document frequencies only roughly and takes them from a count-min sketch of fixed size
that counts every shingle of every document. Classes that share such a shingle meet by that shingle:

* the first shingle that two sets share is late in one of them only if little is left to share: a class leaves a shingle where
  no other class is near enough in size and place, so that a passage shared by many unlinked texts, whose places are all late,
  gives no candidates at all;
* shingles that hold exactly the same classes stand for one another: the first of them stays;
* first each class is compared with one partner, the class of least hash that it meets; this joins most groups of near copies
  as stars. Then some probes of each shingle (the classes of least hash) are joined with its other classes, not all pairs;
* the other sets of a probe form a prefix tree (sets sorted in the global order, each set beginning at the depth that it
  shares with the one before); the probe walks it once, shares the overlap counted on common paths and leaves a subtree as
  soon as the elements left on either side cannot reach the overlap that is needed;
* pairs whose sizes, places or signatures (parities of elements over 512 cells) already rule a link out never leave that join;
* links are contracted to components; a shingle whose classes then lie in one component is settled, any other gets sixteen times
  as many probes in the next round, until every pair in different components has been compared. No link is lost, no candidate
  is capped, and a large group of near copies costs a star instead of all its pairs.

Sets travel only for pairs that are left then. A probe with very many partners is dealt out in blocks. The classes of a
shingle that the sketch shows in far more than `hot` documents are dealt out in pieces as well, and meet by counts of their
sizes; the least hashes of a shingle are picked within each task before they are shuffled. Neither changes what meets.

Defined cases: a text without words has the empty set and is linked with nothing; fewer than k words are one shingle; null
text is no words; a null doc_id is linked with nothing; rows that repeat a doc_id are compared each by their own text; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, materialise, ship, text_chunks
from .components import connected_components

#: The sketch: two rows of counters, cut into parts that are summed each in its own task. Its size is fixed.
SKETCH_BITS, PART = 20, 1 << 16
#: Classes that one task takes of a shingle; more are dealt out in pieces.
HOT = 1000
#: Longs in a set's signature.
WORDS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64)
_PLACES = np.random.default_rng(8).integers(1, 1 << 63, 64).astype(np.uint64) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts (ASCII white space separates) and the number of words of each text."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[buf]
    edge = np.diff(space.view(np.int8), prepend=1)
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power = np.full(len(buf), _BASE)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * power)])
    back = np.full(len(buf), _INVERSE)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    hashes = mix((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(first, ends)
    return hashes, np.diff(upto, prepend=0)


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, one text after another, and their numbers."""
    words, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    n = len(words)
    whole = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    h = np.zeros(len(whole), np.uint64)
    for j in range(k):
        h += words[whole + j] * _PLACES[j]
    own = owner[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        start = np.cumsum(counts) - counts
        one = np.array([sum(int(words[start[d] + j]) * int(_PLACES[j]) for j in range(counts[d])) + int(counts[d]) * int(_PLACES[-1]) & (1 << 64) - 1 for d in short], np.uint64)
        own, h = np.concatenate([own, short]), np.concatenate([h, one])
        order = np.argsort(own, kind="stable")
        own, h = own[order], h[order]
    h = mix(h)
    ends = np.cumsum(np.bincount(own, minlength=len(texts)))
    for s, e in zip([0, *ends.tolist()], ends.tolist()):
        h[s:e].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[keep], np.bincount(own[keep], minlength=len(texts))


def _class_ids(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit id of each set; two different sets of one corpus share one with probability of about documents^2 / 2^65."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0xD6E8FEB86659FD93)))])
    ends = np.cumsum(counts)
    return mix(total[ends] - total[ends - counts] + counts.astype(np.uint64) * _PLACES[-2]).view(np.int64)


def _signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Parities of each set's elements over 64 * WORDS cells, as WORDS longs. Two sets that differ in d elements differ in
    at most d cells."""
    cells = 64 * WORDS
    own = np.repeat(np.arange(len(counts)), counts)
    odd = np.bincount(own * cells + ((h >> np.uint64(20)) % np.uint64(cells)).astype(np.int64), minlength=len(counts) * cells) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(counts), cells), axis=1).view(np.int64)


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64) + (1 << SKETCH_BITS)


def _estimate(sketch: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _slots(h)
    return np.minimum(sketch[a], sketch[b])


def _profile(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, cls, s0...) of each row, and the sketch of document frequencies."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    signature = [f"s{i}" for i in range(WORDS)]
    names = ["doc_id", "n_shingles", "cls", *signature, "part", "salt", "counts"]

    def run(batches):
        counts = np.zeros(2 << SKETCH_BITS, np.int64)
        salt = 0
        ids = None
        for batch in text_chunks(batches):
            h, n = shingle_sets(batch.column(1).to_pylist(), k)
            for s in _slots(h):
                counts += np.bincount(s, minlength=2 << SKETCH_BITS)
            cls = _class_ids(h, n)
            salt = int(cls[0]) & 7 if len(cls) else salt
            ids, rows = batch.column(0), len(n)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(cls, pa.int64()), *map(pa.array, np.ascontiguousarray(_signatures(h, n).T)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if ids is not None:
            small = np.minimum(counts, (1 << 32) - 1).astype("<u4")
            parts = [small[i : i + PART].tobytes() for i in range(0, len(small), PART)]
            m = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, ids.type), *[pa.nulls(m, pa.int64())] * (2 + WORDS), pa.array(range(m), pa.int32()), pa.array([salt] * m, pa.int32()), pa.array(parts)], names)

    both = materialise(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, cls long, {''.join(f'{c} long, ' for c in signature)}part int, salt int, counts binary"))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                sums[p] = sums.get(p, 0) + np.frombuffer(c, "<u4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([np.minimum(c, (1 << 32) - 1).astype("<u4").tobytes() for c in sums.values()])], ["part", "salt", "counts"])

    parts = (2 << SKETCH_BITS) // PART
    sketch = np.zeros(2 << SKETCH_BITS, np.uint32)
    rows = both.filter("part is not null").select("part", "salt", "counts")
    for wide in (("part", "salt"), ("part",)):  # first within eight groups of tasks, then all
        rows = rows.repartition(parts, *wide).mapInArrow(add, "part int, salt int, counts binary")
    for p, _, c in rows.collect():  # of fixed size, whatever the corpus
        sketch[p * PART : (p + 1) * PART] = np.frombuffer(c, "<u4")
    return both.filter("part is null").select("doc_id", "n_shingles", "cls", *signature), sketch


def _prefix_rows(docs: DataFrame, k: int, percent: int, shared, hot: int = HOT) -> DataFrame:
    """(token, cls, n, pos, pieces): the first elements of each set in the global order, their places from 0, and the number of
    pieces (of about `hot` classes) for an element that is frequent beyond what collisions in the sketch make of it, else 1."""

    def run(batches):
        sketch, sent = shared.value, set()
        noise = float(sketch.mean())
        for batch in text_chunks(batches):
            h, n = shingle_sets(batch.column(0).to_pylist(), k)
            cls, rank = _class_ids(h, n), _estimate(sketch, h)
            take = n - -(-percent * n // 100) + 1
            ends = np.cumsum(n)
            picked, own, places = [], [], []
            for d, c in enumerate(cls.tolist()):
                if n[d] and c not in sent:  # equal sets of one task go out once
                    sent.add(c)
                    picked.append(ends[d] - n[d] + np.argsort(rank[ends[d] - n[d] : ends[d]], kind="stable")[: take[d]])
                    own.append(d)
                    places.append(np.arange(take[d], dtype=np.int32))
            if picked:
                at, own = np.concatenate(picked), np.repeat(own, take[own])
                pieces = np.where(rank[at] > hot + 2 * noise, np.ceil((rank[at] - noise) / hot), 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(cls[own]), pa.array(n[own], pa.int64()), pa.array(np.concatenate(places)), pa.array(pieces)], ["token", "cls", "n", "pos", "pieces"])
            if len(sent) > 1_000_000:
                sent.clear()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, cls long, n long, pos int, pieces int")


def _fits(x, y, percent: int):
    """Sizes of sets that may be linked."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _met_by_size(rows: DataFrame, percent: int) -> DataFrame:
    """The same for shingles in pieces: classes of a shingle and size are counted first, and a class is held against the
    counts. That keeps a few more than a look at each class would, where a class alone has room for its own size."""
    sizes = rows.groupBy("token", "n").agg(F.count("*").alias("_c"), F.max("room").alias("_best"))
    by_size = Window.partitionBy("token").orderBy("n")  # as many rows as the shingle's sets have sizes
    n, before = F.col("n"), F.lag("n").over(by_size)
    room = F.max("_best").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    below = before.isNotNull() & _fits(n, before, percent) & (room >= n)
    after = F.lead("n").over(by_size)
    sizes = sizes.select(F.col("token").alias("_token"), F.col("n").alias("_n"), "_c", (below | ((F.col("_c") > 1) & (F.col("_best") >= n))).alias("_below"), F.when(_fits(n, after, percent), after).alias("_after"))
    joined = rows.join(broadcast_if_small(materialise(sizes), 100_000), (F.col("token") == F.col("_token")) & (F.col("n") == F.col("_n")))
    larger = F.coalesce(F.col("_after") <= F.col("room"), F.lit(False)) | ((F.col("_c") > 1) & (F.col("n") <= F.col("room")))
    return joined.filter(F.col("_below") | larger).select("token", "cls", "n", "pos")


def _meeting(rows: DataFrame, percent: int) -> DataFrame:
    """(token, cls, n, pos) of the classes that meet another one at a shingle which may be the first that they share and leave
    room for a link. Of two linked classes both stay at the first shingle they share: the smaller one comes before the larger
    one by size, and each place leaves room for the size of the other."""
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("cls"), "pieces")).repartition("token", "piece").dropDuplicates(["token", "piece", "cls"])
    by_size = Window.partitionBy("token", "piece").orderBy("n", "cls")
    n, least = F.col("n"), F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n")  # largest partner
    before, after = F.lag("n").over(by_size), F.lead("n").over(by_size)
    room = F.max("room").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    smaller = before.isNotNull() & _fits(n, before, percent) & (room >= n)  # least() skips nulls
    larger = after.isNotNull() & _fits(n, after, percent) & (after <= F.col("room"))
    split = F.col("pieces") > 1
    kept = materialise(rows.withColumn("room", least).withColumn("_met", smaller | larger).filter(F.col("_met") | split).select("token", "cls", "n", "pos", "room", "pieces"))
    met = kept.filter(~split).select("token", "cls", "n", "pos")
    hot = kept.filter(split)
    if hot.take(1):
        met = materialise(met.unionByName(_met_by_size(hot, percent)))
    # shingles that hold the same classes lead to the same pairs; all sets have them in one order, so the first has the least sum
    lists = met.groupBy("token").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("cls")).alias("_x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("_y"), F.sum("pos").alias("_s"))
    first = lists.groupBy("_n", "_x", "_y").agg(F.min(F.struct("_s", "token"))["token"].alias("token"))
    # a table of its own: a frequent shingle's classes are read where they lie, or split by adaptive execution
    return met.join(broadcast_if_small(materialise(first.select("token"))), "token")


def _ordered_sets(docs: DataFrame, wanted: DataFrame, k: int, shared) -> DataFrame:
    """(cls, n, elements) for the wanted (doc_id, cls): big-endian hashes in the global order."""
    names = ["cls", "n", "elements"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(broadcast_if_small(wanted.withColumnRenamed("cls", "_cls")), "doc_id").select("text", "_cls")

    def run(batches):
        sketch = shared.value
        for batch in text_chunks(batches):
            h, n = shingle_sets(batch.column(0).to_pylist(), k)
            cls, rank = _class_ids(h, n), _estimate(sketch, h)
            own = np.flatnonzero(cls == batch.column(1).to_numpy())  # rows that repeat a doc_id may hold another text
            ends = np.cumsum(n)
            sets = [h[ends[i] - n[i] : ends[i]][np.argsort(rank[ends[i] - n[i] : ends[i]], kind="stable")].astype(">u8").tobytes() for i in own.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(cls[own]), pa.array(n[own], pa.int64()), pa.array(sets, pa.binary())], names)

    return materialise(rows.mapInArrow(run, "cls long, n long, elements binary"))


def walk(probe: bytes, members: list[tuple[int, bytes]], percent: int) -> list[int]:
    """Ids of the members whose set reaches the similarity with the probe: one walk over their prefix tree.

    Members are sorted, so those below a node of the tree stand together and a member starts at the depth it shares with
    the one before. counted[d] is the overlap of the current path's first d elements; at depth d at most
    min(member's rest, probe's elements not yet met) more can follow."""
    p = np.sort(np.frombuffer(probe, ">u8").astype(np.uint64))
    out, before, counted, stopped = [], np.zeros(0, np.uint64), np.zeros(1, np.int64), -1
    for ident, raw in sorted(members, key=lambda m: m[1]):
        m = np.frombuffer(raw, ">u8").astype(np.uint64)
        need = -(-percent * (len(p) + len(m)) // (100 + percent))
        short = min(len(before), len(m))
        unequal = np.flatnonzero(before[:short] != m[:short])
        shared = min(int(unequal[0]) if len(unequal) else short, len(counted) - 1)
        before = m
        if 0 <= stopped <= shared and counted[stopped] + min(len(m) - stopped, len(p) - counted[stopped]) < need:
            continue  # the whole subtree below the stop
        counted, depth, stopped = counted[: shared + 1], shared, -1
        while True:
            o = int(counted[depth])
            if o + min(len(m) - depth, len(p) - o) < need:
                stopped = depth
                break
            if depth == len(m):
                out.append(ident)
                break
            step = m[depth : depth + 128]
            hit = p[np.minimum(np.searchsorted(p, step), len(p) - 1)] == step
            counted = np.concatenate([counted, o + np.cumsum(hit)])
            depth += len(step)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, block: int = 256, max_elements: int = 400_000) -> DataFrame:
    """(a, b) of the pairs (probe, member) that are links."""
    sizes = pairs.groupBy("probe").count().select("probe", F.ceil(F.col("count") / block).alias("_blocks"))
    dealt = pairs.join(sizes, "probe").select("probe", "member", F.pmod(F.xxhash64("member"), F.col("_blocks")).alias("block"))
    dealt = materialise(dealt)
    members = dealt.join(sets.select(F.col("cls").alias("member"), "elements"), "member").select("probe", "block", "member", "elements")
    probes = dealt.select("probe", "block").distinct().join(sets.select(F.col("cls").alias("probe"), "elements"), "probe").select("probe", "block", F.lit(None).cast("long").alias("member"), "elements")
    rows = probes.unionByName(members).repartition("probe", "block").sortWithinPartitions("probe", "block", F.col("member").asc_nulls_first())

    def run(batches):
        key, probe, waiting, elements = None, None, [], 0

        def flush():
            hits = walk(probe, waiting, percent) if waiting else []
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(hits), pa.int64()), pa.array(hits, pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b, m, e in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != key:
                    if waiting:
                        yield flush()
                    key, probe, waiting, elements = (a, b), e, [], 0
                elif m is not None:
                    waiting.append((m, e))
                    elements += len(e) // 8
                    if elements > max_elements:  # a tree for each so many elements bounds the memory
                        yield flush()
                        waiting, elements = [], 0
        if waiting:
            yield flush()

    return rows.mapInArrow(run, "a long, b long")


def ngram_join(docs: DataFrame, k: int = 4, percent: int = 85, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), one row for each row of docs. `hot` changes which
    tasks do the work, not the result."""
    spark = docs.sparkSession
    ship(spark)

    profile, sketch = _profile(docs, k)
    shared = spark.sparkContext.broadcast(sketch)
    open_ = materialise(_meeting(_prefix_rows(docs, k, percent, shared, hot), percent))
    signature = [f"s{i}" for i in range(WORDS)]
    classes = materialise(profile.filter("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in signature]))
    near_by = classes.select("cls", *signature)
    open_ = materialise(open_.join(F.broadcast(near_by) if classes.count() <= 500_000 else near_by, "cls"))

    def could_link():
        """Sizes, places and signatures of a class and a probe (columns named p...) leave room for a link."""
        apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"p{c}"))) for c in signature), F.lit(0))
        sizes = F.col("n") + F.col("pn")
        rest = F.least(F.col("n") - F.col("pos"), F.col("pn") - F.col("ppos"))
        return _fits(F.col("n"), F.col("pn"), percent) & (rest * (100 + percent) >= sizes * percent) & (apart <= sizes - 2 * F.ceil(sizes * percent / (100 + percent)))

    def as_probe(df, *more):
        return df.select("token", *[F.col(c).alias(f"p{c}") for c in ("cls", "n", "pos", *signature, *more)])

    def verify(pairs: DataFrame) -> DataFrame:
        """The links among the pairs (probe, member)."""
        used = pairs.select(F.col("probe").alias("cls")).unionAll(pairs.select("member")).distinct()
        sets = _ordered_sets(docs, materialise(used.join(classes, "cls").select("doc_id", "cls")), k, shared)
        return materialise(_verified(pairs, sets, percent))

    by_hash = Window.partitionBy("token").orderBy(F.xxhash64("cls"), "cls")
    pair = (F.least("cls", "pcls").alias("probe"), F.greatest("cls", "pcls").alias("member"))
    # each class and one partner: the class of least hash that it meets and could be linked with
    first = as_probe(open_.withColumn("_turn", F.row_number().over(by_hash)).filter("_turn = 1"))
    partner = open_.join(first, (open_["token"] == first["token"]) & (F.col("cls") != F.col("pcls")) & could_link())
    partner = partner.groupBy("cls").agg(F.min(F.struct(F.xxhash64("pcls").alias("h"), "pcls"))["pcls"].alias("pcls"))
    done = materialise(partner.select(*pair).distinct())
    links = verify(done)
    component = connected_components(links)
    left, probes = open_, 2
    while True:
        placed = left.join(component, left["cls"] == component["node"], "left").select(*left.columns, F.coalesce("component", "cls").alias("c"))
        mixed = materialise(placed.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("token"))
        unsettled = materialise(placed.join(broadcast_if_small(mixed), "token"))
        if not unsettled.take(1):
            break
        turns = materialise(unsettled.withColumn("_turn", F.row_number().over(by_hash)).filter(F.col("_turn") <= probes).drop("_turn"))
        chosen = as_probe(turns, "c")
        more = unsettled.join(chosen, (unsettled["token"] == chosen["token"]) & (F.col("c") != F.col("pc")) & could_link()).select(*pair).distinct()
        pairs = materialise(more.join(done, ["probe", "member"], "left_anti"))
        if pairs.take(1):
            found = verify(pairs)
            done = done.unionAll(pairs)
            if found.take(1):
                links = links.unionAll(found)
                component = connected_components(links)
        left, probes = unsettled.select(*left.columns).join(turns.select("token", "cls"), ["token", "cls"], "left_anti").select(*left.columns), probes * 16
    placed = profile.join(component, profile["cls"] == component["node"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "cls")).alias("_c"))
    placed = materialise(placed)
    # a table of its own, so that adaptive execution may split the join where one component holds many rows
    least = broadcast_if_small(materialise(placed.filter("_c is not null").groupBy("_c").agg(F.min("doc_id").alias("_least")).withColumnRenamed("_c", "_k")), 200_000)
    return placed.join(least, placed["_c"] == least["_k"], "left").select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near copies: of each component one row of its smallest doc_id stays.

    Rows without words or without a doc_id are linked with nothing and all stay. Rows that share a doc_id are told apart by
    their text; of rows that repeat both, one stays. Extra columns pass through whatever their names; an empty table gives no
    rows."""
    text = F.col("text").cast("string")
    i, h, turn = fresh(docs, "_id", "_hash", "_turn")
    key = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias(i), F.xxhash64(text).alias(h)))
    placed = materialise(ngram_join(docs.select(key.alias("doc_id"), text.alias("text")), k, percent).filter("n_shingles > 0 and doc_id is not null"))
    dropped = materialise(placed.filter("doc_id <> component_id").select("doc_id.*").distinct())
    repeated = materialise(placed.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id.*"))
    same = (F.col("doc_id") == F.col(i)) & (F.xxhash64(text) == F.col(h))
    left = docs.join(broadcast_if_small(dropped), same, "left_anti")
    if not repeated.take(1):
        return left
    repeated = broadcast_if_small(repeated)
    one = Window.partitionBy("doc_id", F.xxhash64(text)).orderBy(F.xxhash64(*docs.columns))
    first = left.join(repeated, same, "left_semi").withColumn(turn, F.row_number().over(one)).filter(F.col(turn) == 1).select(*docs.columns)
    return left.join(repeated, same, "left_anti").unionByName(first)
