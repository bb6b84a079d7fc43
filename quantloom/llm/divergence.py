"""Source divergence audit: how far the term frequencies of the sources of one language lie apart.

Single-pass in-memory indexing. Each task counts terms of whole texts in an in-memory block (occurrences by language, source and
term, documents by language and term) until `block_bytes` of text are in it, then spills the block as term-sorted runs, cut into hash
shards of the terms and into chunks of bounded size. Spark moves the chunks to their shards, sorted by first term, and one
heap merges the runs of a shard: a chunk is opened when the merge reaches its first term, so what is held is one open chunk a
run. A frequent term arrives once a run, not once an occurrence. Merged frequencies of the kept terms are a written table.

All divergences are integers. For the pairs of sources, a term that neither source has adds the same number as any other
such term; so the sum over all kept terms is that number times the terms, plus what terms of one source add (from a histogram
of its counts), plus a correction for terms that both have. The corrections are streamed over the terms into sums of bounded
size. The result has a row for each ordered pair of a language's sources, which is what is asked for; nothing else grows with
the square of a group.

`shards` is the number of shuffle partitions of the session unless given: like any shuffle it should follow the input.

Defined cases: null text, language or source count as empty strings; empty texts and texts without terms still make their group
known; repeated rows and rows that share a doc_id count each; a very long text is counted in pieces cut between terms; ties
in a rank go by item; a language without kept terms gives pairs of value 0 and no terms; an empty table gives no rows; doc_id
and extra columns are not used, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, ship, text_chunks

#: A-Z lowered, a-z and bytes beyond ASCII kept, all else a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 20
_RUN = "shard int, lang string, first binary, sources array<string>, terms array<binary>, docs array<bigint>, n array<int>, src array<int>, tf array<bigint>"
_FREQUENCY = "lang string, term binary, sources array<string>, counts array<bigint>, total bigint"


def pieces(text: bytes):
    """Lists of terms of a text, from pieces of about a megabyte that end between terms."""
    clean, start = text.translate(_TERMS), 0
    while start < len(clean):
        end = clean.find(b" ", start + _PIECE) if start + _PIECE < len(clean) else -1
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


class Block:
    """Postings in memory: the terms of texts as arrays, and of each text its language, its source and what of it counts."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.groups: dict[tuple[int, str], int] = {}
        self.texts: list[tuple[int, int, bool, bool]] = []  # language, group, occurrences count, the text as a document counts
        self.sizes: list[int] = []
        self.arrays: list[pa.Array] = []
        self.tail: list[bytes] = []
        self.bytes = 0

    def add(self, lang: str, source: str, terms, occurrences: bool = True, document: bool = True) -> None:
        of = self.langs.setdefault(lang, len(self.langs))
        self.texts.append((of, self.groups.setdefault((of, source), len(self.groups)), occurrences, document))
        self.sizes.append(len(terms))
        self.tail.extend(terms)
        if len(self.tail) > 100_000:
            self.arrays.append(pa.array(self.tail, pa.binary()))
            self.tail = []

    def run(self, shards: int, most: int):
        """The block as a run: batches of chunks, ordered by language, shard and term, of about `most` postings each."""
        terms = pa.concat_arrays([*self.arrays, pa.array(self.tail, pa.binary())]).dictionary_encode()
        known, n = terms.dictionary, len(terms.dictionary)
        if not n:
            return
        lang, group, occurs, counts = (np.array(c) for c in zip(*self.texts))
        text = np.repeat(np.arange(len(lang)), self.sizes)
        pair, often = np.unique(text * n + terms.indices.to_numpy(), return_counts=True)
        text, code = pair // n, pair % n
        mine = occurs[text]
        posting, at = np.unique(group[text[mine]] * n + code[mine], return_inverse=True)
        tf = np.zeros(len(posting), np.int64)
        np.add.at(tf, at, often[mine])
        group_lang = np.array([of for of, _ in self.groups])
        group, code_of = posting // n, posting % n
        mine = counts[text]
        held, docs = np.unique(lang[text[mine]] * n + code[mine], return_counts=True)
        keys = np.unique(np.concatenate([group_lang[group] * n + code_of, held]))
        rank = np.empty(n, np.int64)
        rank[pc.sort_indices(known).to_numpy()] = np.arange(n)
        shard = np.array([zlib.crc32(t) % shards for t in known.to_pylist()], np.int64)
        order = np.lexsort((rank[keys % n], shard[keys % n], keys // n))
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        lang, code = keys[order] // n, keys[order] % n
        documents = np.zeros(len(keys), np.int64)
        documents[place[np.searchsorted(keys, held)]] = docs
        owner = place[np.searchsorted(keys, group_lang[group] * n + code_of)]
        by_term = np.lexsort((group, owner))
        group, tf = group[by_term], tf[by_term]
        each = np.bincount(owner, minlength=len(keys))
        cell = lang * shards + shard[code]
        weight = np.cumsum(each + 1)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        before = np.repeat(np.concatenate([[0], weight])[first], np.diff(np.append(first, len(cell))))
        part = (weight - before - 1) // most
        starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]))
        ends = np.append(starts[1:], len(cell))
        until = np.concatenate([[0], np.cumsum(each)])
        names, sources = [s for _, s in self.groups], []
        local = np.zeros(len(group), np.int32)
        for a, b in zip(until[starts], until[ends]):
            of, local[a:b] = np.unique(group[a:b], return_inverse=True)
            sources.append([names[g] for g in of])
        by_chunk, by_posting = (pa.array(x, pa.int32()) for x in (np.append(starts, len(cell)), until[np.append(starts, len(cell))]))
        spelled = known.take(pa.array(code))
        langs = list(self.langs)
        columns = [pa.array(shard[code[starts]], pa.int32()), pa.array([langs[x] for x in lang[starts]], pa.string()), spelled.take(pa.array(starts)), pa.array(sources, pa.list_(pa.string()))]
        columns += [pa.ListArray.from_arrays(by_chunk, x) for x in (spelled, pa.array(documents, pa.int64()), pa.array(each, pa.int32()))]
        columns += [pa.ListArray.from_arrays(by_posting, x) for x in (pa.array(local, pa.int32()), pa.array(tf, pa.int64()))]
        out = pa.RecordBatch.from_arrays(columns, ["shard", "lang", "first", "sources", "terms", "docs", "n", "src", "tf"])
        for at in range(0, len(starts), 64):
            yield out.slice(at, 64)


def _batches(rows, schema: pa.Schema, weight, most: int):
    """Arrow batches of rows whose weights add up to about `most`."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if total >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_FREQUENCY_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("total", pa.int64())])


def _indexer(shards: int, block_bytes: int, chunk_entries: int):
    def spilled(batches):
        block = Block()

        def full(more: int) -> bool:
            block.bytes += more
            return block.bytes >= block_bytes

        for batch in text_chunks(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if len(text) <= block_bytes:
                    block.add(lang, source, [t for p in pieces(text) for t in p])
                    if full(len(text) + 100):
                        yield from block.run(shards, chunk_entries)
                        block = Block()
                    continue
                seen: set[bytes] = set()  # a text of many blocks counts once as a document
                for terms in pieces(text):
                    block.add(lang, source, terms, document=False)
                    seen.update(terms)
                    if full(_PIECE):
                        yield from block.run(shards, chunk_entries)
                        block = Block()
                block.add(lang, source, seen, occurrences=False)
        yield from block.run(shards, chunk_entries)

    return spilled


def _opened(batches):
    """The chunks of sorted batches, each taken out of Arrow when its turn comes."""
    for batch in batches:
        for i in range(batch.num_rows):
            _, lang, first, sources, *lists = (c.slice(i, 1).to_pylist()[0] for c in batch.columns)
            yield lang, first, sources, lists


def _entries(number: int, sources, lists):
    at, (terms, docs, n, src, tf) = 0, lists
    for term, d, k in zip(terms, docs, n):
        yield term, number, d, [(sources[src[j]], tf[j]) for j in range(at, at + k)]
        at += k


def heap_merge(chunks):
    """(lang, term, documents, occurrences by source) in order, from chunks sorted by language and first term."""
    heap, number, lang = [], 0, None

    def merged(limit):
        """The terms that stand on the heap below the limit, each once."""
        while heap and (limit is None or heap[0][0] < limit):
            now, docs, by_source = heap[0][0], 0, {}
            while heap and heap[0][0] == now:
                _, which, d, of = heap[0]
                docs += d
                for source, count in of:
                    by_source[source] = by_source.get(source, 0) + count
                following = next(rest[which], None)
                if following is None:
                    heapq.heappop(heap)
                    del rest[which]
                else:
                    heapq.heapreplace(heap, following)
            yield lang, now, docs, by_source

    rest: dict[int, object] = {}
    for of, first, sources, lists in chunks:
        yield from merged(first if of == lang else None)
        lang = of
        rest[number] = _entries(number, sources, lists)
        heapq.heappush(heap, next(rest[number]))
        number += 1
    yield from merged(None)


def term_frequencies(docs: DataFrame, min_docs: int = 10, shards: int | None = None, block_bytes: int = 16 << 20, chunk_entries: int = 4_000) -> DataFrame:
    """lang, term, sources, counts (occurrences by source) and total of the terms in at least min_docs of a language's rows."""
    spark = docs.sparkSession
    ship(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    runs = texts.mapInArrow(_indexer(shards, block_bytes, chunk_entries), _RUN).repartitionById(shards, F.col("shard")).sortWithinPartitions("lang", "first")

    def merge(batches):
        kept = ((lang, term, list(of), list(of.values()), sum(of.values())) for lang, term, n, of in heap_merge(_opened(batches)) if n >= min_docs)
        return _batches(kept, _FREQUENCY_SCHEMA, lambda row: 1 + len(row[2]), 50_000)

    return runs.mapInArrow(merge, _FREQUENCY).withColumn("term", F.col("term").cast("string"))


def _share(count: str, n: str, v: str) -> Column:
    """p of a count among n occurrences of v terms, exact at any size; null where there are no terms."""
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + (CAST({count} + 2 AS DECIMAL(38, 0)) * 1000000000) DIV ({n} + 2 * {v}) END")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) DIV ({p} + {q})")


def group_shares(docs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """lang, source, i (number of the source in its language), n (occurrences of kept terms), v (kept terms of the language),
    n_lang and p0 (the share of a count of 0) for each (language, source) that occurs."""
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    each = frequencies.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.counts").alias("n"))
    langs = frequencies.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = groups.join(each, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("n_lang"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    return joined.select("lang", "source", number.alias("i"), "n", "v", "n_lang", _share("0", "n", "v").alias("p0"))


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _summed(codes: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, v = np.concatenate(codes), np.concatenate(values)
    order = np.argsort(c, kind="stable")
    c, v = c[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    return c[first], np.add.reduceat(v, first)


def _corrections(batches):
    """What each pair of a term's sources adds beyond the sum of what either adds alone, summed over the terms streamed."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])
    held: dict[str, tuple[list, list]] = {}
    waiting, most = 0, 1_000_000

    def emptied():
        for lang, (codes, values) in held.items():
            c, v = _summed(codes, values)
            for s in range(0, len(c), 65_536):
                a, b = (c[s : s + 65_536] >> 31).astype(np.int32), (c[s : s + 65_536] & (2**31 - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), pa.array(a), pa.array(b), pa.array(v[s : s + 65_536])], schema=schema)

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        i, p, p0 = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in range(3))
        row = np.repeat(np.arange(len(sizes)), sizes)
        for apart in range(1, int(sizes.max(initial=0))):
            x = np.flatnonzero(row[apart:] == row[:-apart])
            y = x + apart
            more = _gaps(p[x], p[y]) - _gaps(p[x], p0[y]) - _gaps(p0[x], p[y]) + _gaps(p0[x], p0[y])
            codes, of = (i[x] << 31) | i[y], langs[row[x]]
            for lang in set(of.tolist()):
                mine = of == lang
                c, v = _summed([codes[mine]], [more[mine]])
                kept = held.setdefault(lang, ([], []))
                kept[0].append(c)
                kept[1].append(v)
                waiting += len(c)
            if waiting > most:
                held = {lang: tuple([x] for x in _summed(*kept)) for lang, kept in held.items()}
                waiting = sum(len(kept[0][0]) for kept in held.values())
                if waiting > most // 2:
                    yield from emptied()
                    held, waiting = {}, 0
    yield from emptied()


def divergences(docs: DataFrame, min_docs: int = 10, top: int = 10, **index) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its divergence from each other one (part pair), and
    the `top` terms in which it lies furthest above the language (part term). `index` goes to term_frequencies()."""
    frequencies = materialise(term_frequencies(docs.select("lang", "source", "text"), min_docs, **index))
    shares = materialise(group_shares(docs, frequencies))
    groups = broadcast_if_small(shares, 200_000)
    each = frequencies.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("s")).select("lang", "term", "total", F.col("s.sources").alias("source"), F.col("s.counts").alias("count"))
    each = materialise(each.join(groups, ["lang", "source"]).select("lang", "source", "i", "term", _share("count", "n", "v").alias("p"), _share("total", "n_lang", "v").alias("q"), "p0"))

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = each.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    by_term = each.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("i", "p", "p0"))).alias("of")).select("lang", "of")
    both = by_term.mapInArrow(_corrections, "lang string, a int, b int, value bigint")
    other = groups.select("lang", F.col("i").alias("j"), F.col("p0").alias("q0"))
    alone = each.groupBy("lang", "i", "p", "p0").agg(F.count("*").alias("m")).join(other, "lang").filter("i <> j")
    alone = alone.select("lang", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("m") * (_gap("p", "q0") - _gap("p0", "q0"))).alias("value"))
    left = shares.select("lang", F.col("i").alias("a"), F.col("source").alias("x"), F.col("p0").alias("p"), "v")
    right = groups.select("lang", F.col("i").alias("b"), F.col("source").alias("y"), F.col("p0").alias("q"))
    base = left.join(right, "lang").filter("a < b")
    sums = both.unionByName(alone).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    value = F.coalesce(F.col("v") * _gap("p", "q"), F.lit(0)) + F.coalesce("value", F.lit(0))
    pairs = base.join(sums, ["lang", "a", "b"], "left").select("lang", "x", "y", value.alias("value"))
    pairs = pairs.unionAll(pairs.select("lang", "y", "x", "value")).select("lang", F.col("x").alias("source"), F.lit("pair").alias("part"), F.col("y").alias("item"), "value")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)
