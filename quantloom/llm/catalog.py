"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .common import crc_mod, materialise, scratch
from .ctw import score
from .decontaminate import audit
from .divergence import divergences
from .embed_dedup import near_dedup
from .flac import text_media
from .hard_negatives import integer_rows, mine
from .langid import predict, train
from .line_dedup import line_dedup
from .mixing import mix_plan
from .ngram_join import ngram_join
from .packing import best_fit_pack
from .token_counts import RollupStore, count_tokens, count_words, deletes, entries, revisions


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizer versions. They are loaded with estimates from their sizes, taken out again where they
    have no words, and counted: the last batch takes back every estimate, counts all rows and is committed twice, which changes
    nothing. The totals are those of all rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    store = RollupStore(spark, f"{scratch(spark)}/rollups-{uuid.uuid4().hex}")
    for version, count in (("byte_bpe_50k", count_tokens), ("words_1", count_words)):
        counted = materialise(count(docs))
        guess = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.lit(version).alias("tokenizer_version"), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).alias("n_tokens"))
        store.commit(f"{version}-load", entries(guess, docs))
        store.commit(f"{version}-empty", deletes(counted.filter("n_tokens = 0")))
        store.compact()
        for _ in range(2):
            store.commit(f"{version}-count", revisions(counted, docs))
    return store.totals()


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, held_out=crc_mod(F.col("doc_id"), 5) == 1)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = crc_mod(F.col("doc_id"), 4)
    model = train(docs.filter(fold != 2).select("text", "lang"))
    read = predict(docs.select("doc_id", "text"), model)
    return read.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(_table(spark, sf_dir, "documents"))


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_rows(_table(spark, sf_dir, "embeddings"))
    return mine(rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(_table(spark, sf_dir, "documents").select("lang", "source", "text"), min_docs=10, top=10)


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), n=10)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_ngram_jaccard_join, op3_token_counts, op4_best_fit_packing, op5_lm_scoring, op6_language_id, op7_line_dedup, op8_source_mixing, op9_embedding_near_dedup, op10_media_columns, op11_hard_negative_mining, op12_source_divergence_audit, op13_benchmark_decontamination)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, s.y FROM reach r JOIN steps s ON r.y = s.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id""",
    "op7_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
flagged AS (
  SELECT doc_id, pos, line, coalesce(f.keeper <> doc_id, false) AS lost FROM keyed LEFT JOIN frequent f USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM flagged GROUP BY doc_id""",
    "op8_source_mixing": """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sized GROUP BY source),
caps AS (SELECT *, source_size * 2.0::DOUBLE / w AS cap_per_weight FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY cap_per_weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
       / sum(w) OVER (ORDER BY cap_per_weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
targets AS (
  SELECT source, source_size, CASE WHEN cap_per_weight > level
         THEN max(CASE WHEN cap_per_weight > level THEN level END) OVER () * w ELSE source_size * 2.0::DOUBLE END AS target FROM levels),
rates AS (SELECT *, coalesce(target / nullif(source_size, 0), 0) AS rate FROM targets)
SELECT doc_id, size, source_size, target,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source""",
    "op11_hard_negative_mining": """
WITH rows_ AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.id AS a, a.label = r.label AS same, r.id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS s
  FROM rows_ a JOIN rows_ r ON a.id <> r.id WHERE a.id % 50 = 0),
positives AS (SELECT a, id AS p, s AS ps FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, id) <= 5),
ranked AS (
  SELECT p.a, p.p, p.ps, n.id, n.s, CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.s DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same WHERE 50 * p.ps <= 100 * n.s AND 100 * n.s <= 95 * p.ps)
SELECT a AS anchor_id, p AS positive_id, rank, id AS negative_id, ps AS positive_score, s AS negative_score FROM ranked WHERE rank <= 3""",
    "op12_source_divergence_audit": f"""
WITH rows_ AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
groups_ AS (SELECT DISTINCT lang, source FROM rows_),
terms AS (SELECT r, lang, source, unnest(w) AS term FROM rows_),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
found AS (SELECT lang, source, term, count(*) AS c FROM terms GROUP BY ALL),
counts AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(f.c, 0) AS HUGEINT) AS c
  FROM groups_ g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
p AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)) // (CAST(sum(c) OVER g AS HUGEINT) + 2 * count(*) OVER g) AS p FROM counts WINDOW g AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, CAST(sum(c) AS HUGEINT) AS c FROM counts GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (c + 2)) // (CAST(sum(c) OVER g AS HUGEINT) + 2 * count(*) OVER g) AS q FROM whole WINDOW g AS (PARTITION BY lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op13_benchmark_decontamination": f"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc_words, lengths WHERE len(w) >= n)),
found AS (SELECT p.doc_id, p.n, p.i, w.item_id FROM places p JOIN windows w USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS word FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)""",
}
