"""Language ID by error-correcting output codes over byte n-grams.

Each language gets a codeword of bits. For each bit a binary n-gram classifier (log odds of hashed byte trigrams and bigrams
between the languages with a one and those with a zero) reads the whole text. Counts for the classifiers cover all labelled
rows given and are summed in Spark; the model has bins x languages numbers, whatever the corpus. A bounded sample of
labelled rows (at most calibration_rows, the rows of least hash) measures how often each bit is right for each language; decoding
sums those weights times the logistic loss of the bit and takes the codeword of least loss. A text is ambiguous if its two
best codewords lie closer than `margin`.

Defined cases: null text, or text without a letter, is `und` with score 0; rows without a language are not learned from; with
no labelled rows every text is `und`; one learned language is predicted for every text with letters, with score 1; empty and
very long texts are read whole; rows that repeat are predicted alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_chunks

BINS = 1 << 15


def has_letter(text: str) -> bool:
    """A character of Unicode category L*; digits, signs and numerals such as "½" or "Ⅷ" are none."""
    return any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """n rows of -1/+1. Up to five languages: the exhaustive code. More: the best of seeded random codes by least distance."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[(j >> (n - 1 - i)) & 1 for j in range(1 << (n - 1), (1 << n) - 1)] for i in range(n)]
        return np.array(bits) * 2.0 - 1
    width, rng, best, far = int(np.ceil(10 * np.log2(n))), np.random.default_rng(n), None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, width)) * 2 - 1
        mixed = np.abs(code.sum(0)) < n
        distance = ((width - code @ code.T) // 2 + np.eye(n, dtype=int) * width).min()
        if mixed.all() and distance > far:
            best, far = code, distance
    return (best if best is not None else code).astype(float)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the byte trigrams and bigrams at each place, texts parted by a zero byte, and where each text begins."""
    b = np.frombuffer(b"\0".join(texts) + b"\0\0\0", np.uint8).astype(np.uint32)
    two = b[:-2] << np.uint32(8) | b[1:-1]
    three = two << np.uint32(8) | b[2:]
    bins = np.empty((2, len(two)), np.int64)
    bins[0] = (two * np.uint32(2654435761)) >> np.uint32(17)
    bins[1] = (three * np.uint32(2246822519)) >> np.uint32(17)
    return bins, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])


def _lower(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]


class Model:
    """languages, code (languages x bits), odds (bins x bits), trust (languages x bits: how often a bit is right)."""

    def __init__(self, languages: list[str], counts: np.ndarray, alpha: float = 0.5):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + alpha) / (counts.sum(1, keepdims=True) + alpha * counts.shape[1]) if len(languages) else counts
        self.odds = np.zeros((BINS, self.code.shape[1]), np.float32)
        for j in range(self.code.shape[1] if len(languages) > 1 else 0):
            one = self.code[:, j] > 0
            self.odds[:, j] = np.log(share[one].mean(0)) - np.log(share[~one].mean(0))
        self.trust = np.ones_like(self.code)

    def margins(self, texts: list[bytes], evidence: float = 40.0) -> np.ndarray:
        """Per text and bit: mean log odds of its n-grams, scaled by the number of n-grams up to `evidence`."""
        bins, start = grams(texts)
        n = np.array([len(t) + 1 for t in texts])
        total = np.add.reduceat(self.odds[bins[0]] + self.odds[bins[1]], start, axis=0)[: len(texts)].astype(np.float64)
        return total / (2 * n[:, None]) * np.minimum(n, evidence)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score (softmax of the negative losses) and the lead over the second best loss."""
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust[None]).sum(2) / self.trust.sum(1)
        best = loss.argmin(1)
        least = loss[np.arange(len(loss)), best]
        share = np.exp(least[:, None] - loss)
        ranked = np.sort(loss, 1)
        lead = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, 1 / share.sum(1), lead


def train(labelled: DataFrame, calibration_rows: int = 2000) -> Model:
    """Fit on all rows (text, lang) with both present."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.filter("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in text_chunks(batches):
            by: dict[str, list[str]] = {}
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                sums[lang] = sums.get(lang, 0) + np.bincount(grams(_lower(texts))[0].ravel(), minlength=BINS + 1)
                sums[lang][BINS] += len(texts)  # the rows themselves
        for lang, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (BINS + 1)), pa.array(np.arange(BINS + 1), pa.int32()), pa.array(c, pa.int64())], ["lang", "bin", "n"])

    # languages x bins rows, whatever the corpus
    summed = rows.mapInArrow(count, "lang string, bin int, n long").filter("n > 0").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    names = summed.column("lang").to_pylist()
    languages = sorted(set(names))
    counts = np.zeros((len(languages), BINS + 1))
    at = {lang: i for i, lang in enumerate(languages)}
    counts[[at[x] for x in names], summed.column("bin").to_numpy()] = summed.column("n").to_numpy()
    labelled_rows, counts = counts[:, BINS].sum(), counts[:, :BINS]
    model = Model(languages, counts)
    if len(languages) > 1 and calibration_rows:
        # rows of a low hash, about four times as many as needed, so that tasks do not each send calibration_rows texts
        low = (1 << 64) * min(1.0, 4 * calibration_rows / max(labelled_rows, 1)) - (1 << 63)
        drawn = rows.withColumn("_h", F.xxhash64("text", "lang")).filter(F.col("_h") <= F.lit(low))
        sample = drawn.orderBy("_h", "text", "lang").limit(calibration_rows).drop("_h")
        shared = spark.sparkContext.broadcast(model)

        def judge(batches):
            m = shared.value
            for batch in text_chunks(batches):
                right = np.sign(m.margins(_lower(batch.column(0).to_pylist()))) == m.code[[at[x] for x in batch.column(1).to_pylist()]]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(right.astype(int).tolist(), pa.list_(pa.int64()))], ["lang", "ok"])

        seen = np.ones(len(languages)) * 2
        good = np.ones_like(model.code)
        for lang, ok in sample.mapInArrow(judge, "lang string, ok array<long>").collect():  # at most calibration_rows
            seen[at[lang]] += 1
            good[at[lang]] += np.array(ok)
        model.trust = good / seen[:, None]
    return model


def predict(docs: DataFrame, model: Model, margin: float = 0.02) -> DataFrame:
    """docs plus lang_pred, score (0 to 1) and ambiguous; like-named columns of docs are replaced. Only text is read."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    added = {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}
    rest = [c for c in docs.columns if c not in added]
    frame = docs.select(*rest)  # the text travels once, in its own column
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema.fields)

    def run(batches):
        m = shared.value
        for batch in text_chunks(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            read = np.array([bool(m.languages) and t is not None and has_letter(t) for t in texts])
            lang, score, unclear = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if read.any():
                best, s, lead = m.decode(m.margins(_lower([t for t, r in zip(texts, read) if r])))
                lang[read], score[read], unclear[read] = np.array(m.languages, object)[best], s, lead < margin
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(unclear)], [*rest, *added])

    return frame.mapInArrow(run, schema + "".join(f", {k} {v}" for k, v in added.items()))


def drop_unidentified(docs: DataFrame, model: Model) -> DataFrame:
    """docs without texts in no language (`und`) and without ambiguous ones; the columns of docs."""
    return predict(docs.select(*docs.columns), model).filter("lang_pred <> 'und' and not ambiguous").select(*docs.columns)
