"""Language identification by nearest centroid.

Documents become hashed TF-IDF vectors of letter 1- to 3-grams with unit length. Each language has
several centroids, found by spherical k-means over its labelled documents; a document takes the
language of the centroid with the largest cosine, and is rejected where even that cosine is below
the language's limit. The limit is half of the ``LIMIT_QUANTILE`` of the cosines that labelled documents
of the language reach: each half of the fitting sample is scored by centroids of the other half, so the
documents to be filtered have no say in it. ``reject_below`` is the least limit; it alone counts for texts under
``LEAST_SIGNS`` signs, whose cosines are low in any language, and for languages with too small a sample.

The classifier is fitted on a bounded sample: about ``sample_per_language`` labelled documents of
each language, chosen by a hash of the id. Prediction reads every whole text.

Edge cases: a null text, or one without letters, is ``und`` with score 0 and rejected; with no
labelled document at all everything is ``und``. Rows are predicted one by one, so repeated rows
repeat their result. A null id counts as the empty text when held-out rows are chosen. Ties go to
the language first in alphabetical order. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import in_arrow, map_arrow
from gleanery.session import table

BUCKETS = 1 << 13
SAMPLE_PER_LANGUAGE = 500
CENTROIDS = 4
REJECT_BELOW = 0.1
LIMIT_QUANTILE, LIMIT_SHARE = 0.01, 0.5
LEAST_SIGNS, LEAST_SAMPLE = 40, 20
UNDETERMINED = "und"


class Grams:
    """Counts of hashed letter n-grams."""

    def __init__(self):
        self.lower = np.arange(0x10000, dtype=np.uint32)
        letter = np.zeros(0x10000, bool)
        for c in range(0x10000):
            s = chr(c)
            if s.isalpha():
                letter[c] = True
                self.lower[c] = ord(s.lower()[0])
        self.lower[~letter] = 32

    def counts(self, text: str | None) -> np.ndarray | None:
        """None where there is no letter."""
        if not text:
            return None
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.lower[np.minimum(cps, 0xFFFF)]
        high = cps > 0xFFFF
        if high.any():
            kinds, where = np.unique(cps[high], return_inverse=True)
            s[high] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in kinds], np.uint32)[where]
        gap = s == 32
        if gap.all():
            return None
        s = np.concatenate([[np.uint32(32)], s[~(gap & np.concatenate([[True], gap[:-1]]))], [np.uint32(32)]]).astype(np.uint32)
        h1 = s * np.uint32(0x9E3779B1)
        h2 = (h1[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + h1[1:]
        h3 = (h2[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + h1[2:]
        h = np.concatenate([h1, h2, h3])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        return np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)


def unit_rows(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def to_unit_rows(counts: np.ndarray, idf: np.ndarray, rows: int = 128) -> None:
    """:func:`unit_rows` in place, some rows at a time: the driver holds a sample once, and no copies of it."""
    for lo in range(0, len(counts), rows):
        counts[lo : lo + rows] = unit_rows(counts[lo : lo + rows], idf)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; starts from the mean's nearest row and goes on to the farthest ones."""
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        far = int(np.argmin(near))
        if near[far] > 0.999:
            break
        chosen.append(far)
        near = np.maximum(near, x @ x[far])
    c = x[chosen]
    for _ in range(rounds):
        owner = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[owner == j].sum(axis=0) if (owner == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class CentroidModel:
    """idf (BUCKETS), centroids (m x BUCKETS) and the language and least cosine of each."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], limits: list[float]):
        self.idf, self.centroids, self.langs, self.limits = idf, centroids, langs, limits


def least_cosine(x: np.ndarray, signs: np.ndarray, k: int) -> float:
    """The limit of a language, out of the unit rows of its sample; 0 if that is too small."""
    halves = [np.arange(len(x)) % 2 == i for i in (0, 1)]
    own = np.concatenate([(x[h & (signs >= LEAST_SIGNS)] @ spherical_kmeans(x[~h], k).T).max(axis=1) for h in halves]) if len(x) >= LEAST_SAMPLE else x[:0, 0]
    return LIMIT_SHARE * float(np.quantile(own, LIMIT_QUANTILE)) if len(own) >= LEAST_SAMPLE else 0.0


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> CentroidModel:
    """Fit on a hash sample of rows with a language; it and its size a language are bounded."""
    labelled = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    totals = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    share = F.lit(0.0)
    for lang, n in totals.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, sample_per_language / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(8)), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grams()
        for batch in batches:
            langs, at, n = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = g.counts(text)
                if counts is not None:
                    nz = np.flatnonzero(counts)
                    langs.append(lang)
                    at.append(nz.astype(np.int16).tobytes())
                    n.append(counts[nz].astype(np.int32).tobytes())
            if langs:
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "at", "n"])

    sample = map_arrow(labelled.where(draw < share), [lang_col, text_col], grams, "lang string, at binary, n binary").collect()
    sample.sort()
    counts = np.zeros((len(sample), BUCKETS), np.float32)
    for i, (_, at, n) in enumerate(sample):
        counts[i, np.frombuffer(at, np.int16)] = np.frombuffer(n, np.int32)
    idf = np.log((1 + len(sample)) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32) + 1
    signs = counts.sum(axis=1) / 3
    to_unit_rows(x := counts, idf)
    langs, limits, found = [], [], []
    for lang in sorted({r[0] for r in sample}):
        rows = np.array([r[0] == lang for r in sample])
        c = spherical_kmeans(x[rows], centroids)
        found.append(c)
        langs += [lang] * len(c)
        limits += [least_cosine(x[rows], signs[rows], centroids)] * len(c)
    return CentroidModel(idf, np.concatenate(found) if found else np.zeros((0, BUCKETS), np.float32), langs, limits)


def predict(docs: DataFrame, model: CentroidModel, columns: list[str], text_col: str = "text", reject_below: float = REJECT_BELOW, batch_rows: int = 128) -> DataFrame:
    """``columns`` of each row with lang_pred, score (cosine, 0 to 1) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.centroids.astype(np.float32), list(model.langs), np.array(model.limits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grams()
        idf, centroids, langs, limits = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo in range(0, batch.num_rows, batch_rows):
                part = [g.counts(t.as_py()) for t in texts[lo : lo + batch_rows]]
                best = np.full(len(part), -1)
                score = np.zeros(len(part))
                least = np.full(len(part), reject_below)
                some = [i for i, c in enumerate(part) if c is not None]
                if some and langs:
                    cosine = unit_rows(np.stack([part[i] for i in some]), idf) @ centroids.T
                    best[some] = np.argmax(cosine, axis=1)
                    score[some] = np.clip(cosine.max(axis=1), 0, 1)
                    long = [i for i in some if part[i].sum() >= 3 * LEAST_SIGNS]
                    least[long] = np.maximum(reject_below, limits[best[long]])
                out = [batch.column(i)[lo : lo + len(part)] for i in range(len(columns))]
                out.append(pa.array([langs[b] if b >= 0 else UNDETERMINED for b in best], pa.string()))
                out += [pa.array(score), pa.array((best < 0) | (score < least))]
                yield pa.RecordBatch.from_arrays(out, names=[*columns, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    source = docs.select(*columns, F.col(text_col).alias("_text_in"))
    return in_arrow(source, run, f"{kinds}, lang_pred string, score double, rejected boolean")


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    found = predict(docs, model, ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op8_language_id": op8_language_id}
