"""Bigram language model with interpolated modified Kneser-Ney smoothing.

Counts are made in Spark: tasks tally their words and then their bigrams as sorted arrays, which are
shuffled by ranges (words) and by context (bigrams) and summed. The tasks that sum write the model as
sorted arrays into the shared folder: shards of word hashes with counts, continuation counts and
context statistics, and shards of bigram keys with counts. Scoring tasks memory-map the shards, so a
model of any size costs them only the pages they touch; nothing but totals passes the driver.

p(v | u) = max(c(u,v) - D(c), 0) / c(u) + gamma(u) p(v), where p(v) is the discounted share of
distinct contexts of v, interpolated with the uniform distribution over the V known tokens and one
unknown. The three discounts of each order come from the counts of counts. An unseen context
leaves p(v). The pairs of a context that holds a large part of a shard's share of bigrams are spread over all shards,
and so are those of the start of text; which contexts these are is read off the stored counts.

Tokens: words (lower-cased A-Z, split at ASCII white space), then one end token. The order is two:
see the README for what a third would cost.

Edge cases: a null or empty text is its end token. Repeated rows are counted and scored as often as
they occur. A null id counts as the empty text when held-out rows are chosen. With no training rows
every probability is 1. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import in_arrow, map_arrow, open_mapped, put_file, shared_path
from gleanery.llm.lang_id import fold
from gleanery.llm.words import WordHashes, mix, words
from gleanery.session import table

CHARS_A_WORD_SHARD = 1 << 25
TOKENS_A_BIGRAM_SHARD = 1 << 21
HELD = 1 << 22
SCORED_AT_ONCE = 1 << 18
#: White space within keeps these apart from all words.
END, START = xxhash.xxh64_intdigest(b"\n end"), xxhash.xxh64_intdigest(b"\n start")


class Tally:
    """Keys with their summed counts, kept sorted and distinct."""

    def __init__(self):
        self.keys, self.counts, self.held, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.held.append((keys, np.ones(len(keys), np.int64) if counts is None else counts))
        self.size += len(keys)
        if self.size >= HELD // 2:
            self.settle()

    def settle(self) -> Tally:
        if self.held:
            keys = np.concatenate([self.keys, *(k for k, _ in self.held)])
            counts = np.concatenate([self.counts, *(n for _, n in self.held)])
            self.keys, where = np.unique(keys, return_inverse=True)
            self.counts = np.bincount(where, counts, len(self.keys)).astype(np.int64)
            self.held, self.size = [], 0
        return self

    def __len__(self) -> int:
        return len(self.keys)


def _blobs(part: np.ndarray, *columns: np.ndarray) -> list[list]:
    """Rows (part, bytes of each column) for ascending parts."""
    ids, at = np.unique(part, return_index=True)
    ends = np.append(at[1:], len(part))
    return [ids.tolist(), *([c[a:b].tobytes() for a, b in zip(at, ends, strict=True)] for c in columns)]


def _starts(shards: int) -> np.ndarray:
    """First hash of each word shard but the first."""
    return (np.arange(1, shards) / shards * 2.0**64).astype(np.uint64)


class Model:
    """Totals of a model and where its arrays lie; the arrays are mapped when first used."""

    def __init__(self, path: str, word_shards: int):
        self.path, self.word_shards = path, word_shards
        self.offsets = np.zeros(1, np.int64)
        self.bigram_shards = 1
        self.tokens = self.types = 0
        self.start, self.large = -1, 0.0
        self.low_d = self.high_d = (0.5, 1.0, 1.5)
        self.low_total, self.low_gamma = 0, 1.0
        self._open: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def array(self, name: str, dtype) -> np.ndarray:
        if name not in self._open:
            self._open[name] = np.frombuffer(open_mapped(f"{self.path}/{name}"), dtype)
        return self._open[name]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids of sorted hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.concatenate([[0], np.searchsorted(hashes, _starts(self.word_shards)), [len(hashes)]])
        for p in np.flatnonzero(np.diff(at)).tolist():
            part = hashes[at[p] : at[p + 1]]
            size = self.offsets[p + 1] - self.offsets[p]
            if size:
                shard = self.array(f"word-{p}.hash", np.uint64)
                i = np.minimum(np.searchsorted(shard, part), size - 1)
                out[at[p] : at[p + 1]] = np.where(shard[i] == part, i + self.offsets[p], -1)
        return out

    def of_words(self, ids: np.ndarray, name: str, dtype) -> np.ndarray:
        """A word column at ids; 0 for unknown words."""
        out = np.zeros(len(ids), dtype)
        known = np.flatnonzero(ids >= 0)
        by = known[np.argsort(ids[known], kind="stable")]
        shards, at = np.unique(np.searchsorted(self.offsets, ids[by], side="right") - 1, return_index=True)
        for p, mine in zip(shards.tolist(), np.split(by, at[1:]), strict=True) if len(by) else ():
            out[mine] = self.array(f"word-{p}.{name}", dtype)[ids[mine] - self.offsets[p]]
        return out

    def bigram_shard(self, keys: np.ndarray) -> np.ndarray:
        """The shard of each pair: by its context, or by the pair where the context is frequent."""
        u, where = np.unique((keys >> np.uint64(32)).astype(np.int64), return_inverse=True)
        spread = ((self.of_words(u, "count", np.int64) > self.large) | (u == self.start))[where]
        return (mix(np.where(spread, keys, keys >> np.uint64(32))) % np.uint64(self.bigram_shards)).astype(np.int64)

    def bigrams(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Counts of pairs of known ids."""
        if not len(u):
            return np.zeros(0, np.int64)
        keys, where = np.unique((u.astype(np.uint64) << np.uint64(32)) | v.astype(np.uint64), return_inverse=True)
        shard = self.bigram_shard(keys)
        out = np.zeros(len(keys), np.int64)
        by = np.argsort(shard, kind="stable")
        ids, at = np.unique(shard[by], return_index=True)
        for p, mine in zip(ids, np.split(by, at[1:]), strict=True):
            stored = self.array(f"pair-{p}.key", np.uint64)
            if not len(stored):
                continue
            i = np.minimum(np.searchsorted(stored, keys[mine]), len(stored) - 1)
            n = np.where(stored[i] == keys[mine], self.array(f"pair-{p}.count", np.uint8)[i], 0).astype(np.int64)
            if (many := n == 255).any():
                j = np.searchsorted(self.array(f"pair-{p}.many", np.uint64), keys[mine][many])
                n[many] = self.array(f"pair-{p}.manycount", np.int64)[j]
            out[mine] = n
        return out[where]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from the numbers of types with counts 1 to 4."""
    n1, n2 = n[0], n[1]
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else k / 2 for k in (1, 2, 3))


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return c - np.array([0.0, *d])[np.minimum(c, 3)]


def train(docs: DataFrame, text_col: str = "text") -> Model:
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    model = Model(shared_path(spark, "language-model"), int(chars // CHARS_A_WORD_SHARD) + 1)
    _count_words(texts, model)
    model.bigram_shards = int(model.tokens // TOKENS_A_BIGRAM_SHARD) + 1
    model.large = model.tokens / (4 * model.bigram_shards)
    _count_bigrams(texts, model)
    return model


def _count_words(texts: DataFrame, model: Model) -> None:
    shards, path = model.word_shards, model.path

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), Tally()

        def rows() -> pa.RecordBatch:
            seen.settle()
            cols = _blobs(np.searchsorted(_starts(shards), seen.keys, side="right").astype(np.int32), seen.keys, seen.counts.astype(np.uint32))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "keys", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.add(np.append(known.array(words(t.as_py())), np.uint64(END)))
            if len(seen) >= HELD:
                yield rows()
                seen = Tally()
        if seen.size or len(seen):
            yield rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Tally] = {}
        for batch in batches:
            for part, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(part, Tally()).add(np.frombuffer(keys, np.uint64), np.frombuffer(n, np.uint32).astype(np.int64))
        for part, seen in sums.items():
            opens = part == int(np.searchsorted(_starts(shards), np.uint64(START), side="right"))
            if opens:
                seen.add(np.array([START], np.uint64), np.zeros(1, np.int64))
            seen.settle()
            put_file(f"{path}/word-{part}.hash", seen.keys.tobytes())
            put_file(f"{path}/word-{part}.count", seen.counts.tobytes())
            start = int(np.searchsorted(seen.keys, np.uint64(START))) if opens else -1
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in (len(seen), int(seen.counts.sum()), start))], names=["part", "types", "tokens", "start"]
            )

    # The shard of the start token exists even if no word falls into it.
    start = int(np.searchsorted(_starts(shards), np.uint64(START), side="right"))
    seed = texts.sparkSession.createDataFrame([(start, b"", b"")], "part int, keys binary, n binary")
    counted = map_arrow(texts, ["text"], tally, "part int, keys binary, n binary").unionByName(seed)
    found = counted.repartition(shards, "part").mapInArrow(merge, "part int, types bigint, tokens bigint, start bigint").collect()
    sizes = np.zeros(shards, np.int64)
    for r in found:
        sizes[r.part] = r.types
    model.offsets = np.concatenate([[0], np.cumsum(sizes)])
    model.tokens, model.types = sum(r.tokens for r in found), int(sizes.sum()) - 1
    if model.types >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    model.start = next(int(model.offsets[r.part]) + r.start for r in found if r.start >= 0)


def _lookup(model: Model, known: WordHashes, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens of some texts, ends included, the ends' positions, and hashes' ids for reuse."""
    parts = [np.append(known.array(words(t)), np.uint64(END)) for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    kinds, where = np.unique(np.concatenate(parts), return_inverse=True)
    return model.ids(kinds), where, ends


def _contexts(ids: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.append(0, ends[:-1])] = start
    return before


def _grouped(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, int, list]]:
    """Runs of texts of about ``limit`` characters times eight, with their batch and first row."""
    for batch in batches:
        lo, held, size = 0, [], 0
        for i, t in enumerate(batch.column(column)):
            held.append(t.as_py())
            size += len(held[-1] or "") // 8 + 1
            if size >= limit:
                yield batch, lo, held
                lo, held, size = i + 1, [], 0
        if held:
            yield batch, lo, held


def _count_bigrams(texts: DataFrame, model: Model) -> None:
    path = model.path

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, start = WordHashes(), Tally(), model.start

        def rows() -> pa.RecordBatch:
            seen.settle()
            shard = model.bigram_shard(seen.keys).astype(np.int32)
            by = np.argsort(shard, kind="stable")
            cols = _blobs(shard[by], seen.keys[by], seen.counts[by].astype(np.uint32))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "keys", "n"])

        for _, _, held in _grouped(batches, 0, SCORED_AT_ONCE):
            kinds, where, ends = _lookup(model, known, held)
            ids = kinds[where]
            seen.add((_contexts(ids, ends, start).astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
            if len(seen) >= HELD:
                yield rows()
                seen = Tally()
        if seen.size or len(seen):
            yield rows()

    fields = ["part", "kind", "ids", "n", "n1", "n2", "n3"]
    schema = "part int, kind string, ids binary, n binary, n1 binary, n2 binary, n3 binary"

    def word_rows(kind: str, ids: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        cols = _blobs((np.searchsorted(model.offsets, ids, side="right") - 1).astype(np.int32), ids.astype(np.uint32), *columns)
        size = len(cols[0])
        cols += [[b""] * size] * (6 - len(cols))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([kind] * size), *(pa.array(c, pa.binary()) for c in cols[1:])], names=fields)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Tally] = {}
        for batch in batches:
            for part, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(part, Tally()).add(np.frombuffer(keys, np.uint64), np.frombuffer(n, np.uint32).astype(np.int64))
        for part, seen in sums.items():
            seen.settle()
            many = seen.counts >= 255
            put_file(f"{path}/pair-{part}.key", seen.keys.tobytes())
            put_file(f"{path}/pair-{part}.count", np.minimum(seen.counts, 255).astype(np.uint8).tobytes())
            put_file(f"{path}/pair-{part}.many", seen.keys[many].tobytes())
            put_file(f"{path}/pair-{part}.manycount", seen.counts[many].tobytes())
            if not len(seen):
                continue
            v, of_v = np.unique(seen.keys & np.uint64(0xFFFFFFFF), return_counts=True)
            yield word_rows("v", v.astype(np.int64), of_v.astype(np.uint32))
            u, at = np.unique(seen.keys >> np.uint64(32), return_index=True)
            over = lambda a: np.add.reduceat(a, at)
            c = seen.counts
            yield word_rows("u", u.astype(np.int64), over(c).astype(np.uint64), *(over(m).astype(np.uint32) for m in ((c == 1).astype(np.int64), (c == 2).astype(np.int64), (c >= 3).astype(np.int64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array(["high"]), *(pa.array([x], pa.binary()) for x in (b"", np.bincount(np.minimum(c, 5), minlength=6).tobytes(), b"", b"", b""))], names=fields
            )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[int, list[np.ndarray]] = {}
        high = np.zeros(6, np.int64)
        for batch in batches:
            for part, kind, ids, *cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "high":
                    high += np.frombuffer(cells[0], np.int64)
                    continue
                size = model.offsets[part + 1] - model.offsets[part]
                cont, c, n1, n2, n3 = columns.setdefault(part, [np.zeros(size, d) for d in (np.uint32, np.uint64, np.uint32, np.uint32, np.uint32)])
                i = np.frombuffer(ids, np.uint32) - model.offsets[part]
                if kind == "v":
                    cont[i] += np.frombuffer(cells[0], np.uint32)
                else:
                    c[i] += np.frombuffer(cells[0], np.uint64)
                    for a, b in zip((n1, n2, n3), cells[1:], strict=True):
                        a[i] += np.frombuffer(b, np.uint32)
        low = np.zeros(6, np.int64)
        total = 0
        for part, cols in columns.items():
            for name, a in zip(("cont", "c", "n1", "n2", "n3"), cols, strict=True):
                put_file(f"{path}/word-{part}.{name}", a.tobytes())
            low += np.bincount(np.minimum(cols[0], 5), minlength=6)
            total += int(cols[0].sum())
        yield pa.RecordBatch.from_arrays([pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([total], pa.int64())], names=["high", "low", "total"])

    # An empty row for each shard, so that one without pairs has its files too.
    seed = texts.sparkSession.range(model.bigram_shards).select(F.col("id").cast("int").alias("part"), F.lit(b"").alias("keys"), F.lit(b"").alias("n"))
    pairs = map_arrow(texts, ["text"], tally, "part int, keys binary, n binary").unionByName(seed).repartition(model.bigram_shards, "part")
    stats = pairs.mapInArrow(merge, schema).repartition(model.word_shards, "part").mapInArrow(settle, "high array<bigint>, low array<bigint>, total bigint").collect()
    high, low = (np.sum([r[k] for r in stats], axis=0, dtype=np.int64).tolist() if stats else [0] * 6 for k in ("high", "low"))
    model.high_d, model.low_d = discounts(high[1:5]), discounts(low[1:5])
    model.low_total = sum(r.total for r in stats)
    if model.low_total:
        types = (low[1], low[2], low[3] + low[4] + low[5])
        model.low_gamma = sum(d * n for d, n in zip(model.low_d, types, strict=True)) / model.low_total


def score(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of each row with n_tokens, n_known, base_score (add-half unigrams) and score."""
    fields = [*columns, "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = WordHashes(), model.start
        for batch, lo, held in _grouped(batches, len(columns), SCORED_AT_ONCE):
            kinds, where, ends = _lookup(model, known, held)
            count = model.of_words(kinds, "count", np.int64)
            base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
            uniform = 1 / (model.types + 1)
            if model.low_total:
                low = _discounted(model.of_words(kinds, "cont", np.uint32).astype(np.int64), model.low_d) / model.low_total + model.low_gamma * uniform
            else:
                low = np.full(len(kinds), uniform)
            ids = kinds[where]
            p = low[where]
            before = _contexts(ids, ends, start)
            seen_u, at_u = np.unique(before, return_inverse=True)
            c, n1, n2, n3 = (model.of_words(seen_u, n, d).astype(np.float64) for n, d in (("c", np.uint64), ("n1", np.uint32), ("n2", np.uint32), ("n3", np.uint32))) if model.low_total else np.zeros((4, len(seen_u)))
            gamma = np.where(c > 0, sum(d * n for d, n in zip(model.high_d, (n1, n2, n3), strict=True)) / np.maximum(c, 1), 1)[at_u]
            both = (before >= 0) & (ids >= 0) & (c[at_u] > 0)
            high = np.zeros(len(ids))
            high[both] = _discounted(model.bigrams(before[both], ids[both]), model.high_d) / c[at_u][both]
            first = np.append(0, ends[:-1])
            total = lambda a: np.add.reduceat(a, first)
            out = [batch.column(i)[lo : lo + len(held)] for i in range(len(columns))]
            out += [pa.array(np.diff(ends, prepend=0)), pa.array(total((count > 0)[where].astype(np.int64)))]
            out += [pa.array(total(base[where])), pa.array(total(np.log10(high + gamma * p)))]
            yield pa.RecordBatch.from_arrays(out, names=fields)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    source = docs.select(*columns, F.col(text_col).alias("_text_in"))
    return in_arrow(source, run, f"{kinds}, n_tokens bigint, n_known bigint, base_score double, score double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 5) != 1))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
