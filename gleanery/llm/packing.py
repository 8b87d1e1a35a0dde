"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents are tokenised and read as one stream in stored order; the stream is cut into windows of
at most ``window`` ids. Cuts may fall at document ends (free), at sentence ends (cheap) and, inside
long sentences, at set distances (dear). The cost of a window is its padding (none at a power of
two), a charge for each window, and the penalty of its closing cut. As padding is linear in the
opening cut, the best opening cut for each closing one is a sliding minimum, kept in a monotone
queue; the few power-of-two lengths are looked up besides.

Every input partition is a stream of its own, so nothing is shuffled and a lost task is redone alone;
it costs at most one part-filled window per partition. Within a partition the stream is cut in blocks of ``BLOCK`` ids;
the rest of a block (under one window) opens the next one, so memory holds a block and one document. The plan is the cheapest
of each block, so over a stream it may cost about one window more for each block of 512 windows.

Edge cases: a null or empty text is its closing id alone; a text longer than a window is cut into
pieces; repeated rows are packed one by one; an empty table packs into nothing; other columns are
not read. Ties go to the earliest opening cut.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.common import map_arrow
from gleanery.session import table

END_ID = 0
BLOCK = 1 << 19
WINDOW_CHARGE = 32
SENTENCE_PENALTY = 2
SPLIT_PENALTY = 16
SPLIT_EVERY = 64
CACHE_WORDS = 300_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordCachedTokenizer:
    """Ids of the public byte-level BPE as little-endian uint32 bytes.

    Its pre-tokens never join a space to what stands before it, so a word with its leading space
    is encoded alone and kept in a bounded cache. Texts with runs of white space, where that does
    not hold, are encoded whole. Where the same vocabulary lies beside the tokenizer file as a list of ranks,
    that is read, as it encodes faster; else the file itself.
    """

    def __init__(self, path: str | None = None):
        path = path or default_tokenizer()
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                self.pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.pieces, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.pieces = {piece.encode(): i for piece, i in tokenizer.get_vocab().items()}
            self._encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.words: dict[str, bytes | None] = {}

    def ends_sentence(self) -> np.ndarray:
        """By id; a line end is spelt as Ċ in the tokenizer file."""
        flags = np.zeros(max(self.pieces.values()) + 2, bool)
        for piece, i in self.pieces.items():
            flags[i] = piece.endswith((b".", b"!", b"?", b"\n", "Ċ".encode()))
        return flags

    def whole(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def _word(self, word: str) -> bytes | None:
        bare = word[1:] if word.startswith("\n") else word
        if not bare or bare[0].isspace() or bare[-1].isspace():
            out = None
        else:
            out = self.whole(word if word.startswith("\n") else " " + word)
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        self.words[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first or first[0].isspace() or first[-1].isspace():
            return self.whole(text)
        known, word = self.words, self._word
        try:
            return self.whole(first) + b"".join([known[w] if w in known else word(w) for w in rest])
        except TypeError:  # a run of white space somewhere
            return self.whole(text)


def candidate_cuts(flags: np.ndarray, doc_ends: np.ndarray, total: int) -> tuple[list[int], list[int]]:
    """Positions where a window may close, ascending, and their penalties."""
    sentence = np.flatnonzero(flags) + 1
    base = np.union1d(sentence, doc_ends)
    gaps = np.diff(base, prepend=0)
    extra = [
        np.arange(end - gap + SPLIT_EVERY, end, SPLIT_EVERY) for end, gap in zip(base[gaps > SPLIT_EVERY], gaps[gaps > SPLIT_EVERY], strict=True)
    ]
    if extra:
        cuts = np.union1d(base, np.concatenate(extra))
    else:
        cuts = base
    penalty = np.full(len(cuts), SPLIT_PENALTY)
    penalty[np.isin(cuts, sentence, assume_unique=True)] = SENTENCE_PENALTY
    penalty[np.isin(cuts, doc_ends, assume_unique=True)] = 0
    assert total == 0 or cuts[-1] == total
    return cuts.tolist(), penalty.tolist()


def plan_windows(cuts: list[int], penalties: list[int], window: int, last: bool) -> list[int]:
    """Closing positions of the cheapest windows from 0 on.

    ``last``: the final cut must close a window; else any cut within a window of it may, and what
    lies behind that cut is left over.
    """
    powers = [p for p in (512, 256, 128, 64) if p < window]
    at = [0, *cuts]
    index = {0: 0}
    best, came = [0], [0]
    queue = deque([0])
    slack = [0]  # best[i] + at[i], ascending along the queue
    for k in range(1, len(at)):
        pos = at[k]
        floor = pos - window
        while at[queue[0]] < floor:
            queue.popleft()
        i = queue[0]
        cost = slack[i] - floor
        for p in powers:
            j = index.get(pos - p)
            if j is not None and best[j] < cost:
                cost, i = best[j], j
        cost += WINDOW_CHARGE + penalties[k - 1]
        index[pos] = k
        best.append(cost)
        came.append(i)
        s = cost + pos
        slack.append(s)
        while queue and slack[queue[-1]] > s:
            queue.pop()
        queue.append(k)
    k = len(at) - 1
    if not last:
        floor = at[-1] - window
        k = min((i for i in range(len(at) - 1, -1, -1) if at[i] > floor), key=lambda i: (slack[i] - 2 * at[i], -i))
    closes = []
    while k:
        closes.append(at[k])
        k = came[k]
    return closes[::-1]


SCHEMA = "`{id}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class _Packer:
    """Streams documents in, pieces out."""

    def __init__(self, tokenizer: WordCachedTokenizer, window: int, first_sequence: int):
        self.tokenizer, self.window, self.sequence = tokenizer, window, first_sequence
        self.ends = tokenizer.ends_sentence()
        self.docs: list[list] = []  # id, ids as bytes, first id not yet packed
        self.held = 0

    def push(self, doc_id, text: str | None) -> list[tuple]:
        ids = self.tokenizer.ids(text or "") + END_ID.to_bytes(4, "little")
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids) // 4
        return self.flush(False) if self.held >= BLOCK else []

    def flush(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        stream = np.frombuffer(b"".join([ids[4 * done :] if done else ids for _, ids, done in self.docs]), "<u4")
        sizes = np.array([len(ids) // 4 - done for _, ids, done in self.docs])
        flags = self.ends[np.minimum(stream, len(self.ends) - 1)]
        closes = plan_windows(*candidate_cuts(flags, np.cumsum(sizes), len(stream)), self.window, last)
        out, d, opened = [], 0, 0
        for close in closes:
            offset = 0
            while opened < close:
                doc_id, ids, done = doc = self.docs[d]
                size = len(ids) // 4
                take = min(size - done, close - opened)
                out.append((doc_id, done, take, zlib.crc32(ids[4 * done : 4 * (done + take)]), size, self.sequence, offset))
                doc[2] += take
                offset += take
                opened += take
                d += doc[2] == size
            self.sequence += 1
        self.docs = self.docs[d:]
        self.held -= opened
        return out


def pack_documents(docs: DataFrame, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``sequence_id`` is the partition's number times 2**40 plus a counter, so ids are unique and a
    task that runs again gives the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(WordCachedTokenizer(tokenizer_path), window, TaskContext.get().partitionId() << 40)
        id_type = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += packer.push(doc_id, text.as_py())
            if rows:
                yield batch_of(rows)
        if rows := packer.flush(True):
            yield batch_of(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs, [id_col, text_col], run, SCHEMA.format(id=id_col, kind=kind))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
