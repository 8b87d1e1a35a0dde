"""SimHash near-duplicates: fingerprints, and an exact join of them within a few bits over vantage-point trees.

A fingerprint sums up the XXH64 hashes of a text's word shingles, repeats included: a bit is set if it is set in over half of
them. Documents of one fingerprint form a class and go on as one point.

Points are then partitioned by vantage-point trees. A node of the tree has a vantage point and a block of bits; the Hamming
distance to the vantage within that block says in which ring, so in which branch, a point lies. By the triangle inequality, points
within ``radius`` bits of each other differ in that distance by at most their own distance in the block; blocks of a round
do not overlap, so along a path the differences add up, and a branch is pruned as soon as their sum exceeds the radius. That prunes more
than one distance over all bits could.

1. The upper tree is fitted on a bounded sample of the points (``SAMPLE`` of them, an eighth at most); its leaves are the shards. Every
   point is sent to its own shard, and to those of greater number that its ball of ``radius`` overlaps.
2. Each shard, in a task of its own, builds a tree of the same kind over all its points, down to leaves of ``LEAF``; own points and
   visitors descend it, pruned alike, and are compared with the leaves they reach. Each pair is met in one shard.
3. A shard gives one link for each point, to the least of those it is connected with there, so a dense group
   of m points gives m links, not its pairs. Components of the links are worked out by joins.

The fit has no influence on the result: the search is exact. Work grows faster than the points: with 16-bit blocks a point visits about 0.78, 0.37, 0.13 and
0.035 of all shards after one to four levels, and as little again of those after the next four.

Edge cases: null and empty texts, and those without words, have fingerprint zero and are linked like any other; with fewer words than
``k`` the whole sequence is one shingle. Repeated rows share a class; rows of one id with different texts each get a result. A null id is
kept, but never names a component (a component of null ids only has none). An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import map_arrow, stored
from gleanery.llm.components import connected
from gleanery.llm.jaccard import by_part, in_parts
from gleanery.llm.words import words
from gleanery.session import table

SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42
BLOCKS = tuple(np.uint64(0xFFFF << 16 * i) for i in range(4))
SAMPLE = 1 << 16
SHARD_POINTS = 1 << 14
#: A shard has at least so many points of the sample.
SHARD_SAMPLE = 8
LEAF = 64
#: Vantage points tried at a node; the one whose distances vary most is taken.
TRIED = 8
BUFFER = 1 << 20
#: Cells of a distance table, and pairs kept until they are merged: bounds on a task's memory.
CELLS = 1 << 21
SHINGLES_AT_ONCE = 1 << 14


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a text; zero without words."""
    tokens = words(text)
    if not tokens:
        return 0
    line = memoryview(b" ".join(tokens))
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    k = min(k, len(tokens))
    starts, ends = (ends - sizes)[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(starts), SHINGLES_AT_ONCE):
        h = np.array([hashed(line[a:b], SEED) for a, b in zip(starts[lo : lo + SHINGLES_AT_ONCE], ends[lo : lo + SHINGLES_AT_ONCE], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) of each document (id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return map_arrow(docs, ["id", "text"], run, f"id {docs.schema['id'].dataType.simpleString()}, fp bigint")


@dataclass
class Node:
    """A branch: rings (first distance of each) around a vantage within a block of bits, and what lies in each; or a leaf."""

    leaf: int = -1
    points: np.ndarray | None = None
    vantage: np.uint64 = np.uint64(0)
    block: int = 0
    rings: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    inner: list[Node] = field(default_factory=list)


def distances(points: np.ndarray, vantage: np.uint64, block: int) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & BLOCKS[block]).astype(np.int64)


def build_tree(points: np.ndarray, most: int) -> tuple[Node, int]:
    """A vantage-point tree whose leaves have at most ``most`` of the points, unless they are all alike; and the number of its leaves."""
    rng = np.random.default_rng(len(points))
    count = 0

    def grow(own: np.ndarray, level: int, flat: int) -> Node:
        nonlocal count
        if len(own) <= most or flat == len(BLOCKS):
            count += 1
            return Node(count - 1, own)
        block = level % len(BLOCKS)
        tried = own[rng.integers(0, len(own), TRIED)]
        vantage = max(tried, key=lambda v: distances(own, v, block).var())
        d = distances(own, vantage, block)
        sizes = np.bincount(d)
        rings, held = [0], 0
        for at, size in enumerate(sizes[:-1]):
            held += int(size)
            if held >= most / 2:
                rings.append(at + 1)
                held = 0
        if len(rings) == 1:  # one value, or a rest below half a leaf: cut it at the values there are
            rings = [0, *(np.flatnonzero(sizes)[1:].tolist())]
        if len(rings) == 1:
            return grow(own, level + 1, flat + 1)
        node = Node(vantage=vantage, block=block, rings=np.array(rings))
        ring = np.searchsorted(node.rings, d, side="right") - 1
        node.inner = [grow(own[ring == r], level + 1, 0) for r in range(len(rings))]
        return node

    return grow(points, 0, 0), count


def visits(tree: Node, points: np.ndarray, radius: int) -> Iterator[tuple[Node, np.ndarray, np.ndarray]]:
    """(leaf, which points, whether each lies there) for all leaves that the balls of the points may overlap."""
    stack = [(tree, np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool), -1)]
    while stack:
        node, at, used, home, last = stack.pop()
        if node.leaf >= 0:
            yield node, at, home
            continue
        if node.block <= last:  # the next round of blocks: its differences add up anew
            used = np.zeros(len(at), np.int64)
        d = distances(points[at], node.vantage, node.block)
        for r, inner in enumerate(node.inner):
            first, end = node.rings[r], node.rings[r + 1] if r + 1 < len(node.rings) else 65
            gap = used + np.maximum(0, np.maximum(first - d, d - end + 1))
            if len(few := np.flatnonzero(gap <= radius)):
                stack.append((inner, at[few], gap[few], home[few] & (d[few] >= first) & (d[few] < end), node.block))


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of each a and b; a label is the least place of its component."""
    while True:
        x, y = labels[a], labels[b]
        if not (x != y).any():
            return
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels != (up := labels[labels])).any():
            labels[:] = up


def linked(own: np.ndarray, visitors: np.ndarray, radius: int, leaf: int = LEAF) -> np.ndarray:
    """For each of own and visitors the place of the least it is connected with by pairs within ``radius``, one of them of own."""
    tree, _ = build_tree(own, leaf)
    points = np.concatenate([own, visitors])
    place = {int(p): i for i, p in enumerate(own)}
    labels = np.arange(len(points))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for node, at, _ in visits(tree, points, radius):
        here = np.array([place[int(p)] for p in node.points])
        step = max(1, CELLS // len(here))
        for lo in range(0, len(at), step):
            few = at[lo : lo + step]
            near = np.bitwise_count(points[few][:, None] ^ node.points[None, :]) <= radius
            i, j = np.nonzero(near)
            a, b = few[i], here[j]
            fresh = labels[a] != labels[b]
            if fresh.any():
                held.append((a[fresh], b[fresh]))
                size += len(held[-1][0])
            if size >= CELLS:
                merge(labels, *(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0
    if held:
        merge(labels, *(np.concatenate(c) for c in zip(*held, strict=True)))
    return labels


def near_links(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(a, b) of distinct points (fp): links that connect just those fingerprints that pairs within ``radius`` bits connect."""
    n = points.count()
    share = min(1 / 8, SAMPLE / max(n, 1))
    few = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("fp").toArrow()
    sample = few.column(0).to_numpy().view(np.uint64)
    tree, shards = build_tree(np.sort(sample), max(SHARD_SAMPLE, round(shard_points * len(sample) / max(n, 1))))
    known = points.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            both = np.concatenate(held)
            home_of = np.full(len(both), -1)
            found = list(visits(known.value, both, radius))
            for leaf, at, home in found:
                home_of[at[home]] = leaf.leaf
            rows = [(leaf.leaf, both[at[home]].tobytes(), both[at[leaf.leaf > home_of[at]]].tobytes()) for leaf, at, home in found]
            part, own, others = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(own, pa.binary()), pa.array(others, pa.binary())], names=["part", "own", "others"])

        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            size += len(batch)
            if size >= BUFFER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cells in by_part(batches, [np.uint64, np.uint64]):
            own, others = (np.concatenate(c) for c in zip(*cells, strict=True))
            if len(own):
                own, others = np.unique(own), np.unique(others)
                both = np.concatenate([own, others]).view(np.int64)
                labels = linked(own, others, radius)
                at = np.flatnonzero(labels != np.arange(len(labels)))
                yield pa.RecordBatch.from_arrays([pa.array(both[at]), pa.array(both[labels[at]])], names=["a", "b"])

    dealt = map_arrow(points, ["fp"], deal, "part int, own binary, others binary")
    return in_parts(dealt, shards).mapInArrow(search, "a bigint, b bigint")


def simhash_components(docs: DataFrame, k: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shard_points: int = SHARD_POINTS) -> DataFrame:
    """(id_col, fingerprint, component_id) of each row; fingerprint is 16 hexadecimal digits."""
    marked = stored(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), k), "simhash-marks")
    points = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-points")
    groups = connected(stored(near_links(points, radius, shard_points).distinct(), "simhash-links"))
    labelled = points.join(groups.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(names, "label").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op12_simhash_near_dedup": op12_simhash_near_dedup}
