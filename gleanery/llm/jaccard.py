"""Exact n-gram Jaccard self-join and its components over a token-group matrix.

Documents with one and the same shingle set form a class and go on as one node. Then:

1. Shingles are put in one global order: by hash, the known frequent ones last. Two sets that link
   share a shingle within their prefixes of n - ceil(t n) + 1, so prefixes are all that is
   exchanged. (Which shingles count as frequent affects speed alone; any order gives the same links.)
   Sets of n and m shingles link only with a = t (n + m) / (1 + t) in common, so behind the first
   common one each must still have a: its position rules out most chance meetings.
2. Similar nodes are partitioned into groups: of the nodes that share a prefix shingle each is
   compared with two of them, the one with the smallest share of rare shingles, which in a group of edited
   copies is the least edited, and the one of the greatest name. Verified links join nodes into groups.
   That takes a number of comparisons linear in the nodes, however large a group of copies is.
3. Only pairs in different groups are left. For each prefix shingle the matrix tells in which groups
   it occurs; a node of the smaller group queries the larger one. A shingle of very many nodes is split: its groups are dealt
   into parts, and each part meets the nodes in a task of its own. For groups of several nodes the
   union of all their shingles is stored, the overlap of the query with it is counted, and the
   group is opened only for members of a size that this overlap allows: none can overlap more.
4. Opened members are compared one by one, and the new links complete the components.

Each comparison is exact, on whole texts. No step lists all pairs of a group, and no group is
gathered in a task: frequent shingles are spread over all partitions.

Edge cases: a null or empty text has an empty set (n_shingles 0), linked with nothing; its component is its
own id. With fewer words than ``k`` the whole sequence is one shingle. Repeated rows are in one class; rows
of one id with different texts each get a result. Rows with a null id are linked like others but
never name a component. An empty table gives an empty result. Further columns are not read. Shingles
and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import map_arrow, small, stored
from gleanery.llm.components import connected
from gleanery.llm.words import distinct, mix, shingle_sets
from gleanery.session import table

#: From which count on shingles are frequent.
FREQUENT = 24
#: The most frequent ones are known to all tasks: 8 bytes each, 2 MB in all.
MOST_FREQUENT = 1 << 18
ROWS_A_PART = 1 << 20
#: Beyond so many parts tasks take several, one after the other.
MOST_TASKS = 1 << 15
#: A shingle with more nodes than this meets its groups in several parts.
HOT_NODES = 1 << 12
BUFFER = 1 << 20


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit name for a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """(id, ref, n, node) of each document (id, ref, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64())], names=["id", "ref", "n", "node"]
            )

    return map_arrow(docs, ["id", "ref", "text"], run, f"id {docs.schema['id'].dataType.simpleString()}, ref bigint, n bigint, node bigint")


def _as_long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _parts_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of ``parts`` equal ranges in a sorted array of hashes."""
    edges = (np.arange(1, parts) / parts * 2.0**64).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])


def in_parts(rows: DataFrame, parts: int) -> DataFrame:
    """rows with each part whole in one partition and its rows together, so tasks hold one part at a time however parts are dealt."""
    return rows.repartition(min(parts, MOST_TASKS), "part").sortWithinPartitions("part")


def by_part(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> Iterator[tuple[int, list[tuple]]]:
    """(part, its cells) of rows (part, one binary column a kind) that come sorted by part; negative parts are given cell by cell."""
    last, cells = None, []
    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if cells and (part != last or part < 0):
                yield last, cells
                cells = []
            last = part
            cells.append(tuple(np.frombuffer(c, kind) for c, kind in zip(row, kinds, strict=True)))
    if cells:
        yield last, cells


def frequent_shingles(docs: DataFrame, k: int, total: int, least: int = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """The most frequent shingles, sorted; a bounded number. All shingles of all documents are counted."""
    parts = int(total / ROWS_A_PART) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            both = np.concatenate(held)
            keys = distinct(both)
            n = np.diff(np.append(np.searchsorted(both, keys), len(both)))
            at = _parts_of(keys, parts)
            rows = [(p, keys[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes()) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            part, kb, nb = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kb, pa.binary()), pa.array(nb, pa.binary())], names=["part", "keys", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), k):
                if len(s):
                    held.append(s)
                    size += len(s)
            if size >= BUFFER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cells in by_part(batches, [np.uint64, np.uint32]):
            keys, where = np.unique(np.concatenate([c[0] for c in cells]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c[1] for c in cells])).astype(np.int64)
            keep = n >= least
            yield pa.RecordBatch.from_arrays([_as_long(keys[keep]), pa.array(n[keep])], names=["h", "n"])

    counted = map_arrow(docs, ["text"], count, "part int, keys binary, n binary")
    rows = in_parts(counted, parts).mapInArrow(total_up, "h bigint, n bigint").orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def shared_prefixes(docs: DataFrame, k: int, percent: int, total: int, frequent: np.ndarray) -> DataFrame:
    """(token, node, n, pos, rare): prefix shingles of each node that may occur in the prefix of another one.

    pos is the shingle's place in the global order of its set, rare the per mille of the set's
    shingles that are not frequent.
    """
    parts = max(1, int(total * (100 - percent) / 100 / ROWS_A_PART) + 1)
    known_frequent = docs.sparkSession.sparkContext.broadcast(frequent)
    names, kinds = ["token", "node", "n", "pos", "rare"], [np.int64, np.int64, np.int32, np.int32, np.int32]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = known_frequent.value
        held: list[tuple] = []
        size, seen = 0, set()

        def flush() -> pa.RecordBatch:
            token, node, n, pos, share, common = (np.concatenate(c) for c in zip(*held, strict=True))
            # Frequent ones are spread by node, as all of them are passed on; the others meet by token.
            part = np.where(common, mix(token ^ node.view(np.uint64)) % np.uint64(parts), mix(token) % np.uint64(parts)).astype(np.int32)
            part = np.where(common, -1 - part, part)
            by = np.argsort(part, kind="stable")
            ids, at = np.unique(part[by], return_index=True)
            cells = np.split(by, at[1:])
            cols = [[a[c].tobytes() for c in cells] for a in (token, node, n, pos, share)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["part", *names])

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), k):
                if not len(s):
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                p = prefix_size(len(s), percent)
                common = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
                rare = s[~common][:p]
                rest = s[common][: p - len(rare)]
                share = 1000 * (len(s) - np.count_nonzero(common)) // len(s)
                same = [np.full(p, x, np.int32) for x in (len(s), share)]
                held.append((np.concatenate([rare, rest]), np.full(p, node), same[0], np.arange(p, dtype=np.int32), same[1], np.arange(p) >= len(rare)))
                size += p
            if size >= BUFFER // 2:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cells in by_part(batches, kinds):
            if part < 0:
                for cell in cells:
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in cell], names=names)
                continue
            columns = [np.concatenate(c) for c in zip(*cells, strict=True)]
            by = np.lexsort((columns[1], columns[0]))
            columns = [c[by] for c in columns]
            token, node = columns[:2]
            fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
            columns = [c[fresh] for c in columns]
            same = columns[0][1:] == columns[0][:-1]
            met = np.append(False, same) | np.append(same, False)
            yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in columns], names=names)

    rows = map_arrow(docs, ["text"], emit, "part int, " + ", ".join(f"{c} binary" for c in names))
    return in_parts(rows, parts).mapInArrow(meet, "token bigint, node bigint, n int, pos int, rare int")


class Join:
    """The state of one join: documents (id, ref, text) and what has been stored of them.

    ref finds a document again: a hash of its id, or of its text where the id is null. As different
    texts may share one, a text counts as a node's only if its set has that name.
    """

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.k, self.percent = k, percent
        self.docs = docs
        self.sets = stored(describe(docs, k), "jaccard-sets")
        self.nodes = self.sets.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.min("ref").alias("ref"))

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of distinct nodes, by one document of each."""
        wanted = stored(self.nodes.join(nodes, "node", "left_semi").select("ref", "node"), "jaccard-wanted")
        return self.docs.join(small(wanted), "ref").select("node", "text")

    def sizes_fit(self, a: str, b: str):
        return (100 * F.col(a) >= self.percent * F.col(b)) & (100 * F.col(b) >= self.percent * F.col(a))

    def may_overlap(self, left: str, n: str, m):
        """Whether a set of n with ``left`` shingles from here on can have as many in common as one of m asks for."""
        return F.col(left) * (100 + self.percent) >= self.percent * (F.col(n) + m)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) of nodes that link."""
        k, percent = self.k, self.percent
        texts = self.texts(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        laid = (
            pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b")
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                # Pairs with the same b lie together.
                others: dict[tuple, int] = {}
                which = [others.setdefault(other, len(others)) for other in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                of_b = [(node, s) for (node, _), s in zip(others, shingle_sets([t for _, t in others], k), strict=True)]
                of_a = zip(batch.column(0).to_pylist(), shingle_sets(batch.column(2).to_pylist(), k), strict=True)
                for i, ((a, mine), (b, theirs)) in enumerate(zip(of_a, map(of_b.__getitem__, which), strict=True)):
                    if node_of(theirs) != b or node_of(mine) != a:
                        continue
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(theirs) - both):
                        keep.append(i)
                yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

        return map_arrow(laid, ["a", "b", "text_a", "text_b"], run, "a bigint, b bigint").distinct()

    def tokens(self, members: DataFrame, label: str) -> DataFrame:
        """Distinct (label, token) over the whole texts of members (node, label)."""
        k = self.k
        laid = self.texts(members.select("node").distinct()).join(members, "node").select(label, "node", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, nodes, texts = (c.to_pylist() for c in batch.columns)
                for name, node, s in zip(names, nodes, shingle_sets(texts, k), strict=True):
                    if node_of(s) == node:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), name)), _as_long(s)], names=[label, "token"])

        return map_arrow(laid.withColumnRenamed("node", "of"), [label, "of", "text"], run, f"{label} bigint, token bigint").distinct()


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of each row; see the module's text."""
    ref = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(0), F.col(text_col))).otherwise(F.xxhash64(F.col(id_col).cast("string")))
    docs = docs.select(F.col(id_col).alias("id"), ref.alias("ref"), F.col(text_col).alias("text"))
    join = Join(docs, k, percent)
    total = join.sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = frequent_shingles(docs, k, total)
    prefixes = stored(shared_prefixes(docs, k, percent, total, frequent), "jaccard-prefixes")

    # Groups: links with the least edited and the greatest node that share a prefix shingle.
    prefixes = prefixes.withColumn("left", F.col("n") - F.col("pos"))
    leaders = (
        prefixes.groupBy("token")
        .agg(F.min(F.struct("rare", "node", "n", "left")).alias("lo"), F.max(F.struct("node", "n", "left")).alias("hi"), F.min("node").alias("other"))
        .where("other <> hi.node")
    )
    two = F.array(F.struct("lo.node", "lo.n", "lo.left"), F.col("hi"))
    star = prefixes.join(leaders, "token").select(F.col("node").alias("a"), "n", "left", F.explode(two).alias("to"))
    star = star.select("a", "n", "left", F.col("to.node").alias("b"), F.col("to.n").alias("m"), F.col("to.left").alias("m_left"))
    star = star.where("a <> b").where(join.sizes_fit("n", "m") & join.may_overlap("left", "n", F.col("m")) & join.may_overlap("m_left", "m", F.col("n")))
    tried = stored(star.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "jaccard-tried")
    links = stored(join.verified(tried), "jaccard-links")
    groups = connected(links)

    # Queries: a node of the smaller group against the larger group, for each prefix shingle in both.
    size = F.count("*").alias("size")
    sizes = groups.groupBy("label").agg(size)
    labelled = (
        prefixes.join(groups.join(sizes, "label"), "node", "left")
        .select("token", "node", "n", "left", F.coalesce("label", "node").alias("group"), F.coalesce("size", F.lit(1)).alias("size"))
    )
    mixed = labelled.groupBy("token").agg(F.min("group").alias("g"), F.max("group").alias("h")).where("g <> h").select("token")
    labelled = stored(labelled.join(mixed, "token", "left_semi"), "jaccard-mixed")
    matrix = labelled.groupBy("token", "group", "size").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("left").alias("most_left"))
    other = matrix.select("token", F.col("group").alias("to"), F.col("size").alias("to_size"), "least", "most", "most_left")
    smallest = F.greatest(F.col("least"), percent * F.col("n") / 100)
    hot = labelled.groupBy("token").agg(F.count("*").alias("parts")).where(F.col("parts") > HOT_NODES)
    hot = stored(hot.select("token", F.ceil(F.col("parts") / HOT_NODES).cast("int").alias("parts")), "jaccard-hot")
    parts = F.coalesce("parts", F.lit(1))
    other = other.join(small(hot), "token", "left").withColumn("part", F.pmod(F.xxhash64("to"), parts).cast("int")).drop("parts")
    asking = labelled.join(small(hot), "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    asks = (
        asking.join(other, ["token", "part"])
        .where("size < to_size or (size = to_size and group < to)")
        .where((percent * F.col("n") <= 100 * F.col("most")) & (percent * F.col("least") <= 100 * F.col("n")))
        .where(join.may_overlap("left", "n", smallest) & join.may_overlap("most_left", "n", smallest))
        .select("node", "n", "to", "to_size")
        .distinct()
    )
    asks = stored(asks, "jaccard-asks")
    alone = asks.where("to_size = 1").select(F.col("node").alias("q"), F.col("to").alias("m"))
    wide = asks.where("to_size > 1")
    opened = alone
    if not wide.isEmpty():
        union = join.tokens(groups.join(wide.select(F.col("to").alias("label")).distinct(), "label", "left_semi"), "label")
        queries = join.tokens(wide.select("node").distinct().withColumn("label", F.col("node")), "label").withColumnRenamed("label", "node")
        overlap = wide.join(queries, "node").join(union.withColumnRenamed("label", "to"), ["to", "token"]).groupBy("node", "n", "to").agg(F.count("*").alias("both"))
        members = groups.select(F.col("node").alias("m"), F.col("label").alias("to")).join(join.sets.select(F.col("node").alias("m"), F.col("n").alias("n_m")).distinct(), "m")
        least = members.groupBy("to").agg(F.min("n_m").alias("least"))
        qualified = overlap.join(least, "to").where(join.may_overlap("both", "n", smallest)).drop("least")
        into = qualified.join(members, "to").where(join.sizes_fit("n", "n_m") & join.may_overlap("both", "n", F.col("n_m")))
        opened = alone.union(into.select(F.col("node").alias("q"), "m"))
    pairs = opened.select(F.least("q", "m").alias("b"), F.greatest("q", "m").alias("a")).distinct()
    more = join.verified(stored(pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-opened"))
    groups = connected(stored(links.union(more), "jaccard-links"))

    named = join.nodes.join(groups, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "id")
    names = named.groupBy("label").agg(F.min("id").alias("component_id"))
    result = named.select("node", "label").join(names, "label").select("node", "component_id")
    return join.sets.join(result, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
