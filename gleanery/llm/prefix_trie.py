"""The prefix trie of rebuilt conversations, out of mergeable partial tries keyed by hashes.

A node stands for a distinct sequence of first turns. Each turn of a rebuilt conversation is hashed together with its place, and the
key of a prefix is the exclusive or of its turns' hashes (two of 64 bits), so keys can be worked out piece by piece. The texts
themselves are never shuffled, nor kept: a turn goes on as two hashes and a size.

1. Turns are numbered: dealt by range of (conversation, turn), numbered within each part, plus what the earlier parts of a
   conversation hold. No conversation, however long, has to lie in one task; nor does one in the later steps, which cut conversations
   and chains into ``STRETCH`` turns.
2. Partial tries: each partition combines its prefixes to a table (node, parent, members, least member). Tables are
   merged as a tree: a round folds those of ``FAN`` partitions, so a node that all share, as the root, is summed up in rounds.
   End lists are merged likewise: cut by range of ids, combined to sorted runs, and the runs of a node are hashed in order as a stream.
3. Bottom-up rollup. A node belongs to its least member, and what belongs to one conversation is a chain at the lower end of its path. A chain's
   totals (saved tokens, whether it ends in a leaf) are carried up by its conversation to all nodes on its path, and summed by the same merges;
   from a node's sum goes what its own chain has above it. So the number of rounds does not depend on the depth of the trie.

Edge cases: rows with a null conversation id take no part; null roles and texts are empty; a null turn comes first. Turns of one
number go by a hash of role and text, and repeated rows are turns of their own. A conversation whose rebuilt form has no turn is a member of the
root, and ends there. An empty table has no conversations, so not even a root. For a negative id, id % 5 has its sign. Further columns are not read.
Prefixes are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.common import in_arrow, small, stored
from gleanery.session import table

#: Of so many turns a conversation has a head at most, and so many neighbours share the head of one of them.
HEAD, SHARED = 9, 5
STRETCH = 1 << 14
#: Partial tries merged in a round.
FAN = 64
NODE = ["k1", "k2", "depth"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, h1, h2, bytes) with ``pos``, the place in its conversation, from 0."""
    # The last key only spreads repeated rows; which of them comes first does not matter.
    dealt = stored(turns.repartitionByRange("conv", "turn", "h1", "h2", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "trie-turns")
    edges = dealt.groupBy("part").agg(F.array_distinct(F.array(F.min("conv"), F.max("conv"))).alias("conv")).select("part", F.explode("conv").alias("conv"))
    # Two rows a part at most: the first and last conversation of each are the only ones that others may hold, too.
    spans = F.broadcast(edges.withColumn("parts", F.count("*").over(Window.partitionBy("conv"))).where("parts > 1").drop("parts"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.join(spans, ["conv", "part"]).groupBy("conv", "part").count().select("conv", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "h1", "h2"))
    return dealt.withColumn("own", own).join(F.broadcast(held), ["conv", "part"], "left").select("conv", (F.col("own") - 1 + F.coalesce("before", F.lit(0))).alias("pos"), "h1", "h2", "bytes")


def running(rows: DataFrame, group: str, place: str, fold, columns: dict[str, str], inclusive: bool) -> DataFrame:
    """rows with a running ``fold`` of columns (new name: column) within a group, by place, in stretches of bounded length; rows are stored.

    The stretches before a row's own are folded apart, for groups of several stretches only.
    """
    rows = rows.withColumn("stretch", F.floor(F.col(place) / STRETCH))
    within = Window.partitionBy(group, "stretch").orderBy(place).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.withColumns({new: fold(F.col(old)).over(within) for new, old in columns.items()})
    long = stored(rows.where(F.col(place) % STRETCH == 0).where("stretch > 0").select(group).distinct(), "trie-long")
    if not long.isEmpty():
        earlier = Window.partitionBy(group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        totals = rows.join(small(long), group, "left_semi").groupBy(group, "stretch").agg(*(fold(F.col(old)).alias(new) for new, old in columns.items()))
        before = stored(totals.select(group, "stretch", *(fold(F.col(new)).over(earlier).alias(f"before_{new}") for new in columns)), "trie-before")
        out = out.join(small(before), [group, "stretch"], "left")
        out = out.withColumns({new: _two(fold, new) for new in columns}).drop(*(f"before_{new}" for new in columns))
    return out.drop("stretch")


def _two(fold, new: str) -> Column:
    own, before = F.coalesce(new, F.lit(0)), F.coalesce(f"before_{new}", F.lit(0))
    return own.bitwiseXOR(before) if fold is F.bit_xor else own + before


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, s1, s2, bytes, end) of each turn of the rebuilt conversations, and (conv, end) of all conversations at depth 0."""
    conv = F.col("conv")
    heads = turns.where(F.col("pos") < HEAD - 1).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "bytes"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", (F.crc32(conv.cast("string")) % HEAD).cast("int"))
    convs = convs.withColumn("base", conv - conv % SHARED).join(heads.withColumnRenamed("conv", "base"), "base", "left")
    convs = convs.withColumn("head", F.slice("head", 1, F.col("h"))).withColumn("m", F.greatest(F.coalesce(F.size("head"), F.lit(0)), F.lit(0)))
    convs = convs.select("conv", "h", "head", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = stored(convs, "trie-conversations")
    first = convs.select("conv", "length", F.explode("head").alias("t")).select("conv", (F.col("t.pos") + 1).alias("depth"), "length", "t.h1", "t.h2", "t.bytes")
    rest = turns.join(convs.select("conv", "h", "m", "length"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("depth"), "length", "h1", "h2", "bytes")
    salted = lambda h: F.xxhash64("depth", h)
    path = first.unionByName(rest).select("conv", F.col("depth").cast("bigint").alias("depth"), salted("h1").alias("s1"), salted("h2").alias("s2"), "bytes", (F.col("depth") == F.col("length")).alias("end"))
    return path, convs.select("conv", (F.col("length") == 0).alias("end"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, k1, k2, depth, p1, p2, bytes, end): each node on the path of each conversation, the root included; p is the parent's key."""
    path, convs = rebuilt(turns)
    keyed = running(stored(path, "trie-rebuilt"), "conv", "depth", F.bit_xor, {"k1": "s1", "k2": "s2"}, True)
    keyed = keyed.select("conv", *NODE, F.col("k1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("s2")).alias("p2"), "bytes", "end")
    zero = F.lit(0).cast("bigint")
    root = convs.select("conv", *(zero.alias(c) for c in (*NODE, "p1", "p2", "bytes")), "end")
    return stored(keyed.unionByName(root), "trie-prefixes")


def merged(tries: DataFrame, *aggregates: Column) -> DataFrame:
    """Partial tries, one a partition, merged by node in rounds of ``FAN``; the aggregates keep their columns' names."""
    slots = max(2, int(tries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tries = tries.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(slots)))
    while slots > 1:
        slots = -(-slots // FAN)
        tries = tries.withColumn("slot", F.floor(F.col("slot") / FAN)).groupBy(*NODE, "slot").agg(*aggregates)
    return tries.drop("slot")


def end_lists(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends (node, conv): sorted runs, one a node and batch, hashed in order as they stream by."""

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            keys = f[NODE].to_numpy(np.int64)
            by = np.lexsort((np.arange(len(f)), *keys.T))
            keys, convs = keys[by], f["conv"].to_numpy(np.int64)[by]
            first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            texts = [",".join(map(str, run.tolist())) for run in np.split(convs, first[1:])]
            yield pd.DataFrame({**dict(zip(NODE, keys[first].T, strict=True)), "first": convs[first], "ids": texts})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        names = [*NODE, "ends_sha256"]
        for batch in batches:
            done = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    if last:
                        done.append((*last, sha.hexdigest()))
                    last, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*last, sha.hexdigest())], names=names)

    sorted_runs = ends.repartitionByRange("conv").sortWithinPartitions("conv").select(*NODE, "conv").mapInPandas(runs, "k1 bigint, k2 bigint, depth bigint, first bigint, ids string")
    laid = sorted_runs.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids")
    return in_arrow(laid, digests, "k1 bigint, k2 bigint, depth bigint, ends_sha256 string")


def rolled_up(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) out of nodes (node, conv, own, n_children): chains' totals carried up the paths of their conversations."""
    chains = nodes.groupBy("conv").agg(F.sum("own").alias("own"), F.sum((F.col("n_children") == 0).cast("bigint")).alias("n_leaves")).where("own > 0 or n_leaves > 0")
    sums = merged(paths.select("conv", *NODE).join(chains, "conv").select(*NODE, "own", "n_leaves"), F.sum("own").alias("own"), F.sum("n_leaves").alias("n_leaves"))
    above = running(nodes.select("conv", *NODE, "own"), "conv", "depth", F.sum, {"above": "own"}, False).select(*NODE, "above")
    return sums.join(above, NODE).select(*NODE, "n_leaves", (F.col("own") - F.coalesce("above", F.lit(0))).alias("saved_tokens"))


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    light = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(17), text, role).alias("h2"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    paths = prefixes(stored(numbered(light), "trie-numbered"))
    one = F.lit(1).cast("bigint")
    partial = paths.select(*NODE, "p1", "p2", "bytes", "conv", one.alias("n_convs"))
    nodes = merged(partial, F.sum("n_convs").alias("n_convs"), *(F.min(c).alias(c) for c in ("conv", "p1", "p2", "bytes")))
    nodes = stored(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "trie-nodes")
    above = (F.col("depth") - 1).alias("depth")
    kids = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), above).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    root = nodes.where("depth = 0").select("conv").first()
    # Children of the root, often most of a hot key's, need no join.
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv_id")).where("depth > 1")
    lower = nodes.where("depth > 1").join(parents, ["p1", "p2", "depth"])
    upper = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root["conv"] if root else None)).cast("bigint"))
    shas = end_lists(paths.where("end").select(*NODE, "conv"))
    return (
        lower.unionByName(upper)
        .join(rolled_up(nodes, paths), NODE)
        .join(shas, NODE, "left")
        .select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: CRC-32 bit by bit, prefixes as lists, and each node summed over the path of its least member.
OP11_SQL = """
with ordered as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos
  from conversations where conv_id is not null
), convs as (
  select conv_id, conv_id - conv_id % 5 as base,
    xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint),
      lambda crc, byte: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(crc, byte)), 4294967295::bigint), 4294967295) % 9 as h
  from (select distinct conv_id from ordered)
), parts as (
  select c.conv_id, 0 as later, o.pos, o.role, o.text from convs c join ordered o on o.conv_id = c.base and o.pos < c.h
  union all
  select c.conv_id, 1, o.pos, o.role, o.text from convs c join ordered o on o.conv_id = c.conv_id and o.pos >= c.h
), turns as (
  select conv_id, row_number() over (partition by conv_id order by later, pos) as depth, role, text from parts
), paths as (
  select conv_id, depth, octet_length(encode(text)) as bytes, list({'r': role, 't': text}) over (partition by conv_id order by depth) as path from turns
  union all
  select conv_id, 0, 0, [] from convs
), lengths as (
  select conv_id, max(depth) as depth from paths group by conv_id
), ends as (
  select p.path, sha256(string_agg(p.conv_id::varchar, ',' order by p.conv_id)) as ends_sha256 from paths p join lengths using (conv_id, depth) group by p.path
), nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(bytes) as own, path[1:depth - 1] as up from paths group by path, depth
), kids as (
  select up as path, count(*) as n from nodes where depth > 0 group by up
), sums as (
  select p.path, sum(n.own) as saved, count(*) filter (where k.n is null) as leaves
  from nodes n join paths p on p.conv_id = n.conv_id and p.depth <= n.depth left join kids k on k.path = n.path group by p.path
)
select n.conv_id, n.depth::bigint as depth, u.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(k.n, 0)::bigint as n_children, s.leaves::bigint as n_leaves,
  s.saved::bigint as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from nodes n join sums s on s.path = n.path left join kids k on k.path = n.path left join ends e on e.path = n.path
left join nodes u on n.depth > 0 and u.path = n.up and u.depth = n.depth - 1
"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {"op11_prefix_trie": OP11_SQL}
