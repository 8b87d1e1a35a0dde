"""The prefix trie of conversations, against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gleanery.llm import prefix_trie


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = own + sum(saved[k] for k in children[node])
    sha = lambda convs: hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest()
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), leaves[node], saved[node], sha(ends[node])) for node, m in members.items()
    )


def result(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in df.collect())


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string, k1 int")
    assert result(prefix_trie.trie(docs)) == plain_trie(rows)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = prefix_trie.op11_prefix_trie(spark, sf_dir)
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    assert result(df) == plain_trie(rows)


def test_cases(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(40, 60) for t in range(c % 7 + 1)]  # many share paths, some are exact copies
    rows += [(None, 0, "user", "no conversation"), (101, None, "user", "null turn first"), (101, 5, None, None), (101, -3, "", ""), (102, 0, "user", "é" * 5000)]
    rows += [(200, 0, "user", "repeated")] * 3 + [(201, 0, "user", "repeated")]
    rows += [(-7, 0, "user", "same 0"), (0, 0, "assistant", "zero"), (3, 0, "user", "short"), (4, 0, "user", "short")]
    # 10**15 + 1 has no base and fewer turns than its head takes: no turn is left.
    lone = next(c for c in range(10**15, 10**15 + 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows += [(lone, 0, "user", "a"), (lone, 1, "user", "b")]
    rows += [(c, 0, "user", "ab") for c in (305, 310)] + [(c, 0, "usera", "b") for c in (315, 320)]
    docs = [r for r in rows if r[0] is None or r[0] >= 0 or r[0] % 5 == 0]
    check(spark, docs)
    negative = prefix_trie.trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert negative.where("depth = 0").first().n_convs == len({r[0] for r in rows} - {None})
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.trie(empty).count() == 0


@pytest.mark.parametrize("stretch", [3, 64])
def test_long_conversations_are_cut(spark, monkeypatch, stretch):
    """A conversation of most rows lies in many parts and stretches; copies of it, and of its beginning, share its nodes."""
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    rng = random.Random(stretch)
    long = [("user", f"turn {i} " + "x" * rng.randint(0, 9)) for i in range(300)]
    rows = [(10, t, *r) for t, r in enumerate(long)] + [(15, t, *r) for t, r in enumerate(long)] + [(20, t, *r) for t, r in enumerate(long[:170])]
    rows += [(25, t, *r) for t, r in enumerate([*long[:120], ("user", "parts here"), *long[121:200]])]
    rows += [(c, t, "user", f"{c % 3} {t}") for c in range(100, 130) for t in range(rng.randint(1, 12))]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
