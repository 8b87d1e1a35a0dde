"""Fingerprints joined over vantage-point trees, and whitening."""

import random
import re

import numpy as np
import pytest
import xxhash

from gleanery.llm import simhash, whitening


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """doc_id -> least id reached; rows (doc_id, fingerprint)."""
    left, out = dict(enumerate(rows)), {}
    while left:
        start, _ = left.popitem()[1], None
        group, open_ = [start], [start]
        while open_:
            fp = open_.pop()[1]
            near = [i for i, r in left.items() if (fp ^ r[1]).bit_count() <= 3]
            open_ += [left[i] for i in near]
            group += [left.pop(i) for i in near]
        least = min((i for i, _ in group if i is not None), default=None)
        out.update({r: least for r in group})
    return out


def balls(rng, centres, rounds):
    """Distinct fingerprints in chains of steps of one to three bits from each centre."""
    found = set()
    for _ in range(centres):
        at = rng.getrandbits(64)
        for _ in range(rounds):
            found.add(at)
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.randrange(64)
    return np.array(sorted(found), np.uint64)


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_pairs_over_a_tree_are_exact(leaf):
    points = balls(random.Random(leaf), 40, 12)
    own, visitors = points[::2], points[1::2]
    both = np.concatenate([own, visitors])
    near = np.bitwise_count(both[:, None] ^ both[None, :]) <= 3
    near[len(own) :, len(own) :] = False
    want = np.arange(len(both))
    simhash.merge(want, *np.nonzero(near))
    assert (simhash.linked(own, visitors, 3, leaf) == want).all()


def test_points_are_at_home_in_one_leaf_and_meet_all_near_ones():
    points = balls(random.Random(5), 30, 20)
    tree, leaves = simhash.build_tree(points[::3], 6)
    at_home, met = np.zeros(len(points), int), np.zeros((len(points), leaves), bool)
    for leaf, at, home in simhash.visits(tree, points, 3):
        at_home[at[home]] += 1
        met[at, leaf.leaf] = True
    assert (at_home == 1).all() and leaves > 20
    home = np.zeros(len(points), int)
    for leaf, at, own in simhash.visits(tree, points, 3):
        home[at[own]] = leaf.leaf
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    assert met[i, home[j]].all()


def test_links_in_many_shards_equal_brute_force(spark):
    points = balls(random.Random(9), 150, 12)
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    label = dict(zip(points.tolist(), points.tolist(), strict=True))

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for a, b in simhash.near_links(frame, shard_points=100).collect():
        a, b = root(a % 2**64), root(b % 2**64)
        label[max(a, b)] = min(a, b)
    got = [root(p) for p in points.tolist()]
    want = np.arange(len(points))
    simhash.merge(want, *np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3))
    groups = lambda of: sorted(sorted(np.flatnonzero(np.array(of) == g)) for g in set(of))
    assert groups(got) == groups(want.tolist())


def test_fingerprints_and_components_of_documents(spark, sf_dir):
    rng = random.Random(3)
    vocabulary = [f"W{i}" for i in range(50)]
    long = " ".join(rng.choice(vocabulary) for _ in range(40_000))
    texts = [None, "", " \n\t", "one", "ONE", "one two", "Ünï two\x0bthree four five", long, long + " end", long, "a b c", "a  B\tc"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one"), (None, "lonely words here"), (3, "one"), (3, "another text")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, fp string, component_id int")
    got = sorted(map(tuple, simhash.simhash_components(docs).collect()), key=str)
    marked = [(i, plain_fingerprint(t)) for i, t in rows]
    component = plain_components(marked)
    assert got == sorted(((i, f"{f:016x}", component[(i, f)]) for i, f in marked), key=str)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    marked = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    component = plain_components(marked)
    got = simhash.op12_simhash_near_dedup(spark, sf_dir).collect()
    assert {tuple(r) for r in got} == {(i, f"{f:016x}", component[(i, f)]) for i, f in marked} and len(got) == len(docs)


def plain_whitening(vectors, most=32):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    deviation = [sum(c * c for c in v) for v in y]
    y = np.array([[c / n for c in v] for v in y])
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return deviation, y @ q / np.sqrt(e), e / np.trace(v)


def compare(got, ids, vectors, most=32):
    deviation, white, explained = plain_whitening(vectors, most)
    got = {(r.vec_id, r.component): r for r in got}
    assert len(got) == white.size
    for j in range(white.shape[1]):
        mine = np.array([got[i, j + 1].whitened for i in ids])
        sign = np.sign(mine @ white[:, j])
        assert np.abs(mine * sign - white[:, j]).max() < 1e-6
    for i, d in zip(ids, deviation, strict=True):
        r = got[i, 1]
        assert (int(r.deviation), r.n) == (d, len(ids)) and r.identity_error < 1e-9
    assert np.allclose([got[ids[0], j + 1].explained for j in range(white.shape[1])], explained, rtol=1e-9)


def test_whitening_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = whitening.op13_whitening(spark, sf_dir)
    assert dict(got.dtypes)["deviation"] == "bigint"
    compare(got.collect(), [r.vec_id for r in rows], [list(r.embedding) for r in rows])


def test_whitening_of_entries_beyond_longs(spark):
    """Products and squares that no long holds are still exact."""
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(40, 3)) * [1e9, 1e12, 1e10]).tolist()
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    compare(whitening.whiten(docs).collect(), list(range(40)), vectors)


def test_whitening_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 0.0]), (3, [nan, 1.0]), (4, None), (5, [1.0, None]), (6, [inf, 0.0]), (7, [3.0, -1.0]), (8, [1e30, 0.0]), (9, []), (10, [0.5])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, component string")
    got = whitening.whiten(docs).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == sorted((i, c, 4) for i in (1, 1, 0, 7) for c in (1, 2))
    white = np.array([[r.whitened for r in got if r.component == c] for c in (1, 2)])
    assert np.abs(white @ white.T / 4 - np.eye(2)).max() < 1e-9
    alike = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id bigint, embedding array<double>")
    assert whitening.whiten(alike).count() == 0 and whitening.whiten(alike.limit(0)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 5.0, float(-i)]) for i in range(5)], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(flat).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-9 for r in got)
    mixed = docs.unionByName(spark.createDataFrame([(20, [1.5], "x"), (21, [2.5], "x")], docs.schema))
    assert {(r.vec_id, r.n) for r in whitening.whiten(mixed).where("vec_id > 9").collect()} == {(10, 3), (20, 3), (21, 3)}
