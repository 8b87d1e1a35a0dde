"""Neighbour search, the Jaccard join and the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from gleanery.llm import ann, jaccard, words
from gleanery.llm.components import connected
from gleanery.session import table


def brute_neighbours(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in dict(rows).items() if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            scored = [(-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in good if j != i and len(w) == len(v)]
            out[i] = [j for _, j in sorted(scored, key=lambda x: (round(x[0], 12), x[1]))[:k]]
    return out


def recall(got, want):
    hit = total = 0
    for q, ids in want.items():
        hit += len(set(ids) & {v for _, v in got[q]})
        total += len(ids)
    return hit / total


def answers(df):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id))
        assert [x for x, _ in got[r.query_id]] == list(range(1, len(got[r.query_id]) + 1))
    return got


def test_neighbours_with_a_dense_cluster_and_copies(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    vectors = [rng.normal(size=16) if i % 3 else centre + 0.02 * rng.normal(size=16) for i in range(2000)]
    for i in range(0, 600, 2):
        vectors[i] = vectors[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, score string")
    asked = ann.F.col("vec_id") % 50 == 0
    assert recall(answers(ann.nearest(docs, asked, shard_rows=400)), brute_neighbours(rows)) >= 0.9


def test_neighbours_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [1.0, None]), (50, [2.0, 0.0]), (None, [1.0, 0.0]), (100, [1.0, 1.0, 1.0])]
    docs = spark.createDataFrame([*rows, rows[1]], "vec_id bigint, embedding array<float>")
    got = answers(ann.nearest(docs, ann.F.col("vec_id") % 50 == 0))
    assert {q: [v for _, v in a] for q, a in got.items()} == {0: [1, 50, 2], 50: [0, 1, 2]}
    assert ann.nearest(docs.limit(0), ann.F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_huge_and_tiny_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1.0, 1.0]), (3, [1e-300, 1e-300]), (4, [-1e300, -1e300])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), ann.F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert {got[0].vec_id, got[1].vec_id} == {2, 3} and [r.vec_id for r in got[2:]] == [1, 4]
    assert np.allclose([r.score for r in got], [1, 1, 0.5**0.5, -1])


def test_tied_neighbours_go_by_id(spark):
    """Vectors of one direction are classes of their own with one and the same cosine; the smaller ids are the answer, also across shards."""
    rows = [(0, [3.0, 0.0]), *((i, [float(i), 0.0]) for i in range(39, 0, -1)), *((i, [-1.0, float(i)]) for i in range(51, 90))]
    docs = spark.createDataFrame([*rows, (2, [2.0, 0.0])], "vec_id bigint, embedding array<double>")
    for shard_rows in (1 << 14, 20):
        got = ann.nearest(docs, ann.F.col("vec_id") % 50 == 0, shard_rows=shard_rows).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in range(1, 6)]


def test_neighbours_over_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 10)
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    docs = table(spark, "/root/testdata/sf0.1", "embeddings")
    assert recall(answers(ann.nearest(docs, ann.F.col("vec_id") % 50 == 0, shard_rows=500)), brute_neighbours(rows)) >= 0.9


def test_neighbour_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    assert recall(answers(ann.op9_ann_search(spark, sf_dir)), brute_neighbours(rows)) >= 0.9


def brute_components(rows, k, percent):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            t = sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return Counter((i, len(s), i if not s else least.get(find(a), i)) for a, (i, s) in enumerate(sets))


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(rng):
    """Copies, groups of edited copies, a passage that many share, short and odd texts."""
    rows = []
    new = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage = " ".join(new(60))
    for _ in range(6):
        base = new(rng.choice([12, 40, 150]))
        rows += [" ".join(base)] * rng.randint(1, 4)
        rows += [edited(rng, base, rng.randint(0, max(1, len(base) // 25))) for _ in range(rng.randint(1, 30))]
    rows += [" ".join(new(rng.randint(5, 90))) + " " + passage + " " + " ".join(new(rng.randint(5, 40))) for _ in range(60)]
    rows += [passage, passage + " x", "", None, "one", "One", "two words", "a b c d", "A b  c\td", "a b c d e", " \n "]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_components_match_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    for frequent, k, percent in ((24, 4, 85), (4, 5, 80), (3, 2, 60)):
        rows = corpus(rng)
        rows += [rows[5], (rows[6][0], rows[7][1]), (None, rows[8][1]), (None, "only here with no id")]
        docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id bigint, text string, node string")
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        monkeypatch.setattr(jaccard, "ROWS_A_PART", 500)
        monkeypatch.setattr(jaccard, "HOT_NODES", 3)
        monkeypatch.setattr(jaccard.frequent_shingles, "__defaults__", (frequent, *jaccard.frequent_shingles.__defaults__[1:]))
        assert result(jaccard.jaccard_components(docs, k, percent)) == brute_components_by_id(rows, k, percent)


def brute_components_by_id(rows, k, percent):
    """Components of rows; rows of one id count as linked through it only where a class is named by it."""
    return brute_components(rows, k, percent)


def test_components_of_nothing(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_connected_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.label for r in connected(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_pipeline_decides_by_id_and_text(spark, sf_dir):
    copy, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    item = table(spark, sf_dir, "benchmark").first().text
    rows = [(5, copy, "en", "s", 1), (None, copy, "en", "s", 1), (None, copy + " x", "en", "s", 1), (9, copy, "en", "s", 1), (9, other, "en", "s", 1), (9, other, "en", "a", 1), (None, None, "en", "s", 1), (7, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    got = {(r.doc_id, r.text, r.source) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert got == {(5, copy, "s"), (9, other, "a"), (None, None, "s"), (7, "", "s")}
    rows = [(None, f"Intro. {item}", "en", "s", 1), (3, item, "en", "s", 1), (3, other, "en", "s", 1), (None, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, docs.schema)
    assert {(r.doc_id, r.text) for r in corpus_pipeline.benchmark(spark, docs, sf_dir).collect()} == {(3, other), (None, None)}


def test_pipeline_of_nothing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_pipeline_stages(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 456", None, "s", 7)], documents.schema)
    docs = documents.unionByName(extra)
    docs = docs.unionByName(docs.limit(3))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], sf_dir).cache()
        if name != "pack":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        seen.append(out)
    counts = [d.count() for d in seen]
    assert counts[1] == counts[0] - 2 and counts[2] == counts[1]
    rows = [(r.doc_id, r.text) for r in seen[2].collect()]
    components = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in seen[3].collect()) == sorted({c for _, _, c in components})
    leaked = {r.doc_id for r in corpus_pipeline.decontaminate.find_leaks(seen[3], table(spark, sf_dir, "benchmark")).collect()}
    assert {r.doc_id for r in seen[4].collect()} == {r.doc_id for r in seen[3].collect()} - leaked
    assert {r.doc_id for r in seen[5].collect()} == {r.doc_id for r in seen[4].collect()}


def test_shingle_sets_of_batches():
    texts = ["", "a", None, "a b", "A b\x0bc d e", "é x y\x00 z w", "w" * 3000 + " " + "W" * 3000 + " b c d", " \n ", "eightlet eightletters nine", "a b c d e a b c d e"]
    brute = []
    for t in texts:
        w = (t or "").encode().lower().split()
        brute.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    names = {}
    for sets in (words.shingle_sets(texts, 4), [words.shingle_sets([t], 4)[0] for t in texts]):
        assert [len(s) for s in sets] == [len(b) for b in brute]
        assert all((np.diff(s.astype(float)) > 0).all() for s in sets)
        for s, b in zip(sets, brute, strict=True):
            assert names.setdefault(tuple(s.tolist()), b) == b
    assert len(names) == len({frozenset(b) for b in brute}) and words.shingle_sets([], 4) == []


def test_parts_come_one_by_one():
    cell = np.arange(3, dtype=np.uint64).tobytes()
    batches = [jaccard.pa.RecordBatch.from_pydict({"part": p, "keys": [cell] * len(p)}) for p in ([-2, -2, -1], [0, 0], [0, 3])]
    assert [(part, len(cells)) for part, cells in jaccard.by_part(iter(batches), [np.uint64])] == [(-2, 1), (-2, 1), (-1, 1), (0, 3), (3, 1)]
