"""Streams against the batch operators: links in any order, the compacted table through crashes."""

import random

import pytest

from gleanery.operators import store
from gleanery.sources import readers
from gleanery.streaming import links, upserts

EVENTS = "url string, op string, filter_label string, _seq bigint"
ROWS = "source_url string, data string, _seq bigint"


def random_events(rng, urls, n):
    seqs = rng.sample(range(1000), n)
    ops = ["sample", "discovered", "discovered", "processed"]
    return [(f"u{rng.randrange(urls)}", op := rng.choice(ops), None if op == "processed" else rng.choice(["a", "b", None]), s) for s in seqs]


def streamed(spark, tmp_path, batches, name, lateness=None):
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    query = links.fold_link_stream(events, lateness).writeStream.outputMode("update").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return {r.url: (r.status, r.filter_label) for r in store.last_wins(spark.table(name), "url").collect()}


def folded(spark, events):
    return {r.url: (r.status, r.filter_label) for r in store.fold_links(spark.createDataFrame(events, EVENTS)).collect()}


def test_link_stream_in_any_order_equals_the_batch_fold(spark, tmp_path):
    rng = random.Random(7)
    events = random_events(rng, 25, 160)
    dealt = rng.sample(events, len(events))
    batches = [dealt[:3], dealt[3:70], dealt[70:90], dealt[90:]]
    assert streamed(spark, tmp_path, batches, "links_any_order") == folded(spark, events)


def test_late_events_are_ignored_beyond_the_lateness(spark, tmp_path):
    batches = [[("u", "discovered", "a", 100), ("v", "discovered", "a", 100)], [("u", "discovered", "b", 120), ("v", "discovered", "b", 150)], [("u", "processed", None, 110), ("v", "processed", None, 110)]]
    assert streamed(spark, tmp_path, batches, "links_late", 30) == {"u": ("processed", "a"), "v": ("discovered", "b")}


def plain_fold(events):
    status, label = None, None
    for _, op, new in events:
        status, label = links.advance(status, label, op, new)
    return status, label


@pytest.mark.parametrize("seed", range(30))
def test_events_taken_off_never_matter(seed):
    """Whatever is dropped as idle, after every arrival, the rest replays to what all events replay to."""
    rng = random.Random(seed)
    arriving = [(s, rng.choice(["sample", "discovered", "processed"]), rng.choice("abc")) for s in rng.sample(range(40), 14)]
    kept, seen = [], []
    for e in arriving:
        kept, seen = sorted([*kept, e]), sorted([*seen, e])
        gone = links.idle(kept)
        kept = [x for x in kept if x not in gone]
        assert plain_fold(kept) == plain_fold(seen)


def table(spark, path):
    return {r.source_url: r.data for r in upserts.latest(spark, path, ROWS).collect()}


def test_upserts_are_compacted_and_survive_a_crash(spark, tmp_path, monkeypatch):
    path, want = str(tmp_path / "table"), {}

    def delta(epoch, rows):
        upserts.write_delta(spark.createDataFrame(rows, ROWS), epoch, path)
        want.update({u: d for u, d, _ in sorted(rows, key=lambda r: r[2])})

    assert table(spark, path) == {}
    upserts.compact(spark, path, ROWS, 4)  # nothing to fold
    delta(0, [(f"k{i}", f"v{i}", i) for i in range(50)])
    delta(1, [("k1", "new", 100), ("k1", "older", 99), ("x", "y", 101)])
    want["k1"] = "new"
    assert table(spark, path) == want
    upserts.compact(spark, path, ROWS, 4)
    base = upserts.manifest(spark, path)[0]
    assert table(spark, path) == want and base == "base-1"
    for bucket in (tmp_path / "table" / base).glob("bucket=*"):
        assert len(list(bucket.glob("*.parquet"))) == 1
    delta(2, [("k2", "two", 200)])
    whole = readers.read_or_empty
    with monkeypatch.context() as m:  # dies before the base is named
        m.setattr(upserts, "read_or_empty", whole)
        spark_range = type(spark).range
        m.setattr(type(spark), "range", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            upserts.compact(spark, path, ROWS, 4)
    assert type(spark).range is spark_range
    assert table(spark, path) == want and upserts.manifest(spark, path)[3] == 1
    upserts.compact(spark, path, ROWS, 8)
    assert table(spark, path) == want and upserts.manifest(spark, path)[1:] == (8, 2, 2)
    delta(2, [("k2", "two", 200)])  # an epoch tried again after it was folded
    assert table(spark, path) == want


def test_upsert_stream(spark, tmp_path):
    want = {}
    for n in range(5):
        rows = [("a", f"v{n}", n), (f"b{n % 2}", f"x{n}", 10 + n)]
        want.update({u: d for u, d, _ in rows})
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = upserts.upsert_stream(rows, str(tmp_path / "out"), str(tmp_path / "cp"), buckets=3, every=2)
    query.processAllAvailable()
    query.stop()
    assert table(spark, str(tmp_path / "out")) == want
    assert upserts.manifest(spark, str(tmp_path / "out"))[2] == 3
