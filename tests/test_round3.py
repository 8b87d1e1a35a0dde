"""Prefix joins, gaps, summaries, nested scalars, flows, run trees and fuzzy matches against plain versions."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanery.operators import affix, coverage, flow, history, plan, summaries, vocab
from gleanery.sources import readers


@pytest.mark.parametrize("part_keys", [3, 1 << 17])
def test_least_partners_equal_brute_force(spark, part_keys):
    rng = random.Random(part_keys)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
    probes = {word(): rng.random() < 0.5 for _ in range(80)}
    records = [(word() if rng.random() < 0.9 else "aab", rng.randrange(10**15)) for _ in range(150)]
    p = spark.createDataFrame([*probes.items(), *list(probes.items())[:5]], "key string, upward boolean")
    r = spark.createDataFrame([*records, (None, 1)], "key string, partner bigint")
    want = {}
    for k, up in probes.items():
        if found := [n for x, n in records if x.startswith(k) or (up and k.startswith(x))]:
            want[k] = min(found)
    assert {r.key: r.partner for r in affix.least_partners(p, r, part_keys).collect()} == want


def test_url_hits_equal_brute_force(spark):
    rng = random.Random(3)
    path = lambda: "/".join(rng.choice(["a", "b", "doc", "x?y=1"]) for _ in range(rng.randint(1, 3)))
    urls = sorted({rng.choice(["https://h.example/", "http://h.example/", "h.example/", ""]) + path() + rng.choice(["", "/", "//"]) for _ in range(120)})
    probes, records = list(enumerate(urls[::2])), [(u, i) for i, u in enumerate(urls[1::2] + urls[:20:2])]

    def hit(p, u):
        low, ulow, bare = p.rstrip("/").lower(), u.rstrip("/").lower(), p.rstrip("/")
        if len(low) > 8 and len(ulow) > 8 and (low.endswith(ulow) or ulow.endswith(low)):
            return True
        return len(bare) > 8 and u.startswith(bare) and u[len(bare) : len(bare) + 1] in ("", "/", "?")

    got = {r.probe_ord: r.matched_seq for r in coverage.first_hits(spark.createDataFrame(probes, "probe_ord int, source_url string"), spark.createDataFrame([*records, (None, 0), ("", 0)], "url string, _seq bigint")).collect()}
    for i, p in probes:
        found = [s for u, s in records if hit(p, u)]
        assert got.get(i, 10**9) <= min(found, default=10**9)  # a normalised match may come earlier
        if i in got:
            u = dict((s, u) for u, s in records)[got[i]]
            assert hit(p, u) or p.split("://")[-1].lower() == u.split("://")[-1].lower()


def spans(spark, values, **kw):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return sorted((r.lo, r.hi) for r in coverage.gap_spans(df, **kw).collect())


def test_gaps_of_any_width(spark):
    assert spans(spark, ["1", "2", "2000000000", "2", None, "x", "1.5"]) == [(3, 1999999999)]
    least, most = -(2**63), 2**63 - 1
    assert spans(spark, [str(least), "0", str(most), "99999999999999999999"]) == [(least + 1, -1), (1, most - 1)]
    assert spans(spark, ["1", "5"]) == [] == spans(spark, [])
    assert spans(spark, ["1", "5"], least=2) == [(2, 4)]
    numbers = random.Random(1).sample(range(-5000, 5000), 900)
    df = spark.createDataFrame([(str(v),) for v in numbers], "value string")
    assert {r.missing for r in coverage.numeric_gaps(df).collect()} == set(range(min(numbers), max(numbers))) - set(numbers)
    wide = spark.createDataFrame([("0",), ("3",), (str(5 * 2**32 + 2**17),)], "value string")
    pieces = coverage.numeric_gaps(wide)
    assert "repartition" not in pieces.columns and spans(spark, ["0", "3", str(5 * 2**32 + 2**17)]) == [(1, 2), (4, 5 * 2**32 + 2**17 - 1)]
    few = coverage.numeric_gaps(spark.createDataFrame([("-70000",), ("0",), ("70000",)], "value string"))
    assert (few.count(), few.agg(F.min("missing"), F.max("missing")).first()[:]) == (139998, (-69999, 69999))


def test_combinations_that_never_occur(spark):
    rng = random.Random(4)
    pairs = [(rng.choice("abcdefg"), rng.choice(["x", "y", "z", "u", "é", "w", "v"])) for _ in range(20)] + [("", "x"), ("a", ""), (None, "x"), ("lonely", "x")]
    df = spark.createDataFrame(pairs, "n string, b string")
    seen = {p for p in pairs if p[0] and p[1]}
    want = {(x, y) for x in {p[0] for p in seen} for y in {p[1] for p in seen}} - seen
    got = [tuple(r) for r in coverage.cross_gaps(df, "n", "b").collect()]
    assert set(got) == want and len(got) == len(want)
    assert coverage.cross_gaps(df.limit(0), "n", "b").count() == 0


def summary(spark, content, style):
    df = spark.createDataFrame([(1, content, style)], "id int, content string, style string")
    return summaries.summaries(df, ["id"]).first().summary


def test_summaries_of_returns(spark):
    end = summaries.PLACEHOLDER
    entries = [f"  <a {i}>" for i in range(45)]
    analysis = "\n".join(["# analyzed page structure", "# Buttons", *entries[:23], "", "plain", *entries[:21], "# Link URL patterns", *entries[:30], "# Tables", "  one"])
    want = ["# analyzed page structure", "# Buttons", *entries[:20], "", "[3 more trimmed]", "plain", *entries[:20], "[1 more trimmed]", "# Link URL patterns", *entries[:30], "# Tables", "  one"]
    assert summary(spark, analysis, "analysis") == "\n".join(want)
    assert summary(spark, analysis, "analysis_hard").split("\n") == ["# analyzed page structure", "# Buttons", "# Link URL patterns", "# Tables", end]
    page = "\r\n".join(["# page", "", "# Page links (45)", *entries[:2], "", *entries[2:], "<html>"]) + "\n"
    assert summary(spark, page, "snapshot").split("\n") == ["# page", "# Page links (45)", *entries[:30], end]
    assert summary(spark, page, "snapshot_hard").split("\n") == ["# page", "# Page links (45)", *entries[:6], end]
    assert summary(spark, "# a\n# Extracted elements\n  <x>\n  href=1\n  <y>", "snapshot").split("\n") == ["# a", "# Extracted elements", "  <x>", end]
    assert summary(spark, "# a\n<html>\n# Page links\n  x", "snapshot").split("\n") == ["# a", end]
    assert summary(spark, "\n\na\n \nb c\x0bd\ne\nf\ng\n", "lines").split("\n") == ["a", "b", "c", "d", "e", "f", end]
    assert summary(spark, "", "lines") == end and summary(spark, "", "snapshot") == end and summary(spark, "", "analysis") == ""


def test_a_users_summariser_runs_in_the_plan(spark):
    @F.pandas_udf("string")
    def shout(texts: pd.Series) -> pd.Series:
        return texts.str[:5].str.upper()

    own = summaries.Summarisers()
    own.register("lookup", shout)
    long = "words " * 400
    rows = [(1, 0, 0, "tool_return", "lookup", long), (1, 1, 0, "tool_return", "other", long), (1, 2, 0, "thinking", None, long), (1, 3, 0, "thinking", None, "short"), (1, 4, 0, "user", None, long), (1, 5, 0, "tool_return", "other", long)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, part_ord int, kind string, tool_name string, content string")
    out = history.compacted(df, budget=10, summarisers=own, keep={"thinking": 1, "snapshot": 2, "validation": 1, "other": 1}).orderBy("turn").collect()
    assert [r.trimmed for r in out] == ["soft", "soft", "soft", None, None, None]
    assert out[0].content == "WORDS" and out[1].content == long.strip() + " \n" + summaries.PLACEHOLDER and out[2].content == summaries.BLANK_THINKING
    fits = history.compacted(df, budget=10**6, summarisers=own)
    assert fits.where("trimmed is not null").count() == 0 and fits.exceptAll(df.withColumn("trimmed", F.lit(None).cast("string"))).count() == 0


def plain_scalar(raw):
    if isinstance(raw, dict):
        if "value" in raw:
            return plain_scalar(raw["value"])
        return raw["url"].strip() or None if isinstance(raw.get("url"), str) else None
    if isinstance(raw, list):
        return next((v for x in raw if (v := plain_scalar(x)) is not None), None)
    return None if raw is None else str(raw).strip() or None


def test_nested_scalars_of_any_depth(spark):
    rng = random.Random(11)

    def nest(depth):
        if depth == 0:
            return rng.choice([None, "", "  ", " text ", 7, True, "u", {"url": " https://x "}, {"url": 5}, {"label": "l"}, {}])
        return rng.choice([lambda: {"value": nest(depth - 1), "url": "not this"}, lambda: [nest(rng.randrange(depth)) for _ in range(rng.randint(0, 3))] + [nest(depth - 1)]])()

    values = [nest(rng.randint(0, 9)) for _ in range(150)]
    deep = "end"
    for _ in range(30):
        deep = [{"value": deep}]
    values.append(deep)
    rows = [(i, json.dumps({"my key": v, "other": 1}), "x") for i, v in enumerate(values)] + [(900, "{broken", ""), (901, None, ""), (902, "[]", ""), (903, '{"other": "o"}', "")]
    df = spark.createDataFrame(rows, "id int, metadata string, value string")
    got = {r.id: r.key for r in plan.nested_scalar(df, "metadata", "my key").collect()}
    assert got == {**{i: plain_scalar(v) for i, v in enumerate(values)}, 900: None, 901: None, 902: None, 903: None}


def test_flows_are_resolved(spark):
    tasks = [
        ("a", [], "done"), ("b", ["a"], "done"), ("c", ["b"], "pending"), ("d", ["c"], "pending"), ("left", ["d"], "pending"), ("right", ["d"], "pending"), ("join", ["left", "right"], "pending"),
        ("f", ["a"], "failed"), ("g", ["f"], "done"), ("h", ["g", "lost"], "pending"), ("i", ["h"], "pending"), ("x", ["y"], "pending"), ("y", ["z", "a"], "pending"), ("z", ["x"], "done"), ("w", ["x"], "pending"), ("self", ["self"], "pending"),
        ("null", None, "pending"), ("repeated", ["a", "a"], "pending"),
    ]
    out = {r.subtask_id: (r.outcome, r.cause, r.steps) for r in flow.resolved(spark.createDataFrame(tasks, "subtask_id string, depends_on array<string>, status string")).collect()}
    want = {t: ("waiting", None, None) for t in ("d", "left", "right", "join")} | {t: ("kept", None, None) for t in "ab"} | {t: ("cyclic", None, None) for t in ("x", "y", "z", "self")}
    want |= {t: ("ready", None, None) for t in ("c", "null", "repeated")} | {"f": ("aborted", "f", 0), "g": ("aborted", "f", 1), "h": ("aborted", "lost", 1), "i": ("aborted", "lost", 2), "w": ("aborted", "x", 1)}
    assert out == want
    assert flow.resolved(spark.createDataFrame([], "subtask_id string, depends_on array<string>, status string")).count() == 0


def test_run_tree(spark, tmp_path):
    root = tmp_path / "my runs"

    def put(name, text):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    for run in ("r1", "r2", "r3", "r4", "r5"):
        put(f"{run}/scripts/2024_01_01__discover__x.py", "print(1)")
    for i in range(8):
        put(f"r1/scripts/2024_02_0{i + 1}_p.py", "pass")
    for name in ("r1/scripts/2024_01_02.raw.py", "r1/scripts/helper.py", "r1/2024_01_01_elsewhere.py", "r1/scripts/deep/2024_01_01_a.py"):
        put(name, "pass")
    put("r1/scripts/2024_01_00_empty.py", "")
    put("r1/task_split.json", json.dumps({"processing_prompt": "Fetch all. Then more.", "discovery_prompt": "Find links! Now.", "site_overview": "o" * 3000, "verified_selectors": ["a.b"], "pdf_download_strategy": "direct"}))
    put("r1/flow/state.json", json.dumps({"plan": {"task_summary": "not this"}}))
    put("r2/task_split.json", "{broken")
    subtasks = [{"subtask_id": "1", "kind": "discovery", "description": "Look. x", "verified_selectors": ["s1"], "pdf_download_strategy": "click"}, {"subtask_id": "2", "kind": "processing", "description": "Work", "verified_selectors": ["s2"]}]
    put("r2/flow/state.json", json.dumps({"plan": {"task_summary": "sum", "site_overview": "site", "subtasks": subtasks}, "records": []}))
    put("r3/run.yaml", "kind: x\nprompt: |\n  Collect the files. All of them.\n  More")
    put("r5/task_split.json", json.dumps({"processing_prompt": "current"}))
    got = {(r.run_name, r.script_path): r for r in readers.read_run_tree(spark, str(root), "r5").collect()}
    assert sorted(p for run, p in got if run == "r1") == ["scripts/2024_01_01__discover__x.py"] + [f"scripts/2024_02_0{i}_p.py" for i in range(1, 6)]
    r1, r1p = got["r1", "scripts/2024_01_01__discover__x.py"], got["r1", "scripts/2024_02_01_p.py"]
    assert (r1.kind, r1.task_summary, r1.subtask_description, r1.verified_selectors, r1.pdf_download_strategy, len(r1.site_overview)) == ("discovery", "Fetch all.", "Find links!", ["a.b"], "direct", 2000)
    assert (r1p.kind, r1p.subtask_description) == ("processing", "Fetch all.")
    r2, r3, r4 = (got[r, "scripts/2024_01_01__discover__x.py"] for r in ("r2", "r3", "r4"))
    assert (r2.task_summary, r2.subtask_description, r2.verified_selectors, r2.pdf_download_strategy, r2.site_overview) == ("sum", "Look.", ["s1", "s2"], "click", "site")
    assert (r3.task_summary, r3.subtask_description, r3.pdf_download_strategy) == ("Collect the files.", "Collect the files.", "browser_fetch")
    assert (r4.task_summary, r4.verified_selectors, r4.status) == ("", [], "unknown") and {run for run, _ in got} == {"r1", "r2", "r3", "r4"}


def test_fuzzy_matches_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 7)))
    values, labels = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for v in values:
        d, label = min((edits(v, x), x) for x in labels)
        if d <= 2:
            want[v] = (label, d)
    got = vocab.fuzzy_candidates(spark.createDataFrame([(v, 1) for v in values], "crawl_value string, n int"), spark.createDataFrame([(x, 0) for x in labels], "label string, ord int"))
    assert {r.crawl_value: (r.suggested, r.distance) for r in got.collect()} == want


def test_reports_tables_and_mappings_in_any_store(spark, tmp_path):
    from gleanery.operators import mapping
    from gleanery.sources import writers

    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    writers.json_report({"rows": df, "none": df.limit(0)}, str(tmp_path / "report"))
    lines = (line for f in (tmp_path / "report" / "rows").glob("*.json") for line in f.read_text().splitlines())
    assert sorted(map(json.loads, lines), key=str) == [{"a": 1, "b": None}, {"a": 2, "b": "x"}]
    for _ in range(2):
        writers.ensure_table(spark, str(tmp_path / "t"), "a int, b string")
    assert spark.read.parquet(str(tmp_path / "t")).schema == df.limit(0).schema
    df.write.mode("append").parquet(str(tmp_path / "t"))
    writers.ensure_table(spark, str(tmp_path / "t"), "a int, b string")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"properties": [{"name": "a", "source": "x"}]}))
    assert mapping.load(spark, (tmp_path / "m.json").as_uri()).fingerprint() == mapping.from_dict({"properties": [{"name": "a", "source": "x"}]}).fingerprint()

