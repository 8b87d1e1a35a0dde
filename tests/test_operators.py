"""Operators on small golden cases."""

import pytest
from pyspark.sql import functions as F

from gleanery.operators import catalog, coverage, flow, history, html, lint, mapping, plan, reconcile, sqlgate, store, vocab
from gleanery.sources import readers, writers

LINK_CASES = [
    (["discovered A", "discovered B"], ("discovered", "B")),
    (["discovered A", "processed", "discovered B"], ("processed", "A")),
    (["sample s", "discovered A"], ("discovered", "A")),
    (["discovered A", "sample s"], ("discovered", "A")),
    (["processed"], None),
    (["sample s"], ("sample", "s")),
    (["processed", "sample s", "processed", "sample t"], ("processed", "s")),
]


def link_events():
    rows = []
    for i, (events, _) in enumerate(LINK_CASES):
        for j, e in enumerate(events):
            op, _, label = e.partition(" ")
            rows.append((f"u{i}", op, label or None, j * 10 + i))
    return rows


def test_link_fold(spark):
    df = spark.createDataFrame(link_events(), "url string, op string, filter_label string, _seq bigint")
    got = {r.url: (r.status, r.filter_label) for r in store.fold_links(df).collect()}
    assert got == {f"u{i}": want for i, (_, want) in enumerate(LINK_CASES) if want}


def test_upsert_and_handled_keys(spark):
    rows = [("HTTP://H/a", "1", 1), ("https://h/a", "2", 2), ("https://h/b/pdf/pdf_1/pdf/x", "3", 3)]
    df = spark.createDataFrame(rows, "source_url string, data string, _seq bigint")
    got = store.upsert_records(df)
    assert {r.source_url: r.data for r in got.collect()} == {"https://h/a": "2", "https://h/b/pdf/pdf_1/pdf/x": "3"}
    keys = got.where("_seq = 3").select(store.handled_keys(F.col("source_url")).alias("k")).first().k
    assert keys == ["https://h/b/pdf/pdf_1/pdf/x", "https://h/b", "https://h/b/pdf/pdf_1"]


def test_integrity_of_bytes(spark):
    pdf = b"%PDF-1.4" + b"x" * 2000 + b"%%EOF"
    files = [("a.pdf", pdf), ("b.pdf", b"%PDF" + b"%%EOF"), ("c.pdf", b"%PDF no end"), ("d.doc", b"x" * 2000), ("e.doc", b""), ("f.pdf", b"%PDF" + b"%%EOF" + b"x" * 3000), ("g.pdf", (b"%PDF" + b"x" * 1015 + b"%%EOF"))]
    df = spark.createDataFrame([(n, len(c), c) for n, c in files], "basename string, length bigint, content binary")
    got = {r.basename: (r.is_valid, r.is_small) for r in reconcile.checked_files(df).collect()}
    assert got == {"a.pdf": (True, False), "b.pdf": (True, True), "c.pdf": (False, False), "d.doc": (True, False), "e.doc": (False, False), "f.pdf": (False, False), "g.pdf": (True, True)}
    ole = spark.createDataFrame([(bytes.fromhex("d0cf11e0a1"),), (b"PK\x03\x04",), (b"none",)], "c binary")
    assert [r.x for r in ole.select(reconcile.is_office_bytes(F.col("c")).alias("x")).collect()] == [True, True, False]


def test_catalog_lists_and_types(spark):
    rows = [(1, '{"d": "2024-01-01", "t": ["x", "y", ""], "n": "1,000"}'), (2, '{"d": "2024/1", "t": ["y"], "n": "2", "b": true}'), (3, "[1]"), (4, None)]
    df = spark.createDataFrame(rows, "_seq bigint, data string")
    assert {r.field: r.n for r in catalog.field_coverage(df).collect()} == {"d": 2, "t": 2, "n": 2, "b": 1}
    samples = catalog.first_samples(df, 2)
    assert [(r.field, r.value) for r in samples.orderBy("field", "rank").collect() if r.field == "t"] == [("t", "x"), ("t", "y")]
    assert {r.field: r.value_type for r in catalog.value_types(samples).collect()} == {"d": "date", "t": "string", "n": "numeric", "b": "string"}
    assert {(r.field, r.value): r.n for r in catalog.value_histogram(df).collect()}[("t", "y")] == 2


def test_discovery_log_and_gate(spark):
    lines = ["DISCOVERY target=a found=3 saved=2", "noise", "DISCOVERY target=a found=4 saved=9", "DISCOVERY target=b found=0 saved=0"]
    log = coverage.discovery_lines(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"))
    assert {r.label: (r.found, r.saved) for r in log.collect()} == {"a": (4, 9), "b": (0, 0)}
    assert {r.label: r.failure for r in coverage.self_check(log).collect()} == {"a": "saved_above_found", "b": "found_below_minimum"}


def test_vocabulary_tree_and_fuzzy(spark):
    nodes = [("t", "1", None, "A", 1), ("t", "2", "1", "B", 2), ("t", "3", "1", "C", 1), ("t", "4", "3", "D", 1), ("t", "5", None, "E", 0)]
    df = spark.createDataFrame(nodes, "thesaurus_id string, node_id string, parent_id string, label string, ord int")
    paths = vocab.tree_paths(df)
    assert [r.label for r in paths.orderBy("path").collect()] == ["E", "A", "C", "D", "B"]
    assert {r.label: r.parent_label for r in vocab.parent_labels(paths).collect()} == {"B": "A", "C": "A", "D": "C"}
    assert vocab.first_leaf(paths).first().label == "E"
    values = spark.createDataFrame([("Spian", 1), ("xyz", 1)], "crawl_value string, n bigint")
    labels = spark.createDataFrame([("Spain", 1), ("Sweden", 2)], "label string, ord int")
    assert [(r.crawl_value, r.suggested) for r in vocab.fuzzy_candidates(values, labels).collect()] == [("Spian", "Spain")]


def test_mapping_is_validated():
    with pytest.raises(ValueError):
        mapping.Mapping(properties=(), registry_template="x")
    with pytest.raises(TypeError):
        mapping.from_dict({"properties": [], "unknown": 1})
    m = mapping.from_dict({"properties": [{"name": "a", "source": "x"}]})
    assert m.fingerprint() == mapping.from_dict({"properties": [{"source": "x", "name": "a"}]}).fingerprint()
    assert mapping.field_type("multi_thing") == "multiselect" and mapping.field_type("other") == "text"


def test_mapping_lists_and_relationships(spark):
    m = mapping.Mapping(properties=(mapping.Property("s", "multiselect", source="tags"), mapping.Property("r", "relationship", source="rel"), mapping.Property("d", "select", default_value="one")))
    df = spark.createDataFrame([('{"tags": ["a", "zz"], "rel": ["T1", "T9"]}',), ("{}",)], "data string")
    from gleanery.functions.values import decode_object

    lookup = F.create_map(F.lit("a"), F.lit("Alpha"))
    ids = F.create_map(F.lit("T1"), F.lit("id1"))
    rows = mapping.project(df, m, decode_object(F.col("data")), {"s": lookup}, ids=ids).collect()
    assert rows[0].metadata == {"s": '[{"value":"Alpha"}]', "r": '[{"value":"id1"},{"value":"T9"}]', "d": '[{"value":"one"}]'}
    assert rows[1].metadata == {"d": '[{"value":"one"}]'}


def test_plan_helpers(spark):
    df = spark.createDataFrame([("m",)], "m string")
    files = df.limit(1).select(plan.attachments(F.lit("a.pdf"), F.lit(""), F.lit("noext")).alias("x")).first().x
    assert [(f.filename, f.kind) for f in files] == [("a.pdf", "PDF"), ("noext", "BIN")]


PAGE = """<html><head><title>Just a moment...</title><style>x</style></head><body><!-- c --><div class="item" id="i1"><h3><a href="/doc/1?s=1">One  <b>x</b></a></h3>
<span class="date">2024-01-02</span><p></p></div><div class="item"><h3><a href="/doc/1?s=1">Again</a></h3></div><a href="#">f</a><a href="mailto:x@y">m</a><a href="b.pdf">B</a><a href="c.pdf">C</a>
<table><tr><th>H</th></tr><tr><td>1</td></tr></table><input name="q"><script>var a = "<a href='no'>";</script></body></html>"""


def test_html_extraction(spark):
    pages = spark.createDataFrame([(1, "https://h/x/", PAGE), (2, "https://h/", None), (3, "https://h/", "")], "page_id bigint, url string, html string")
    fields = html.extract_fields(pages, [{"field": "d", "selector": ".item > span.date"}, {"field": "h", "selector": "div#i1 a[href*='doc']", "source": "href"}, {"field": "all", "selector": "h3 a, td", "source": "list_text"}])
    got = {r.page_id: r for r in fields.collect()}
    assert got[1].fields == {"d": "2024-01-02", "h": "/doc/1?s=1"} and got[1].lists == {"all": ["One x", "Again", "1"]}
    assert got[2].fields == {"d": "", "h": ""}
    rows = html.extract_rows(pages, "div.item", [{"field": "t", "selector": "a"}, {"field": "d", "selector": ".date"}], include_html=True).orderBy("pos").collect()
    assert [(r.cells["t"], r.cells["d"]) for r in rows] == [("One x", "2024-01-02"), ("Again", "")]
    assert rows[1].cells["core_source_html"].startswith('<div class="item"><h3>')
    links = html.anchors(pages).orderBy("pos").collect()
    assert [(r.href, r.text) for r in links] == [("https://h/doc/1?s=1", "Onex"), ("https://h/x/b.pdf", "B"), ("https://h/x/c.pdf", "C")]
    assert {(r.key, r.n) for r in html.link_patterns(html.anchors(pages)).collect()} == {("ext:.pdf", 2), ("path:h/x/", 2)}
    assert [r.n for r in html.limited_anchors(pages, 2).groupBy("page_id").agg(F.count("*").alias("n")).collect()] == [2]
    cleaned = {r.page_id: r.cleaned for r in html.clean_html(pages).collect()}
    assert "<p>" not in cleaned[1] and "script" not in cleaned[1] and 'class="item"' in cleaned[1] and cleaned[3] == ""
    shape = html.page_structure(pages).where("page_id = 1").first()
    assert [len(shape[k]) for k in html.CAPS] == [6, 0, 1, 2, 1] and shape.tables[0].extra["rows"] == "2" and shape.inputs[0].selector == "input[name=q]"
    found = pages.where("page_id = 1").select(html.challenge(F.col("url"), html.page_title(F.col("html")), F.col("html")).alias("c")).first().c
    assert (found.kind, found.confidence) == ("cloudflare_iuam", 0.95)
    with pytest.raises(ValueError):
        html.Selector("a:hover")


def test_links_as_real_pages_spell_them(spark):
    page = """<!-- <a href="/comment">c</a> --><script>var x = '<a href="/script">s</a>';</script>
      <a href="x?a=1&amp;b=2">A &amp; <b> B </b></a><a href='y.html'>Y</a><a href=z.html>Z</a><A HREF="y.html">again</A>
      <a>none</a><a href="#t">t</a><a href=" mailto:a@b.c">m</a><a href="http://[bad">w</a><a href="ü v">U</a>"""
    pages = spark.createDataFrame([(1, "https://h.example/d/", page, "k"), (2, None, None, "k"), (3, "https://h.example", "<div>" * 3000 + "<a href=deep>d</a>", "k")], "page_id bigint, url string, html string, pos string")
    got = {(r.page_id, r.pos, r.href, r.text) for r in html.anchors(pages).collect()}
    at = "https://h.example/d/"
    assert got == {(1, 0, at + "x?a=1&b=2", "A &B"), (1, 1, at + "y.html", "Y"), (1, 2, at + "z.html", "Z"), (1, 7, at + "ü v", "U"), (3, 0, "https://h.example/deep", "d")}


def test_deep_pages(spark):
    deep = "<body>" + "<div class='c'>" * 3000 + "x<p></p>" + "</div>" * 3000
    pages = spark.createDataFrame([(1, deep)], "page_id bigint, html string")
    cleaned = html.clean_html(pages).first().cleaned
    assert cleaned.count('<div class="c">') == 3000 == cleaned.count("</div>") and "<p>" not in cleaned
    assert html.extract_rows(pages, "body > div", [{"field": "x", "selector": "p"}], include_html=True).first().cells["core_source_html"].startswith("<div")
    assert html.page_structure(pages).count() == 1


def test_selector_probe(spark):
    pages = spark.createDataFrame([("<div id='m'><p class='ad x' data-k='v'>t</p></div>",)], "h string")
    cases = {"div p.ad": True, "p.ad.y": False, "#m": True, "#n, p": True, "a[href]": False, "p[data-k='v']": True, "p[data-k='w']": False, "*": True}
    assert [pages.select(html.selector_probe(F.col("h"), c).alias("x")).first().x for c in cases] == list(cases.values())


def test_truncation_at_tags(spark):
    df = spark.createDataFrame([("<a>bc</a><b>", ), ("ab<cdefghijkl",), ("abcdefghijklmnop",), ("<a>",)], "h string")
    assert [r.x for r in df.select(html.truncate_at_tag(F.col("h"), 10).alias("x")).collect()] == ["<a>bc</a>", "ab", "abcdefghij", "<a>"]


def test_snapshots_and_logs(spark):
    cards = spark.createDataFrame([("p", 1, 0, "a"), ("p", 1, 1, "b"), ("p", 2, 0, "b"), ("p", 2, 1, "c")], "page string, snap int, pos int, card string")
    assert [(r.snap, r.card) for r in html.consolidate_snapshots(cards).orderBy("snap", "pos").collect()] == [(1, "a"), (2, "b"), (2, "c")]
    log = spark.createDataFrame([("k", i, h) for i, h in enumerate([True, True, False, True, True, True, False])], "k string, i int, hit boolean")
    assert flow.longest_streak(log, "k", "i", "hit").first().longest == 3


def test_history_details(spark):
    rows = [(1, 0, 0, "user", None, "x" * 40), (1, 1, 0, "tool_call", "find", "y" * 9), (1, 2, 0, "response_text", None, "z" * 99)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, part_ord int, kind string, tool_name string, content string")
    assert history.conversation_tokens(df).first().tokens == 10 + 1 + 2
    assert [r.turn for r in history.overflow_tail(df.where("turn < 2")).collect()] == [0]


def test_sql_gate(spark):
    spark.range(300).createOrReplaceTempView("gate_numbers")
    gate = sqlgate.Gate(spark, budget=2)
    for bad in ("WITH x AS (SELECT 1) SELECT * FROM x", "SELECT 1; SELECT 2", "DROP TABLE x", "SELECT nope FROM gate_numbers"):
        assert gate.ask(bad).startswith("error")
    assert gate.ask("select id from gate_numbers;").endswith("201 rows (more rows were cut)")
    assert "1 rows" in gate.ask(" SELECT count(*) FROM gate_numbers")
    assert "budget" in gate.ask("SELECT 1")


def test_lint_rules(spark):
    code = "import requests\nasync def worker():\n    await save_record('u', {})\n"
    df = spark.createDataFrame([("s", "processing", code), ("d", "discovery", "save_discovered_link('x')")], "name string, kind string, code string")
    assert [(r.name, r.rule, r.line) for r in lint.lint(df).orderBy("rule").collect()] == [("s", "11", 3), ("s", "15i", 2), ("s", "8", 1)]
    out = spark.createDataFrame([("a\nKeyError: x\nb",)], "o string")
    assert tuple(out.select(lint.error_line(F.col("o")), lint.diagnosis(F.col("o"))).first()) == ("KeyError: x", "a key is missing")


def test_readers_and_writers(spark, tmp_path):
    assert readers.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.pdf").write_bytes(b"abc")
    assert [(r.basename, r.length) for r in readers.list_files(spark, str(tmp_path / "files")).collect()] == [("a.pdf", 3)]
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_json_log(spark, str(tmp_path / "log.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "1.yaml").write_text("property_name: country\nmapping:\n  es: Spain\n  'fr': \"France\"\n  de: null\n")
    (tmp_path / "v" / "2.yaml").write_text("property_name: country\nmapping:\n  es: España\nother: x\n")
    (tmp_path / "v" / "3.yaml").write_text("nothing here")
    got = vocab.last_file_wins(readers.read_vocabulary_files(spark, str(tmp_path / "v")))
    assert {r.crawl_value: r.canonical_value for r in got.collect()} == {"es": "España", "fr": "France", "de": None}
    log = spark.createDataFrame([("http://h/a", "1", 1), ("https://h/a", "2", 2)], "source_url string, data string, _seq bigint")
    log.write.parquet(str(tmp_path / "records"))
    writers.compact_records(spark, str(tmp_path / "records"), str(tmp_path / "compact"), "source_url string, data string, _seq bigint")
    assert [r.data for r in spark.read.parquet(str(tmp_path / "compact")).collect()] == ["2"]
    report = writers.markdown_report("R", {"rows": log.select("data").orderBy("data")})
    assert "| data |" in report and "| 2 |" in report


def test_paged_entities(spark):
    def fetch(language, start, size, wanted):
        rows = [("t", f"{language}{i}", "{}") for i in range(7)]
        return rows[start : start + size]

    readers.register_entities(spark, "paged_entities_test", fetch, ["en", "fr"], 3)
    df = spark.read.format("paged_entities_test").load()
    assert df.groupBy("language").count().orderBy("language").collect() == [("en", 7), ("fr", 7)]


def test_trees_of_any_depth_and_cycles(spark):
    schema = "thesaurus_id string, node_id string, parent_id string, label string, ord int"
    chain = [("t", str(i), str(i - 1) if i else None, f"L{i}", 0) for i in range(40)] + [("t", "r", None, "R", 1), ("t", "lost", "nobody", "x", 0)]
    paths = vocab.tree_paths(spark.createDataFrame(chain, schema))
    got = {r.label: (r.depth, r.position) for r in vocab.numbered(paths).collect()}
    assert got == {**{f"L{i}": (i + 1, i + 1) for i in range(40)}, "R": (1, 41)}
    assert vocab.find_label(paths, "L7").first().node_id == "7"
    assert {r.leaf for r in vocab.first_leaves(paths).collect()} == {"L39", "R"}
    twice = [("t", "a", None, "A", 0), ("t", "b", "a", "B", 0), ("t", "a", "b", "A", 0)]
    with pytest.raises(ValueError):
        vocab.tree_paths(spark.createDataFrame(twice, schema))


def test_default_filling(spark):
    nodes = [("v", "1", None, "Europe", 0), ("v", "2", "1", "Spain", 1), ("v", "3", "1", "France", 0), ("v", "4", None, "Other", 1)]
    paths = vocab.tree_paths(spark.createDataFrame(nodes, "thesaurus_id string, node_id string, parent_id string, label string, ord int"))
    props = [("name", "title", True, None), ("a", "select", True, "v"), ("b", "select", False, "v"), ("c", "multiselect", True, "v"), ("d", "text", True, None), ("e", "select", True, "v")]
    mapped = spark.createDataFrame([("c", None, "Europe", ""), ("e", "x", "Spain", "kept"), ("d", None, "Europe", None)], "name string, source string, default_value string, notes string")
    out = mapping.fill_defaults(mapped, spark.createDataFrame(props, "name string, type string, required boolean, thesaurus_id string"), paths)
    missing = "no scraped field for this property"
    assert {(r.name, r.source, r.default_value, r.notes) for r in out.collect()} == {
        ("a", None, "France", missing), ("b", None, None, missing), ("c", None, "France", "default moved from group Europe to leaf France"), ("d", None, "Europe", None), ("e", "x", "Spain", "kept"),
    }


def test_run_check_without_a_total(spark):
    lines = spark.createDataFrame([(0, "DISCOVERY target=a found=0 saved=0")], "line_no int, line string")
    none, one = spark.createDataFrame([], "url string"), spark.createDataFrame([("u",)], "url string")
    assert [(r.label, r.failure) for r in coverage.run_check(lines, one).collect()] == [(None, "total_missing")]
    more = lines.union(spark.createDataFrame([(1, "DISCOVERY total_saved=3"), (2, "DISCOVERY total_saved=x")], lines.schema))
    assert {(r.label, r.failure) for r in coverage.run_check(more, none).collect()} == {(None, "nothing_stored"), ("a", "found_below_minimum")}


def test_whole_plan_rows(spark):
    rows = [("s1", "en", "k1", "u", "T", {"a": "1"}, {"r": "1"}), ("s2", "en", "k2", "u", "T", {}, {"r": "2"}), ("s3", "en", "k3", "", "T", {}, {"r": "3"})]
    df = spark.createDataFrame(rows, "source_url string, language string, key string, file_url string, title string, metadata map<string,string>, registry_metadata map<string,string>")
    index = lambda *r: spark.createDataFrame(list(r), "key string, shared_id string")
    got = {r.source_url: (r.action, r.registry_metadata, r.primary_shared_id, r.mapping_sha256) for r in plan.plan_rows(df, index(("k2", "p2")), index(("k9", "r9")), "abc").collect()}
    assert got == {"s1": ("CREATE", {"r": "1"}, None, "abc"), "s2": ("CREATE_REGISTRY_ONLY", {"r": "2"}, "p2", "abc"), "s3": ("SKIP", None, None, "abc")}
    sent = plan.registry_enrich(spark.createDataFrame([("p", b"x"), (None, b"y")], "primary_shared_id string, content binary")).collect()
    assert sent[0].registry_link[0].value == "p" and sent[1].registry_link is None


def test_vocabulary_round_trip(spark, tmp_path):
    rows = [("country", "es", "Spain"), ("country", "xx", None), ("kind", "a: b", 'q"uote')]
    entries = spark.createDataFrame(rows, "property_name string, crawl_value string, canonical_value string")
    writers.write_vocabulary(entries, str(tmp_path / "v"))
    assert {(r.property_name, r.crawl_value, r.canonical_value) for r in readers.read_vocabulary(spark, str(tmp_path / "v")).collect()} == set(rows)
    assert readers.read_vocabulary(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "1.yaml").write_text("property_name: k\nmapping:\n" + "".join(f"  a{i}: b\n" for i in range(30000)) + "end: z\n")
    assert readers.read_vocabulary_files(spark, str(tmp_path / "y")).count() == 30000


def test_entities_by_pushed_values(spark):
    def fetch(language, start, size, wanted):
        rows = [(f"t{i % 3}", f"{language}{i}", "{}") for i in range(9)]
        return [r for r in rows if r[0] in wanted.get("template", [r[0]])][start : start + size]

    readers.register_entities(spark, "entities_in_test", fetch, ["en"], 2)
    df = spark.read.format("entities_in_test").load()
    assert df.where(F.col("template").isin("t0", "t2")).count() == 6 and df.where("template = 't1'").count() == 3


def test_gate_refuses_what_acts(spark):
    gate = sqlgate.Gate(spark)
    for bad in ("INSERT INTO x SELECT 1", "SELECT 1; DROP TABLE x", "FROM x INSERT INTO y SELECT 1", "select", ""):
        assert gate.ask(bad).startswith("error")
    assert "| " in gate.ask("SELECT json_extract('{\"a\": \"x|y\"}', '$.a') AS v, NULL AS n") and gate.left == sqlgate.QUERIES_A_TURN - 1
