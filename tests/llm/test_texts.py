"""Line removal, language model, decontamination, packing and language identification."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
import regex

import corpus_pipeline
from gleanery.llm import common, decontaminate, lang_id, language_model, line_dedup, packing
from gleanery.session import table


def brute_lines(rows, least):
    sites = defaultdict(set)
    for site, text in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if line.strip(" "):
                sites[line.strip(" ")].add(site)
    bad = {x for x, s in sites.items() if len(s) >= least}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad) for _, t in rows]


def test_line_removal(spark):
    rows = [(i, f"s{i % 7}" if i % 5 else None, f"head\nline {i}\n foot \nhead\n\nmid {i % 3}") for i in range(40)]
    rows += [(1, "s1", rows[1][2]), (90, "s0", None), (91, "s0", ""), (92, "s0", "head"), (None, "s9", "x\nfoot"), (93, "s1", "\n".join(["head", "keep"] * 500))]
    docs = spark.createDataFrame([(*r, "7", 5, "k", [9]) for r in rows], "doc_id bigint, source string, text string, N_Lines string, n_removed int, _k1 string, _gone array<int>")
    for least in (2, 5, 8):
        out = line_dedup.drop_boilerplate(docs, least)
        assert out.columns == ["doc_id", "source", "text", "_k1", "_gone", "n_lines", "n_removed"]
        got = out.collect()
        assert {r._k1 for r in got} == {"k"} and {tuple(r._gone) for r in got} == {(9,)}
        want = brute_lines([(r[1], r[2]) for r in rows], least)
        assert Counter((r.doc_id, r.text) for r in got) == Counter(zip([r[0] for r in rows], want, strict=True))
    assert {r.doc_id: r.n_lines for r in got}[90] == 0 and {r.doc_id: r.n_lines for r in got}[93] == 1000
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_line_stage_strips_heavy_frames_and_spares_copies(spark):
    frame = "\n".join(f"long line {i} of the frame about a page" for i in range(9))
    rows = [(i, f"{frame}\nown {i}", "en", f"s{i}", 0) for i in range(9)] + [(20 + i, "all\nthe same lines" + " " * (i % 2), "en", f"s{i}", 0) for i in range(9)]
    rows += [(40, f"{frame}\nown 0", "en", "s8", 0), (41, None, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert [got[i] for i in range(9)] == [f"own {i}" for i in range(9)] and got[40] == "own 0" and got[41] is None
    assert all(got[20 + i] == rows[9 + i][1] for i in range(9))


def test_line_removal_can_leave_copies_whole(spark):
    rows = [(i, f"s{i}", "all\nthe same lines") for i in range(9)] + [(20 + i, f"s{i}", f"frame\n{'own words ' * 9}{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, 8, keep_above=0.5).collect()}
    assert got[0].text == "all\nthe same lines" and got[0].n_removed == 0
    assert got[20].n_removed == 1 and "frame" not in got[20].text


def words(text):
    return (text or "").encode().lower().split() + [None]


def kneser_ney(train):
    count, pairs = Counter(), Counter()
    for text in train:
        w = words(text)
        count.update(w)
        pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(count.values()), len(count)
    cont = Counter(b for _, b in pairs)
    ctx = defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), c in pairs.items():
        ctx[a][0] += c
        ctx[a][min(c, 3)] += 1
    dh, dl = (language_model.discounts([sum(c == k for c in t.values()) for k in (1, 2, 3, 4)]) for t in (pairs, cont))
    total = sum(cont.values())
    gl = sum(dl[min(c, 3) - 1] for c in cont.values()) / total if total else 1.0
    off = lambda c, d: c - (d[min(c, 3) - 1] if c else 0)

    def p(a, b):
        low = (off(cont[b], dl) / total if total else 0) + gl / (v + 1)
        if a not in ctx:
            return low
        x = ctx[a]
        return off(pairs[a, b], dh) / x[0] + sum(d * m for d, m in zip(dh, x[1:], strict=True)) / x[0] * low

    return count, n, v, p


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_language_model_is_kneser_ney(spark, monkeypatch, shard):
    monkeypatch.setattr(language_model, "TOKENS_A_BIGRAM_SHARD", shard)
    monkeypatch.setattr(language_model, "CHARS_A_WORD_SHARD", shard * 4)
    texts = ["the cat sat on the mat", "The CAT ate\tthe rat", "a dog sat", "the the the the the the the", None, "", "é ü the\x0bcat", "the cat sat on the mat"]
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, score string")
    model = language_model.train(docs)
    asked = [*texts, "unseen words only", "cat the unseen mat"]
    got = language_model.score(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), model, ["doc_id"]).collect()
    count, n, v, p = kneser_ney(texts)
    assert (model.tokens, model.types) == (n, v)
    for r in got:
        w = words(asked[r.doc_id])
        assert r.n_tokens == len(w) and r.n_known == sum(count[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)))
    assert sum(p(b"the", x) for x in count) + p(b"the", b"unknown") == pytest.approx(1)


def test_language_model_with_shards_that_got_no_pair(spark, monkeypatch):
    monkeypatch.setattr(language_model, "TOKENS_A_BIGRAM_SHARD", 50)
    texts = ["a b"] * 300
    model = language_model.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = ["b a a b", "a b", "b b a a", "c"]
    got = language_model.score(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), model, ["doc_id"]).collect()
    p = kneser_ney(texts)[3]
    for r in got:
        w = words(asked[r.doc_id])
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)))


@pytest.mark.parametrize("conf, told, master, want", [({"spark.checkpoint.dir": "hdfs://a/b/"}, "hdfs://c", "yarn", "hdfs://a/b"), ({}, "hdfs://c/d", "yarn", "hdfs://c/d"), ({}, None, "local[2]", "/tmp/checkpoints")])
def test_shared_folder(conf, told, master, want):
    context = SimpleNamespace(getCheckpointDir=lambda: told, master=master, setCheckpointDir=lambda d: None)
    assert common.shared_root(SimpleNamespace(conf=conf, sparkContext=context)) == want


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        common.shared_root(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")))


def test_language_model_of_nothing(spark):
    model = language_model.train(spark.createDataFrame([], "text string"))
    got = language_model.score(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), model, ["doc_id"]).first()
    assert (got.n_tokens, got.n_known, got.base_score, got.score) == (3, 0, 0.0, 0.0)


def test_language_model_query(spark, sf_dir):
    rows = language_model.op4_lm_scoring(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)


ITEMS = [
    (1, "If a train leaves Boston at 9 and runs 60 km each hour how far is it from Boston after 9 hours"),
    (2, "the quick brown fox jumps over the lazy dog while seven small birds sing above the green hill"),
    (3, "too short to tell"),
    (4, None),
    (2, "the quick brown fox jumps over the lazy dog while seven small birds sing above the green hill"),
]
DOCS = [
    (1, "Intro text. If a train leaves Boston at 9 and runs 60 km each hour how far is it from Boston after 9 hours? More."),
    (2, "Intro text. If a train leaves Madrid at 7 and runs 85 km each hour how far is it from Madrid after 7 hours? More."),
    (3, "If a train leaves Madrid at 7 and runs 85 km each hour how far is it from Oslo after 3 hours"),
    (4, "THE QUICK, brown*** fox jumps%%% over the lazy dog while\nseven small birds sing above the green hill"),
    (5, "the quick brown fox jumps over the lazy cat while nine tall trees stand below the red barn"),
    (6, "too short to tell"),
    (7, None),
    (8, ""),
    (4, "THE QUICK, brown*** fox jumps%%% over the lazy dog while\nseven small birds sing above the green hill"),
    (9, "x " * 30000 + "the quick brown fox jumps over the lazy dog while seven small birds sing above the green hill " + "y " * 30000),
]


def template(text):
    """(template, plain tokens) by plain patterns."""
    num, unit, name = decontaminate.NUM, decontaminate.UNIT, decontaminate.NAME
    s = re.sub(rf"[ \t\n\x0b\f\r{num}-{name}]+", " ", text or "")
    s = regex.sub(r"(?<=[\p{Ll},;:0-9] )\p{Lu}\p{Ll}+", lambda m: name + m[0], s)
    s = regex.sub(rf"(?<=[0-9]) ?((?i:{'|'.join(sorted(decontaminate.UNITS, key=len, reverse=True))}))(?![\p{{L}}0-9])", lambda m: f" {unit}{m[1]}", s).lower()
    s = regex.sub(rf"[^\p{{L}}\p{{M}}0-9.,{unit}{name}]|[.,](?![0-9])|(?<![0-9])[.,]", " ", s)
    marked = s.split()
    return [w[0] if w[0] in unit + name else num if w[0] in "0123456789" else w for w in marked], [w.lstrip(unit + name) for w in marked]


def brute_leaks(docs, items, window=5, containment=0.8):
    holders = (decontaminate.NUM, decontaminate.UNIT, decontaminate.NAME)

    def keyed(t, r, size):
        for i in range(len(t) - size + 1):
            cells = tuple(t[i : i + size])
            yield i, {tuple(r[i : i + size])} | ({cells} if sum(c not in holders for c in cells) >= 2 else set())

    out = set()
    for item_id, text in set(items):
        it, ir = template(text)
        if not it:
            continue
        size = min(window, len(it))
        mine = list(keyed(it, ir, size))
        need = math.ceil(containment * len(mine) - 1e-9)
        for doc_id, doc in set(docs):
            dt, dr = template(doc)
            met = [(at, n) for n, ks in keyed(dt, dr, size) for at, keys in mine if ks & keys]
            mixed, slots = set(), defaultdict(set)
            for at, n in met:
                for a, b, x, y in zip(it[at : at + size], dt[n : n + size], ir[at : at + size], dr[n : n + size], strict=True):
                    if a == b and a in holders:
                        slots[n - at, a, x].add(y)
            mixed = {k[0] for k, v in slots.items() if len(v) > 1}
            alike = {at for at, n in met if ir[at : at + size] == dr[n : n + size]}
            good = alike | {at for at, n in met if n - at not in mixed}
            if len(good) >= need:
                n_slots = len({(k[1], k[2], y) for k, v in slots.items() if k[0] not in mixed for y in v})
                out.add((doc_id, item_id, len(mine), len(good), n_slots, len(alike) < need))
    return out


def leaks(spark, docs, items):
    docs = spark.createDataFrame([(*r, "k") for r in docs], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.find_leaks(docs, items).collect()
    out = {(r.doc_id, r.item_id, r.n_windows, r.n_matched, r.n_slots, r.reparameterised) for r in rows}
    assert len(out) == len(rows) and all(r.containment == r.n_matched / r.n_windows for r in rows)
    return out


def test_decontamination_cases(spark):
    items = [*ITEMS, (5, "What is the capital of France?"), (6, "Add 5 and 7"), (2, "another text of the second id that stands for itself in this table"), (7, "12 34"), (None, "an item without any id is found as well as all others are")]
    long = ITEMS[0][1].split()
    docs = [
        *DOCS,
        (20, "so: what is the capital of Peru then"),
        (21, "What   is the\ncapital of   France"),
        (22, "we add 9 and 8 here, and 12 34 there"),
        (23, "the number 12 35 is no 34 12"),
        (24, " ".join([*long[:3], "quickly", *long[3:]])),
        (25, " ".join([*long[:5], "12", *long[6:]])),
        (26, "IF A TRAIN LEAVES BOSTON AT 9 AND RUNS 60 KM EACH HOUR HOW FAR IS IT FROM BOSTON AFTER 9 HOURS"),
        (27, "*" * 100_000 + "." * 100_000 + " an item without any id is found as well as all others are"),
        (28, "another text of the second id that stands for itself in this table"),
        (None, "what is the capital of France"),
    ]
    got = leaks(spark, docs, items)
    assert got == brute_leaks(docs, items)
    pairs = {(d, i) for d, i, *_ in got}
    assert {(1, 1), (2, 1), (4, 2), (9, 2), (6, 3), (20, 5), (21, 5), (22, 6), (22, 7), (24, 1), (26, 1), (27, None), (28, 2), (None, 5)} == pairs
    assert {(d, i) for d, i, *_, changed in got if changed} == {(2, 1), (20, 5), (22, 6)}
    assert not leaks(spark, [], items) and not leaks(spark, docs, [])


def test_decontamination_at_every_offset(spark):
    """A nine-word item whose last word was changed shares four of five windows: found wherever it stands."""
    item = "red stones fall down while nine grey birds wait"
    docs = [(i, " ".join(["pad"] * i + item.split()[:8] + ["sing", "on"])) for i in range(12)]
    assert {d for d, *_ in leaks(spark, docs, [(1, item)])} == set(range(12))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["the", "train", "runs", "from", "to", "with", "each", "day", "how", "many", "are", "left"]

    def text(n):
        return " ".join(rng.choice([rng.choice(vocabulary)] * 6 + [rng.choice(["Oslo", "Rome", "Anna"]), str(rng.randrange(30)), f"{rng.randrange(9)} km", "x-ray,", "End. Then"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40]))) for i in range(40)]
    docs = []
    for d in range(160):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = [rng.choice([*vocabulary, "Paris", "17"])]
        w = [rng.choice(["Lima", x]) if x in ("Oslo", "Rome") else x.upper() if rng.random() < 0.05 else x for x in w]
        docs.append((d, text(rng.randint(0, 30)) + rng.choice([" ", "\n", ". "]) + rng.choice([" ", "  ", "\n"]).join(w) + " " + text(rng.randint(0, 10))))
    got = leaks(spark, docs, items)
    assert got == brute_leaks(docs, items) and len(got) > 150 and any(g[-1] for g in got)


def test_decontamination_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    got = {(r.doc_id, r.item_id, r.n_windows, r.n_matched, r.n_slots, r.reparameterised) for r in decontaminate.op5_decontaminate(spark, sf_dir).collect()}
    assert got == brute_leaks(docs, items)


def test_tokenizer_cache_gives_the_public_ids(tmp_path):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(packing.default_tokenizer())
    reference.encode_special_tokens = True
    texts = ["", " ", "a", "a  b", " lead", "tail ", "x\ny", "x \n y", "x\n\ny\n", "don't we'll 'S 12,5%", "tab\tand\xa0nbsp", "é ü 漢字 \U0001f600!!", "<|endoftext|> x", "a.\n b\r\nc"]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("ab '\n\t.é1,!漢"), rng.integers(0, 40))) for _ in range(400)]
    (tmp_path / "alone.json").symlink_to(packing.default_tokenizer())
    ranked, plain = packing.WordCachedTokenizer(), packing.WordCachedTokenizer(str(tmp_path / "alone.json"))
    assert (ranked.ends_sentence()[:50000] == plain.ends_sentence()[:50000]).all()
    for text in texts:
        for mine in (ranked, plain):
            assert np.frombuffer(mine.ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


def check_packing(pieces, texts, tokenizer, window=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = tokenizer.ids(text or "") + bytes(4)
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4 and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    waste = total = 0
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        total += at
        waste += 0 if at & (at - 1) == 0 else window - at
    return waste / total


def test_packing_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert check_packing(packing.op6_packing(spark, sf_dir).collect(), texts, packing.WordCachedTokenizer()) < 0.03


def test_packing_cases(spark, monkeypatch):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "One. Two. Three.\nFour", 5: "x" * 4000, 6: "A b c. " * 700}
    docs = spark.createDataFrame([(*r, 1) for r in texts.items()], "doc_id bigint, text string, start int").coalesce(1)
    check_packing(packing.pack_documents(docs).collect(), texts, packing.WordCachedTokenizer())
    check_packing(packing.pack_documents(docs, 100).collect(), texts, packing.WordCachedTokenizer(), 100)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_plan_is_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(60):
        cuts = np.cumsum(rng.integers(1, 60, 14)).tolist()
        pens = rng.integers(0, 50, 14).tolist()
        window = 100

        def cost(size):
            pad = 0 if size in (64,) else window - size
            return pad + packing.WINDOW_CHARGE

        best = {0: 0}
        for i, c in enumerate(cuts):
            best[c] = min(best[o] + cost(c - o) + pens[i] for o in best if c - o <= window)
        closes = packing.plan_windows(cuts, pens, window, True)
        got = sum(cost(b - a) + pens[cuts.index(b)] for a, b in zip([0, *closes], closes, strict=False))
        assert got == best[cuts[-1]]


def test_language_id(spark, sf_dir):
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    got = lang_id.op8_language_id(spark, sf_dir).collect()
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert not any(r.rejected for r in got)


def test_language_id_against_brute_force(spark, sf_dir):
    """Each text's hashed grams, one by one in plain numbers, against the model's centroids."""
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs)
    texts = [r.text for r in docs.limit(40).collect()] + ["x", "ab cd", "1 2", "", None, "É\U00010428 ß", "aa  b-b"]
    low = lambda c: ord(c.lower()[0]) if c.isalpha() else 32

    def grams(text):
        s = [32]
        for c in text or "":
            if not (low(c) == 32 == s[-1]):
                s.append(low(c))
        s += [32]
        m = 1 << 32
        h1 = [c * 0x9E3779B1 % m for c in s]
        h2 = [((a ^ 0x5BD1E995) * 0x85EBCA6B + b) % m for a, b in zip(h1, h1[1:])]
        h3 = [((a ^ 0x27D4EB2F) * 0xC2B2AE35 + b) % m for a, b in zip(h2, h1[2:])]
        out = Counter()
        for h in (*h1, *h2, *h3):
            h ^= h >> 15
            h = h * 0x2C1B3C6D % m
            out[(h ^ (h >> 12)) % lang_id.BUCKETS] += 1
        return out

    got = {r.doc_id: r for r in lang_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        w = {b: math.log1p(n) * float(model.idf[b]) for b, n in grams(text).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        cosines = [sum(x * float(c[b]) for b, x in w.items()) / norm for c in model.centroids]
        assert got[i].score == pytest.approx(max(cosines), abs=1e-4)
        assert max(c for c, name in zip(cosines, model.langs, strict=True) if name == got[i].lang_pred) == pytest.approx(max(cosines), abs=1e-5)


def test_language_id_ties_and_repeats(spark):
    rows = [(1, "same words here", "b"), (2, "same words here", "a"), (3, "same words here", None), (3, "same words here", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in lang_id.predict(docs, lang_id.fit(docs), ["doc_id"]).collect()] == ["a"] * 4


def test_language_id_rejects_gibberish_and_unseen_languages(spark):
    import random

    rng = random.Random(3)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. "
    polish = "Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach. Są oni obdarzeni rozumem i sumieniem. "
    far = [junk(n) for n in (5, 20, 100, 3000, 20000)] + [finnish, finnish * 50, polish, polish * 50, "z" * 4000]
    model = lang_id.fit(docs)
    asked = spark.createDataFrame(list(enumerate(far)), "doc_id bigint, text string")
    assert all(r.rejected for r in lang_id.predict(asked, model, ["doc_id"]).collect())
    assert lang_id.predict(docs.where("lang is not null and text is not null"), model, ["doc_id"]).where("rejected").count() == 0


def test_language_id_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !!", "de"), (5, "the dog", None), (6, "", None)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id bigint, text string, lang string, score double")
    model = lang_id.fit(docs)
    got = {r.doc_id: r for r in lang_id.predict(docs, model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "und", "und", "en", "und"]
    assert got[3].rejected and got[3].score == 0
    none = lang_id.fit(docs.limit(0))
    assert {r.lang_pred for r in lang_id.predict(docs, none, ["doc_id"]).collect()} == {"und"}
    far = lang_id.predict(spark.createDataFrame([(1, "漢字 " * 20)], "doc_id bigint, text string"), model, ["doc_id"]).first()
    assert far.rejected and far.lang_pred in ("en", "de")
