"""BPE, quality, language ID, WARC, LM scoring, MinHash and the pipeline against brute force, round trips and goldens."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import bpe, language_id, minhash, quality, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word", "en", "a", 4), (None, "no id here at all", "en", "b", 10), (4, "long text " * 30_000, "en", "b", 0), (5, "12 34 --", "en", "b", 8), (5, "12 34 --", "en", "b", 8)]
    return spark.createDataFrame(rows, DOCS).withColumns({"ids": F.lit(1), "score": F.lit(0), "n": F.lit(2), "id": F.lit("x")})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- BPE ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    with open(path, "rb") as f:
        return bpe.Bpe(f.read()), lib


def encode(b, text):
    return np.frombuffer(b"".join(b.encode(text)), "<i4")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeinorst'é Σİ1²!?<|>\n　😀\x1c", max_size=60), st.integers(1, 40))
def test_bpe_equals_library(both, text, times):
    b, lib = both
    text = text * times
    want = lib.encode(text, add_special_tokens=False).ids
    got = encode(b, text)
    assert got.tolist() == want
    assert bpe.Decoder(b).text(got, step=7) == lib.decode(want, skip_special_tokens=False)


def test_bpe_long_word_streams(both):
    b, lib = both
    rng = random.Random(2)
    word = "".join(rng.choice("theinraosd") for _ in range(20_000))
    assert encode(b, word + " x<|endoftext|>").tolist() == lib.encode(word + " x<|endoftext|>", add_special_tokens=False).ids


def test_lookahead_is_sufficient(both):
    b, _ = both
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice("theinraosdl") for _ in range(b.lookahead + 60)]
        whole, cut = b.merge(list(s)), b.merge(s[:-20])
        size = 0
        for x, y in zip(whole, cut):
            size += len(y)
            if size > len(s) - 20 - b.lookahead:
                break
            assert x == y


def test_byte_decoder_round_trip(both):
    b, _ = both
    d = bpe.Decoder(b, surface=False)
    assert d.text(encode(b, "héllo wörld 😀 ok"), step=1) == "héllo wörld 😀 ok "


def test_bpe_odd(odd):
    got = bpe.tokenize(odd, bpe.default_tokenizer()).collect()
    assert len(got) == 7 and all(r.ids == [] and r.decoded == "" for r in got if r.doc_id in (1, 2))
    assert bpe.tokenize(odd.filter("false"), bpe.default_tokenizer()).count() == 0 and bpe.digests(odd.filter("false"), bpe.default_tokenizer()).count() == 0


def test_bpe_digests_equal_library(spark, both, docs, odd):
    """All result columns of the query, over the whole table and the odd rows, against the tokenizers library."""
    import hashlib

    _, lib = both
    names = DOCS.replace(" long", "").replace(" string", "").split(", ")
    table = docs.select(*names).unionByName(odd.select(*names)).unionByName(spark.createDataFrame([(77_001, "é" * 3_000_000 + " tail", None, None, None)], DOCS).filter("true"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in table.filter("doc_id <> 77001 OR doc_id IS NULL").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    got = bpe.digests(table, bpe.default_tokenizer()).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got if r.doc_id != 77_001), key=key) == sorted(want, key=key)
    assert [r.n_tokens > 1 for r in got if r.doc_id == 77_001] == [True]


# -- quality --------------------------------------------------------------------------------------


def brute_repeats(words):
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return sum(any(seen[tuple(words[j : j + 5])] > 1 for j in range(max(0, i - 4), min(i, len(words) - 5) + 1)) for i in range(len(words)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute_repeats(words)


def test_js_distance():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0.0, 1])) == 1 and quality.js_distance(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0


def brute_quality(rows):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept) of (text, lang) rows."""
    import re
    import unicodedata

    gap = "[\\x20\\x09-\\x0D]+"
    of = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Nd": "digit", "Zs": "space", "Zl": "space", "Zp": "space"}
    main = {"L": "other_letter", "M": "other_letter", "N": "digit", "P": "punctuation", "S": "symbol", "C": "control"}

    def kind(c):
        if c in "#*$%&|<>":
            return "symbol"
        if c in "\t\n\x0b\x0c\r":
            return "space"
        return of.get(unicodedata.category(c)) or main[unicodedata.category(c)[0]]

    def js(p, q):
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
        kl = lambda x: sum(v * math.log2(v / m[k]) for k, v in x.items() if v > 0)
        return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))

    share = lambda c: {k: v / max(1, sum(c.values())) for k, v in c.items()}
    lettered = lambda w: any(ord(c) > 127 or c.isalpha() for c in w)
    facts = []
    for text, lang in rows:
        words = [w for w in re.split(gap, text or "") if w]
        lines = [x for x in (text or "").split("\n") if re.sub(gap, "", x)]
        repeats = brute_repeats(words)
        failed = len(words) < 10 or 100 * repeats > 20 * len(words)
        facts.append((words, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeats, failed, Counter(map(kind, text or ""))))
    langs = {lang for _, lang in rows if lang}
    teach = {x: [i for i, (t, lang) in enumerate(rows) if lang == x and t is not None and not facts[i][5]] for x in langs}
    langs = {x for x in langs if len({t for t, lang in rows if lang == x and t is not None}) >= 20 and sum(len(facts[i][0]) for i in teach[x]) >= 2000}
    classes = {x: sum((facts[i][6] for i in teach[x]), Counter()) for x in langs}
    counts = {x: sum((Counter(facts[i][0]) for i in teach[x]), Counter()) for x in langs}
    common = {x: [w for w, _ in sorted(((w, n) for w, n in counts[x].items() if lettered(w)), key=lambda v: (-v[1], v[0].encode()))[:40]] for x in langs}

    def bins(c, x):
        out = Counter({w: c[w] for w in common[x]})
        out["bare"] = sum(n for w, n in c.items() if not lettered(w))
        out["rest"] = sum(c.values()) - sum(out.values())
        return out

    for i, (words, chars, symbols, dup, repeats, failed, own) in enumerate(facts):
        mine = Counter(words)
        minus = lambda c, x, part: Counter({k: v - (part[k] if i in teach[x] else 0) for k, v in c.items()})
        by_class = min((js(share(own), share(minus(classes[x], x, own))) for x in langs), default=0.0)
        by_word = min((js(share(bins(mine, x)), share(minus(bins(counts[x], x), x, bins(mine, x)))) for x in langs), default=0.0)
        fits = (chars < 200 or by_class <= 0.28) and (len(words) < 40 or by_word <= 0.42)
        yield len(words), chars, symbols, dup, repeats, failed, by_class, by_word, fits and not failed


def test_quality_equals_brute_force(spark, docs, odd):
    rng = random.Random(3)
    junk = " ".join("".join(rng.choice("@{}~^01") for _ in range(7)) for _ in range(400))
    extra = [(9001, junk, "xx", None, 0), (9002, junk, None, None, 0), (9003, "a|b <c>\x1f d\u00a0e\n\n a\n a\n", "en", None, 0), (9004, "\u2028 \x85 word " * 30, "fr", None, 0)]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, DOCS)).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = table.withColumn("classes", F.lit(1)).collect()
    got = sorted(quality.judge(table.withColumn("words", F.lit(1))).collect(), key=lambda r: (str(r.doc_id), r.n_words))
    order = sorted(range(len(rows)), key=lambda i: (str(rows[i].doc_id), len([w for w in (rows[i].text or "").encode().split()])))
    want = list(brute_quality([(r.text, r.lang) for r in rows]))
    for g, i in zip(got, order):
        w = want[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed, g.kept) == (*w[:6], w[8]), g.doc_id
        assert math.isclose(g.class_distance, w[6], abs_tol=1e-6) and math.isclose(g.word_distance, w[7], abs_tol=1e-6), g.doc_id
    said = {g.doc_id: g.kept for g in got}
    assert said[9001] is said[9002] is False  # a junk text is no reference for itself or for its copy


def test_quality_verdict(spark, docs, sf, odd):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    fresh = [(q, got[i].kept) for i, q in labels.items() if not got[i].base_failed]
    assert sum(k for q, k in fresh if q) >= 0.98 * sum(q for q, _ in fresh)
    assert sum(k for q, k in fresh if not q) <= 0.2 * sum(not q for q, _ in fresh)
    rows = quality.judge(odd).collect()
    assert len(rows) == 7 and not any(r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert quality.judge(odd.filter("false")).count() == 0


# -- language ---------------------------------------------------------------------------------------


def test_grams():
    got = Counter(language_id.grams("Ab  b-1").tolist())
    code = lambda s: int.from_bytes(b"", "big") or sum(ord(c) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    want = Counter(map(code, ["a", "b", "b", " a", "ab", "b ", " b", "b ", " ab", "ab ", " b "]))
    assert got == want


def brute_language(teach, texts):
    """(language, score) of texts by dictionaries; teach: (text, lang)."""
    import unicodedata

    def grams(text):
        low = "".join(c.lower()[0] if unicodedata.category(c)[0] in "LM" else " " for c in unicodedata.normalize("NFC", text or ""))
        if not any(unicodedata.category(c)[0] == "L" for c in unicodedata.normalize("NFC", text or "")):
            return Counter()
        out = Counter()
        for w in low.split():
            p = f" {w} "
            out.update(w)
            out.update(p[i : i + 2] for i in range(len(p) - 1))
            out.update(p[i : i + 3] for i in range(len(p) - 2))
        return out

    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    ranked = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:400]]
    totals: dict = {}
    for text, lang in teach:
        if text is not None and lang is not None:
            totals.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in sorted(totals.items()) if c}
    for text in texts:
        mine = ranked(grams(text))
        if not mine or not profiles:
            yield "und", 0.0
            continue
        costs = {lang: sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(costs, key=lambda x: (costs[x], x))
        yield best, 1 - costs[best] / (400 * len(mine))


def test_language_equals_brute_force(spark, docs, odd):
    names = DOCS.replace(" long", "").replace(" string", "").split(", ")
    table = docs.select(*names).unionByName(odd.select(*names))
    rows = table.collect()
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 4 == 2
    want = dict(zip([r.text for r in rows], brute_language([(r.text, r.lang) for r in rows if not held(r.doc_id)], [r.text for r in rows])))
    text_of = {(r.doc_id, r.text): r.text for r in rows}
    profiles = language_id.learn(table, ~language_id.held_out())
    got = language_id.identify(table, profiles).collect()
    assert len(got) == len(rows)
    for g in got:
        lang, score = want[text_of[g.doc_id, g.text]]
        assert g.lang_pred == lang and math.isclose(g.score, score, abs_tol=1e-12), g.doc_id


def test_language_held_out(spark, docs, odd):
    profiles = language_id.learn(docs, ~language_id.held_out())
    out = language_id.identify(docs, profiles)
    held = out.filter(language_id.held_out()).select((F.col("lang") == F.col("lang_pred")).alias("ok"), "score").collect()
    assert sum(r.ok for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in held)
    clash = odd.withColumns({"lang_pred": F.lit("zz"), "code": F.lit(1), "r": F.lit(2)})
    said = {r.doc_id: r.lang_pred for r in language_id.identify(clash, profiles).collect()}
    assert said[1] == said[2] == said[5] == "und" and said[4] != "und"
    assert {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}
    empty = odd.filter("false")
    assert language_id.learn(empty, F.lit(True)) == {} and language_id.identify(empty, profiles).count() == 0


# -- WARC -----------------------------------------------------------------------------------------------


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    big = "x" * 300_000
    rows = [(1, "http://a/ b\n", "p" * 100), (2, None, "p" * 100), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "p" * 99), (6, "http://f", "p" * 99), (7, "http://g", big), (2, "http://h", "p" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages, path)
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"left by a lost task")
    got = warc.read_warc(spark, path).collect()
    assert sorted(r.record_type for r in got) == ["response"] * 6 + ["revisit"] * 2
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {"<urn:page:1>"}
    assert {len(r.payload) for r in got if r.record_id == "<urn:page:7>"} == {300_000}
    only = warc.read_warc(spark, path, payload=False).filter("record_type = 'revisit' AND target_uri IS NOT NULL")
    assert [(r.record_id, r.payload, r.http_length) for r in only.collect()] == [("<urn:page:2>", None, 100)]
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter isnotnull" not in plan
    assert warc.read_warc(spark, path).filter(F.col("target_uri").startswith("http://a/%20b%0A")).count() == 1


def test_warc_append_keeps_and_overwrite_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    page = lambda a, b: spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>") for i in range(a, b)], "page_id long, url string, html string")
    uris = lambda: sorted(r["target_uri"] for r in warc.read_warc(spark, path).collect())
    warc.write_pages(page(0, 10), path)
    warc.write_pages(page(10, 20), path)
    assert uris() == sorted(f"http://a/{i}" for i in range(20))
    torn = F.when(F.col("page_id") == 25, F.raise_error("torn")).otherwise(F.col("html"))
    with pytest.raises(Exception, match="torn"):
        warc.write_pages(page(20, 30).withColumn("html", torn), path)
    assert len(uris()) == 20
    one = warc.read_warc(spark, path).limit(1)
    held = spark.createDataFrame(one.collect(), one.schema).select("record_type", "record_id", F.lit("http://new").alias("target_uri"), "payload_digest", "payload", "http_length", "refers_to")
    before = set((tmp_path / "w").glob("*.warc.gz"))
    held.write.format(warc.NAME).mode("overwrite").save(path)
    assert uris() == ["http://new"] and not before & set((tmp_path / "w").glob("*.warc.gz"))
    assert len(list((tmp_path / "w").glob("_manifest*"))) == 1 and not list((tmp_path / "w").glob("*.tmp"))


def test_warc_foreign_members(tmp_path):
    import gzip

    rec = lambda i: warc.record("response", f"<urn:x:{i}>", "http://x", "0", b"y" * (i * 5000), i * 5000, None, "2024-01-01T00:00:00Z")
    (tmp_path / "plain.warc").write_bytes(rec(1) + rec(2))
    (tmp_path / "other.warc.gz").write_bytes(gzip.compress(rec(3)) + gzip.compress(rec(0)))
    for name, ids in (("plain.warc", [1, 2]), ("other.warc.gz", [3, 0])):
        got = list(warc.records(f"file://{tmp_path}/{name}", lambda r: True, True))
        assert [(r["record_id"], len(r["payload"])) for r in got] == [(f"<urn:x:{i}>", i * 5000) for i in ids]
        assert [r["payload"] for r in warc.records(f"file://{tmp_path}/{name}", lambda r: True, False)] == [None, None]
    (tmp_path / "bad.warc").write_bytes(rec(1)[:-3000])
    with pytest.raises(ValueError, match="bad.warc, offset 0"):
        list(warc.records(f"file://{tmp_path}/bad.warc", lambda r: True, True))


def test_warc_passes_over_a_large_foreign_payload(tmp_path):
    import gzip
    import time
    import tracemalloc

    rng = random.Random(1)
    body = rng.randbytes(1 << 20) * 60
    rec = lambda i, b: warc.record("response", f"<urn:page:{i}>", "http://x", "0", b, len(b), None, "2024-01-01T00:00:00Z")
    (tmp_path / "big.warc.gz").write_bytes(gzip.compress(rec(1, body), 1) + gzip.compress(rec(2, b"small")))
    path = f"file://{tmp_path}/big.warc.gz"
    start = time.perf_counter()
    assert [len(r["payload"]) for r in warc.records(path, lambda r: True, True)] == [len(body), 5]
    read = time.perf_counter() - start
    tracemalloc.start()
    start = time.perf_counter()
    assert [r["record_id"] for r in warc.records(path, lambda r: r["record_id"].endswith(":2>"), True)] == ["<urn:page:2>"]
    skipped = time.perf_counter() - start
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    assert skipped < 3 * read + 1


def test_warc_copies_and_ids(spark, tmp_path):
    long = "y" * 150
    rows = [(f"a/{i}", None, long if i % 3 else long + str(i)) for i in range(60)] + [(None, None, long), ("a b>", "http://u", "z" * 100), (None, None, "z" * 100), ("a/1", None, long)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").withColumns({"payload_digest": F.lit(1), "id": F.lit(2), "first_id": F.lit(3), "word": F.lit(4)})
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages, path)
    got = warc.read_warc(spark, path).withColumns({"page": warc.page_of(F.col("record_id")), "first": warc.page_of(F.col("refers_to"))}).collect()
    assert sorted(str(r.page) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        body = next(h for i, _, h in rows if i == r.page and len(h) == r.http_length)
        if len(body) == 100:
            want = (None, "response") if r.page else ("a b>", "revisit")
        else:
            want = ("a/1", "revisit") if body == long and r.page != "a/1" else (None, "response")
        assert (r.first, r.record_type) == want
        assert bytes(r.payload).decode() == (body if r.record_type == "response" else "")
    warc.write_pages(pages.filter("false"), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


# -- MinHash ------------------------------------------------------------------------------------------------


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    find = lambda x: x if label[x] == x else find(label[x])
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x = len(sets[a] & sets[b])
            if sets[a] and 100 * x >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash_brute_force(spark, odd):
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(90)]
    texts = {}
    for i in range(150):
        words = list(base) if i % 2 else [f"w{rng.randrange(300)}" for _ in range(60)]
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        texts[i * 3 + 1] = " ".join(words)
    texts |= {1000: "A b c", 1001: "a B c", 1002: "a b", 1003: None, 1004: "", 1005: texts[1]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"key": F.lit(1), "node": F.lit(2)})
    for width in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width=width).collect()}
        assert got == brute_components(texts, width, 80)
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 7 and [r.kept for r in rows if r.doc_id is None] == [True]
    assert minhash.near_duplicates(odd.filter("false")).count() == 0


@pytest.mark.parametrize("block", [256, 20])
def test_minhash_repeated_rows_in_a_crowd(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(90)]
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(2, 12)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        texts[i + 1] = " ".join(words)
    rows = list(texts.items())
    df = spark.createDataFrame(rows + [r for r in rows if r[0] % 2], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width=4).collect()}
    assert got == brute_components(texts, 4, 80)


def test_crowd_bound_spares_ids_with_several_sets(spark):
    ids = list(range(20))
    members = spark.createDataFrame([(7, i, i, 20) for i in ids], "key long, node long, label long, size long")
    stats = spark.createDataFrame([(i, 100 + 100 * (i == 0), 90, 1.0, True if i == 0 else None) for i in ids], "node long, n long, shared long, centrality double, several boolean")
    centred = minhash.centres(members, stats.withColumn("centrality", F.col("node").cast("double")))
    to_centre = spark.createDataFrame([(19, i, 10) for i in ids if i != 19], "a long, b long, common long")
    pairs = [(r.a, r.b) for r in minhash.crossing_pairs(members, stats, centred, to_centre, 80).collect()]
    assert {b for a, b in pairs if a == 0} == set(ids[1:]) and len(pairs) == len(set(pairs))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 300)], "a long, b long")
    assert {r.node: r.component for r in minhash.components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


# -- pipeline -------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, sf):
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, sf).cache()
        seen.append((name, before, now))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == list(corpus_pipeline.COLUMNS)
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    language, lines, near, mixed, coded = (x[2] for x in seen)
    assert set(ids(language)) == set(ids(docs))  # all have letters
    texts = {r.doc_id: r.text for r in lines.collect()}
    want = {c for _, c in brute_components(texts, 5, 80).values()}
    assert sorted(ids(near)) == sorted(want)
    assert all(n <= 3 for n in Counter(ids(mixed)).values()) and set(ids(mixed)) <= set(ids(near))
    assert sorted(ids(coded)) == sorted(ids(mixed)) and coded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, coded.collect()))


def test_pipeline_odd_tables(spark, odd, docs):
    """Every stage on nulls, repeated rows, long texts, clashing columns, and on an empty table."""
    names = DOCS.replace(" long", "").replace(" string", "").split(", ")
    some = docs.filter("doc_id < 40").select(*names)
    twice = spark.createDataFrame([(90_007, "one text of five or more words here", "en", "a", 1), (90_007, "another text of five or more words here", "en", "a", 1), (None, "a third text of five or more words", "en", None, None)], DOCS)
    full = some.unionByName(odd.select(*names)).unionByName(twice).withColumns({"_row": F.lit(1), "_doc": F.lit(2), "_copy": F.lit(3), "component_id": F.lit(4), "p": F.lit(5), "lang_pred": F.lit(6)})
    for table in (full, full.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == list(corpus_pipeline.COLUMNS)
            rows = out.collect()
            assert bool(rows) == (table is full), name
            if name == "MinHash near-dedup" and rows:
                assert sorted(r.text for r in rows if r.doc_id == 90_007) == ["another text of five or more words here", "one text of five or more words here"]
                assert sum(r.text == "12 34 --" for r in rows) == 1 and "a third text of five or more words" in {r.text for r in rows if r.doc_id is None}


def test_minhash_recall_of_buckets():
    """Pairs just above the threshold, measured: they share a bucket."""
    rng = random.Random(12)
    pairs = found = 0
    for _ in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        other = list(words)
        for _ in range(rng.randrange(1, 4)):
            other[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        a, b = (minhash.Shingles(5).of(" ".join(x)) for x in (words, other))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            pairs += 1
            found += bool({*minhash.buckets_of(minhash.minima(a)).tolist()} & {*minhash.buckets_of(minhash.minima(b)).tolist()})
    assert pairs > 200 and found >= 0.995 * pairs
