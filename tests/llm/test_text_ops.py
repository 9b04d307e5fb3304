"""Quality classifier, spelling variants and fill-in-the-middle against brute force, SQL, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import catalog, fill_middle, spelling, subword

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "word", "en", "a", 4), (None, "no id here at all", "en", "b", 10), (4, "long text " * 30_000, "en", "b", 0),
        (5, "12 34 --", "en", "b", 8), (5, "12 34 --", "en", "b", 8), (6, "has a <S> inside", "en", "b", 16), (7, "ÄÖü 😀 x́", "de", "b", 7), (8, "x" * 700_000, "en", "c", 700_000),
    ]
    clash = {"ids": F.lit(1), "score": F.lit(0), "n": F.lit(2), "id": F.lit("x"), "word": F.lit("w"), "rank": F.lit(3), "output": F.lit(""), "form": F.lit(1), "h1": F.lit(2), "predicted": F.lit("p"), "label": F.lit(1)}
    return spark.createDataFrame(rows, DOCS).withColumns(clash)


@pytest.mark.parametrize("name", ["op12_spelling", "op13_fill_middle"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(catalog.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)


# -- fill-in-the-middle -------------------------------------------------------------------------


def plain_units(units, text):
    """The units by a pattern, one by one."""
    if units.gap == fill_middle.EACH:
        return list(text)
    c = re.escape(units.changes)
    return re.findall(f"[^{c}]+|[{c}]" if units.gap == fill_middle.ONE else f"[^{c}]*[{c}]|[^{c}]+", text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <P>SM\n\t😀é", max_size=40), st.sampled_from([fill_middle.CODE_POINTS, fill_middle.WORDS, fill_middle.LINES]), st.tuples(*[st.integers(0, 2**32 - 1)] * 4))
def test_cut_against_list_of_units(text, units, h):
    scanner = fill_middle.Scanner(units)
    ranks = scanner.ranks(len(text), scanner.events(text)[0])
    held = plain_units(units, text)
    assert ranks.n == len(held)
    assert [ranks.end_of(k) for k in range(len(held) + 1)] == [len("".join(held[:k])) for k in range(len(held) + 1)]
    c = fill_middle.cut(scanner, text, h, 10, 20)
    out = fill_middle.arranged(text, c)
    assert fill_middle.rebuilt(scanner, out, c.form) == text
    low, high = sorted((h[0] % (len(held) + 1), h[1] % (len(held) + 1)))
    p, m, s = ("".join(x) for x in (held[:low], held[low:high], held[high:]))
    plain = not text or any(x in text for x in fill_middle.SENTINELS) or h[2] % 100 >= 90
    assert out == (text if plain else f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}")


def test_sentinels_that_overlap():
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "<M>"), ("<P>x", "P>", "<M>"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fill_middle.Scanner(sentinels=bad)


def test_fill_middle_odd(odd):
    for units in (fill_middle.CODE_POINTS, fill_middle.WORDS, fill_middle.LINES):
        made = fill_middle.transform(odd, units=units)
        assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = fill_middle.restore(made, units=units).collect()
        want = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
        assert len(got) == 10 and all(r["restored"] == want[r["doc_id"]] for r in got)
        of = {r["doc_id"]: r for r in got}
        assert [of[k]["form"] for k in (1, 2, 6)] == ["plain"] * 3 and of[1]["n"] == 0 and of[6]["prefix_chars"] is None
    assert fill_middle.transform(odd.limit(0)).count() == 0
    with pytest.raises(Exception, match="not an output of form"):
        fill_middle.restore(made.withColumn("form", F.lit("psm")).filter("doc_id = 6")).collect()


def test_forms_have_their_shares(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    n = {r["form"]: r["count"] for r in fill_middle.transform(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] - 2000) < 200 and abs(n["spm"] - 3600) < 300
    again = fill_middle.transform(docs.repartition(7))
    assert again.exceptAll(fill_middle.transform(docs)).count() == 0


# -- spelling variants --------------------------------------------------------------------------


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, min_length=6, min_count=5, factor=5):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) if xs else None for w, xs in near.items()}
    form = {w: x if x and n[x] >= factor * n[w] else None for w, x in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def as_rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_spelling_brute_force(spark):
    rng = random.Random(5)
    bases = ["colourful", "aaaaaaaa", "ababab", "bababa", "überaus", "ÀÿÀÿÀÿ", "letters"]
    words = []
    for b in bases:  # variants of variants, with falling counts, so that chains of forms arise
        held = [b]
        for k in range(30):
            w = list(rng.choice(held))
            at = rng.randrange(len(w))
            how = rng.randrange(3)
            w[at : at + (how != 0)] = [] if how == 1 else [rng.choice("abcü×")]
            held.append("".join(w))
        words += [w for k, w in enumerate(held) for _ in range(max(1, int(400 / (1 + k) ** 1.6)))]
    rng.shuffle(words)
    rows = [(i % 97 or None, " ".join(words[i::120]) + (" UPPER" if i % 2 else ".")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_variants(rows)
    assert as_rows(spelling.variants(docs)) == want and len(want) > 40
    assert as_rows(spelling.variants(docs.repartition(7), min_length=4, min_count=2, factor=2)) == plain_variants(rows, 4, 2, 2)


def test_chain_of_forms(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb"]
    rows = [(i, " ".join([w] * 5 * 5**k)) for i in range(1) for k, w in enumerate(chain)]
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {"aaaaaa": ("aaaaab", "aaabbb"), "aaaaab": ("aaaabb", "aaabbb"), "aaaabb": ("aaabbb", "aaabbb"), "aaabbb": (None, "aaabbb")}


def test_spelling_odd(odd, spark):
    got = {r["word"]: r["n"] for r in spelling.variants(odd, min_length=4).collect()}
    assert got == {"long": 30_000, "text": 30_000}
    assert spelling.variants(odd.limit(0)).count() == 0 and spelling.variants(odd.filter("doc_id < 4")).count() == 0
    long = [(k, "y" * 3000 + c) for k in range(5) for c in ("a", "b")]
    assert as_rows(spelling.variants(spark.createDataFrame(long, "doc_id long, text string"), min_count=3)) == plain_variants(long, 6, 3)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aÀÿ×b .-\n", max_size=60), st.integers(1, 9))
def test_blocks_cut_no_run(text, block):
    assert [w for found in spelling.runs(text, block) for w in found] == re.findall(spelling.LETTERS, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abÿ", min_size=5, max_size=5), min_size=2, max_size=8, unique=True))
def test_group_keys(words):
    points = np.array([[ord(c) for c in w] for w in words], "<u4")
    whole, blank, gone, first = spelling.group_keys(points)
    shorter = {w[:k] + w[k + 1 :] for w in words for k in range(5)}
    keys = spelling.group_keys(np.array([[ord(c) for c in w] for w in sorted(shorter)], "<u4"))[0]
    key_of = dict(zip(sorted(shorter), map(tuple, keys.T)))
    for i, w in enumerate(words):
        assert first[i].sum() == len({w[:k] + w[k + 1 :] for k in range(5)})
        for k in range(5):
            assert tuple(gone[:, i, k]) == key_of[w[:k] + w[k + 1 :]]
            for j, x in enumerate(words):
                assert (tuple(blank[:, i, k]) == tuple(blank[:, j, k])) == (w[:k] + w[k + 1 :] == x[:k] + x[k + 1 :])


# -- quality classifier -------------------------------------------------------------------------


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES["op11_subword"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got.collect())


def plain_features(text):
    """Words and n-grams one by one."""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    grams = [f" {w} "[k : k + n] for w in words for n in subword.GRAMS for k in range(len(w) + 3 - n)]
    return words, grams, sum(a == b for a, b in zip(words, words[1:]))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc é😀\n\t.", max_size=50))
def test_features_against_strings(text):
    words, grams, again = plain_features(text)
    got = subword.features(text, 1 << 62)
    assert len(got) == len(words) + len(grams) + again
    for held, own in ((words, got[: len(words)]), (grams, got[len(words) : len(got) - again])):
        assert len(set(held)) == len(set(own.tolist()))  # one bucket for each string, and none shared among so few


def test_blocks_of_text():
    text = "some words, and more of them " * 2000
    assert "".join(subword.blocks(text, 1000)) == text
    assert all(b[-1] == " " and len(b) < 1010 for b in subword.blocks(text, 1000))
    own, n = subword.bucket_counts(text * 10)
    assert n[own == subword.MARK] == 1 and n.sum() == 1 + len(np.concatenate([subword.features(b) for b in subword.blocks(text * 10)]))


def test_classifier_odd(spark, odd):
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, 0), (3, 1), (5, 1), (5, 7), (None, 0), (99, 0)], "doc_id long, quality int")
    model = subword.learn(odd, labels, F.lit(True))
    out = subword.classify(odd, model)
    rows = out.collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    of = {r["doc_id"]: r["score"] for r in rows}
    assert of[1] == of[2] and len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    assert subword.classify(odd.limit(0), model).count() == 0
    none = subword.learn(odd, labels.limit(0), F.lit(True))
    assert {r["score"] for r in subword.classify(odd, none).collect()} == {0.5}


def test_sample_is_bounded_and_repeatable(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good prose here").otherwise("bad $$$ here").alias("text"))
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    few = subword.teachers(docs.union(docs), labels.union(labels), F.lit(True), "doc_id", "text", "quality", 50)
    assert few.count() == 50
    one, two = (subword.learn(d, labels, F.lit(True), sample=100) for d in (docs, docs.repartition(5)))
    assert (one.weight == two.weight).all()
    assert one.score("good prose here") > 0.9 and one.score("bad $$$ here") < 0.2
