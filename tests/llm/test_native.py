"""Line dedup, mixing, exact dedup and sharding: SQL, goldens, and the odd tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.llm import catalog, exact_dedup, line_dedup, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "Hello\nWorld", "en", "a", 11), (2, "hello\nworld", "en", None, 11), (3, None, None, "b", None), (4, "", "en", "b", 0), (5, "x" * 200_000, "en", "c", 200_000),
        (5, "x" * 200_000, "en", "c", 200_000), (None, "HELLO\nWORLD", "en", "a", 11), (6, "ÄÖ äö", "de", "d", 5), (7, "äö äö", "de", "d", 5), (8, "Hello\nnew line\n\n  Hello ", "en", "b", 20),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "size": F.lit("s"), "node": F.lit(0), "id": F.lit("clash")})


def same(got, want):
    key = lambda r: tuple(repr(v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_warc", "op6_mixing", "op9_exact_dedup", "op10_sharding"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(catalog.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    same([tuple(r[c] for c in cols) for r in df.collect()], [tuple(r[i] for i in at) for r in rel.fetchall()])


def test_exact_dedup_odd(odd):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect()}
    assert (1, 2, 3, False) in got and (2, 2, 3, True) in got and (None, 2, 3, False) in got
    assert (3, 4, 2, False) in got and (5, 5, 2, True) in got
    assert (6, 6, 1, True) in got and (7, 7, 1, True) in got  # only A-Z is lowered


def test_index_grows_by_batches(spark):
    """Buckets of files split when a later batch overfills them; others keep their files; lookups see all batches."""
    rows = [(i, f"text {i % 700}", "en", "s", 0) for i in range(1500)]
    first, second, third = (spark.createDataFrame(x, DOCS) for x in (rows[:300], rows[300:1400], [(5000, "TEXT 3", "en", "s", 0)]))
    one = exact_dedup.insert(exact_dedup.Index(spark, capacity=60), first)
    two = exact_dedup.insert(one, second)
    assert one.depth >= 3 and len(two.buckets) > len(one.buckets) and two.depth > one.depth
    three = exact_dedup.insert(two, third)
    kept = {b.folder for b in two.buckets} & {b.folder for b in three.buckets}
    assert len(kept) == len(two.buckets) - 1  # one bucket was touched
    for index in (one, two, three):
        assert sum(2.0**-b.depth for b in index.buckets) == 1  # the prefixes cover all keys once
        sizes = [index.entries([b]).count() for b in index.buckets]
        assert max(sizes) <= 60 and sum(sizes) == index.entries().count()
        for b in index.buckets:
            assert {r[0] for r in index.entries([b]).select(exact_dedup.slot_of(F.col("key"), b.depth)).distinct().collect()} <= {b.prefix}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.lookup(three, spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == 1500 and got[3] == (5000, 3, False) and got[1390] == (1390, 2, True) and got[10] == (710, 2, False)
    assert exact_dedup.lookup(three, spark.createDataFrame([(1, "not there", None, None, None)], DOCS)).collect()[0].group_size == 0


def test_exact_dedup_hot_text(spark):
    rows = [(i, "Hot" if i % 3 else f"own {i}", "en", "s", 0) for i in range(3000)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == (2999, 2000, False) and got[2999] == (2999, 2000, True) and got[0] == (0, 1, True)


def test_exact_dedup_hot_text_without_ids(spark):
    """Rows without an id of a hot text are dealt out over tasks, and each has its answer."""
    rows = [(None if i % 3 else i, "Hot" if i % 3 else f"own {i}", "en", "s", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    index = exact_dedup.insert(exact_dedup.Index(spark), docs)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = exact_dedup.lookup(index, docs)
        assert found.filter("doc_id IS NULL").groupBy("keep_id", "group_size", "kept").count().collect() == [(None, 2000, True, 2000)]
        where = found.filter("doc_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in where) < 1500
    finally:
        for name in settings:
            spark.conf.unset(name)


def reference_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump(spark):
    keys = [0, 1, 17, 2**63, 2**64 - 1, 10**18 + 7]
    df = spark.createDataFrame([(str(k),) for k in keys], "k string").select(F.col("k").cast("decimal(20,0)").alias("k"))
    for n in (1, 2, 8, 9, 50):
        assert [r[0] for r in df.select(sharding.jump_shard(F.col("k"), n)).collect()] == [reference_jump(k, n) for k in keys]


def test_sharding_odd(odd):
    rows = sharding.shard(odd).collect()
    assert len(rows) == 10
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {1} and {r.text_crc32 for r in rows if r.doc_id == 3} == {0}


def test_mixing_targets(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5), ("d", 0)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(sized).collect()}
    total = 2015
    assert got["a"] == (10, 30.0) and got["d"] == (0, 0.0) and got[None] == (5, 15.0)
    left = total - 45
    assert got["b"] == (1000, left * 2 / 5) and got["c"] == (1000, left * 3 / 5)


def test_mixing_closeness_and_odd(spark, odd):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"))
    rows = mixing.mix(docs, keep=("source",)).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 25
        assert all(r.taken <= 3 * r.size for r in mine)
    got = mixing.mix(odd).collect()
    assert len(got) == 10 and all(r.taken <= 3 * r.size for r in got) and {r.size for r in got if r.doc_id in (3, 4)} == {0}


def test_mixing_inclusion_frequencies(spark):
    """One source of many equal documents for each size: of every class the share that the level and its weight ask for is taken."""
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 3 == 0, 2).when(F.col("id") % 3 == 1, 20).otherwise(200).cast("int")).alias("text"),
        F.when(F.col("id") < 15_000, "a").otherwise("b").alias("source"), F.lit(9).alias("p"), F.lit(8).alias("copies"), F.lit(7).alias("words"),
    )
    rows = mixing.mix(docs, keep=("source", "words", "p")).collect()
    assert {r.words for r in rows} == {7} and len(rows) == 30_000
    for source in "ab":
        mine = [r for r in rows if r.source == source]
        whole = min(r.copies for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 100
        for size in (2, 20, 200):
            group = [r for r in mine if r.size == size]
            p = group[0].p
            share = sum(r.copies - whole for r in group) / len(group)
            assert {r.p for r in group} == {p} and abs(share - p) < 4 * (p * (1 - p) / len(group)) ** 0.5 + 0.005
        weights = {r.size: r.p for r in mine if r.p > 0}
        assert len(weights) == 3 and abs(weights[20] / weights[2] - 5 / 2) < 1e-9 and abs(weights[200] / weights[2] - 8 / 2) < 1e-9
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs, seed="other").collect()}
    assert again != {(r.doc_id, r.copies) for r in rows}


def brute_pareto(rows, limit=3):
    """rows: (id, text, source) to copies, by sorting every source whole."""
    import hashlib
    import re

    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    words = {s: sum(n for r, n in size.items() if r[2] == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    stopped: set = set()
    while True:
        level = (sum(words.values()) - sum(limit * words[s] for s in stopped)) / max(1, sum(weight[s] for s in names if s not in stopped))
        more = {s for s in names if s not in stopped and limit * words[s] <= level * weight[s]}
        if not more:
            break
        stopped |= more
    out = {}
    for s in names:
        mine = [r for r in rows if r[2] == s]
        target = limit * words[s] if s in stopped else level * weight[s]
        whole = min(limit, int(target / words[s])) if words[s] else 0
        left, sure = target - whole * words[s], set()
        digits = {r: size[r].bit_length() for r in mine}
        while True:
            share = sum(size[r] * digits[r] for r in mine if r not in sure)
            lam = (left - sum(size[r] for r in sure)) / share if share else 0.0
            top = max((digits[r] for r in mine if r not in sure), default=0)
            if not top or lam * top < 1:
                break
            sure |= {r for r in mine if digits[r] == top}
        left -= sum(size[r] for r in sure)

        def rank(r):
            md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
            u = (int(md5(f"mix|{r[0]}|{md5(r[1] or '')}")[:13], 16) + 0.5) / (1 << 52)
            return u / (1 - u) / (lam * digits[r] / (1 - lam * digits[r]))

        run, extra = 0, set()
        for r in sorted((r for r in mine if r not in sure and lam * digits[r] > 0), key=rank):
            if run + size[r] / 2 > left:
                break
            extra.add(r)
            run += size[r]
        out |= {r[0]: whole + (r in sure) + (r in extra) for r in mine}
    return out


def test_mixing_equals_brute_force(spark):
    import random

    rng = random.Random(6)
    rows = [(i, "w " * int(rng.expovariate(0.02)) if i % 11 else None, rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)] + [(2000, "w " * 5000, "e"), (2001, "w", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.copies for r in mixing.mix(docs).collect()} == brute_pareto(rows)


def test_line_dedup_first_stays(spark):
    rows = [(i, f"shared line\nown {i}\nshared line", None, f"s{i % 9}", 0) for i in range(30)] + [(50, None, None, "s1", 0), (51, "", None, None, 0), (None, "shared line", None, "s2", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_boilerplate(docs, min_sites=9).collect()}
    assert got[0] == ("shared line\nown 0", 3, 1) and got[7] == ("own 7", 3, 2) and got[None] == ("", 1, 1)
    assert got[50] == (None, 0, 0) and got[51] == ("", 0, 0)
    kept = line_dedup.drop_boilerplate(docs, min_sites=10).agg(F.sum("n_removed")).first()[0]
    assert kept == 0


def test_line_dedup_odd(spark, odd):
    clash = odd.withColumns({c: F.lit(7) for c in ("n_lines", "n_removed", "_id", "_th", "_h", "_gone", "gone", "th", "parts", "row", "a", "b", "salt", "first_id", "at")})
    for sites in (1, 2, 8):
        got = line_dedup.drop_boilerplate(clash, min_sites=sites)
        assert sorted(got.columns) == sorted({*clash.columns}) and len(got.collect()) == 10
        assert {r.gone for r in got.collect()} == {7} and {r.text for r in got.collect() if r.doc_id == 3} == {None}
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_boilerplate(clash, min_sites=2).collect()}
    assert (1, "Hello\nWorld", 2, 0) in got and (8, "new line\n", 3, 2) in got  # "Hello" on sites a and b; ids order before texts


def test_line_dedup_many_lines(spark):
    lines = "\n".join(f"line {i}" for i in range(20_000))
    docs = spark.createDataFrame([(i, lines + f"\nown {i}", "en", f"s{i}", 0) for i in range(10)], DOCS)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.drop_boilerplate(docs).collect()}
    assert got[0] == (lines + "\nown 0", 0) and all(got[i] == (f"own {i}", 20_000) for i in range(1, 10))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    for f in (exact_dedup.exact_dedup, sharding.shard, mixing.mix, line_dedup.drop_boilerplate):
        assert f(docs).count() == 0
