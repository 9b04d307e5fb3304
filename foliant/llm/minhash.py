"""MinHash near-dedup: banding, signature and exact verification, components by alternating stars.

1. Each text's set of distinct word shingles (64-bit hashes) gives ``BANDS * ROWS`` minima of universal hash
   functions. Equal sets collapse to one node, the smallest id; copies are never linked pair by pair.
2. Nodes that agree on all minima of a band share a bucket. A bucket's nodes are paired with its
   smallest node, so a bucket of n nodes gives under n pairs.
3. A pair stands if the share of equal minima does not rule it out (``SLACK`` below the threshold, over
   five standard errors) and the full sets then reach the threshold.
4. Components of the links. In buckets that still hold several components, pairs across components are tested
   too, so no link between components that share a bucket is lost. Crowded buckets of that kind, as a large group of
   edited copies makes them, first compare every node with their most central one, whose exact intersections then
   bound those of all other pairs; pairs that the bound rules out are dropped. Components are then found anew.

With 40 bands of 5, a pair at 0.8 misses every bucket with probability 1e-7.

Components are found by alternating large-star and small-star; each round is written to the shared folder, and only
a row count and a checksum reach the driver. Later links are put on the components so far.

A bucket, a head or a component may hold a third of all nodes. Joins on such keys deal a key's rows out over ``SALTS`` tasks, and the pairs of a
crowded bucket are dealt out by blocks of ``BLOCK`` nodes.

Defined results: null texts and texts without words have an empty set and stay alone; rows with a null id get
their set size, a null component, and stay; rows repeated under one id are one node (with different texts, its links are
those of any of them); an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import discard, map_arrow, spread, staged, table

BANDS, ROWS = 40, 5
SLACK = 0.15
#: Mixed buckets with more members are crowded: their nodes are first compared with the most central one.
CROWD = 16
SALTS, BLOCK = 32, 256
MOST_WORDS = 200_000
_rng = np.random.default_rng(20240501)
FACTORS = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
PLACES = _rng.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingles:
    """Sets of word shingles, sorted; words' hashes are kept in a bounded table."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def word(self, w: bytes) -> int:
        if len(self.known) >= MOST_WORDS:
            self.known.clear()
        got = self.known[w] = xxhash.xxh3_64_intdigest(w)
        return got

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        get = self.known.get
        h = np.fromiter([got if (got := get(w)) is not None else self.word(w) for w in words], np.uint64, len(words))
        width = min(self.width, len(words))
        n = len(h) - width + 1
        total = np.full(n, width, np.uint64)
        for k in range(width):
            total += h[k : k + n] * PLACES[k]
        return np.unique(mixed(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash function, as 32 bits."""
    out = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        x = np.multiply.outer(shingles[i : i + 1024], FACTORS)
        x += OFFSETS
        np.minimum(out, x.min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def buckets_of(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    parts = sig.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(BANDS, dtype=np.uint64) * PLACES[ROWS]
    for k in range(ROWS):
        total += mixed(parts[:, k] + np.uint64(k + 1)) * PLACES[k]
    return mixed(total).view(np.int64)


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", pairs: DataFrame | None = None) -> DataFrame:
    """many joined to ``one``, with the rows of a key dealt out by ``by`` over ``SALTS`` tasks. pairs: a smaller table with
    the same pairs of key and by."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).alias("_salt")
    wanted = (many if pairs is None else pairs).select(key, salt).distinct()
    many = many.withColumn("_salt", salt)
    return many.join(wanted.join(one, key), [key, "_salt"], how).drop("_salt")


def sign(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n_shingles, set_key (128 bits), sig (16 bits of each minimum), keys (one for each band)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            n, key, sig, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles.of(text or "")
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                m = minima(s) if len(s) else None
                sig.append(m.astype(np.uint16).tobytes() if len(s) else None)
                keys.append(buckets_of(m) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n_shingles", "set_key", "sig", "keys"],
            )

    picked = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(picked, run, f"id {kind}, n_shingles long, set_key binary, sig binary, keys array<long>")


def on_both(pairs: DataFrame, of: DataFrame, value: str, names: tuple[str, str]) -> DataFrame:
    """pairs (a, b) with the value of each side under its name. A node of many pairs is dealt out on either side. of: id, value."""
    left, right = (of.select(F.col("id").alias(side), F.col(value).alias(name)) for side, name in zip("ab", names))
    return salted_join(salted_join(pairs, left, "a", "b"), right, "b", "a", pairs=pairs).select("a", "b", *names)


def likely(pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs (a, b, sig_a, sig_b) that their signatures don't rule out."""
    least = threshold - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array((x == y).mean(1) >= least)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(pairs.select("a", "b", "sig_a", "sig_b"), run, f"a {kind}, b {kind}")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, common of pairs (a, b): the sizes of their full sets and of the intersection. sets: id, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, common = [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                na.append(len(x))
                nb.append(len(y))
                common.append(len(np.intersect1d(x, y, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(v, pa.int64()) for v in (na, nb, common)]], ["a", "b", "na", "nb", "common"])

    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(on_both(pairs, sets, "shingles", ("x", "y")), run, f"a {kind}, b {kind}, na long, nb long, common long")


def reaching(found: DataFrame, percent: int) -> DataFrame:
    """a < b of the overlaps with 100 * intersection >= percent * union."""
    union = F.col("na") + F.col("nb") - F.col("common")
    linked = found.filter(100 * F.col("common") >= percent * union)
    return linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of edges(a, b)."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = staged(edges.select(u, v).filter("u <> v").distinct(), "stars")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, low, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = salted_join(large, low, "u", "v").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = staged(small, "small-star")
        discard(now, large)
        now, last, before = after, before, mark(after)
        if before == last:
            break
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads).distinct()


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, component) after more links(a, b): components of components."""
    of = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
    named = links.join(of, "a", "left").join(of.withColumnsRenamed({"a": "b", "la": "lb"}), "b", "left")
    named = staged(named.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "named-links")
    moved = staged(components(named.select(F.col("la").alias("a"), F.col("lb").alias("b"))), "moved")
    fresh = named.select(F.col("a").alias("node")).union(named.select("b")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("now"))
    out = salted_join(labels.unionByName(fresh), to, "component", "node", "left").select("node", F.coalesce("now", "component").alias("component"))
    out = staged(out, "labels")
    discard(named, moved)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id and kept for every row of docs."""
    signed = staged(sign(docs, id_col, text_col, width), "signed")
    filled = signed.filter("id IS NOT NULL AND set_key IS NOT NULL")
    nodes = filled.groupBy("set_key").agg(F.min("id").alias("node"), F.any_value("sig").alias("sig"), F.any_value("keys").alias("keys"))
    nodes = staged(nodes, "nodes")

    buckets = nodes.select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = nodes.select("node", F.explode("keys").alias("key"))
    shared = staged(placed.join(buckets, "key").select("key", "node", "head"), "shared-buckets")
    stars = shared.select(F.col("head").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    sigs = nodes.select(F.col("node").alias("id"), "sig").join(shared.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    sigs = staged(sigs, "signatures")
    stars = staged(stars, "bucket-stars")
    first = staged(likely(on_both(stars, sigs, "sig", ("sig_a", "sig_b")), percent / 100), "likely")

    wanted = shared.select(F.col("node").alias("_node")).distinct()
    texts = docs.join(wanted, F.col(id_col) == F.col("_node"), "left_semi").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every_set = staged(shingle_sets(texts, width), "every-set")
    repeated = every_set.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id")
    repeated_sets = staged(every_set.join(repeated, "id", "left_semi").distinct(), "repeated-sets")
    sets = every_set.join(repeated_sets.select("id").distinct(), "id", "left_anti").unionByName(repeated_sets)
    several = repeated_sets.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("id").alias("node"), F.lit(True).alias("several"))
    links = staged(reaching(overlaps(first, sets), percent), "links")
    labels = staged(components(links), "labels")

    # links across components that share a bucket
    mixed_buckets = staged(members_of_mixed(shared, labels), "mixed-buckets")
    stats = staged(crowd_stats(mixed_buckets, sets).join(several, "node", "left"), "crowd-stats")
    centred = staged(centres(mixed_buckets, stats), "centres")
    pairs = centred.select(F.col("centre").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    to_centre = staged(overlaps(pairs, sets), "to-centre")
    before, labels = labels, extended(labels, staged(reaching(to_centre, percent), "links-central"))
    discard(before)
    again = staged(members_of_mixed(mixed_buckets, labels), "mixed-buckets")
    across = crossing_pairs(again, stats, centred, to_centre, percent).join(first, ["a", "b"], "left_anti")
    across = staged(across, "across")
    second = staged(likely(on_both(across, sigs, "sig", ("sig_a", "sig_b")), percent / 100), "likely-across")
    more = staged(reaching(overlaps(second, sets), percent), "links-across")
    if not more.isEmpty():
        labels = extended(labels, more)
    discard(shared, stars, across, first, second, every_set, repeated_sets, sigs, mixed_buckets, again, stats, centred, to_centre, links, more)

    of_set = nodes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    joined = salted_join(signed.select("id", "n_shingles", "set_key").withColumn("_n", F.monotonically_increasing_id()), of_set, "set_key", "_n", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id"))
    )


def members_of_mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, label, size for the members of buckets that hold several components; size is the bucket's."""
    label = F.coalesce("component", "node").alias("label")
    named = members.select("key", "node").join(labels, "node", "left").select("key", "node", label)
    per = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    return salted_join(named, per.select("key", "size"), "key", "node")


def crowd_stats(members: DataFrame, sets: DataFrame) -> DataFrame:
    """node, n, shared, centrality of the nodes in mixed buckets of over ``CROWD`` members.

    n: size of the set; shared: its shingles that any other of these nodes has, so an upper bound of every intersection;
    centrality: the mean number of these nodes that have one of its shingles.
    """
    crowd = members.filter(F.col("size") > CROWD).select(F.col("node").alias("id")).distinct()
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.frombuffer(raw, np.int64)
                for i in range(0, len(s), 50_000):
                    part = s[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([node] * len(part)).cast(batch.schema.field(0).type), pa.array(part)], ["id", "s"])

    pieces = map_arrow(sets.join(crowd, "id", "left_semi"), run, f"id {kind}, s long")
    held = pieces.groupBy("s").agg(F.count(F.lit(1)).alias("d"))
    joined = salted_join(pieces, held, "s", "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 1).alias("shared"), F.avg("d").alias("centrality"))
    return joined.withColumnRenamed("id", "node")


def centres(members: DataFrame, stats: DataFrame) -> DataFrame:
    """key, node, centre: for the members of crowded buckets the bucket's most central node."""
    crowd = members.filter(F.col("size") > CROWD).join(stats.select("node", "centrality"), "node")
    best = crowd.groupBy("key").agg(F.max(F.struct("centrality", "node"))["node"].alias("centre"))
    return salted_join(crowd, best, "key", "node").select("key", "node", "centre")


def crossing_pairs(members: DataFrame, stats: DataFrame, centred: DataFrame, to_centre: DataFrame, percent: int) -> DataFrame:
    """a < b: all pairs of a bucket's nodes from different components that can reach the threshold.

    In crowded buckets a pair drops out where its intersection is bound too low: inside the centre's set it is at most the smaller
    of the two nodes' intersections with that set, and outside it at most the smaller number of the shingles that
    either shares with anyone. With x as that bound, (100 + percent) * x has to reach percent * (n_a + n_b). A pair that
    shares several buckets comes from the one with the smallest key only. Nodes whose id has several different sets (``several``) are
    not bound.
    """
    common = to_centre.select(F.col("a").alias("centre"), F.col("b").alias("node"), "common")
    held = centred.join(common, ["centre", "node"], "left")
    bound = members.join(held, ["key", "node"], "left").join(stats.select("node", "n", "shared", "several"), "node", "left")
    inside = F.when(F.col("node") == F.col("centre"), F.col("n")).otherwise(F.col("common"))
    bound = bound.withColumn("i", inside).withColumn("o", F.greatest(F.lit(0), F.col("shared") - F.col("i")))
    small = F.col("size") <= CROWD
    free = small | F.coalesce("several", F.lit(False))
    bound = bound.join(members.groupBy("node").agg(F.collect_set("key").alias("ks")), "node")
    worth = bound.filter(free | (100 * F.col("shared") >= percent * F.col("n")))
    # a row meets each block of its bucket once: as the left side those from its own on, as the right side those up to its own
    worth = worth.withColumn("n_blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    onwards = F.explode(F.sequence(F.col("block"), F.col("n_blocks") - 1)).alias("j")
    upto = F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i")
    left = worth.select("key", F.col("block").alias("i"), onwards, F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("o").alias("oa"), F.col("ks").alias("ka"), free.alias("fa"))
    right = worth.select("key", upto, F.col("block").alias("j"), F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("o").alias("ob"), F.col("ks").alias("kb"), free.alias("fb"))
    can = F.col("fa") | F.col("fb") | ((100 + percent) * (F.least("ia", "ib") + F.least("oa", "ob")) >= percent * (F.col("na") + F.col("nb")))
    once = F.array_min(F.array_intersect("ka", "kb")) == left["key"]
    same = (left["key"] == right["key"]) & (left["i"] == right["i"]) & (left["j"] == right["j"])
    ordered = (left["i"] != left["j"]) | (F.col("a") < F.col("b"))
    apart = left.join(right, same & ordered & (F.col("a") != F.col("b")) & (F.col("la") != F.col("lb")) & can & once)
    return apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """id and shingles (sorted 64-bit hashes as bytes) of texts(id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            got = [shingles.of(t or "").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["id", "shingles"])

    return map_arrow(texts, run, f"id {texts.schema['id'].dataType.simpleString()}, shingles binary").filter("shingles <> X''")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
