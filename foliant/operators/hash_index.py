"""Hashes near each other: exact nearest earlier hash by multi-index hashing, and leader dedup of groups of any size.

Both rest on ``meet``: rows of two sides that agree on some columns are packed into blocks of about ``BLOCK`` and meet block by block
in Arrow tasks; each row hands on its best. No pair becomes a row, and a group, bucket or band value that holds a third of all rows is
spread over tasks of one size.

``seq`` is a whole number, unique in its group, that gives the order. Rows with equal hashes are first brought down to the
earliest of them. A null group is a group; rows without a hash or a number are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.shipping import ship
from foliant.sources.shared import discard, staged

BLOCK = 1024
#: Pairs that are compared at a time.
PAIRS = 1 << 18
NEVER = np.iinfo(np.int32).max


def _same(names: list[str], prefix: str) -> Column:
    return reduce(and_, (F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in names), F.lit(True))


def _prefixed(df: DataFrame, names: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{k}" for k in names})


def _packed(rows: DataFrame, on: list[str], block: int, values: list[str]) -> DataFrame:
    """on, _n (blocks of the group), _b, and the arrays of ``values`` and of the words of each block."""
    sizes = rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    dealt = rows.join(_prefixed(sizes, on, "_k"), _same(on, "_k")).withColumn("_b", F.pmod(F.xxhash64("_seq"), F.col("_n")).cast("int"))
    held = dealt.groupBy(*on, "_n", "_b").agg(F.collect_list(F.struct(*values, "_w")).alias("_rows"))
    return held.select(*on, "_n", "_b", *[F.col("_rows")[v].alias(f"_all{v}") for v in values], F.flatten(F.col("_rows")["_w"]).alias("_all_w"))


def _lists(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of a column's lists, and all their values."""
    held = batch.column(column)
    return held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), held.flatten().to_numpy(zero_copy_only=False)


def _shares(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose pairs come to about ``PAIRS``; a row of more is a range."""
    pairs = _lists(batch, at)[0] * _lists(batch, at + 3)[0]
    begin, total = 0, 0
    for i, n in enumerate(pairs.tolist()):
        if total and total + n > PAIRS:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield begin, batch.num_rows


def _compare(batch: pa.RecordBatch, at: int, most: int) -> tuple[np.ndarray, ...]:
    """Of every row of mine that finds one: its place in the batch, number, distance, number found, compared. All rows of the batch at once; one
    row that is a large block by itself as a matrix."""
    (m, s), (_, limit), (_, h), (o, os), (_, oh) = (_lists(batch, at + k) for k in range(5))
    if not len(s) or not len(os):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int32),) + (np.empty(0, np.int64),) * 2
    h, oh = h.view(np.uint64).reshape(len(s), -1), oh.view(np.uint64).reshape(len(os), -1)
    if len(m) == 1:
        order = np.argsort(os, kind="stable")
        os, oh = os[order], oh[order]
        d = np.zeros((len(s), len(os)), np.int32)
        for k in range(h.shape[1]):
            d += np.bitwise_count(h[:, k, None] ^ oh[None, :, k])
        earlier = os[None, :] < limit[:, None]
        d[~earlier] = NEVER
        best = d.argmin(1)
        found, number, met = d[np.arange(len(s)), best], os[best], earlier.sum(1)
    else:
        pairs = m * o
        row = np.repeat(np.arange(len(m)), pairs)
        place = np.arange(len(row)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        mine, other = (np.cumsum(m) - m)[row] + place // o[row], (np.cumsum(o) - o)[row] + place % o[row]
        d = np.bitwise_count(h[mine] ^ oh[other]).sum(1, dtype=np.int32)
        earlier = os[other] < limit[mine]
        d[~earlier] = NEVER
        begins = np.cumsum(np.repeat(o, m)) - np.repeat(o, m)  # of each row of mine, its pairs
        found = np.minimum.reduceat(d, begins)
        number = np.minimum.reduceat(np.where(d == np.repeat(found, np.repeat(o, m)), os[other], np.iinfo(np.int64).max), begins)
        met = np.add.reduceat(earlier.astype(np.int64), begins)
    keep = np.flatnonzero((found <= most) & (found < NEVER))
    return np.repeat(np.arange(len(m)), m)[keep], s[keep], found[keep].astype(np.int32), number[keep], met[keep]


def meet(mine: DataFrame, others: DataFrame, on: list[str], keys: list[str], most: int = NEVER - 1, block: int = BLOCK) -> DataFrame:
    """keys, _seq, _best (struct of distance _d and number _o) and _met, for rows of ``mine`` (on, _seq, _w, and _limit: only others numbered
    below it count) that find one of ``others`` (on, _seq, _w) within ``most`` bits. _met: how many it was compared with."""
    ship(mine.sparkSession)
    left, right = _packed(mine, on, block, ["_seq", "_limit"]), _packed(others, on, block, ["_seq"])
    right = _prefixed(right, on, "_o").withColumnsRenamed({"_b": "_ob", "_n": "_on", "_all_seq": "_os", "_all_w": "_oh"})
    many = _prefixed(others.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_many")), on, "_c")
    left = left.join(many, _same(on, "_c")).select(*on, "_all_seq", "_all_limit", "_all_w", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)).alias("_to"))
    met = left.join(right, _same(on, "_o") & (F.col("_to") == F.col("_ob"))).select(*keys, "_all_seq", "_all_limit", "_all_w", "_os", "_oh")
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _shares(batch, at):
                own, *cols = _compare(batch.slice(i, j - i), at, most)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own + i)) for c in batch.columns[:at]), *map(pa.array, cols)], [*keys, "_seq", "_d", "_o", "_c"])

    schema = mine.select(*keys).schema.add("_seq", "long").add("_d", "integer").add("_o", "long").add("_c", "long")
    return met.mapInArrow(run, schema).groupBy(*keys, "_seq").agg(F.min(F.struct("_d", "_o")).alias("_best"), F.sum("_c").alias("_met"))


def _rows(df: DataFrame, keys: list[str], seq: str, words: str) -> DataFrame:
    rows = df.select(*keys, F.col(seq).cast("long").alias("_seq"), F.col(words).alias("_w"))
    return rows.filter(F.col("_seq").isNotNull() & F.col("_w").isNotNull())


def _without(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows that ``found`` has no row for, by keys and number."""
    gone = _prefixed(found.select(*keys, "_seq"), [*keys, "_seq"], "_g")
    return rows.join(gone, _same(keys, "_g") & (F.col("_seq") == F.col("_g_seq")), "left_anti")


def band_values(words: Column, n_words: int, bands: int) -> Column:
    """Array of the hash's bands: runs of equally many bits, none across two words."""
    width = 64 * n_words // bands
    if not bands or 64 % width or width * bands != 64 * n_words:
        raise ValueError(f"{bands} bands don't cut {n_words} words evenly")
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    return F.array(*[F.shiftrightunsigned(words[j * width // 64], j * width % 64).bitwiseAND(mask) for j in range(bands)])


def flips(width: int, n: int) -> list[int]:
    """Every number of ``width`` bits, n of them set."""
    return [reduce(or_, (1 << b for b in bits), 0) for bits in combinations(range(width), n)]


def nearest_earlier(df: DataFrame, keys: list[str], seq: str, words: str, n_words: int = 1, bands: int = 4, reach: int = 1, block: int = BLOCK) -> DataFrame:
    """keys, seq, nearest_seq, distance, compared: of all earlier rows of the group the nearest, first of equals. Exact.

    Two hashes that differ in d bits differ in d // bands bits or fewer in one of their bands. Round r compares a row with the
    rows that have one of its bands with r bits flipped; then all within bands * (r + 1) - 1 bits have been met, so a best within
    that radius is final and the row is done. What is left after ``reach`` rounds, and has nothing near, meets its whole group.
    """
    width = 64 * n_words // bands
    rows = staged(_rows(df, keys, seq, words), "hash-rows")
    first = staged(rows.groupBy(*keys, "_w").agg(F.min("_seq").alias("_seq")), "hash-firsts")
    heads = _prefixed(first, [*keys, "_w", "_seq"], "_f")
    copies = rows.join(heads, _same([*keys, "_w"], "_f")).filter("_seq > _f_seq").select(*keys, "_seq", F.struct(F.lit(0).alias("_d"), F.col("_f_seq").alias("_o")).alias("_best"), F.lit(0).cast("long").alias("_met"))
    banded = first.withColumn("_v", band_values(F.col("_w"), n_words, bands)).select(*keys, "_seq", "_w", F.posexplode("_v").alias("_band", "_value"))
    on = [*keys, "_band", "_value"]
    left, done, so_far = first, [], []
    for r in range(reach + 1):
        masks = F.array(*[F.lit(m).cast("long") for m in flips(width, r)])
        probes = left.withColumn("_v", band_values(F.col("_w"), n_words, bands)).select(*keys, "_seq", "_w", F.col("_seq").alias("_limit"), F.posexplode("_v").alias("_band", "_of"))
        probes = probes.select("*", F.explode(masks).alias("_mask")).withColumn("_value", F.col("_of").bitwiseXOR(F.col("_mask"))).select(*on, "_seq", "_w", "_limit")
        got = meet(probes, banded, on, keys, block=block)
        all_met = reduce(DataFrame.unionByName, [*so_far, got]).groupBy(*keys, "_seq").agg(F.min("_best").alias("_best"), F.sum("_met").alias("_met"))
        met = staged(all_met, "hash-met")
        near = F.col("_best._d") <= bands * (r + 1) - 1
        done.append(met.filter(near))
        so_far = [met.filter(~near)]
        left = staged(_without(left, done[-1], keys), "hash-left")
    final = meet(left.withColumn("_limit", F.col("_seq")), first, keys, keys, block=block)
    final = reduce(DataFrame.unionByName, [*so_far, final]).groupBy(*keys, "_seq").agg(F.min("_best").alias("_best"), F.sum("_met").alias("_met"))
    out = reduce(DataFrame.unionByName, [copies, *done, final])
    kind = df.schema[seq].dataType
    return out.select(*keys, F.col("_seq").cast(kind).alias(seq), F.col("_best._o").cast(kind).alias("nearest_seq"), F.col("_best._d").alias("distance"), F.col("_met").alias("compared"))


# -- leaders ------------------------------------------------------------------------------------

KEPT, GONE, OPEN = 1, 0, -1
#: Shares of a group at which its order may be cut.
SHARES = [2.0**-k for k in range(1, 25)]


def chunked(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """rows with _chunk, shared by at most ``block`` rows of one group that follow each other, and _limit, the first number of the chunk."""
    ranged = staged(rows.repartitionByRange(*keys, "_seq").withColumn("_part", F.spark_partition_id()), "leader-ranges")
    place = F.row_number().over(W.partitionBy(*keys, "_part").orderBy("_seq")) - 1
    cut = ranged.withColumn("_chunk", F.struct("_part", F.floor(place / block).alias("k"))).drop("_part")
    return cut.withColumn("_limit", F.min("_seq").over(W.partitionBy(*keys, "_chunk")))


def _walk(words: np.ndarray, blocked: np.ndarray, threshold: int) -> np.ndarray:
    """What is certain of a chunk's rows, in order: near a kept one is gone; near none kept but behind something open, or ``blocked``, is open."""
    n = len(words)
    state = np.full(n, OPEN, np.int8)
    for i in range(n):
        near = np.bitwise_count(words[:i] ^ words[i]).sum(1, dtype=np.int32) <= threshold
        held = state[:i][near]
        if (held == KEPT).any():
            state[i] = GONE
        elif not blocked[i] and not (held == OPEN).any():
            state[i] = KEPT
    return state


def decided(chunks: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """keys, _seq, _w, _state of the rows of every chunk; ``chunks`` has _blocked for each row."""
    ship(chunks.sparkSession)
    held = chunks.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(F.struct("_seq", "_blocked", "_w"))).alias("_rows"))
    held = held.select(*keys, F.col("_rows")["_seq"].alias("_s"), F.col("_rows")["_blocked"].alias("_x"), F.flatten(F.col("_rows")["_w"]).alias("_h"))
    at, kind = len(keys), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s, x, h = (batch.column(at + k)[i].values.to_numpy(zero_copy_only=False) for k in range(3))
                h = h.reshape(len(s), -1)
                state = _walk(h.view(np.uint64), x, threshold)
                own = pa.array(np.full(len(s), i))
                yield pa.RecordBatch.from_arrays([*(c.take(own) for c in batch.columns[:at]), pa.array(s), pa.array(list(h), kind), pa.array(state.astype(np.int32))], [*keys, "_seq", "_w", "_state"])

    schema = chunks.select(*keys, "_seq", "_w").schema.add("_state", "integer")
    return held.mapInArrow(run, schema)


def _settled(prefix: DataFrame, keys: list[str], threshold: int, block: int, alone: bool = False) -> list[DataFrame]:
    """``alone``: every group's prefix is one chunk. The leaders among ``prefix``, by rounds: what waits for nothing outside its chunk is decided there, all at once; then what lies near a
    new leader goes. A round decides the first open chunk of every group at least."""
    if alone:
        one = prefix.select("*", F.lit(0).alias("_chunk"), F.lit(False).alias("_blocked"))
        return [staged(decided(one, keys, threshold).filter(F.col("_state") == KEPT).drop("_state"), "leader-states")]
    kept, left = [], prefix
    while True:
        chunks = staged(chunked(left, keys, block), "leader-chunks")
        waits = _prefixed(meet(chunks, left, keys, keys, threshold, block).select(*keys, "_seq"), [*keys, "_seq"], "_m")
        marked = chunks.join(waits, _same(keys, "_m") & (F.col("_seq") == F.col("_m_seq")), "left").withColumn("_blocked", F.col("_m_seq").isNotNull())
        states = staged(decided(marked, keys, threshold), "leader-states")
        kept.append(states.filter(F.col("_state") == KEPT).drop("_state"))
        still = states.filter(F.col("_state") == OPEN).drop("_state")
        if still.isEmpty():
            return kept
        near = meet(still.withColumn("_limit", F.col("_seq")), kept[-1], keys, keys, threshold, block)
        left = staged(_without(still, near, keys), "leader-open")
        discard(chunks)
        if left.isEmpty():
            return kept


def leaders(df: DataFrame, keys: list[str], seq: str, words: str, threshold: int = 60, block: int = BLOCK) -> DataFrame:
    """keys, seq, ordinal: the rows that lie further than ``threshold`` bits from every row kept before them, as the fold of ``greedy_dedup`` keeps them.

    This is the lexicographically first maximal independent set of the graph of near rows. A group's order is cut into prefixes, each twice as long as
    the one before; a prefix is settled, and all that lies near its leaders goes before the next is cut. So a group of many like
    rows is compared with few leaders, a small group takes one pass, and no task holds more than ``block`` rows of a group.
    """
    rest = staged(_rows(df, keys, seq, words).groupBy(*keys, "_w").agg(F.min("_seq").alias("_seq")).select(*keys, "_seq", "_w"), "leader-rest")
    kept, size = [], block
    while True:
        marks = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("_seq").alias("_last"), F.percentile_approx("_seq", SHARES, 1000).alias("_cuts"))
        inside = F.filter(F.zip_with("_cuts", F.array(*map(F.lit, SHARES)), lambda c, f: F.struct(c.alias("c"), f.alias("f"))), lambda x: x["f"] * F.col("_n") <= size)
        cut = F.when(F.col("_n") <= size, F.col("_last")).otherwise(F.coalesce(F.try_element_at(inside, F.lit(1))["c"], F.element_at("_cuts", -1)))
        marks = _prefixed(marks.select(*keys, cut.alias("_cut")), keys, "_p")
        cut_at = rest.join(marks, _same(keys, "_p"))
        got = _settled(cut_at.filter("_seq <= _cut").select(*keys, "_seq", "_w"), keys, threshold, block, size == block)
        kept += got
        later = cut_at.filter("_seq > _cut").select(*keys, "_seq", "_w")
        near = meet(later.withColumn("_limit", F.col("_seq")), reduce(DataFrame.unionByName, got), keys, keys, threshold, block)
        rest, size = staged(_without(later, near, keys), "leader-rest"), size * 2
        if rest.isEmpty():
            break
    out = staged(reduce(DataFrame.unionByName, kept).select(*keys, "_seq").repartitionByRange(*keys, "_seq").withColumn("_part", F.spark_partition_id()), "leaders")
    per = out.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = _prefixed(per.select(*keys, "_part", ahead.alias("_ahead")), [*keys, "_part"], "_a")
    placed = out.join(per, _same([*keys, "_part"], "_a")).withColumn("_at", F.row_number().over(W.partitionBy(*keys, "_part").orderBy("_seq")))
    return placed.select(*keys, F.col("_seq").cast(df.schema[seq].dataType).alias(seq), (F.col("_ahead") + F.col("_at")).cast("int").alias("ordinal"))
