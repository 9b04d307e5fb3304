"""Spelling variants: words of a corpus that differ by one code point, each led to its most frequent near word.

Workers count runs of letters (``LETTERS``, A-Z lower-cased) a document at a time, and Spark sums the counts. The words that
occur often enough are the vocabulary; each has a rank in code-point order, which stands for it from then on.

Near words are found without a row for any pair. A word of L code points is in L wildcard groups (position, prefix, suffix):
words of one group differ in that position alone, so a group's size and its two first words by frequency say all there is to
say about replacements. For insertions and deletions each distinct deletion of a word meets the vocabulary word that it spells:
the longer words count and lead the shorter one as a group, and each of them gains the shorter one. Both kinds of groups are
windows over one shuffle. A group has at most as many words as the alphabet has letters (wildcards), or that times L + 1
(deletions), whatever the corpus, so no group is hot.

Groups are keyed by two polynomial hashes of the word with the position blanked or deleted, modulo two pairs of primes below
2^31 (123 bits in all), so a row has a fixed size and a word of any length costs memory in proportion to its length; that two
groups fall together is less likely than a failing memory chip.

A root is reached by doubling: each round lets every word point as far again. A form is at least ``factor`` times as frequent as its
word, so chains are short and have no rings.

Defined results: null and empty texts have no words; a null id is written as the empty string; very long texts are read in blocks; repeated
rows count each; an empty table, or one without a word frequent enough, gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import LOWER, UPPER, discard, map_arrow, spread, staged, table

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
#: Where this divides crc32 of ``id:run``, the run loses one code point.
SLIP = 199
#: Code points of a text that are cut into runs at a time.
BLOCK = 1 << 20
#: A task's counts are handed on and begun anew at this many words; the sums stay the same.
FLUSH = 200_000
#: Letters of words whose groups are written at a time.
GROUP_LETTERS = 1 << 18
_run = re.compile(LETTERS)
_lower = str.maketrans(UPPER, LOWER)
#: Primes below 2^31, each with the base of its polynomial.
FIELDS = ((2147483647, 1103515245), (2147483629, 1566083941), (2147483587, 1812433253), (2147483579, 1664525013))


def runs(text: str, block: int = BLOCK) -> Iterator[list[str]]:
    """The runs of letters of the text, a block of it at a time; no run is cut."""
    at = 0
    while at < len(text):
        end = at + block
        over = _run.match(text, end)
        end = over.end() if over else end
        yield _run.findall(text, at, end)
        at = end


def slipped(key: str, run: str, start: int) -> str:
    """The run, or what a slip leaves of it. ``start``: crc32 of the id and a colon."""
    h = zlib.crc32(run.encode(), start)
    if h % SLIP:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """word, n: occurrences over all documents of the words of at least ``min_length`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_on() -> Iterator[pa.RecordBatch]:
            words = list(held.items())
            for i in range(0, len(words), 20_000):
                cols = list(zip(*words[i : i + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{key}:".encode())
                for found in runs(text or ""):
                    for w, n in Counter(found).items():
                        if len(w) >= min_length:
                            w = slipped(key, w.translate(_lower), start)
                            if len(w) >= min_length:
                                held[w] += n
                    if len(held) > FLUSH:
                        yield from hand_on()
        yield from hand_on()

    picked = spread(docs).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return map_arrow(picked, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counted: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """The frequent words as a staged table: word, n and rank, from 0 in code-point order. Ranges of words are ranked side by side."""
    ranged = counted.filter(F.col("n") >= min_count).repartitionByRange("word").withColumn("_part", F.spark_partition_id())
    ranged = staged(ranged, "spelling-words")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    firsts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy("word"))
    out = staged(ranged.join(F.broadcast(firsts), "_part").select("word", "n", (F.col("_first") + inside - 1).alias("rank")), "spelling-ranks")
    discard(ranged)
    return out


def group_keys(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length, a row each: hashes of the word, of it with each position blanked, with each position deleted, all as
    [half, word(, position)] in 62 bits; and whether a deletion is the first with its result."""
    m, length = points.shape
    whole, blank, gone = np.zeros((2, m), np.int64), np.zeros((2, m, length), np.int64), np.zeros((2, m, length), np.int64)
    c = points.astype(np.int64)
    for f, (p, base) in enumerate(FIELDS):
        power = np.ones(length + 1, np.int64)
        for k in range(length):
            power[k + 1] = power[k] * base % p
        term = c * power[length - 1 :: -1][:length] % p  # what each letter adds to the hash of the whole word
        total = term.sum(1) % p
        prefix, suffix = np.zeros((m, length), np.int64), np.zeros((m, length), np.int64)
        for k in range(1, length):
            prefix[:, k] = (prefix[:, k - 1] * base + c[:, k - 1]) % p
            suffix[:, length - 1 - k] = (suffix[:, length - k] + term[:, length - k]) % p
        half, shift = f % 2, 31 * (f // 2)
        whole[half] |= total << shift
        blank[half] |= (total[:, None] - term) % p << shift
        gone[half] |= (prefix * power[length - 1 :: -1][:length] + suffix) % p << shift
    first = np.ones((m, length), bool)
    first[:, 1:] = c[:, 1:] != c[:, :-1]
    return whole, blank, gone, first


#: Places of a group's key that are no position: a word as a whole, met by deletions.
WHOLE = -1


def groups(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """at, one, two (a group's key), whole (the row is the word that deletions spell), rank, n: a row for each group that a word is in."""
    names = ["at", "one", "two", "whole", "rank", "n"]

    def rows(held: list[str], rank: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        m, length = len(held), len(held[0])
        points = np.frombuffer("".join(held).encode("utf-32-le"), "<u4").reshape(m, length)
        whole, blank, gone, first = group_keys(points)
        own = np.repeat(np.arange(m), length)
        at = np.tile(np.arange(length, dtype=np.int32), m)
        yield batch(np.full(m, WHOLE, np.int32), whole, True, rank, n)
        yield batch(at, blank.reshape(2, -1), False, rank[own], n[own])
        if length > min_length:
            keep = first.ravel()
            yield batch(np.full(keep.sum(), WHOLE, np.int32), gone.reshape(2, -1)[:, keep], False, rank[own][keep], n[own][keep])

    def batch(at: np.ndarray, key: np.ndarray, whole: bool, rank: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(key[0]), pa.array(key[1]), pa.array(np.full(len(at), whole)), pa.array(rank), pa.array(n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, list[int]] = defaultdict(list)
            texts = b.column(0).to_pylist()
            for i, w in enumerate(texts):
                by[len(w)].append(i)
            n, rank = b.column(1).to_numpy(), b.column(2).to_numpy()
            for length, own in by.items():
                step = max(1, GROUP_LETTERS // length)
                for i in range(0, len(own), step):
                    some = own[i : i + step]
                    yield from rows([texts[k] for k in some], rank[some], n[some])

    return map_arrow(words.select("word", "n", "rank"), run, "at int, one long, two long, whole boolean, rank long, n long")


def near(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """rank, n_near, best (n and rank of the most frequent near word, ties to the smaller; null if none), for every word."""
    key = W.partitionBy("at", "one", "two").orderBy("whole", F.desc("n"), "rank")
    every = key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    entry = F.struct((-F.col("n")).alias("less"), "rank")
    seen = groups(words, min_length).select(
        "at", "whole", "rank",
        F.count(F.lit(1)).over(every).alias("size"),
        F.first(entry).over(every).alias("top"),
        F.nth_value(entry, 2).over(every).alias("next"),
        F.last("whole").over(every).alias("spelt"),
        F.last(entry).over(every).alias("last"),
    )
    wildcard, others = F.col("at") != WHOLE, F.col("size") > 1
    gains = seen.filter("whole OR (at <> -1 AND size > 1) OR (at = -1 AND spelt)").select(
        "rank",
        F.when(wildcard | F.col("whole"), F.col("size") - 1).otherwise(1).alias("near"),
        F.when(wildcard & (F.col("top.rank") == F.col("rank")), F.col("next"))
        .when(wildcard | (F.col("whole") & others), F.col("top"))
        .when(~F.col("whole"), F.col("last"))
        .alias("best"),
    )
    return gains.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (rank, form) as a staged table with root, the end of the chain of forms from each."""
    now = staged(forms.select("rank", F.col("form").alias("root")), "spelling-chains")
    while True:
        onward = now.select(F.col("rank").alias("root"), F.col("root").alias("_to"))
        then = staged(now.join(onward, "root", "left").select("rank", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")), "spelling-chains")
        discard(now)
        now = then
        if now.filter("_moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = vocabulary(counts(docs, id_col, text_col, min_length), min_count)
    known = words.join(near(words, min_length), "rank")
    best = (-F.col("best.less")) >= F.col("n") * factor
    known = staged(known.select("rank", "word", "n", "n_near", F.when(best, F.col("best.rank")).alias("form"), F.when(best, -F.col("best.less")).alias("form_n")), "spelling-near")
    chains = roots(known.filter("form IS NOT NULL").select("rank", "form"))
    word_of = lambda name: words.select(F.col("rank").alias(name), F.col("word").alias(f"{name}_word"))
    led = known.join(chains.select("rank", "root"), "rank", "left").join(word_of("form"), "form", "left").join(word_of("root"), "root", "left")
    return led.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: crc32 has no function in the oracle; it is built there from its table, which a rule gives.
OP12_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) r(i))
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT)),
         lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295)::BIGINT AS h
  FROM runs, crc_table
), left_over AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM left_over WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), cuts AS (
  SELECT word, n, i, substring(word, 1, i - 1) AS p, substring(word, i + 1) AS s FROM places
), gone AS (
  SELECT DISTINCT word, n, p || s AS rest FROM cuts
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION ALL SELECT g.word, w.word, w.n FROM gone g JOIN words w ON w.word = g.rest
  UNION ALL SELECT w.word, g.word, g.n FROM gone g JOIN words w ON w.word = g.rest
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN other END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), chains AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT word, form, arg_max(root, steps) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
FROM formed JOIN chains USING (word) GROUP BY word, form
"""
