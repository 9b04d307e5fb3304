"""Quality classifier: supervised subword embeddings.

Words and their character 3- to 5-grams (the word's ends are characters of them) are hashed into ``BUCKETS`` vectors. Two more
vectors are marks: one that every text has, and one for each word that only repeats the word before it. A document is the mean
of the vectors of all its words, n-grams and marks; a softmax layer turns it into the odds of the labels. Vectors and layer are
learnt by stochastic gradient descent in numpy.

The vectors are fitted on a bounded sample: of all labelled rows that may teach, the ``SAMPLE`` documents with the smallest hash of
their id. An id labelled both ways teaches its more frequent label (ties: 1), one with several texts its smallest. Workers turn texts into bucket counts, so
one task fits the model on at most ``SAMPLE`` times ``BUCKETS`` pairs of six bytes, whatever the corpus and the length of its texts. With the vectors fixed
the odds are linear in them, so a bucket's vector comes down to one number when a document is scored.

Defined results: a null or empty text has the mark alone, so its score is the mark's; without labelled rows every score is 0.5; rows whose
label is neither 0 nor 1 don't teach; very long texts are read whole, in blocks that end between words; repeated rows are scored alike; an empty
table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import crc_of_id, discard, map_arrow, spread, staged, table

SAMPLE = 4096
BUCKETS = 1 << 16
DIMENSIONS, EPOCHS, RATE = 16, 6, 0.5
GRAMS = (3, 4, 5)
CUT = 0.3
#: Code points of a text that are hashed at a time; a block ends between words.
BLOCK = 1 << 19
SPACE = 32
_gap = re.compile("[ \t\n\x0b\x0c\r]")
#: Fixed value: odd multiplier of the hash of a run of characters, 2^64 over the golden ratio.
MIX = np.uint64(0x9E3779B97F4A7C15)
MARK, AGAIN, MARKS = 0, 1, 2


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in pieces that end at a gap between words."""
    at = 0
    while at < len(text):
        gap = _gap.search(text, at + size)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every word, n-gram and repeated word of the text, as often as it occurs; the first buckets are the marks' alone."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    x = np.full(len(points) + 2, SPACE, np.uint64)
    x[1:-1] = points
    gap = (x == SPACE) | ((x >= 9) & (x <= 13))
    keep = np.concatenate([[True], ~(gap[1:] & gap[:-1])])
    x, gap = np.where(gap, np.uint64(SPACE), x)[keep], gap[keep]
    found, again = [], 0
    if len(x) > 2:
        ends = np.flatnonzero(gap)
        starts, ends = ends[:-1] + 1, ends[1:]
        length = ends - starts
        place = np.arange(len(x)) - np.repeat(np.append(0, ends), np.diff(np.concatenate([[0], ends, [len(x)]])))
        letters = (x + np.uint64(1)) * (place.astype(np.uint64) * MIX | np.uint64(1))
        letters ^= letters >> np.uint64(29)
        words = np.add.reduceat(letters * MIX, starts) + length.astype(np.uint64)
        found.append(words)
        again = np.count_nonzero(words[1:] == words[:-1])
        run = x.copy()
        for n in range(2, max(GRAMS) + 1):
            run = (run[:-1] ^ (run[:-1] >> np.uint64(31))) * MIX + x[n - 1 :]
            if n in GRAMS and len(run):
                inside = np.zeros(len(run), bool)
                for k in range(1, n - 1):
                    inside |= gap[k : k + len(run)]
                found.append(run[~inside] * np.uint64(2 * n + 1))
    if not found:
        return np.empty(0, np.int64)
    h = np.concatenate(found)
    h = (h ^ (h >> np.uint64(32))) * MIX
    own = (h >> np.uint64(33)).astype(np.int64) % (buckets - MARKS) + MARKS
    return np.append(own, np.full(again, AGAIN))


def bucket_counts(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct buckets and how often it has each."""
    total = np.zeros(buckets, np.int64) if len(text) > BLOCK else None
    if total is None:
        return np.unique(np.append(features(text, buckets), MARK), return_counts=True)
    total[MARK] = 1
    for block in blocks(text):
        total += np.bincount(features(block, buckets), minlength=buckets)
    own = np.flatnonzero(total)
    return own, total[own]


@dataclass(frozen=True)
class Model:
    """What each bucket adds to the log odds of label 1 when it is all there is."""

    weight: np.ndarray

    def score(self, text: str) -> float:
        """The share of label 1, from 0 to 1."""
        total, n = float(self.weight[MARK]), 1
        for block in blocks(text):
            own = features(block, len(self.weight))
            total, n = total + float(self.weight[own].sum()), n + len(own)
        odds = max(-700.0, min(700.0, total / n))
        return 1 / (1 + math.exp(-odds))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Descent, a document at a time, with a rate that falls to nothing. The order comes from the seed."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).astype(np.float32)
    layer = np.zeros((2, dimensions), np.float32)
    step, steps = 0, max(1, epochs * len(docs))
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            own, n = docs[i]
            share = n.astype(np.float32)
            share /= share.sum()
            mean = share @ vectors[own]
            odds = layer @ mean
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[labels[i]] -= 1
            now = np.float32(rate * (1 - step / steps))
            back = p @ layer
            layer -= now * np.outer(p, mean)
            # a document's vectors share one gradient; by the square root of its distinct buckets, so that long texts don't stand still
            vectors[own] -= (now * np.sqrt(np.float32(len(own)))) * np.outer(share, back)
            step += 1
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float64))


def teachers(docs: DataFrame, labels: DataFrame, may_teach: Column, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """_id, text and label of the sample: ``sample`` ids at most, each once."""
    ids = labels.filter(may_teach & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.round(F.avg(label_col)).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    told = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id")
    return told.groupBy("_id", "label").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, may_teach: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """The model of the sample's labels. What reaches the driver is one number for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [bucket_counts(t or "", buckets) for t in batch.column(2).to_pylist()]
            cols = [pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["h", "label", "own", "n"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, known = [], []
        for batch in batches:
            known += batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                own, n = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                docs.append((own.astype(np.uint16 if buckets <= 1 << 16 else np.int32), n.copy()))
        weight = fit(docs, known, buckets).weight if docs else np.zeros(buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(weight)], ["bucket", "weight"])

    told = teachers(docs, labels, may_teach, id_col, text_col, label_col, sample).select(F.xxhash64("_id").alias("h"), "label", "text")
    told = staged(map_arrow(told, count, "h long, label int, own array<int>, n array<int>"), "subword-sample")
    rows = map_arrow(told.repartition(1).sortWithinPartitions("h"), train, "bucket long, weight double").collect()
    discard(told)
    weight = np.zeros(buckets)
    for r in rows:
        weight[r["bucket"]] = r["weight"]
    return Model(weight)


def classify(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs with score and predicted; every column of docs stays but ones of these names."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    at = names.index(text_col)
    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array([int(s >= cut) for s in score], pa.int32())], [*names, "score", "predicted"])

    return map_arrow(spread(docs).select(*names), run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(id_col), F.lit(5)) == 0


def op11_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    out = classify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", "predicted")
