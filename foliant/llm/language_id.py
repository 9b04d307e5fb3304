"""Language identification by rank-order profiles.

A profile is the list of a language's ``PROFILE`` most frequent n-grams (1 to 3 letters, words padded with one
space at both ends), most frequent first. A document's own list is compared with every profile by
out-of-place distance: each of its n-grams costs the difference between the two ranks, or ``PROFILE``
where the profile lacks it. The nearest language wins, ties by name. The score is 1 minus the
distance as a share of the largest possible.

Profiles are learnt from all rows that may teach, not from a sample: workers count n-grams and Spark sums the
counts. Words are cut at whatever is neither letter nor mark, in lower case.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing could be learnt;
rows with a null language never teach; texts are read whole; repeated rows are judged alike; an empty table
gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import crc_of_id, discard, map_arrow, spread, staged, table

PROFILE = 400
UNKNOWN = "und"
#: A task's counts are handed on and begun anew beyond this many n-grams; the sums stay the same.
FLUSH = 1_000_000
SPACE = 32


@cache
def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: itself in lower case if it is a letter or a mark, else a space; and whether it is a letter."""
    kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    low = [ord(chr(c).lower()[0]) if k in "LM" else SPACE for c, k in enumerate(kind)]
    return np.array(low, np.int64), np.array([k == "L" for k in kind])


def grams(text: str) -> np.ndarray:
    """Every 1- to 3-gram of the text's words, packed 21 bits a letter, so codes order as strings of one length do.

    Words are one space apart; n-grams reach from a word to the spaces at its ends, never into the next word.
    """
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    low, is_letter = letter_table()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    if not is_letter[points].any():
        return np.empty(0, np.int64)
    x = np.full(len(points) + 2, SPACE)
    x[1:-1] = low[points]
    gap = x == SPACE
    x = x[np.concatenate([[True], ~(gap[1:] & gap[:-1])])]
    letter = x != SPACE
    two = x[:-1] << 21 | x[1:]
    three = (two[:-1] << 21 | x[2:])[letter[1:-1]]
    return np.concatenate([x[letter], two, three])


def ranked(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """Distinct codes by falling count, ties by code."""
    items, n = np.unique(codes, return_counts=True)
    return items[np.argsort(-n, kind="stable")[:most]]


def learn(docs: DataFrame, may_teach: Column, text_col: str = "text", lang_col: str = "lang", most: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language. ``most`` rows for each language reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in totals.items():
                for i in range(0, len(codes), 50_000):
                    part = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes[part]), pa.string()), pa.array(codes[part]), pa.array(n[part])], ["lang", "code", "n"])
            totals.clear()

        for batch in batches:
            texts: dict[str, list[str]] = defaultdict(list)
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts[lang].append(text)
            for lang, held in texts.items():
                codes, n = np.unique(grams(" ".join(held)), return_counts=True)
                if lang in totals:
                    was, m = totals[lang]
                    all_codes, at = np.unique(np.concatenate([was, codes]), return_inverse=True)
                    codes, n = all_codes, np.bincount(at, weights=np.concatenate([m, n])).astype(np.int64)
                totals[lang] = codes, n
            if sum(len(codes) for codes, _ in totals.values()) > FLUSH:
                yield from hand_on()
        yield from hand_on()

    taught = spread(docs).filter(may_teach).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sums = staged(map_arrow(taught, run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "language-grams")
    cut = lambda *by: W.partitionBy("lang", *by).orderBy(F.desc("n"), "code")
    best = sums.withColumn("s", F.pmod(F.hash("code"), F.lit(64))).withColumn("r", F.row_number().over(cut("s"))).filter(F.col("r") <= most)
    best = best.withColumn("r", F.row_number().over(cut())).filter(F.col("r") <= most).select("lang", "code", "r").collect()
    discard(sums)
    out: dict[str, list] = defaultdict(list)
    for r in sorted(best, key=lambda r: (r["lang"], r["r"])):
        out[r["lang"]].append(r["code"])
    return {lang: np.array(codes, np.int64) for lang, codes in out.items()}


class Profiles:
    """All profiles as one table: a row for each n-gram of any of them, a rank for each language."""

    def __init__(self, profiles: dict[str, np.ndarray], most: int = PROFILE):
        self.langs, self.most = sorted(profiles), most
        self.codes = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)  # last: not in any
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def nearest(self, mine: np.ndarray) -> tuple[str, float]:
        """(language, score) of a document's ranked n-grams."""
        if not len(mine) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, mine)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != mine] = len(self.codes)
        rank = self.ranks[at]
        out_of_place = np.where(rank < 0, self.most, np.abs(rank - np.arange(len(mine))[:, None])).sum(0)
        best = int(out_of_place.argmin())
        return self.langs[best], float(1 - out_of_place[best] / (self.most * len(mine)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; every column of docs stays."""
    table_of = Profiles(profiles)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text_col)
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [table_of.nearest(ranked(grams(t or ""))) for t in batch.column(at).to_pylist()]
            more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "lang_pred", "score"])

    return map_arrow(spread(docs).select(*names), run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(id_col), F.lit(4)) == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs, ~held_out())
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")
