"""Quality rules: Jensen-Shannon distance of a document's histograms from language references.

References are taken from the whole corpus, from documents that pass the base rules: for each language, the share of every character class
and of its ``COMMON`` most frequent words (words without a letter, and all other words, are two more bins). A language is a reference
only with ``MIN_TEXTS`` different texts and ``MIN_REFERENCE_WORDS`` words or more, so a stray label makes none. A document is compared with every
reference and its nearest one counts; its language column serves only to take the document's own counts out of the reference that it
taught. Distances are square roots of the divergence in bits, from 0 to 1. Guards: the character histogram speaks only from ``MIN_CHARS``
characters in words on, the word histogram from ``MIN_WORDS`` words on.

Base rules come first: fewer than 10 words, or over 20 % of the words inside repeated 5-word
windows, fail.

Defined results: null texts have no words and fail; rows without a language teach nothing; without
any reference the method keeps; very long texts are read whole; repeated rows are judged alike; an empty table gives
no rows; columns of other names are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import discard, map_arrow, spread, staged, table

MIN_WORDS, MIN_CHARS = 40, 200
COMMON = 40
MIN_TEXTS, MIN_REFERENCE_WORDS = 20, 2000
CLASS_LIMIT, WORD_LIMIT = 0.28, 0.42
#: A task's word table is handed on and begun anew at this many entries; the sums stay the same.
FLUSH = 200_000
CLASSES = ("lower", "upper", "other_letter", "digit", "space", "punctuation", "symbol", "control")
#: Words without a letter are one bin of the word histogram; a byte over 127 counts as part of a letter.
NO_LETTER = b""
_letter = re.compile(rb"[A-Za-z\x80-\xff]").search
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@cache
def class_table() -> np.ndarray:
    """Class number of every code point."""
    of = {"Ll": 0, "Lu": 1, "Lt": 1, "Nd": 3, "Zs": 4, "Zl": 4, "Zp": 4}
    main = {"L": 2, "M": 2, "N": 3, "P": 5, "S": 6, "C": 7}
    cats = [unicodedata.category(chr(c)) for c in range(0x110000)]
    out = np.array([of.get(k, main.get(k[0], 7)) for k in cats], np.uint8)
    out[[9, 10, 11, 12, 13]] = 4
    out[[ord(c) for c in SYMBOLS]] = 6
    return out


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.bincount(class_table()[points], minlength=len(CLASSES))


def learn(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, kind (class or word), item, n: sums over every row that has a language and a text and passes the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
        words: dict[str, Counter] = defaultdict(Counter)

        def rows(kind: str, got: list) -> pa.RecordBatch:
            cols = list(zip(*got)) or [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array([kind] * len(got), pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())],
                ["lang", "kind", "item", "n"],
            )

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, c in words.items():
                bare = [w for w in c if not _letter(w)]
                c[NO_LETTER] = sum(c.pop(w) for w in bare)
                items = list(c.items())
                for i in range(0, len(items), 20_000):
                    yield rows("word", [(lang, w, n) for w, n in items[i : i + 20_000]])
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = text.encode().split()
                if not base_fails(len(held), repeated_words(held)):
                    classes[lang] += class_counts(text)
                    words[lang].update(held)
            if sum(map(len, words.values())) > FLUSH:
                yield from hand_on()
        yield from hand_on()
        yield rows("class", [(lang, CLASSES[i].encode(), int(n)) for lang, v in classes.items() for i, n in enumerate(v)])

    known = spread(docs).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    parts = map_arrow(known, run, "lang string, kind string, item binary, n long")
    return parts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


@dataclass
class Reference:
    """A language's counts: of classes; and of its common words, words without a letter and all others."""

    classes: np.ndarray
    words: list[bytes]
    counts: np.ndarray


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON) -> dict[str, Reference]:
    """Of each language with enough texts and words. What reaches the driver is the class counts, and ``common`` words with two totals, for each."""
    sums = staged(learn(docs, text_col, lang_col), "quality-sums")
    words = sums.filter("kind = 'word'")
    bare = {r["lang"]: r["n"] for r in words.filter("item = X''").collect()}
    rank = W.partitionBy("lang").orderBy(F.desc("n"), "item")
    # first the best of each slice, so that no task orders a whole language
    sliced = W.partitionBy("lang", "_s").orderBy(F.desc("n"), "item")
    best = words.filter("item <> X''").withColumn("_s", F.pmod(F.hash("item"), F.lit(64))).withColumn("_r", F.row_number().over(sliced)).filter(F.col("_r") <= common)
    best = best.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= common).select("lang", "item", "n", "r").collect()
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    texts = docs.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.approx_count_distinct(F.xxhash64(text_col), 0.02).alias("n")).filter(F.col("n") >= MIN_TEXTS)
    enough = {r["lang"] for r in texts.collect() if totals.get(r["lang"], 0) >= MIN_REFERENCE_WORDS}
    out = {lang: Reference(np.zeros(len(CLASSES)), [], np.zeros(0)) for lang in sorted(enough)}
    for r in sums.filter("kind = 'class'").collect():
        if r["lang"] in out:
            out[r["lang"]].classes[CLASSES.index(r["item"].decode())] = r["n"]
    held: dict[str, list[int]] = defaultdict(list)
    for r in sorted(best, key=lambda r: (r["lang"], r["r"])):
        if r["lang"] in out:
            out[r["lang"]].words.append(bytes(r["item"]))
            held[r["lang"]].append(r["n"])
    for lang, ref in out.items():
        ref.counts = np.array([*held[lang], bare.get(lang, 0), totals[lang] - bare.get(lang, 0) - sum(held[lang])], float)
    discard(sums)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits; the rows of q may be many."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


class Rules:
    """The references, laid out for one pass over a document."""

    def __init__(self, refs: dict[str, Reference]):
        self.place_of = {lang: k for k, lang in enumerate(refs)}
        self.classes = np.array([r.classes for r in refs.values()])
        self.words = list(dict.fromkeys(w for r in refs.values() for w in r.words))
        at = {w: i for i, w in enumerate(self.words)}
        self.own = [np.array([at[w] for w in r.words], int) for r in refs.values()]
        self.counts = [r.counts for r in refs.values()]

    def distances(self, classes: np.ndarray, counts: Counter, n_words: int, taught: str | None) -> tuple[float, float]:
        """Of the nearest reference: by character classes, by common words. ``taught``: the language that the document taught."""
        if not self.counts:
            return 0.0, 0.0
        mine = self.place_of.get(taught, -1)
        refs = self.classes
        if mine >= 0:
            refs = refs.copy()
            refs[mine] -= classes
        by_class = float(js_distance(classes / max(1, classes.sum()), refs / np.maximum(1, refs.sum(1, keepdims=True))).min())
        seen = np.fromiter(map(counts.get, self.words, [0] * len(self.words)), float, len(self.words))
        bare = sum(n for w, n in counts.items() if not _letter(w))
        by_word = 1.0
        for k, (own, ref) in enumerate(zip(self.own, self.counts)):
            held = np.append(seen[own], [bare, n_words - bare - seen[own].sum()])
            ref = ref - held if k == mine else ref
            by_word = min(by_word, float(js_distance(held / max(1, n_words), ref / max(1, ref.sum()))))
        return by_class, by_word


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window which occurs twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == n:
        return 0
    count = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + 5 - max(i, end)
            end = i + 5
    return covered


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, the base counts, base_failed, class_distance, word_distance and kept, for every row."""
    rules = Rules(references(docs, text_col, lang_col))
    kind = docs.schema[id_col].dataType.simpleString()
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    schema = f"id {kind}, {counts}, base_failed boolean, class_distance double, word_distance double, kept boolean"
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                teaches, text = text is not None, text or ""
                words = text.encode().split()
                n, repeats = len(words), repeated_words(words)
                chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
                failed = base_fails(n, repeats)
                by_class, by_word = rules.distances(class_counts(text), Counter(words), n, lang if teaches and not failed else None)
                fits = (chars < MIN_CHARS or by_class <= CLASS_LIMIT) and (n < MIN_WORDS or by_word <= WORD_LIMIT)
                out.append((n, chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats, failed, by_class, by_word, fits and not failed))
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names)

    picked = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return map_arrow(picked, run, schema).withColumnRenamed("id", id_col)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
