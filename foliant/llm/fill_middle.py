"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and put out in another order between sentinels.

One Aho-Corasick automaton scans a text for events: the sentinels, and the ASCII characters at which the class of a unit
changes. Between two events lies a gap, whose units follow from its length (``EACH``: a unit a character; ``ONE``: one unit),
so the events alone, and no list of units, tell where the unit of any rank ends. Units tile the text; with code points as
units no character changes the class, and the only events are sentinels.

Cuts and form are drawn from the SHA-256 of seed and id, so reruns and other partitions agree. Sentinels may not overlap, or
one could arise where a piece meets a sentinel; such a list raises.

Defined results: a null text is an empty one, and an empty text stays plain, as does a text that holds a sentinel; a null id
counts as the empty string; very long texts are cut whole, in memory of a few times their size; repeated rows come out alike;
an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import map_arrow, spread, table

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
EACH, ONE, ENDED = "each", "one", "ended"


@dataclass(frozen=True)
class Units:
    """``changes``: ASCII characters that change the class. ``gap``: what lies between two of them is a unit a character
    (``EACH``), one unit (``ONE``; the changing character is a unit too), or one unit with the changing character at its end
    (``ENDED``)."""

    changes: str = ""
    gap: str = EACH


CODE_POINTS = Units()
WORDS = Units(" \t\n\x0b\x0c\r", ONE)
LINES = Units("\n", ENDED)


class Scanner:
    """The automaton, and rank lookup on what it finds."""

    def __init__(self, units: Units = CODE_POINTS, sentinels: tuple[str, ...] = SENTINELS):
        clash = any(a[-k:] == b[:k] for a in sentinels for b in sentinels for k in range(1, min(len(a), len(b)) + (a != b)))
        if not all(sentinels) or clash or any(a != b and a in b for a in sentinels for b in sentinels) or len(set(sentinels)) < len(sentinels):
            raise ValueError(f"sentinels overlap: {sentinels}")
        self.units, self.sentinels = units, sentinels
        self.automaton = ahocorasick.Automaton()
        for c in units.changes:
            self.automaton.add_word(c, -1)
        for k, s in enumerate(sentinels):
            self.automaton.add_word(s, k)
        self.automaton.make_automaton()

    def events(self, text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Places of the characters that change the class; (sentinel, start) of each sentinel."""
        changes, found = [], []
        for end, k in self.automaton.iter(text):
            if k < 0:
                changes.append(end)
            else:
                found.append((k, end + 1 - len(self.sentinels[k])))
        return np.array(changes, np.int64), found

    def ranks(self, length: int, changes: np.ndarray) -> Ranks:
        return Ranks(self.units, length, changes)


class Ranks:
    """Gaps and events in turn, with the units up to each."""

    def __init__(self, units: Units, length: int, changes: np.ndarray):
        self.each = units.gap == EACH
        ends = np.empty(2 * len(changes) + 1, np.int64)
        ends[0:-1:2], ends[1::2], ends[-1] = changes, changes + 1, length
        size = np.diff(ends, prepend=0)
        if not self.each:
            size = np.minimum(size, 1)
            if units.gap == ENDED:
                size[:-1:2] = 0  # such a gap is part of the event's unit
        self.ends, self.upto = ends, np.cumsum(size)
        self.n = int(self.upto[-1])

    def end_of(self, rank: int) -> int:
        """Where the first ``rank`` units end, in code points."""
        if not rank:
            return 0
        k = int(np.searchsorted(self.upto, rank))
        return int(self.ends[k] - (self.upto[k] - rank)) if self.each else int(self.ends[k])


def draws(id_col: str, seed: int) -> list[Column]:
    """Four whole numbers of 32 bits for each row, from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    first: int = 0
    second: int = 0


def cut(scanner: Scanner, text: str, h: tuple[int, int, int, int], plain_percent: int, spm_percent: int) -> Cut:
    """Number of units, form, and the places where prefix and middle end."""
    changes, found = scanner.events(text)
    ranks = scanner.ranks(len(text), changes)
    if not text or found or h[2] % 100 >= 100 - plain_percent:
        return Cut(ranks.n, PLAIN)
    low, high = sorted((h[0] % (ranks.n + 1), h[1] % (ranks.n + 1)))
    return Cut(ranks.n, SPM if h[3] % 100 < spm_percent else PSM, ranks.end_of(low), ranks.end_of(high))


def arranged(text: str, c: Cut, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    p, s, m = sentinels
    if c.form == PLAIN:
        return text
    prefix, middle, suffix = text[: c.first], text[c.first : c.second], text[c.second :]
    return "".join((p, prefix, s, suffix, m, middle) if c.form == PSM else (s, suffix, p, prefix, m, middle))


def rebuilt(scanner: Scanner, output: str, form: str) -> str:
    """The text again, from what the automaton finds in the output."""
    if form == PLAIN:
        return output
    found = scanner.events(output)[1]
    order = [0, 1, 2] if form == PSM else [1, 0, 2]
    if [k for k, _ in found] != order or found[0][1]:
        raise ValueError(f"not an output of form {form}")
    ends = [at for _, at in found[1:]] + [len(output)]
    pieces = {k: output[at + len(scanner.sentinels[k]) : end] for (k, at), end in zip(found, ends)}
    return pieces[0] + pieces[2] + pieces[1]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, units: Units = CODE_POINTS, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """id_col, n (units), form, prefix_chars, middle_chars (null if plain) and output, for every row."""
    Scanner(units, sentinels)  # what is wrong with the sentinels is said here, not by a worker
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(units, sentinels)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cuts = [cut(scanner, t, h, plain_percent, spm_percent) for t, *h in zip(texts, *(batch.column(k).to_pylist() for k in range(2, 6)))]
            lengths = lambda of: pa.array([None if c.form == PLAIN else of(c) for c in cuts], pa.int64())
            cols = [pa.array([c.n for c in cuts], pa.int64()), pa.array([c.form for c in cuts], pa.string()), lengths(lambda c: c.first), lengths(lambda c: c.second - c.first), pa.array([arranged(t, c, sentinels) for t, c in zip(texts, cuts)], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    picked = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *draws(id_col, seed))
    return map_arrow(picked, run, schema).withColumnRenamed("id", id_col)


def restore(made: DataFrame, units: Units = CODE_POINTS, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """made with a column ``restored``: the text rebuilt from output and form alone. An output that is not of its form raises."""
    names = [c for c in made.columns if c != "restored"]
    schema = made.select(*names).schema.add("restored", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(units, sentinels)
        for batch in batches:
            held = zip(*(batch.column(names.index(c)).to_pylist() for c in ("output", "form")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([rebuilt(scanner, *x) for x in held], pa.string())], [*names, "restored"])

    return map_arrow(made.select(*names), run, schema)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restore(transform(table(spark, sf_dir, "documents")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


OP13_SQL = """
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS two,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS three, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS four
  FROM base
), cut AS (
  SELECT doc_id, text, n,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR three >= 90 THEN 'plain'
              WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(one, two) AS a, greatest(one, two) AS b
  FROM drawn
), pieces AS (
  SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM cut
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM pieces
"""
