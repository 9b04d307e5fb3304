"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

*Lookahead.* Merges run in rank order, so what follows a place in the text can only change tokens left of it
through a chain of merges of rising rank, each of which takes in the token just left of the last changed
boundary. ``sufficient_lookahead`` finds the longest such chain in the merge list: tokens that end at
least that many symbols before the end of what has been read never change, and are emitted. A pre-token of any
length is thus encoded in a window of fixed size.

*Decoding.* ``Decoder`` is an incremental state machine from ids to UTF-8 bytes to text; an
incomplete character waits in the state for its next bytes.

Words between white space are encoded once and kept in a bounded table. Texts are cut into blocks at white
space; beside the row itself, memory holds one block and one word, and digests are fed block by block. (A caller who asks for a
text's ids or decoded text gets them whole.)

Defined results: null texts count as empty; an empty text has no ids and decodes to an empty text; special tokens' strings
in a text are special tokens; repeated rows give repeated results; an empty table gives no rows; other columns are ignored. Letters and digits are
those of this machine's Unicode tables: characters that are newer than the tokenizers library's tables
may be cut otherwise.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import map_arrow, spread, table

#: Unicode's White_Space characters: what the pre-tokenizer's \s means.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BLOCK = 1 << 20
MOST_WORDS = 200_000
LONGEST_KEPT = 64


def byte_symbols() -> list[str]:
    """The printable stand-in for every byte, by the published byte-level rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """A merge list with word ends, read from a tokenizer's JSON."""

    def __init__(self, spec: str | bytes):
        d = json.loads(spec)
        m = d["model"]
        self.vocab: dict[str, int] = m["vocab"]
        self.suffix: str = m.get("end_of_word_suffix") or ""
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ", 1)) for x in m["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.special = {x["content"]: x["id"] for x in d.get("added_tokens", [])}
        self.pieces = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.symbols = byte_symbols()
        missing = [s for s in self.symbols if s not in self.vocab or s + self.suffix not in self.vocab]
        if missing:
            raise ValueError(f"no token for the bytes of {missing[:5]}")
        pattern = next(x["pattern"]["Regex"] for x in d["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(pattern.replace("\\s", SPACE))
        self.split = regex.compile(f"[{SPACE}]+").split
        self.last_space = regex.compile(f"(?r)[{SPACE}]")
        self.next_space = regex.compile(f"[{SPACE}]")
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda w: [w]
        self.mark = next(iter(set.intersection(*map(set, self.special))), "") if self.special else "\n"
        self.known: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        self.raw = {t: i.to_bytes(4, "little") for t, i in {**self.vocab, **self.special}.items()}

    @cached_property
    def lookahead(self) -> int:
        return sufficient_lookahead(self.rank, self.suffix)

    # -- one pre-token ------------------------------------------------------------------------

    def merge(self, parts: list[str]) -> list[str]:
        """All merges of a finished sequence of symbols, lowest rank first, leftmost first."""
        if len(parts) > 48:
            return self._merge_long(parts)
        rank, none = self.rank, len(self.rank)
        ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n, rank = len(parts), self.rank
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], list(parts)
        heap = [(r, i, alive[i], alive[i + 1]) for i in range(n - 1) if (r := rank.get((alive[i], alive[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] == a else -1
            if j < 0 or alive[j] != b:
                continue
            alive[i], alive[j], after[i] = a + b, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (r := rank.get((alive[left], alive[right]))) is not None:
                    heapq.heappush(heap, (r, left, alive[left], alive[right]))
        return [x for x in alive if x]

    def stream(self, token: str) -> Iterator[bytes]:
        """The ids of one pre-token, as bytes of int32, once they are stable; holds lookahead + 1,024 symbols at most."""
        symbols, raw, full = self.symbols, self.raw, self.lookahead + 1024
        window: list[str] = []
        for i in range(0, len(token), 1024):
            window += [symbols[b] for b in token[i : i + 1024].encode()]
            if len(window) > full:
                settled, end = 0, len(window) - 1 - self.lookahead  # the last symbol may yet end the word
                for t in self.merge(window[:-1]):
                    if settled + len(t) > end:
                        break
                    yield raw[t]
                    settled += len(t)
                del window[:settled]
        window[-1] += self.suffix
        yield from [raw[t] for t in self.merge(window)]

    # -- words and texts ----------------------------------------------------------------------

    def normalise(self, word: str) -> str:
        if word.isascii():
            return word.lower()
        return "".join(c.lower() for c in unicodedata.normalize("NFC", word))

    def token(self, token: str) -> bytes:
        got = b"".join(self.stream(token))
        if len(token) <= LONGEST_KEPT:
            if len(self.tokens) >= MOST_WORDS:
                self.tokens.clear()
            self.tokens[token] = got
        return got

    def word(self, word: str) -> bytes:
        """The ids of what stands between white space, as bytes of int32; short words come from the bounded table."""
        known, out = self.tokens, []
        for part in self.find_special(word) if self.mark in word else [word]:
            if part in self.special:
                out.append(self.raw[part])
            else:
                out += [known.get(t) or self.token(t) for t in self.pattern.findall(self.normalise(part))]
        ids = b"".join(out)
        if len(word) <= LONGEST_KEPT:
            if len(self.known) >= MOST_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def blocks(self, text: str) -> Iterator[str]:
        """The text cut at white space, about BLOCK characters at a time."""
        at = 0
        while len(text) - at > BLOCK:
            m = self.last_space.search(text, at, at + BLOCK) or self.next_space.search(text, at + BLOCK)
            cut = m.end() if m else len(text)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as bytes of int32, block by block."""
        known = self.known
        for block in self.blocks(text):
            words = [w for w in self.split(block) if w] if self.odd(block) else block.split()
            yield b"".join([known.get(w) or self.word(w) for w in words])

    @staticmethod
    def odd(block: str) -> bool:
        """Python's split() also cuts at U+001C..U+001F, which are not white space here."""
        return "\x1c" in block or "\x1d" in block or "\x1e" in block or "\x1f" in block


def sufficient_lookahead(rank: dict[tuple[str, str], int], suffix: str = "") -> int:
    """Symbols of context after which no token further left can change.

    reach[t] is how far left of a token t's start a change that begins there can go with merges of a rank above
    the present one. Going through the merges from the last to the first, merge (x, d) lets a change at the start of
    d, or of any token that d grew from on its left, go on to the start of x.
    """
    size = lambda t: len(t.removesuffix(suffix)) if suffix else len(t)
    made = {}
    for (a, b), r in rank.items():
        if max(made.get(a, -1), made.get(b, -1)) >= r:
            raise ValueError(f"merge {r} uses a token that a later merge makes")
        made.setdefault(a + b, r)
    left = {a + b: a for (a, b) in rank}
    reach: dict[str, int] = {}
    most = max((size(t) for t in made), default=1)
    for x, d in sorted(rank, key=rank.get, reverse=True):
        far = size(x) + reach.get(x, 0)
        most = max(most, far + size(d))
        while d is not None:
            if reach.get(d, 0) < far:
                reach[d] = far
            d = left.get(d)
    return most


class Decoder:
    """Ids to text, piece by piece.

    ``surface``: the tokens' own strings, joined by a space, as a tokenizer without a decoder gives them.
    Otherwise byte stand-ins turn back into bytes and word ends into a space.
    """

    def __init__(self, bpe: Bpe, surface: bool = True):
        byte = {s: b for b, s in enumerate(bpe.symbols)}
        turn = lambda t: bytes(byte[c] for c in t.removesuffix(bpe.suffix)) + b" " * t.endswith(bpe.suffix)
        of = {i: t.encode() if surface or t in bpe.special else turn(t) for i, t in bpe.pieces.items()}
        self.of = [of.get(i, b"") for i in range(max(of) + 1)]
        self.gap = b" " if surface else b""
        self.start()

    def start(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        got = self.gap.join(map(self.of.__getitem__, ids))
        if got and self.begun:
            got = self.gap + got
        self.begun |= bool(got)
        return self.state.decode(got)

    def end(self) -> str:
        out = self.state.decode(b"", True)
        self.start()
        return out

    def pieces(self, blocks: Iterable[bytes], step: int = 1 << 16) -> Iterator[str]:
        """The text, piece by piece, of ids that come as blocks of int32."""
        for block in blocks:
            ids = np.frombuffer(block, "<i4")
            for i in range(0, len(ids), step):
                yield self.feed(ids[i : i + step].tolist())
        yield self.end()

    def text(self, ids: np.ndarray, step: int = 1 << 16) -> str:
        return "".join(self.pieces([ids.astype("<i4").tobytes()], step))


_loaded: dict[int, tuple[Bpe, Decoder, Digest]] = {}


def _loaded_once(spec: bytes, surface: bool) -> tuple[Bpe, Decoder, Digest]:
    key = hash((spec, surface))
    if key not in _loaded:
        bpe = Bpe(spec)
        _loaded[key] = bpe, Decoder(bpe, surface), Digest(bpe)
    return _loaded[key]


class Digest:
    """SHA-256 of decimal ids joined by a space, and of the decoded text, fed piece by piece."""

    def __init__(self, bpe: Bpe):
        self.decimal = [b"%d" % i for i in range(max(bpe.pieces) + 1)]

    def of(self, blocks: Iterable[bytes], decoder: Decoder, step: int = 1 << 16) -> tuple[int, str, str]:
        """Number of ids and both digests; holds one block of ids and one piece of text at a time."""
        n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
        for block in blocks:
            ids = np.frombuffer(block, "<i4")
            for i in range(0, len(ids), step):
                part = ids[i : i + step].tolist()
                ids_sha.update((b" " if n else b"") + b" ".join(map(self.decimal.__getitem__, part)))
                text_sha.update(decoder.feed(part).encode())
                n += len(part)
        text_sha.update(decoder.end().encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", surface: bool = True, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """id_col and the ``outputs`` for every row: ids, decoded (text), n_tokens, ids_sha256, decoded_sha256.

    Counts and digests are fed block by block, so that without ids and decoded a text of any length is coded in constant memory
    beside the row itself. The tokenizer file is read once on the driver and sent to the workers; its size is the vocabulary's,
    whatever the corpus.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType
    types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
    whole = "ids" in outputs or "decoded" in outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, decoder, digest = _loaded_once(spec.value, surface)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                blocks = bpe.encode(text or "")
                held = [b"".join(blocks)] if whole else blocks
                row = dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), digest.of(held, decoder))) if set(outputs) - {"ids", "decoded"} else {}
                if whole:
                    row |= {"ids": np.frombuffer(held[0], "<i4"), "decoded": "".join(decoder.pieces(held)) if "decoded" in outputs else None}
                rows.append(row)
            cols = [pa.array([r[o] for r in rows], types.get(o, pa.string())) for o in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", *outputs])

    picked = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_arrow(picked, run, ", ".join([f"id {kind.simpleString()}", *(f"{o} {OUTPUTS[o]}" for o in outputs)]))
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs."""
    return tokenize(docs, tokenizer_path, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_tokenizer())
