"""Language-model scoring by online logistic context mixing over bits.

A text is its words in lower case and one end. Every word is coded in binary decisions, and each decision's probability is
mixed in the logistic domain from several hashed-context predictors, with weights that a gate picks (how often the contexts were seen), and
refined by a table indexed by gate and mixed logit.

*Words.* A Huffman code of the training words has a leaf for each frequent word (``FREQUENT`` at most, none that occurs once) and two for all others:
"new in this text" and "again". One decision is one node of the code's tree, and every decision of every word is mixed. Predictors of a decision: the node alone; the previous word; the endings of the two
previous words; and the text's own earlier decisions at this node, which are counted online, decision by decision. A word that comes again
costs its share of the text's earlier rare words.

*Letters.* A new rare word is spelled in bytes, by a Huffman code of the bytes of the distinct training words: contexts are the last 2, 3
and 5 bytes and all bytes since the word's start. What it costs depends on the word alone, so it is computed once for each distinct
word of the corpus and joined to the texts.

*What the corpus gives.* All counts cover all training texts. Hashed tables have check bits: of the contexts that fall into one
slot the one counted most keeps it. Tables and word counts grow with the corpus's distinct words and nothing caps them; at most the
tables, ``FREQUENT`` words and their code are sent to the workers. Weights and refining tables learn online over all
training texts (letters: over all distinct training words), a mini-batch at a time, each decision predicted before it is learnt
from and without its own count in its slots. Rows are dealt by a hash of their content into groups of about ``GROUP_TOKENS`` tokens (``GROUP_WORDS``
words for letters) that are learnt from side by side, each in an order of its own; their results are averaged by decisions in whole numbers. So
neither the input's partitions nor a task that runs again change a score.

*Scoring* is online too: beside the online counts each text adapts the weights to itself by gradient steps after its first
``FIRST_BLOCK`` words and after blocks that double in length. ``score`` is the log10 probability that the model gives the text,
``bits_per_byte`` says the same a byte of its words with one byte after each.

The base score is a unigram with add-one smoothing; rare words' counts are joined exactly.

Defined results: a null text is an empty one and scores its end alone; a null id hashes as an empty string; rows repeated are scored
alike; without training rows base_score is null and the model knows only its uniform start; very long
texts and words are scored whole, in slices; an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import crc_of_id, discard, map_arrow, shuffles_removed, spread, staged, table

FREQUENT = 1 << 16
NEW, AGAIN = 0, 1
LETTERS = 4
LEAST_BITS = 18
#: Slots for each distinct training word: spelling contexts, then the previous word and the two endings.
SLOTS_A_WORD = (0.25, 1, 2, 4)
WORD_SLOTS_A_WORD = (1, 1)
BLOCK_BITS = 16
KEYS, TOKENS = 1 << 23, 1 << 19
SLICE, TEXTS, TOGETHER = 1 << 16, 256, 1 << 14
#: What one mixer learns from in a row, and how finely its sums are kept.
GROUP_TOKENS, GROUP_WORDS, UNIT = 1 << 18, 1 << 15, 1 << 16
FIRST_BLOCK = 32
OWN_STEP = 0.5
_rng = np.random.default_rng(7)
_odd = lambda n: _rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1)
ODD, POWERS = _odd(8), _odd(64)

#: Counts are kept as a byte: exact up to 32, then 16 steps for each doubling.
VALUES = np.concatenate([np.arange(33.0), 32 * 2 ** (np.arange(1, 224) / 16)]).astype(np.float32)


def quantised(n: np.ndarray) -> np.ndarray:
    return np.where(n <= 32, n, 32 + np.rint(16 * np.log2(np.maximum(n, 32) / 32)).clip(0, 223)).astype(np.uint8)


def slot_bits(shares: tuple[float, ...], distinct: int) -> tuple[int, ...]:
    """Bits of each hashed table: a power of two of slots over its share of the distinct words."""
    return tuple(max(LEAST_BITS, math.ceil(math.log2(max(k * distinct, 1)))) for k in shares)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD[7]
    return h ^ (h >> np.uint64(29))


class Nodes:
    """Hashes of contexts at a code's nodes, for a table of so many bits of slots: with one context the nodes of a row lie in 8 slots side by side."""

    def __init__(self, code: Code, bits: int):
        self.row = mixed(mixed((code.row + 1).astype(np.uint64) * ODD[1]) * ODD[2])
        self.seat = code.seat << np.uint64(64 - bits)

    def hashed(self, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        """context: hashes of the decisions' contexts, which are overwritten."""
        context ^= self.row.take(node, mode="clip")
        context *= ODD[6]
        context ^= self.seat.take(node, mode="clip")
        return context


def place(h: np.ndarray, bits: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and check (1 to 255) of a well-mixed hash."""
    check = np.maximum((h >> np.uint64(24)).astype(np.uint8), 1)
    slot = (h >> np.uint64(64 - bits)).view(np.int64)
    slot += start
    return slot, check


# -- codes --------------------------------------------------------------------------------------


class Code:
    """Huffman code of symbols 0..n-1 with positive counts, its paths cut after ``most`` decisions.

    ``leaf``: each symbol's leaf of the cut tree; ``share``: natural log of its share of what its leaf holds. ``length`` and ``first``
    of each leaf's path, and its ``node`` and ``bit``.
    """

    def __init__(self, counts: np.ndarray, most: int = 1 << 20):
        n = len(counts)
        heap = [(int(c), s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        sums = [int(c) for c in counts]
        while len(heap) > 1:
            (n0, a), (n1, b) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (n0 + n1, n + len(children)))
            children.append((a, b))
            sums.append(n0 + n1)
        self.leaf, self.share, paths = np.zeros(n, np.int64), np.zeros(n), []
        self.nodes = 0
        todo: list[tuple[int, list]] = [(heap[0][1], [])]
        while todo:
            at, path = todo.pop()
            if at >= n and len(path) < most:
                todo += [(child, [*path, (self.nodes, bit)]) for bit, child in enumerate(children[at - n])]
                self.nodes += 1
                continue
            below = [at]
            while below:
                x = below.pop()
                if x >= n:
                    below += children[x - n]
                else:
                    self.leaf[x], self.share[x] = len(paths), math.log(sums[x] / sums[at])
            paths.append(path)
        self.nodes = max(self.nodes, 1)
        self.length = np.array([len(p) for p in paths], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.node = np.array([x for p in paths for x, _ in p], np.int32)
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)
        #: A node's row is the node above it, or itself, at a depth divisible by 3; ``seat`` is its place in the row, which has 7 at most.
        self.row, self.seat = np.zeros(self.nodes, np.int32), np.zeros(self.nodes, np.uint64)
        depth = np.arange(len(self.node)) - np.repeat(self.first, self.length)
        for above in range(3):
            here = np.flatnonzero(depth % 3 == above)
            self.row[self.node[here]] = self.node[here - above]
            self.seat[self.node[here]] = (1, 2, 4)[above] - 1 + sum(self.bit[here - k].astype(np.uint64) << np.uint64(k - 1) for k in range(1, above + 1))

    def spell(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all decisions of the symbols: the symbol's index, node and bit; and the decisions of each symbol."""
        leaf = self.leaf[symbols]
        per = self.length[leaf]
        rep = np.repeat(np.arange(len(symbols), dtype=np.int32), per)
        at = np.arange(len(rep))
        at += (self.first[leaf] - (np.cumsum(per) - per)).take(rep, mode="clip")
        return rep, self.node.take(at, mode="clip"), self.bit.take(at, mode="clip"), per


# -- tables of counts ---------------------------------------------------------------------------


class Table:
    """Counts by slot: two quantised counts as 16 bits, and above them the check of the context that holds the slot."""

    def __init__(self, slots: int):
        self.held = np.zeros(slots, np.uint32)

    def get(self, slot: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Both counts as 16 bits; 0 where another context holds the slot."""
        got = self.held.take(slot, mode="clip")
        mine = got >> np.uint32(16) == check
        got &= np.uint32(0xFFFF)
        got *= mine
        return got


def runs(keys: np.ndarray, weights: np.ndarray | None = None, bits: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs or the sum of its weights, each below 2 ** ``bits``. Without weights the keys are sorted in place."""
    if weights is None:
        keys.sort()
    else:  # as one number, since sorting is much faster than finding an order
        both = keys.astype(np.uint64)
        both <<= np.uint64(bits)
        both |= weights.astype(np.uint64)
        both.sort()
        weights = (both & np.uint64((1 << bits) - 1)).view(np.int64)
        both >>= np.uint64(bits)
        keys = both
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[begin], np.diff(begin, append=len(keys)) if weights is None else np.add.reduceat(weights, begin) if len(begin) else weights[:0]


def packed(slot: np.ndarray, check: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return slot.astype(np.uint64) << np.uint64(9) | check.astype(np.uint64) << np.uint64(1) | bit


def batch_of(cols: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits by significance of their bytes: most high bytes are 0, which compresses well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def block_rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys and their counts as rows (block, data)."""
    shift = np.uint64(BLOCK_BITS + 9)
    edges = np.flatnonzero(np.diff(keys >> shift)) + 1
    block, data, pack = [], [], zstandard.ZstdCompressor(1).compress
    for k, m in zip(np.split(keys, edges), np.split(n, edges)):
        if len(k):
            block.append(int(k[0] >> shift))
            low = (k & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.uint32)
            data.append(pack(planes(np.concatenate([np.diff(low, prepend=np.uint32(0)), m.astype(np.uint32)]))))
    for i in range(0, len(block), 64):
        yield batch_of([block[i : i + 64], data[i : i + 64]], [pa.int32(), pa.binary()], ["block", "data"])


def filled(parts: DataFrame, slots: int, out: Table | None = None) -> Table:
    """Sums the rows (block, data) by key, gives each slot to its heaviest context, and brings the table to the driver.

    The table has ``slots`` slots, set by the number of distinct words; tasks sum the blocks. ``out``: a table that holds other slots already.
    """
    width = 1 << BLOCK_BITS

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: Counter = Counter()
        pack, unpack = zstandard.ZstdCompressor(1).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                both = from_planes(unpack(raw)).reshape(2, -1)
                held.setdefault(block, []).append((np.cumsum(both[0], dtype=np.uint32), both[1].copy()))
                size[block] += both.shape[1]
                if size[block] > 1 << 20 and len(held[block]) > 8:
                    key, n = runs(*(np.concatenate(x) for x in zip(*held.pop(block))), 39)
                    held[block] = [(key.astype(np.uint32), n.astype(np.uint32) if n.max() < 1 << 32 else n)]
                    size[block] = 0
        while held:
            block, pieces = held.popitem()
            both = [np.concatenate(x) for x in zip(*pieces)]
            del pieces
            key, n = runs(*both, 39)
            del both
            context = key >> np.uint64(1)
            begin = np.flatnonzero(np.concatenate([np.ones(1, bool), context[1:] != context[:-1]]))
            ones = np.add.reduceat(np.where(key & np.uint64(1), n, 0), begin)
            total = np.add.reduceat(n, begin)
            slot, check = (context[begin] >> np.uint64(8)).astype(np.int64), (context[begin] & np.uint64(255)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([np.ones(1, bool), slot[1:] != slot[:-1]]))
            rank = total << 8 | check  # distinct in a slot
            best = np.flatnonzero(rank == np.repeat(np.maximum.reduceat(rank, first), np.diff(first, append=len(slot))))
            cells = np.zeros(width, np.uint32)
            cells[slot[best]] = check[best].astype(np.uint32) << 16 | quantised(ones[best]).astype(np.uint32) << 8 | quantised(total[best] - ones[best])
            yield batch_of([[block], [pack(cells.tobytes())]], [pa.int32(), pa.binary()], ["block", "data"])

    merged = staged(map_arrow(parts.repartition("block"), merge, "block int, data binary"), "slots")
    out = out or Table(-(-slots // width) * width)
    unpack = zstandard.ZstdDecompressor().decompress
    for r in merged.toLocalIterator():
        out.held[r["block"] * width :][:width] |= np.frombuffer(unpack(bytes(r["data"])), np.uint32)
    discard(merged)
    return out


# -- the mixer ----------------------------------------------------------------------------------


def seen(n: np.ndarray) -> np.ndarray:
    """Confidence class of a count: never, rarely, some times, often."""
    return ((n > 0).astype(np.uint8) + (n > 2)) + (n > 15)


LOGS = np.log(np.arange(1 << 12, dtype=np.float32) + np.float32(0.4))
_n0, _n1 = np.tile(VALUES, 256), np.repeat(VALUES, 256)
logit = lambda n0, n1: np.log((n1 + 0.05) / (n0 + 0.05)).astype(np.float32)
#: Logit and confidence class of each pair of quantised counts, read as 16 bits; and of the same without one 0 and without one 1.
LOGIT = np.concatenate([logit(_n0, _n1), logit(np.maximum(_n0 - 1, 0), _n1), logit(_n0, np.maximum(_n1 - 1, 0))])
SEEN = np.concatenate([seen(_n0 + _n1), seen(np.maximum(_n0 - 1, 0) + _n1), seen(_n0 + np.maximum(_n1 - 1, 0))])


class Mixer:
    """Weights of ``inputs`` predictors and a bias by gate, and the refining table; ``learn`` is online, a mini-batch at a time."""

    GATES, LEVELS, PRIOR = 64, 33, 16.0

    def __init__(self, inputs: int):
        self.inputs = inputs
        self.w = np.full((inputs + 1, self.GATES), 0.3, np.float32)
        self.w[inputs] = 0
        self.done = np.zeros(self.GATES)
        self.hits, self.total = np.zeros((2, self.GATES * self.LEVELS))
        self.start = np.tile(self.PRIOR / (1 + np.exp(-(np.arange(self.LEVELS) - 16) / 2)), self.GATES)

    def mix(self, st: np.ndarray, gate: np.ndarray) -> np.ndarray:
        x = self.w[self.inputs].take(gate, mode="clip")
        for w, s in zip(self.w, st):
            part = w.take(gate, mode="clip")
            part *= s
            x += part
        return x

    def final(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mixed probability, the refining table's cell and the final probability that the bit is 1."""
        x = np.clip(x, np.float32(-11), np.float32(11))
        p = np.exp(-x)
        p += np.float32(1)
        np.divide(np.float32(1), p, out=p)
        x *= np.float32(2)
        x += np.float32(16.5)
        cell = np.clip(x, np.float32(0), np.float32(self.LEVELS - 1), out=x).astype(np.intp)
        cell += gate * np.int16(self.LEVELS)
        final = ((self.hits + self.start) / (self.total + self.PRIOR)).astype(np.float32).take(cell, mode="clip")
        final += p
        final *= np.float32(0.5)
        return p, cell, np.clip(final, np.float32(2e-5), np.float32(1 - 2e-5), out=final)

    def learn(self, st: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> None:
        """One mini-batch: predict, then update. A gate's step falls with the decisions that it has learnt from."""
        p, cell, _ = self.final(self.mix(st, gate), gate)
        err = bit - p
        n = np.bincount(gate, minlength=self.GATES)
        step = (0.05 + 2 / (1 + self.done / 4000)) / (n + 8)
        for k in range(self.inputs):
            self.w[k] += step * np.bincount(gate, weights=err * st[k], minlength=self.GATES)
        self.w[self.inputs] += step * np.bincount(gate, weights=err, minlength=self.GATES)
        self.done += n
        self.hits += np.bincount(cell, weights=bit, minlength=len(self.hits))
        self.total += np.bincount(cell, minlength=len(self.hits))

    def sums(self) -> np.ndarray:
        """What was learnt, as whole numbers that add up over groups in any order."""
        parts = [(self.w * self.done).ravel(), self.done, self.hits, self.total]
        return np.rint(np.concatenate(parts) * UNIT).astype(np.int64)

    @classmethod
    def averaged(cls, rows: DataFrame, inputs: int) -> Mixer:
        """Of the tasks' rows(at, value); the driver gets a few thousand sums, whatever the corpus."""
        out = cls(inputs)
        flat = np.zeros(out.w.size + len(out.done) + 2 * len(out.hits))
        with shuffles_removed(rows.sparkSession):
            for r in rows.groupBy("at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect():
                flat[r["at"]] = int(r["value"]) / UNIT
        w, out.done, out.hits, out.total = np.split(flat, np.cumsum([out.w.size, len(out.done), len(out.hits)]))
        known = out.done > 0
        out.w[:, known] = (w.reshape(out.w.shape)[:, known] / out.done[known]).astype(np.float32)
        return out


def in_groups(rows: DataFrame, groups: int) -> DataFrame:
    """group and value of rows(value), each group whole in one partition and in an order that only the values decide."""
    dealt = rows.withColumn("h", F.xxhash64("value")).withColumn("group", F.pmod("h", F.lit(groups)))
    return dealt.repartition("group").sortWithinPartitions("group", "h", "value").select("group", "value")


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(group, values) of rows that stand by group: cut where their bytes reach ``most``, wherever batches end."""
    group, held, size = None, [], 0
    for batch in batches:
        for g, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (g != group or size >= most):
                yield group, held
                held, size = [], 0
            group = g
            held.append(v)
            size += len(v) + 1
    if held:
        yield group, held


def learnt(batches: Iterator[pa.RecordBatch], inputs: int, most: int, feed: Callable[[Mixer, list[bytes]], None]) -> Iterator[pa.RecordBatch]:
    """at, value: sums over a task's groups; every group begins with a new mixer."""
    total, mixer, last = 0, None, None
    for group, values in blocks(batches, most):
        if mixer is None or group != last:
            total = total + mixer.sums() if mixer else total
            mixer, last = Mixer(inputs), group
        feed(mixer, values)
    if mixer:
        total = total + mixer.sums()
        yield batch_of([np.arange(len(total)), total], [pa.int32(), pa.int64()], ["at", "value"])


# -- letters ------------------------------------------------------------------------------------


def slices(words: list[bytes], most: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """Ranges of words with about ``most`` bytes."""
    first = total = 0
    for i, w in enumerate(words):
        total += len(w) + 1
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(words):
        yield first, len(words)


class Speller:
    """Decisions of words' bytes, and their hashed contexts inside the word."""

    def __init__(self, code: Code, bits: tuple[int, ...]):
        self.code, self.bits = code, bits
        self.starts = np.cumsum([0, *(1 << b for b in bits)])
        self.nodes = [Nodes(code, b) for b in bits]

    def decisions(self, words: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """(slot, check) for each context, bits, and the number of decisions of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        x = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        begin = np.cumsum(sizes) - sizes
        start = np.repeat(begin, sizes)
        pos = np.arange(len(x)) - start
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * POWERS[pos & 63])])
        whole = (run[:-1] - run[start]) ^ (pos.astype(np.uint64) << np.uint64(56))
        context, so_far = [], np.zeros(len(x), np.uint64)
        for k in range(1, 6):
            c = np.zeros(len(x), np.uint64)
            c[k:] = x[:-k] if k <= len(x) else 0
            c[pos < k] = 0
            so_far = so_far | c << np.uint64(8 * k - 8)
            if k not in (1, 4):
                context.append(so_far)
        rep, node, bit, per = self.code.spell(x)
        found = []
        for k, c in enumerate([*context, whole]):
            h = self.nodes[k].hashed(mixed(mixed((c + np.uint64(1)) * ODD[k]) * ODD[5]).take(rep), node)
            found.append(place(h, self.bits[k], int(self.starts[k])))
        return found, bit, np.add.reduceat(per, begin) if len(words) else per

    def predict(self, table: Table, words: list[bytes], own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits, gate, bits and decisions a word; ``own``: one own count is taken out of the slots."""
        found, bit, per = self.decisions(words)
        less = (bit.astype(np.int32) + 1) << 16 if own else np.int32(0)
        got = [table.get(*f) + less for f in found]
        a, b, c = (SEEN.take(g) for g in got[1:])
        return np.array([LOGIT.take(g) for g in got]), a * np.intp(16) + b * np.intp(4) + c, bit, per


# -- words --------------------------------------------------------------------------------------


class Speech:
    """The code of words, and the hashed contexts of its decisions across words."""

    def __init__(self, code: Code, words: list[bytes], bits: tuple[int, ...]):
        self.code, self.bits = code, bits
        self.starts = np.cumsum([-(-code.nodes // 16) * 16, *(1 << b for b in bits)])
        self.nodes = [Nodes(code, b) for b in bits]
        self.ending = np.array([0, 1, *(zlib.crc32(w[-2:]) % 4093 + 2 for w in words)], np.uint64)
        self.last = words.index(b"") + 2 if b"" in words else NEW

    def contexts(self, ids: np.ndarray, before: tuple[int, int], fresh: np.ndarray, which: tuple[int, ...] = (0, 1)) -> list[np.ndarray]:
        """Of each token, its contexts across words (``which``) as numbers: the word before it, and the endings of the two before it.

        fresh: the tokens that begin a text; ``before``: the two words before the first token.
        """
        one = np.concatenate([[before[1]], ids[:-1]])[: len(ids)]
        two = np.concatenate([[before[0]], one[:-1]])[: len(ids)]
        one[fresh] = self.last
        two[fresh] = self.last
        two[(fresh + 1)[fresh + 1 < len(ids)]] = self.last
        return [self.ending[one] << np.uint64(13) | self.ending[two] if k else one.astype(np.uint64) for k in which]

    @staticmethod
    def hashed(k: int, context: np.ndarray) -> np.ndarray:
        return mixed(mixed((context + np.uint64(1)) * ODD[k + 5]) * ODD[k + 3])

    def at(self, k: int, context: np.ndarray, rep: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot and check of context k (hashed, of each token) at the nodes of decisions; ``rep``: each decision's token."""
        return place(self.nodes[k].hashed(context.take(rep, mode="clip"), node), self.bits[k], int(self.starts[k]))

    def decisions(self, ids: np.ndarray, before: tuple[int, int], fresh: np.ndarray, which: tuple[int, ...] = (0, 1)) -> tuple[np.ndarray, ...]:
        """Token, node and bit of all decisions, and slot and check in those (``which``) of the two contexts across words."""
        rep, node, bit, _ = self.code.spell(ids)
        return rep, node, bit, *(self.at(k, self.hashed(k, c), rep, node) for k, c in zip(which, self.contexts(ids, before, fresh, which)))

    def counted(self, k: int, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of context k at all decisions of some tokens, and how often each occurs. The tokens are sorted by context and place in the
        code's tree, so that a node's decisions lie side by side on each level and no more than distinct pairs go down the tree."""
        code = self.code
        wide = np.uint64(len(code.length).bit_length())
        pair, n = runs(context << wide | code.leaf.take(ids).astype(np.uint64))
        context, leaf = pair >> wide, (pair & ((np.uint64(1) << wide) - np.uint64(1))).view(np.int64)
        h, at, left = self.hashed(k, context), code.first.take(leaf), code.length.take(leaf)
        keys, sums = [], []
        while True:
            live = np.flatnonzero(left)
            if not len(live):
                break
            if len(live) < len(left):
                context, h, n, at, left = context[live], h[live], n[live], at[live], left[live]
            node, bit = code.node.take(at), code.bit.take(at)
            begin = np.flatnonzero(np.concatenate([np.ones(1, bool), (node[1:] != node[:-1]) | (context[1:] != context[:-1])]))
            ones, all_ = np.add.reduceat(n * bit, begin), np.add.reduceat(n, begin)
            slot, check = self.at(k, h, begin, node[begin])
            for value, m in ((0, all_ - ones), (1, ones)):
                some = np.flatnonzero(m)
                keys.append(packed(slot[some], check[some], np.uint64(value)))
                sums.append(m[some])
            at, left = at + 1, left - 1
        return runs(np.concatenate(keys), np.concatenate(sums)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


class Own:
    """The open texts' earlier decisions at each node: counts of 0 and 1 before each decision of a slice."""

    def __init__(self, nodes: int):
        self.nodes = nodes
        self.carry: np.ndarray | None = None

    def before(self, text: np.ndarray, node: np.ndarray, bit: np.ndarray, goes_on: bool) -> tuple[np.ndarray, np.ndarray]:
        """text: of each decision, below ``TEXTS``. ``goes_on``: the slice is part of one long text, and not its last."""
        n = len(node)
        key = text.astype(np.uint64)
        key *= np.uint64(self.nodes)
        key += node.astype(np.uint64)
        key <<= np.uint64(24)
        key |= np.arange(0, 2 * n, 2, dtype=np.uint64)
        key |= bit
        key.sort()
        order = (key & np.uint64(0xFFFFFF)).view(np.int64)
        b = (order & 1).astype(np.int32)
        order >>= 1
        key >>= np.uint64(24)
        ones = np.cumsum(b, dtype=np.int32)
        ones -= b
        opens = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), key[1:] != key[:-1]]))
        per = np.diff(opens, append=n)
        ones -= np.repeat(ones[opens], per)
        n1, n0 = np.empty((2, n), np.int32)
        n1[order] = ones
        zeros = np.arange(n, dtype=np.int32)
        zeros -= np.repeat(opens.astype(np.int32), per)
        zeros -= ones
        n0[order] = zeros
        if self.carry is not None:
            n0 += self.carry[0][node]
            n1 += self.carry[1][node]
        if goes_on:
            more = np.bincount(node * 2 + bit, minlength=2 * self.nodes).reshape(-1, 2).T.astype(np.int32)
            self.carry = more if self.carry is None else self.carry + more
        else:
            self.carry = None
        return n0, n1


def text_slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(first text, end text, first token, end token, goes on): up to ``TEXTS`` whole texts and ``TOGETHER`` tokens together, or one text of up
    to ``most`` tokens; longer texts in parts."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        at = int(ends[i] - sizes[i])
        if sizes[i] > most:
            for k in range(at, int(ends[i]), most):
                end = min(k + most, int(ends[i]))
                yield i, i + 1, k, end, bool(end < ends[i])
            i += 1
            continue
        j = i
        while j < min(len(sizes), i + TEXTS) and (j == i or ends[j] - at <= min(most, TOGETHER)):
            j += 1
        yield i, j, at, int(ends[j - 1]), False
        i = j


def own_logit(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logit of the text's own counts."""
    if max(n0.max(initial=0), n1.max(initial=0)) < len(LOGS):
        out = LOGS.take(n1, mode="clip")
        out -= LOGS.take(n0, mode="clip")
        return out
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))


class Reader:
    """Predicts the decisions of texts, slice by slice."""

    def __init__(self, speech: Speech, table: Table, most: int = SLICE):
        self.speech, self.table, self.most = speech, table, most
        self.own = Own(speech.code.nodes)

    def slices(self, ids: np.ndarray, sizes: np.ndarray, own: bool, by_block: bool = False) -> Iterator[tuple]:
        """first text, end text, goes on; of each token its text, block and decisions; of each decision its logits, gate and bit. ``own``: one own
        count is taken out of the slots. ``by_block``: tokens stand by their block of doubling length, else as in the texts."""
        begin = np.cumsum(sizes) - sizes
        speech, table = self.speech, self.table
        for i, j, at, end, goes_on in text_slices(sizes, self.most):
            starts = begin[i:j] - at
            before = (int(ids[at - 2]), int(ids[at - 1])) if at > begin[i] else (speech.last,) * 2
            piece = ids[at:end]
            context = [speech.hashed(k, c) for k, c in enumerate(speech.contexts(piece, before, starts[starts >= 0]))]
            text = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(np.append(np.maximum(starts, 0), end - at)))
            block = None
            if by_block:
                block = np.frexp(((np.arange(at, end) - begin[i:j][text]) // FIRST_BLOCK + 1).astype(np.float32))[1].astype(np.uint8)
                order = np.argsort(block, kind="stable")
                piece, text, block = piece[order], text[order], block[order]
                context = [c[order] for c in context]
            rep, node, bit, per = speech.code.spell(piece)
            n0, n1 = self.own.before(text.take(rep), node, bit, goes_on)
            st = np.empty((4, len(node)), np.float32)
            gate = seen(n0 + n1)
            less = (bit.astype(np.uint32) + np.uint32(1)) << np.uint32(16) if own else None
            for k in range(3):
                got = table.get(*speech.at(k - 1, context[k - 1], rep, node)) if k else table.held.take(node)
                if own:
                    got += less
                np.take(LOGIT, got, out=st[k], mode="clip")
                if k:
                    gate += SEEN.take(got, mode="clip") << np.uint8(2 * k)
            st[3] = own_logit(n0, n1)
            yield i, j, goes_on, text, block, per, st, gate, bit


class Scorer:
    """Natural log probability of texts; the weights adapt to each text."""

    def __init__(self, reader: Reader, mixer: Mixer):
        self.reader, self.mixer = reader, mixer

    def texts(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes))
        carried = None
        for i, j, goes_on, text, block, tokens, st, gate, bit in self.reader.slices(ids, sizes, own=False, by_block=True):
            own = carried if carried is not None else np.zeros((len(st) + 1, j - i), np.float32)
            opens = np.append(0, np.cumsum(tokens))
            turn = np.flatnonzero(np.concatenate([np.ones(min(1, len(text)), bool), (text[1:] != text[:-1]) | (block[1:] != block[:-1])]))
            starts, whose, blocks = opens[turn], text[turn], block[turn]
            full = np.diff(starts, append=len(bit)) > 0  # words of a code of one leaf have no decision
            starts, whose, blocks = starts[full], whose[full], blocks[full]
            edges = np.append(np.flatnonzero(np.diff(blocks, prepend=0)), len(blocks))
            for u, v in zip(edges, edges[1:]):
                at = slice(int(starts[u]), int(starts[v]) if v < len(starts) else len(bit))
                mine, begin = whose[u:v], starts[u:v] - at.start
                s, g, t = st[:, at], gate[at], bit[at]
                per = np.diff(begin, append=len(t))
                y = self.mixer.mix(s, g)
                if blocks[u] > 1 or carried is not None:
                    for k in range(len(st)):
                        y += np.repeat(own[k][mine], per) * s[k]
                    y += np.repeat(own[-1][mine], per)
                p, _, final = self.mixer.final(y, g)
                final += t
                final -= np.float32(1)
                out[i + mine] += np.add.reduceat(np.log(np.abs(final, out=final), out=final), begin, dtype=np.float64)
                err = t - p
                step = OWN_STEP / (per + 64).astype(np.float32)
                for k in range(len(st)):
                    own[k, mine] += step * np.add.reduceat(s[k] * err, begin)
                own[-1, mine] += step * np.add.reduceat(err, begin)
            carried = own if goes_on else None
        return out


# -- from texts to tokens -----------------------------------------------------------------------


ANY_BYTES = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts (binary), each once, the empty word last; each token's word as an index, text by text with an end after each; and the
    tokens of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.cast(pc.fill_null(texts, b""), options=ANY_BYTES)))
    flat, edges = lists.flatten(), lists.offsets.to_numpy()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at a text's ends cuts empty words off
    if not real.all():
        edges = np.append(0, np.cumsum(real))[edges]
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    words = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([b""], pa.binary())])
    sizes = np.diff(edges).astype(np.int64) + 1
    codes = np.insert(coded.indices.to_numpy().astype(np.int64), edges[1:] - edges[0], len(words) - 1)
    return words, codes, sizes


def count_words(docs: DataFrame) -> DataFrame:
    """word, n (in the texts that teach) over all of docs(text, teaches); the empty word counts the texts' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, codes, sizes = cut(batch.column(0).cast(pa.binary()))
            teaches = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(bool), sizes)
            n = pa.array(np.bincount(codes[teaches], minlength=len(words)))
            for i in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([words[i : i + 20_000], n[i : i + 20_000]], ["word", "n"])
        pa.default_memory_pool().release_unused()

    return map_arrow(docs, run, "word binary, n long", rows=1 << 11).groupBy("word").agg(F.sum("n").alias("n"))


def byte_counts(words: DataFrame) -> np.ndarray:
    """How often each byte stands in words(word) and their ends: 256 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b" ".join([*batch.column(0).to_pylist(), b""]), np.uint8), minlength=256)
        yield batch_of([range(256), total], [pa.int32(), pa.int64()], ["byte", "n"])

    out = np.zeros(256, np.int64)
    for r in map_arrow(words.select("word"), run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def least_frequent(counts: DataFrame, most: int) -> int:
    """The count, 2 or more, from which on at most ``most`` words are frequent; a histogram of a few thousand cells tells it.

    Words that occur once stay rare: they tell how often a word is new."""
    cell = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    found = counts.filter("n > 1").groupBy(cell.alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, held = (1 << 63) - 1, 0
    for r in sorted(found, key=lambda r: -r["n"]):
        held += r["words"]
        if held > most:
            break
        least = r["n"]
    return least


def tokenised(docs: DataFrame, often: dict[bytes, int], code: Code) -> DataFrame:
    """row, id, teaches, n_tokens, n_known and base (of frequent words), n_bytes, fixed (natural log probability of words within their leaves
    and of what comes again), ids (symbols, as bytes of int32) and rare (its distinct rare words with their times) of docs(id, text, teaches), written once."""
    spark = docs.sparkSession
    log_counts = np.log10(np.fromiter(often.values(), float, len(often)) + 1)
    sent = spark.sparkContext.broadcast((pa.array(often, pa.binary()), np.concatenate([[0.0, 0.0], log_counts]), code.share))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, logs, share = sent.value
        for batch in batches:
            words, codes, sizes = cut(batch.column(1).cast(pa.binary()))
            number = pc.fill_null(pc.index_in(words, frequent), -2).to_numpy().astype(np.int32) + np.int32(2)
            ids = number.take(codes)
            lengths = pc.binary_length(words).to_numpy().astype(np.int64).take(codes)
            begin = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(ids == 0)
            rid = codes[at]
            mine = owner[at]
            key = mine * len(words) + rid
            order = np.argsort(key, kind="stable")
            opens = np.concatenate([np.ones(min(1, len(at)), bool), np.diff(key[order]) != 0])
            first = np.flatnonzero(opens)
            times = np.diff(first, append=len(at))
            rank = np.empty(len(at))
            rank[order] = np.arange(len(at)) - np.repeat(first, times)
            so_far = np.arange(len(at)) - np.searchsorted(mine, mine)
            again = rank > 0
            ids[at[again]] = AGAIN
            fixed = np.bincount(mine[again], weights=np.log(rank[again] / so_far[again]), minlength=len(sizes)) + np.add.reduceat(share[ids], begin)
            known = ids > AGAIN
            words = words.take(pa.array(rid[order][first]))
            at = np.searchsorted(mine[order][first], np.arange(len(sizes) + 1))
            rare = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([words, pa.array(times, pa.int64())], ["word", "n"]))
            raw, ends = ids.tobytes(), (np.append(begin, len(ids)) * 4).tolist()
            tokens = pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
            sums = lambda x: np.add.reduceat(x, begin)
            cols = (sizes, sums(known.astype(np.int64)), sums(logs[ids]), sums(lengths) + sizes, fixed)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
            got = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *got, tokens, rare], ["id", "teaches", "n_tokens", "n_known", "base", "n_bytes", "fixed", "ids", "rare"])
        pa.default_memory_pool().release_unused()

    schema = f"id {kind}, teaches boolean, n_tokens long, n_known long, base double, n_bytes long, fixed double, ids binary, rare array<struct<word:binary,n:long>>"
    return staged(map_arrow(docs.select("id", "text", "teaches"), run, schema).withColumn("row", F.monotonically_increasing_id()), "tokens")


def flat_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of texts, and each text's number."""
    return np.frombuffer(b"".join(texts), np.int32).astype(np.int64), np.fromiter(map(len, texts), np.int64, len(texts)) // 4


# -- training -----------------------------------------------------------------------------------


def train_letters(words: DataFrame, distinct: int) -> tuple[Speller, Table, Mixer]:
    """Over all distinct training words(word), each counted once: new words are like other words, not like other tokens."""
    sc = words.sparkSession.sparkContext
    speller = Speller(Code(byte_counts(words) + 1), slot_bits(SLOTS_A_WORD, distinct))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, size = [], 0
        for batch in batches:
            words = batch.column(0).to_pylist()
            for i, j in slices(words, 1 << 15):
                found, bit, _ = speller.decisions(words[i:j])
                keys += [packed(*f, bit) for f in found]
                size += len(found) * len(bit)
                if size >= KEYS:
                    held, keys, size = np.concatenate(keys), [], 0
                    yield from block_rows(*runs(held))
        if keys:
            yield from block_rows(*runs(np.concatenate(keys)))

    table = filled(map_arrow(words.select("word"), count, "block int, data binary", rows=1 << 16), int(speller.starts[-1]))
    sent = sc.broadcast(table)

    def feed(mixer: Mixer, held: list[bytes]) -> None:
        for i, j in slices(held):
            st, gate, bit, _ = speller.predict(sent.value, held[i:j], own=True)
            for k in range(0, len(bit), 8192):
                s = slice(k, k + 8192)
                mixer.learn(st[:, s], gate[s], bit[s].astype(np.float32))

    rows = in_groups(words.select(F.col("word").alias("value")), distinct // GROUP_WORDS + 1)
    mixer = Mixer.averaged(map_arrow(rows, lambda x: learnt(x, LETTERS, 1 << 16, feed), "at int, value long"), LETTERS)
    sent.destroy()
    return speller, table, mixer


def code_of_words(often: dict[bytes, int], total: int) -> Code:
    """Rare words are taken to come again one time in eight; what they do is counted at the code's nodes."""
    others = max(total - sum(often.values()), 0)
    return Code(np.array([others - others // 8 + 1, others // 8 + 1, *often.values()]))


def train_words(tokens: DataFrame, often: dict[bytes, int], code: Code, distinct: int) -> tuple[Speech, Table, Mixer]:
    """Over all texts that teach."""
    sc = tokens.sparkSession.sparkContext
    speech = Speech(code, list(often), slot_bits(WORD_SLOTS_A_WORD, distinct))
    taught = tokens.filter("teaches").select("ids")

    def count(batches: Iterator[pa.RecordBatch], which: int) -> Iterator[pa.RecordBatch]:
        alone = np.zeros(len(code.length), np.int64)
        held, size = [], 0
        for batch in batches:
            ids, sizes = flat_ids(batch.column(0).to_pylist())
            context = speech.contexts(ids, (speech.last,) * 2, np.cumsum(sizes) - sizes, (which,))[0]
            if which == 0:
                alone += np.bincount(code.leaf[ids], minlength=len(alone))
            for at in range(0, len(ids), TOKENS):
                held.append((context[at : at + TOKENS], ids[at : at + TOKENS]))
                size += len(held[-1][1])
                if size >= TOKENS:
                    yield from block_rows(*speech.counted(which, *(np.concatenate(x) for x in zip(*held))))
                    held, size = [], 0
        if held:
            yield from block_rows(*speech.counted(which, *(np.concatenate(x) for x in zip(*held))))
        times = np.repeat(alone, code.length)
        both = np.bincount(code.node * 2 + code.bit, weights=times, minlength=2 * code.nodes).astype(np.int64)
        at = np.flatnonzero(both)
        yield from block_rows((at.astype(np.uint64) >> np.uint64(1)) << np.uint64(9) | (at & 1).astype(np.uint64), both[at])

    # one context after the other, so that only one's counts lie on disk
    table = None
    for which in (0, 1):
        table = filled(map_arrow(taught, lambda x, which=which: count(x, which), "block int, data binary"), int(speech.starts[-1]), table)
    sent = sc.broadcast(table)

    def feed(mixer: Mixer, texts: list[bytes]) -> None:
        reader = Reader(speech, sent.value)
        ids, sizes = flat_ids(texts)
        for *_, st, gate, bit in reader.slices(ids, sizes, own=True):
            for k in range(0, len(bit), 16384):
                s = slice(k, k + 16384)
                mixer.learn(st[:, s], gate[s], bit[s].astype(np.float32))

    groups = (tokens.filter("teaches").agg(F.sum("n_tokens")).first()[0] or 0) // GROUP_TOKENS + 1
    rows = in_groups(taught.select(F.col("ids").alias("value")), groups)
    mixer = Mixer.averaged(map_arrow(rows, lambda x: learnt(x, 4, 4 * SLICE, feed), "at int, value long"), 4)
    sent.destroy()
    return speech, table, mixer


# -- scoring ------------------------------------------------------------------------------------


def spelled(rare: DataFrame, speller: Speller, table: Table, mixer: Mixer) -> DataFrame:
    """word, n and cost (natural log probability of its bytes) of rare(word, n)."""
    sent = rare.sparkSession.sparkContext.broadcast((speller, table, mixer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, table, mixer = sent.value
        for batch in batches:
            words, costs = batch.column(0).to_pylist(), [np.empty(0)]
            for i, j in slices(words):
                st, gate, bit, per = speller.predict(table, words[i:j], own=False)
                p = mixer.final(mixer.mix(st, gate), gate)[2]
                costs.append(np.add.reduceat(np.log(np.abs(p + bit - 1), dtype=np.float64), np.cumsum(per) - per))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.concatenate(costs))], ["word", "n", "cost"])

    return map_arrow(rare.select("word", "n"), run, "word binary, n long, cost double")


def said(tokens: DataFrame, speech: Speech, table: Table, mixer: Mixer) -> DataFrame:
    """tokens without ids and rare, and with ln: the natural log probability of the texts' symbols."""
    sent = tokens.sparkSession.sparkContext.broadcast((speech, table, mixer))
    names = ["row", "id", "n_tokens", "n_known", "base", "n_bytes", "fixed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speech, table, mixer = sent.value
        scorer = Scorer(Reader(speech, table), mixer)
        for batch in batches:
            ln = scorer.texts(*flat_ids(batch.column(len(names)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(ln, pa.float64())], [*names, "ln"])

    picked = tokens.select(*names, "ids")
    kinds = ", ".join(f"{n} {picked.schema[n].dataType.simpleString()}" for n in names)
    return map_arrow(picked, run, f"{kinds}, ln double")


def score(docs: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for every row."""
    picked = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(teaches, F.lit(False)).alias("teaches"))
    counts = staged(count_words(picked.select("text", "teaches")), "word-counts")
    total, distinct = counts.filter("n > 0").agg(F.sum("n"), F.count(F.lit(1))).first()
    total, least = total or 0, least_frequent(counts, frequent)
    often = {bytes(r["word"]): r["n"] for r in counts.filter(F.col("n") >= least).collect()}
    often = dict(sorted(often.items(), key=lambda x: (-x[1], x[0])))
    rare = counts.filter(F.col("n") < least)
    code = code_of_words(often, total)
    tokens = tokenised(picked, often, code)
    speller = train_letters(counts.filter("n > 0 AND word <> X''"), distinct)
    costs = staged(spelled(rare, *speller), "spelled")
    pieces = tokens.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("k"))
    hit = pieces.join(costs, "word").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum("cost").alias("cost")
    )
    hit = staged(hit, "rare-words")
    discard(counts, costs)
    full = staged(said(tokens, *train_words(tokens, often, code, distinct)).join(hit, "row", "left"), "scored")
    discard(tokens, hit)
    lowest = math.log10(total + distinct + 1) if total else None
    none = F.lit(0.0)
    result = (F.col("ln") + F.col("fixed") + F.coalesce("cost", none)) / math.log(10)
    return full.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", none) - F.col("n_tokens") * F.lit(lowest).cast("double")).alias("base_score"),
        result.alias("score"),
        (-result * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(id_col), F.lit(7)) == 2


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
