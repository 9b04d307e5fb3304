"""Average hashes as arrays of 64-bit words; any number of bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rec. 709 luma weights.
LUMA = (0.2126, 0.7152, 0.0722)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def mean(values: Column) -> Column:
    """Mean of an array, summed in order as double."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(values)


def hash_bits(values: Column) -> Column:
    """Array of 0/1: is the value strictly above the mean? A flat image gives zeros."""
    return F.zip_with(values, F.array_repeat(mean(values), F.size(values)), lambda v, m: (v.cast("double") > m).cast("int"))


def bits_to_words(bits: Column, n: int) -> Column:
    """n bits as ceil(n/64) words; bit i of the hash is bit i % 64 of word i // 64."""

    def word(k: int) -> Column:
        part = F.slice(bits, k * 64 + 1, min(64, n - k * 64))
        return F.aggregate(
            F.transform(part, lambda b, i: F.call_function("shiftleft", b.cast("long"), i)), F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v)
        )

    return F.array(*[word(k) for k in range(-(-n // 64))])


def bit_string(bits: Column) -> Column:
    """The bits as text, first bit first."""
    return F.array_join(bits.cast("array<string>"), "")


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two word arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def hash_hex(words: Column) -> Column:
    """Words as 16 hexadecimal digits each, highest word first."""
    return F.lower(F.array_join(F.transform(F.reverse(words), lambda w: F.lpad(F.hex(w), 16, "0")), ""))
