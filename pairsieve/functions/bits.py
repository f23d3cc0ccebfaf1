"""Bits, packed words, hashes, frame and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .channel import as_col

WORD_BITS = 64


def word_index(pos: Column) -> Column:
    return F.floor(pos / WORD_BITS)


def packed_word(bit: Column, pos: Column) -> Column:
    """Aggregate: little-endian 64-bit word of the bits whose positions share a word."""
    return F.bit_or(F.call_function("shiftleft", bit.cast("bigint"), (pos % WORD_BITS).cast("int")))


def unpack_bit(word: Column, offset: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, offset.cast("int")).bitwiseAND(F.lit(1).cast("bigint"))


def hamming_words(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def packed_byte(bit: Column, pos: Column) -> Column:
    """Aggregate: big-endian byte of the bits whose positions share a byte."""
    return F.bit_or(F.call_function("shiftleft", bit.cast("int"), (7 - pos % 8).cast("int")))


def bit_bytes(text: Column) -> Column:
    """String of 0/1 characters to one byte (0x00 or 0x01) per bit."""
    return F.unhex(bit_hex(text))


def bit_hex(text: Column) -> Column:
    """String of 0/1 characters to two hex digits per bit."""
    return F.regexp_replace(text, "([01])", "0$1")


def le64_hex(number: Column) -> Column:
    """16 hex digits of a non-negative number, little-endian byte order."""
    digits = F.lpad(F.hex(number.cast("bigint")), 16, "0")
    return F.lower(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8))]))


def commit(nonce: Column, data: Column) -> Column:
    """sha256 over nonce followed by data (both binary)."""
    return F.sha2(F.concat(nonce, data), 256)


def block_hash_hex(payload_hex: Column, seed: Column) -> Column:
    """First 8 digest bytes of sha256(payload, seed as 8 little-endian bytes), as hex in digest order."""
    return F.substring(F.sha2(F.unhex(F.concat(payload_hex, le64_hex(seed))), 256), 1, 16)


HMAC_BLOCK = 64


def hmac_sha256(key_hex: Column, message_hex: Column) -> Column:
    """HMAC-SHA256 of hex input for keys of at most 64 bytes, as hex.

    A key byte k is xor-ed with the fixed pads 0x36 and 0x5c by table: the
    key is cut in bytes, each mapped through ``conv``.
    """

    def padded(pad: int) -> Column:
        full = F.rpad(key_hex, 2 * HMAC_BLOCK, "0")
        return F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.lit(HMAC_BLOCK - 1)),
                lambda i: F.lpad(
                    F.hex(
                        F.conv(F.substr(full, 2 * i + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(pad)).cast("bigint")
                    ),
                    2,
                    "0",
                ),
            ),
            "",
        )

    inner = F.sha2(F.unhex(F.concat(padded(0x36), message_hex)), 256)
    return F.sha2(F.unhex(F.concat(padded(0x5C), inner)), 256)


def masked_tag(digest_hex: Column, bits: int) -> Column:
    """Low ``bits`` (at most 56) of the leading digest bytes read little-endian."""
    if not 1 <= bits <= 56:
        raise ValueError("bits must be in 1..56")
    nbytes = (bits + 7) // 8
    le = F.concat(*[F.substring(digest_hex, 2 * i + 1, 2) for i in reversed(range(nbytes))])
    return F.conv(le, 16, 10).cast("bigint").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


HASH_PRIME = 2**61 - 1


def polynomial_hash(bit_array: Column, seed: int, bits: int = 50) -> Column:
    """acc = acc * base + bit (mod 2^61 - 1) over one block, lowest ``bits``.

    Products stay below 2^122, inside DECIMAL(38,0). Blocks are at most one
    frame (4,096 bits) long.
    """
    prime = F.lit(str(HASH_PRIME)).cast("decimal(20,0)")
    base = F.lit(str(seed % HASH_PRIME + 1)).cast("decimal(19,0)")
    folded = F.aggregate(
        bit_array,
        F.lit("0").cast("decimal(20,0)"),
        lambda acc, b: ((acc.cast("decimal(19,0)") * base + b) % prime).cast("decimal(20,0)"),
    )
    return folded.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def shortening_bits(n_shortened: Column, frame: Column | int) -> Column:
    """Disclosure of s known bits in a frame: s * log2(frame / s)."""
    frame, s = as_col(frame), n_shortened.cast("double")
    return F.when((s > 0) & (frame > s), s * F.log2(frame / s)).otherwise(F.lit(0.0))


LLR_CLAMP = 1e-6
LLR_KNOWN = 100.0


def channel_llr(bit: Column, qber: Column, punctured: Column) -> Column:
    q = F.least(F.lit(0.5 - LLR_CLAMP), F.greatest(F.lit(LLR_CLAMP), qber))
    return F.when(punctured, F.lit(0.0)).otherwise((1 - 2 * bit) * F.log((1 - q) / q))


def three_state_llr(bit: Column, qber: Column, punctured: Column, shortened: Column, known: Column) -> Column:
    """Punctured 0, known bits +-100, received bits +-ln((1-q)/q), or +-2 if q is out of range."""
    alpha = F.when((qber <= 0) | (qber >= 0.5), F.lit(2.0)).otherwise(F.log((1 - qber) / qber))
    return (
        F.when(punctured, F.lit(0.0))
        .when(shortened, F.when(known == 0, F.lit(LLR_KNOWN)).otherwise(F.lit(-LLR_KNOWN)))
        .otherwise(F.when(bit == 0, alpha).otherwise(-alpha))
    )


def state_llr(pos: Column, bit: Column, qber: Column, payload: Column, n_shortened: Column) -> Column:
    """Payload positions by channel, then shortened (+100), then punctured (0)."""
    q = F.least(F.lit(0.5 - LLR_CLAMP), F.greatest(F.lit(LLR_CLAMP), qber))
    return (
        F.when(pos < payload, (1 - 2 * bit) * F.log((1 - q) / q))
        .when(pos < payload + n_shortened, F.lit(LLR_KNOWN))
        .otherwise(F.lit(0.0))
    )


def basis_label(basis: Column) -> Column:
    return F.when(basis == 0, "Z").otherwise("X")


def percent_label(lo: Column, hi: Column) -> Column:
    return F.format_string("%d%%-%d%%", F.bround(lo * 100).cast("int"), F.bround(hi * 100).cast("int"))
