"""Digests, hex, ids and bit prefixes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hexify(data: Column) -> Column:
    """Upper-case hex digits of a binary value."""
    return F.hex(data)


def dehexify(digits: Column) -> Column:
    """Bytes of hex digits; null for a bad digit or an odd number of them."""
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(digits))


def content_element(text: Column) -> Column:
    """MD5 of a text in upper-case hex: the element that sets of records hold."""
    return F.upper(F.md5(text))


def big_endian(data: Column) -> Column:
    """Bytes, at most seven, as an unsigned number, first byte highest."""
    return F.conv(F.hex(data), 16, 10).cast("bigint")


def to_big_endian(number: Column, size: int) -> Column:
    """A number as ``size`` bytes, highest first."""
    return F.unhex(F.lpad(F.hex(number), 2 * size, "0"))


def fit_bytes(data: Column, size: int) -> Column:
    """Bytes cut to ``size``, or filled up with zeros on the right."""
    return F.rpad(data, size, F.lit(b"\x00"))


def fingerprint_v4(body: Column) -> Column:
    """SHA-1 over the byte 0x99, the length in two bytes and the body, in upper-case hex."""
    return F.upper(F.sha1(F.concat(F.lit(b"\x99"), to_big_endian(F.octet_length(body), 2), body)))


def fingerprint_v3(modulus: Column, exponent: Column) -> Column:
    """MD5 over the bytes of modulus and exponent, in upper-case hex."""
    return F.upper(F.md5(F.concat(modulus, exponent)))


def pretty_fingerprint(digits: Column) -> Column:
    """40 digits in groups of four, 32 in groups of two, with a wider gap in the middle; others as they are."""
    wide = F.trim(F.regexp_replace(digits, "(.{4})", "$1 "))
    narrow = F.trim(F.regexp_replace(digits, "(.{2})", "$1 "))
    return (
        F.when(F.length(digits) == 40, F.concat(F.substring(wide, 1, 24), F.lit(" "), F.substring(wide, 25, 30)))
        .when(F.length(digits) == 32, F.concat(F.substring(narrow, 1, 23), F.lit("  "), F.substring(narrow, 25, 30)))
        .otherwise(digits)
    )


def short_id(digits: Column) -> Column:
    """Last eight hex digits."""
    return F.right(digits, F.lit(8))


def parse_id(text: Column) -> Column:
    """Hex digits, upper case, of an id with or without ``0x``; null unless 8 or 16 of them follow."""
    digits = F.upper(F.regexp_replace(text, "^0[xX]", ""))
    return F.when(digits.rlike("^([0-9A-F]{8}|[0-9A-F]{16})$"), digits)


def other_ids(main: Column, subs: Column) -> Column:
    """Distinct ids of ``subs`` without the main one, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(subs), F.array(main)))


def bit_prefix(digits: Column, bits: int) -> Column:
    """The first ``bits`` bits, at most 60, of a hex digest, as a string of 0 and 1."""
    used = -(-bits // 4)
    return F.substring(F.lpad(F.conv(F.substring(digits, 1, used), 16, 2), 4 * used, "0"), 1, bits)


def child_index(digits: Column, depth: int, width: int = 2) -> Column:
    """Which of the 2^width children at ``depth`` a digest belongs to, highest bits first."""
    return F.conv(F.substring(bit_prefix(digits, (depth + 1) * width), depth * width + 1, width), 2, 10).cast("int")
