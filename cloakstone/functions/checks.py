"""Check digits, digit normalisation and keyed hashes as column expressions."""

from __future__ import annotations

import hashlib
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def dihedral(a: int, b: int) -> int:
    """The product in the symmetry group of the pentagon (rotations 0-4, reflections 5-9)."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


def permutation(i: int, d: int) -> int:
    """The digit d after i turns of Verhoeff's permutation."""
    #: Fixed values of the published scheme.
    once = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    for _ in range(i % 8):
        d = once[d]
    return d


PRODUCTS = [dihedral(a, b) for a in range(10) for b in range(10)]
TURNS = [permutation(i, d) for i in range(8) for d in range(10)]
INVERSE = [next(b for b in range(10) if dihedral(a, b) == 0) for a in range(10)]


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _verhoeff_state(digits: Column, shift: int) -> Column:
    """The product over the digits, last first; ``shift`` is the last digit's position."""
    products, turns = _numbers(PRODUCTS), _numbers(TURNS)
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.get(turns, ((i + shift) % 8) * 10 + d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda c, d: F.get(products, c * 10 + d))


def verhoeff_valid(text: Column) -> Column:
    """Whether the digits in the text pass; a text without digits doesn't."""
    digits = digits_of(text)
    return F.when(F.length(digits) == 0, F.lit(False)).otherwise(_verhoeff_state(digits, 0) == 0)


def verhoeff_digit(text: Column) -> Column:
    """The check digit to append."""
    digits = digits_of(text)
    return F.when(F.length(digits) == 0, F.lit(0)).otherwise(F.get(_numbers(INVERSE), _verhoeff_state(digits, 1)))


def luhn_valid(text: Column) -> Column:
    digits = digits_of(text)
    return F.when(F.length(digits) < 2, F.lit(False)).otherwise(F.call_function("luhn_check", digits))


def _decimal_digits() -> tuple[str, str]:
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


OTHER_DIGITS, THEIR_ASCII = _decimal_digits()


def normalize_digits(text: Column) -> Column:
    """Every decimal digit of any script as its ASCII digit, one code point for one."""
    return F.when(text.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(text, OTHER_DIGITS, THEIR_ASCII)).otherwise(text)


def hmac_sha256(key: str | bytes, value: Column) -> Column:
    """HMAC-SHA-256 of the value's UTF-8 bytes, in lower-case hexadecimal.

    The padded keys stand in the plan: hide plans that hold them
    (spark.sql.redaction.string.regex) and don't log them.
    """
    key = key.encode() if isinstance(key, str) else key
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key.ljust(64, b"\0")).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def plain_number(value: Column) -> Column:
    """A double as the shortest text that reads back, positional between 1e-4 and 1e16 and with a two-digit exponent elsewhere."""
    text = value.cast("string")
    size = F.abs(value)
    mantissa, exponent = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), F.substring_index(text, "E", -1).cast("int")
    power = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    # digits of the mantissa, moved to their place
    sign = F.when(value < 0, "-").otherwise("")
    figures = F.regexp_replace(mantissa, "[-.]", "")
    whole = F.concat(sign, F.rpad(figures, F.greatest(exponent + 1, F.length(figures)), "0"))
    up = F.when(F.length(figures) <= exponent + 1, F.concat(whole, F.lit(".0"))).otherwise(F.concat(sign, F.substring(figures, F.lit(1), exponent + 1), F.lit("."), F.substring(figures, exponent + 2, F.length(figures))))
    down = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), figures)
    named = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    return F.coalesce(named, F.when(~F.contains(text, F.lit("E")), text).when((size >= 1e-4) & (size < 1e16), F.when(exponent >= 0, up).otherwise(down)).otherwise(power))
