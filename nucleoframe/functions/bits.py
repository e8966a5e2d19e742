"""Sequences of up to 30 bases as 64-bit integers, two bits a base (A 0, C 1, G 2, T 3), the first base highest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 30


def _mask(n: Column | int) -> Column:
    """The low 2n bits."""
    if isinstance(n, int):
        return F.lit((1 << (2 * n)) - 1).cast("bigint")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (n * 2).cast("int")) - F.lit(1).cast("bigint")


def _left(v: Column, k: Column) -> Column:
    return F.call_function("shiftleft", v, k.cast("int"))


def _right(v: Column, k: Column) -> Column:
    return F.call_function("shiftrightunsigned", v, k.cast("int"))


def _n(n: Column | int) -> Column:
    return F.lit(n) if isinstance(n, int) else n


def seq_to_int(seq: Column) -> Column:
    """Any other letter counts as A; an error above 30 bases."""
    digits = F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "A"), "ACGT", "0123")
    value = F.conv(F.concat(F.lit("0"), digits), 4, 10).cast("bigint")
    return F.when(F.length(seq) <= MOST, value).when(seq.isNotNull(), F.raise_error(F.lit("more than 30 bases")).cast("bigint"))


def int_to_seq(v: Column, n: Column | int) -> Column:
    digits = F.concat(F.lit("0" * MOST), F.conv(v.cast("string"), 10, 4))
    n = _n(n)
    return F.when(n <= 0, F.lit("")).otherwise(F.translate(F.substr(digits, F.length(digits) - n + 1, n), "0123", "ACGT"))


def int_complement(v: Column, n: Column | int) -> Column:
    return F.bitwise_not(v).bitwiseAND(_mask(n))


def int_reverse(v: Column, n: Column | int) -> Column:
    """The bases in the opposite order, by their digits to the base of four."""
    n = _n(n)
    digits = F.right(F.concat(F.lit("0" * MOST), F.conv(v.cast("string"), 10, 4)), n)
    return F.when(n > 0, F.conv(F.reverse(digits), 4, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def int_reverse_complement(v: Column, n: Column | int) -> Column:
    return int_reverse(int_complement(v, n), n)


def base_code(base: Column) -> Column:
    return F.when(F.upper(base) == "C", 1).when(F.upper(base) == "G", 2).when(F.upper(base) == "T", 3).otherwise(0).cast("bigint")


def add_base(v: Column, base: Column) -> Column:
    return _left(v, F.lit(2)) + base_code(base)


def remove_base(v: Column) -> Column:
    return _right(v, F.lit(2))


def add_to_window(v: Column, base: Column, n: Column | int) -> Column:
    return add_base(v, base).bitwiseAND(_mask(n))


def int_substring(v: Column, start: Column | int, end: Column | int, n: Column | int, wide: bool = False) -> Column:
    """Bases from ``start`` up to before ``end``; ``wide`` keeps the bases before ``start`` that a mask of ``n - start`` bases lets through."""
    start, end, n = _n(start), _n(end), _n(n)
    return _right(v, (n - end) * 2).bitwiseAND(_mask((n - start) if wide else (end - start)))
