"""Scalar column functions. All stay on the JVM and inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def idiv(left: Column, right: Column | int) -> Column:
    """Integer quotient, exact for 64-bit values (no detour over doubles)."""
    return F.call_function("div", left, F.lit(right) if isinstance(right, int) else right)


WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, Unicode blanks included."""
    return F.btrim(text, F.lit(WHITESPACE))


def digit(number: Column, place: int) -> Column:
    """Decimal digit at ``place`` (0 = units), with floor semantics for negatives."""
    base = F.lit(10**place).cast("bigint")
    whole = number.cast("bigint")
    return F.pmod(idiv(whole - F.pmod(whole, base), base), F.lit(10).cast("bigint"))


def digit_count(number: Column) -> Column:
    """Length of the number written in decimal."""
    return F.length(number.cast("string"))


def reversed_digits(number: Column, places: int) -> Column:
    """The lowest ``places`` digits read backwards, as one number.

    Ordering by it is ordering by units digit first, then tens, and so on.
    """
    if places > 18:
        modulus = F.lit("1" + "0" * places).cast(f"decimal({places + 1},0)")
        low = F.pmod(number.cast("decimal(38,0)"), modulus)
        target = "decimal(38,0)"
    else:
        low = F.pmod(number.cast("bigint"), F.lit(10**places).cast("bigint"))
        target = "bigint"
    return F.reverse(F.lpad(low.cast("string"), places, "0")).cast(target)


def _product_error(x: Column, y: Column) -> Column:
    """``x * y`` minus its rounded double, exactly (Dekker's product)."""

    def halves(v: Column) -> tuple[Column, Column]:
        big = v * F.lit(134217729.0)  # 2**27 + 1 splits 53 bits in two halves
        high = big - (big - v)
        return high, v - high

    (xh, xl), (yh, yl) = halves(x), halves(y)
    return ((xh * yh - x * y) + xh * yl + xl * yh) + xl * yl


def round_significant(number: Column, digits: int) -> Column:
    """Round to ``digits`` significant digits; fails unless the number is positive.

    What counts is the exact binary value, so 5.55e-7, which is stored a little below
    its name, becomes 5.5e-7; true ties go to the even digit. Written without branches,
    so that common subexpressions are computed once.
    """
    needed = F.raise_error(F.lit("significant digits need a positive number")).cast("double")
    number = F.coalesce(F.when(number > 0, number.cast("double")), needed)
    places = F.lit(digits - 1) - F.floor(F.log10(number))
    up = F.pow(F.lit(10.0), F.greatest(places, F.lit(0)))
    down = F.pow(F.lit(10.0), F.greatest(-places, F.lit(0)))  # one of the two is 1
    scaled = number * up / down
    beyond = _product_error(number, up) + (
        (number * up - scaled * down) - _product_error(scaled, down)
    )
    whole = F.floor(scaled).cast("double")
    side = F.signum(scaled - whole - 0.5) * 4 + F.signum(beyond) * 2 + (whole % 2) * 2 - 1
    return (whole + (side > 0).cast("double")) / up * down


def readable_size(size_bytes: Column) -> Column:
    """``'x.xx MB'``, or ``'x.xx GB'`` from one GB (1024-based) on."""
    gb = size_bytes / F.lit(float(1 << 30))
    mb = size_bytes / F.lit(float(1 << 20))
    return F.when(gb >= 1, F.format_string("%.2f GB", gb)).otherwise(F.format_string("%.2f MB", mb))


def argmax(array: Column) -> Column:
    """Index of the largest element; the first one wins a tie."""
    return F.array_position(array, F.array_max(array)) - 1
