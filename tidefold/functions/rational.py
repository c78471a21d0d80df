"""Exact rationals as columns: structs (num, den) of longs, reduced, den > 0. A part beyond 64 bits is an error, never a rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidefold.operators.ledger import gcd

_LONG = (1 << 63) - 1


def _wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _fits(x: Column) -> Column:
    return F.when(F.abs(x) > _LONG, F.raise_error(F.lit("a rational leaves 64 bits")).cast("long")).otherwise(x.cast("long"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _pair(num: Column, den: Column) -> Column:
    return F.struct(num.alias("num"), den.alias("den"))


def _div(x: Column, y: Column) -> Column:
    """The whole quotient of longs where y divides x."""
    return F.call_function("div", x, y)


def rational(num: Column, den: Column) -> Column:
    """num / den reduced, with the sign above; a null part gives null, a zero den an error."""
    n, d = num.cast("long"), den.cast("long")
    ok = F.when(d == 0, F.raise_error(F.lit("a rational over zero")).cast("long")).otherwise(gcd(n, d))
    sign = F.when(d < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    return F.when(n.isNotNull() & d.isNotNull(), _let(ok, lambda g: _pair(_div(n, g) * sign, _div(d, g) * sign)))


def times(a: Column, b: Column) -> Column:
    """Reduced across before the product, so that only a result too large overflows."""
    crossed = _let(F.struct(a.alias("a"), b.alias("b"), gcd(a["num"], b["den"]).alias("g"), gcd(b["num"], a["den"]).alias("h")), lambda x: F.struct(
        _fits(_wide(_div(x["a"]["num"], x["g"])) * _wide(_div(x["b"]["num"], x["h"]))).alias("num"),
        _fits(_wide(_div(x["a"]["den"], x["h"])) * _wide(_div(x["b"]["den"], x["g"]))).alias("den"),
    ))
    return F.when(a.isNotNull() & b.isNotNull(), crossed)


def inverse(a: Column) -> Column:
    return rational(a["den"], a["num"])


def over(a: Column, b: Column) -> Column:
    return times(a, inverse(b))


def negated(a: Column) -> Column:
    return F.when(a.isNotNull(), _pair(-a["num"], a["den"]))


def plus(a: Column, b: Column) -> Column:
    """The sum, by the common divisor of the dens and then that of the sum with it."""
    start = F.struct(a.alias("a"), b.alias("b"), gcd(a["den"], b["den"]).alias("g"))
    summed = _let(start, lambda x: F.struct(
        (_wide(x["a"]["num"]) * _wide(_div(x["b"]["den"], x["g"])) + _wide(x["b"]["num"]) * _wide(_div(x["a"]["den"], x["g"]))).cast("decimal(38,0)").alias("t"),
        _div(x["a"]["den"], x["g"]).alias("d"), x["b"]["den"].alias("e"), x["g"].alias("g"),
    ))
    done = _let(summed, lambda x: _let(F.struct(x["t"].alias("t"), x["d"].alias("d"), x["e"].alias("e"), gcd((x["t"] % _wide(x["g"])).cast("long"), x["g"]).alias("h")), lambda y: F.struct(
        _exact(y["t"], y["h"]).alias("num"), _fits(_wide(y["d"]) * _wide(_div(y["e"], y["h"]))).alias("den"),
    )))
    return F.when(a.isNotNull() & b.isNotNull(), done)


def _exact(t: Column, h: Column) -> Column:
    """t / h for a wide t that h divides; beyond 64 bits an error."""
    large = F.abs(t) > F.lit(_LONG) * _wide(h)
    return F.when(large, F.raise_error(F.lit("a rational leaves 64 bits")).cast("long")).otherwise(F.call_function("div", t, _wide(h)))


def minus(a: Column, b: Column) -> Column:
    return plus(a, negated(b))


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.signum(_wide(a["num"]) * _wide(b["den"]) - _wide(b["num"]) * _wide(a["den"])).cast("int")


def greatest(a: Column, b: Column) -> Column:
    return F.when(compared(a, b) >= 0, a).otherwise(b)


def ceiling(a: Column) -> Column:
    """The least whole number that is not below."""
    return _div(a["num"], a["den"]) + F.when(a["num"] % a["den"] > 0, 1).otherwise(0).cast("long")
