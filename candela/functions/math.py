"""Element-wise functions (class S0): one column expression each, no shuffle, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerics import INF, NAN, ieee_div


def _integral(f):
    """Spark's ceil and floor give BIGINT and 0 for NaN; doubles from 2**53 on are whole already."""
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(f(x).cast("double"))


def _finite(f):
    """Overflow becomes NaN."""
    return lambda x: F.when(F.isnan(f(x)) | (F.abs(f(x)) == INF), F.lit(NAN)).otherwise(f(x))


def _log(f):
    return lambda x: F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(f(x))


UNARY = {
    "acos": F.acos,
    "asin": F.asin,
    "atan": F.atan,
    "ceil": _integral(F.ceil),
    "cos": F.cos,
    "cosh": _finite(F.cosh),
    "exp": _finite(F.exp),
    "floor": _integral(F.floor),
    "ln": _log(F.ln),
    "log10": _log(F.log10),
    "sin": F.sin,
    "sinh": _finite(F.sinh),
    "sqrt": F.sqrt,
    "tan": F.tan,
    "tanh": F.tanh,
}

BINARY = {
    "add": lambda x, y: x + y,
    "sub": lambda x, y: x - y,
    "mult": lambda x, y: x * y,
    "div": ieee_div,
}


def bop(o: Column, h: Column, l: Column, c: Column) -> Column:  # noqa: E741
    """Balance of power: body over range, 0 for a bar without range."""
    return F.when(h == l, F.lit(0.0)).otherwise(F.try_divide(c - o, h - l))


PRICE = {
    "avgprice": (("open", "high", "low", "close"), lambda o, h, l, c: (o + h + l + c) * 0.25),
    "medprice": (("high", "low"), lambda h, l: (h + l) * 0.5),
    "typprice": (("high", "low", "close"), lambda h, l, c: (h + l + c) / 3.0),
    "wclprice": (("high", "low", "close"), lambda h, l, c: (h + l + c * 2.0) * 0.25),
    "bop": (("open", "high", "low", "close"), bop),
}
