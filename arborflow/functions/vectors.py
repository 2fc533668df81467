"""Functions on array columns: scores, masks and paths.  Ties go to the lowest index throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def argmax(v: Column) -> Column:
    """0-based index of the largest element."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("long")


def top_k(v: Column, k: int) -> Column:
    """0-based indices of the k largest elements, largest first."""
    pairs = F.transform(v, lambda x, i: F.struct((-x).alias("x"), i.cast("long").alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: s["i"])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def softmax(v: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(doubles(v), lambda x: x / F.lit(float(temperature)))
    share = lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t))
    return let(scaled, lambda s: let(F.array_max(s), lambda m: let(F.transform(s, lambda x: F.exp(x - m)), share)))


def entropy(p: Column) -> Column:
    """-sum p * ln(p + 1e-5)."""
    return -total(F.transform(p, lambda x: x * F.ln(x + F.lit(1e-5))))


def typical_threshold(p: Column, threshold: float, alpha: float) -> Column:
    return F.least(F.lit(float(threshold)), F.exp(-entropy(p)) * F.lit(float(alpha)))


def nucleus_kept(p: Column, top_p: float) -> Column:
    """Indices of the nucleus, in falling probability: what precedes an element sums to at most top_p."""
    order = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("x"), i.cast("long").alias("i"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda a, s: F.struct((a["sum"] - s["x"]).alias("sum"), F.when(a["sum"] <= F.lit(float(top_p)), F.concat(a["kept"], F.array(s["i"]))).otherwise(a["kept"]).alias("kept"))
    return F.aggregate(order, start, step, lambda a: a["kept"])


def nucleus_last(p: Column, top_p: float) -> Column:
    """The last element of the nucleus in falling probability, as (x: its negative probability, i)."""
    order = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("x"), i.cast("long").alias("i"))))
    start = lambda o: F.struct(F.lit(0.0).alias("sum"), F.get(o, 0).alias("last"))
    step = lambda a, s: F.struct((a["sum"] - s["x"]).alias("sum"), F.when(a["sum"] <= F.lit(float(top_p)), s).otherwise(a["last"]).alias("last"))
    return let(order, lambda o: F.aggregate(o, start(o), step, lambda a: a["last"]))


def prefix_length(mask: Column) -> Column:
    """Number of leading true elements: the sum of the running product."""
    first = F.array_position(mask, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(mask)).cast("long")


def pad_path(path: Column, length: int, pad: int = -2) -> Column:
    return F.concat(path, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(path))))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def rms_norm(v: Column, weight: float = 1.0, eps: float = 1e-6) -> Column:
    square = total(F.transform(v, lambda x: x * x)) / F.size(v)
    return let(1 / F.sqrt(square + F.lit(eps)), lambda r: F.transform(v, lambda x: x * r * F.lit(weight)))


def rotate_half(v: Column) -> Column:
    half = (F.size(v) / 2).cast("int")
    return F.concat(F.transform(F.slice(v, half + 1, half), lambda x: -x), F.slice(v, 1, half))


def rope(v: Column, position: Column, size: int, base: float = 10000.0, factor: float = 1.0, max_length: int | None = None, length: int | None = None) -> Column:
    """v with rotary position embedding.  factor scales positions linearly; with max_length and a greater length
    the base grows instead (dynamic NTK scaling)."""
    if max_length is not None and length is not None and length > max_length:
        base, factor = base * ((factor * length / max_length) - (factor - 1)) ** (size / (size - 2)), 1.0
    elif max_length is not None:
        factor = 1.0
    half = size // 2
    freq = F.array(*[F.lit(base ** (-2.0 * i / size)) for i in range(half)])
    turn = lambda turned: F.transform(v, lambda x, i: x * F.cos(angle(i)) + F.get(turned, i) * F.sin(angle(i)))
    angle = lambda i: position.cast("double") / F.lit(factor) * F.get(freq, i % half)
    return let(rotate_half(v), turn)


def check_rope_scaling(scaling: dict | None) -> None:
    """Raises ValueError unless scaling is None or {type: linear or dynamic, factor: a float above 1}."""
    if scaling is None:
        return
    if not isinstance(scaling, dict) or len(scaling) != 2 or scaling.get("type") not in ("linear", "dynamic"):
        raise ValueError("rope scaling needs a type (linear or dynamic) and a factor")
    if not isinstance(scaling.get("factor"), float) or not scaling["factor"] > 1 or math.isinf(scaling["factor"]):
        raise ValueError("the factor of rope scaling must be a float above 1")


def joined(v: Column) -> Column:
    return F.array_join(v.cast("array<string>"), ",")
