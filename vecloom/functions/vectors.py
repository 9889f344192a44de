"""Vector columns (V1-V16): arrays of numbers, computed in double precision inside the JVM. NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def let(x: Column, use) -> Column:
    """use(x) with x worked out once; a lambda would work it out again for each element."""
    return F.get(F.transform(F.array(x), use), 0)


def rounded(x: Column, places: int = 6) -> Column:
    """As SQL rounds: times a power of ten, halves away from zero, and back. A small negative number becomes -0.0, where
    F.round gives 0.0. A number too large to be multiplied stays as it is."""
    unit = 10.0**places
    return F.when(F.abs(x) * unit < float("inf"), F.signum(x) * F.round(F.abs(x) * unit) / unit).otherwise(x)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Vectors of different lengths have no product (NULL)."""
    return F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column, length: Column | None = None) -> Column:
    """v over its length; a zero vector has none (NULL). Pass a length column that is known already."""
    return let(norm(v) if length is None else length, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def logit_scale(s: Column) -> Column:
    """A learned scale: e to its power, held within 0 and 100."""
    return F.least(F.greatest(F.exp(s), F.lit(0.0)), F.lit(100.0))


def softmax(v: Column) -> Column:
    """Over one array; for rows of a table see operators.losses."""
    powers = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(total(p), lambda s: F.transform(p, lambda x: x / s)))


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.exp(log_sigmoid(x))


def part(v: Column, widths: list[int], t: int) -> Column:
    """Member t of concatenated teachers; a single width of -1 means the whole vector."""
    return v if widths == [-1] else F.slice(v, sum(widths[:t]) + 1, widths[t])


def project(v: Column, rows: list[list[float]]) -> Column:
    """v @ W, W given by its columns."""
    return F.array(*(dot(v, F.array(*map(F.lit, r))) for r in rows))


def pool(v: Column, how: str = "mean") -> Column:
    """Global pooling: mean, mean of absolute values, or root of the mean square."""
    n = F.size(v)
    if how == "mean":
        return F.try_divide(total(v), n)
    if how == "abs":
        return F.try_divide(total(F.transform(v, F.abs)), n)
    if how == "rms":
        return F.sqrt(F.try_divide(total(F.transform(v, lambda x: x * x)), n))
    raise ValueError(f"unknown pooling {how!r}")


def layer_norm(v: Column, scale: float = 1.0, shift: float = 0.0, eps: float = 1e-5) -> Column:
    centred = let(pool(v), lambda mean: F.transform(v, lambda x: x - mean))
    scaled = lambda c: let(F.sqrt(pool(F.transform(c, lambda x: x * x)) + eps), lambda d: F.transform(c, lambda x: x / d * scale + shift))
    return let(centred, scaled)


def causal_mask(n: Column) -> Column:
    """n rows of n numbers: 0 up to the diagonal, minus infinity beyond."""
    places = F.sequence(F.lit(1), n)
    return F.transform(places, lambda i: F.transform(places, lambda j: F.when(j > i, F.lit(float("-inf"))).otherwise(F.lit(0.0))))


def joined(*vectors: Column) -> Column:
    """One after another; NULL if one of them is."""
    return F.concat(*vectors)


def attention(q: Column, k: Column, v: Column, causal: bool = False) -> Column:
    """softmax(q k' / sqrt(d)) v of matrices given by rows; causal: row i sees rows up to i only. No keys, no rows."""

    def row(x: Column, i: Column) -> Column:
        keys, values = (F.slice(m, F.lit(1), i + 1) if causal else m for m in (k, v))
        weights = softmax(F.transform(keys, lambda y: dot(x, y) / F.sqrt(F.size(x))))
        places = F.sequence(F.lit(0), F.size(F.get(v, 0)) - 1)
        return let(weights, lambda w: F.transform(places, lambda j: total(F.zip_with(w, values, lambda a, r: a * F.get(r, j)))))

    return F.when(F.size(k) > 0, F.transform(q, row)).otherwise(F.array().cast("array<array<double>>"))


def resized_rows(rows: Column, n: int) -> Column:
    """A matrix of n rows, by linear interpolation between the centres of the given ones; unchanged if there are n."""
    m = F.size(rows)

    def row(i: Column) -> Column:
        at = F.least(F.greatest((i + 0.5) * m / n - 0.5, F.lit(0.0)), (m - 1).cast("double"))
        lo = F.floor(at).cast("int")
        return F.zip_with(F.get(rows, lo), F.get(rows, F.least(lo + 1, m - 1)), lambda a, b: a * (1 - (at - lo)) + b * (at - lo))

    return F.when(m == n, rows).when(m > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), row))


def half(x: Column) -> Column:
    """The nearest number of 16 bits (10 of fraction), ties to even; beyond 65504 infinity."""
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    near = F.rint(x / step) * step
    wide = F.when(x > 0, float("inf")).otherwise(float("-inf"))
    return F.when((size == 0) | F.isnan(x) | (size == float("inf")), x).when(size >= 65520, wide).otherwise(near)


def affine(v: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / std, by channel: element i belongs to channel i modulo the number of channels."""
    k = len(mean)
    means, stds = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    return F.transform(v, lambda x, i: (x - F.get(means, F.pmod(i, F.lit(k)))) / F.get(stds, F.pmod(i, F.lit(k))))


def blend(a: Column, b: Column, weight: Column) -> Column:
    """weight * a + (1 - weight) * b."""
    return F.zip_with(a, b, lambda x, y: weight * x + (1 - weight) * y)


def one_hot(label: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def to_unit_range(v: Column) -> Column:
    """0-255 to 0-1."""
    return F.transform(v, lambda x: x / 255.0)


def to_bytes_range(v: Column) -> Column:
    """0-1 to 0-255, cut off behind the point."""
    return F.transform(v, lambda x: F.floor(x * 255.0).cast("int"))
