"""Kernels over array<double> columns as Column expressions; nothing here leaves the JVM."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once: inside a lambda it would be evaluated again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def scaled(x: Column, by: Column) -> Column:
    return let(by, lambda b: F.transform(x, lambda v: v * b))


def rms_norm(x: Column, weight: Column | None = None, eps: float = 1e-5) -> Column:
    out = scaled(x, 1 / F.sqrt(dot(x, x) / F.size(x) + eps))
    return out if weight is None else F.zip_with(out, weight, lambda a, b: a * b)


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    centred = lambda mean: F.transform(x, lambda v: v - mean)
    return let(let(total(x) / F.size(x), centred), lambda c: scaled(c, 1 / F.sqrt(dot(c, c) / F.size(c) + eps)))


def l2_normalize(x: Column, eps: float = 1e-12) -> Column:
    return scaled(x, 1 / F.greatest(F.sqrt(dot(x, x)), F.lit(eps)))


def exp_below(x: Column, top: Column) -> Column:
    return F.transform(x, lambda v: F.exp(v - top))


def logsumexp(x: Column) -> Column:
    return let(F.array_max(x), lambda top: top + F.ln(total(exp_below(x, top))))


def softmax(x: Column) -> Column:
    return let(let(F.array_max(x), lambda top: exp_below(x, top)), lambda e: scaled(e, 1 / total(e)))


def lse_merge(x: Column, y: Column) -> Column:
    """Element by element log(exp(x) + exp(y))."""
    return F.zip_with(x, y, lambda a, b: F.greatest(a, b) + F.ln(F.exp(a - F.greatest(a, b)) + F.exp(b - F.greatest(a, b))))


def lse_gate(x: Column, y: Column, alpha: float) -> Column:
    """alpha * x + (1 - alpha) * lse_merge(x, y)."""
    return F.zip_with(x, lse_merge(x, y), lambda a, m: alpha * a + (1 - alpha) * m)


def added(shared: Column, routed: Column) -> Column:
    """What an expert shared by all tokens gives, plus the weighted sum of those that a token was routed to."""
    return F.zip_with(shared, routed, lambda a, b: a + b)


def swiglu(gate: Column, up: Column, clamp: float | None = None) -> Column:
    """silu(gate) * up; with a clamp the gate is cut above it and up on both sides."""
    g = gate if clamp is None else F.transform(gate, lambda v: F.least(v, F.lit(clamp)))
    u = up if clamp is None else F.transform(up, lambda v: F.greatest(F.least(v, F.lit(clamp)), F.lit(-clamp)))
    return F.zip_with(g, u, lambda a, b: a / (1 + F.exp(-a)) * b)


def top_k(x: Column, k: int) -> Column:
    """array<struct<v, i>> of the k largest values with their places, the lesser place first among equals."""
    pairs = F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["v"]).alias("v"), p["i"].alias("i")))


def top_k_threshold(x: Column, k: int) -> Column:
    """x with null below its k-th largest value; ties at the threshold all stay."""
    least = F.element_at(F.sort_array(x, asc=False), F.least(F.lit(k), F.size(x)))
    return let(least, lambda edge: F.transform(x, lambda v: F.when(v >= edge, v)))


def weighted(best: Column, extra: float = 0.0) -> Column:
    """(i, w) of the chosen (v, i), weights over their sum."""
    sum_ = lambda b: F.aggregate(b, F.lit(extra), lambda a, p: a + p["v"])
    over = lambda b, s: F.transform(b, lambda p: F.struct(p["i"].alias("i"), (p["v"] / s).alias("w")))
    return let(best, lambda b: let(sum_(b), lambda s: over(b, s)))


def route_softmax(x: Column, k: int) -> Column:
    """Top k of the softmax as (i, w), weights scaled to sum to one."""
    return weighted(top_k(softmax(x), k))


def route_softplus(x: Column, k: int, scale: float = 2.5) -> Column:
    """Top k of scale * sqrt(softplus(x)) as (i, w), weights over their sum."""
    return weighted(top_k(F.transform(x, lambda v: scale * F.sqrt(F.ln(1 + F.exp(v)))), k), 1e-6)


# Fixed values of the hash router.
HASH_BASE, HASH_STEP = 2654435761, 97


def route_hash(first: Column, experts: int, k: int) -> Column:
    """Experts of a row by a hash of its truncated first value: one for each of k multipliers."""
    whole = first.cast("long")  # truncates towards zero
    slot = lambda i: F.pmod(F.shiftright(whole * (HASH_BASE + HASH_STEP * i), 16), F.lit(experts))
    return F.array(*(slot(i) for i in range(k)))


def rope(x: Column, position: Column, theta: float = 10000.0, dims: int | None = None) -> Column:
    """Rotary position embedding of the first dims values (all if not given): pairs (i, i + dims / 2) turn."""
    if dims is not None:
        return F.concat(rope(F.slice(x, 1, dims), position, theta), F.slice(x, F.lit(dims + 1), F.size(x)))
    n = F.size(x)
    half = (n / 2).cast("int")
    angle = lambda i: position * F.pow(F.lit(theta), -2.0 * (i % half) / n)
    other = lambda i: F.when(i < half, -F.get(x, i + half)).otherwise(F.get(x, i - half))
    return F.transform(x, lambda v, i: v * F.cos(angle(i)) + other(i) * F.sin(angle(i)))


def sinkhorn(rows: Column, rounds: int = 20) -> Column:
    """exp of a matrix (array of rows), rows and columns scaled in turn until both sum to one.

    A round is three steps of one fold, rows, column sums, columns, so that no sum is evaluated twice.
    """
    start = F.transform(rows, lambda r: F.transform(r, lambda v: F.exp(v)))
    none = F.array().cast("array<double>")

    def step(acc: Column, phase: Column) -> Column:
        m, sums = acc["m"], acc["sums"]
        by_row = F.transform(m, lambda r: scaled(r, 1 / total(r)))
        by_column = F.transform(m, lambda r: F.zip_with(r, sums, lambda v, s: v / s))
        added = F.aggregate(
            F.slice(m, F.lit(2), F.size(m)), F.element_at(m, 1), lambda a, r: F.zip_with(a, r, lambda p, q: p + q)
        )
        return F.struct(
            F.when(phase == 0, by_row).when(phase == 2, by_column).otherwise(m).alias("m"),
            F.when(phase == 1, added).otherwise(sums).alias("sums"),
        )

    phases = F.transform(F.sequence(F.lit(0), F.lit(3 * rounds - 1)), lambda i: i % 3)
    return F.aggregate(phases, F.struct(start.alias("m"), none.alias("sums")), step, lambda acc: acc["m"])


# Fixed coefficients of the iteration.
NEWTON_SCHULZ = (2.0, -1.5, 0.5)


def newton_schulz(rows: Column, rounds: int = 5) -> Column:
    """A matrix (array of rows) brought near its closest orthogonal one, in NumPy over Arrow batches."""
    import numpy as np
    import pandas as pd

    a, b, c = NEWTON_SCHULZ

    @F.pandas_udf("array<array<double>>")
    def udf(values: pd.Series) -> pd.Series:
        def one(value) -> list:
            x = np.array([list(r) for r in value], dtype=np.float64)
            tall = x.shape[0] > x.shape[1]
            x = x.T if tall else x
            x = x / (np.linalg.norm(x) + 1e-7)
            for _ in range(rounds):
                s = x @ x.T
                x = a * x + (b * s + c * s @ s) @ x
            return (x.T if tall else x).tolist()

        return values.map(one)

    return udf(rows)


def repetition_penalty(logit: Column, count: Column, penalty: float, once: bool = False) -> Column:
    """A logit after its token occurred so often: positive ones are divided, negative ones multiplied."""
    power = F.pow(F.lit(penalty), F.least(count, F.lit(1)) if once else count)
    return F.when(logit >= 0, logit / power).otherwise(logit * power)


def bias_update(load: Column, experts: int, rate: float, direction: int = -1) -> Column:
    """Change of an expert's routing bias; direction -1 lowers overloaded experts, 1 raises them."""
    return direction * F.signum(load - 1.0 / experts) * rate


def head_merge_place(t: Column, h: Column, heads: int, length: int) -> Column:
    """Struct (h, t) of the source that a transposed view puts at position (t, h): v = t * heads + h is read as (v div length, v mod length)."""
    v = t * heads + h
    return F.struct(F.floor(v / length).alias("h"), (v % length).alias("t"))


def z_loss(x: Column) -> Column:
    return F.pow(logsumexp(x), F.lit(2.0))


def kl_divergence(p: Column, q: Column, least: float = 1e-12) -> Column:
    """Sum of p * (ln p - ln q), both cut off below at least."""
    cut = lambda v: F.greatest(v, F.lit(least))
    return total(F.zip_with(p, q, lambda a, b: cut(a) * (F.ln(cut(a)) - F.ln(cut(b)))))


def mix_streams(mixing: Column, streams: Column) -> Column:
    """Streams (array of vectors) mixed by the transpose of a matrix: stream c becomes the sum over h of mixing[h][c] * stream h."""
    column = lambda c: F.transform(mixing, lambda r: F.get(r, c))
    weighted_sum = lambda w: F.aggregate(
        F.zip_with(w, streams, lambda a, x: F.transform(x, lambda v: a * v)),
        F.transform(F.get(streams, F.lit(0)), lambda v: F.lit(0.0)),
        lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b),
    )
    return F.transform(streams, lambda _, c: let(column(c), weighted_sum))
