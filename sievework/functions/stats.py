"""Numeric functions: columns where rows are many, plain Python where there is one number."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def excludes_zero(lo: Column, hi: Column) -> Column:
    return ((lo > 0) & (hi > 0)) | ((lo < 0) & (hi < 0))


def ci_class(lo: Column, hi: Column, higher_is_better: bool = True) -> Column:
    """favorable, adverse or not_established; strict at zero."""
    good, bad = ("favorable", "adverse") if higher_is_better else ("adverse", "favorable")
    return F.when(lo > 0, good).when(hi < 0, bad).otherwise("not_established")


def wilson(failures: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval."""
    n, p = total.cast("double"), failures / total
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def temperature(fit, low: float = 0.05, high: float = 20.0, steps: int = 60) -> float:
    """The scalar that minimises ``fit(t)`` (a mean loss), by golden section on log t."""
    a, b, g = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = fit(math.exp(c)), fit(math.exp(d))
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = fit(math.exp(c))
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = fit(math.exp(d))
    return math.exp((a + b) / 2)


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided binomial test of discordant counts; logarithms where integers would not fit a double."""
    n = b + c
    if n == 0:
        return 1.0
    k = min(b, c)
    if n <= 1000:
        tail = sum(math.comb(n, i) for i in range(k + 1))
        return min(1.0, 2 * tail / 2**n)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def chi2_divergence(p: list[float], q: list[float]) -> float:
    out = 0.0
    for a, b in zip(p, q, strict=True):
        if b == 0:
            if a:
                return math.inf
            continue
        out += (a - b) ** 2 / b
    return out


def kish_weights(target: list[float], data: list[float], n: int) -> dict[str, float | None]:
    """Class weights target/data: their spread and the effective sample size.

    A class that the target has and the data lack would weigh infinitely: no largest weight, no effective row.
    """
    seen = [(t, d) for t, d in zip(target, data, strict=True) if d > 0]
    lost = any(t > 0 and d <= 0 for t, d in zip(target, data, strict=True))
    spread = sum(t * t / d for t, d in seen)
    w = [t / d for t, d in seen]
    return {"max": None if lost or not w else max(w), "min": min(w) if w else None, "n_eff": 0.0 if lost or not spread else n / spread}


def hamilton(counts: dict, target: int) -> dict:
    """Largest-remainder quotas; everything if the target reaches the total; ties by ascending key."""
    total = sum(counts.values())
    if target >= total:
        return dict(counts)
    out = {k: n * target // total for k, n in counts.items()}
    left = target - sum(out.values())
    for k in sorted(counts, key=lambda k: (-(counts[k] * target % total), k))[:left]:
        out[k] += 1
    return out


def round_tree(x, digits: int = 10):
    """Rounded recursively, half to even; what isn't finite becomes None."""
    if isinstance(x, dict):
        return {k: round_tree(v, digits) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [round_tree(v, digits) for v in x]
    if isinstance(x, float):
        return round(x, digits) if math.isfinite(x) else None
    return x
