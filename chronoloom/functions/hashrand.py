"""Counter-based random numbers: a draw is a function of what it is about, in Spark and in DuckDB alike.

u = first 52 bits of md5("seed|purpose|a|b|...") / 2^52. Results don't depend on partitioning, retries or the number of
executors, shard filters can be pushed below generation, and an oracle can repeat every draw. Decisions (u < p, inverse
distribution functions) compare raw draws with literals that are computed once in Python, so both engines agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seed of the queries; operators take their own.
SEED = 42
_SCALE = float(1 << 52)

# purposes of draws
NODE, TOPOLOGY, ACTOR, CAMPAIGN, STATIC, FAILURE, BASELINE = 1, 2, 3, 4, 5, 6, 7


def _text(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def u(purpose: int, *about, seed: int = SEED) -> Column:
    """Uniform on [0, 1)."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(str(purpose)), *[_text(a) for a in about])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(_SCALE)


def u_sql(purpose: int, *about: str, seed: int = SEED) -> str:
    """The same draw in DuckDB; about are SQL expressions."""
    key = " || '|' || ".join([f"'{seed}|{purpose}'", *[f"({a})::varchar" for a in about]])
    return f"(('0x' || substr(md5({key}), 1, 13))::ubigint::double / 4503599627370496e0)"


def quick(purpose: int, *about, seed: int = SEED) -> Column:
    """Uniform on [0, 1), like u, from Spark's xxHash64: no text is made, and it stays within generated code. For draws of single events, of which there are many."""
    key = [x if isinstance(x, Column) else F.lit(x) for x in (seed, purpose, *about)]
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") * F.lit(2.0**-53)


def real(x: float) -> str:
    """A literal that both engines read as the same double."""
    return f"{x:.17e}"


def _lit_array(xs: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in xs)})")  # one call to the JVM, not one a number


def poisson_table(mean: float) -> tuple[int, list[float]]:
    """First outcome and the distribution function from there on, up to 1 - 1e-12, for any mean.

    Outcomes that are left out before the first have less mass together than 1e-30; from the logarithm of the mass at
    the first one, so that nothing underflows."""
    lo = max(0, math.floor(mean - 12 * math.sqrt(mean) - 12)) if mean > 500 else 0
    p = math.exp(lo * math.log(mean) - mean - math.lgamma(lo + 1)) if lo else math.exp(-mean)
    most = math.ceil(mean + 12 * math.sqrt(mean) + 60)
    out, total, k = [], 0.0, lo
    while total < 1 - 1e-12 and k < most:
        total += p
        out.append(min(total, 1.0))
        k += 1
        p *= mean / k
    return lo, out


def poisson_cdf(mean: float) -> list[float]:
    lo, out = poisson_table(mean)
    return [0.0] * lo + out


def zipf_cdf(s: float, n: int) -> list[float]:
    weights = [k**-s for k in range(1, n + 1)]
    total, acc, out = sum(weights), 0.0, []
    for w in weights:
        acc += w / total
        out.append(acc)
    return out


def weights_cdf(weights: list[float]) -> list[float]:
    total, acc, out = sum(weights), 0.0, []
    if not total > 0 or any(not (w >= 0) or math.isinf(w) for w in weights):
        raise ValueError("weights must be finite, not negative, and not all zero")
    for w in weights:
        acc += w / total
        out.append(acc)
    return out


def pick(draw: Column, cdf: list[float]) -> Column:
    """Index of the outcome: how many of the distribution function's values are at or under the draw; the last one absorbs rounding."""
    table = _lit_array(cdf)
    return F.least(once(draw, lambda d: F.size(F.filter(table, lambda x: x <= d))), F.lit(len(cdf) - 1)).cast("int")


def once(value: Column, use) -> Column:
    """use(value) with value evaluated once a row: a lambda's body is evaluated for each element, so a draw must not stand in one."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pick_sql(draw: str, cdf: list[float]) -> str:
    return f"least(len(list_filter([{', '.join(map(real, cdf))}], lambda x: x <= {draw})), {len(cdf) - 1})::int"


def poisson(draw: Column, mean: float) -> Column:
    if mean < 1e-9:
        return F.lit(0)
    lo, cdf = poisson_table(mean)
    return (pick(draw, cdf) + F.lit(lo)).cast("int")


def poisson_sql(draw: str, mean: float) -> str:
    return pick_sql(draw, poisson_cdf(mean)) if mean >= 1e-9 else "0"


def exponential(draw: Column, mean: float) -> Column:
    return -F.lit(float(mean)) * F.log(F.greatest(draw, F.lit(1e-12)))


def exponential_sql(draw: str, mean: float) -> str:
    return f"(-{real(mean)} * ln(greatest({draw}, 1e-12)))"


def normal(a: Column, b: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Box-Muller."""
    return F.lit(float(mean)) + F.lit(float(sd)) * F.sqrt(-2 * F.log(F.greatest(a, F.lit(1e-12)))) * F.cos(F.lit(2 * math.pi) * b)


def normal_sql(a: str, b: str, mean: float = 0.0, sd: float = 1.0) -> str:
    return f"({real(mean)} + {real(sd)} * sqrt(-2 * ln(greatest({a}, 1e-12))) * cos({real(2 * math.pi)} * {b}))"


def lognormal(a: Column, b: Column, mu: float, sigma: float) -> Column:
    return F.exp(normal(a, b, mu, sigma))


def lognormal_sql(a: str, b: str, mu: float, sigma: float) -> str:
    return f"exp({normal_sql(a, b, mu, sigma)})"


def pareto(draw: Column, scale: float, shape: float) -> Column:
    return F.lit(float(scale)) / F.pow(F.greatest(draw, F.lit(1e-15)), F.lit(1.0 / shape))


def pareto_sql(draw: str, scale: float, shape: float) -> str:
    return f"({real(scale)} / pow(greatest({draw}, 1e-15), {real(1.0 / shape)}))"


def geometric(draw: Column, mean: float) -> Column:
    """Failures before a success, of this mean."""
    return F.floor(F.log(F.greatest(draw, F.lit(1e-12))) / F.lit(math.log(1 - 1 / (1 + mean)))).cast("int")


def geometric_sql(draw: str, mean: float) -> str:
    return f"floor(ln(greatest({draw}, 1e-12)) / {real(math.log(1 - 1 / (1 + mean)))})::int"


def mean_of(kind: str, *p: float) -> float:
    """Analytic means of the eight distributions."""
    match kind:
        case "constant":
            return p[0]
        case "uniform":
            return (p[0] + p[1]) / 2
        case "normal":
            return p[0]
        case "log_normal":
            return math.exp(p[0] + p[1] ** 2 / 2)
        case "exponential":
            return 1 / p[0]
        case "pareto":
            return math.inf if p[1] <= 1 else p[0] * p[1] / (p[1] - 1)
        case "zipf":
            s, n = p[0], int(p[1])
            if n > 10_000:
                return _power_sum(s - 1, n) / _power_sum(s, n)
            return sum(k ** (1 - s) for k in range(1, n + 1)) / sum(k**-s for k in range(1, n + 1))
        case "poisson":
            return p[0]
    raise ValueError(f"no such distribution: {kind}")


def _power_sum(s: float, n: int) -> float:
    """About the sum of k^-s for k = 1..n, by the integral from 1 and the end correction."""
    whole = math.log(n) if abs(s - 1) < 1e-12 else (n ** (1 - s) - 1) / (1 - s)
    return whole + (1 + n**-s) / 2
