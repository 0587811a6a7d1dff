"""Closed-form math as Column expressions, inside whole-stage code."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PERIODS_PER_YEAR

SQRT_2_OVER_PI = math.sqrt(2 / math.pi)
SHORTEST_TAU = 0.5 / PERIODS_PER_YEAR

# Rational approximation of the normal distribution function (Hart 1968, in the
# form of West 2005), numerator and denominator by falling power. Fixed values.
CDF_NUMERATOR = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_DENOMINATOR = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_SPLIT = 7.07106781186547
CDF_ROOT_2_PI = 2.506628274631


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + c
    return value


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clean(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(finite(x), x)


def annualize(sigma: Column, periods_per_year: float = PERIODS_PER_YEAR, annualized: bool = True) -> Column:
    """A per-session volatility by the root of the sessions of a year, or as it is."""
    if periods_per_year <= 0:
        raise ValueError("periods_per_year must be strictly positive")
    return sigma * (math.sqrt(periods_per_year) if annualized else 1.0)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _tail(a: Column, e: Column) -> Column:
    """Probability beyond ``a`` >= 0, given ``e`` = exp(-a * a / 2)."""
    near = e * _horner(a, CDF_NUMERATOR) / _horner(a, CDF_DENOMINATOR)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / CDF_ROOT_2_PI
    return F.when(a > 37, F.lit(0.0)).when(a < CDF_SPLIT, near).otherwise(far)


def norm_cdf(x: Column) -> Column:
    """Normal distribution function to about 2e-16."""
    tail = _tail(F.abs(x), F.exp(-x * x / 2))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _valid_straddle(spot: Column, strike: Column, vol: Column, tau: Column) -> Column:
    return finite(spot) & finite(strike) & finite(vol) & finite(tau) & (spot > 0) & (strike > 0) & (vol > 0) & (tau >= 0)


def _d1(spot: Column, strike: Column, vol: Column, t: Column, rate: float) -> Column:
    return (F.ln(spot / strike) + (rate + vol * vol / 2) * t) / (vol * F.sqrt(t))


def _straddle_struct(spot: Column, strike: Column, width: Column, t: Column, d1: Column, up: Column, down: Column, rate: float) -> Column:
    return F.struct(
        (spot * (2 * up - 1) - strike * F.exp(-rate * t) * (2 * down - 1)).alias("price"),
        (2 * up - 1).alias("delta"),
        (2 * norm_pdf(d1) / (spot * width)).alias("gamma"),
    )


def _intrinsic(spot: Column, strike: Column) -> Column:
    return F.struct(F.abs(spot - strike).alias("price"), F.signum(spot - strike).alias("delta"), F.lit(0.0).alias("gamma"))


def bs_straddle(spot: Column, strike: Column, vol: Column, tau: Column, rate: float = 0.0, strict: bool = False) -> Column:
    """``struct(price, delta, gamma)`` of a straddle under Black-Scholes, as one expression.

    At tau 0 it has its intrinsic value; a shorter positive tau than half a
    session counts as that.  Inputs that are not finite, or not positive, give
    null, or raise where ``strict``.  ``with_straddle`` does the same for a
    whole table in generated code.
    """

    def priced(v: Column) -> Column:
        s, k, width, t, d1 = (v[c] for c in ("s", "k", "width", "t", "d1"))
        both = F.struct(norm_cdf(d1).alias("up"), norm_cdf(d1 - width).alias("down"))
        return _let(both, lambda n: _straddle_struct(s, k, width, t, d1, n["up"], n["down"], rate))

    def alive(v: Column) -> Column:
        s, k, vol_, t = (v[c] for c in ("s", "k", "vol", "t"))
        return _let(F.struct(s.alias("s"), k.alias("k"), (vol_ * F.sqrt(t)).alias("width"), t.alias("t"), _d1(s, k, vol_, t, rate).alias("d1")), priced)

    valid = _valid_straddle(spot, strike, vol, tau)
    inputs = F.struct(spot.alias("s"), strike.alias("k"), vol.alias("vol"), F.greatest(tau, F.lit(SHORTEST_TAU)).alias("t"))
    value = F.when(valid & (tau > 0), _let(inputs, alive)).when(valid, _intrinsic(spot, strike))
    if strict:
        message = "straddle inputs must be finite, and spot, strike and vol strictly positive"
        value = value.otherwise(F.raise_error(F.lit(message)).cast("struct<price:double,delta:double,gamma:double>"))
    return value


def _horner_sql(x: str, coefficients: tuple[float, ...]) -> str:
    text = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}D)"
    return text


def _tail_sql(a: str, e: str) -> str:
    """``_tail`` as SQL text of two columns: one call to the driver's JVM instead of one for each operation."""
    near = f"{e} * {_horner_sql(a, CDF_NUMERATOR)} / {_horner_sql(a, CDF_DENOMINATOR)}"
    far = f"{e} / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65D))))) / {CDF_ROOT_2_PI!r}D"
    return f"CASE WHEN {a} > 37 THEN 0D WHEN {a} < {CDF_SPLIT!r}D THEN {near} ELSE {far} END"


def with_norm_cdf(df: DataFrame, x: str, into: str) -> DataFrame:
    """``norm_cdf`` of a column in steps, so that generated code computes each part once."""
    a, e, tail = f"{into}_a", f"{into}_e", f"{into}_tail"
    df = df.withColumns({a: F.abs(x), e: F.exp(-F.col(x) * F.col(x) / 2)}).withColumn(tail, F.expr(_tail_sql(f"`{a}`", f"`{e}`")))
    return df.withColumn(into, F.when(F.col(x) > 0, 1 - F.col(tail)).otherwise(F.col(tail))).drop(a, e, tail)


def with_straddles(df: DataFrame, legs: dict[str, tuple[Column, Column, Column, Column]], rate: float = 0.0) -> DataFrame:
    """``df`` with a struct of ``bs_straddle`` per leg ``(spot, strike, vol, tau)``.

    The legs advance together through a few layers of columns, which generated
    code evaluates once each and which keep the plan shallow.  Layers are SQL
    text, as an expression is then made by one call.
    """
    r = f"{float(rate)!r}D"

    def parts(leg: str, names: str) -> list[str]:
        return [f"`_{leg}_{n}`" for n in names.split()]

    def layer(df: DataFrame, build: Callable[[str], dict[str, Column | str]]) -> DataFrame:
        return df.withColumns({f"_{leg}_{part}": F.expr(x) if isinstance(x, str) else x for leg in legs for part, x in build(leg).items()})

    def inputs(leg: str) -> dict[str, Column | str]:
        spot, strike, vol, tau = legs[leg]
        return {"s": spot, "k": strike, "v": vol, "u": tau, "t": F.greatest(tau, F.lit(SHORTEST_TAU))}

    def distances(leg: str) -> dict[str, Column | str]:
        s, k, v, u, t = parts(leg, "s k v u t")
        known = " AND ".join(f"{x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < double('infinity')" for x in (s, k, v, u))
        ok = f"{known} AND {s} > 0 AND {k} > 0 AND {v} > 0 AND {u} >= 0"
        return {"w": f"CASE WHEN {ok} THEN {v} * sqrt({t}) END", "d1": f"CASE WHEN {ok} THEN (ln({s} / {k}) + ({r} + {v} * {v} / 2) * {t}) / ({v} * sqrt({t})) END"}

    def powers(leg: str) -> dict[str, Column | str]:
        d1, w = parts(leg, "d1 w")
        d2 = f"({d1} - {w})"
        return {"d2": d2, "a1": f"abs({d1})", "e1": f"exp(-{d1} * {d1} / 2)", "a2": f"abs({d2})", "e2": f"exp(-{d2} * {d2} / 2)"}

    def tails(leg: str) -> dict[str, Column | str]:
        return {f"tail{n}": _tail_sql(*parts(leg, f"a{n} e{n}")) for n in (1, 2)}

    def value(leg: str) -> Column:
        s, k, w, t, u, d1, d2, tail1, tail2 = parts(leg, "s k w t u d1 d2 tail1 tail2")
        up, down = (f"CASE WHEN {d} > 0 THEN 1 - {tail} ELSE {tail} END" for d, tail in ((d1, tail1), (d2, tail2)))
        price = f"{s} * (2 * ({up}) - 1) - {k} * exp(-{r} * {t}) * (2 * ({down}) - 1)"
        gamma = f"2 * (exp(-{d1} * {d1} / 2) / {math.sqrt(2 * math.pi)!r}D / ({s} * {w}))"
        alive = f"named_struct('price', {price}, 'delta', 2 * ({up}) - 1, 'gamma', {gamma})"
        over = f"named_struct('price', abs({s} - {k}), 'delta', signum({s} - {k}), 'gamma', 0D)"
        return F.expr(f"CASE WHEN {w} IS NOT NULL AND {u} > 0 THEN {alive} WHEN {w} IS NOT NULL THEN {over} END")

    kept = df.columns
    for build in (inputs, distances, powers, tails):
        df = layer(df, build)
    return df.select(*[F.col(f"`{n}`") for n in kept if n not in legs], *[value(leg).alias(leg) for leg in legs])


def with_straddle(df: DataFrame, into: str, spot: Column, strike: Column, vol: Column, tau: Column, rate: float = 0.0) -> DataFrame:
    return with_straddles(df, {into: (spot, strike, vol, tau)}, rate)


def implied_jump_move(iv: Column, baseline: Column, days_to_expiry: int = 21, periods_per_year: float = PERIODS_PER_YEAR) -> Column:
    """The event move that the variance of ``iv`` beyond ``baseline`` pays for; null where either is."""
    if days_to_expiry <= 0 or periods_per_year <= 0:
        raise ValueError("days_to_expiry and periods_per_year must be strictly positive")
    paid = (iv * iv - baseline * baseline) * (days_to_expiry / periods_per_year)
    return F.when(paid > 0, F.sqrt(paid)).when(paid <= 0, F.lit(0.0))


def register_sql_functions(spark: SparkSession) -> None:
    """``norm_cdf``, ``implied_jump_move``, ``straddle_price`` and ``straddle_delta`` for SQL text, as SQL functions.

    The straddle takes spot, strike, volatility, years to expiry and rate, and
    is null for inputs that ``bs_straddle`` does not price.
    """

    def define(head: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")

    def horner(coefficients: tuple[float, ...]) -> str:
        text = f"{coefficients[0]!r}D"
        for c in coefficients[1:]:
            text = f"({text} * abs(x) + {c!r}D)"
        return text

    e = "exp(-x * x / 2)"
    far = f"{e} / (abs(x) + 1 / (abs(x) + 2 / (abs(x) + 3 / (abs(x) + 4 / (abs(x) + 0.65D))))) / {CDF_ROOT_2_PI}D"
    tail = f"(CASE WHEN abs(x) > 37 THEN 0D WHEN abs(x) < {CDF_SPLIT}D THEN {e} * {horner(CDF_NUMERATOR)} / {horner(CDF_DENOMINATOR)} ELSE {far} END)"
    define("norm_cdf(x DOUBLE)", f"CASE WHEN x > 0 THEN 1 - {tail} ELSE {tail} END")
    define("implied_jump_move(iv DOUBLE, base DOUBLE, days DOUBLE, per_year DOUBLE DEFAULT 252D)", "CASE WHEN abs(iv) > abs(base) THEN sqrt((iv * iv - base * base) * days / per_year) WHEN abs(iv) <= abs(base) THEN 0D END")
    inputs = "spot DOUBLE, strike DOUBLE, vol DOUBLE, tau DOUBLE, rate DOUBLE DEFAULT 0D"
    t = f"greatest(tau, {SHORTEST_TAU!r}D)"
    d1 = f"((ln(spot / strike) + (rate + vol * vol / 2) * {t}) / (vol * sqrt({t})))"
    valid = "spot > 0 AND strike > 0 AND vol > 0 AND tau >= 0"
    define(
        f"straddle_price({inputs})",
        f"CASE WHEN {valid} AND tau > 0 THEN spot * (2 * norm_cdf({d1}) - 1) - strike * exp(-rate * {t}) * (2 * norm_cdf({d1} - vol * sqrt({t})) - 1) WHEN {valid} THEN abs(spot - strike) END",
    )
    define(f"straddle_delta({inputs})", f"CASE WHEN {valid} AND tau > 0 THEN 2 * norm_cdf({d1}) - 1 WHEN {valid} THEN signum(spot - strike) END")
