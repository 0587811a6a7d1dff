"""Frames over a ticker's sessions, and guarded statistics in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_session() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("pp")


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker")


def positioned(bars: DataFrame) -> DataFrame:
    """Bars with ``pp`` (session number from 0), ``n_sessions`` and the log return ``r``.

    Closes must be positive; validation comes before.  A ticker is one window
    partition, of some thousands of sessions.
    """
    order = Window.partitionBy("ticker").orderBy("date")
    return (
        bars.withColumn("pp", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("n_sessions", F.count(F.lit(1)).over(by_ticker()))
        .withColumn("r", F.ln("close") - F.lag(F.ln("close")).over(order))
    )


def full(value: Column, observed: Column, frame: WindowSpec, size: int) -> Column:
    """``value`` where the frame holds ``size`` observations, else null."""
    return F.when(F.count(observed).over(frame) == size, value)


def variance(x: Column, zero_mean: bool, ddof: int, frame: WindowSpec | None = None) -> Column:
    """Mean square, or variance with ``ddof``; null where too few values."""

    def over(c: Column) -> Column:
        return c if frame is None else c.over(frame)

    if zero_mean:
        return over(F.avg(x * x))
    if ddof == 0:
        return over(F.var_pop(x))
    n = over(F.count(x))
    if ddof == 1:
        return F.when(n > 1, over(F.var_samp(x)))
    return F.when(n > ddof, over(F.var_pop(x)) * n / (n - ddof))


def sliding_moments(df: DataFrame, values: dict[str, Column], size: int) -> DataFrame:
    """Adds ``_m_<name>``, a struct of count, mean and sum of squares about the mean (n, mean, m2) of the last ``size`` rows.

    A frame that slides is gathered anew for each row.  Here positions are cut
    into blocks of ``size`` rows: each window is the end of one block and the
    start of the next.  Running moments along the blocks, forwards and backwards,
    give both, and two moments are merged about their means, without a
    difference of large sums.  A row's cost does not depend on ``size``.
    """
    df = df.withColumn("_b", F.floor(F.col("pp") / size)).withColumns({f"_x_{k}": v for k, v in values.items()})
    ahead = Window.partitionBy("ticker", "_b").orderBy("pp").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("ticker", "_b").orderBy(F.desc("pp")).rowsBetween(Window.unboundedPreceding, 0)

    def moments(name: str, along: WindowSpec) -> Column:
        x = F.col(f"_x_{name}")
        n = F.count(x).over(along)
        return F.struct(n.alias("n"), F.coalesce(F.avg(x).over(along), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(x).over(along) * n, F.lit(0.0)).alias("m2"))

    df = df.withColumns({f"_p_{k}": moments(k, ahead) for k in values}).withColumns({f"_s_{k}": moments(k, behind) for k in values})
    df = df.withColumns({f"_s_{k}": F.lag(f"_s_{k}", size - 1).over(by_session()) for k in values})
    ends_block = (F.col("pp") + 1) % size == 0

    def merged(name: str) -> Column:
        p, s = F.col(f"_p_{name}"), F.col(f"_s_{name}")
        n, gap = p["n"] + s["n"], p["mean"] - s["mean"]
        share = p["n"] / F.greatest(n, F.lit(1))
        both = F.struct(n.alias("n"), (s["mean"] + gap * share).alias("mean"), (p["m2"] + s["m2"] + gap * gap * s["n"] * share).alias("m2"))
        return F.when(ends_block | s.isNull(), p).otherwise(both)

    df = df.withColumns({f"_m_{k}": merged(k) for k in values})
    return df.drop("_b", *[f"_{part}_{k}" for part in "xps" for k in values])
