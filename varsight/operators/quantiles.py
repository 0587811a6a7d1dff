"""Exact quantiles of groups of any size, by counting passes.

``percentile`` keeps every distinct value of a group in one buffer.  Here an
order statistic is known by its rank and by an open interval of values that
holds it.  A pass sketches the values of each interval, takes two of them around
the rank, and counts exactly how many lie below, at and above both: the rank is
then one of the two or lies in a part of the interval.  A sketch is off by one
in ``accuracy``, so a part holds a small share of the values, whatever they are;
as both values are excluded from it, passes end in any case.  What is left of an
interval is sorted once it is ``few``.  Counts, sketches and sums are combined
before they are shuffled, and rows of a group are dealt to ``salts`` parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class SelectConfig:
    """grid: values of a sketch that are read off.  accuracy: of the sketch, as
    in ``percentile_approx``; it holds some that many values.  few: values of an
    interval that one task sorts.  salts: parts of a group.
    """

    grid: int = 500
    accuracy: int = 5000
    few: int = 50_000
    salts: int = 32


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: as Parquet in the checkpoint folder, or in the executors' storage, which is recomputed where lost."""
    spark = df.sparkSession
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        return df.persist()
    path = f"{folder.get()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _between(low: Column, high: Column) -> Column:
    v = F.col("v")
    return (low.isNull() | (v > low)) & (high.isNull() | (v < high))


def _intervals(open_ranks: DataFrame, keys: list[str], cfg: SelectConfig, columns: list[Column]) -> DataFrame:
    """A row for each interval and part of its group."""
    bounds = open_ranks.groupBy(*keys, "low", "high", "below", "inside").agg(*columns)
    return bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(cfg.salts - 1))))


def _pass(values: DataFrame, active: DataFrame, keys: list[str], cfg: SelectConfig) -> DataFrame:
    """Narrower intervals for the ranks of ``active``."""
    on, bounds = [*keys, "salt"], ["low", "high", "below", "inside"]
    ranks = _intervals(active, keys, cfg, [F.sort_array(F.collect_set("rank")).alias("ranks")])
    held = values.join(ranks, on).where(_between(F.col("low"), F.col("high")))
    grid = F.array(*[F.lit(k / cfg.grid) for k in range(cfg.grid + 1)])
    sketch = held.groupBy(*keys, *bounds).agg(F.percentile_approx("v", grid, cfg.accuracy).alias("s"), F.first("ranks").alias("ranks"))
    share = (F.col("rank") - F.col("below") + 0.5) / F.col("inside")
    slack = 1.0 / cfg.accuracy
    at = lambda x: F.get("s", F.least(F.greatest(x.cast("int"), F.lit(0)), F.lit(cfg.grid)))
    cuts = sketch.select(*keys, *bounds, "s", F.explode("ranks").alias("rank"))
    cuts = cuts.withColumns({"lo": at(F.floor((share - slack) * cfg.grid)), "hi": at(F.ceil((share + slack) * cfg.grid))}).drop("s")
    cuts = _intervals(cuts, keys, cfg, [F.collect_list(F.struct("rank", "lo", "hi")).alias("cuts")])
    counted = values.join(cuts, on).where(_between(F.col("low"), F.col("high"))).select(*keys, *bounds, "v", F.explode("cuts").alias("c"))
    v, lo, hi = F.col("v"), F.col("c.lo"), F.col("c.hi")
    counts = counted.groupBy(*keys, *bounds, F.col("c.rank").alias("rank"), lo.alias("lo"), hi.alias("hi")).agg(
        F.count_if(v < lo).alias("below_lo"), F.count_if(v <= lo).alias("to_lo"), F.count_if(v < hi).alias("below_hi"), F.count_if(v <= hi).alias("to_hi")
    )
    a, low, high, below = F.col("rank") - F.col("below"), F.col("low"), F.col("high"), F.col("below")
    lo, hi, none = F.col("lo"), F.col("hi"), F.lit(None).cast("double")

    def case(low: Column, high: Column, below: Column, inside: Column, value: Column = none) -> Column:
        return F.struct(low.alias("low"), high.alias("high"), below.alias("below"), inside.alias("inside"), value.alias("value"))

    found = (
        F.when(a < F.col("below_lo"), case(low, lo, below, F.col("below_lo")))
        .when(a < F.col("to_lo"), case(low, high, below, F.lit(0).cast("long"), lo))
        .when(a < F.col("below_hi"), case(lo, hi, below + F.col("to_lo"), F.col("below_hi") - F.col("to_lo")))
        .when(a < F.col("to_hi"), case(low, high, below, F.lit(0).cast("long"), hi))
        .otherwise(case(hi, high, below + F.col("to_hi"), F.col("inside") - F.col("to_hi")))
    )
    return counts.select(*keys, "rank", found.alias("f")).select(*keys, "rank", "f.*")


def order_statistics(values: DataFrame, ranks: DataFrame, keys: list[str], cfg: SelectConfig) -> DataFrame:
    """``(*keys, rank, value)``: the values at ``ranks(*keys, n, rank)``, from 0, of ``values(*keys, v, salt)``."""
    nothing = F.lit(None).cast("double")
    state = ranks.select(*keys, "rank", nothing.alias("low"), nothing.alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), nothing.alias("value"))
    state = settled(state)
    while True:
        wide = F.col("value").isNull() & (F.col("inside") > cfg.few)
        active = state.where(wide)
        if active.isEmpty():
            break
        state = settled(state.where(~wide).unionByName(_pass(values, active, keys, cfg)))
    left = state.where("value is null")
    narrow = _intervals(left, keys, cfg, [F.collect_set("rank").alias("ranks")])
    held = values.join(narrow, [*keys, "salt"]).where(_between(F.col("low"), F.col("high")))
    place = F.row_number().over(Window.partitionBy(*keys, "low", "high", "below").orderBy("v")) - 1 + F.col("below")
    last = held.withColumn("rank", place.cast("long")).where(F.array_contains("ranks", F.col("rank"))).select(*keys, "rank", F.col("v").alias("value"))
    return state.where("value is not null").select(*keys, "rank", "value").unionByName(last)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: Sequence[float], cfg: SelectConfig | None = None) -> DataFrame:
    """``(*keys, n, quantiles)``: what ``percentile`` gives for each of ``quantiles``, as an array.

    Between two values it is interpolated.  Null values do not count, and groups
    that have no other, or a null in their key, are absent.
    """
    cfg = cfg or SelectConfig()
    if not quantiles or any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles must lie in [0, 1]")
    values = df.select(*keys, F.col(value).cast("double").alias("v")).dropna()
    values = settled(values.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(cfg.salts)).cast("int")))
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    at = [F.lit(float(q)) * (F.col("n") - 1) for q in quantiles]
    wanted = F.array_distinct(F.array(*[g(x).cast("long") for x in at for g in (F.floor, F.ceil)]))
    found = order_statistics(values, sizes.select(*keys, "n", F.explode(wanted).alias("rank")), keys, cfg)
    # two entries for each quantile at most
    known = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("by_rank"))

    def between(x: Column) -> Column:
        lower, upper = F.floor(x).cast("long"), F.ceil(x).cast("long")
        a, b = F.element_at("by_rank", lower), F.element_at("by_rank", upper)
        return F.when((lower == upper) | (a == b), a).otherwise((upper - x) * a + (x - lower) * b)

    return sizes.join(known, keys).select(*keys, "n", F.array(*[between(x) for x in at]).alias("quantiles"))
