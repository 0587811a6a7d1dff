"""Counters that ride on jobs, and a run of the command line in few of them."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from varsight import cli
from varsight.operators import alignment, counters, decomposition, quality, report

from .conftest import sample_history


def _executions(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_counts_equal_those_of_a_pass(spark, sample):
    bars = quality.coerce_bars(sample[0])
    k = F.day("date")
    bars = bars.withColumn("high", F.when(k == 3, F.col("low") - 1).otherwise(F.col("high"))).withColumn("open", F.when(k == 5, None).when(k == 7, -1.0).otherwise(F.col("open")))
    told = quality.violations(bars).first().asDict()
    seen_bars, seen = counters.observe_bars(bars)
    before = _executions(spark)
    written = seen_bars.write.format("noop").mode("overwrite").save()
    assert written is None and _executions(spark) == before + 1
    got = seen.get
    assert _executions(spark) == before + 1
    for name, n in got.items():
        if name not in ("n_broken", "first_date", "last_date"):
            assert n == told[name], name
    assert got["n_rows"] == 521 and got["n_incomplete"] > 0 and got["n_broken"] > 0
    assert (got["first_date"], got["last_date"]) == bars.agg(F.min("date"), F.max("date")).first()


def test_counts_of_an_empty_table(spark, sample):
    none, seen = counters.observe_bars(quality.coerce_bars(sample[0]).limit(0))
    assert none.collect() == [] and seen.get["n_rows"] == 0 and seen.get["first_date"] is None


def test_counts_of_alignment_and_events(spark, sample):
    bars, announcements = sample
    late = announcements.unionByName(spark.createDataFrame([("SYN", dt.date(2030, 1, 1)), ("SYN", dt.date(2023, 1, 4))], announcements.schema))
    status, seen = counters.observe_alignment(alignment.align_events(bars, late))
    rows = status.collect()
    assert seen.get["n_aligned"] == 7 and sum(seen.get.values()) == len(rows) == 9
    events, seen = counters.observe_events(decomposition.decompose_events(bars, announcements))
    rows = events.collect()
    assert seen.get == {"n_events": 7, "n_clamped": sum(r["jump_clamped"] for r in rows)}


def test_outcomes_tell_the_stages_and_the_figures(spark, sample):
    events = decomposition.decompose_events(*sample)
    summary = decomposition.summarize(events)
    everyone = spark.createDataFrame([("SYN",), ("GONE",), ("GONE",)], "ticker string")
    done, seen = counters.observe_stages(report.outcomes(everyone, summary, None, summary.select("ticker")))
    rows = {r["ticker"]: r for r in done.collect()}
    assert set(rows) == {"SYN", "GONE"} and rows["SYN"]["summary"]["n_events"] == 7 and rows["GONE"]["summary"] is None
    assert rows["GONE"]["stages"] == {"decomposition": "failed", "vrp": "skipped", "backtest": "failed"}
    assert {r["ticker"]: r["stages"] for r in report.stage_status(everyone, summary, None, summary.select("ticker")).collect()} == {t: r["stages"] for t, r in rows.items()}
    assert seen.get["n_tickers"] == 2 and seen.get["n_decomposition_failed"] == 1 and seen.get["n_vrp_skipped"] == 2


@pytest.mark.parametrize("flags", [[], ["-q", "--no-backtest"], ["--strict-gaps", "--fail-fast"]])
def test_a_run_is_at_most_three_jobs(spark, sample, tmp_path, capsys, flags):
    bars, dates = sample_history()
    spark.createDataFrame(bars).write.parquet(str(tmp_path / "p"))
    sample[1].write.parquet(str(tmp_path / "e"))
    raw, announced = spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "e"))
    args = cli.build_parser().parse_args(["-t", "SYN", "--prices-csv", "p", "--earnings-csv", "e", *flags])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(cli, "_inputs", lambda *a: (raw, announced))
        before = _executions(spark)
        assert cli.analyze(spark, args) == 0
    assert _executions(spark) - before <= 3
    assert ("SYN: 7 events" in capsys.readouterr().out) == ("-q" not in flags)
    assert len(dates) == 7


def test_failures_are_told_by_ticker(spark, tmp_path, capsys):
    """A ticker without bars, one with bad bars, one with too few events and one without a date are rows of one run."""
    bars, dates = sample_history()
    good = spark.createDataFrame(bars)
    bad = good.withColumns({"ticker": F.lit("BAD"), "high": F.lit(1.0)})
    few, lone = good.withColumn("ticker", F.lit("FEW")), good.withColumn("ticker", F.lit("LONE"))
    raw = good.unionByName(bad).unionByName(few).unionByName(lone)
    raw.toPandas().to_csv(tmp_path / "p.csv", index=False)
    rows = [(t, d) for t in ("SYN", "BAD") for d in dates] + [("FEW", dates[0])]
    spark.createDataFrame(rows, "ticker string, announcement_date date").toPandas().to_csv(tmp_path / "e.csv", index=False)
    args = ["-t", "SYN", "BAD", "FEW", "LONE", "GONE", "--prices-csv", str(tmp_path / "p.csv"), "--earnings-csv", str(tmp_path / "e.csv")]
    assert cli.main(args) == 1
    said = capsys.readouterr().out
    assert "GONE: failed: no bars" in said and "BAD: failed: High < Low: 521" in said.replace("Open outside", "") and "LONE: failed: no event could be aligned" in said
    assert "FEW: failed: no event with enough history to trade" in said and "SYN: failed" not in said and "SYN: 7 events" in said
