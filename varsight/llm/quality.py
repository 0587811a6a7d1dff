"""Quality rules under weak supervision, in DataFrame functions alone.

Each rule votes that a text is good, that it is bad, or abstains.  What the
rules' votes are worth is not given: expectation-maximisation estimates, from
how they agree over all texts, each rule's accuracy and the share of good
texts, and a text is kept if the posterior probability that it is good is at
least one half.  No single rule decides, but for the base checks.

Votes of all rules form one small number, so the texts reduce to a histogram of
at most 3 ** rules vote patterns before anything reaches the driver, and the
posteriors go back as a literal array.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

GOOD, BAD, ABSTAIN = 2, 1, 0


@dataclass(frozen=True)
class QualityConfig:
    """window: words of a repeated stretch.  prior: first guess of the share of
    good texts; good_accuracy, bad_accuracy: of how often a vote for and against
    a text is right.  rounds: of the estimation.  trust: pseudo-votes that hold
    the estimates near the first guess.
    least_words, repeat_percent: the base checks.
    """

    window: int = 8
    prior: float = 0.85
    good_accuracy: float = 0.6
    bad_accuracy: float = 0.9
    rounds: int = 30
    trust: float = 20.0
    least_words: int = 20
    repeat_percent: int = 30


DEFAULT = QualityConfig()


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column, width: int) -> Column:
    """Words in windows whose hash occurs twice or more; ``hashes`` by first word."""

    def positions(ordered: Column) -> Column:
        # neighbours in the order of hashes are equal where a window repeats
        last = F.size(ordered) - 1
        same = F.filter(
            ordered,
            lambda x, i: ((i > 0) & (ordered[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (ordered[F.least(i + 1, last)]["h"] == x["h"])),
        )
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def total(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, s: F.struct((s + width).alias("end"), (a["n"] + s + width - F.greatest(a["end"], s)).alias("n"))
        return F.aggregate(starts, zero, step)["n"]

    numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return _bind(F.array_sort(numbered), lambda ordered: total(positions(ordered)))


def measure(documents: DataFrame, cfg: QualityConfig = DEFAULT) -> DataFrame:
    """``documents`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    and the further measures of the rules.  A null text has no word.  Columns of
    these names are replaced; ``judge_documents`` and ``keep_good`` keep the caller's apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = documents.withColumn("_text", text).withColumn("_words", F.array_remove(F.split("_text", r"[ \t-\r]+"), ""))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    df = df.withColumn("_lines", lines)
    df = df.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn("n_distinct", F.size(F.array_distinct("_words")).cast("long"))
    df = df.withColumn("n_marked", F.size(F.filter("_words", lambda w: w.rlike(r"^\p{L}+[.,;:]?$"))).cast("long"))
    df = df.withColumn("n_upper", F.char_length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long"))
    # hashes of windows by doubling: of 1, 2, 4 and 8 words
    hashes, width = F.transform("_words", lambda w: F.xxhash64(w)), 1
    while width < cfg.window:
        shifted = F.slice(F.col("_h"), width + 1, F.greatest(F.size("_h") - width, F.lit(0)))
        df = df.withColumn("_h", hashes)
        hashes = F.zip_with(F.slice("_h", 1, F.size(shifted)), shifted, lambda a, b: F.xxhash64(a, b))
        width *= 2
    if width != cfg.window:
        raise ValueError("window must be a power of two")
    df = df.withColumn("_h", hashes)
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("n_repeat_words", F.when(repeats, _covered(F.col("_h"), cfg.window)).otherwise(F.lit(0)).cast("long"))
    return df.drop("_text", "_words", "_lines", "_h")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_distinct", "n_marked", "n_upper", "n_repeat_words"]


def rules() -> dict[str, Column]:
    """Each rule's vote from the measures of ``measure``.

    A rule for a defect abstains where it sees none, as that says little about
    others; rules for signs of prose may also vote for a text.
    """
    n = F.col("n_words")

    def vote(bad: Column, good: Column | None = None) -> Column:
        chain = F.when(n == 0, ABSTAIN).when(bad, BAD)
        return (chain if good is None else chain.when(good, GOOD)).otherwise(ABSTAIN)

    return {
        "length": vote(n < 20, n >= 50),
        "symbols": vote(F.col("n_symbols") * 10 > n, F.col("n_symbols") * 100 <= n),
        "plain_words": vote((n >= 30) & (F.col("n_marked") * 100 < n * 60), F.col("n_marked") * 100 >= n * 85),
        "repeats": vote(F.col("n_repeat_words") * 4 > n),
        "lines": vote(F.col("n_dup_lines") * 4 > F.col("n_lines")),
        "variety": vote(F.col("n_distinct") * 100 < n * 15),
        "capitals": vote(F.col("n_upper") * 100 > F.col("word_chars") * 40),
    }


def _pattern(votes: list[Column]) -> Column:
    return reduce(lambda code, v: code * 3 + v, votes, F.lit(0)).cast("int")


def _votes(pattern: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return out[::-1]


def estimate(histogram: dict[int, int], n_rules: int, cfg: QualityConfig = DEFAULT) -> list[float]:
    """Posterior of every vote pattern, by expectation-maximisation over the histogram.

    Rules are taken as independent given the truth.  For either truth each has
    probabilities of its three votes, from which follow its accuracy and how
    often it abstains; they start from the first guess, which stays in as
    pseudo-counts.  An empty histogram gives the posteriors of the first guess.
    """
    patterns = {p: _votes(p, n_rules) for p in range(3**n_rules)}
    g, b = cfg.good_accuracy, cfg.bad_accuracy
    # odds of a vote are good : bad = g : 1 - g where it is GOOD, 1 - b : b where it is BAD
    guess = {1: (1.0, 1 - b, g), 0: (1.0, b, 1 - g)}
    chance = {y: [[v / sum(guess[y]) for v in guess[y]] for _ in range(n_rules)] for y in (0, 1)}
    prior = cfg.prior

    def posterior(votes: list[int], first: bool) -> float:
        odds = math.log(prior / (1 - prior))
        for k, v in enumerate(votes):
            if not (first and v == ABSTAIN):
                odds += math.log(chance[1][k][v] / chance[0][k][v])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

    total = sum(histogram.values())
    first = True
    for _ in range(cfg.rounds if total else 0):
        good = {p: posterior(patterns[p], first) for p in histogram}
        first = False
        prior = min(max(sum(histogram[p] * q for p, q in good.items()) / total, 0.02), 0.98)
        for y in (0, 1):
            for k in range(n_rules):
                counts = [cfg.trust * v / sum(guess[y]) for v in guess[y]]
                for p, n in histogram.items():
                    counts[patterns[p][k]] += n * (good[p] if y else 1 - good[p])
                chance[y][k] = [c / sum(counts) for c in counts]
    return [posterior(patterns[p], first) for p in range(3**n_rules)]


def _decided(measured: DataFrame, cfg: QualityConfig) -> DataFrame:
    """``measured`` with base_failed, quality and kept; reads it twice."""
    votes = list(rules().values())
    coded = measured.withColumn("_pattern", _pattern(votes))
    histogram = {r["_pattern"]: r["count"] for r in coded.groupBy("_pattern").count().collect()}
    posteriors = F.array(*[F.lit(p) for p in estimate(histogram, len(votes), cfg)])
    failed = (F.col("n_words") < cfg.least_words) | (100 * F.col("n_repeat_words") > cfg.repeat_percent * F.col("n_words"))
    coded = coded.withColumn("base_failed", failed).withColumn("quality", F.get(posteriors, F.col("_pattern")))
    return coded.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop("_pattern")


def judge_documents(documents: DataFrame, cfg: QualityConfig = DEFAULT) -> DataFrame:
    """doc_id, the measures, base_failed, quality and kept of every row.

    Null and blank texts have no word and fail the base checks; repeated rows
    are judged alike; other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = materialize(measure(rows, cfg).select("doc_id", *MEASURES), "measures")
    return _decided(measured, cfg)


def keep_good(documents: DataFrame, cfg: QualityConfig = DEFAULT) -> DataFrame:
    """The kept rows with their columns as they were."""
    columns = documents.columns
    kept = F.struct(*[F.col(c) for c in columns])
    rows = documents.select(kept.alias("_row"), F.col("text").alias("text"))
    measured = materialize(measure(rows, cfg).select("_row", *MEASURES), "measured")
    return _decided(measured, cfg).where("kept").select(*[F.col("_row")[c].alias(c) for c in columns])
