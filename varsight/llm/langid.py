"""Language identification by unigram models summed over all segmentations.

The pieces are those of a public byte-level vocabulary, which stays fixed; only
their probabilities are learned, one distribution per language, by expectation
maximisation over the words of labelled texts.  A word's probability under a
language sums over every way to cut it into pieces, with a forward recursion
over its bytes; a text's is the product over its words.

Words are maximal runs of letters of the lower-cased text, each with a blank
before it, and are never cut.  Those longer than ``WORD_BYTES`` are summed in
logarithms, as their probabilities may be too small for a double.

All values of ``lang`` are learned.  A language's probabilities are kept as
those of the pieces that its texts use and one for all others; languages are
gone through in blocks, so what a task holds at once does not depend on how
many there are.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import textkernels as tk
from .common import is_held_out, map_arrow, materialize, smallest, tokenizer_path

WORD_BYTES = 32
CACHE_WORDS = 1_000_000
CACHE_CELLS = 8_000_000  # words times languages
CACHE_BYTES = 64 << 20
BLOCK_CELLS = 1 << 22
_LETTERS = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class LanguageConfig:
    """texts: bound of the labelled texts per language, those with the smallest
    hash of their ids.  rounds: of expectation maximisation.  floor:
    pseudo-count of every piece.  block: languages whose probabilities a task
    lays out at once.
    """

    vocabulary: str = "byte_bpe_multi_50k.tiktoken"
    texts: int = 400
    rounds: int = 3
    floor: float = 0.05
    block: int = 16


DEFAULT = LanguageConfig()


class PieceTable:
    """Looks up byte substrings among the pieces of a vocabulary."""

    def __init__(self, path: str):
        pieces = {bytes([b]) for b in range(256)}
        for line in open(path, "rb"):
            token, _ = line.split()
            pieces.add(base64.b64decode(token))
        self.pieces = sorted(pieces)
        self.longest = max(map(len, self.pieces))
        hashes = np.array([self._of(np.frombuffer(p, dtype=np.uint8)[None, :])[0, -1] for p in self.pieces], dtype=np.uint64)
        self._order = np.argsort(hashes)
        self._sorted = hashes[self._order]
        if len(np.unique(self._sorted)) != len(self.pieces):
            raise ValueError("two pieces share a hash")
        self._maybe = np.zeros(1 << 21, dtype=bool)
        self._maybe[tk.mix64(hashes) >> np.uint64(43)] = True

    def _of(self, rows: np.ndarray) -> np.ndarray:
        """Prefix sums of rows of bytes; their differences hash substrings."""
        n = rows.shape[1]
        sums = np.zeros((rows.shape[0], n + 1), dtype=np.uint64)
        np.cumsum(tk._BYTE[rows] * tk._power_tables(n + 1)[0][:n], axis=1, out=sums[:, 1:])
        return sums

    def spans(self, rows: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For words of one length, (start, end) to the words whose bytes there are a piece, and the piece.

        In order of end, then start.
        """
        sums, n = self._of(rows), rows.shape[1]
        inverse = tk._power_tables(n + 1)[1]
        words, starts, ends, pieces = [], [], [], []
        for size in range(1, min(self.longest, n) + 1):
            h = (sums[:, size:] - sums[:, :-size]) * inverse[: n - size + 1]
            w, start = np.nonzero(self._maybe[tk.mix64(h) >> np.uint64(43)])
            h = h[w, start]
            k = np.minimum(np.searchsorted(self._sorted, h), len(self._sorted) - 1)
            real = self._sorted[k] == h
            words.append(w[real])
            starts.append(start[real])
            ends.append(start[real] + size)
            pieces.append(self._order[k[real]])
        word, start, end, piece = map(np.concatenate, (words, starts, ends, pieces))
        order = np.lexsort((word, start, end))
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        cuts = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])]))
        bounds = [*cuts.tolist(), len(word)]
        keys = zip(start[cuts].tolist(), end[cuts].tolist(), strict=True)
        return {key: (word[lo:hi], piece[lo:hi]) for key, lo, hi in zip(keys, bounds[:-1], bounds[1:], strict=True)}


_tables: dict[str, PieceTable] = {}


def piece_table(cfg: LanguageConfig) -> PieceTable:
    if cfg.vocabulary not in _tables:
        _tables[cfg.vocabulary] = PieceTable(tokenizer_path(cfg.vocabulary))
    return _tables[cfg.vocabulary]


def words_of(text: str) -> list[bytes]:
    """The text's words as bytes, a blank before each."""
    return [(" " + w).encode("utf-8") for w in _LETTERS.findall(text.lower())]


def _by_length(words: list[bytes], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length, so many that ``columns`` numbers per byte stay bounded (one word at least)."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes).tolist():
        same = np.flatnonzero(sizes == n)
        most = max(1, BLOCK_CELLS // (n * max(columns, 1)))
        for lo in range(0, len(same), most):
            at = same[lo : lo + most]
            yield at, np.frombuffer(b"".join(words[i] for i in at), dtype=np.uint8).reshape(len(at), n)


def _forward(spans: dict, count: int, n: int, p: np.ndarray) -> np.ndarray:
    """alpha[i, word, language]: probability of the first i bytes, summed over segmentations."""
    alpha = np.zeros((n + 1, count, p.shape[1]))
    alpha[0] = 1
    for (start, end), (at, piece) in spans.items():
        alpha[end, at] += alpha[start, at] * p[piece]
    return alpha


def _forward_logs(spans: dict, count: int, n: int, p: np.ndarray, longest: int) -> np.ndarray:
    """Logs of the words' probabilities; keeps as many places as the longest piece has bytes."""
    ring = np.full((longest + 1, count, p.shape[1]), -np.inf)
    ring[0] = 0
    last = 0
    for (start, end), (at, piece) in spans.items():
        if end != last:
            ring[end % (longest + 1)] = -np.inf
            last = end
        k = end % (longest + 1)
        ring[k, at] = np.logaddexp(ring[k, at], ring[start % (longest + 1), at] + np.log(p[piece]))
    return ring[n % (longest + 1)]


def log_likelihoods(words: list[bytes], p: np.ndarray, table: PieceTable) -> np.ndarray:
    """Natural logs of the words' probabilities, one column per language."""
    out = np.zeros((len(words), p.shape[1]))
    for at, rows in _by_length(words, p.shape[1]):
        spans, n = table.spans(rows), rows.shape[1]
        if n > WORD_BYTES:
            out[at] = _forward_logs(spans, len(at), n, p, table.longest)
        else:
            out[at] = np.log(np.maximum(_forward(spans, len(at), n, p)[-1], 1e-300))
    return out


def expected_counts(words: list[bytes], times: np.ndarray, p: np.ndarray, table: PieceTable) -> np.ndarray:
    """Expected uses of every piece in a language's words, over all their segmentations."""
    out = np.zeros_like(p)
    for at, rows in _by_length(words, 1):
        spans, n = table.spans(rows), rows.shape[1]
        if n > WORD_BYTES:
            _expect_logs(spans, len(at), n, times[at], p, out)
            continue
        alpha = np.zeros((n + 1, len(at)))
        beta = np.zeros((n + 1, len(at)))
        alpha[0] = beta[n] = 1
        for (start, end), (w, piece) in spans.items():
            alpha[end, w] += alpha[start, w] * p[piece]
        for (start, end), (w, piece) in sorted(spans.items(), key=lambda s: -s[0][0]):
            beta[start, w] += beta[end, w] * p[piece]
        scale = times[at] / np.maximum(alpha[n], 1e-300)
        for (start, end), (w, piece) in spans.items():
            np.add.at(out, piece, alpha[start, w] * p[piece] * beta[end, w] * scale[w])
    return out


def _expect_logs(spans: dict, count: int, n: int, times: np.ndarray, p: np.ndarray, out: np.ndarray) -> None:
    """``expected_counts`` of words of one length, in logarithms, added to ``out``."""
    alpha = np.full((n + 1, count), -np.inf)
    beta = np.full((n + 1, count), -np.inf)
    alpha[0] = beta[n] = 0
    for (start, end), (w, piece) in spans.items():
        alpha[end, w] = np.logaddexp(alpha[end, w], alpha[start, w] + np.log(p[piece]))
    for (start, end), (w, piece) in sorted(spans.items(), key=lambda s: -s[0][0]):
        beta[start, w] = np.logaddexp(beta[start, w], beta[end, w] + np.log(p[piece]))
    for (start, end), (w, piece) in spans.items():
        share = np.exp(alpha[start, w] + np.log(p[piece]) + beta[end, w] - alpha[n, w])
        np.add.at(out, piece, share * times[w])


@dataclass(frozen=True)
class LanguageModel:
    """languages: their codes, in order.  pieces, chances: of each, the pieces
    its texts use and their probabilities.  rest: probability of any other piece.
    """

    config: LanguageConfig
    languages: list[str]
    pieces: list[np.ndarray]
    chances: list[np.ndarray]
    rest: np.ndarray

    def columns(self, first: int, end: int, size: int) -> np.ndarray:
        """Probabilities of all pieces, one column per language from ``first`` to ``end``."""
        p = np.tile(self.rest[first:end], (size, 1))
        for k in range(first, min(end, len(self.languages))):
            p[self.pieces[k], k - first] = self.chances[k]
        return p


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            for w, n in Counter(words_of(text or "")).items():
                counts[lang, w] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"]
        )


def _expect(model: object) -> Callable:
    """Rows ``(lang, word, n)`` in order of lang to expected uses of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        table, number = piece_table(m.config), {x: i for i, x in enumerate(m.languages)}
        lang, p, total = None, None, None

        def told() -> pa.RecordBatch:
            piece = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(np.full(len(piece), number[lang], dtype=np.int32)), pa.array(total[piece])], ["piece", "lang", "n"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            cut = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)] if len(langs) else [0]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if langs[lo] != lang:
                    if lang is not None:
                        yield told()
                    lang = langs[lo]
                    p = m.columns(number[lang], number[lang] + 1, len(table.pieces))[:, 0]
                    total = np.zeros_like(p)
                part = batch.slice(lo, hi - lo)
                total += expected_counts(part.column("word").to_pylist(), part.column("n").to_numpy().astype(float), p, table)
        if lang is not None:
            yield told()

    return run


def fit(documents: DataFrame, cfg: LanguageConfig = DEFAULT) -> LanguageModel:
    """Learn from rows outside the held-out fold whose language and text are known.

    The ids are counted by language and then filtered by a bound on their hash,
    which chooses the texts of all languages at once; rows that repeat an id
    and language count as one.
    """
    sc = documents.sparkSession.sparkContext
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    chosen = smallest(rows.select("doc_id", "lang"), cfg.texts, F.xxhash64("doc_id"), by="lang")
    # as many rows as texts of each language are learned from: two numbers each, so the texts stay where they are
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("text", "lang")
    words = sample.transform(map_arrow, _count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    table = piece_table(cfg)
    size, k = len(table.pieces), len(languages)
    # a start that favours no long piece
    start = 0.2 ** np.array([len(x) for x in table.pieces]) / size
    model = LanguageModel(cfg, languages, [np.arange(size)] * k, [start] * k, np.zeros(k))
    for _ in range(cfg.rounds if k else 0):
        dealt = words.repartition("lang", F.pmod(F.xxhash64("word"), F.lit(8))).sortWithinPartitions("lang", "word")
        found = dealt.transform(map_arrow, _expect(sc.broadcast(model)), "piece int, lang int, n double")
        found = found.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "piece"])
        lang, piece, n = (found[c].to_numpy() for c in ("lang", "piece", "n"))
        cut = np.searchsorted(lang, np.arange(k + 1))
        totals = np.array([n[cut[i] : cut[i + 1]].sum() for i in range(k)]) + cfg.floor * size
        pieces = [piece[cut[i] : cut[i + 1]] for i in range(k)]
        chances = [(n[cut[i] : cut[i + 1]] + cfg.floor) / totals[i] for i in range(k)]
        model = LanguageModel(cfg, languages, pieces, chances, cfg.floor / totals)
    return model


def _identify(model: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        table, languages = piece_table(m.config), m.languages
        k = len(languages)
        blocks = [(lo, min(lo + m.config.block, k)) for lo in range(0, k, m.config.block)]
        rows: dict[bytes, int] = {}
        logs = np.zeros((0, k), dtype=np.float32)
        held = 0
        for batch in batches:
            for first, end, _, _ in tk.text_blocks(batch.column("text"), 4 * tk.BLOCK_BYTES):
                part = batch.slice(first, end - first)
                if len(rows) > min(CACHE_WORDS, CACHE_CELLS // max(k, 1)) or held > CACHE_BYTES:
                    rows, logs, held = {}, logs[:0], 0
                new: list[bytes] = []
                numbers, sizes = [], []
                for text in part.column("text").to_pylist():
                    words = words_of(text or "")
                    sizes.append(len(words))
                    for w in words:
                        at = rows.get(w)
                        if at is None:
                            at = rows[w] = len(rows)
                            new.append(w)
                            held += len(w)
                        numbers.append(at)
                fresh = np.zeros((len(new), k), dtype=np.float32)
                for lo, hi in blocks if new else []:
                    fresh[:, lo:hi] = log_likelihoods(new, m.columns(lo, hi, len(table.pieces)), table)
                logs = np.concatenate([logs, fresh])
                n = np.array(sizes)
                known = n > 0
                sums = np.zeros((len(n), k))
                owner = np.repeat(np.arange(len(n)), n)
                index = np.array(numbers, dtype=np.int64)
                for c in range(k):
                    sums[:, c] = np.bincount(owner, weights=logs[index, c], minlength=len(n))
                if k:
                    # words that follow each other are no independent evidence: certainty grows with the root of their number
                    evidence = sums / np.sqrt(np.maximum(n, 1))[:, None]
                    share = np.exp(evidence - evidence.max(axis=1, keepdims=True))
                    share /= share.sum(axis=1, keepdims=True)
                    best = evidence.argmax(axis=1)
                    pred = [languages[b] if some else "und" for b, some in zip(best, known, strict=True)]
                    score = np.where(known, share[np.arange(len(n)), best], 0.0)
                else:
                    pred, score = ["und"] * len(n), np.zeros(len(n))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "lang_score"])

    return run


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``documents``, ``lang_pred`` and ``lang_score``, from the text alone.

    ``und`` with score 0 where the text is null or has no letter, or where no
    language was learned; of equally likely languages the first by code.
    Columns of these two names are replaced.
    """
    documents = documents.drop("lang_pred", "lang_score")
    schema = StructType([*documents.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])
    return documents.transform(map_arrow, _identify(documents.sparkSession.sparkContext.broadcast(model)), schema)


def identify_documents(documents: DataFrame, cfg: LanguageConfig = DEFAULT) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; see ``identify``."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = identify(rows, fit(documents, cfg))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
