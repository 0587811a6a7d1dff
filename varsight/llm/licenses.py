"""License scans: MinHash bands over text windows, verified by shingle containment.

A template is the wording of a license or of a notice that names it.  Texts are
cut into overlapping windows, half as long again as a template and a quarter of
it apart, for each length of templates; a window and a template whose shingle
sets are similar share a band of MinHash values with high probability, and
every template retrieved is then checked by the exact share of its shingles
that the window holds, and by the words that it demands whole: the name of the
license with its version.  A phrase that names a license by a name that no
template has is reported as ``unknown``.  Templates are few and fixed, so their
bands travel to the tasks and texts are never shuffled.

With ``rows`` values in a band, a pair of Jaccard similarity s shares one of b
bands with probability 1 - (1 - s ** rows) ** b.  A stretch of up to one and a
quarter template's length that holds the demanded share c of a template lies in
some window whole, and their similarity is then c / (2.5 - c) at least:
``bands_for`` takes the fewest bands that retrieve such a pair with the recall.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as tk
from .common import map_arrow
from .license_texts import demands as known_demands
from .license_texts import templates as known_templates

UNKNOWN = "unknown"

@dataclass(frozen=True)
class LicenseConfig:
    """width: words of a shingle.  containment: least share of a template's
    shingles in a window.  recall: share of the pairs of a window and a template
    it holds that the bands must retrieve.  rows: MinHash values of a band.
    """

    width: int = 3
    containment: float = 0.75
    recall: float = 0.999
    rows: int = 2

    @property
    def similarity(self) -> float:
        """The least Jaccard similarity of a window and a template that it holds."""
        return self.containment / (2.5 - self.containment)


DEFAULT = LicenseConfig()


def bands_for(cfg: LicenseConfig) -> int:
    """The fewest bands that retrieve a pair of the similarity with the recall."""
    return math.ceil(math.log(1 - cfg.recall) / math.log(1 - cfg.similarity**cfg.rows))


def _normal(data: np.ndarray) -> np.ndarray:
    """ASCII signs become blanks and letters lower case, so that wrapping and case don't matter."""
    return _FOLD[data]


_FOLD = np.arange(256, dtype=np.uint8)
for _c in range(128):
    _FOLD[_c] = ord(chr(_c).lower()) if chr(_c).isalnum() else 0x20


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# Capitalized names that end as those of licenses do, after a phrase, or with a version; what goes on as the name of a rule or a body is none.
_NAMED = re.compile(
    rb"\b(?i:licensed|released|distributed|available|published)\s+(?i:under)\s+(?:(?i:the|a|an)\s+)?(?:(?i:terms)\s+(?i:of)\s+(?i:the)\s+)?"
    rb"((?:[A-Z0-9][\w.+-]*[\s,]+){1,8}?(?:License|Licence|LICENSE|LICENCE)|CC[ -][A-Z-]+[ -]\d+(?:\.\d+)*|(?:[A-Z]{2,}|[A-Z]+PL)[ -]?v?\d+(?:\.\d+)*)\b(?!\s+(?:Act|Board|Ordinance|Code|Law|Office|Agency|Commission|Department|Regulations?)\b)"
)


class Words:
    """A document's words in lower case, with what a version goes on with."""

    def __init__(self, raw: bytes):
        found = list(_WORD.finditer(raw))
        self.raw = raw
        self.words = [m[0].lower() for m in found]
        self.starts = [m.start() for m in found]
        self.dotted = [bool(re.match(rb"\.\d", raw[m.end() : m.end() + 2])) for m in found]

    def holds(self, wanted: list[bytes], first: int, end: int) -> bool:
        """Whether ``wanted`` lies word by word in a stretch, and no version goes on after it."""
        n = len(wanted)
        return any(self.words[i : i + n] == wanted and not (wanted[-1][-1:].isdigit() and self.dotted[i + n - 1]) for i in range(first, min(end, len(self.words)) - n + 1))

    def unknown(self, taken: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """Stretches that name a license after a phrase and overlap none that is known."""
        out = []
        for m in _NAMED.finditer(self.raw):
            first, end = np.searchsorted(self.starts, [m.start(), m.end()]).tolist()
            if all(end <= a or first >= b for _, a, b, _ in taken):
                out.append((UNKNOWN, first, end, 0.0))
        return out


class TemplateIndex:
    """Templates by length class, with their bands, shingle sets and demanded words."""

    def __init__(self, templates: dict[str, list[str]], cfg: LicenseConfig, demands: dict[tuple[str, str], list[str]] | None = None):
        self.cfg, self.bands = cfg, bands_for(cfg)
        self.demands: list[list[list[bytes]]] = []
        n = self.bands * cfg.rows
        rng = np.random.default_rng(8)
        self.seeds = rng.integers(1, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mixers = rng.integers(1, 1 << 63, size=cfg.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.names, self.sets, spans = [], [], []
        for name, texts in templates.items():
            for text in texts:
                raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
                words, ranges = tk.word_hashes(_normal(raw), np.array([0, len(raw)]))
                shingles, _ = tk.shingle_hashes(words, ranges, cfg.width)
                if len(shingles):
                    self.names.append(name)
                    self.demands.append([[w.lower() for w in _WORD.findall(d.encode())] for d in (demands or {}).get((name, text), [])])
                    self.sets.append(np.unique(shingles))
                    spans.append(len(shingles))
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        # by length in shingles: its templates, the fewest shingles that must be met, and bands to templates
        self.classes: list[tuple[int, list[int], int, list[dict[int, list[int]]]]] = []
        for span in sorted(set(spans)):
            members = [i for i, s in enumerate(spans) if s == span]
            tables: list[dict[int, list[int]]] = [{} for _ in range(self.bands)]
            for i in members:
                for b, key in enumerate(self.band_keys(self.minhash(self.sets[i])[None, :])[0].tolist()):
                    tables[b].setdefault(key, []).append(i)
            least = min(math.ceil(cfg.containment * len(self.sets[i]) - 1e-9) for i in members)
            self.classes.append((span, members, least, tables))

    def minhash(self, shingles: np.ndarray) -> np.ndarray:
        return tk.mix64(shingles[:, None] * self.seeds).min(axis=0)

    def band_keys(self, values: np.ndarray) -> np.ndarray:
        v = values.reshape(len(values), self.bands, self.cfg.rows)
        return tk.mix64((v * self.mixers).sum(axis=2, dtype=np.uint64))

    def retrieved(self, window: np.ndarray, tables: list[dict[int, list[int]]]) -> set[int]:
        """Templates that share a band with the window's shingles."""
        keys = self.band_keys(self.minhash(np.unique(window))[None, :])[0].tolist()
        return {i for b, key in enumerate(keys) for i in tables[b].get(key, ())}

    def matches(self, shingles: np.ndarray, raw: bytes) -> list[tuple[str, int, int, float]]:
        """(license, first word, end word, containment) of stretches of a text that do not overlap, by place.

        Of templates that match overlapping stretches the one with most shingles
        met counts, then the fullest, then the first.
        """
        if not len(shingles) or not len(self.known):
            return []
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        hits = np.concatenate([[0], np.cumsum(self.known[at] == shingles)])
        if hits[-1] < min(least for _, _, least, _ in self.classes):
            return []
        words = Words(raw)
        found: set[tuple[int, float, int, int, int]] = set()
        for span, _, least, tables in self.classes:
            size, step = span + max(span // 2, 2), max(span // 4, 1)
            starts = np.arange(0, max(len(shingles) - size, 0) + step, step)
            ends = np.minimum(starts + size, len(shingles))
            # a window that meets too few known shingles holds no template
            for s, e in zip(*(x[hits[ends] - hits[np.minimum(starts, len(shingles))] >= least].tolist() for x in (starts, ends)), strict=True):
                window = shingles[s:e]
                for i in self.retrieved(window, tables):
                    place = np.flatnonzero(np.isin(window, self.sets[i]))
                    met = len(np.unique(window[place]))
                    share = met / len(self.sets[i])
                    if share < self.cfg.containment:
                        continue
                    first, end = s + int(place[0]), s + int(place[-1]) + self.cfg.width
                    if all(words.holds(d, first, end) for d in self.demands[i]):
                        found.add((-met, -share, i, first, end))
        kept: list[tuple[str, int, int, float]] = []
        for _, share, i, first, end in sorted(found):
            if all(end <= a or first >= b for _, a, b, _ in kept):
                kept.append((self.names[i], first, end, -share))
        return sorted(kept, key=lambda m: m[1])


def _scan(index: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            found = []
            for first, end, data, offsets in tk.text_blocks(batch.column("text")):
                words, ranges = tk.word_hashes(_normal(data), offsets)
                shingles, spans = tk.shingle_hashes(words, ranges, ix.cfg.width)
                for d in range(end - first):
                    raw = data[offsets[d] : offsets[d + 1]].tobytes()
                    known = ix.matches(shingles[spans[d] : spans[d + 1]], raw)
                    found.append(sorted(known + (Words(raw).unknown(known) if ix.sets and _NAMED.search(raw) else []), key=lambda m: m[1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({m[0] for m in f})) for f in found], pa.string()),
                    pa.array([max((m[3] for m in f), default=0.0) for f in found], pa.float64()),
                    pa.array([",".join(f"{name}:{a}:{b}:{share:.3f}" for name, a, b, share in f) for f in found], pa.string()),
                ],
                ["doc_id", "n_matches", "licenses", "best_containment", "spans"],
            )

    return run


def scan_licenses(documents: DataFrame, cfg: LicenseConfig = DEFAULT, templates: dict[str, list[str]] | None = None, demands: dict[tuple[str, str], list[str]] | None = None) -> DataFrame:
    """Per row: doc_id, the number of stretches that hold a template, their licenses by name, the best containment, and the stretches.

    A stretch is ``license:first word:end word:containment``; ASCII signs part
    words and letters' case does not matter.  ``demands`` names by license and
    template what a stretch must hold whole; the templates known here have
    theirs.  A license whose name no template has is ``unknown``, with a
    containment of 0, where a phrase and a capitalized name point to it.  Null, empty and blank texts hold
    none; repeated rows give repeated results; without templates nothing is found.
    """
    index = documents.sparkSession.sparkContext.broadcast(TemplateIndex(known_templates(), cfg, known_demands()) if templates is None else TemplateIndex(templates, cfg, demands))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(map_arrow, _scan(index), "doc_id long, n_matches long, licenses string, best_containment double, spans string")
