"""Language identification by hierarchical discrimination.

A text's family is decided first, then its language within that family; both levels
use one-versus-one linear support vector machines over hashed character 2- and 3-grams
of the lower-cased letters (anything else is a blank), log-scaled and of unit length.

Training takes at most `PER_LANGUAGE` rows of each language, those with the smallest id
hash: ids are chosen on a column-pruned scan, with the limit applied in each task before
the exchange, then their texts are read by a broadcast of these few ids. The machines
(squared hinge loss, accelerated gradient steps) and their logistic calibration are
fitted on the driver from that bounded matrix. Every row is predicted, whole.

Defined cases: a text that is null or has no letter gets `und` and score 0; so does
everything if no language was learned; with one language all letters are that, score 1;
rows without a language are predicted but not learned from; repeated rows are predicted
again; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquet.llm.tokens import forget

PER_LANGUAGE = 500
# Rows of all languages together.
MOST_ROWS = 20_000
DIMENSIONS = 2048
UNKNOWN = "und"

# Families of common languages; any other language is its own family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "indic": ("hi", "bn", "ur", "mr", "ne"),
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}

_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
_PART = 1 << 18


def family(language: str) -> str:
    return _FAMILY_OF.get(language, language)


def features(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Unit vector of hashed letter n-grams; None without a letter."""
    text = (text or "").lower()
    counts = np.zeros(dimensions)
    seen = False
    for at in range(0, len(text), _PART):
        # Parts overlap by the two characters that a 3-gram reaches over.
        over = min(at, 2)
        raw = text[at - over : at + _PART].encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, np.uint32)
        letters = _LETTER[codes]
        if not letters.any():
            continue
        seen = True
        codes = np.where(letters, codes, 32).astype(np.uint32)
        pairs = codes[:-1] * np.uint32(2654435761) + codes[1:] * np.uint32(40503)
        triples = pairs[:-1] * np.uint32(2246822519) + codes[2:] * np.uint32(3266489917)
        for grams in (pairs[max(0, over - 1) :], triples):
            spread = (grams ^ (grams >> np.uint32(15))) * np.uint32(2246822519)
            counts += np.bincount(spread >> np.uint32(32 - (dimensions - 1).bit_length()),
                                  minlength=dimensions)[:dimensions]
    if not seen:
        return None
    counts = np.log1p(counts)
    return counts / max(np.linalg.norm(counts), 1e-12)


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 300) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    rate = 1.0 / (1.0 + 2 * cost * (share[:, None] * x * x).sum())
    w = ahead = np.zeros(x.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = ahead / len(x) - 2 * cost * x.T @ (share * y * slack)
        new = ahead - rate * gradient
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def fit_slope(margins: np.ndarray, y: np.ndarray) -> float:
    """Slope of a logistic through 0 for margins, fitted by Newton steps."""
    target, slope = (y > 0) * 0.98 + 0.01, 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * margins, -30, 30)))
        step = ((p - target) * margins).sum() / ((p * (1 - p) * margins**2).sum() + 1e-6)
        slope = float(np.clip(slope - np.clip(step, -2, 2), 0.1, 50))
    return slope


@dataclass
class Duel:
    """Decides among classes by one machine for each pair of them."""

    classes: list[str]
    weights: np.ndarray
    slopes: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, classes: list[str]) -> "Duel":
        weights, slopes = [], []
        for a, b in itertools.combinations(classes, 2):
            of = (labels == a) | (labels == b)
            y = np.where(labels[of] == a, 1.0, -1.0)
            w = fit_machine(x[of], y)
            weights.append(w)
            slopes.append(fit_slope(x[of] @ w[:-1] + w[-1], y))
        return cls(classes, np.array(weights), np.array(slopes))

    def decide(self, v: np.ndarray) -> tuple[str, float]:
        """The class with most wins (then the largest margins), and how sure it is:
        its least probability against another class."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        margins = self.weights[:, :-1] @ v + self.weights[:, -1]
        p = 1 / (1 + np.exp(-np.clip(self.slopes * margins, -30, 30)))
        wins = np.zeros(len(self.classes))
        total, least = np.zeros(len(self.classes)), np.ones(len(self.classes))
        for (a, b), m, q in zip(itertools.combinations(range(len(self.classes)), 2), margins, p):
            wins[a if m >= 0 else b] += 1
            total[a], total[b] = total[a] + m, total[b] - m
            least[a], least[b] = min(least[a], q), min(least[b], 1 - q)
        best = max(range(len(self.classes)), key=lambda c: (wins[c], total[c], -c))
        return self.classes[best], float(least[best])


@dataclass
class LanguageModel:
    families: Duel | None
    languages: dict[str, Duel]
    dimensions: int = DIMENSIONS

    def predict(self, text: str | None) -> tuple[str, float]:
        v = features(text, self.dimensions) if self.families else None
        if v is None:
            return UNKNOWN, 0.0
        name, sure = self.families.decide(v)
        language, within = self.languages[name].decide(v)
        return language, sure * within


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, lang and text of at most `per_language` rows of each language, fewer where that would make
    more than `most` rows in all.

    Rows are chosen by id and digest of the text, so the bound holds whatever ids repeat; rows
    equal in all three count once.
    """
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").select(
        "doc_id", "lang", "text", F.xxhash64("text").alias("digest")
    )
    languages = rows.agg(F.approx_count_distinct("lang")).first()[0]
    each = max(1, min(per_language, most // max(languages, 1)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "digest")
    chosen = (
        rows.select("doc_id", "lang", "digest").withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= each).select("doc_id", "lang", "digest").distinct()
    )
    return rows.join(F.broadcast(chosen), ["doc_id", "lang", "digest"]).groupBy("doc_id", "lang", "digest").agg(
        F.first("text").alias("text")
    ).select("doc_id", "lang", "text")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> LanguageModel:
    """A model of the languages in `docs` (doc_id, lang, text)."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang.as_py(), features(text.as_py(), dimensions))
                    for lang, text in zip(batch.column("lang"), batch.column("text"))]
            rows = [(a, v.astype("<f4").tobytes()) for a, v in rows if v is not None]
            yield pa.record_batch(
                [pa.array([a for a, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.binary())],
                names=["lang", "v"],
            )

    got = training_rows(docs, per_language).mapInArrow(vectors, "lang string, v binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    if not got:
        return LanguageModel(None, {}, dimensions)
    x = np.array([np.frombuffer(r["v"], "<f4") for r in got], float)
    labels = np.array([r["lang"] for r in got], object)
    kin = np.array([family(a) for a in labels], object)
    names = sorted(set(kin))
    return LanguageModel(
        Duel.fit(x, kin, names),
        {n: Duel.fit(x[kin == n], labels[kin == n], sorted(set(labels[kin == n]))) for n in names},
        dimensions,
    )


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of every row with lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            columns = [batch.column(c) for c in keep if c != "text"] + [
                pa.array([a for a, _ in found], pa.string()),
                pa.array([s for _, s in found], pa.float64()),
            ]
            yield pa.record_batch(columns, names=[c for c in keep if c != "text"] + ["lang_pred", "score"])

    chosen = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = ", ".join(f"`{c}` {k}" for c, k in chosen.dtypes if c in keep and c != "text")
    return chosen.mapInArrow(run, f"{schema}, lang_pred string, score double")


def confident(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of `docs`, unchanged, whose text has a language with at least this score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield batch.filter(pa.array([a != UNKNOWN and s >= least for a, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
