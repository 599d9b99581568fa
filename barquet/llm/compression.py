"""Quality by compression: which of two dictionaries packs a text better.

A zstandard dictionary is built from good and another from bad labelled text. A text is
compressed with both, in blocks of `BLOCK` bytes so that a dictionary matters for all of
it and not for its beginning alone. The difference of the two sizes per byte, through a
logistic fitted on labelled texts that the dictionaries have not seen, is its score.

Training takes at most `PER_CLASS` rows of each label, those with the smallest id hash,
and of each a span of at most `SPAN` characters at a place chosen by the id's hash;
this bounds what the driver gets. Every row is scored, whole.

Defined cases: null text is empty text; an empty text has no difference and a score like
any other; without labelled rows of both kinds every score is 0.5; a row with several labels
counts with each; repeated rows are scored again; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_CLASS = 600
SPAN = 8_000
BLOCK = 2_048
DICTIONARY = 65_536
LEVEL = 3


def _blocks(text: str | None, block: int) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + block] for i in range(0, len(raw), block)]


def build_dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train on."""
    import zstandard

    blocks = [b for t in texts for b in _blocks(t, BLOCK // 2)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


@dataclass
class CompressionModel:
    """Dictionaries of good and bad text and the logistic over their difference."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    intercept: float = 0.0

    def _compressors(self):
        import zstandard

        if not hasattr(self, "_made"):
            self._made = [
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d),
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                ) for d in (self.good, self.bad)
            ]
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def difference(self, text: str | None) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / bytes of text."""
        good, bad = self._compressors()
        sizes = n = 0
        for b in _blocks(text, BLOCK):
            sizes += len(bad.compress(b)) - len(good.compress(b))
            n += len(b)
        return sizes / n if n else 0.0

    def score(self, text: str | None) -> float:
        z = self.slope * self.difference(text) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept by ridge Newton steps; label 1 weighs its `share` of all labels."""
    scale = x.std() or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    weight = np.where(y > 0, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    w = np.zeros(2)
    ridge = np.diag([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + ridge @ w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge
        w = w - np.clip(np.linalg.solve(hessian, gradient), -3, 3)
    return float(w[0] / scale), float(w[1])


def best_cut(x: np.ndarray, y: np.ndarray, share: float) -> float:
    """The difference from which on label 1 is likelier: most right answers, the shares of
    the labels counted; the middle of equally good ones."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    gain = np.where(y > 0, -share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    right = np.concatenate([[0.0], np.cumsum(gain)])
    cuts = np.concatenate([[x[0]], (x[1:] + x[:-1]) / 2, [x[-1]]])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(cuts[best[len(best) // 2]])


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, span: int = SPAN) -> DataFrame:
    """good (boolean), rank and a text span of at most `per_class` rows of each label.

    Labels are chosen first, then rows of their documents by id and digest of the text, so the bound
    holds whatever ids repeat in either table; rows equal in both count once.
    """
    marked = labels.filter("doc_id is not null and quality is not null").select(
        "doc_id", (F.col("quality") == 1).alias("good")
    ).distinct()
    side = Window.partitionBy("good")
    by_id = side.orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = marked.withColumn("rank", F.row_number().over(by_id)).filter(F.col("rank") <= per_class).drop("rank")
    rows = docs.filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("digest"))
    by_row = side.orderBy(F.xxhash64("doc_id"), "doc_id", "digest")
    found = rows.select("doc_id", "digest").join(F.broadcast(chosen), "doc_id").distinct()
    ranked = found.withColumn("rank", F.row_number().over(by_row)).filter(F.col("rank") <= per_class)
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - span + 1)).cast("int")
    return rows.join(F.broadcast(ranked), ["doc_id", "digest"]).select(
        "good", "rank", "doc_id", F.substring(F.col("text"), start + 1, F.lit(span)).alias("text")
    ).groupBy("good", "rank", "doc_id").agg(F.first("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> CompressionModel:
    """Dictionaries from the odd ranks, calibration from the even ones."""
    got = sorted(tuple(r) for r in training_rows(docs, labels, per_class).collect())
    known = labels.filter("quality is not null").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    side = {g: ([t for a, k, _, t in got if a == g and k % 2], [t for a, k, _, t in got if a == g and not k % 2])
            for g in (True, False)}
    if not all(side[True]) or not all(side[False]):
        return CompressionModel(b"", b"")
    model = CompressionModel(build_dictionary(side[True][0]), build_dictionary(side[False][0]))
    x = np.array([model.difference(t) for g in (True, False) for t in side[g][1]])
    y = np.array([g for g in (True, False) for _ in side[g][1]], float)
    share = min(max(known, 0.01), 0.99)
    model.slope, _ = fit_logistic(x, y, share)
    # Even odds lie where most labels, in their true shares, are told right.
    model.intercept = -model.slope * best_cut(x, y, share)
    return model


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.float64())],
                                  names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double"
    )
