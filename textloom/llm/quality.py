"""Quality classifier: regularised quadratic discriminant on document statistics.

Statistics of the whole text are transformed towards normality. Per class, mean
and covariance come from sums over all labelled training rows (one aggregation,
a few hundred numbers to the driver). Each covariance is shrunk towards the
pooled one and then towards its diagonal; its Cholesky factor is kept. A score
is the logistic function of the difference of the Mahalanobis log densities plus
log prior odds.

Training uses only rows whose crc32(doc_id as text) mod 5 is not 0. Labels,
language, source and id never enter a score. Null and empty texts have the
statistics of "no words" and get a score like any other. Null labels are left
out; repeated label rows count once each. If a class has no training rows all
scores are the share of the other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import symbols as S
from textloom.llm.common import materialise, whole_text

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "newline", "mark", "bang", "symbol",
    "bar", "non_ascii", "distinct", "most_common", "same_as_last", "line_repeat",
)
THRESHOLD = 0.3
FOLDS = 5
#: Weight of the pooled covariance, then of the diagonal.
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.1
FLOOR = 1e-3
#: Added to a share's denominator, so that short texts have no extreme shares.
SMOOTH = 120

_CLASSES = np.zeros((256, 8))
for _k, _bytes in enumerate((range(65, 91), range(48, 58), (32, 9, 11, 12, 13), (10,), b".,;:?'\"()-", b"!", b"#$%&*+/<=>@\\^_`{}~[]", b"|")):
    for _b in _bytes:
        _CLASSES[_b, _k] = 1


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = n - int(counts[128:192].sum())
    upper, digit, space, newline, mark, bang, symbol, bar = counts @ _CLASSES
    wide = float(counts[192:].sum())
    words = text.split()
    m = len(words)
    tally = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    share = lambda x, of: float(np.log1p(1000 * x / (of + SMOOTH)))
    same = sum(map(bytes.__eq__, words, words[1:])) if m > 1 else 0
    return [
        float(np.log1p(chars)), float(np.log1p(m)), float(np.log1p((chars - space - newline) / max(m, 1))),
        share(upper, chars), share(digit, chars), share(space, chars), share(newline, chars), share(mark, chars),
        share(bang, chars), share(symbol, chars), share(bar, chars), share(wide, chars),
        float(np.log1p(len(tally)) / np.log1p(m)) if m else 1.0,
        share(max(tally.values(), default=0), m), share(same, m), share(len(lines) - len(set(lines)), len(lines)),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_buffer().to_pybytes() if t.as_buffer() else b"") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])
            S.trim()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclass(frozen=True)
class Model:
    """log prior odds of class 1; per class the mean, the inverse Cholesky factor and its log determinant."""

    odds: float
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    log_dets: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), 1 / (1 + np.exp(-self.odds)))
        dens = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) + d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(dens[1] - dens[0] + self.odds, -500, 500)))


def fit(x: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """From all training rows with a label. The labels, not the texts, are shuffled."""
    d = len(FEATURES)
    target = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    rows = x.where(~held_out(F.col("doc_id"))).join(target, "doc_id")
    at = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(a) for a in at]).alias("s"), F.array(*[F.sum(at[i] * at[j]) for i, j in pairs]).alias("p")
    )
    by = {r.y: r for r in sums.collect()}  # two rows
    if len(by) < 2:
        return Model(np.log((1 + (by[1].n if 1 in by else 0)) / (1 + (by[0].n if 0 in by else 0))), (), (), ())
    means, covs = [], []
    for y in (0, 1):
        n, mean = by[y].n, np.array(by[y].s) / by[y].n
        cov = np.zeros((d, d))
        for (i, j), v in zip(pairs, by[y].p, strict=True):
            cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
        means.append(mean)
        covs.append(cov)
    total = by[0].n + by[1].n
    pooled = (by[0].n * covs[0] + by[1].n * covs[1]) / total
    factors, dets = [], []
    for cov in covs:
        c = (1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled
        c = (1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.diag(np.diag(c)) + FLOOR * np.eye(d)
        f = np.linalg.inv(np.linalg.cholesky(c))
        factors.append(f)
        dets.append(float(np.log(np.diag(f)).sum()))
    return Model(float(np.log(by[1].n / by[0].n)), tuple(means), tuple(factors), tuple(dets))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    x = materialise(features(docs), "quality")
    return scored(x, fit(x, labels), threshold)


def scored(x: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.asarray(b.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(rows))], ["doc_id", "score"])

    kind = dict(x.dtypes)["doc_id"]
    out = x.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """*docs* without the rows that the classifier rejects, with all columns it had.

    Scores are computed again beside the rows (no join of texts).
    """
    model = fit(materialise(features(docs), "quality"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            x = np.array([statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in text]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold))
            S.trim()

    return docs.mapInArrow(run, docs.schema)
