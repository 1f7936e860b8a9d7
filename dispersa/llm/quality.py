"""Regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispersa.llm.common import materialise, remainder

FEATURES = (
    "log_words", "mean_word", "sd_word", "distinct", "top_word", "upper", "digit", "symbol", "stop_marks",
    "comma", "pipe", "line_words", "repeated_lines", "repeated_pairs", "repeated_runs", "deflate", "capital_words", "symbol_words",
)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text: logs of counts, logits of shares."""
    raw = text.encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8)
    n = max(1, len(b))
    hist = np.bincount(b, minlength=256)
    words = raw.split()
    k = len(words)
    sizes = np.fromiter(map(len, words), np.float64, k) if k else np.zeros(1)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if k else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    runs = sum(x == y for x, y in zip(words, words[1:], strict=False))
    letters = int(hist[_LETTER].sum())
    upper, digit = int(hist[65:91].sum()), int(hist[48:58].sum())
    stops, commas, pipes = int(hist[[33, 46, 63]].sum()), int(hist[44]), int(hist[124])
    spaces = int(hist[[9, 10, 11, 12, 13, 32]].sum())
    symbols = len(b) - letters - digit - spaces - int(hist[46]) - commas

    def share(x: float, of: float) -> float:
        return float(np.log((x + 0.5) / (max(of, x) - x + 0.5 + 0.02 * of)))

    capital = sum(w[:1].isupper() for w in words)
    marked = sum(not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,;:!?") for w in words)
    return [
        float(np.log1p(k)), float(np.log1p(sizes.mean())), float(np.log1p(sizes.std())), share(len(counts), k), share(top, k),
        share(upper, n), share(digit, n), share(symbols, n), share(stops, n), share(commas, n), share(pipes, n),
        float(np.log1p(k / max(1, len(lines)))), share(len(lines) - len(set(lines)), len(lines)), share(max(0, k - 1 - pairs), k), share(runs, k),
        float(np.log((len(zlib.compress(raw, 1)) + 1) / (len(raw) + 16))), share(capital, k), share(marked, k),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats ARRAY<DOUBLE>) of each document; a map over Arrow batches, nothing is shuffled. Null text: empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [statistics(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "stats"])

    return docs.select(id_col, text_col).mapInArrow(batches, f"id {kind}, stats array<double>")


def class_moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and second-moment matrix of `stats` for each label: tasks add up, Spark sums over tasks."""
    d = len(FEATURES)

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((d + 1, d + 1)) for c in (0, 1)}
        for batch in it:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, d)
            x = np.hstack([np.ones((len(x), 1)), x])
            y = np.asarray(batch.column(1))
            for c in (0, 1):
                sums[c] += x[y == c].T @ x[y == c]
        cells = np.arange((d + 1) ** 2, dtype=np.int32)
        for c, m in sums.items():
            if m[0, 0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), c, np.int32)), pa.array(cells), pa.array(m.ravel())], ["label", "cell", "v"])

    got = rows.select("stats", F.col("label").cast("int")).mapInArrow(partial, "label int, cell int, v double")
    out = {c: np.zeros((d + 1) ** 2) for c in (0, 1)}
    for label, cell, v in got.groupBy("label", "cell").agg(F.sum("v")).collect():  # 2 (d + 1)^2 rows, whatever the input
        out[label][cell] = v
    return {c: (int(m[0]), m.reshape(d + 1, d + 1)[0, 1:], m.reshape(d + 1, d + 1)[1:, 1:]) for c, m in out.items()}


class Discriminant:
    """Gaussian class densities with shrunken covariances; keeps means, Cholesky factors and log determinants."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], toward_pooled: float = 0.3, toward_diagonal: float = 0.1, prior: float | None = None):
        d = len(FEATURES)
        n = {c: m[0] for c, m in moments.items()}
        scatter, self.mean = {}, {}
        for c, (k, s, q) in moments.items():
            self.mean[c] = s / max(1, k)
            scatter[c] = q - k * np.outer(self.mean[c], self.mean[c])
        pooled = (scatter[0] + scatter[1]) / max(1, n[0] + n[1] - 2)
        self.factor, self.logdet = {}, {}
        for c in (0, 1):
            own = scatter[c] / max(1, n[c] - 1)
            cov = (1 - toward_pooled) * own + toward_pooled * pooled
            cov = (1 - toward_diagonal) * cov + toward_diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(d)
            low = np.linalg.cholesky(cov)
            self.factor[c] = np.linalg.inv(low)
            self.logdet[c] = 2 * np.log(np.diag(low)).sum()
        share = (n[1] + 1) / (n[0] + n[1] + 2) if prior is None else prior
        self.prior = float(np.log(share / (1 - share)))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 less that of label 0, with the prior's log odds."""
        half = {}
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            half[c] = -0.5 * ((z * z).sum(axis=1) + self.logdet[c])
        return half[1] - half[0] + self.prior

    def score(self, x: np.ndarray, spread: float = 4.0) -> np.ndarray:
        """Into 0..1, 0.5 where both classes are as likely; `spread` only keeps scores from piling up at the ends."""
        return 1 / (1 + np.exp(-np.clip(self.difference(x) / spread, -40, 40)))


def fit_quality(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all labelled rows of `stats` (id, stats) joined with labels (id, label); only moments reach the driver.

    Without any labelled row both classes get the same density: every score is the prior's.
    """
    return Discriminant(class_moments(stats.join(labels, "id")))


def score_quality(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(id, score) by the fitted discriminant; a map, nothing is shuffled."""
    kind = stats.schema["id"].dataType.simpleString()
    d = len(FEATURES)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    return stats.mapInArrow(batches, f"id {kind}, score double")


def training_labels(labels: DataFrame, column: str, modulus: int, held: int) -> DataFrame:
    """(id, label): one label a document outside the held-out remainder; null labels and ids are left out."""
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held))
    return rows.groupBy(F.col("doc_id").alias("id")).agg(F.max(column).alias("label"))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Repeated rows score alike, empty and null texts score as texts of no words. Labels, language and source
    are never inputs. The statistics are written once to the shared folder, then joined with the labels to
    fit and read again to score.
    """
    stats = materialise(document_statistics(docs))
    model = fit_quality(stats, training_labels(labels, "quality", modulus, held))
    out = score_quality(stats, model)
    return out.select(
        F.col("id").alias("doc_id"), (remainder("id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, modulus: int = 3, held: int = 1, sample: int = 20_000) -> DataFrame:
    """The documents, all columns, whose score is at least `least`.

    The discriminant is fitted on about `sample` labelled rows at most, those with the least hashes of their ids; these ids are few enough to go
    to every task, so that only the sample's statistics are worked out twice and no text is shuffled.
    """
    known = training_labels(labels, "quality", modulus, held)
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select("doc_id", "text").join(F.broadcast(known.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    model = fit_quality(document_statistics(texts), F.broadcast(known))
    at = docs.columns.index("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # mapInArrow doesn't take names with dots

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array([statistics(t or "") for t in batch.column(0).field(at).to_pylist()]).reshape(-1, len(FEATURES))
            row = batch.column(0).filter(pa.array(model.score(x) >= least))
            yield pa.RecordBatch.from_arrays(row.flatten(), names=[f.name for f in row.type])

    return rows.mapInArrow(batches, docs.schema)
