"""Weighted lexicon scoring with Aho-Corasick over folded text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispersa.llm.common import remainder

# Look-alike letters of other scripts and digits or signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")
_SIGN_IN_WORD = re.compile(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])|(?<!\S)[@$](?=[^\W\d_])")
_FOLD = str.maketrans(HOMOGLYPHS | {k: v for k, v in SUBSTITUTES.items() if k.isdigit()})
_SIGNS = {k: v for k, v in SUBSTITUTES.items() if not k.isdigit()}
_ZERO_WIDTH = re.compile("[​‌‍⁠﻿­]")


def fold(text: str) -> list[str]:
    """Lower-cased words with homoglyphs and substituted digits and signs folded to the letters they stand for."""
    text = text.lower()
    if not text.isascii():
        text = _ZERO_WIDTH.sub("", text)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN_IN_WORD.sub(lambda m: _SIGNS[m[0]], text)
    return _WORD.findall(text.translate(_FOLD))


def _terms(words: Sequence[str]) -> set[str]:
    out = set(words)
    out |= {w[:n] + "*" for w in tuple(out) for n in STEMS if len(w) >= n}
    return out


def _counts(texts: DataFrame, of) -> DataFrame:
    """(term, toxic, clean): documents of each label that hold a term. Tasks count first."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seen = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(of(fold(text or "")))
            for label in (0, 1):
                keys = list(seen[label])
                if keys:
                    n = pa.array(list(seen[label].values()), pa.int64())
                    zero = pa.array(np.zeros(len(keys), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), n if label else zero, zero if label else n], ["term", "toxic", "clean"])

    rows = texts.select("text", F.col("label").cast("int")).mapInArrow(partial, "term string, toxic long, clean long")
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Lexicon:
    """Weights of words and stems ("stem*"), and phrases in which a match doesn't count."""

    def __init__(self, weights: dict[str, float], exceptions: Sequence[str] = ()):
        self.weights, self.exceptions = weights, tuple(exceptions)
        self.coef = np.array([-3.0, 1.0, 1.0])

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            key = f" {term[:-1]}" if term.endswith("*") else f" {term} "
            a.add_word(key, (w, len(key), not term.endswith("*")))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (None, len(phrase) + 2, True))
        a.make_automaton()
        return a

    def matches(self, automaton, words: Sequence[str]) -> list[tuple[int, int, float]]:
        """(first, last + 1, weight) of the strongest match at each place, outside exception phrases."""
        text = f" {' '.join(words)} "
        found, free = {}, []
        for end, (w, size, _) in automaton.iter(text):
            low = end - size + 1
            if w is None:
                free.append((low, end + 1))
            elif found.get(low, (0, 0.0))[1] < w:
                found[low] = (end + 1, w)
        return [(low, high, w) for low, (high, w) in found.items() if not any(a <= low and high <= b for a, b in free)]

    def features(self, automaton, words: Sequence[str]) -> tuple[float, float]:
        """Weight per length, and the weight of the strongest match."""
        hits = [w for *_, w in self.matches(automaton, words)]
        return sum(hits) / np.log2(8 + len(words)), max(hits, default=0.0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.coef[0] + np.log1p(x) @ self.coef[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> None:
        """Logistic regression of labels on the two features by Newton steps with a ridge."""
        a = np.hstack([np.ones((len(x), 1)), np.log1p(x)])
        b = np.zeros(3)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(3)
            b = b + np.linalg.solve(h, a.T @ (y - p) - ridge * b)
        self.coef = b


def choose_terms(rows: Sequence[tuple[str, int, int]], toxic: int, clean: int, least_odds: float, size: int) -> dict[str, float]:
    """Weights (log odds) of at most `size` terms; a stem stands for longer terms that are no stronger."""
    odds = {t: float(np.log((a + 0.5) / (toxic + 1) * (clean + 1) / (c + 0.5))) for t, a, c in rows}
    kept: dict[str, float] = {}
    for term, a, _ in sorted(rows, key=lambda r: (len(r[0].rstrip("*")), not r[0].endswith("*"), r[0])):
        body = term.rstrip("*")
        stem = next((f"{body[:n]}*" for n in STEMS if n <= len(body) and f"{body[:n]}*" != term and f"{body[:n]}*" in kept), None)
        if odds[term] >= np.log(least_odds) and not (stem and kept[stem] >= odds[term] - 1.0):
            kept[term] = odds[term]
    support = {t: a for t, a, _ in rows}
    best = sorted(kept, key=lambda t: (-kept[t] * support[t], t))[:size]
    return {t: kept[t] for t in best}


def fit_lexicon(docs: DataFrame, labels: DataFrame, sample: int = 20_000, size: int = 4000, least_docs: int = 3, least_odds: float = 12.0, exceptions: Sequence[str] = ()) -> Lexicon:
    """Learn weights, exception phrases and calibration from labels (id, label).

    At most `sample` labelled rows are read, the first by hash of the id, so the broadcast of their ids, the
    counts and the `size` terms that reach the driver are bounded at any input size.
    """
    chosen = labels.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("text", "label")
    totals = dict(chosen.groupBy("label").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    rows = _counts(texts, _terms).where((F.col("toxic") >= least_docs) & ((F.col("toxic") + 0.5) * (clean + 1) >= (F.col("clean") + 0.5) * (toxic + 1) * least_odds))
    rows = [tuple(r) for r in rows.orderBy(F.desc("toxic"), "term").limit(20 * size).collect()]
    lexicon = Lexicon(choose_terms(rows, toxic, clean, least_odds, size), exceptions)

    def phrases(words: list[str]) -> set[str]:
        automaton = lexicon._automaton = getattr(lexicon, "_automaton", None) or lexicon.automaton()
        at, place = {}, 1
        for i, w in enumerate(words):
            at[place - 1] = i
            place += len(w) + 1
        out = set()
        for low, *_ in lexicon.matches(automaton, words):
            i = at[low]
            out |= {" ".join(words[max(0, i - 1) : i + 1])} if i else set()
            out |= {" ".join(words[i : i + 2])} if i + 1 < len(words) else set()
        return out

    if lexicon.weights:
        harmless = _counts(texts, phrases).where((F.col("clean") >= max(3, least_docs)) & (F.col("toxic") == 0))
        harmless = [r[0] for r in harmless.orderBy(F.desc("clean"), "term").limit(size).collect()]
        weights, lexicon = lexicon.weights, Lexicon(lexicon.weights, sorted({*exceptions, *harmless}))
        lexicon.weights = weights

    def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in it:
            x = [lexicon.features(automaton, fold(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x]), pa.array([b for _, b in x]), batch.column(1)], ["x", "top", "label"])

    if toxic and clean and lexicon.weights:
        got = texts.select("text", F.col("label").cast("int")).mapInArrow(measured, "x double, top double, label int").collect()  # at most `sample` rows
        lexicon.calibrate(np.array([[r[0], r[1]] for r in got]), np.array([r[2] for r in got], float))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, matches) of every whole text; a map, nothing is shuffled. Null and empty texts have no match."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton() if lexicon.weights else None
        for batch in it:
            n, x = [], np.zeros((batch.num_rows, 2))
            for i, text in enumerate(batch.column(1)):
                hits = []
                if automaton is not None:
                    words = fold(text.as_py() or "")
                    hits = [w for *_, w in lexicon.matches(automaton, words)]
                    x[i] = sum(hits) / np.log2(8 + len(words)), max(hits, default=0.0)
                n.append(len(hits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lexicon.probability(x)), pa.array(n, pa.int32())], ["doc_id", "score", "matches"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, score double, matches int")


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and matches of every document; repeated rows score alike."""
    from dispersa.llm.quality import training_labels

    lexicon = fit_lexicon(docs, training_labels(labels, "toxic", modulus, held))
    out = score_toxicity(docs, lexicon)
    return out.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matches")
