"""Toxicity by a classifier chain: linear models for the categories in turn, each fed the earlier categories' probabilities.

The labels mark toxic documents only. The categories before the last are found in the training rows: of the words that tell toxic
documents best, one after the other that is in most toxic documents not covered yet leads a category, and the other strong words join the
leader they occur with most. A category holds for a toxic document with a word of its group. The last category is the label itself. While
fitting, the earlier probabilities are out-of-fold predictions, so that later models see them as they are on new documents; the threshold
is the one that serves the out-of-fold probabilities of the last category best (F1). Words enter as present or absent; the vocabulary holds
the words, and word beginnings, with the strongest association in the sample, by the two-proportion score. Fitting uses at most SAMPLE
labelled rows (a documented parameter); scoring reads all rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import Scratch, free_names, labelled_sample, small_batches
from docspark.llm.linear import fit_logistic, sigmoid

#: Labelled rows used for fitting at most.
SAMPLE = 20_000
#: Words in a model at most, the fewest sample documents a word must be in, and the folds.
VOCABULARY, LEAST_DOCS, FOLDS = 300, 5, 3
#: Least two-proportion score of a word, in standard deviations: words of no clear meaning must not speak by their absence.
LEAST_SCORE = 4.0
#: Words that may lead or join a category.
STRONG = 40
CATEGORIES = ("category_1", "category_2", "category_3", "toxic")
LASSO, RIDGE, STEPS = 1e-5, 5e-5, 400

_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that count as features beside whole words, so that inflected forms of a stem meet.
STEMS = (4, 5, 6)


def words_of(text: str | None) -> set[str]:
    """The lower-cased words of a text, and the beginnings of its longer words, marked by a star."""
    words = set(_WORD.findall(text.lower())) if text else set()
    for n in STEMS:
        stems = {w[:n] for w in words if len(w) > n}
        words.update([s + "*" for s in stems])
    return words


class Chain:
    """Vocabulary, and for each category its word weights, the weights of earlier categories and the intercept; and the threshold."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, carried: np.ndarray, intercepts: np.ndarray, threshold: float, groups: list[list[str]]):
        self.index = {w: i for i, w in enumerate(vocabulary)}
        self.weights, self.carried, self.intercepts, self.threshold, self.groups = weights, carried, intercepts, threshold, groups

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        index, base = self.index, np.tile(self.intercepts, (len(texts), 1))
        for row, text in zip(base, texts, strict=True):
            if found := [index[w] for w in words_of(text).intersection(index)]:
                row += self.weights[sorted(found)].sum(0)
        out = np.zeros_like(base)
        for k in range(base.shape[1]):
            out[:, k] = sigmoid(base[:, k] + out[:, :k] @ self.carried[k, :k])
        return out


def word_groups(x: np.ndarray, y: np.ndarray, count: int) -> list[np.ndarray]:
    """x: which sample documents have which word, the words in the order of their strength. -> the words (columns) of each category."""
    toxic = x[y == 1]
    common = toxic.mean(0) if len(toxic) else np.zeros(x.shape[1])
    strong = np.flatnonzero(common > (x[y == 0].mean(0) if (y == 0).any() else 0))[:STRONG]
    leaders, open_docs = [], np.ones(len(toxic), bool)
    for _ in range(min(count, len(strong))):
        rest = np.setdiff1d(strong, leaders, assume_unique=True)
        rest = rest[np.argsort(rest)]
        new = toxic[open_docs][:, rest].sum(0)
        if not new.any():
            break
        leader = int(rest[np.argmax(new)])  # the strongest of equals
        leaders.append(leader)
        open_docs &= toxic[:, leader] == 0
    groups = [[k] for k in leaders]
    size = np.sqrt(toxic.sum(0)) + 1e-9
    for k in strong:
        if k not in leaders:
            together = [(toxic[:, k] @ toxic[:, a]) / (size[k] * size[a]) for a in leaders]
            held = [toxic[:, g].any(1).sum() for g in groups]
            # With no leader at all: to the category of the fewest documents.
            groups[int(np.argmax(together)) if max(together) > 0 else int(np.argmin(held))].append(int(k))
    return [np.array(g, int) for g in groups] + [np.zeros(0, int)] * (count - len(groups))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut between two neighbouring probabilities with the best F1, of those above which half of the rows are toxic at least; of
    equals the one in the widest gap. Without such a cut, as where too few rows tell anything, and without toxic rows 1, which no
    probability reaches; with toxic ones alone 0.5."""
    if not 0 < y.sum() < len(y):
        return 0.5 if y.sum() else 1.0
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    gap = p - np.append(p[1:], 0.0)
    fits = (gap > 0) & (2 * hits >= np.arange(1, len(p) + 1))
    if not fits.any():
        return 1.0
    best = max(np.flatnonzero(fits), key=lambda i: (round(float(f1[i]), 9), gap[i]))
    return float(p[best] - gap[best] / 2)


def fit(sets: list[set[str]], y: np.ndarray, words: list[str]) -> Chain:
    """sets: the words of each text, of which only those in `words`, the vocabulary by strength, matter. Without rows, or with one class
    only, the chain says the class's rate for every text."""
    index = {w: i for i, w in enumerate(words)}
    k_all, d = len(CATEGORIES), len(words)
    x = np.zeros((len(sets), d + k_all - 1), np.float32)
    for row, s in zip(x, sets, strict=True):
        row[[index[w] for w in s.intersection(index)]] = 1
    groups = word_groups(x[:, :d], y, k_all - 1)
    weights, carried, intercepts = np.zeros((d, k_all)), np.zeros((k_all, k_all)), np.zeros(k_all)
    folds, apart = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for k in range(k_all):
        target = y * x[:, groups[k]].any(1) if k < k_all - 1 else y
        w, b = fit_logistic(x[:, : d + k], target, LASSO, RIDGE, STEPS)
        weights[:, k], carried[k, :k], intercepts[k] = w[:d], w[d:], b
        for f in range(FOLDS):
            w, b = fit_logistic(x[folds != f, : d + k], target[folds != f], LASSO, RIDGE, STEPS)
            apart[folds == f] = sigmoid(x[folds == f, : d + k] @ w + b)
        if k < k_all - 1:
            x[:, d + k] = apart
    return Chain(words, weights, carried, intercepts, best_threshold(apart, y), [[words[i] for i in g] for g in groups])


def _word_batches(batches):
    for batch in batches:
        found = [sorted(words_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.string())), batch.column("y")], ["doc_id", "words", "y"])


def fit_on(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Chain:
    """Fits on at most `most` rows with a label, none of the held-out third.

    Labels without a document, null ids and null labels are left out; null and empty texts have no words; very long texts are read whole; a
    repeated id counts once for each of its texts, toxic if any of its labels is; ties between words fall to the first in the alphabet. Other
    columns are not read. Without rows or with one class the chain says the class's rate, and without toxic rows finds no text toxic.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.keep(labelled_sample(docs, labels, "toxic", most).mapInArrow(_word_batches, "doc_id long, words array<string>, y int"), "words")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    words: list[str] = []
    if 0 < n1 < n:
        counts = rows.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("c"), F.sum("y").alias("c1")).where(F.col("c") >= LEAST_DOCS)
        p = F.col("c") / n
        gap = F.abs(F.col("c1") / n1 - (F.col("c") - F.col("c1")) / (n - n1)) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)) + 1e-9)
        words = [r.w for r in counts.where(gap >= LEAST_SCORE).orderBy(F.round(gap, 9).desc(), "w").limit(VOCABULARY).collect()]
    known = F.array(*(F.lit(w) for w in sorted(words))).cast("array<string>")
    found = rows.select("doc_id", "y", F.array_intersect("words", known).alias("words")).toPandas()  # SAMPLE rows of few words
    found["key"] = [" ".join(sorted(w)) for w in found["words"]]
    found = found.sort_values(["doc_id", "key"])
    scratch.drop("words")
    return fit([set(w) for w in found["words"]], found.y.to_numpy(float), words)


_SCORES = T.StructType([T.StructField(f"p_{c}", T.DoubleType()) for c in CATEGORIES])


def scores(text: Column, chain: Chain) -> Column:
    """struct of p_<category> for each category. Texts go to Python alone; the rest of a row stays in the JVM."""

    @F.arrow_udf(_SCORES)
    def run(texts: pa.Array) -> pa.Array:
        p = chain.probabilities(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(p.shape[1])], _SCORES.names)

    return run(text.cast("string"))


def score(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, p_<category> for each category, toxic (boolean): one row for each input row.

    Null and empty texts have no words and the intercepts' probabilities. Repeated rows are scored alike, a null doc_id stays
    null, whole texts are read, other columns are not. Empty tables give empty results. threshold: the chain's own if not given.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scores(F.col("text"), chain).alias("p")).select("doc_id", "p.*")
    return rows.withColumn("toxic", F.col("p_toxic") >= (chain.threshold if threshold is None else threshold))


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """The rows of docs that the chain finds clean, with all their columns, whatever their names.

    Each row is judged by its own text, read whole; ids may be null or repeated, and repeated rows fare alike. Null and empty texts are
    judged by the intercepts. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    (own,) = free_names(docs.columns, "scores")
    kept = docs.withColumn(own, scores(F.col("text"), chain)).where(F.col(own)["p_toxic"] < (chain.threshold if threshold is None else threshold))
    return kept.drop(own)
