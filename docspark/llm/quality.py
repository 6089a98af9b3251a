"""Quality by a sparse rule ensemble: boosted trees over text statistics give conjunctive rules, lasso logistic weights select them,
and the selected rules become one Spark column expression.

Only statistics of the text enter; ids, languages, sources and labels do not. The trees and weights are fitted on the driver on
at most SAMPLE labelled rows (a documented parameter); statistics and scores cover all rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import blocks, crc_mod3, free_names, labelled_sample, small_batches, word_hashes
from docspark.llm.linear import fit_logistic, sigmoid

#: Labelled rows used for fitting at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, SHRINK = 40, 3, 32, 0.3
LASSO = 5e-4

STATS = (
    "bytes words upper lower digit space newline comma stop mark symbol high "
    "word_bytes long_words distinct top_word repeats pairs lines line_words distinct_lines"
).split()

_CLASS = np.full(256, 9, np.uint8)  # symbol
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", b",", b".;:", b"!?", (), range(128, 256))):
    _CLASS[list(_chars)] = _k if _k != 9 else 10
_CLASSES = 11


def _ratio(a, b):
    return a / np.maximum(b, 1)


def text_stats(texts: list[str | None]) -> np.ndarray:
    """A row of STATS for each text: log sizes, shares of character classes, of words and of lines. Null counts as empty, all zeros."""
    out = np.zeros((len(texts), len(STATS)))
    for first, part in blocks(texts, lower=False):
        buffer = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        kinds = _CLASS[buffer]
        sizes = np.array([len(x) for x in part])
        starts = np.cumsum(sizes + 1) - sizes - 1
        counts = np.stack([np.add.reduceat((kinds == k).astype(np.int64), starts) for k in range(_CLASSES)], 1).astype(float)
        counts[:, 4] -= 1  # the separator
        words, at = word_hashes(part)
        edges = np.flatnonzero(np.diff((kinds == 3) | (kinds == 4), prepend=True))  # where words start and end, in turn
        lengths = edges[1::2] - edges[::2]
        n = np.diff(at).astype(float)
        rows = out[first : first + len(part)]
        rows[:, 0], rows[:, 1] = np.log1p(sizes), np.log1p(n)
        shares = _ratio(counts, sizes[:, None])
        rows[:, 2:8] = shares[:, :6]
        rows[:, 8], rows[:, 9], rows[:, 10], rows[:, 11] = shares[:, 6], shares[:, 7], shares[:, 9], shares[:, 10]
        rows[:, 12] = _ratio(sizes - counts[:, 3] - counts[:, 4], n)
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if b > a:
                own = words[a:b]
                ordered = np.sort(own)
                runs = np.diff(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))))
                rows[i, 14], rows[i, 15] = len(runs) / (b - a), runs.max() / (b - a)
                rows[i, 16] = (own[1:] == own[:-1]).mean() if b - a > 1 else 0
                if b - a > 2:
                    rows[i, 17] = len(np.unique(own[1:] * np.uint64(3) + own[:-1])) / (b - a - 1)
                rows[i, 13] = lengths[a:b].max() / 100
            lines = [x for x in part[i].split(b"\n") if x]
            rows[i, 18], rows[i, 19] = np.log1p(len(lines)), (b - a) / max(1, len(lines))
            rows[i, 20] = len(set(lines)) / max(1, len(lines))
    return out


_STATS = T.StructType([T.StructField(name, T.DoubleType()) for name in STATS])


@F.arrow_udf(_STATS)
def stats(texts: pa.Array) -> pa.Array:
    """struct of STATS. Texts go to Python alone; the rest of a row stays in the JVM."""
    found = text_stats(texts.to_pylist())
    return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(STATS))], list(STATS))


# ---- rules ----

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is it above, cut) of each condition


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths to all nodes of boosted trees for the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)  # bin > c means value > cuts[c]
    score = np.zeros(len(y))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = sigmoid(score)
        g, h = y - p, p * (1 - p) + 1e-6
        nodes = [((), np.arange(len(y)))]
        for _ in range(DEPTH):
            below = []
            for path, rows in nodes:
                best = None
                g0, h0 = g[rows].sum(), h[rows].sum()
                for k, c in enumerate(cuts):
                    if len(rows) < 20 or not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, k], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, k], h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (g0 - gl) ** 2 / (h0 - hl + 1) - g0**2 / (h0 + 1)
                    gain[(hl < 0.5) | (h0 - hl < 0.5)] = -1
                    at = int(np.argmax(gain))
                    if gain[at] > 1e-3 and (best is None or gain[at] > best[0]):
                        best = (gain[at], k, at)
                if best is None:
                    score[rows] += SHRINK * g0 / (h0 + 1)
                    continue
                _, k, at = best
                high = binned[rows, k] > at
                for above, part in ((False, rows[~high]), (True, rows[high])):
                    longer = (*path, (k, above, float(cuts[k][at])))
                    rules[longer] = None
                    below.append((longer, part))
            nodes = below
        for _, rows in nodes:
            score[rows] += SHRINK * g[rows].sum() / (h[rows].sum() + 1)
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, k] > cut) == above for k, above, cut in rule])


class RuleModel:
    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))

    def column(self, stats: str) -> Column:
        """The score as a Spark expression over the struct column `stats`."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            tests = [F.col(stats)[STATS[k]] > F.lit(cut) if above else F.col(stats)[STATS[k]] <= F.lit(cut) for k, above, cut in rule]
            total = total + F.when(reduce(lambda a, b: a & b, tests), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Without rows the model says 0.5 everywhere; with one class, the class's rate."""
    if not len(y):
        return RuleModel([], 0.0)
    rules = tree_rules(x, y) if 0 < y.mean() < 1 else []
    matrix = np.stack([holds(r, x) for r in rules], 1) if rules else np.zeros((len(y), 0))
    _, first = np.unique(matrix, axis=1, return_index=True) if rules else (0, np.zeros(0, int))
    rules, matrix = [rules[i] for i in sorted(first)], matrix[:, sorted(first)]
    weights, intercept = fit_logistic(matrix, y, LASSO, 1e-5, 400)
    return RuleModel([(r, float(w)) for r, w in zip(rules, weights, strict=True) if w], intercept)


def fit_on(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> RuleModel:
    """Fits on at most `most` rows with a label, none of the held-out third.

    Labels without a document, null ids and null labels are left out; null and empty texts have zero statistics; very long texts are read
    whole; a repeated id counts once for each of its texts, as 1 if any of its labels is. Other columns are not read. Without rows the model
    says 0.5, with one class the class's rate.
    """
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, "quality", most).select("doc_id", "y", stats("text").alias("s")).select("doc_id", "y", "s.*")
    rows = rows.orderBy("doc_id", "bytes", "distinct").toPandas()
    return fit(rows[list(STATS)].to_numpy(float), rows.y.to_numpy(float))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, score, predicted: one row for each input row.

    Null and empty texts have zero statistics and their score; a null doc_id stays null with held_out false. Repeated rows are
    scored alike. Very long texts are read whole. Other columns are not read. Empty tables give empty results.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stats(F.col("text").cast("string")).alias("stats"))
    rows = rows.select("doc_id", F.coalesce(crc_mod3(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), model.column("stats").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least threshold, with all their columns, whatever their names.

    Each row is judged by its own text, read whole; ids may be null or repeated, and repeated rows fare alike. Null and empty texts have
    zero statistics and their score. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    (own,) = free_names(docs.columns, "stats")
    return docs.withColumn(own, stats(F.col("text").cast("string"))).where(model.column(own) >= threshold).drop(own)
