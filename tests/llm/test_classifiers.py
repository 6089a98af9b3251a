import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docspark.llm import quality, toxicity
from docspark.llm.linear import fit_logistic, sigmoid


def made(spark, n=600):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa", "zeta", "theta", "iota"]) for _ in range(rng.randint(30, 90))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "pathetic", "vexfoo", "vexbar", "vexbaz"]))
        text = " ".join(w) + "." if good else " ".join(x + "%%%" for x in w)
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_held_out(spark):
    docs, labels = made(spark)
    model = quality.fit_on(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(got[i].held_out == held(i) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in truth if held(i)]) > 0.95
    x = quality.text_stats([r.text for r in docs.orderBy("doc_id").collect()])
    assert np.allclose(model.score(x), [got[i].score for i in sorted(got)])


def test_quality_ignores_held_out_labels(spark):
    docs, labels = made(spark)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_on(docs, labels), quality.fit_on(docs, flipped)
    assert a.rules == b.rules and a.intercept == b.intercept


def test_quality_odd_rows(spark, odd_docs, no_docs):
    docs, labels = made(spark)
    model = quality.fit_on(docs, labels)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.score(no_docs, model).count() == 0
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in rows)
    empty = quality.fit_on(docs, labels.limit(0))
    assert empty.score(np.zeros((1, len(quality.STATS))))[0] == 0.5
    assert quality.fit(np.zeros((5, len(quality.STATS))), np.ones(5)).score(np.zeros((1, len(quality.STATS))))[0] > 0.9


def test_longest_word_of_the_whole_text():
    at = quality.STATS.index("long_words")
    texts = ["ab " * 5000 + "x" * 700, "ab\x0bé\tabcd", None, " \n", "x" * 30 + " " + "ab\r\n" * 9000 + "y" * 40 + "\x0c ", "", "z"]
    want = [max(map(len, (t or "").encode().split()), default=0) / 100 for t in texts]
    assert want[0] == 7 and np.allclose(quality.text_stats(texts)[:, at], want)


def plain_stats(text):
    """The statistics one by one, without arrays over several texts."""
    raw = (text or "").encode()
    n, words = len(raw), raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    share = lambda f: sum(map(f, raw)) / max(1, n)
    of = lambda chars: share(lambda c: c in chars)
    counted = Counter(words)
    word_bytes = sum(c not in b" \t\r\x0b\x0c\n" for c in raw)
    return [
        math.log1p(n), math.log1p(len(words)), share(lambda c: 65 <= c <= 90), share(lambda c: 97 <= c <= 122), share(lambda c: 48 <= c <= 57), of(b" \t\r\x0b\x0c"), of(b"\n"), of(b","), of(b".;:"), of(b"!?"),
        share(lambda c: c < 128 and not (chr(c).isalnum() or c in b" \t\r\x0b\x0c\n,.;:!?")), share(lambda c: c >= 128), word_bytes / max(1, len(words)), max(map(len, words), default=0) / 100,
        len(counted) / max(1, len(words)), max(counted.values(), default=0) / max(1, len(words)), sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1),
        len(set(zip(words, words[1:]))) / (len(words) - 1) if len(words) > 2 else 0, math.log1p(len(lines)), len(words) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)),
    ]


def test_statistics_against_their_plain_form():
    rng = random.Random(11)
    alphabet = ["ab", "AB", "é", "7", ",", ".", "!", "#", " ", " ", "\n", "\t", "中", "\x00", "the", "\x0b", "~"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice((0, 1, 5, 60, 900)))) for _ in range(150)]
    # Deciding words far behind: after word 4,096 and after a million bytes.
    texts += [None, "", " ", "\n\n", "x", "ab " * 5000 + "x" * 700, "word one two\n" * 90_000 + "y" * 999 + " end"]
    got = quality.text_stats(texts)
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain_stats(t), atol=1e-9), ((t or "")[:60], dict(zip(quality.STATS, zip(row, plain_stats(t)))))


def odd_names(docs):
    """Names that need quoting, and those that the operators use themselves."""
    for k, name in enumerate(("my col", "a-b", "tick`s", "a.b", "stats", "scores", "row", "p_toxic", "_words", "Stats_")):
        docs = docs.withColumn(name, F.lit(k))
    return docs


def test_odd_names(spark, odd_docs):
    docs, labels = made(spark)
    model, chain = quality.fit_on(docs, labels), toxicity.fit_on(docs, labels)
    named = odd_names(odd_docs)
    for kept, plain in ((quality.keep_good(named, model), quality.keep_good(odd_docs, model)), (toxicity.drop_toxic(named, chain), toxicity.drop_toxic(odd_docs, chain))):
        assert kept.columns == named.columns and kept.count() == plain.count()


def test_chain_against_its_plain_form(spark):
    """Each category's model by itself, with the probabilities of the earlier ones put in as further features."""
    docs, labels = made(spark)
    chain = toxicity.fit_on(docs, labels)
    words = list(chain.index)
    for r in toxicity.score(docs, chain).collect()[:200]:
        own, p = toxicity.words_of(docs_text(docs, r.doc_id)), []
        for k in range(len(toxicity.CATEGORIES)):
            z = chain.intercepts[k] + sum(chain.weights[i, k] for i, w in enumerate(words) if w in own) + sum(chain.carried[k, j] * p[j] for j in range(k))
            p.append(1 / (1 + math.exp(-z)))
        assert np.allclose([r[f"p_{c}"] for c in toxicity.CATEGORIES], p) and r.toxic == (p[-1] >= chain.threshold)


_texts = {}


def docs_text(docs, doc_id):
    if not _texts:
        _texts.update({r.doc_id: r.text for r in docs.collect()})
    return _texts[doc_id]


def test_categories_come_from_the_rows():
    """Two families of words that never stand together make categories of their own; no list of words is given."""
    x = np.zeros((60, 4), np.float32)
    x[:10, 0] = x[:8, 1] = x[10:18, 2] = x[12:18, 3] = 1
    y = (np.arange(60) < 20).astype(float)
    groups = toxicity.word_groups(x, y, 3)
    assert [g.tolist() for g in groups] == [[0, 1], [2, 3], []]
    assert [g.tolist() for g in toxicity.word_groups(x[:0], y[:0], 3)] == [[], [], []]
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1.0, 1, 0, 0])) == 0.55
    assert toxicity.best_threshold(np.array([0.9]), np.array([1.0])) == 0.5


def test_toxicity_held_out(spark):
    docs, labels = made(spark)
    chain = toxicity.fit_on(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([got[i].toxic == bool(truth[i]) for i in truth if held(i)]) > 0.97
    assert {f"p_{c}" for c in toxicity.CATEGORIES} <= set(toxicity.score(docs, chain).columns)
    # Later categories are fed by earlier ones.
    assert chain.carried.shape == (4, 4) and np.any(chain.carried[3, :3]) and not np.any(chain.carried[0])


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    docs, labels = made(spark)
    chain = toxicity.fit_on(docs, labels)
    rows = toxicity.score(odd_docs, chain).collect()
    assert len(rows) == 14 and not any(r.toxic for r in rows)
    kept = toxicity.drop_toxic(odd_docs, chain)
    assert kept.columns == odd_docs.columns and kept.count() == 14 and toxicity.drop_toxic(no_docs, chain).count() == 0
    assert toxicity.score(docs, toxicity.fit_on(docs, labels.limit(0))).count() == 600


def test_lasso_leaves_noise_out():
    rng = np.random.default_rng(1)
    x = rng.random((800, 12)) < 0.5
    w, b = fit_logistic(x, (x[:, 0] & x[:, 1]).astype(float), 0.02)
    assert w[0] > 0.5 and w[1] > 0.5 and np.abs(w[2:]).max() < 0.2 and 0 < sigmoid(np.array([b]))[0] < 0.5


def test_threshold_that_says_nothing_takes_nothing():
    import numpy as np

    from docspark.llm.toxicity import best_threshold

    y = np.array([1.0] + [0.0] * 9)
    assert best_threshold(np.full(10, 0.1), y) == 1.0
    assert best_threshold(np.linspace(0.1, 0.9, 10), y) == 1.0
    assert 0.2 < best_threshold(np.array([0.9] + [0.2] * 9), y) < 0.9
