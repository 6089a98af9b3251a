import random
import re

import numpy as np
import pytest

from docspark.llm import components as C
from docspark.llm import near_dedup as N
from docspark.llm.components import components
from docspark.llm.common import Scratch, shingle_hashes


def plain(rows):
    """Brute force: doc_id -> (size, component)."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"t{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(4, 200))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((n, " ".join(w)))
            n += 1
    # A chain: each links to the next only.
    long = [rng.choice(words) for _ in range(160)]
    rows += [(n + k, " ".join(long[k * 8 : k * 8 + 90])) for k in range(8)]
    rng.shuffle(rows)
    check(spark, rows)


def test_crowded_buckets(spark, monkeypatch):
    """Many variants of one text, most of them not linked with each other, over several blocks."""
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for n in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(120)] = f"x{n}"
        rows.append((n, " ".join(w)))
    check(spark, rows)


def test_odd_rows(odd_docs, no_docs):
    got = sorted((tuple(r) for r in N.near_duplicates(odd_docs).collect()), key=repr)
    by = {r[0]: r for r in got}
    assert len(got) == 14 and by[2][2] == by[3][2] == 1 and by[5] == (5, 0, 5, True) and by[6] == (6, 0, 6, True) and by[7][1] == 0
    assert by[8][1:] == (1, 8, True) and by[9][1:] == (1, 8, False) and by[11][3] and by[None][2] is None and by[None][3]
    kept = N.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 10, 11, 11, 12]
    assert N.near_duplicates(no_docs).count() == 0 and N.drop_near_duplicates(no_docs).count() == 0


def test_sketches_merge_and_estimate():
    hashes, starts = shingle_hashes([b" ".join(b"w%d" % i for i in range(k, k + 300)) for k in (0, 40)])
    both, _ = shingle_hashes([b" ".join(b"w%d" % i for i in range(340))])
    a, b = N.sketches(hashes, starts)
    union = N.sketches(both, np.array([0, len(both)]))[0]
    assert (N.merge(a, b) == union).all()
    same = (a == b).mean()
    assert abs(same - 256 / 336) < 0.12
    assert N.likely(a[None], b[None], np.array([296.0]), np.array([296.0]), 75)[0]
    assert not N.likely(a[None], b[None], np.array([296.0]), np.array([100.0]), 75)[0]
    assert (N.sketches(np.zeros(0, np.uint64), np.array([0, 0])) == 0).all()


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(50, 51), (51, 50), (60, 61), (61, 62), (60, 62)], "u long, v long")
    got = dict(map(tuple, components(edges, Scratch(spark, "t"), "c").collect()))
    assert all(got[k] == 1 for k in range(1, 31)) and got[51] == 50 and got[62] == got[61] == 60
    assert components(edges.limit(0), Scratch(spark, "t"), "c").count() == 0


@pytest.mark.parametrize("solved, tables", [(1_000_000, 1), (0, None), (150, None)])
def test_components_in_one_task_and_by_stars(spark, monkeypatch, solved, tables):
    """Few edges take one table however long the chains; more go by stars, to the end or until few are left."""
    monkeypatch.setattr(C, "SOLVED", solved, raising=False)
    kept = []

    class Counted(Scratch):
        def keep(self, df, name):
            kept.append(name)
            return super().keep(df, name)

    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200, 400)) for _ in range(150)] + [(k + 1, k) for k in range(1000, 1040)] * 2 + [(2**60, -5)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    got = sorted(map(tuple, components(spark.createDataFrame(edges, "u long, v long"), Counted(spark, "t"), "c").collect()))
    assert got == sorted((x, root(x)) for x in up)
    assert tables is None or len(kept) == tables


def test_a_pair_of_many_buckets_is_compared_once(monkeypatch):
    hashes, starts = shingle_hashes([b" ".join(b"w%d" % i for i in range(k, k + 100)) for k in (0, 4, 90)])
    (a, b, c), sets, tried = N.sketches(hashes, starts), [np.unique(hashes[x:y]).tobytes() for x, y in zip(starts[:-1], starts[1:])], []
    monkeypatch.setattr(N, "likely", lambda ka, *rest, own=N.likely: tried.append(len(ka)) or own(ka, *rest))

    def chunk(*pairs):
        return [np.array([p[k] for p in pairs], object if k > 5 else None) for k in range(8)]

    ab, ba, ac = (1, 2, 96, 96, a, b, sets[0], sets[1]), (2, 1, 96, 96, b, a, sets[1], sets[0]), (1, 3, 96, 96, a, c, sets[0], None)
    got = N.settle([chunk(ab), chunk(ab, ac), chunk(ba)] * 20, 75)
    assert list(zip(*got.to_pydict().values())) == [(2, 1, True)] and tried == [2]
    assert N.settle([], 75).num_rows == 0


def test_each_text_of_an_id_links(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(4, a + " more"), (4, b), (2, a), (3, b + " x"), (9, "other words here entirely now"), (9, ""), (12, c), (12, a), (11, c + " y"), (10, "q r s t u v")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(4, 57, 2), (4, 56, 2), (2, 56, 2), (3, 57, 2), (9, 1, 9), (9, 0, 9), (12, 56, 2), (11, 57, 2), (10, 2, 10)}


def test_names_of_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 1, 2)], "doc_id long, text string, gone_doc int, `a-b` int")
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", 1, 2)]


def test_stated_miss_rate_is_the_simulated_one():
    """Bands share registers, so misses of bands are not independent."""
    told, of = re.search(r"simulated: (\d+) of ([\d,]+)", N.__doc__).groups()
    rng, missed = np.random.default_rng(5), 0
    for _ in range(30):
        equal, left = rng.random((10_000, N.REGISTERS), dtype=np.float32) < 0.75, np.arange(10_000)
        for band in N._bands:
            left = left[~equal[np.ix_(left, band)].all(1)]
        missed += len(left)
    assert abs(missed - 300_000 * int(told) / int(of.replace(",", ""))) < 5 * missed**0.5
