import hashlib
import math
import os
import random
import re

import pytest

from pyspark.sql import functions as F

from docspark.llm import decontam, licenses, merkle, url_filter

SF = "/root/testdata/sf0.001"

# ---- decontamination ----


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def runs(w, k=5):
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def plain(docs, items):
    """Every window of an item's size in every text."""
    from collections import Counter

    out = {}
    for d, text in docs:
        for i, told in items:
            w, v = words(text), words(told)
            if not w or not v:
                continue
            k = min(5, len(v))
            item, own = Counter(runs(v, k)), runs(w, k)
            m = sum(item.values())
            best = 0.0
            for s in range(max(1, len(own) - m + 1)):
                window = Counter(own[s : s + m])
                both = sum((window & item).values())
                if 100 * both >= 75 * (sum(window.values()) + m - both):
                    best = max(best, both / (sum(window.values()) + m - both))
            if best:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_decontamination_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 16)
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((3, 5, 9, 30, 41, 55, 30))] + [(7, "a a a a a a a a b"), (8, ""), (9, None)]
    docs = []
    for d in range(60):
        told = words(rng.choice(items[:8])[1])
        edit = d % 4
        if edit == 1 and len(told) > 8:
            told[len(told) // 2] = "changed"
        if edit == 2:
            told = told[: -max(1, len(told) // 10)]
        around = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        at = rng.randint(0, len(around))
        docs.append((d, " ".join(around[:at] + (told if edit < 3 else []) + around[at:]).upper() + "!"))
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_simhash_is_the_majority(spark):
    rng = random.Random(4)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 20, 28)]
    for hashes in rows:
        told = spark.createDataFrame([(hashes,)], "h array<long>").select(decontam.simhash(F.col("h"), len(hashes))).first()[0]
        assert told & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert decontam.BLOCKS * (decontam.REACH + 1) > decontam.RADIUS and decontam.BLOCKS * decontam.WIDTH == 64
    assert len(set(decontam.NEAR)) == sum(math.comb(decontam.WIDTH, n) for n in range(decontam.REACH + 1))


def test_windows_are_the_prints_of_their_shingles(spark):
    """All windows of a text over several pieces, from the planes, against the fingerprint of each window by itself."""
    rng = random.Random(7)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    row = spark.createDataFrame([(60, 0, 0, hashes)], "n int, at int, first int, around array<long>")
    kinds = {1: 0, 3: 1, 6: 2, 8: 3, 16: 4, 24: 5}
    for stride in (1, 2):
        got = {(r.i, r.kind): r.print for r in decontam.windows(row, kinds, stride).collect()}
        assert len(got) == 6 * len(range(0, 60, stride))
        for size, kind in kinds.items():
            for i in range(0, 60 - size + 1, stride):
                assert got[i, kind] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes[i : i + size]) > size)


def test_every_print_within_the_radius_is_found(spark):
    """The index has a print under every value that a print within RADIUS bits may have in one of its blocks."""
    rng = random.Random(9)
    value = rng.getrandbits(63)
    entries = {(b, (value >> 16 * b & 65535) ^ m) for b in range(4) for m in decontam.NEAR}
    for _ in range(3000):
        other = value ^ sum(1 << b for b in rng.sample(range(64), decontam.RADIUS))
        assert any((b, other >> 16 * b & 65535) in entries for b in range(4))


def test_decontamination_of_distant_fingerprints(spark):
    """Six of seven shingles shared, similarity 0.75, and 24 to 27 bits of the whole fingerprints apart: a part of them is equal."""
    import xxhash

    def hashes(w):
        out = []
        for run in runs(w):
            h = 42
            for x in run:
                h = xxhash.xxh64_intdigest(x, seed=h)
            out.append(h)
        return out

    def majority(h):
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    def ties(w):
        h = hashes(w[:10])
        return sum(sum(x >> b & 1 for x in h) == 3 for b in range(64))

    head = max(([f"a{i}x{j}" for j in range(10)] for i in range(3000)), key=ties)
    prints = {f"z{i}": majority(hashes([*head, f"z{i}"])) for i in range(200)}
    a, b = next((a, b) for a in prints for b in prints if 24 <= (prints[a] ^ prints[b]).bit_count() <= 27)
    docs = spark.createDataFrame([(1, " ".join([*head, a]))], "doc_id long, text string")
    items = spark.createDataFrame([(2, " ".join([*head, b]))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.similarity) for r in decontam.matches(docs, items).collect()] == [(1, 2, 0.75)]


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    long = odd_docs.where("doc_id = 10").first().text.split()
    items = spark.createDataFrame([(1, " ".join(long[500:540])), (2, "one two"), (3, None), (None, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(odd_docs, items).collect()}
    assert {(10, 1), (8, 2), (9, 2)} <= got
    kept = decontam.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and not {8, 9, 10} & {r.doc_id for r in kept.collect()}
    assert decontam.matches(no_docs, items).count() == 0 and decontam.matches(odd_docs, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(odd_docs, items.limit(0)).count() == 14


def test_each_row_is_judged_by_its_own_text(spark):
    """Null and repeated ids, and columns with the names that the operator uses itself."""
    leak = " ".join(f"leak{i}" for i in range(30))
    rows = [(None, leak, 1, 2), (None, "clean words only", 1, 2), (7, "x " + leak, 1, 2), (7, "clean words only", 1, 2), (8, None, 1, 2), (8, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_doc long, `my col` int").withColumnRenamed("my col", "gone_text")
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[3], rows[4], rows[5]], key=repr)


def test_recall_at_the_threshold(spark):
    """Passages with one changed word, cut ends or both, all of 0.75 to 0.9: at least 0.9 of them are found, as the plain form does."""
    rng = random.Random(12)
    vocabulary = [f"r{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(14, 60)))) for i in range(150)]
    docs = []
    for d in range(600):
        told = items[d % 150][1].split()
        if d % 3 != 1 and len(told) > 38:
            told[rng.randrange(len(told))] = "changed"
        elif d % 3 == 1:
            cut = rng.randint(0, len(told) // 8)
            told = told[rng.randint(0, cut) : len(told) - cut // 2]
        docs.append((d, " ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 90))] + told + [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))])))
    want = {}
    for d, text in docs:
        want |= plain([(d, text)], [items[d % 150]])
    want = {k: v for k, v in want.items() if v < 0.9}
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    found = [k for k in want if k in got]
    print("recall", len(found), "of", len(want), "best window of these", sum(abs(got[k] - want[k]) < 1e-9 for k in found))
    assert len(want) > 200 and len(found) >= 0.9 * len(want) and all(abs(got[k] - want[k]) < 1e-9 for k in found)


# ---- fingerprints ----


def test_fingerprints(odd_docs, no_docs):
    for buckets in (1, 3, 50):
        rows = merkle.fingerprints(odd_docs, buckets).collect()
        order = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = []
        for k, (i, t) in enumerate(order):
            n, half = len(t), len(t) // 2
            want.append((i, n, hashlib.sha256((t[: n - half] + order[(k + 1) % len(order)][1][:half]).encode()).hexdigest()))
        assert sorted((tuple(r)[:3] for r in rows), key=repr) == sorted(want, key=repr)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0 and by[1].fingerprint != by[3].fingerprint
    assert by[3].near_next < 0.5 < by[2].near_next and 0 < by[10].near_edited < 1 and all(0 <= r.near_edited <= 1 for r in rows)
    assert merkle.fingerprints(no_docs).count() == 0
    alone = merkle.fingerprints(odd_docs.where("doc_id = 4")).first()
    assert alone.near_next == 1.0


def test_fingerprints_against_their_plain_form(spark, odd_docs):
    """Trees, fingerprints and likeness made text by text."""
    import xxhash

    leaf = re.compile(r"\s*(?:[^ \t\n\x0b\f\r]+\s*){1,4}|\s+", re.A)

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def of_array(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(signed(v).to_bytes(8, "little", signed=True), seed=h)
        return h

    def told(text):
        sections, low = [], set()
        for s in text.split("\n\n"):
            nodes = [[xxhash.xxh64_intdigest(x.encode(), seed=42) for x in leaf.findall(p)] for p in s.split("\n")]
            low |= {h & 0xFFFFFFFF for p in nodes for h in p}
            h = 42
            for p in nodes:
                for v in p:
                    h = xxhash.xxh64_intdigest(signed(v).to_bytes(8, "little", signed=True), seed=h)
            sections.append(f"{h:016x}:" + ",".join(f"{of_array(p):016x}=" + ".".join(f"{v & 0xFFFFFFFF:08x}" for v in p) for p in nodes))
        body = ";".join(sections)
        return hashlib.sha256(body.encode()).hexdigest() + ";" + body, low

    def like(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    rows = [(1, "one two three four five\nsix\n\nseven  eight"), (2, "one two three four X\nsix\n\nseven  eight nine ten"), (3, ""), (4, "\n\n \n"), (5, "é 中文 😀 " * 30), (6, "é 中文 😀 " * 31)]
    got = {r.doc_id: r for r in merkle.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (told(t)[0], told(edited)[0])
        assert abs(r.near_edited - like(told(t)[1], told(edited)[1])) < 1e-12 and abs(r.near_next - like(told(t)[1], told(after)[1])) < 1e-12


def test_merkle_differences(spark):
    texts = ["a b c d e\nf\n\ng", "a b c d X\nf\n\ng", "a b c d e\nf\n\ng ", "a b c d e\nf\n\ng\nh", ""]
    f = {t: r[0] for t in texts for r in spark.createDataFrame([(t,)], "t string").select(merkle.fingerprint(F.col("t"))).collect()}
    assert len(set(f.values())) == len(texts)

    def differing(a, b):
        row = spark.createDataFrame([(f[a], f[b])], "a string, b string").select(merkle.differing(F.col("a"), F.col("b")).alias("d"), merkle.likeness(F.col("a"), F.col("b")).alias("l")).first()
        return [tuple(x) for x in row.d], row.l

    assert differing(texts[0], texts[0]) == ([], 1.0)
    assert differing(texts[0], texts[1])[0] == [(0, 0)] and differing(texts[0], texts[3])[0] == [(1, 1)]
    assert 0 < differing(texts[0], texts[1])[1] < 1


# ---- licences ----


def test_licenses(spark, odd_docs, no_docs):
    rows = [(1, "x Released under the MIT License. Under the mit-license"), (2, "Licensed under the Apache License, Version 2.0."), (3, "CC BY-NC 4.0"), (4, "All rights reserved."), (5, "mit"), (6, ""),
            (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this Software and the associated documentation files"), (8, "hereby granted permission free of charge is"), (9, None),
            (10, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 2, 6, "mit")
    assert got[2].labels == "apache-2" and got[2].first_word == 3 and got[3].base_labels == "cc-by-nc" and got[4].labels == "proprietary" and got[4].base_labels == ""
    assert got[5].labels == "" and got[5].score == 0 and got[6].n_words == 0 and got[9].labels == "" and got[7].labels == "mit" and got[7].score >= 0.75 and got[8].labels == "" and got[10].labels == "gpl"
    odd = {(r.doc_id, r.n_words): r for r in licenses.scan(odd_docs).collect()}
    assert len(odd) == 13 and odd[6, 0].labels == "" and odd[10, 24000].score == 0 and odd[None, 60].n_base == 0 and licenses.scan(no_docs).count() == 0


def test_whole_licences(spark):
    """Paragraphs with their own punctuation and line breaks, each alone in a long text."""
    filler = "plain words without any meaning here " * 300
    rows = [(k, filler + t.replace(", ", ",\n") + " " + filler) for k, (_, t, _) in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[k].labels.split(",") and got[k].score > 0.99 for k, (label, _, _) in enumerate(licenses.TEMPLATES))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_base_columns_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    phrases = ", ".join(f"('{p}', '{x}')" for p, x in licenses.BASE.items())
    want = duckdb.sql(rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM '{SF}/documents.parquet'),
        b(phrase, label) AS (VALUES {phrases}),
        p AS (SELECT doc_id, label, unnest(list_filter(range(0, len(words)), lambda i: array_to_string(words[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase)) AS k FROM w, b)
        SELECT w.doc_id, len(words) AS n_words, count(k) AS n_base, min(k) AS first_word, max(k) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN p USING (doc_id) GROUP BY ALL
    """).fetchall()
    got = [tuple(r)[:6] for r in licenses.scan(spark.read.parquet(f"{SF}/documents.parquet")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(r[2] for r in got)


def test_licence_index_misses_no_place():
    """Anchors find what comparing every place of every template finds."""
    rng = random.Random(8)
    idf = {w: rng.uniform(0.01, 9) for w in licenses._VOCABULARY}
    index = licenses.Index(idf)
    for _ in range(300):
        _, told, _, _ = index.templates[rng.randrange(len(index.templates))]
        w = [x if rng.random() > 0.12 else rng.choice(["the", "of", "zzz"]) for x in ["pad"] * rng.randint(0, 5) + told]
        found = {t for t, _, _ in index.matches(w)}
        for t, (_, template, key, weight) in enumerate(index.templates):
            best = max((sum(idf[x] for p, x in enumerate(template) if 0 <= s + p < len(w) and w[s + p] == x) / weight for s in range(-len(template), len(w)) if index._holds(w, max(0, s), s + len(template), key)), default=0)
            assert (t in found) == (best >= licenses.LEAST_SHARE)


# ---- URLs ----


def rule_of(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls(spark):
    urls = ["https://www.example.com/en/x", "http://A.Example.COM/en/?q", "http://example.com/en", "http://x.net/es/1", "http://net/fr/", "http://x.org/", "odd", None, "", "http://", "://com/", "http://com/", "http://xcom/", "http://a.b.c.d.e.f.com/en/" + "y" * 5000, "http://example.com#/en/"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)] + [(None, urls[0], "x"), (0, urls[0], None)], "page_id long, url string, verdict string")
    got = sorted((tuple(r) for r in url_filter.judge(pages).collect()), key=repr)
    assert got == sorted(((k, *rule_of(u)) for k, u in [*enumerate(urls), (None, urls[0]), (0, urls[0])]), key=repr)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    keys = [f"k{i}" for i in range(4000)]
    listed = set(keys[:37])
    made = url_filter.build(listed, spark.createDataFrame([(k,) for k in keys], "key string"), len(keys))
    assert len(made.levels) > 1 and all((k in made) == (k in listed) for k in keys)
    assert "k1" not in url_filter.build(set(), spark.createDataFrame([], "key string"), 0)


def test_urls_of_a_million_hosts(spark):
    url = F.concat(F.lit("https://h"), F.col("id").cast("string"), F.element_at(F.array(*map(F.lit, (".example.com/en/", ".org/a/", ".net/es/x", ".com/b"))), (F.col("id") % 4 + 1).cast("int")))
    rules = F.element_at(F.array(*map(F.lit, ("example.com/en/", None, "net/es/", "com/"))), (F.col("page_id") % 4 + 1).cast("int"))
    got = url_filter.judge(spark.range(1_000_000).select(F.col("id").alias("page_id"), url.alias("url")))
    right = rules.eqNullSafe(F.col("rule")) & (F.col("verdict") == F.when(F.col("page_id") % 2 == 0, "block").otherwise("allow"))
    assert got.agg(F.count("*"), F.sum(right.cast("int"))).first()[:] == (1_000_000, 1_000_000)


def test_cascade_with_too_many_wrong_keys_is_made_finer(spark):
    """A count far too small asks for a rate that lets thousands of keys through."""
    universe = spark.range(2_000_000).select(F.concat(F.lit("k"), "id").alias("key"))
    first = url_filter.Bloom(["k1", "k2"], 2, 0.5, 0)
    assert sum(f"k{i}" in first for i in range(2_000_000)) > 1040
    made = url_filter.build({"k1", "k2"}, universe, 1)
    assert [i for i in range(2_000_000) if f"k{i}" in made] == [1, 2]


def test_bloom_reaches_its_rate():
    for n, p in ((2, 1e-4), (3, 1e-3), (3, 0.01), (500, 0.02)):
        made = url_filter.Bloom([f"in{i}" for i in range(n)], n, p, 0)
        assert all(f"in{i}" in made for i in range(n)) and sum(f"out{i}" in made for i in range(200_000)) < 1.5 * p * 200_000 + 10
