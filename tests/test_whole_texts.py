"""The queries over whole texts against plain versions, with what matters far behind the texts' beginnings."""

import re

import pytest

import __spark_entry__
from docspark.functions.tags import CATEGORIES

FAR = "plain words, " * 40
TEXTS = [
    FAR + "\n## Late\nbody \t\n\n\n\n- x\n12. y\n# End", FAR + "\n---\nk:\n\n- v\n---\n", "k" * 9000 + "\n# a\n####### b\n#### c\n", "\n\n" + FAR + "É: <late> a/b ..",
    "short.", "", None, FAR + " ".join(f" {w} " for words in CATEGORIES.values() for w in words),
]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(k, t, "en", "src") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")

    def values(name):
        got = dict(map(tuple, __spark_entry__.queries()[name](spark, folder).collect()))
        return [got[k] for k in range(len(TEXTS))]

    return values


def cleaned(t):
    for pattern, new in ((r"\n{3,}", "\n\n"), (r"\n(#{1,6} )", r"\n\n\1"), (r"(#{1,6} [^\n]+)\n(?!\n)", r"\1\n\n"), (r"\n(- )", r"\n\n\1"), (r"\n\d+\. ", "\n\n1. "), (r"(?m)[ \t]+$", "")):
        t = re.sub(pattern, new, t)
    return t.strip()


def name(t):
    t = ".." + re.sub(r"[^\x00-\x7f]", "x", t) + " a/b:c?."
    t = re.sub(r"\s+", " ", re.sub(r"[/\\]", "-", re.sub(r'[<>:"|?*]', "", t))).strip(". ")
    return t if len(t) <= 100 else t[:97] + "..."


def test_whole_texts(run):
    whole = [t or "" for t in TEXTS]
    assert run("q_clean_markdown") == [cleaned(t + "\na  \n\n\n\n- b\n3. c\n7. d\n\n") for t in whole]
    assert run("q_tag_normalize") == [re.sub("[^a-z0-9]+", "-", t.lower()).strip("-") for t in whole]
    assert run("q_clean_name") == [name(t) for t in whole]
    assert run("q_yaml_fix") == ["---\ntags:\n- a\n\n- b\n---\n" + t + "\nk:\n\n- x" for t in whole]
    told = [["src", *[c for c, words in CATEGORIES.items() if any(w in t.lower() for w in words)][:2]] for t in whole]
    assert all(got.split(",")[: len(want)] == want for got, want in zip(run("q_tags_final"), told, strict=True)) and len(told[-1]) == 3
