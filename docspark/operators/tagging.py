"""Term statistics of documents for tags, folded within each document's row: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.tags import terms
from docspark.functions.text import tag


def counted(words: Column) -> Column:
    """array<struct<term, n, first>> of an array of terms: how often each occurs and where it first does. Runs of the sorted terms are
    counted by their borders."""
    ordered = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def runs(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)))
        starts = F.filter(places, lambda i: F.get(s, i)["w"].isNotNull() & ~F.get(s, i)["w"].eqNullSafe(F.get(s, i - 1)["w"]))
        closed = lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i)["w"].alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("n"), F.get(s, i)["i"].alias("first")))
        return F.flatten(F.transform(F.array(starts), closed))

    return F.flatten(F.transform(F.array(ordered), runs))


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, n, first: how often each term of a document occurs and where it first does."""
    return docs.select(key, F.explode(counted(terms(F.col(text)))).alias("t")).select(key, "t.*")


def top_terms(counts: Column, tags: Column, most: int = 5, least: int = 3, kept: int = 2) -> Column:
    """Of the `most` commonest terms, ties by their first place, those that occur `least` times and whose tag is not among `tags`
    already: the tags of the first `kept`."""

    def of(row: Column) -> Column:
        often = F.filter(row["counts"], lambda t: t["n"] >= least)
        ranked = F.sort_array(F.transform(often, lambda t: F.struct((-t["n"]).alias("n"), t["first"].alias("first"), t["term"].alias("term"))))
        best = F.transform(F.slice(ranked, 1, most), lambda t: F.struct(t["n"].alias("n"), tag(t["term"]).alias("tag")))
        fits = F.filter(best, lambda t: ~F.array_contains(row["tags"], t["tag"]))
        return F.slice(F.transform(fits, lambda t: t["tag"]), 1, kept)

    # As one element of an array, both are made once for a row; else the optimiser puts them inside the functions over elements.
    return F.flatten(F.transform(F.array(F.struct(counts.alias("counts"), tags.alias("tags"))), of))
