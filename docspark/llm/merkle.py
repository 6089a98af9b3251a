"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame functions only.

Sections are parted by blank lines, paragraphs by line ends; a paragraph's leaves are runs of up to four words with the white space
around them, so that every character is in a leaf or a border. A leaf's hash has 32 bits, a paragraph's and a section's 64 bits over
the full hashes below, the root is the SHA-256 of all of them. The fingerprint is text:
`<root>;<section>:<paragraph>=<leaf>.<leaf>,<paragraph>=...;<section>:...`. Equal texts have equal roots, and different
texts different ones, unless leaves collide in 64 bits, which crafted texts can; where roots differ, the sections, paragraphs and leaves
that differ locate the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAF = r"\s*+(?:\S++\s*+){1,4}+|\s++"


def _hex(value: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(value), digits, "0"))


def tree(text: Column) -> Column:
    """array of sections of arrays of paragraphs of arrays of full leaf hashes."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda c: F.xxhash64(c))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def leaves_of(nodes: Column) -> Column:
    return F.transform(F.flatten(F.flatten(nodes)), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))


def body(nodes: Column) -> Column:
    """The fingerprint without its root."""
    paragraph = lambda p: F.concat(_hex(F.xxhash64(p), 16), F.lit("="), F.array_join(F.transform(p, lambda h: _hex(h.bitwiseAND(F.lit(0xFFFFFFFF)), 8)), "."))
    section = lambda s: F.concat(_hex(F.xxhash64(s), 16), F.lit(":"), F.array_join(F.transform(s, paragraph), ","))
    return F.array_join(F.transform(nodes, section), ";")


def rooted(told: Column) -> Column:
    return F.concat(F.sha2(told, 256), F.lit(";"), told)


def fingerprint(text: Column) -> Column:
    return rooted(body(tree(F.coalesce(text, F.lit("")))))


def leaf_likeness(a: Column, b: Column) -> Column:
    """Shared share of distinct leaves; 1 where neither has any."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1."""
    leaves = lambda f: F.regexp_extract_all(f, F.lit(r"[=.]([0-9a-f]{8})"), F.lit(1))
    return F.when(a == b, F.lit(1.0)).otherwise(leaf_likeness(leaves(a), leaves(b)))


def differing(a: Column, b: Column) -> Column:
    """array of (section, paragraph), from 0, of the paragraphs in which two fingerprints differ by place. Branches with equal
    hashes are not looked into."""
    sections = lambda f: F.slice(F.split(f, ";"), 2, 1 << 30)
    paragraphs = lambda s: F.split(F.split_part(F.coalesce(s, F.lit("")), F.lit(":"), F.lit(2)), ",")

    def of(pair: Column, i: Column) -> Column:
        x, y = pair["0"], pair["1"]
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(paragraphs(x)), F.size(paragraphs(y))) - 1), lambda j: ~F.get(paragraphs(x), j).eqNullSafe(F.get(paragraphs(y), j)))
        return F.when(x.eqNullSafe(y), F.expr("cast(array() as array<struct<section:int,paragraph:int>>)")).otherwise(F.transform(places, lambda j: F.struct(i.alias("section"), j.alias("paragraph"))))

    return F.flatten(F.transform(F.arrays_zip(sections(a).alias("0"), sections(b).alias("1")), of))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, next_text and the given order's helpers; the first text follows the last.

    Rows go to buckets by ranges of doc_id. A copy of the next bucket's first row closes each bucket, so that each bucket is ordered
    on its own. Null ids come first, ties are ordered by text.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(least)).alias("_k"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = sorted({int(x) for x in docs.where("doc_id is not null").select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)} if n > 1 else set())
    cuts = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.expr("cast(array() as array<bigint>)")
    rows = rows.withColumn("_bucket", F.size(F.filter(cuts, lambda b: b <= F.col("_k"))))
    # One id for each bucket: as many rows as bounds, and one.
    heads = sorted(tuple(r) for r in rows.groupBy("_bucket").agg(F.min("_k")).collect())
    follows = [(heads[(i + 1) % len(heads)][1], heads[i][0]) for i in range(len(heads))]
    small = spark.createDataFrame(follows, "_k long, _before int")
    closing = rows.join(F.broadcast(small), "_k").groupBy("_before").agg(F.min(F.struct("_k", "text")).alias("h"))
    closing = closing.select(F.lit(None).cast("long").alias("doc_id"), F.lit((1 << 63) - 1).alias("_k"), "h.text", F.col("_before").alias("_bucket"), F.lit(True).alias("_closes"))
    every = rows.withColumn("_closes", F.lit(False)).unionByName(closing)
    return every.repartition("_bucket").sortWithinPartitions("_bucket", "_k", "_closes", "text")


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by as many of the next document's first ones, or by all it
    has; the first document follows the last. Null and empty texts have no leaves. Rows that repeat a doc_id are ordered by text,
    null ids come first. A single row is its own next. An empty table gives an empty result; other columns are not read.
    """
    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), buckets)
    rows = rows.withColumn("nodes", tree(F.col("text"))).withColumn("leaves", leaves_of(F.col("nodes")))
    order = "over (partition by _bucket order by _k, _closes, text)"
    rows = rows.select("*", F.expr(f"lead(text) {order}").alias("next_text"), F.expr(f"lead(leaves) {order}").alias("next_leaves")).where("not _closes")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", "nodes", "leaves", "next_leaves", n.cast("long").alias("n_chars"), F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)).alias("edited"))
    rows = rows.withColumn("edited_nodes", tree(F.col("edited")))
    rows = rows.withColumn("edited_leaves", leaves_of(F.col("edited_nodes"))).withColumn("told", body(F.col("nodes"))).withColumn("edited_told", body(F.col("edited_nodes")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), rooted(F.col("told")).alias("fingerprint"), rooted(F.col("edited_told")).alias("edited_fingerprint"),
        leaf_likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"), leaf_likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )
