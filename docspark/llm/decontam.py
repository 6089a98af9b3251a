"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Texts become words, words five-word shingles, shingles 64-bit hashes. A fingerprint has, in each bit, the majority of the hashes' bits,
repeated shingles weighing as often as they occur. An item is cut into parts of up to PART shingles, two at least from HALVED shingles on;
a part's windows are `size` of its shingles from every place that has room, `stride` places at least. Texts have a window of each such size at every
stride-th place, so that wherever a part stands in a text, one window of the text lies exactly over one window of the part. The counts of all
sizes at a place are made in one go, as bit planes to which four shingles at a time are added.

The items' fingerprints are indexed by four blocks of 16 bits. Fingerprints within RADIUS bits differ in at most REACH bits in one
block at least, so each fingerprint is entered under all values that near to its blocks: looking a window's four blocks up finds
every item's window within the radius. Candidates within the radius are compared by exact weighted shingles, sum of smaller over sum of
larger multiplicities, of the item and the text's windows of its size at the place found and AROUND places beside it.

A similarity of 0.75 leaves a seventh of an item's shingles to differ: one changed word within 36 shingles, or a few at its ends. So of two
halves one differs in few shingles or none, and its fingerprint in few bits. The measured recall of documents and items stands in
the README.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, free_names

SHINGLE = 5
#: Bits that fingerprints may differ in; blocks, and the bits that one of them may differ in: BLOCKS * (REACH + 1) > RADIUS.
RADIUS, BLOCKS, REACH = 11, 4, 2
WIDTH = 64 // BLOCKS
#: Most shingles of a part of an item, and the fewest of an item in two parts.
PART, HALVED = 28, 16
#: Places beside a candidate that are compared too.
AROUND = 4
#: Most index entries in one broadcast (548 for each window of an item, some 60 bytes each); more items go through in several passes.
BROADCAST_ENTRIES = 4_000_000
#: As many document ids at most are broadcast; beyond that, joins shuffle.
BROADCAST_IDS = 500_000
#: Shingles that one generated method adds to its windows.
METHOD = 12
#: Shingles of a text that stand in one row while windows are made; a multiple of the strides.
PIECE = 1024

_WORD = r"[\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def shingles(words: Column, k: int = SHINGLE) -> Column:
    """Hashes of the k-word runs in order; fewer words are one run, none give none."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(runs)


def stride_and_size(part: int, alone: bool) -> tuple[int, int]:
    """How far apart a text's windows for a part of that many shingles start, and their size. If the part is the whole item, three
    quarters of it at most, as a text that matches may be shorter than the item."""
    stride = 1 if part < 8 else 2
    size = min(part - stride + 1, max(1, 3 * part // 4)) if alone else part - stride + 1
    return stride, size if size < 6 else size // 2 * 2 if size < 12 else size // 4 * 4


# ---- fingerprints ----


def added(planes: list[Column], new: list[Column]) -> list[Column]:
    """Bit planes of counts after one, two or four more bit strings."""
    if len(new) == 1:
        low, carries = planes[0].bitwiseXOR(new[0]), [planes[0].bitwiseAND(new[0])]
    else:
        s, c = full(planes[0], new[0], new[1])
        if len(new) == 2:
            low, carries = s, [c]
        else:
            low, second = full(s, new[2], new[3])
            carries = [c, second]
    out, rest = [low], planes[1:]
    if len(carries) == 2:
        s, carry = full(rest[0], *carries)
        out, rest = [*out, s], rest[1:]
    else:
        carry = carries[0]
    for p in rest:
        out.append(p.bitwiseXOR(carry))
        carry = p.bitwiseAND(carry)
    return out


def full(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Sum and carry of three bit strings."""
    return a.bitwiseXOR(b).bitwiseXOR(c), a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseXOR(b)))


def majority(planes: list[Column], count: int) -> Column:
    """Bits whose count is more than half of `count`, for all 64 counts at once from the highest plane down."""
    above, same = None, None
    for k in reversed(range(len(planes))):
        p = planes[k]
        if count // 2 >> k & 1:
            same = p if same is None else same.bitwiseAND(p)
        else:
            more = p if same is None else same.bitwiseAND(p)
            above = more if above is None else above.bitwiseOR(more)
            same = F.bitwise_not(p) if same is None else same.bitwiseAND(F.bitwise_not(p))
    return above


_PLANES = PART.bit_length()


def simhash(hashes: Column, size: int) -> Column:
    """Of an array of `size` hashes: each bit says whether more than half of them have it."""
    planes = lambda s: [s[f"p{k}"] for k in range(_PLANES)]
    zero = F.struct(*(F.lit(0).cast("long").alias(f"p{k}") for k in range(_PLANES)))
    return F.aggregate(hashes, zero, lambda s, h: F.struct(*(p.alias(f"p{k}") for k, p in enumerate(added(planes(s), [h])))), lambda s: majority(planes(s), size))


def block(print_: Column, b: int) -> Column:
    return F.shiftrightunsigned(print_, WIDTH * b).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def key(kind: Column, b: int, value: Column) -> Column:
    """Kind of window, block and value as one number."""
    return kind.cast("long") * (BLOCKS << WIDTH) + (b << WIDTH) + value


#: All ways for a block to differ in at most REACH bits.
NEAR = [sum(1 << i for i in c) for n in range(REACH + 1) for c in combinations(range(WIDTH), n)]


def windows(pieces: DataFrame, kinds: dict[int, int], stride: int) -> DataFrame:
    """pieces(..., n, at, first, around) -> the same with `i` (place less at), `kind` and `print`: all windows of the sizes kinds[size]
    that begin in the piece. Those that the text's end cuts short have prints of no meaning; what they find is compared like the rest.

    The JVM compiles no method of more than 8,000 bytes, and Spark puts all steps between two generators in one. So a generator of one
    row comes after each METHOD shingles.
    """
    places = F.sequence(F.lit(0), F.least(F.lit(PIECE), F.greatest(F.col("n") - F.col("at"), F.lit(1))) - 1, F.lit(stride))
    rows = pieces.select("*", F.explode_outer(places).alias("i"))
    kept = rows.columns
    rows = rows.withColumn("_begin", F.col("at") - F.col("first") + F.col("i"))
    planes = [F.lit(0).cast("long")] * _PLANES
    size, cut, prints = 0, 0, []
    for wanted in sorted(kinds):
        while size < wanted:
            step = 4 if wanted - size >= 4 else 2 if wanted - size >= 2 else 1
            new = [F.coalesce(F.get("around", F.col("_begin") + (size + k)), F.lit(0).cast("long")) for k in range(step)]
            # Each step's shingles and planes are columns, for they are used several times.
            rows = rows.select(*kept, "_begin", *prints, *(x.alias(f"_e{k}") for k, x in enumerate(new)), *(p.alias(f"_p{k}") for k, p in enumerate(planes)))
            prints = [p if isinstance(p, str) else f"_f{size}" for p in prints]
            most = (size + step).bit_length()
            planes = added([F.col(f"_p{k}") for k in range(most)], [F.col(f"_e{k}") for k in range(step)]) + [F.lit(0).cast("long")] * (_PLANES - most)
            rows = rows.select(*kept, "_begin", *prints, *(p.alias(f"_p{k}") for k, p in enumerate(planes)))
            planes, size = [F.col(f"_p{k}") for k in range(_PLANES)], size + step
            if size - cut >= METHOD:
                cut = size
                rows = rows.select(*kept, "_begin", *prints, *planes[1:], F.explode(F.array(planes[0])).alias("_p0"))
        prints.append(majority(planes, size).alias(f"_f{size}"))
    rows = rows.select(*kept, *prints).select(*kept, F.posexplode(F.array(*(f"_f{s}" for s in sorted(kinds)))).alias("turn", "print"))
    kind = F.element_at(F.array(*(F.lit(kinds[s]) for s in sorted(kinds))), F.col("turn") + 1)
    return rows.select(*kept, kind.alias("kind"), "print")


# ---- matches ----


def shared(a: Column, b: Column) -> Column:
    """Sum of the smaller multiplicities of two arrays of hashes."""
    both = F.array_intersect(a, b)
    count = lambda array, h: F.size(F.filter(array, lambda x: x == h))
    single = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(single, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda s, h: s + F.least(count(a, h), count(b, h))))


def parts_of(items: DataFrame) -> DataFrame:
    """items(item_id, k, hashes, m) -> item_id, k, hashes, m, stride, size, back, print, pid: the windows of the items' parts; back is
    how far into the item a window begins."""
    count = F.greatest(F.ceil(F.col("m") / PART).cast("int"), F.when(F.col("m") < HALVED, 1).otherwise(2))
    length = F.floor(F.col("m") / count).cast("int")
    rows = items.select("*", length.alias("part"), (count == 1).alias("alone"), F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda p: p * length)).alias("from"))
    shapes = [stride_and_size(n, alone) for alone in (True, False) for n in range(1, PART + 1)]
    pick = lambda at: F.element_at(F.array(*(F.lit(s[at]) for s in shapes)), F.when(F.col("alone"), F.col("part")).otherwise(F.col("part") + PART))
    rows = rows.withColumns({"stride": pick(0), "size": pick(1)})
    rows = rows.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.col("part") - F.col("size")), lambda o: F.col("from") + o)).alias("back"))
    own = F.slice("hashes", F.col("back") + 1, F.col("size"))
    rows = rows.withColumn("print", F.coalesce(*(F.when(F.col("size") == n, simhash(own, n)) for n in sorted({n for _, n in shapes}))))
    return rows.select("item_id", "k", "hashes", "m", "stride", "size", "back", "print", F.xxhash64("item_id", "hashes", "back").alias("pid"))


def matches(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """docs(doc_id, text, ...), items(item_id, text, ...) -> doc_id, item_id, start, shared, similarity: a row for each document and
    item with a window of similarity percent / 100 or more, with the best window (the first of equals; words count from 0).

    Words are letters and digits, lower-cased. Items of fewer than five words are one shingle and meet the same words in order; items
    without words, and null or empty texts, match nothing. Shorter texts are one window, very long ones are read whole, in pieces. Rows
    that repeat a doc_id or item_id count as one document or item with several texts. Null doc_ids come as one null doc_id. Other
    columns are not read, whatever their names. Without items or documents the result is empty.
    """
    rows = found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["doc_id"], items, percent)
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "shared", -F.col("start"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.col3")).alias("start"), "b.shared", "b.similarity")


def found(docs: DataFrame, own: list[str], items: DataFrame, percent: int) -> DataFrame:
    """docs(*own, text) -> *own, item_id, start, shared, similarity of windows that match; the best of a match among them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text").cast("string")).alias("w")).where("size(w) > 0")
    items = items.withColumn("k", F.least(F.lit(SHINGLE), F.size("w")))
    sized = reduce(DataFrame.unionByName, (items.where(F.col("k") == k).select("item_id", "k", shingles(F.col("w"), k).alias("hashes")) for k in range(1, SHINGLE + 1)))
    parts = scratch.keep(parts_of(sized.withColumn("m", F.size("hashes"))), "parts")
    # As many rows as there are sorts of windows, some thirty at most for each k.
    sorts = sorted(tuple(r) for r in parts.groupBy("k", "stride", "size").agg(F.count("*"), F.max("m")).collect())
    longest = max((r[4] for r in sorts), default=0)
    passes = -(-sum(r[3] for r in sorts) * BLOCKS * len(NEAR) // BROADCAST_ENTRIES)
    texts = docs.select(*own, words_of(F.col("text")).alias("w"))
    results = []
    for k, stride in sorted({r[:2] for r in sorts}):
        kinds = {size: n for n, (a, b, size, _, _) in enumerate(sorts) if (a, b) == (k, stride)}
        runs = texts.select(*own, shingles(F.col("w"), k).alias("all"))
        for turn in range(passes):
            part = parts.where((F.col("k") == k) & (F.col("stride") == stride) & (F.pmod(F.xxhash64("pid"), F.lit(passes)) == turn))
            results.append(_found(runs, own, part, kinds, stride, longest, percent))
    kinds_of = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in own)
    empty = spark.createDataFrame([], f"{kinds_of}, item_id long, start int, shared int, similarity double")
    return reduce(DataFrame.unionByName, results, empty)


def _found(runs: DataFrame, own: list[str], parts: DataFrame, kinds: dict[int, int], stride: int, longest: int, percent: int) -> DataFrame:
    """parts: those of one k and stride whose index entries are bounded by BROADCAST_ENTRIES; longest: most shingles in an item."""
    kind = F.element_at(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*map(F.lit, kinds.values()))), F.col("size"))
    masks = F.array(*(F.lit(m).cast("long") for m in NEAR))
    near = [F.transform(masks, lambda m: m.bitwiseXOR(value)) for value in (key(kind, b, block(F.col("print"), b)) for b in range(BLOCKS))]
    index = parts.select("pid", F.col("print").alias("part_print"), F.explode(F.concat(*near)).alias("key"))
    facts = parts.select("pid", "item_id", "back", "m", F.col("hashes").alias("item"))

    # Hashes come in pieces of bounded length with as much around them as a window needs, so that a long text costs no more for each
    # word than a short one. The outer forms keep the optimiser from testing sizes below, where it would make the arrays anew for
    # each element; so does the coalesce further down.
    margin = longest + AROUND
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(PIECE)),
        lambda at: F.struct(at.alias("at"), F.slice("all", F.greatest(at - margin, F.lit(0)) + 1, PIECE + 2 * margin).alias("around")),
    )
    cut = runs.select(*own, F.size("all").alias("n"), F.explode_outer(pieces).alias("piece"))
    cut = cut.select(*own, "n", F.col("piece.at").alias("at"), F.greatest(F.col("piece.at") - margin, F.lit(0)).alias("first"), F.col("piece.around").alias("around"))

    looked = windows(cut, kinds, stride)
    looked = looked.select("*", F.posexplode(F.array(*(key(F.col("kind"), b, block(F.col("print"), b)) for b in range(BLOCKS)))).alias("b", "key"))
    hits = looked.join(F.broadcast(index), "key")
    differs = F.col("print").bitwiseXOR(F.col("part_print"))
    # Of all blocks that are near enough, the first one stands for the pair.
    earlier = reduce(lambda x, y: x | y, ((F.col("b") > b) & (F.bit_count(block(differs, b)) <= REACH) for b in range(BLOCKS - 1)))
    hits = hits.where((F.bit_count(differs) <= RADIUS) & ~earlier).join(F.broadcast(facts), "pid")
    last = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    place = F.col("at") + F.col("i") - F.col("back")
    beside = F.array_distinct(F.transform(F.sequence(F.lit(-AROUND), F.lit(AROUND)), lambda d: F.least(F.greatest(place + d, F.lit(0)), last)))
    tried = hits.select(*own, "item_id", "first", "around", "item", "m", F.explode(beside).alias("start"))
    tried = tried.withColumn("window", F.slice("around", F.col("start") - F.col("first") + 1, F.col("m")))
    tried = tried.withColumn("shared", F.coalesce(shared(F.col("window"), F.col("item")), F.lit(0)))
    union = F.size("window") + F.size("item") - F.col("shared")
    return tried.where(100 * F.col("shared") >= percent * union).select(*own, "item_id", "start", "shared", (F.col("shared") / union).alias("similarity"))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs whose own text matches no item, with all their columns.

    Each row goes or stays by its own text, also where a doc_id is null or repeated. Null and empty texts stay, very long ones are read
    whole, extra columns may have any names. Without items all rows stay; without documents the result is empty.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.col("text").cast("string").alias("text"))
    doc, text = free_names(docs.columns, "gone_doc", "gone_text")
    gone = found(rows, ["doc_id", "digest"], items, percent).select(F.col("doc_id").alias(doc), F.col("digest").alias(text)).distinct()
    gone = scratch.keep(gone, "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (digest == F.col(text)), "left_anti")
