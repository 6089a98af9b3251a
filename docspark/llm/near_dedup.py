"""Near-duplicate groups by SetSketch: banded registers, a joint likelihood estimate, then exact sets.

A sketch has 224 registers. Register i holds the exponentially spaced, truncated minimum of the i-th exponential hash over a
document's shingles: K = floor(1 - log_b(min)), held to 0..q+1. Sketches of parts merge by the registers' maximum. Documents that
agree on all eight registers of a band share a bucket; there are 112 bands, each register being in four, so that a pair at
similarity 0.75 misses all bands about 2.2 times in 10,000 (simulated: 258 of 1,200,000) while pairs below 0.5 rarely meet. In each bucket a hub, the member with most company over all buckets, is
tried against all other members, so that a group of n copies costs about n trials. Buckets that then still hold members of several
groups are swept: their members meet in blocks of BLOCK sketches, compared as matrices within a task; what is likely and not yet of
one group is compared by sets, there and then if these are small. No pair of a bucket is dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, blocks, dealt_join, free_names, mix, shingle_hashes, small_batches
from docspark.llm.components import components

REGISTERS, ROWS, BANDS = 224, 8, 112
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: A pair goes before its sets are compared only if its likelihood at the threshold is e^12 times less than at its best value.
DOUBT = 12.0
#: Members of a block in the sweep, and the largest sets that travel with them.
BLOCK, SMALL = 512, 512
#: Pairs of the sweep that are held at once.
CHUNK = 4096
#: Registers that pairs at the threshold share at least, but for once in ten million times.
LEAST_EQUAL = 130
#: As many document ids at most are broadcast (8 bytes each and their table); beyond that, joins shuffle.
BROADCAST_IDS = 500_000

_odd = np.random.default_rng(20240601).integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: The registers of each band: four shuffles of all registers, cut in eights.
_bands = np.concatenate([np.random.default_rng(k).permutation(REGISTERS).reshape(-1, ROWS) for k in range(BANDS * ROWS // REGISTERS)])


def registers_of(least: np.ndarray) -> np.ndarray:
    """Least uniform values (as 64-bit integers) -> registers."""
    minimum = -np.log1p(-(least.astype(np.float64) + 0.5) * 2.0**-64) / RATE
    return np.clip(np.floor(1 - np.log(minimum) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def sketches(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of registers for each document; documents without shingles have zeros."""
    n = len(starts) - 1
    full = np.flatnonzero(np.diff(starts))
    out = np.zeros((n, REGISTERS), np.uint16)
    if len(full):
        spread, at = np.empty_like(hashes), starts[:-1][full]
        least = np.empty((len(full), REGISTERS), np.uint64)
        for i in range(REGISTERS):
            np.multiply(hashes, _odd[i], out=spread)
            least[:, i] = np.minimum.reduceat(spread, at)
        out[full] = registers_of(least)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Sketches -> a 64-bit key for each band."""
    packed = np.ascontiguousarray(sketch[:, _bands]).view(np.uint64)  # two words of four registers of 16 bits
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(mix(packed[..., 0] ^ salt) + packed[..., 1]).view(np.int64)


def log_likelihood(j: np.ndarray, u: np.ndarray, larger: np.ndarray, less: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Of similarity j, given the share u of the first set's size in both sizes and how many registers are larger, less and equal."""
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = p(u - v * j), p(v - u * j)
    return larger * np.log(a) + less * np.log(b) + equal * np.log(np.clip(1 - a - b, 1e-12, 1))


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches may have a similarity of percent / 100 or more. Set sizes are exact; they alone may rule a pair out."""
    larger, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    equal = REGISTERS - larger - less
    u = na / (na + nb)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    possible = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    grid = np.linspace(0, 1, 65)[:, None] * most
    best = np.max([log_likelihood(j, u, larger, less, equal) for j in grid], axis=0)
    top = np.array([log_likelihood(most * s + np.minimum(percent / 100, most) * (1 - s), u, larger, less, equal) for s in np.linspace(0, 1, 17)]).max(0)
    return possible & (top >= best - DOUBT)


def key_of(shingles: bytes) -> bytes | None:
    return hashlib.blake2b(shingles, digest_size=16).digest() if shingles else None


def _sketch_batches(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        sizes, keys, rows = [], [], []
        for _, part in blocks(texts):
            hashes, starts = shingle_hashes(part)
            for row, a, b in zip(sketches(hashes, starts), starts[:-1], starts[1:], strict=True):
                own = np.unique(hashes[a:b])
                sizes.append(len(own))
                keys.append(key_of(own.tobytes()))
                rows.append(row.tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "n_shingles", "set_key", "sketch"])


def _band_batches(batches):
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), keys.shape[1]))], ["key", "id"])


def _set_batches(batches):
    for batch in batches:
        sets = []
        for _, part in blocks(batch.column("text").to_pylist()):
            hashes, starts = shingle_hashes(part)
            sets += [np.unique(hashes[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(key_of, sets), pa.binary()), pa.array(sets, pa.binary())], ["id", "set_key", "shingles"])


def _likely_batches(percent: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ka", "kb"))
                good = likely(a, b, *(batch.column(c).to_numpy().astype(float) for c in ("na", "nb")), percent)
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(good))

    return run


def _verified_batches(percent: int):
    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                good.append(is_link(a.as_buffer(), b.as_buffer(), percent))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _pairs_with(pairs: DataFrame, side: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Joins side(id, ...) to both ends of pairs(u, v)."""
    for end, k in (("v", 1), ("u", 0)):
        pairs = pairs.join(side.select(F.col("id").alias(end), *(F.col(c).alias(names[k]) for c, names in columns.items())), end)
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return _pairs_with(pairs, sets, {"shingles": ("sa", "sb")}).select("u", "v", "sa", "sb").mapInArrow(_verified_batches(percent), "u long, v long")


def _swept(pending: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pending(key, id, comp, size) -> pairs (u, v, sure) of different groups that share a bucket: links, and for larger sets likely
    pairs that are still to be verified.

    A bucket of more than BLOCK members is dealt to blocks by a hash of the id. A row goes once to each pair of blocks that holds
    its own; a pair of blocks is a group of some 2 * BLOCK rows, however large the bucket. Sets of up to SMALL shingles travel along.
    """
    blocks_of = F.ceil(F.col("size") / BLOCK).cast("int")
    small = sets.where(F.length("shingles") <= 8 * SMALL)
    rows = pending.join(facts, "id").join(small, ["id", "set_key"], "left")
    rows = rows.select("key", "id", "comp", "n", "sketch", "shingles", blocks_of.alias("blocks"), F.pmod(F.xxhash64("id"), blocks_of).cast("int").alias("own"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("other", F.explode(others)).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")
    return dealt.select(*_SWEPT, "sketch", "shingles").mapInArrow(_sweep_batches(percent), "u long, v long, sure boolean")


_SWEPT = ("key", "lo", "hi", "own", "id", "comp", "n")


def _sweep_batches(percent: int):
    def run(batches):
        held, found, waiting = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in _SWEPT] + [np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS), np.array(batch.column("shingles").to_pylist(), object)]
            held = new if held is None else [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
            cuts = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
            # The last group may go on in the next batch.
            for a, b in zip([0, *cuts[:-1]], cuts, strict=len(cuts) > 0):
                for chunk in close_pairs([x[a:b] for x in held], percent):
                    found.append(chunk)
                    waiting += len(chunk[0])
                    if waiting > CHUNK:
                        yield settle(found, percent)
                        found, waiting = [], 0
            if len(cuts):
                held = [x[cuts[-1] :].copy() for x in held]
        for chunk in close_pairs(held, percent) if held is not None else ():
            yield settle([chunk], percent)
        yield settle(found, percent)

    return run


def close_pairs(group: list[np.ndarray], percent: int):
    """Pairs of a group of rows that may be links by their sizes and numbers of equal registers: (ids, sizes, sketches, shingles) of
    both ends, CHUNK pairs at most at a time."""
    _, lo, hi, own, ids, comps, sizes, sketch, sets = group
    if (comps == comps[0]).all():
        return
    left, right = np.flatnonzero(own == lo[0]), np.flatnonzero(own == hi[0])
    step = max(1, 16 * CHUNK // max(1, len(right)))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        fits = (comps[some][:, None] != comps[right]) & (100 * np.minimum(sizes[some][:, None], sizes[right]) >= percent * np.maximum(sizes[some][:, None], sizes[right]))
        if lo[0] == hi[0]:  # within a block each pair once, between blocks all
            fits &= some[:, None] < right
        i, j = np.nonzero(fits)
        for a in range(0, len(i), CHUNK):
            x, y = some[i[a : a + CHUNK]], right[j[a : a + CHUNK]]
            good = (sketch[x] == sketch[y]).sum(1) >= LEAST_EQUAL
            x, y = x[good], y[good]
            if len(x):
                yield [ids[x], ids[y], sizes[x], sizes[y], sketch[x], sketch[y], sets[x], sets[y]]


def settle(found: list[list[np.ndarray]], percent: int) -> pa.RecordBatch:
    """Links among close pairs whose sets are at hand, and the likely ones of the others. A pair that several buckets found is compared once."""
    us, vs, sure = [], [], []
    if found:
        ia, ib, na, nb, ka, kb, sa, sb = (np.concatenate(x) for x in zip(*found, strict=True))
        u, v = np.maximum(ia, ib), np.minimum(ia, ib)
        order = np.lexsort((v, u))
        again = (np.diff(u[order], prepend=-1) == 0) & (np.diff(v[order], prepend=-1) == 0)
        again[0] = False
        once = order[~again]
        once = once[likely(ka[once], kb[once], na[once].astype(float), nb[once].astype(float), percent)]
        for x, y, a, b in zip(u[once].tolist(), v[once].tolist(), sa[once], sb[once], strict=True):
            if a is None or b is None or is_link(a, b, percent):
                us.append(x)
                vs.append(y)
                sure.append(a is not None and b is not None)
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(sure, pa.bool_())], ["u", "v", "sure"])


def is_link(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.sort(np.concatenate([x, y]))
    both = int((both[1:] == both[:-1]).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _same_document(known: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (u, v) of the representatives of all sets of a document that has several."""
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("doc_id")
    own = known.join(several, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(reps.select("set_key", "id"), "set_key").select("doc_id", "id")
    return own.join(own.groupBy("doc_id").agg(F.min("id").alias("v")), "doc_id").where("id <> v").select(F.col("id").alias("u"), "v")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs(doc_id long, text string, ...) -> doc_id, n_shingles, component_id, kept: one row for each input row.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a set holds the distinct 5-word shingles, or the whole word
    sequence where there are fewer words. Rows link at 100 * intersection >= percent * union. component_id is the smallest doc_id
    that links reach. Null and empty texts have 0 shingles and stand alone. Rows that repeat a doc_id are one document that links by
    each of its texts, and all its rows with shingles share its component. A null doc_id links with nothing and is kept, with a null
    component_id and kept = true. Very long texts are read whole, other columns are not read, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(docs.mapInArrow(_sketch_batches, "doc_id long, n_shingles long, set_key binary, sketch binary"), "rows")
    known = rows.where("doc_id is not null and n_shingles > 0")
    reps = scratch.keep(known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"), F.max(F.struct("n_shingles", "sketch")).alias("s")).select("set_key", "id", "rows", F.col("s.n_shingles").alias("n"), F.col("s.sketch").alias("sketch")), "reps")

    keys = reps.select("id", "sketch").mapInArrow(_band_batches, "key long, id long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = scratch.keep(keys.join(shared, "key", "left_semi"), "members")
    company = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("id").agg(F.sum("n").alias("company"))
    ids = scratch.keep(company, "ids")
    few = ids.count() <= BROADCAST_IDS
    wanted = ids.select(F.col("id").alias("doc_id"))
    chosen = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").mapInArrow(_set_batches, "id long, set_key binary, shingles binary")
    # Rows that repeat a document and its text give one set; texts of other documents with the same set are no representatives.
    sets = chosen.where(F.length("shingles") > 0).groupBy("id", "set_key").agg(F.max("shingles").alias("shingles"))
    sets = scratch.keep(sets.join(reps.select("id", "set_key"), ["id", "set_key"], "left_semi"), "sets")
    facts = reps.select("id", "set_key", "n", "sketch")

    members = members.join(ids, "id")
    hubs = members.groupBy("key").agg(F.max(F.struct("company", -F.col("id"))).alias("h")).select("key", (-F.col("h.col2")).alias("hub"))
    pairs = members.join(hubs, "key").where("id <> hub").select(F.greatest("id", "hub").alias("u"), F.least("id", "hub").alias("v")).distinct()
    maybe = _pairs_with(pairs, facts, {"sketch": ("ka", "kb"), "n": ("na", "nb")}).select("u", "v", "ka", "kb", "na", "nb").mapInArrow(_likely_batches(percent), "u long, v long")
    links = scratch.keep(_verified(maybe, sets, percent).union(_same_document(known, reps)), "links-0")
    comps = components(links, scratch, "comps-0")

    placed = members.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
    pending = scratch.keep(placed.join(split, "key").select("key", "id", "comp", "size"), "pending")
    if not pending.isEmpty():
        maybe = scratch.keep(_swept(pending, facts, sets, percent).distinct(), "maybe-1")
        links = _verified(maybe.where("not sure").select("u", "v").distinct(), sets, percent).union(maybe.where("sure").select("u", "v")).union(comps.where("id <> comp").select(F.col("id").alias("u"), F.col("comp").alias("v")))
        comps = components(scratch.keep(links, "links-1"), scratch, "comps-1")

    # Each set's component first, then the rows to their set: a text that is repeated often has few sets, and rows without any stay apart.
    placed = reps.select("id", "set_key", "rows").join(comps, "id", "left").select("set_key", "rows", F.coalesce("comp", "id").alias("component_id"))
    total = placed.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    linked = "doc_id is not null and n_shingles > 0"
    out = dealt_join(rows.where(linked).drop("sketch"), placed, "set_key", "rows", total).select("doc_id", "n_shingles", "component_id")
    out = out.union(rows.where(f"not ({linked})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs without the rows whose near-duplicate group has a smaller doc_id; all columns stay, whatever their names.

    Rows with a null doc_id stay, and so do null and empty texts, unless another text of the same doc_id goes. Repeated rows that are kept
    stay repeated. Very long texts are read whole. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near")
    (own,) = free_names(docs.columns, "gone_doc")
    gone = scratch.keep(near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias(own)).distinct(), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col(own), "left_anti")
