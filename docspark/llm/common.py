"""What the training-data operators share: tables, the shared scratch folder, words and shingle hashes."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.lineage import shared_folder

#: Most rows in an Arrow batch. Documents may be very long, so that Spark's 10,000 could need gigabytes.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone already when the driver ends
        return


class Scratch:
    """Tables written in the shared folder: they cut the lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = new_path(self.spark, f"{self.tag}-{name}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                drop_path(self.spark, path)


def free_names(taken: list[str], *stems: str) -> list[str]:
    """Names for columns of our own that clash with none of `taken`, in whatever case these are written."""
    low = {c.lower() for c in taken}
    found = []
    for stem in stems:
        while stem.lower() in low:
            stem += "_"
        low.add(stem.lower())
        found.append(stem)
    return found


def dealt_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined with facts(key, weight, ...), one row for each key; weight says how many of the `total` rows have the key, which is not null.

    Keys with more than a quarter of a partition's even share of rows are broadcast, 4 * partitions of them at most, so that no task gets all
    rows of such a key; the others shuffle.
    """
    bound = max(1, total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    heavy, light = facts.where(F.col(weight) > bound), facts.where(F.col(weight) <= bound)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return rows.join(F.broadcast(heavy), key).unionByName(rest).drop(weight)


def crc_mod3(doc_id) -> "F.Column":
    """The remainder that keeps rows out of every training set (1: held out)."""
    return F.crc32(doc_id.cast("string")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents whose crc_mod3 is not 1, chosen by a hash of doc_id.

    A doc_id with several labels counts as 1 if any is 1; one with several texts gives its largest. Null ids and labels are left out.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    rows = rows.where(crc_mod3(F.col("id")) != 1).groupBy("id").agg(F.max("y").alias("y"))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(most)  # at most `most` small rows: a proven bound for the broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")


# ---- words and shingles, many documents at a time ----

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        size = max(1 << 20, n)
        factors = np.full(size, base)
        factors[0] = 1
        _powers[name] = np.multiply.accumulate(factors)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def blocks(texts: list[str | None], most: int = 1 << 20, lower: bool = True):
    """Groups of neighbouring texts of about `most` bytes, lower-cased in ASCII if asked, as (first index, list of bytes)."""
    part, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        raw = raw.lower() if lower else raw
        if part and size + len(raw) > most:
            yield first, part
            part, size, first = [], 0, i
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield first, part


def word_hashes(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of the texts in turn, and where each text's words start (one more at the end)."""
    buffer = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
    space = _SPACE[buffer]
    inner = np.ones(len(buffer) + 1, bool)
    inner[1:] = space
    starts = np.flatnonzero(inner[:-1] & ~space)
    ends = np.flatnonzero(~inner[:-1] & space)
    n = len(buffer)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "up", n), out=sums[1:])
    words = (sums[ends] - sums[starts]) * _power(_BASE_INVERSE, "down", n)[starts]
    words ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    limits = np.cumsum([0, *(len(x) + 1 for x in part)])
    return mix(words), np.searchsorted(starts, limits)


def shingle_hashes(part: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in order, and where each text's start. A shorter text is one shingle, an empty one none."""
    words, first = word_hashes(part)
    counts = np.diff(first)
    factor = np.uint64(0xA0761D6478BD642F)
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled *= factor
        rolled += words[j : j + n]
    mix(rolled)
    out, starts = [], [0]
    for at, c in zip(first, counts, strict=False):
        if c >= k:
            out.append(rolled[at : at + c - k + 1])
        elif c:
            whole = np.full(1, np.uint64(int(c) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            for w in words[at : at + c]:
                whole = whole * factor + w
            out.append(mix(whole))
        starts.append(starts[-1] + (max(1, c - k + 1) if c else 0))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(starts)
