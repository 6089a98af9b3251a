"""Token counts of documents in flat token files without an index, by their separators.

A file is a run of fixed-width little-endian ids in which an end-of-document id follows each document. It is cut in blocks that
tasks read on their own; each block's separators are found by one vectorised comparison. A document may run over several blocks:
the last separator before a block and the number of separators before it are prefix scans over the blocks' summaries of a file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm import bytebpe
from docspark.llm.common import Scratch, new_path, small_batches

#: Ids in a block.
BLOCK = 4 << 20


def _name(root: str, shard: int) -> str:
    return f"{root}/tokens-{shard:06d}.bin"


def _write_batches(uri: str, path: str, separator: int):
    def run(batches):
        context = TaskContext.get()
        shard, enc = context.partitionId(), bytebpe.encoder(path, plain_specials=True)
        end = np.array([separator], f"<u{enc.width}").tobytes()
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        own = f"{_name(root, shard)}.{context.taskAttemptId()}.tmp"
        at, size = 0, 0
        with fs.open_output_stream(own, buffer_size=1 << 20) as out:
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    tokens = enc.encode(text)
                    out.write(tokens + end)
                    size += len(tokens) // enc.width + 1
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(at, at + n)), pa.nulls(n, pa.int64())], ["doc_id", "shard", "ordinal", "ids"])
                at += n
        fs.move(own, _name(root, shard))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([shard], pa.int32()), pa.nulls(1, pa.int64()), pa.array([size])], ["doc_id", "shard", "ordinal", "ids"])

    return run


def write_flat(docs: DataFrame, uri: str, tokenizer: str, separator: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Writes one file for each partition of docs. Returns the documents' places (doc_id, shard, ordinal) and the files (shard, ids)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = scratch.keep(rows.mapInArrow(_write_batches(uri, tokenizer, separator), "doc_id long, shard int, ordinal long, ids long"), "places")
    return told.where("ids is null").drop("ids"), told.where("ids is not null").select("shard", "ids")


def _scan_batches(uri: str, separator: int, width: int):
    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for shard, block, first, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "first", "n")), strict=True):
                with fs.open_input_file(_name(root, shard)) as f:
                    ids = np.frombuffer(f.read_at(n * width, first * width), f"<u{width}")
                ends = np.flatnonzero(ids == separator) + (first + 1)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int64()), "ends": pa.array([ends], pa.list_(pa.int64()))})

    return run


def scan(spark: SparkSession, uri: str, files: DataFrame, separator: int, width: int, block: int = BLOCK) -> DataFrame:
    """files(shard, ids) -> shard, ordinal, n_tokens of each document, without its separator. Ids after a file's last separator
    are a last document, if there are any. Empty documents count 0; empty files have no documents."""
    cut = files.select("shard", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(ids - 1) div {block}"), F.lit(0)))).alias("block"))
    cut = cut.select("shard", "block", (F.col("block") * block).alias("first"), F.least(F.lit(block), F.col("ids") - F.col("block") * block).alias("n"))
    found = cut.repartition("shard", "block").mapInArrow(_scan_batches(uri, separator, width), "shard int, block long, ends array<long>")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select("shard", "ends", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("seen"), F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(0)).alias("carry"))
    stitched = stitched.select("shard", "seen", F.posexplode(F.expr("transform(ends, (e, i) -> e - 1 - if(i = 0, carry, ends[i - 1]))")).alias("i", "n_tokens"))
    closed = stitched.select("shard", (F.col("seen") + F.col("i")).alias("ordinal"), "n_tokens")
    last = found.groupBy("shard").agg(F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))), F.lit(0)).alias("end"))
    return closed.union(files.join(last, "shard").where("ids > end").select("shard", "ordinal", (F.col("ids") - F.col("end")).alias("n_tokens")))


def counts(docs: DataFrame, tokenizer: str, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens: one row for each input row, from flat files written in the shared folder.

    The last id of the vocabulary separates documents; its string in a text is ordinary text. Null and empty texts count 0,
    repeated rows each, a null doc_id stays null, other columns are not read. Empty tables give empty results.
    """
    spark = docs.sparkSession
    scratch, uri, enc = Scratch(spark, "tokens"), new_path(spark, "flat"), bytebpe.encoder(tokenizer, plain_specials=True)
    separator = enc.vocabulary - 1
    places, files = write_flat(docs, uri, tokenizer, separator, scratch)
    sized = scratch.keep(scan(spark, uri, files, separator, enc.width, block), "counts")
    return places.join(sized, ["shard", "ordinal"]).select("doc_id", "n_tokens")
