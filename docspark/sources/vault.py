"""Writing a vault: Markdown files, reports, changed texts only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.path import escapes


def yaml_scalar(value: str) -> str:
    plain = value and value == value.strip() and not any(c in value for c in ":#{}[],&*!|>'\"%@`\n") and value.lower() not in ("null", "true", "false", "yes", "no", "~") and not value[0] in "-?0123456789."
    return value if plain else "'" + value.replace("'", "''").replace("\n", " ") + "'"


def frontmatter(fields: list[tuple[str, F.Column]], lists: list[tuple[str, F.Column]]) -> F.Column:
    """A YAML block of fields in order; null and empty fields are left out, lists come last with one item a line."""
    quote = lambda c: F.when(c.rlike(r"""[:#{}\[\],&*!|>'"%@`\n]|^[\s?\-0-9.]|\s$|^(?i:null|true|false|yes|no|~)$"""), F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(c)
    told = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}: "), quote(c))) for k, c in fields]
    told += [F.when(F.size(c) > 0, F.concat(F.lit(f"{k}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), quote(x))), "\n"))) for k, c in lists]
    return F.concat_ws("\n", F.lit("---"), *told, F.lit("---"))


def changed(old: DataFrame, new: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows of new whose text differs from that of old."""
    return new.join(old.select(key, F.col(text).alias("_old")), key).where(~F.col(text).eqNullSafe(F.col("_old"))).drop("_old")


def write_files(rows: DataFrame, root: str, path: str = "path", content: str = "text") -> DataFrame:
    """Writes each row to root/path, by a temporary file and a rename; returns path, bytes. Paths that leave root are refused."""

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        own = f".{TaskContext.get().taskAttemptId()}.tmp"
        for batch in batches:
            sizes = []
            for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = f"{base}/{p}"
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at + own) as f:
                    f.write(c)
                fs.move(at + own, at)
                sizes.append(len(c))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return rows.where(~escapes(F.col(path))).select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "path string, bytes long")


def file_counts(rows: DataFrame, before: str, after: str) -> DataFrame:
    """One row: files, and how many of them a pass changed."""
    return rows.agg(F.count("*").alias("files"), F.count_if(~F.col(before).eqNullSafe(F.col(after))).alias("fixed"))
