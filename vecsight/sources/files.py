"""File sources and sinks.

Scratch and stage outputs live under the shared folder that the session names
in ``spark.checkpoint.dir`` (never a machine-local temp folder on a cluster).
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsight.functions.text import base_name, parent_name
from vecsight.session import ensure_checkpoint_dir


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder below the session's shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([root, "vecsight", *parts])


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh, unique folder below the shared folder, grouped by application id so a
    finished run's scratch data can be removed as a whole."""
    return shared_dir(spark, "scratch", spark.sparkContext.applicationId, f"{tag}-{uuid.uuid4().hex[:12]}")


def input_state(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and modification times of all files below the paths: part of a stage's key, so
    that a stage made from other files is not taken for this one."""
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = p.getFileSystem(conf)
        todo = [p]
        while todo:
            for s in store.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                else:
                    found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


def stage_dir(spark: SparkSession, *key: str) -> str:
    """A stable folder for a pipeline stage keyed by its inputs (for ``materialize``)."""
    h = hashlib.sha1("|".join(key).encode()).hexdigest()[:16]
    return shared_dir(spark, "stages", h)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = True) -> DataFrame:
    """A1/A2: CSV (plain or .gz, by extension) with a header and an explicit schema (no inference
    pass).  ``multiLine`` because stored vector text may hold line breaks."""
    return (spark.read.schema(schema).option("header", "true").option("multiLine", str(multiline).lower())
            .option("mode", "PERMISSIVE").csv(path))


def write_csv(df: DataFrame, path: str, gzip: bool = False, mode: str = "errorifexists") -> None:
    """A4/A5: CSV with a header; put the key column first with ``select`` for A5."""
    w = df.write.mode(mode).option("header", "true")
    if gzip:
        w = w.option("compression", "gzip")
    w.csv(path)


def read_text_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole content."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def list_files(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Recursive listing filtered by extension -> (folder_name, image_name, file_path)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", pattern).load(root).select(F.col("path").alias("file_path")))
    return df.select(parent_name("file_path").alias("folder_name"),
                     base_name("file_path").alias("image_name"), "file_path")


def read_binary(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """File bytes for a decoder or an encoder (path, content)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).load(root).select("path", "content"))


def _complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(conf).exists(p)


def materialize(spark: SparkSession, path: str, build, fmt: str = "parquet") -> DataFrame:
    """Read the stage output if a complete one exists, else compute, write, and read it.

    Writing and reading back also cuts the lineage, so a lost executor only
    recomputes from the written stage.
    """
    if not _complete(spark, path):
        build().write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written below the shared folder and read back: later steps start from files that every
    executor sees, and what made them is computed once."""
    path = scratch_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_ledger(ids: DataFrame, path: str) -> None:
    """Append ids to a ledger table (created on first write)."""
    ids.write.mode("append").parquet(path)
