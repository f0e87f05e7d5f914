"""Where intermediate tables and files live: the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Only a local master, as in tests, may do without one; it then gets a fresh folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder name nobody else uses; writers create it."""
    return f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there.

    Lost executors cost a re-read, not a recomputation, and what follows sees the table's
    true size.
    """
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by `keep` that nothing will read again."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/llm-" in folder:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def open_store(folder: str):
    """The pyarrow file system of a folder, for files that tasks write and read; and the path in it."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def write_file(store, path: str, data: bytes) -> None:
    """Write under a passing name, then rename: a task that dies leaves no half file behind."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, path)


def read_file(store, path: str) -> bytes:
    # The bytes as they are: by default a name in .gz would be unpacked.
    with store.open_input_stream(path, compression=None) as source:
        return source.read()
