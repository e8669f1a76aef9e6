"""Folders that the driver and all executors share, and atomic small files in them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name below the session's ``spark.checkpoint.dir``; below a temporary one where none is set and the master is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for what is read more than once."""
    folder = shared_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, in order; nothing if it isn't there."""
    files, path = _path(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


def get_text(spark: SparkSession, uri: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(uri, wholetext=True).collect())


def put_new(spark: SparkSession, uri: str, text: str) -> bool:
    """Writes a file that appears whole or not at all; False if there is one of that name already."""
    files, path = _path(spark, uri)
    part = path.getParent().suffix(f"/.{uuid.uuid4().hex}")
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(path):
        files.delete(part, False)
        return False
    try:  # a rename that doesn't overwrite: of two writers one wins
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(part, path, _plain_rename(spark))
    except Exception:
        files.delete(part, False)
        if files.exists(path):
            return False
        raise
    return True


def _plain_rename(spark: SparkSession):
    """No options: an array of Hadoop's rename options without any."""
    kind = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    return spark._jvm.java.lang.reflect.Array.newInstance(kind, 0)


def delete(spark: SparkSession, uri: str) -> None:
    files, path = _path(spark, uri)
    files.delete(path, True)
