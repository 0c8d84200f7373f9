"""Named collections of chunks: Parquet by collection and file, replaced by partition; and versions of a whole collection behind a manifest.

A manifest is one small file that names a version's folder.  A new version is written beside the old one and appears when the
manifest is renamed into place, which readers see whole or not at all.  A write that was cut leaves a folder that no manifest names; the next
replacement or ``recover`` drops such folders.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip

#: Names that may stand in a path: no separators, no parents.
NAME = re.compile(r"(?!\.{1,2}$)[\w.\- ]+")


def checked(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"not a name: {name!r}")
    return name


def append(chunks: DataFrame, path: str, collection: str) -> None:
    """Chunks (file_id, ...) of files; a file that is there already is replaced; blank chunks are left out."""
    rows = chunks.where(strip(F.col("text")) != "").withColumn("collection", F.lit(checked(collection)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "file_id").parquet(path)


def read(spark: SparkSession, path: str, collection: str, file_id: str | None = None) -> DataFrame:
    d = spark.read.parquet(path).where(F.col("collection") == collection)
    return d if file_id is None else d.where(F.col("file_id").cast("string") == file_id)


def files(spark: SparkSession, path: str, collection: str) -> DataFrame:
    return read(spark, path, collection).select("file_id").distinct()


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(spark: SparkSession, path: str, collection: str, file_ids: list[str]) -> set[str]:
    """Those of some files that the collection has, without a look at its others."""
    base = f"{path}/collection={checked(collection)}"
    target, system = _file_system(spark, base)
    if not system.exists(target):
        return set()
    within = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    places = {i: within(f"{base}/file_id={checked(i)}") for i in file_ids}
    return {i for i, p in places.items() if system.exists(p) and len(system.listStatus(p))}


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _file_system(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str, collection: str, file_id: str | None = None) -> bool:
    """Drops a file's partition, or the collection's; whether there was one.  Names that would lead elsewhere are an error."""
    where = f"{path}/collection={checked(collection)}" + ("" if file_id is None else f"/file_id={checked(file_id)}")
    target, system = _file_system(spark, where)
    return system.delete(target, True)


def current(spark: SparkSession, path: str, collection: str) -> str | None:
    """The folder of the version that readers see; null before the first."""
    base = f"{path}/{checked(collection)}"
    target, system = _file_system(spark, f"{base}/manifest")
    if not system.exists(target):
        return None
    return f"{base}/{spark.read.text(f'{base}/manifest').first()[0]}"


def replace_all(chunks: DataFrame, path: str, collection: str) -> str:
    """A new version of the whole collection; readers see the old one until it is whole.  Returns its folder."""
    spark, base = chunks.sparkSession, f"{path}/{checked(collection)}"
    version = f"version-{uuid.uuid4().hex}"
    chunks.where(strip(F.col("text")) != "").write.parquet(f"{base}/{version}")
    target, system = _file_system(spark, f"{base}/manifest.{version}")
    out = system.create(target, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(target, jvm.org.apache.hadoop.fs.Path(f"{base}/manifest"), overwrite)
    return f"{base}/{version}"


def read_current(spark: SparkSession, path: str, collection: str) -> DataFrame | None:
    folder = current(spark, path, collection)
    return None if folder is None else spark.read.parquet(folder)


def recover(spark: SparkSession, path: str, collection: str) -> list[str]:
    """Drops the folders and manifests of cut writes and old versions; what was dropped.  To be called where nobody writes or reads an old version."""
    base, kept = f"{path}/{checked(collection)}", current(spark, path, collection)
    target, system = _file_system(spark, base)
    dropped = []
    for status in system.listStatus(target) if system.exists(target) else []:
        name = status.getPath().getName()
        if name.lstrip(".").startswith(("version-", "manifest.version-")) and not (kept and kept.endswith(name)):
            system.delete(status.getPath(), True)
            dropped.append(name)
    return sorted(dropped)
