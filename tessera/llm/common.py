"""Shared column helpers for the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: x20 and x09 to x0D.
WS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text that isn't null, in order.  A one-character separator spares the regex engine."""
    for c in WS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def content_key(text: Column) -> list[Column]:
    """128 bits that stand for a text; equal texts share them."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array of ints, in blocks so that long arrays stay near linear."""

    def run(a: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("o"))
        return F.aggregate(
            a,
            zero,
            lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["o"], F.array(acc["s"] + x)).alias("o")),
            lambda acc: acc["o"],
        )

    def blocks(a: Column) -> Column:
        n = F.size(a)
        inner = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / 256).cast("int")), lambda b: run(F.slice(a, b * 256 + 1, 256))
        )
        return let(
            inner,
            lambda parts: let(
                run(F.transform(parts, lambda p: F.element_at(p, -1))),
                lambda ends: F.flatten(
                    F.transform(
                        parts,
                        lambda p, b: F.transform(p, lambda x: x + F.when(b == 0, F.lit(0)).otherwise(F.get(ends, b - 1))),
                    )
                ),
            ),
        )

    return let(values, lambda a: F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(blocks(a)))


def dealt(df: DataFrame) -> DataFrame:
    """The table, never broadcast when joined: Spark takes it for as large as the files it is read from, also where an explode or Python makes more of it."""
    return df.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or that of the session.

    Only a local session, whose executors are threads of the driver, gets a folder of its own where none is named.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts lineage and is computed once."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
