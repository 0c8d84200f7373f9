"""Register of the engine's queries: a name, a function of (spark, folder of tables), and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    from importlib import import_module

    for module in MODULES:
        import_module(module)


#: Modules that register queries.
MODULES = ["tessera.plans.text_queries", "tessera.plans.retrieval_queries", "tessera.plans.record_queries", "tessera.plans.stream_queries", "tessera.plans.lexical_queries", "tessera.plans.policy_queries", "tessera.plans.json_queries", "tessera.plans.search_queries", "tessera.plans.display_queries", "tessera.plans.case_queries"]


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their neighbours' context that hold the opening words of a benchmark item, eight per item."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tessera.functions import text as t
    from tessera.operators.retrieval import context
    from tessera.plans.text_queries import document_chunks

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(5).collect()
    chunks = context(document_chunks(spark, sf_dir))
    low = t.matchable(F.col("text"))
    scores = [
        F.struct(F.lit(x["item_id"]).alias("query_id"), sum((F.contains(low, F.lit(w)).cast("int") for w in x["text"].lower().split()[:6]), F.lit(0)).alias("score"))
        for x in items
    ]
    d = chunks.select("file_id", "chunk_index", "context", F.explode(F.array(*scores)).alias("s")).select("s.*", "file_id", "chunk_index", F.length("context").alias("context_chars"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "file_id", "chunk_index")
    return d.withColumn("rank", F.row_number().over(best)).where("rank <= 8 AND score > 0")
