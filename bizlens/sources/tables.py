"""SC1: table scans. Parquet keeps predicate pushdown and column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read ``{base}/{name}.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


class _LazyTables(dict):
    """Mapping name -> DataFrame that only builds the reader on first use."""

    def __init__(self, spark: SparkSession, base: str, names):
        super().__init__()
        self._spark, self._base, self._names = spark, base, tuple(names)

    def __missing__(self, key):
        if key not in self._names:
            raise KeyError(key)
        df = load_table(self._spark, self._base, key)
        self[key] = df
        return df


def load_tables(spark: SparkSession, base: str, names=TABLES) -> dict[str, DataFrame]:
    return _LazyTables(spark, base, names)
