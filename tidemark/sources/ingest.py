"""The ingest job: load one module's CSV files into raw parquet tables.

``truncate=True`` reloads each table (overwrite). Without it rows are
appended and the primary key of every table is checked afterwards — loading
the same files twice is reported, not silently duplicated. Tables load in
foreign-key order; all files are resolved before anything is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.quality import raw_ingestion_summary
from ..sinks.tables import append_checked, reload
from .csv import SCHEMA_OF, load_raw
from .schemas import PRIMARY_KEYS


def run_ingest(spark: SparkSession, candidate_dirs: list[str], target_root: str, module: str = "all",
               truncate: bool = True) -> DataFrame:
    """Returns the ingestion summary (row count per loaded table); raises on duplicate keys after an append."""
    sources = load_raw(spark, candidate_dirs, module)  # resolves every file first
    loaded: dict[str, DataFrame] = {}
    for table, df in sources.items():
        path = f"{target_root.rstrip('/')}/{table}"
        if truncate:
            reload(df, path)
        else:
            dups = append_checked(df, path, PRIMARY_KEYS.get(table, df.columns))
            if dups:
                raise ValueError(f"{table}: {dups} duplicated keys after append (load without truncate twice?)")
        loaded[table] = spark.read.parquet(path)
    return raw_ingestion_summary(loaded, SCHEMA_OF)
