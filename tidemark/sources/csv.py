"""CSV source: the raw-file catalogue and a schema-fixed reader.

Files are read with the fixed raw schemas (never inferred), header on, an
empty unquoted field as NULL, UTF-8 with or without BOM. Tables whose text can
hold line breaks (review comments) are cut into records first
(:mod:`.records`); the others are read by Spark's reader. Either way a large file is
read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import path_exists
from .records import read_records
from .schemas import ALL_TABLES, CORE_TABLES, MARKETING_TABLES, RAW_SCHEMAS, SOURCE_FILES

MULTILINE_TABLES = {"order_reviews"}
MODULES = {"core": CORE_TABLES, "marketing": MARKETING_TABLES, "all": ALL_TABLES}
SCHEMA_OF = {t: ("raw_marketing" if t in MARKETING_TABLES else "raw") for t in ALL_TABLES}


#: Options of Spark's CSV reader and of its CSV expression alike.
OPTIONS = {"escape": '"', "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "FAILFAST",
           "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "dateFormat": "yyyy-MM-dd"}


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    if table in MULTILINE_TABLES:
        return read_records(spark, path, RAW_SCHEMAS[table], OPTIONS)
    return spark.read.schema(RAW_SCHEMAS[table]).options(header="true", encoding="UTF-8", **OPTIONS).csv(path)


def find_source(spark: SparkSession, filename: str, candidate_dirs: list[str]) -> str | None:
    """The first ``folder/filename`` that exists, on whatever file system the folder names."""
    for d in candidate_dirs:
        p = f"{d.rstrip('/')}/{filename}"
        if path_exists(spark, p):
            return p
    return None


def resolve(candidate_dirs: list[str], module: str = "all", spark: SparkSession | None = None,
            only: list[str] | None = None) -> dict[str, str]:
    """table -> file path for the chosen module (or those of its tables named in ``only``); raises listing every
    missing file before any load."""
    spark = spark or SparkSession.builder.getOrCreate()
    tables = [t for t in MODULES[module] if only is None or t in only]
    found = {t: find_source(spark, SOURCE_FILES[t], candidate_dirs) for t in tables}
    missing = [SOURCE_FILES[t] for t, p in found.items() if p is None]
    if missing:
        raise FileNotFoundError(f"missing source files: {missing}")
    return found


def load_raw(spark: SparkSession, candidate_dirs: list[str], module: str = "all", only: list[str] | None = None) -> dict[str, DataFrame]:
    """Lazy raw DataFrames of one module (or of its tables named in ``only``), in foreign-key order."""
    return {t: read_csv(spark, p, t) for t, p in resolve(candidate_dirs, module, spark, only).items()}
