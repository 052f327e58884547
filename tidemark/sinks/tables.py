"""Table sinks: reload (overwrite), append with a key check, keyed upsert, CSV export.

Tables are parquet folders under a shared root. A keyed store is a folder of numbered
versions. An upsert writes the merged result (old rows whose key is not in the new batch,
plus the new batch) beside them and publishes it as the next version with one rename that
never overwrites: readers see the old version or the new one, a failed or lost job leaves
the newest one as it was, and of two upserts at once one is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import dq_unique
from ..session import file_system


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, p = file_system(spark, path)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n.startswith("v-"))


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a keyed store; None if there is none."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/{versions[-1]}") if versions else None


def _publish(spark: SparkSession, staged: str, target: str) -> None:
    """Rename; fails if the target exists (also where another writer made it just now)."""
    jvm = spark.sparkContext._jvm
    _, src = file_system(spark, staged)
    _, dst = file_system(spark, target)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        dst.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(src, dst, none)


def reload(df: DataFrame, path: str) -> None:
    """Truncate-and-load."""
    df.write.mode("overwrite").parquet(path)


def append_checked(df: DataFrame, path: str, key: list[str]) -> int:
    """Append, then verify the key is still unique (loading twice without a reload is an error).

    Returns the number of duplicated keys (0 = fine)."""
    df.write.mode("append").parquet(path)
    return dq_unique(df.sparkSession.read.parquet(path), key).count()


def upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str],
           stamp_col: str | None = None) -> DataFrame:
    """Insert-or-update ``new`` into the table at ``path`` by ``key``; keys absent from ``new`` are kept.

    ``stamp_col`` (e.g. ``predicted_at``) is set to the current time on the new rows.
    """
    if stamp_col:
        new = new.withColumn(stamp_col, F.current_timestamp())
    root, versions, old = path.rstrip("/"), _versions(spark, path), read_store(spark, path)
    merged = new if old is None else \
        old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    number = int(versions[-1][2:]) + 1 if versions else 1
    staged, target = f"{root}/.staged-{uuid.uuid4().hex[:8]}", f"{root}/v-{number:09d}"
    fs, staged_path = file_system(spark, staged)
    try:
        merged.write.parquet(staged)
        _publish(spark, staged, target)
    finally:
        fs.delete(staged_path, True)
    for name in versions[:-1]:  # the version before this one stays for readers that have begun
        fs.delete(file_system(spark, f"{root}/{name}")[1], True)
    return spark.read.parquet(target)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export with header (one file per partition; no driver-side streaming)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Raw table as CSV in the source layout (timestamps ``yyyy-MM-dd HH:mm:ss``, NULL as empty,
    surrounding spaces kept — Spark trims them on write by default)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("dateFormat", "yyyy-MM-dd").csv(path))


def upsert_rfm(spark: SparkSession, path: str, rfm: DataFrame) -> DataFrame:
    """Keyed RFM store: one row per customer, ``updated_at`` set on the rows written now."""
    return upsert(spark, path, rfm, ["customer_unique_id"], stamp_col="updated_at")


def upsert_predictions(spark: SparkSession, path: str, pred: DataFrame) -> DataFrame:
    """Keyed prediction store (probability at 4 dp, money at 2 dp), ``predicted_at`` set now."""
    from ..functions.core import rnd
    rounded = (pred.withColumn("churn_probability", rnd(F.col("churn_probability"), 4).cast("double"))
               .withColumn("monetary_value", rnd(F.col("monetary_value"), 2).cast("decimal(12,2)"))
               .withColumn("revenue_at_risk", rnd(F.col("revenue_at_risk"), 2).cast("decimal(12,2)")))
    return upsert(spark, path, rounded, ["customer_unique_id"], stamp_col="predicted_at")


def _digests(df: DataFrame, by: str) -> dict[str, tuple]:
    """Row count and content digest of every partition value, whatever the order of rows."""
    columns = sorted(c for c in df.columns if c != by)
    digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    return {r[0]: tuple(r[1:]) for r in df.groupBy(F.col(by).cast("string")).agg(F.count(F.lit(1)), digest).collect()}


def refresh_months(spark: SparkSession, new: DataFrame, path: str, by: str) -> list[str]:
    """Rewrites the partitions (column ``by``) of a written table in which ``new`` differs; returns their values.

    Counts and digests per partition, one row each, tell which; the others' files aren't touched. A changed partition
    is replaced by dynamic partition overwrite, and one that has no rows any more is removed.
    """
    old = spark.read.parquet(path)
    was, now = _digests(old, by), _digests(new, by)
    changed = sorted(m for m in now if was.get(m) != now[m])
    gone = sorted(m for m in was if m not in now)
    if changed:
        (new.where(F.col(by).cast("string").isin(changed)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(by).parquet(path))
    for m in gone:
        fs, p = file_system(spark, f"{path}/{by}={m}")
        fs.delete(p, True)
    return changed + gone
