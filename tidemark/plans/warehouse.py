"""The warehouse: which layers are lazy views and which are written tables.

* raw tables        written once per input ("ingest"), read back from parquet
* staging / intermediate   lazy DataFrames (views) — Catalyst fuses them
* marts, RFM, scores       written tables under the shared folder, read back

Writing the marts cuts the lineage (an executor loss during a report never
recomputes the warehouse) and lets every report start from compact parquet
with pushed-down filters and pruned columns. Tables live under the session's
``spark.checkpoint.dir`` (a shared folder on a cluster), in a folder keyed by
the input location, the input files' sizes/mtimes and the library's source,
so a changed input or changed code never reads a stale table.
"""

from __future__ import annotations

import hashlib
import json
import threading
from concurrent.futures import ThreadPoolExecutor
import uuid
from decimal import Decimal
from functools import cached_property
from pathlib import Path
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session as sess
from ..operators import analytics as A
from ..operators import churn as C
from ..operators import customers as CU
from ..operators import retention as RT
from ..operators import intermediate as I
from ..operators import marts as M
from ..operators import quality as DQ
from ..operators import rfm as RFM
from ..operators import staging as S
from ..sinks.tables import refresh_months
from ..sources import testdata

_CODE_VERSION: str | None = None
_REGISTRY: dict[tuple, "Warehouse"] = {}


def code_version() -> str:
    global _CODE_VERSION
    if _CODE_VERSION is None:
        h = hashlib.sha1()
        root = Path(__file__).resolve().parents[1]
        for p in sorted(root.rglob("*.py")):
            h.update(p.relative_to(root).as_posix().encode())
            h.update(p.read_bytes())
        _CODE_VERSION = h.hexdigest()[:12]
    return _CODE_VERSION


def _input_files(spark: SparkSession, sf_dir: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The input's location, and path, size and time of every file below it, on any file system."""
    fs, root = sess.file_system(spark, sf_dir)
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        st = files.next()
        found.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return root.toString(), found


def _input_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the input's location and of path, size and time of every file below it."""
    root, files = _input_files(spark, sf_dir)
    return hashlib.sha1("\n".join([root, *sorted(f"{path}:{size}:{time}" for path, size, time in files)]).encode()).hexdigest()[:12]


def _input_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the files that belong to the warehouse's input tables."""
    return sum(size for path, size, _ in _input_files(spark, sf_dir)[1] if any(f"/{t}.parquet" in path for t in testdata.INPUT_TABLES))


class Warehouse:
    def __init__(self, spark: SparkSession, raw_source: Callable[[], dict[str, DataFrame]], root: str):
        self.spark = spark
        self._raw_source = raw_source
        self.root = root.rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()
        self._reports: dict[str, DataFrame] = {}

    # ------------------------------------------------------------ plumbing
    @classmethod
    def for_testdata(cls, spark: SparkSession, sf_dir: str, fresh: bool = False) -> "Warehouse":
        """The session's warehouse for an input folder.

        ``fresh=True`` starts a new one in its own folder (benchmarks: nothing
        written by an earlier run is reused).
        """
        sess.apply_runtime_defaults(spark)
        key = (spark.sparkContext.applicationId, sess.file_system(spark, sf_dir)[1].toString())
        wh = _REGISTRY.get(key)
        if wh is None or fresh:
            sess.scale_to_input(spark, _input_bytes(spark, sf_dir))
            root = f"{sess.shared_root(spark)}/tidemark_wh/{_input_fingerprint(spark, sf_dir)}-{code_version()}"
            if fresh:
                root += f"/run-{uuid.uuid4().hex[:12]}"
            wh = cls(spark, lambda: testdata.raw_tables(
                spark, sf_dir, keep=lambda name, build: wh.table(f"source/{name}", build)), root)
            _REGISTRY[key] = wh
        return wh

    def table(self, rel: str, build: Callable[[], DataFrame], keyed: bool = False,
              arrange: Callable[[DataFrame], DataFrame] = lambda df: df, by: list[str] | None = None) -> DataFrame:
        """Write ``build()`` once to ``root/rel`` and return it read back from parquet.

        A per-table lock makes concurrent builds (see :meth:`build`) write each table once. The model's declared
        checks are counted on the way (see :func:`..operators.quality.write_checked` for ``keyed`` and ``arrange``).
        ``by`` names partition columns; they aren't part of the model's rows.
        """
        if rel in self._tables:
            return self._tables[rel]
        with self._guard:
            lock = self._locks.setdefault(rel, threading.Lock())
        with lock:
            if rel not in self._tables:
                path = f"{self.root}/{rel}"
                if not sess.path_exists(self.spark, f"{path}/_SUCCESS"):
                    def write(df: DataFrame) -> None:
                        out = df.write.mode("overwrite")
                        (out.partitionBy(*by) if by else out).parquet(path)

                    counted = DQ.write_checked(build(), self._model_of(rel), write, keyed, arrange)
                    sess.write_text(self.spark, f"{self.root}/checks/{self._model_of(rel)}.json", json.dumps(counted))
                self._tables[rel] = self.spark.read.parquet(path)
        return self._tables[rel]

    @staticmethod
    def _model_of(rel: str) -> str:
        layer, name = rel.split("/", 1)
        return f"raw_{name}" if layer == "raw" else name

    def counted_at_write(self, model: str) -> dict[str, int]:
        """What the declared checks of a written model counted when it was written; nothing for views."""
        if not model.startswith(("stg_", "int_")):
            self.model(model)  # make sure it is written
        path = f"{self.root}/checks/{model}.json"
        return json.loads(sess.read_text(self.spark, path)) if sess.path_exists(self.spark, path) else {}

    # Tables in dependency levels: every table of a level only reads tables of earlier levels.
    BUILD_LEVELS = [
        ["raw_customers", "raw_orders", "raw_order_items", "raw_order_payments", "raw_order_reviews",
         "raw_products", "raw_sellers", "raw_geolocation", "raw_category_translations", "raw_mql",
         "raw_closed_deals"],
        ["fact_orders", "mart_product_metrics", "mart_seller_metrics"],
        ["dim_customers", "mart_customer_metrics", "mart_marketing_funnel"],
        ["rfm_segments"],
        ["churn_predictions_baseline"],
        ["customer_profile"],
        ["playbook_recommendations", "portfolio_sums"],
    ]

    def build(self, parallelism: int = 4) -> None:
        """Write all warehouse tables, level by level, submitting independent writes concurrently.

        Independent Spark jobs from several threads share the executors, so
        many small writes (dimension tables, small marts) no longer run one
        after another on a mostly idle cluster.
        """
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            for level in self.BUILD_LEVELS:
                list(pool.map(self.model, level))

    @cached_property
    def _raw_plans(self) -> dict[str, DataFrame]:
        return self._raw_source()

    def raw(self, name: str) -> DataFrame:
        return self.table(f"raw/{name}", lambda: self._raw_plans[name])

    # ------------------------------------------------------------ staging (lazy)
    @cached_property
    def stg_customers(self) -> DataFrame:
        return S.stg_customers(self.raw("customers"))

    @cached_property
    def stg_orders(self) -> DataFrame:
        return S.stg_orders(self.raw("orders"))

    @cached_property
    def stg_order_items(self) -> DataFrame:
        return S.stg_order_items(self.raw("order_items"), self.stg_orders)

    @cached_property
    def stg_order_payments(self) -> DataFrame:
        return S.stg_order_payments(self.raw("order_payments"))

    @cached_property
    def stg_order_reviews(self) -> DataFrame:
        return S.stg_order_reviews(self.raw("order_reviews"))

    @cached_property
    def stg_products(self) -> DataFrame:
        return S.stg_products(self.raw("products"), self.raw("category_translations"))

    @cached_property
    def stg_sellers(self) -> DataFrame:
        return S.stg_sellers(self.raw("sellers"))

    @cached_property
    def stg_marketing_leads(self) -> DataFrame:
        return S.stg_marketing_leads(self.raw("mql"))

    @cached_property
    def stg_closed_deals(self) -> DataFrame:
        return S.stg_closed_deals(self.raw("closed_deals"))

    # ------------------------------------------------------------ intermediate (lazy)
    @cached_property
    def int_order_items_aggregated(self) -> DataFrame:
        return I.int_order_items_aggregated(self.stg_order_items)

    @cached_property
    def int_order_reviews_aggregated(self) -> DataFrame:
        return I.int_order_reviews_aggregated(self.stg_order_reviews)

    # The customer models are column subsets of one rollup over the written fact table
    # (see intermediate.customer_rollup); the order-level definitions in
    # ``intermediate`` are kept as the reference formulation and tested equal.
    @cached_property
    def customer_rollup(self) -> DataFrame:
        return I.customer_rollup(self.fact_orders)

    @cached_property
    def int_customer_locations(self) -> DataFrame:
        return I.customer_locations_from_fact(self.fact_orders, self.stg_customers)

    @cached_property
    def int_customer_orders(self) -> DataFrame:
        return self.customer_rollup.select(*I.ORDER_COLS)

    @cached_property
    def int_customer_fulfillment(self) -> DataFrame:
        return self.customer_rollup.select(*I.FULFILLMENT_COLS)

    @cached_property
    def int_customer_reviews(self) -> DataFrame:
        return self.customer_rollup.where(F.col("_reviewed_orders") > 0).select(*I.REVIEW_COLS)

    # ------------------------------------------------------------ marts (written)
    @property
    def fact_orders(self) -> DataFrame:
        """The fact table without its partition column: see :attr:`fact_by_month`."""
        return self.fact_by_month.drop(M.MONTH)

    def _fact_plan(self) -> DataFrame:
        return M.fact_orders(self.stg_orders, self.stg_customers, self.int_order_items_aggregated,
                             self.stg_order_payments, self.int_order_reviews_aggregated)

    @property
    def fact_by_month(self) -> DataFrame:
        """The fact table, partitioned by purchase month: a date window opens its months only."""
        return self.table("marts/fact_orders", self._fact_plan, keyed=True, arrange=M.by_month, by=[M.MONTH])

    def refresh_fact(self) -> list[str]:
        """Brings the written fact table up to date with its sources, rewriting the months that differ."""
        self.fact_by_month  # noqa: B018  (written at least once)
        changed = refresh_months(self.spark, M.by_month(self._fact_plan()), f"{self.root}/marts/fact_orders", M.MONTH)
        self._tables["marts/fact_orders"] = self.spark.read.parquet(f"{self.root}/marts/fact_orders")
        return changed

    @property
    def dim_customers(self) -> DataFrame:
        return self.table("marts/dim_customers", lambda: M.dim_customers(
            self.int_customer_orders, self.int_customer_locations), keyed=True)

    @property
    def mart_customer_metrics(self) -> DataFrame:
        return self.table("marts/mart_customer_metrics", lambda: M.mart_customer_metrics_from_rollup(
            self.customer_rollup, self.int_customer_locations, self.stg_orders), keyed=True)

    @property
    def mart_product_metrics(self) -> DataFrame:
        return self.table("marts/mart_product_metrics", lambda: M.mart_product_metrics(
            self.stg_products, self.stg_order_items, self.int_order_reviews_aggregated), keyed=True)

    @property
    def mart_seller_metrics(self) -> DataFrame:
        return self.table("marts/mart_seller_metrics", lambda: M.mart_seller_metrics(
            self.stg_sellers, self.raw("order_items"), self.stg_orders, self.int_order_reviews_aggregated), keyed=True)

    @property
    def mart_marketing_funnel(self) -> DataFrame:
        return self.table("marts/mart_marketing_funnel", lambda: M.mart_marketing_funnel(
            self.stg_marketing_leads, self.stg_closed_deals, self.mart_seller_metrics), keyed=True)

    # ------------------------------------------------------------ ML layer (written)
    @property
    def rfm_segments(self) -> DataFrame:
        return self.table("ml/rfm_segments", lambda: RFM.rfm_scores(self.mart_customer_metrics))

    @cached_property
    def churn_features(self) -> DataFrame:
        """Written once: training, scoring and the split read it without the join below."""
        return self.table("ml/churn_features", lambda: C.churn_features(
            C.churn_dataset(self.mart_customer_metrics, self.rfm_segments)))

    @cached_property
    def churn_model(self) -> "C.ChurnModel":
        path = f"{self.root}/ml/churn_model"
        if not sess.path_exists(self.spark, f"{path}/metadata/_SUCCESS"):
            model = C.train_churn_model(self.churn_features)
            C.save_model(self.spark, model, path)
        return C.load_model(self.spark, path)

    @property
    def has_churn_model(self) -> bool:
        """Whether a model artifact is stored (without training one)."""
        return sess.path_exists(self.spark, f"{self.root}/ml/churn_model/metadata/_SUCCESS")

    @property
    def churn_model_path(self) -> str:
        self.churn_model  # noqa: B018 — make sure it exists
        return f"{self.root}/ml/churn_model"

    @property
    def churn_predictions(self) -> DataFrame:
        """Model scores for every customer (written table)."""
        return self.table("ml/churn_predictions", lambda: C.score_customers(self.churn_model, self.churn_features))

    @property
    def churn_predictions_baseline(self) -> DataFrame:
        """Deterministic baseline scores (verification path; same downstream rules)."""
        return self.table("ml/churn_predictions_baseline", lambda: C.predictions_from_probability(
            self.churn_features, C.baseline_probability(self.churn_features)))

    # ------------------------------------------------------------ lookups / CSV copies
    def model(self, name: str) -> DataFrame:
        """Any warehouse model by name (``raw_<table>`` for raw tables)."""
        return self.raw(name[4:]) if name.startswith("raw_") else getattr(self, name)

    @property
    def csv_dir(self) -> str:
        """The raw tables written once as CSV files in the source layout (``<source file name>/part-*.csv``)."""
        return self.csv_of(None)

    def csv_of(self, tables: list[str] | None) -> str:
        """The folder of the CSV files, with those of the given tables (all, if None) written: what a job doesn't read
        isn't made for it."""
        from ..sinks.tables import write_raw_csv
        from ..sources.schemas import SOURCE_FILES
        d = f"{self.root}/csv"
        for t, fname in SOURCE_FILES.items():
            if (tables is None or t in tables) and not sess.path_exists(self.spark, f"{d}/{fname}/_SUCCESS"):
                write_raw_csv(self.raw(t), f"{d}/{fname}")
        return d

    # ------------------------------------------------------------ customer profile (written)
    @property
    def customer_profile(self) -> DataFrame:
        """mart ⟕ RFM ⟕ baseline scores, joined once and written: the customer reports scan it
        instead of re-shuffling three customer-grain tables per report."""
        return self.table("marts/customer_profile", lambda: CU.customer_view(
            self.mart_customer_metrics, self.rfm_segments, self.churn_predictions_baseline))

    @property
    def customer_profile_model(self) -> DataFrame:
        """The same profile with the churn model's scores."""
        return self.table("marts/customer_profile_model", lambda: CU.customer_view(
            self.mart_customer_metrics, self.rfm_segments, self.churn_predictions))

    @property
    def playbook_recommendations(self) -> DataFrame:
        """Per-customer playbook recommendation (baseline scores), written once for the economics reports."""
        return self.table("marts/playbook_recommendations", lambda: RT.playbook_recommendation(
            self.customer_profile, RT.playbooks(self.spark)))

    # ------------------------------------------------------------ report rows (merged on read)
    def report_parts(self, name: str, build: Callable[[], DataFrame], part: str = "all") -> list[dict[str, str]]:
        """The rows of sums stored for a report, one per part of the data; ``build`` makes this part's if it has none."""
        folder = f"{self.root}/reports/{name}"
        if not sess.path_exists(self.spark, f"{folder}/{part}.json"):
            row = build().first().asDict()
            sess.write_text(self.spark, f"{folder}/{part}.json", json.dumps({k: str(v) for k, v in row.items()}))
        return [json.loads(sess.read_text(self.spark, p)) for p in sess.files_in(self.spark, folder)]

    def report(self, name: str, build: Callable[[], DataFrame], part: str = "all") -> DataFrame:
        """One row of a report's sums, its parts added up: read without a Spark job."""
        known = self._reports.get(name)
        if known is None:
            parts = self.report_parts(name, build, part)
            total = {k: str(sum(Decimal(p[k]) for p in parts)) for k in parts[0]}
            known = self._reports[name] = self.spark.sql("SELECT * FROM VALUES ({}) AS t({})".format(
                ", ".join(f"cast('{v}' as decimal(38,6))" for v in total.values()), ", ".join(total)))
        return known

    @property
    def portfolio_sums(self) -> DataFrame:
        return self.report("portfolio", lambda: A.portfolio_sums(self.mart_customer_metrics, self.churn_predictions_baseline))

    # ------------------------------------------------------------ serving
    SERVING_TABLES = ["customer_profile", "mart_product_metrics", "mart_seller_metrics", "mart_marketing_funnel",
                      "rfm_segments", "churn_predictions_baseline", "mart_customer_metrics"]

    def serve(self, tables: list[str] | None = None) -> None:
        """Keep the report-facing customer-, product- and seller-grain tables in executor memory
        (spilling to disk), in place of a per-process response cache. Opt-in: at full scale
        choose tables that fit the cluster's storage memory."""
        from pyspark import StorageLevel
        for name in tables or self.SERVING_TABLES:
            rel = next((r for r in self._tables if r.endswith("/" + name)), None)
            df = self.model(name)
            cached = df.persist(StorageLevel.MEMORY_AND_DISK)
            cached.count()
            if rel:
                self._tables[rel] = cached
