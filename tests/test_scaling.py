"""What grows with the input: shuffle partitions, the CSV files and raw tables that a job writes, training partitions."""

import os

import pytest

from tidemark import session as sess
from tidemark.operators import churn as C
from tidemark.plans.registry import QUERIES
from tidemark.plans.warehouse import Warehouse

SF = "/root/testdata/sf0.001"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.fixture
def conf(spark):
    was = {k: spark.conf.get(k, None) for k in (INITIAL, *SIZES)}
    for k in was:
        spark.conf.unset(k)
    yield spark.conf
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_shuffle_partitions_grow_with_the_input(spark, conf):
    sess.scale_to_input(spark, 1000)
    assert conf.get(INITIAL) == conf.get("spark.sql.shuffle.partitions")
    sess.scale_to_input(spark, 6 << 30)
    assert int(conf.get(INITIAL)) == (6 << 30) // sess.INPUT_BYTES_PER_PARTITION
    assert [int(conf.get(k)) for k in SIZES] == [sess.SPLIT_BYTES, sess.PARTITION_BYTES]


def test_smaller_partitions_of_the_session_are_kept(spark, conf):
    conf.set(SIZES[0], "1m")
    conf.set(SIZES[1], "16k")
    sess.scale_to_input(spark, 6 << 30)
    assert [conf.get(k) for k in SIZES] == ["1m", "16k"]


def test_training_partitions_are_bounded():
    assert [C.training_partitions(n) for n in (0, 25_000, 25_001, 10 ** 9)] == [1, 1, 2, C.MOST_PARTITIONS]


def test_a_csv_job_writes_what_it_reads(spark):
    """Neither the other tables' files nor the numbered lines are made for a job that doesn't read them."""
    w = Warehouse.for_testdata(spark, SF, fresh=True)
    local = w.root.removeprefix("file:")
    assert QUERIES["csv_ingest_orders"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert os.listdir(f"{local}/csv") == ["olist_orders_dataset.csv"] and not os.path.exists(f"{local}/source")
    got = {r.table_name: r.row_count for r in QUERIES["ingest_marketing"](spark, SF).collect()}
    assert got == {"raw_marketing.mql": w.raw("mql").count(), "raw_marketing.closed_deals": w.raw("closed_deals").count()}
    assert len(os.listdir(f"{local}/csv")) == 3 and not os.path.exists(f"{local}/source")
    assert w.csv_dir == f"{w.root}/csv" and len(os.listdir(f"{local}/csv")) == 11
