"""CSV source, table sinks and the streaming ingest."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.plans.registry import wh
from tidemark.sinks import tables as SK
from tidemark.sources import csv as CSV
from tidemark.streaming.ingest import ingest_drops

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test data not present")


def same_rows(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_raw_csv_round_trip_keeps_values(spark, tmp_path):
    w = wh(spark, SF_SMALL)
    for t in ["orders", "closed_deals", "order_items"]:
        path = str(tmp_path / t)
        SK.write_raw_csv(w.raw(t), path)
        assert same_rows(CSV.read_csv(spark, path, t), w.raw(t)), t


def test_csv_reader_bom_and_embedded_newlines(spark, tmp_path):
    p = tmp_path / "translations.csv"
    p.write_bytes("﻿product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n"
                  ",empty_key\n".encode("utf-8"))
    rows = CSV.read_csv(spark, str(p), "category_translations").collect()
    assert rows[0].product_category_name == "beleza_saude" and rows[1].product_category_name is None
    r = tmp_path / "reviews.csv"
    r.write_text('review_id,order_id,review_score,review_comment_title,review_comment_message,'
                 'review_creation_date,review_answer_timestamp\n'
                 'r1,o1,5,,"line one\nline two",2018-01-01 00:00:00,2018-01-02 10:11:12\n')
    (row,) = CSV.read_csv(spark, str(r), "order_reviews").collect()
    assert row.review_comment_message == "line one\nline two" and row.review_score == 5
    assert row.review_comment_title is None


def test_catalogue_reports_every_missing_file(tmp_path):
    with pytest.raises(FileNotFoundError) as e:
        CSV.resolve([str(tmp_path)], "marketing")
    assert "olist_marketing_qualified_leads_dataset.csv" in str(e.value)
    assert "olist_closed_deals_dataset.csv" in str(e.value)


def test_streaming_ingest_is_exactly_once(spark, tmp_path):
    w = wh(spark, SF_SMALL)
    orders = w.raw("orders")
    a = orders.where(F.col("order_id") < "O3")
    b = orders.where(F.col("order_id") >= "O3")
    drops, target, ckpt = str(tmp_path / "drops"), str(tmp_path / "raw_orders"), str(tmp_path / "ckpt")
    SK.write_raw_csv(a, str(tmp_path / "stage_a"))
    SK.write_raw_csv(b, str(tmp_path / "stage_b"))
    os.makedirs(drops)

    def drop(stage, tag):
        for f in os.listdir(stage):
            if f.endswith(".csv"):
                os.link(os.path.join(stage, f), os.path.join(drops, f"{tag}-{f}"))

    drop(str(tmp_path / "stage_a"), "a")
    assert ingest_drops(spark, "orders", drops, target, ckpt) == a.count()
    assert ingest_drops(spark, "orders", drops, target, ckpt) == a.count()  # nothing new: nothing added
    drop(str(tmp_path / "stage_b"), "b")
    assert ingest_drops(spark, "orders", drops, target, ckpt) == orders.count()
    assert same_rows(spark.read.parquet(target), orders)


def test_upsert_keeps_missing_keys_and_replaces_present(spark, tmp_path):
    path = str(tmp_path / "store")
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    SK.upsert(spark, path, old, ["k"], stamp_col="updated_at")
    new = spark.createDataFrame([("b", 20.0), ("d", 40.0)], "k string, v double")
    out = SK.upsert(spark, path, new, ["k"], stamp_col="updated_at")
    got = {r.k: r.v for r in out.collect()}
    assert got == {"a": 1.0, "b": 20.0, "c": 3.0, "d": 40.0}
    assert out.where(F.col("updated_at").isNull()).count() == 0
    assert not [p for p in os.listdir(tmp_path) if "__tmp_" in p or "__old_" in p]


def test_append_checked_flags_double_load(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    assert SK.append_checked(df, path, ["k"]) == 0
    assert SK.append_checked(df, path, ["k"]) == 2


def test_campaign_csv_export(spark, tmp_path):
    from tidemark.plans.registry import QUERIES
    exp = QUERIES["campaign_export"](spark, SF_SMALL)
    SK.write_csv(exp, str(tmp_path / "campaign"))
    back = spark.read.option("header", True).csv(str(tmp_path / "campaign"))
    assert back.count() == exp.count() and back.columns == exp.columns


def test_ingest_job_reload_and_append_check(spark, tmp_path):
    from tidemark.sources.ingest import run_ingest
    w = wh(spark, SF_SMALL)
    target = str(tmp_path / "raw")
    s1 = {r.table_name: r.row_count for r in run_ingest(spark, [w.csv_dir], target, "marketing").collect()}
    assert s1 == {"raw_marketing.mql": w.raw("mql").count(), "raw_marketing.closed_deals": w.raw("closed_deals").count()}
    run_ingest(spark, [w.csv_dir], target, "marketing", truncate=True)  # reload: same counts
    with pytest.raises(ValueError):
        run_ingest(spark, [w.csv_dir], target, "marketing", truncate=False)  # append twice: duplicate keys
