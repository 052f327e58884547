"""Offset paging and keyset paging return the same pages."""

from pyspark.sql import functions as F

from tidemark.operators import paging


def test_keyset_equals_offset(spark):
    rows = [(f"id{i:03d}", None if i % 11 == 0 else float(i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, v double")
    after, seen = None, []
    for page_no in range(1, 12):
        off = [tuple(r) for r in paging.page(df, "v", False, "id", page_no, 10).collect()]
        key = [tuple(r) for r in paging.keyset_page(df, "v", False, "id", after, 10).collect()]
        assert off == key
        if not key:
            break
        seen += key
        after = (key[-1][1], key[-1][0])  # (sort value, id)
    assert len(seen) == 100
    nulls_at_end = [v for _, v in seen][-10:]
    assert all(v is None for v in nulls_at_end[-9:])


def test_page_meta(spark):
    df = spark.range(45)
    m = paging.page_meta(df, 2, 20).first()
    assert (m.total_items, m.total_pages, m.has_next, m.has_prev) == (45, 3, True, True)
    assert paging.page_meta(df.where(F.col("id") < 0), 1, 20).first().total_pages == 0
