"""Decontamination stage: which rows leave."""

from tidemark.llm import decontam
from tidemark.llm.storage import Scratch


def text(tag, n=60):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_only_contaminated_rows_leave(spark):
    rows = [(1, text("w")), (2, text("x")), (2, text("w")), (None, text("w")), (None, text("y")), (None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row_id long")
    items = spark.createDataFrame([("i", text("w", 15))], "item_id string, text string")
    kept = decontam.drop_contaminated(docs, items, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(2, text("x")), (None, text("y")), (None, None)], key=str)
