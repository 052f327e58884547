"""Training rows of the licence scan hold whole paragraphs."""

from tidemark.llm import licences
from tidemark.llm.storage import Scratch


def test_plain_rows_are_whole_paragraphs(spark):
    text = "plain " * 500 + "of the x you may x in the x is the x with or x"
    docs = spark.createDataFrame([(i, text + f"\nline {i}") for i in range(30)], "doc_id long, text string")
    rows = licences.training_rows(docs, Scratch(spark, "t")).where("family = 'none'").collect()
    assert any("you may" in r.grams for r in rows)
    assert any("you may" in r.grams for r in rows if r.part == 2)
