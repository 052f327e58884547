"""Near-duplicates where doc_id repeats or is null."""

from tidemark.llm import neardup
from tidemark.llm.storage import Scratch


def text(tag, n=60):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_near_duplicates_keep_one_row_of_each_component(spark):
    a = text("a")
    rows = [(3, a), (7, a), (7, text("b")), (5, text("c")), (5, text("c")), (None, text("d")), (None, text("d")),
            (None, a), (None, text("e")), (8, ""), (8, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row long")
    kept = neardup.drop_near_duplicates(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    want = [(3, a), (7, text("b")), (5, text("c")), (None, text("d")), (None, text("e")), (8, ""), (8, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    judged = neardup.near_duplicates(docs, Scratch(spark, "t")).collect()
    assert len(judged) == len(rows) and sum(r.kept for r in judged) == len(want)
    assert {r.component_id for r in judged if r.doc_id == 7} == {3, 7}
