"""Decontamination stage: items shorter than a window."""

from tidemark.llm import decontam
from tidemark.llm.storage import Scratch


def test_short_items_leave_clean_documents(spark):
    plain = "the cat of la mer said yes to all de la tour " * 5
    long = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, plain), (2, "Yes."), (3, plain + long), (4, "de la yes or no"), (5, "nothing here"), (6, None)],
                                 "doc_id long, text string")
    items = spark.createDataFrame([("a", "yes"), ("b", "the"), ("c", "de la"), ("d", long)], "item_id string, text string")
    kept = decontam.drop_contaminated(docs, items, Scratch(spark, "t"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6]
    hit = decontam.decontaminate(docs, items, Scratch(spark, "t")).where("n_hit > 0")
    assert sorted(r.doc_id for r in hit.collect()) == [1, 2, 3, 4]
