"""Paragraphs of the licence scan, and a wrapped notice."""

from tidemark.llm import licences
from tidemark.llm.storage import Scratch


def test_paragraphs_end_at_blank_lines(spark):
    text = "a\nb \n \t\nc:\n\n  1. d\n\n\n - e\n\n\nf\r\n\r\ng" + "\n" * 50_000 + "h"
    rows = licences.paragraphs(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("line < 0").collect()
    assert [" ".join(r.passage.split()) for r in rows] == ["a b", "c: 1. d - e", "f", "g", "h"]


def test_wrapped_notice_is_found(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    gpl = ("This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General\n"
           "Public License as published by the Free Software\nFoundation, either version 3 of the License, or (at your\n"
           "option) any later version.")
    docs = corpus.unionByName(spark.createDataFrame([(10**9, f"Title\n\n{gpl}\n\nThe end of it.")], "doc_id long, text string"))
    got = {r.doc_id: r for r in licences.scan(docs, Scratch(spark, "t")).collect()}[10**9]
    assert (got.license, got.n_license_paragraphs, got.n_unknown_paragraphs) == ("gpl-3.0", 1, 0)
