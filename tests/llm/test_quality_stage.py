"""Quality stage: texts that two of the thresholds say nothing about."""

from tidemark.llm import quality


def test_stage_keeps_uncovered_languages_and_very_long_texts(spark):
    words = ["слово", "мысль", "город", "река", "дорога", "утро", "книга", "письмо"]
    russian = " ".join(f"{words[i % 8]}{chr(0x430 + i // 8 % 32)}{chr(0x430 + i % 31)}" for i in range(200))
    plain = " ".join(f"word{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(200))
    long = " ".join(f"the w{i}" for i in range(500_050))
    rows = [(1, russian, "ru"), (2, russian, None), (3, russian, "en"), (4, plain, "en"), (5, plain, "pl"), (6, plain, None),
            (7, long, "en"), (8, "too short", "ru"), (9, None, None), (10, plain, "de-AT"), (11, russian + " %|<>" * 200, "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 7]
    assert sorted(r.doc_id for r in quality.keep_good(docs.drop("lang")).collect()) == [1, 2, 3, 7]
    assert not any(r.kept for r in quality.measure(docs).select("kept").collect())
