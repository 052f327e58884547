"""The pipeline's stages on nulls, empty and repeated rows, clashing columns, and on an empty table."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, slot string, words long, mix__row int"
SF = "/root/testdata/sf0.001"


def through(spark, docs, tmp_path):
    """Columns and rows after each stage, each written and read again."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.schema(got.schema).parquet(str(tmp_path / name))
        out.append((name, docs.columns, docs.count()))
    return out


def test_odd_rows_pass_every_stage(spark, tmp_path):
    prose = "The first of many words in a plain text that goes on and on for long enough to be kept as it is with the rest. " \
            "It was said of the house by the river that no one had seen the inside of it in the years of the old king and his sons."
    other = prose.replace("river", "mill").replace("king", "duke").replace("house", "barn") + " So they went to the market and sold what they had."
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, prose, "en", "a"), (3, prose, "en", "a"), (None, other, None, None),
            (5, other[:-1], None, "b"), (6, "lorem ipsum the of and " * 20_000, "en", "b"), (7, "x", "xx", "c")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, "s", 3, 9) for r in rows], SCHEMA)
    got = through(spark, docs, tmp_path)
    assert all(columns == docs.columns for _, columns, _ in got[:4])
    kept = {name: n for name, _, n in got}
    assert kept["quality_rules"] >= 4 > kept["near_duplicates"] >= 1 and kept["token_rows"] >= 1
    left = spark.read.parquet(str(tmp_path / "near_duplicates")).collect()
    assert len({r.text for r in left}) == len(left)


def test_an_empty_table_passes_every_stage(spark, tmp_path):
    got = through(spark, spark.createDataFrame([], SCHEMA), tmp_path)
    assert [n for _, _, n in got] == [0] * 5 and all(len(c) == 9 for _, c, _ in got[:4])
