"""CSV records with line breaks, cut by many tasks, against Spark's multi-line reader."""

import random

from tidemark.sources import csv as CSV
from tidemark.sources.records import ranges_inside_quotes, records
from tidemark.sources.schemas import RAW_SCHEMAS
from pyspark.sql import functions as F

HEAD = "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp"


def made(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(['a', 'é', ' ', ',', '""', '\n', '\n\n', '🙂', 'word ']) for _ in range(rnd.choice([0, 3, 20, 400])))
        title = rnd.choice(["", "plain", '"a ""b"""', '"x\ny"'])
        rows.append(f'r{i},o{i % 7},{i % 5 + 1},{title},"{text}",2018-01-01 00:00:00,{"2018-01-02 10:11:12" if i % 3 else ""}')
    return rows


def multi_line(spark, path):
    return spark.read.schema(RAW_SCHEMAS["order_reviews"]).options(header="true", multiLine="true", **CSV.OPTIONS).csv(path)


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text("\n".join([HEAD, *made(800)]) + "\n", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = spark.read.option("lineSep", "\n").text(str(path)).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
        inside = ranges_inside_quotes(lines)
        assert len(inside) > 10 and any(inside.values()) and not all(inside.values())
        got = CSV.read_csv(spark, str(path), "order_reviews")
        assert got.count() == 800 and same(got, multi_line(spark, str(path)))
        # a record longer than several ranges, and one that ends the file without a line break
        long = 'r9,o9,1,,"' + "line\n" * 5000 + '",2018-01-01 00:00:00,'
        path.write_text("\n".join([HEAD, *made(50, 2), long, *made(50, 3), 'z,o,2,,"open\nend",,']), newline="")
        assert same(CSV.read_csv(spark, str(path), "order_reviews"), multi_line(spark, str(path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_several_files_empty_ones_and_windows_line_ends(spark, tmp_path):
    d = tmp_path / "many.csv"
    d.mkdir()
    for k in range(4):
        (d / f"part-{k}.csv").write_text("\n".join([HEAD, *made(20, k)]) + "\n", newline="")
    (d / "part-8.csv").write_text("")
    (d / "part-9.csv").write_text(HEAD + "\n")
    assert same(CSV.read_csv(spark, str(d), "order_reviews"), multi_line(spark, str(d)))
    w = tmp_path / "w.csv"
    w.write_bytes(("﻿" + HEAD + '\r\nr1,o1,5,,"a\r\nb",,\r\n\r\nr2,o2,4,t,,,\r\n').encode())
    assert [r.record for r in records(spark, str(w)).collect()] == ['r1,o1,5,,"a\r\nb",,', "r2,o2,4,t,,,"]
    got = {r.review_id: r for r in CSV.read_csv(spark, str(w), "order_reviews").collect()}
    assert got["r2"].review_comment_title == "t" and got["r1"].review_score == 5 and got["r1"].review_comment_message.split() == ["a", "b"]
