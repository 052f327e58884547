"""CSV files whose fields hold line breaks, read by many tasks.

A reader that allows line breaks in fields can't be cut: where a byte range begins, nothing says whether it lies inside
quotes. Here a file is read as lines, in byte ranges, twice. The first pass counts each range's quotes; whether
an odd number of them stands before a range (one row per range, summed in order) tells whether it begins inside a field. In the
second pass every range is cut into records by itself, line after line with that parity. Records that a range
holds whole leave as they are; the piece of a record at a range's end goes together with the pieces at the beginning of the
ranges after it. Only those pieces, two a range at most, are shuffled.

Quotes enclose fields, and are doubled inside one; the first line is a header. Line breaks inside fields are kept as they are;
records may end in \\r\\n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RANGE = ["file", "start"]
#: What a task makes of its lines: a whole record, the rest of a record begun before the range, or one that goes on after it.
WHOLE, HEAD, TAIL = 0, 1, 2


def ranges_inside_quotes(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """Whether each byte range of each file begins inside a quoted field; one row per range reaches the driver."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per_range = lines.groupBy(*_RANGE).agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = per_range.select(*_RANGE, (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside")).collect()
    return {(r["file"], r["start"]): r["inside"] for r in rows}


def _cut(inside_at: dict[tuple[str, int], bool]) -> Callable:
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[str, int] | None = None  # the range at hand, the lines of its open record, and whether that began before it
        held: list[str] = []
        inside, from_before = False, False

        def rows(kinds: list[int], records: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([here[0]] * len(kinds), pa.string()), pa.array([here[1]] * len(kinds), pa.int64()),
                                               pa.array(kinds, pa.int32()), pa.array(records, pa.string())], schema=schema)

        def rest() -> Iterator[pa.RecordBatch]:
            if held:  # open at the range's end: also a range that lies in one record as a whole
                yield rows([HEAD if from_before else TAIL], ["\n".join(held)])

        for batch in batches:
            files, starts = batch.column(0), batch.column(1).to_numpy()
            values = batch.column(2)
            odd = pc.count_substring(values, '"').to_numpy() % 2 == 1
            same_file = pc.equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(False) if len(files) > 1 else np.empty(0, bool)
            edges = np.flatnonzero(np.concatenate(([True], ~same_file | (starts[1:] != starts[:-1])))) if len(files) else []
            for a, b in zip(edges, [*edges[1:], len(files)]):
                now = (files[int(a)].as_py(), int(starts[a]))
                text = values.slice(a, b - a).to_pylist()
                if now != here:
                    if here is not None:
                        yield from rest()
                    here, held = now, []
                    inside = from_before = inside_at[now]
                    if now[1] == 0:
                        text, odd_here = text[1:], odd[a + 1:b]  # the header
                    else:
                        odd_here = odd[a:b]
                else:
                    odd_here = odd[a:b]
                kinds, records = [], []
                for line, flip in zip(text, odd_here):
                    inside ^= bool(flip)
                    if inside or held or from_before:
                        held.append(line)
                    if inside:
                        continue
                    kinds.append(HEAD if from_before else WHOLE)
                    records.append("\n".join(held) if held else line)
                    held, from_before = [], False
                if kinds:
                    yield rows(kinds, records)
        if here is not None:
            yield from rest()
    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """Column ``record``: every record of the CSV files at ``path`` but the headers."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    cut = lines.mapInArrow(_cut(ranges_inside_quotes(lines)), "file string, start long, kind int, record string")
    # a record's pieces: a tail and the heads of the ranges after it
    chain = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    pieces = cut.where(F.col("kind") != WHOLE).withColumn("of", F.count_if(F.col("kind") == TAIL).over(chain))
    joined = pieces.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("p")) \
        .select(F.array_join(F.col("p.record"), "\n").alias("record"))
    out = cut.where(F.col("kind") == WHOLE).select("record").unionByName(joined)
    return out.select(F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")


def read_records(spark: SparkSession, path: str, schema, options: dict[str, str]) -> DataFrame:
    """The files' rows by a fixed schema, parsed by Spark's own CSV expression."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return records(spark, path).select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
