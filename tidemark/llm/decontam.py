"""Benchmark decontamination by winnowing.

An item of WINDOW words or more occurs in a document where WINDOW consecutive words of it
do. Both sides keep the smallest hash of 5-word grams in every run of 6 grams: a shared run of
5 + 6 - 1 = WINDOW words then shares a fingerprint, so no occurrence is missed. The
fingerprints are joined, and each hit is extended word by word, on the words themselves, to the
longest match around it; matches of WINDOW words or more count. A shorter item is one gram of
all its words.

Documents are read once. A bit table of the items' fingerprints drops almost all of a
document's fingerprints where they arise; the rest are joined by key (Spark broadcasts the
items' side only if it has measured it to be small, and splits hot keys otherwise). Items that share a passage share its
fingerprints: the same words around one are one row with all their ids, and a hit there is extended once. One marker row
per document goes through the same join, under a key of its own, so that clean documents stay
in the result without a second scan. The filtering stage writes its input with a row id first, so
that only the rows judged contaminated leave: those with a hit of WINDOW words or more, and those in
which hits make up SHORT_PERCENT of the words. A shorter item inside a longer text is no
proof (an item may be one word), so the stage keeps that text; ``decontaminate`` reports it.

Defined results: a null text has no words; an item without words never occurs; repeated
document rows each get a row; repeated items with one item_id count once; the windows of an
item without item_id count as hits but the item isn't listed. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .membership import bit_table, may_contain
from .storage import Scratch, table

WINDOW = 10
GRAM = 5
RUN = WINDOW - GRAM + 1
#: Share of a document's words that hits of short items have to make up for the stage to drop it.
SHORT_PERCENT = 50


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    low = T.LOWER[data]
    starts, ends, first = T.tokens(T.ALNUM[low], offsets)
    return low, starts, ends, first


def winnow(grams: np.ndarray, row_of_word: np.ndarray) -> np.ndarray:
    """Places of the grams that are the smallest of some run of RUN grams within a row."""
    n = len(row_of_word) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = grams[:n].copy()
    for j in range(1, RUN):
        np.minimum(least, grams[j:n + j], out=least)
    least[row_of_word[:n] != row_of_word[WINDOW - 1:]] = 0
    largest = np.zeros(n + RUN - 1, np.uint64)
    for j in range(RUN):
        np.maximum(largest[j:j + n], least, out=largest[j:j + n])
    return np.flatnonzero((largest == grams[:len(largest)]) & (largest != 0))


def _context(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> str:
    return " ".join(low[starts[i]:ends[i]].tobytes().decode("utf-8", "replace") for i in range(a, b))


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column(0), []
        for lo, hi, data, offsets in T.chunks(*T.utf8(batch.column(1))):
            low, starts, ends, first = _words(data, offsets)
            hashes = T.token_hashes(low, starts, ends)
            for r in range(hi - lo):
                a, b = int(first[r]), int(first[r + 1])
                item = ids[lo + r].as_py()
                if b - a >= WINDOW:
                    grams = T.gram_hashes(hashes[a:b], GRAM)
                    for p in winnow(grams, np.zeros(b - a, np.int64)):
                        left = min(int(p), RUN - 1)
                        rows.append((WINDOW, grams[p].astype(np.int64), item, left, _context(
                            low, starts, ends, a + int(p) - left, min(b, a + int(p) + WINDOW))))
                elif b > a:
                    gram = T.gram_hashes(hashes[a:b], b - a)[0]
                    rows.append((b - a, gram.astype(np.int64), item, 0, _context(low, starts, ends, a, b)))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array([int(x) for x in cols[1]], pa.int64()), pa.array(cols[2], pa.string()),
             pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], ["window", "hash", "item_id", "i_left", "i_words"])


def item_fingerprints(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Distinct fingerprints with the words around them (window, hash, i_left, i_words) and the item_ids that share them."""
    return items.select(items[item_id].cast("string"), items[text].cast("string")).mapInArrow(
        _item_batches, "window int, hash long, item_id string, i_left int, i_words string") \
        .groupBy("window", "hash", "i_left", "i_words").agg(F.collect_set("item_id").alias("item_ids"))


_DOC_SCHEMA = "row_id long, doc_id long, n_words long, window int, hash long, pos long, d_left int, d_words string"


def _doc_batches(bits: Broadcast, short: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_ids, doc_ids = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in T.chunks(*T.utf8(batch.column(2))):
                low, starts, ends, first = _words(data, offsets)
                hashes, n = T.token_hashes(low, starts, ends), hi - lo
                row_of_word = np.repeat(np.arange(n), np.diff(first))
                grams = T.gram_hashes(hashes, GRAM)
                found = []  # window, row, word, hash
                at = winnow(grams, row_of_word)
                at = at[may_contain(bits.value, grams[at])]
                found += [(WINDOW, int(p), int(grams[p].astype(np.int64))) for p in at]
                for size in short:
                    grams = T.gram_hashes(hashes, size)
                    inside = row_of_word[:len(grams)] == row_of_word[size - 1:]
                    at = np.flatnonzero(inside & may_contain(bits.value, grams))
                    found += [(size, int(p), int(grams[p].astype(np.int64))) for p in at]
                rows = [int(row_of_word[p]) for _, p, _ in found]
                lefts = [min(p - int(first[r]), RUN - 1) if w == WINDOW else 0 for (w, p, _), r in zip(found, rows)]
                texts = [_context(low, starts, ends, p - k, min(int(first[r + 1]), p + w))
                         for (w, p, _), r, k in zip(found, rows, lefts)]
                markers = T.mix(np.asarray(row_ids[lo:hi], dtype=np.int64).astype(np.uint64)).astype(np.int64)
                take = pa.array([*range(lo, hi), *[lo + r for r in rows]], pa.int64())
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    row_ids.take(take), doc_ids.take(take),
                    pa.concat_arrays([pa.array(np.diff(first), pa.int64()), pa.nulls(len(found), pa.int64())]),
                    pa.array([0] * n + [w for w, _, _ in found], pa.int32()),
                    pa.array([*markers.tolist(), *[h for _, _, h in found]], pa.int64()),
                    pa.concat_arrays([none, pa.array([p - int(first[r]) for (_, p, _), r in zip(found, rows)], pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(lefts, pa.int32())]),
                    pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(texts, pa.string())]),
                ], ["row_id", "doc_id", "n_words", "window", "hash", "pos", "d_left", "d_words"])
    return run


def _run_length(equal: Column, size: Column) -> Column:
    """How many of the first values of a boolean array are true."""
    stop = F.array_position(equal, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(size)


def extend(joined: DataFrame) -> DataFrame:
    """Adds the longest match around each joined fingerprint: words [start, stop) of the document."""
    j = joined.withColumns({"dw": F.split("d_words", " "), "iw": F.split("i_words", " ")})
    same = lambda o: F.coalesce(F.get("dw", F.col("d_left") + o) == F.get("iw", F.col("i_left") + o), F.lit(False))
    to_right = F.transform(F.sequence(F.lit(0), F.col("window") - 1), same)
    to_left = F.transform(F.sequence(F.lit(1), F.lit(RUN - 1)), lambda k: same(-k))
    j = j.withColumns({"right": _run_length(to_right, F.col("window").cast("long")),
                       "left": F.when(F.col("window") == WINDOW, _run_length(to_left, F.lit(RUN - 1).cast("long")))
                       .otherwise(F.lit(0).cast("long"))})
    return j.withColumns({"start": F.col("pos") - F.col("left"), "stop": F.col("pos") + F.col("right")}) \
        .withColumn("hit", F.coalesce(F.col("stop") - F.col("start") >= F.col("window"), F.lit(False))
                    & F.col("i_words").isNotNull()).drop("dw", "iw", "left", "right")


def decontaminate(docs: DataFrame, items: DataFrame, scratch: Scratch, text: str = "text", row: str | None = None) -> DataFrame:
    """One row per document row: row_id (the column ``row``, if given), doc_id, n_words, n_hit, the hit ranges of words,
    the items that occur, and whether a whole window does."""
    spark = docs.sparkSession
    prints = scratch.write(item_fingerprints(items), "items")
    bits = spark.sparkContext.broadcast(bit_table(prints, F.col("hash")))
    short = sorted(r[0] for r in prints.where(F.col("window") < WINDOW).select("window").distinct().collect())
    row_id = docs[row] if row else F.monotonically_increasing_id()
    marked = docs.select(row_id.alias("row_id"), docs["doc_id"].cast("long"), docs[text].cast("string")) \
        .mapInArrow(_doc_batches(bits, short), _DOC_SCHEMA)
    hits = extend(marked.join(prints, ["window", "hash"], "left"))
    by_row = hits.groupBy("row_id", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.max(F.col("hit") & (F.col("window") == WINDOW)).alias("whole_window"),
        F.array_sort(F.collect_set(F.when(F.col("hit"), F.struct("start", "stop")))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("hit"), F.col("item_ids")))))).alias("items"))
    covered = F.aggregate(
        "ranges", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["upto"], x["stop"]).alias("upto"),
                                (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["upto"], x["start"]))).alias("n")))["n"]
    return by_row.withColumn("n_hit", covered)


def drop_contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows in which no benchmark window occurs and that don't consist of short items, columns unchanged."""
    rows = scratch.write(docs.withColumn("decontam__row", F.monotonically_increasing_id()), "rows")
    bad = decontaminate(rows, items, scratch, row="decontam__row") \
        .where(f"whole_window or (n_hit > 0 and 100 * n_hit >= {SHORT_PERCENT} * n_words)")
    return rows.join(bad.select(F.col("row_id").alias("decontam__row")), "decontam__row", "left_anti").select(*docs.columns)


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit and benchmark items that occur, for every document."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op4"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
