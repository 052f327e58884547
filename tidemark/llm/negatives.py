"""Hard negatives by a vertical (BOND) scan of the embeddings.

Vectors of whole numbers are stored in blocks, dimension by dimension, with the smallest and
largest value of each. An anchor reads a block's dimensions in the order of its own falling
magnitudes and adds them to the candidates' partial scores. What the dimensions still to come can add lies between
the sums of their smallest and largest contributions; with these bounds a bitmap of candidates
shrinks: out goes who can no longer reach a score window, can no longer stay in it, or is below
K others that are surely in it. Who is left when all dimensions are read has an exact score.

Two scans: over rows of the anchor's label with one open window for its positives, then over rows of other labels
with one window per positive. Anchors come in chunks, which are joined to the blocks by strip (every chunk is needed
once in each strip), so a task holds one chunk and one block at a time. What leaves a task is K rows at most per
anchor, window and block; a window function with Spark's group limit merges them.

Ties go to the smaller vec_id, null last, then to the earlier row.

Defined results: rows without label, with a null or empty vector, with null or non-finite entries, or with entries
of 2**18 or more (their products may leave a long) take no part; nor do vectors of another than the most frequent length. A row
without vec_id is no anchor but may be found. Rows that repeat a vec_id are rows like others: each is an anchor of its own
and can be another's positive. An anchor without other rows of its label, or whose windows are empty, gives no rows; nor does an empty table.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch, table
from .vectors import common_length, scaled

LIMIT = float(1 << 18)
K = 5
#: A negative's score is at least this percentage of the positive's, and at most all of it.
LOWEST_PERCENT = 80
BLOCK, CHUNK = 4096, 256
#: Dimensions read between two looks at the bounds.
STEP = 8
#: Blocks in a strip, once there are more than Spark's shuffle partitions.
STRIP_BLOCKS = 16
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _packed(batch: pa.RecordBatch, d: int, rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, row, has no id, id, label, x) for slices of so many rows."""
    row, ids, label = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
    none, ids = ids.is_null().to_numpy(False), ids.fill_null(0).to_numpy()
    x = batch.column(3).flatten().to_numpy().reshape(-1, d)
    for a in range(0, len(row), rows):
        b = min(a + rows, len(row))
        yield a, b, row[a:b], none[a:b], ids[a:b], label[a:b], x[a:b]


def _block_batches(d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, row, none, ids, label, x in _packed(batch, d, BLOCK):
                cols = np.ascontiguousarray(x.T).astype("<i8")
                parts = [row, none, ids, label, cols, cols.min(1), cols.max(1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(row[0])]), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                    ["block", "row", "none", "ids", "label", "cols", "low", "high"])
    return run


def _chunk_batches(d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column(4)
            for a, b, row, _, _, label, x in _packed(batch, d, CHUNK):
                floors, ceils = [], []
                for w in windows.slice(a, b - a).to_pylist():
                    w = w or []
                    floors.append([-((-LOWEST_PERCENT * v) // 100) if v is not None else _LOW for v in w])
                    ceils.append([v if v is not None else _HIGH for v in w])
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([p.tobytes()], pa.binary()) for p in (row, label, x.astype("<i8"))],
                     pa.array([floors], pa.list_(pa.list_(pa.int64()))), pa.array([ceils], pa.list_(pa.list_(pa.int64())))],
                    ["a_row", "a_label", "a_x", "floors", "ceils"])
    return run


def bond(a: np.ndarray, cols: np.ndarray, low: np.ndarray, high: np.ndarray, candidates: np.ndarray,
         floors: list[int], ceils: list[int], k: int = K, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose scores may be among the k best of a window, their exact scores, and a bitmap row per window.

    ``cols`` has a row per dimension, with smallest values ``low`` and largest ``high``.
    """
    order = np.argsort(-np.abs(a), kind="stable")
    ends = np.stack([a * low, a * high])[:, order]
    rest_low, rest_high = [np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(0), ends.max(0))]
    place = np.flatnonzero(candidates)
    score = np.zeros(len(place), np.int64)
    live = np.ones((len(floors), len(place)), bool)
    for at in range(0, len(a), step):
        dims = order[at:at + step]
        score += a[dims] @ (cols[dims] if len(place) == cols.shape[1] else np.take(cols[dims], place, 1))
        done = min(at + step, len(a))
        least, most = score + rest_low[done], score + rest_high[done]
        for w, (floor, ceil) in enumerate(zip(floors, ceils)):
            live[w] &= (most >= floor) & (least <= ceil)
            sure = least[live[w] & (least >= floor) & (most <= ceil)]
            if len(sure) > k:
                live[w] &= most >= np.partition(sure, len(sure) - k)[len(sure) - k]
        keep = live.any(0)
        if 4 * keep.sum() < 3 * len(keep):
            place, score, live = place[keep], score[keep], live[:, keep]
        if not len(place):
            break
    return place, score, live


def _scan_batches(same: bool, d: int) -> Callable:
    names = ["a_row", "w", "row", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda f, t="<i8": np.frombuffer(batch.column(f)[r].as_buffer(), t)  # noqa: B023, E731
                row, none, ids, label = get("row"), get("none", bool), get("ids"), get("label")
                cols, low, high = get("cols").reshape(d, -1), get("low"), get("high")
                out: list[list[np.ndarray]] = []
                for a_row, a_label, a, floors, ceils in zip(get("a_row"), get("a_label"), get("a_x").reshape(-1, d),
                                                            batch.column("floors")[r].as_py(), batch.column("ceils")[r].as_py()):
                    fits = (label == a_label) & (row != a_row) if same else label != a_label
                    place, score, live = bond(a, cols, low, high, fits, floors, ceils)
                    for w in range(len(floors)):
                        on = live[w]
                        p, s = place[on], score[on]
                        best = np.lexsort((row[p], ids[p], none[p], -s))[:K]
                        p = p[best]
                        out.append([np.full(len(p), a_row), np.full(len(p), w), row[p], ids[p], none[p], s[best]])
                if out:
                    a_row, w, found, vec_id, missing, score = [np.concatenate(c) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a_row), pa.array(w.astype(np.int32)), pa.array(found), pa.array(vec_id, mask=missing), pa.array(score)], names)
    return run


def _best(blocks: DataFrame, anchors: DataFrame, strips: int, d: int, same: bool) -> DataFrame:
    """The K best rows (a_row, w, rank, row, vec_id, score) of every anchor and window."""
    chunks = anchors.mapInArrow(_chunk_batches(d), "a_row binary, a_label binary, a_x binary, floors array<array<long>>, ceils array<array<long>>")
    chunks = chunks.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    pairs = blocks.repartition(strips, "strip").join(chunks.repartition(strips, "strip"), "strip")
    found = pairs.drop("strip", "block").mapInArrow(_scan_batches(same, d), "a_row long, w int, row long, vec_id long, score long")
    order = Window.partitionBy("a_row", "w").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)


def hard_negatives(vectors: DataFrame, scratch: Scratch, anchor_every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; ``vectors`` has vec_id, label and embedding."""
    label = vectors["label"].cast("long")
    rows = scaled(vectors.where(label.isNotNull()), LIMIT, label.alias("label"))
    d = common_length(rows)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not d:
        return vectors.sparkSession.createDataFrame([], out)
    rows = scratch.write(rows.where(F.size("x") == d).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "x"), "rows")
    blocks = scratch.write(rows.mapInArrow(
        _block_batches(d), "block long, row binary, none binary, ids binary, label binary, cols binary, low binary, high binary"), "blocks")
    count = blocks.count()
    strips = max(min(count, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), count // STRIP_BLOCKS)
    blocks = blocks.withColumn("strip", F.pmod(F.xxhash64("block"), F.lit(strips)).cast("int"))

    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    open_window = F.array(F.lit(None).cast("long"))
    positives = scratch.write(_best(blocks, anchors.withColumn("scores", open_window), strips, d, True), "positives")
    windows = positives.groupBy("a_row").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("s")) \
        .select(F.col("a_row").alias("row"), F.col("s.score").alias("scores"))
    anchors = anchors.join(windows, "row").select("row", "vec_id", "label", "x", "scores")
    negatives = _best(blocks, anchors, strips, d, False)
    return negatives.select("a_row", (F.col("w") + 1).alias("p"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")) \
        .join(positives.select("a_row", F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["a_row", "p"]) \
        .join(rows.select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id")), "a_row") \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th embedding; a seventh of the labels are moved on by one first."""
    e = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    return hard_negatives(e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)), Scratch(spark, "op13"))
