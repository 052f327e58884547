"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The schedule has a slot for every BLOCK_WORDS words of the mix. Slot i stands at the i-th van der Corput point
(the bits of i, mirrored behind the binary point), and the source whose stretch of the cumulative targets holds that point has the
slot. Such points fill every stretch evenly, so each stretch of the schedule holds the sources to within a few slots
of their shares, without random draws. A source too small for a point gets one slot, at a point of its own.

Every source is laid out end to end in a fixed shuffled order, as many times as its target asks for (three at most,
the last time up to the target, to a word), and this stream is cut into as many blocks of equal words (to a word) as the source
has slots. The slots of a source are ranked, and the r-th slot takes the r-th block: what is taken of a document is what
the join of slots and blocks finds.

Targets: sources weigh 1, 2, 3 in turn, in order of their code points. A price per weight hands out all words; sources above
MAX_EPOCHS times their size are capped and the price is set anew from the others, until none is above.

Only (row, source, size) rows are shuffled; ``apply_mix`` also brings the texts into the order of the mix. Running totals and ranks
are taken in two levels (sums of buckets, then inside each bucket), so neither a source with most of the rows or slots nor a long
list of sources ends in one task. Sources and points meet by an equi-join on stretches of the unit interval.

Defined results: a null text or one without words has size 0 and is never taken; a null source is a source of its own, last in
order; rows that repeat a doc_id, or have none, are rows of their own, laid out one by one; rows of one order key are laid out in
row order. An empty table gives no rows. Other columns are ignored by ``mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Words in a block, about: a source's blocks are equal and differ from this by its rounding.
BLOCK_WORDS = 1024
#: Bits of a van der Corput point: exact in a double.
POINT_BITS = 52
#: Stretches of the unit interval by which sources and points are joined, at least.
STRETCHES = 4096
_ROW = "mix__row"


def sized(docs: DataFrame, text: str = "text", row: str | None = None) -> DataFrame:
    """row (the column ``row``, if given), doc_id, source, size in words, and the md5 of the id that gives the shuffled order."""
    return docs.select(
        (docs[row] if row else F.monotonically_increasing_id()).alias("row"), docs["doc_id"], docs["source"],
        F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))).alias("turn"))


def numbered(df: DataFrame, scratch: Scratch, name: str, *order: Column) -> DataFrame:
    """``df`` with ``sid``, its place in this order from 0: sorted over all tasks, then shifted by the rows of the parts before."""
    at = scratch.write(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("at", 33)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per task of the sort
    shift = at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least")) \
        .select("part", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return at.withColumn("part", part).join(shift, "part") \
        .withColumn("sid", F.col("shift") + F.col("at") - F.col("least")).drop("part", "at", "least", "shift")


def targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per source: sid, weight, source_size, target, and quota, the target in whole words."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = numbered(by_source, scratch, "by_source", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    t = scratch.write(t.withColumns({"weight": weight, "cap": MAX_EPOCHS * F.col("source_size")}), "weighed")
    price, above = 0.0, -1
    while True:  # every round caps more sources; one row reaches the driver
        over = F.col("cap") < F.lit(price) * F.col("weight")
        r = t.agg(F.count_if(over).alias("above"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
                  F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).alias("caps"),
                  F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weights")).first()
        if r["above"] == above or not r["weights"]:
            break
        above, price = r["above"], (r["total"] - r["caps"]) / r["weights"]
    target = F.least(F.col("cap").cast("double"), F.lit(price) * F.col("weight"))
    return t.withColumn("target", target).withColumn("quota", F.least("cap", F.round("target").cast("long"))).drop("cap")


def _bucket(n: int) -> int:
    """Rows of a bucket, so that buckets and rows in one are about as many."""
    return max(1, int(n ** 0.5))


def slots(sources: DataFrame, scratch: Scratch, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The schedule: one row per slot with sid, rank (among the source's slots, from 0), n_slots (of the source) and slot, its place in the mix."""
    s = sources.where("quota > 0").select("sid", "quota")
    n_sources, total = s.agg(F.count(F.lit(1)), F.coalesce(F.sum("quota"), F.lit(0))).first()
    n, size = max(1, -(-total // block_words)), _bucket(n_sources)
    # cumulative targets, in two levels
    s = s.withColumn("bucket", F.expr(f"sid div {size}"))
    sums = s.groupBy("bucket").agg(F.sum("quota").alias("q"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("bucket", F.coalesce(F.sum("q").over(before), F.lit(0)).alias("base"))
    upto = W.partitionBy("bucket").orderBy("sid").rowsBetween(W.unboundedPreceding, 0)
    s = s.join(sums, "bucket").withColumn("high", F.col("base") + F.sum("quota").over(upto)) \
        .select("sid", (F.col("high") - F.col("quota")).alias("low"), "high")
    s = scratch.write(s, "stretches")
    # points in order of their slots, each with its stretch
    stretches = max(STRETCHES, n_sources)
    bits = F.lpad(F.bin("id"), POINT_BITS, "0")
    place = F.floor(F.conv(F.reverse(bits), 2, 10).cast("double") / float(1 << POINT_BITS) * F.lit(float(total))).cast("long")
    points = sources.sparkSession.range(n).withColumn("place", F.least(place, F.lit(max(total - 1, 0)))) \
        .withColumn("stretch", F.floor(F.col("place").cast("double") / max(total, 1) * stretches).cast("long"))
    last = F.floor((F.col("high") - 1).cast("double") / max(total, 1) * stretches).cast("long")
    first = F.floor(F.col("low").cast("double") / max(total, 1) * stretches).cast("long")
    spread = s.withColumn("stretch", F.explode(F.sequence(first, last)))
    hit = points.join(spread, "stretch").where("place >= low and place < high").select("sid", F.col("id").cast("double").alias("slot"))
    alone = s.join(hit.select("sid").distinct(), "sid", "left_anti") \
        .select("sid", (F.col("low").cast("double") / max(total, 1) * n - 0.5).alias("slot"))
    hit = scratch.write(hit.unionByName(alone).withColumn("bucket", F.floor(F.col("slot") / _bucket(n)).cast("long")), "slots")
    # ranks within the source, in two levels
    counts = hit.groupBy("sid", "bucket").agg(F.count(F.lit(1)).alias("c"))
    earlier, every = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("sid")
    counts = counts.select("sid", "bucket", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"), F.sum("c").over(every).alias("n_slots"))
    nth = F.row_number().over(W.partitionBy("sid", "bucket").orderBy("slot"))
    return hit.withColumn("nth", nth).join(counts, ["sid", "bucket"]) \
        .select("sid", (F.col("base") + F.col("nth") - 1).alias("rank"), "n_slots", "slot")


def layout(sizes: DataFrame, sources: DataFrame, bucket_digits: int) -> DataFrame:
    """Every row with the words [start, start + size) it fills in its source's shuffled order."""
    d = sizes.join(sources.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))) \
        .drop("source_", "weight") \
        .withColumn("bucket", F.substring("turn", 1, bucket_digits))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    upto = W.partitionBy("sid", "bucket").orderBy("turn", "row").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("start", F.sum("size").over(upto) - F.col("size"))
    return d.join(sums, ["sid", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("base", "turn", "bucket")


def pieces(laid: DataFrame, n_slots: DataFrame) -> DataFrame:
    """Every row cut at block ends: words [first, first + words) of it, read for the ``epoch``-th time, lie in ``block`` of its source's stream.

    The stream has quota words in n_slots blocks, the first quota mod n_slots of which have a word more than the others. A row that
    the stream doesn't reach keeps one piece without block.
    """
    laid = laid.join(n_slots, "sid", "left").withColumns({
        "least": F.expr("coalesce(quota div n_slots, 1)"), "longer": F.expr("coalesce(quota % n_slots, 0)")})

    def block_of(word: str) -> str:
        return f"if({word} < longer * (least + 1), ({word}) div (least + 1), longer + ({word} - longer * (least + 1)) div least)"

    epochs = F.expr("if(size > 0 and n_slots > 0 and quota > start, sequence(0L, (quota - start - 1) div source_size), null)")
    cut = laid.withColumn("epoch", F.explode_outer(epochs)).withColumn("from", F.expr("epoch * source_size + start")) \
        .withColumn("to", F.expr("least(from + size, quota)"))
    cut = cut.withColumn("block", F.explode_outer(F.expr(f"if(epoch is null, null, sequence({block_of('from')}, {block_of('(to - 1)')}))")))
    begin = F.expr("block * least + least(block, longer)")
    cut = cut.withColumns({"begin": F.greatest("from", begin), "end": F.least("to", begin + F.expr("least + if(block < longer, 1, 0)"))})
    return cut.withColumns({"first": F.col("begin") - F.col("from"), "words": F.coalesce(F.col("end") - F.col("begin"), F.lit(0))}) \
        .drop("least", "longer", "begin", "end", "from", "to", "start", "n_slots")


def mix(docs: DataFrame, scratch: Scratch, text: str = "text", row: str | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix in pieces: one row per piece of a row and the slot that takes it (slot null: never taken)."""
    sizes = scratch.write(sized(docs, text, row), "sizes")
    sources = scratch.write(targets(sizes, scratch), "sources")
    schedule = scratch.write(slots(sources, scratch, block_words), "schedule")
    n_docs, digits = sizes.count(), 1
    while 16 ** digits < n_docs ** 0.5:
        digits += 1
    n_slots = schedule.groupBy("sid").agg(F.first("n_slots").alias("n_slots"))
    cut = pieces(layout(sizes, sources, digits), n_slots)
    return cut.join(schedule.select("sid", F.col("rank").alias("block"), "slot"), ["sid", "block"], "left")


def taken_words(mixed: DataFrame) -> DataFrame:
    """How many words of each row the slots take, repeats counted."""
    return mixed.groupBy("row", "doc_id", "sid", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(F.lit(0))).alias("taken"))


def _first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word."""
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), n.cast("string"), F.lit("}+"))
    return F.regexp_substr(text, pattern)


def apply_mix(docs: DataFrame, scratch: Scratch, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows in the order of the mix, once for every time the stream reads them; columns unchanged.

    A copy stands at the slot of its first piece. The last copy of a source, which its target cuts, ends with the
    last word taken (and has its n_chars, if there is such a column), so every source brings its target's words.
    """
    whole = scratch.write(docs.withColumn(_ROW, F.monotonically_increasing_id()), "docs")
    copies = mix(whole, scratch, text, _ROW, block_words).where("slot is not null").groupBy("row", "epoch").agg(
        F.min(F.struct("slot", "first")).alias("at"), F.sum("words").alias("words"), F.first("size").alias("size")) \
        .select(F.col("row").alias(_ROW), F.col("at.slot").alias("mix__slot"), F.col("epoch").alias("mix__epoch"),
                F.when(F.col("words") < F.col("size"), F.col("words")).alias("mix__words"))
    part = F.when(F.col("mix__words").isNotNull(), _first_words(F.col(text), F.col("mix__words"))).otherwise(F.col(text))
    out = whole.join(copies, _ROW).withColumn(text, part)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("mix__words").isNotNull(), F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.orderBy("mix__slot", "mix__epoch", _ROW).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return taken_words(mix(docs, Scratch(spark, "op8"))).select("doc_id", "size", "source_size", "target", "taken")
