"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct 3-word shingles (64-bit hashes). Documents with equal sets
form a class and are compared through one row only. A class has a signature of
b-bit MinHash values (16 bits each), split into chunks of PLACES; two signatures that differ in
at most 2 * chunks - 1 places have, by pigeonhole, a chunk with at most one difference, and
so agree on one of the chunk's keys that leave one place out. Joining these keys therefore finds
every pair under that distance. The number of chunks follows from the similarity asked
for: so many that at most MISSED of the pairs exactly at it are further apart (11 chunks at
0.85). Links are confirmed on the full sets of both texts.

No bucket is expanded into all its pairs. First every member of a bucket is compared with the
bucket's smallest id only (in blocks; repeated over the blocks' survivors if a bucket is larger
than a block). After these links are confirmed and joined into components, the remaining pairs
of a bucket are those between different components; they are all compared, block by block, so no link
between different texts is lost. Most of them are near misses, so these tasks also hold a bit set
of each member's shingles: what one bit set has and the other lacks bounds the common
shingles from above, and only pairs that may reach the similarity leave the task. What one task
holds is at most two blocks.

Rows are told apart by a row id, which is written with their features before anything else. Texts are neither written nor
shuffled: the sets that a confirmation needs are made from the texts again, found by hash and checked by digest. The row of a component that is kept is the one with the smallest
doc_id, rows without doc_id last; component_id is its doc_id.

Defined results: a null text or one without words has an empty set, is linked with nothing and
kept; with one or two words, the sequence is the only shingle; rows that repeat a doc_id, or have none,
are rows like others, so one row of each component is kept whatever the ids, and components may
share a component_id or have null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .components import components
from .membership import bit_table, may_contain
from .storage import Scratch, table

SHINGLE = 3
SIMILARITY_PERCENT = 85
PLACES = 5
MISSED = 1e-5
BLOCK = 2048


def chunks_for(percent: int, missed: float = MISSED) -> int:
    """Fewest chunks for which pairs at this similarity are beyond the signature threshold that rarely."""
    p = percent / 100
    for chunks in range(2, 100):
        n = chunks * PLACES
        if sum(math.comb(n, k) * (1 - p) ** k * p ** (n - k) for k in range(2 * chunks, n + 1)) <= missed:
            return chunks
    raise ValueError(f"no signature of {n} places covers a similarity of {percent} %")


def min_linked(percent: int) -> int:
    """Shingles that the smaller of two different linked sets has at least, plus one."""
    return math.ceil(percent / (100 - percent)) if percent < 100 else 1 << 62


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, end to end, and where each row's begin."""
    low = T.LOWER[data]
    starts, ends, first = T.tokens(T.NOT_SPACE[low], offsets)
    words = T.token_hashes(low, starts, ends)
    grams = T.gram_hashes(words, k)
    sets, at = [], np.zeros(len(offsets), np.int64)
    for r in range(len(offsets) - 1):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= k:
            s = np.sort(grams[a:b - k + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            s = T.gram_hashes(words[a:b], b - a) if b > a else grams[:0]
        sets.append(s)
        at[r + 1] = at[r] + len(s)
    return (np.concatenate(sets) if sets else grams[:0]), at


def signatures(values: np.ndarray, at: np.ndarray, places: int) -> np.ndarray:
    """One row of 16-bit values, one per place, for every set (none may be empty)."""
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, places), np.uint16)
    multipliers = (T.mix(np.arange(1, places + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for j, m in enumerate(multipliers):
        least = np.minimum.reduceat(low * m + high, at[:-1])
        out[:, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def digests(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit digest (two numbers) of every set; the order of a set's values doesn't matter."""
    n = np.diff(at)
    some = n > 0
    d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if some.any():
        starts = at[:-1][some]
        d1[some] = np.add.reduceat(T.mix(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
        d2[some] = np.add.reduceat(T.mix(values + np.uint64(0x14057B7EF767814F)), starts)
    return n, d1.astype(np.int64), d2.astype(np.int64)


def _feature_batches(k: int, percent: int, chunks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in T.chunks(*T.utf8(batch.column(1))):
                values, at = shingle_sets(data, offsets, k)
                n, d1, d2 = digests(values, at)
                some = n > 0
                sigs: list[bytes | None] = [None] * (hi - lo)
                if some.any():
                    rows = signatures(values, np.concatenate((at[:-1][some], at[-1:])), chunks * PLACES)
                    for r, sig in zip(np.flatnonzero(some), rows):
                        if n[r] >= min_linked(percent):
                            sigs[r] = sig.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in (0, 2, 3)], pa.array(n), pa.array(d1), pa.array(d2),
                     pa.array(sigs, pa.binary())], ["row", "doc_id", "text_hash", "n_shingles", "d1", "d2", "sig"])
    return run


def features(rows: DataFrame, k: int = SHINGLE, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """row, doc_id, a hash of the text, n_shingles, a 128-bit digest of the set, and its signature if another set can be similar to it."""
    return rows.select("row", "text", "doc_id", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _feature_batches(k, percent, chunks_for(percent)), "row long, doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sig binary")


def _key_batches(chunks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, chunks, PLACES).astype(np.uint64)
            for c in range(chunks):
                for v in range(PLACES):
                    key = np.zeros(len(reps), np.uint64)
                    for p in range(PLACES):
                        if p != v:
                            key = (key << np.uint64(16)) | sig[:, c, p]
                    tag = c * PLACES + v
                    key = T.mix(T.mix(key) + np.uint64(tag + 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.astype(np.int64)), pa.array(np.full(len(reps), tag, np.int16)), reps], ["key", "tag", "rep"])
    return run


#: Bits of a bit set per shingle, before rounding up to a power of two.
SET_BITS = 8


def bit_set(values: np.ndarray) -> np.ndarray:
    """The values' hashes as a bit set of a power of two of bits, as 64-bit words."""
    bits = max(512, 1 << (SET_BITS * len(values) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(T.mix(values) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def _half(words: np.ndarray) -> np.ndarray:
    """The same set with half the bits."""
    return words[:len(words) // 2] | words[len(words) // 2:]


def most_common(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> int:
    """At least the number of common shingles of two sets with these bit sets and sizes."""
    while len(a) > len(b):
        a = _half(a)
    while len(b) > len(a):
        b = _half(b)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def _fitting(cols: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of places have fitting set sizes and different components."""
    n = cols["n"]
    return (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (cols["comp"][i] != cols["comp"][j])


def _close_pairs(cols: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which fitting pairs have signatures under the distance threshold, this key as their first in common, and bit
    sets that allow the similarity."""
    out = np.zeros(len(i), bool)
    n, chunks = cols["n"], cols["sig"].shape[1] // PLACES
    fit = _fitting(cols, i, j, percent)
    for part in np.array_split(np.flatnonzero(fit), max(1, fit.sum() // 20_000)):
        differ = cols["sig"][i[part]] != cols["sig"][j[part]]
        near = differ.sum(1) < 2 * chunks
        if near.any():  # a pair belongs to the first key it has in common
            by_chunk = differ[near].reshape(-1, chunks, PLACES)
            wrong = by_chunk.sum(2)
            chunk = (wrong <= 1).argmax(1)
            rows = np.arange(len(chunk))
            place = np.where(wrong[rows, chunk] == 0, 0, by_chunk[rows, chunk].argmax(1))
            near[near] = chunk * PLACES + place == cols["tag"][i[part[near]]]
            for x in np.flatnonzero(near):
                a, b = i[part[x]], j[part[x]]
                both = most_common(cols["bits"][a], cols["bits"][b], n[a], n[b])
                near[x] = 100 * both >= percent * (n[a] + n[b] - both)
        out[part] = near
    return out


def _grouped(batches: Iterator[pa.RecordBatch], columns: Callable) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole groups, from rows sorted by group (a bucket's block, or two blocks)."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns(batch)
        now["group"] = T.mix(T.mix(now["key"].astype(np.uint64)) + (now["bi"].astype(np.uint64) << np.uint64(32)) + now["bj"].astype(np.uint64))
        if held and held[-1]["group"][-1] != now["group"][-1] or now["group"][0] != now["group"][-1]:
            cut = int(np.flatnonzero(now["group"] != now["group"][-1])[-1]) + 1 if now["group"][0] != now["group"][-1] else 0
            held.append({k: v[:cut] for k, v in now.items()})
            yield {k: np.concatenate([h[k] for h in held]) for k in now}
            held = []
            now = {k: v[cut:] for k, v in now.items()}
        held.append(now)
    if held:
        yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}


def _emit(cols: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    a, b = cols["rep"][i], cols["rep"][j]
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


_PLACE = ("key", "bi", "bj", "rep", "n", "comp")


def _first_batches(percent: int) -> Callable:
    """Pairs (a, b) of each member of a block and the smallest id in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _grouped(batches, lambda batch: {f: batch.column(f).to_numpy() for f in _PLACE}):
            group = cols["group"]
            if not len(group):
                continue
            begins = np.concatenate(([True], group[1:] != group[:-1]))
            j = np.flatnonzero(~begins)
            i = np.flatnonzero(begins)[np.cumsum(begins) - 1][j]
            ok = _fitting(cols, i, j, percent)
            yield from _emit(cols, i[ok], j[ok])
    return run


def _all_batches(percent: int) -> Callable:
    """Pairs (a, b) of all members of two blocks that are in different components."""
    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        c = {f: batch.column(f).to_numpy() for f in (*_PLACE, "tag", "blk")}
        c["bits"] = np.empty(batch.num_rows, object)
        c["bits"][:] = [np.frombuffer(x, np.uint64) for x in batch.column("bits").to_pylist()]
        c["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        return c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _grouped(batches, columns):
            size, group = len(cols["rep"]), cols["group"]
            if not size:
                continue
            begins = np.concatenate(([True], group[1:] != group[:-1]))
            place = np.arange(size)
            ends = np.append(np.flatnonzero(begins)[1:], size)[np.cumsum(begins) - 1]
            same_block = cols["bi"] == cols["bj"]
            for lag in range(1, size):
                place = place[place + lag < ends[place]]
                if not len(place):
                    break
                i, j = place, place + lag
                ok = same_block[i] | (cols["blk"][i] != cols["blk"][j])
                i, j = i[ok], j[ok]
                ok = _close_pairs(cols, i, j, percent)
                yield from _emit(cols, i[ok], j[ok])
    return run


def _blocks(members: DataFrame) -> tuple[DataFrame, F.Column]:
    """Members with their block of at most about BLOCK, and their bucket's number of blocks."""
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    return members.withColumn("blk", F.pmod(F.xxhash64("rep"), n_blocks.cast("long")).cast("int")), n_blocks


def first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of fitting sizes of each member of a bucket's block and the block's smallest id."""
    m, _ = _blocks(members)
    dealt = m.withColumns({"bi": F.col("blk"), "bj": F.col("blk")}).select(*_PLACE) \
        .repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")
    return dealt.mapInArrow(_first_batches(percent), "a long, b long").distinct()


def all_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs under the signature threshold of a bucket's members in different components; members carry sig and bits."""
    m, n_blocks = _blocks(members)
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1))) \
        .withColumns({"bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")}).drop("other")
    dealt = m.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")
    return dealt.select(*_PLACE, "tag", "blk", "sig", "bits").mapInArrow(_all_batches(percent), "a long, b long").distinct()


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = [np.frombuffer(b"".join(batch.column(f).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for f in ("x", "y")]
            yield batch.filter(pa.array((x != y).sum(1) < 2 * (x.shape[1] // PLACES))).select(["a", "b"])


def near_signatures(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs whose signatures are under the distance threshold."""
    return pairs.join(signed.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a") \
        .join(signed.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b") \
        .select("a", "b", "x", "y").mapInArrow(_near_batches, "a long, b long")


def _set_batches(bits: Broadcast, k: int) -> Callable:
    """Sets of the texts whose hash may be asked for, once per text and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            hashes = batch.column(1).to_numpy()
            first = np.zeros(len(hashes), bool)
            for i in np.flatnonzero(may_contain(bits.value, hashes.astype(np.uint64))):
                if int(hashes[i]) not in seen:
                    seen.add(int(hashes[i]))
                    first[i] = True
            part = batch.filter(pa.array(first))
            for lo, hi, data, offsets in T.chunks(*T.utf8(part.column(0))):
                values, at = shingle_sets(data, offsets, k)
                n, d1, d2 = digests(values, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n), pa.array(d1), pa.array(d2), T.binary_array([values[at[r]:at[r + 1]] for r in range(hi - lo)])],
                    ["n_shingles", "d1", "d2", "shingles"])
    return run


def _confirm_batches(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 1])
    return run


def _bit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [bit_set(np.frombuffer(x, np.uint64)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), T.binary_array(bits)], ["row", "bits"])


def sets_of(rows: DataFrame, classes: DataFrame, ids: DataFrame, scratch: Scratch, name: str, k: int) -> DataFrame:
    """row (the class's ``rep``) and full shingle set of the classes whose rep is in ``ids`` (column id).

    The sets are made from the texts again: a text whose hash is that of an asked class's first text is a hit, and a hit
    whose digest is the class's has its set. So no text is written or shuffled.
    """
    asked = scratch.write(classes.join(ids, F.col("rep") == F.col("id"), "left_semi")
                          .select("rep", "n_shingles", "d1", "d2", F.col("first")["text_hash"].alias("text_hash")), f"{name}-asked")
    bits = rows.sparkSession.sparkContext.broadcast(bit_table(asked, F.col("text_hash")))
    found = rows.select("text", F.xxhash64("text").alias("text_hash")) \
        .mapInArrow(_set_batches(bits, k), "n_shingles long, d1 long, d2 long, shingles binary") \
        .groupBy("n_shingles", "d1", "d2").agg(F.first("shingles").alias("shingles"))
    sets = found.join(asked.drop("text_hash"), ["n_shingles", "d1", "d2"]).select(F.col("rep").alias("row"), "shingles")
    out = scratch.write(sets, name)
    scratch.drop(f"{name}-asked")
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a") \
        .join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
    return scratch.write(both.select("a", "b", "x", "y").mapInArrow(_confirm_batches(percent), "a long, b long"), name)


def near_duplicates(docs: DataFrame, scratch: Scratch, text: str = "text", k: int = SHINGLE,
                    percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
                       docs[text].cast("string").alias("text"))
    return judged(rows, scratch, k, percent).drop("row")


def judged(rows: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, component_id and kept of every row of a table of row, doc_id and text.

    ``row`` is read once, with the features that are written; later reads of ``rows`` use texts only.
    """
    found = scratch.write(features(rows, k, percent), "features")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_hash")
    classes = found.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2") \
        .agg(F.min(first).alias("first"), F.first("sig").alias("sig"))
    classes = scratch.write(classes.withColumn("rep", F.col("first")["row"]), "classes")
    signed = classes.where("sig is not null").select("rep", F.col("n_shingles").alias("n"), "sig")
    keys = signed.select("rep", "sig").mapInArrow(_key_batches(chunks_for(percent)), "key long, tag short, rep long")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.write(keys.join(sizes, "key").join(signed.select("rep", "n"), "rep"), "members")

    links, labels = None, None
    largest = members.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    for step in range(max(1, math.ceil(math.log(max(largest, 2), BLOCK)))):
        if labels is None:
            m = members.withColumn("comp", F.col("rep"))
        else:  # one member of each component in a bucket stands for it
            m = _labelled(members, labels)
            m = m.groupBy("key", "tag", "comp").agg(F.min_by(F.struct("rep", "n"), "rep").alias("r")) \
                .select("key", "tag", "comp", "r.*")
            m = m.join(m.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "key")
        pairs = scratch.write(near_signatures(first_pairs(m, percent), signed), "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        more = confirmed(pairs, sets_of(rows, classes, ids, scratch, "sets", k), scratch, f"links{step}", percent)
        scratch.drop("pairs", "sets")
        links = more if links is None else links.unionByName(more)
        labels = components(links, scratch, f"labels{step}")
    mixed = _labelled(members, labels)
    open_keys = mixed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = scratch.write(mixed.join(open_keys, "key", "left_semi"), "open")
    scratch.drop("members")
    sets = sets_of(rows, classes, rest.select(F.col("rep").alias("id")).distinct(), scratch, "sets", k)
    bits = sets.mapInArrow(_bit_batches, "row long, bits binary").withColumnRenamed("row", "rep")
    known = bits.join(signed.select("rep", "sig"), "rep")
    rest = all_pairs(rest.join(known, "rep"), percent)
    links = links.unionByName(confirmed(rest, sets, scratch, "links", percent))
    labels = components(links, scratch, "labels")
    scratch.drop("open", "sets")

    by_set = scratch.write(classes.join(labels, F.col("rep") == F.col("node"), "left")
                           .select("n_shingles", "d1", "d2", "first", F.coalesce("label", "rep").alias("label")), "by_set")
    keepers = scratch.write(by_set.groupBy("label").agg(F.min("first").alias("keeper")), "keepers")
    by_set = by_set.drop("first").join(keepers, "label").select("n_shingles", "d1", "d2", "keeper")
    out = found.where("n_shingles > 0").drop("sig", "text_hash").join(by_set, ["n_shingles", "d1", "d2"]) \
        .select("row", "doc_id", "n_shingles", F.col("keeper")["doc_id"].alias("component_id"),
                (F.col("row") == F.col("keeper")["row"]).alias("kept"))
    alone = found.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"),
                                                 F.lit(True).alias("kept"))
    return out.unionByName(alone)


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, F.col("rep") == F.col("node"), "left") \
        .withColumn("comp", F.coalesce("label", "rep")).drop("node", "label")


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One row of each group of near-duplicates (that with the smallest doc_id), columns unchanged."""
    whole = scratch.write(docs.withColumn("neardup__row", F.monotonically_increasing_id()), "rows")
    rows = whole.select(F.col("neardup__row").alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kept = judged(rows, scratch, k, percent).where("kept").select(F.col("row").alias("neardup__row"))
    return whole.join(kept, "neardup__row", "left_semi").select(*docs.columns)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over 3-word shingles at 85 %; a row is kept if its doc_id is its component's."""
    out = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
