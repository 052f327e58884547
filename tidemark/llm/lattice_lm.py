"""LM scoring: marginal likelihood of a text over all segmentations into subwords.

The pieces are those of an existing vocabulary file (never trained here). A text is written as
" word word ...": every word is preceded by a space, and pieces hold a space only in front.
The probability of a word is the sum over all its segmentations, taken by a forward
recursion in log space over its bytes. Single bytes are pieces, so any word has a segmentation.
Nothing but the pieces carries probability: a word has no edge of its own.

The vocabulary's own scores are ranks; a piece of rank r weighs 1 / (RANK_SHIFT + r), bytes a little. These weights are the
prior, worth PRIOR tokens in all, of the expected counts that all segmentations of the training words give each piece (words
weighted by how often they occur, EM_ROUNDS rounds). With the end token this is a proper distribution over texts:

    P(end)  = (training texts + 1) / (N + 2)
    P(word) = (1 - P(end)) * sum over segmentations of the product of P(piece)

Each distinct word is scored once, not once per occurrence. Words that make up at least
1 / HEAD of all tokens - at most HEAD words, by counting - are sent to the tasks; all other
words of a document are joined with the word table by key, none of which can be hot. Only
those word rows are shuffled, never texts. Words are joined by 64-bit hashes; the word table holds every word of
the corpus and shows whether two of them share one: then all are hashed anew, so counts and scores are exact.

Defined results: a null text is empty and has its end token only; a null doc_id is held out;
repeated rows each get a row. Very long texts are read in whole, a very long word in lattices of bounded size. Other columns are
ignored. An empty table gives no rows.
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
from .storage import Scratch, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 5, 1
HEAD = 1 << 21
COUNT_CHUNK = 8 << 20
EM_ROUNDS = 2
#: Distinct words that a task handles at once.
GATHERED = 120_000
#: Tokens that the vocabulary's own weights count for before any text is seen.
PRIOR = 100.0
RANK_SHIFT = 10.0
_LN10 = math.log(10)


def _polynomial(data: np.ndarray) -> np.uint64:
    """The hash that prefix sums give for these bytes anywhere in a word."""
    power, _ = T._power_tables(len(data) + 1)
    return ((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)]).sum(dtype=np.uint64)


class Pieces:
    """The vocabulary as byte strings, found by hash."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        sizes = np.array([len(p) for p in pieces])
        hashes = np.array([_polynomial(np.frombuffer(p, np.uint8)) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.log_p = hashes[order], order, log_p
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.longest = int(sizes.max())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are pieces, and these pieces' ids."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        ok = self.hashes[near] == hashes[at]
        return at[ok], self.ids[near[ok]]


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Byte strings of the vocabulary with first log probabilities (by rank)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): 1e-9 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " in raw[1:] or raw.translate(None, b"\t\n\x0b\x0c\r") != raw:
            continue
        weight[raw] = weight.get(raw, 0.0) + 1.0 / (RANK_SHIFT + min(1e6, -model.get_score(i)))
    pieces = list(weight)
    p = np.array([*weight.values()])
    return pieces, np.log(p / p.sum())


def _edges(pieces: Pieces, sums: np.ndarray, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    _, inverse = T._power_tables(i + k + 1)
    return pieces.find((sums[:, i + k] - sums[:, i]) * inverse[i])


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of one length: their places and the prefix sums of their bytes (with the space in front)."""
    data, offsets = T.utf8(words)
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for places in np.split(order, cuts):
        n = int(sizes[places[0]]) + 1 if len(places) else 0
        for part in np.array_split(places, max(1, len(places) * n // 400_000)):
            if not len(part):
                continue
            codes = np.full((len(part), n), 32, np.uint64)
            codes[:, 1:] = data[offsets[part][:, None] + np.arange(n - 1)]
            power, _ = T._power_tables(n + 1)
            sums = np.zeros((len(part), n + 1), np.uint64)
            np.cumsum((codes + np.uint64(1)) * power[:n], axis=1, out=sums[:, 1:])
            yield part, sums


def forward(pieces: Pieces, sums: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Log probability of every prefix of every word, and the lattice's edges."""
    m, n = sums.shape[0], sums.shape[1] - 1
    alpha = np.full((m, n + 1), -np.inf)
    alpha[:, 0] = 0.0
    edges = []
    for i in range(n):
        for k in range(1, min(pieces.longest, n - i) + 1):
            rows, ids = _edges(pieces, sums, i, k)
            if len(rows):
                edges.append((i, i + k, rows, ids))
                alpha[rows, i + k] = np.logaddexp(alpha[rows, i + k], alpha[rows, i] + pieces.log_p[ids])
    return alpha, edges


def expected_counts(pieces: Pieces, words: pa.Array, times: np.ndarray) -> np.ndarray:
    """How often each piece is used in all segmentations of the words, weighted by their probabilities and the words' counts."""
    total = np.zeros(len(pieces.log_p))
    for part, sums in _by_length(words):
        alpha, edges = forward(pieces, sums)
        n = alpha.shape[1] - 1
        beta = np.full(alpha.shape, -np.inf)
        beta[:, n] = 0.0
        used, shares = [], []
        for i, j, rows, ids in reversed(edges):
            through = pieces.log_p[ids] + beta[rows, j]
            beta[rows, i] = np.logaddexp(beta[rows, i], through)
            share = np.exp(alpha[rows, i] + through - alpha[rows, n]) * times[part[rows]]
            used.append(ids)
            shares.append(share)
        total += np.bincount(np.concatenate(used), np.concatenate(shares), len(total))
    return total


def word_scores(pieces: Pieces, words: pa.Array) -> np.ndarray:
    """Log of the marginal probability of every word over the pieces."""
    out = np.empty(len(words))
    for part, sums in _by_length(words):
        out[part] = forward(pieces, sums)[0][:, -1]
    return out


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    low = T.LOWER[data]
    return low, *T.tokens(T.NOT_SPACE[low], offsets)


def _words_array(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow array (every second piece of the buffer cut at all word ends)."""
    if not len(starts):
        return pa.array([], pa.string())
    cuts = np.empty(2 * len(starts), np.int32)
    cuts[0::2], cuts[1::2] = starts, ends
    tiles = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(low)))
    return tiles.take(pa.array(np.arange(0, len(cuts) - 1, 2)))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trained = ~np.asarray(batch.column(0), dtype=bool)
        for lo, hi, data, offsets in T.chunks(*T.utf8(batch.column(1)), COUNT_CHUNK):
            low, starts, ends, first = _split(data, offsets)
            coded = _words_array(low, starts, ends).dictionary_encode()
            codes = np.asarray(coded.indices)
            n = len(coded.dictionary)
            use = np.repeat(trained[lo:hi], np.diff(first)).astype(float)
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary, pa.array(np.bincount(codes, use, n).astype(np.int64)),
                 pa.array(np.bincount(codes, minlength=n).astype(np.int64))], ["word", "c", "c_all"])


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (in training texts) and c_all of every distinct word; docs has held_out and text."""
    return docs.select("held_out", "text").mapInArrow(_count_batches, "word string, c long, c_all long") \
        .groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches, so that words of one length come in numbers."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _em_batches(model: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = model.value, None
        for batch in _gathered(batches):
            part = expected_counts(pieces, batch.column(0), np.asarray(batch.column(1), dtype=float))
            total = part if total is None else total + part
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["piece", "n"])
    return run


def fit(counts: DataFrame, vocabulary: str, rounds: int) -> Pieces:
    """Piece probabilities fitted to the training words; the driver gathers one number per piece."""
    names, log_p = load_pieces(vocabulary)
    pieces, prior = Pieces(names, log_p), PRIOR * np.exp(log_p)
    train = counts.where("c > 0").select("word", "c")
    for _ in range(rounds):
        model = train.sparkSession.sparkContext.broadcast(pieces)
        rows = train.mapInArrow(_em_batches(model), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = prior.copy()
        for piece, x in rows:
            n[piece] += x
        pieces.log_p = np.log(n / n.sum())
        model.unpersist()
    return pieces


def _scored_batches(model: Broadcast, seed: int, log_word: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            data, offsets = T.utf8(batch.column(0))
            hashes = T.token_hashes(data, offsets[:-1], offsets[1:], seed)
            log_p = log_word + word_scores(model.value, batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.astype(np.int64)), batch.column(1), batch.column(2),
                 pa.array(log_p / _LN10)], ["hash", "c", "c_all", "log10_p"])
    return run


_PART = "row_id long, doc_id long, held_out boolean, tail boolean, hash long, tf long, n_tokens long, n_known long, base double, score double"


def _doc_batches(head: Broadcast, end: tuple[int, float, float], total: float, seed: int) -> Callable:
    """Per row: one marker row with the sums over its head words, and one row per other distinct word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, log_p = head.value
        base_of = np.log10(counts + 0.5) - math.log10(total)
        for batch in batches:
            for lo, hi, data, offsets in T.chunks(*T.utf8(batch.column(3))):
                n = hi - lo
                low, starts, ends, first = _split(data, offsets)
                hashes = T.token_hashes(low, starts, ends, seed)
                row = np.repeat(np.arange(n), np.diff(first))
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                at, in_head = at[hit], row[hit]
                sums = [np.bincount(in_head, x[at], n) for x in ((counts > 0).astype(float), base_of, log_p)]
                order = np.lexsort((hashes[~hit], row[~hit]))
                t_row, t_hash = row[~hit][order], hashes[~hit][order]
                new = np.ones(len(t_row), bool)
                new[1:] = (t_row[1:] != t_row[:-1]) | (t_hash[1:] != t_hash[:-1])
                tf = np.diff(np.append(np.flatnonzero(new), len(t_row)))
                t_row, t_hash = t_row[new], t_hash[new]
                ids = np.asarray(batch.column(0).slice(lo, n), dtype=np.int64)
                take = pa.array(np.concatenate((np.arange(lo, hi), lo + t_row)))
                m = len(t_row)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
                    pa.array(np.arange(n + m) >= n),
                    pa.array(np.concatenate((T.mix(ids.astype(np.uint64)), t_hash)).astype(np.int64)),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(tf.astype(np.int64))]),
                    pa.concat_arrays([pa.array(np.diff(first) + 1), none]),
                    pa.concat_arrays([pa.array(sums[0].astype(np.int64) + (end[0] > 0)), none]),
                    pa.concat_arrays([pa.array(sums[1] + end[1]), pa.nulls(m, pa.float64())]),
                    pa.concat_arrays([pa.array(sums[2] + end[2]), pa.nulls(m, pa.float64())]),
                ], ["row_id", "doc_id", "held_out", "tail", "hash", "tf", "n_tokens", "n_known", "base", "score"])
    return run


def score_documents(docs: DataFrame, scratch: Scratch, text: str = "text", vocabulary: str = VOCABULARY,
                    rounds: int = EM_ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    spark = docs.sparkSession
    fold = F.crc32(docs["doc_id"].cast("string").cast("binary")) % FOLDS
    docs = docs.select(F.monotonically_increasing_id().alias("row_id"), docs["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(fold == HELD_OUT, F.lit(True)).alias("held_out"), docs[text].cast("string").alias("text"))
    counts = scratch.write(word_counts(docs), "counts")
    n_train = docs.where(~F.col("held_out")).count()
    words, types, every = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)),
                                     F.coalesce(F.sum("c_all"), F.lit(0))).first()
    train_tokens, distinct = words + n_train, types + (n_train > 0)
    total = train_tokens + 0.5 * (distinct + 1)
    pieces = fit(counts, vocabulary, rounds)

    model, seed = spark.sparkContext.broadcast(pieces), 0
    log_word = math.log((train_tokens - n_train + 1) / (train_tokens + 2))
    while True:
        scored = scratch.write(counts.mapInArrow(_scored_batches(model, seed, log_word), "hash long, c long, c_all long, log10_p double"), f"words{seed}")
        if scored.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
        scratch.drop(f"words{seed}")
        seed += 1
    scratch.drop("counts")
    head = scored.where(F.col("c_all") * HEAD >= every).select("hash", "c", "log10_p").toArrow()
    known = np.asarray(head["hash"]).astype(np.uint64)
    order = np.argsort(known)
    top = spark.sparkContext.broadcast(
        (known[order], np.asarray(head["c"])[order].astype(float), np.asarray(head["log10_p"])[order]))
    end = (n_train, math.log10((n_train + 0.5) / total), math.log10((n_train + 1) / (train_tokens + 2)))
    parts = docs.mapInArrow(_doc_batches(top, end, total, seed), _PART)
    tail = scored.where(F.col("c_all") * HEAD < every).select(F.lit(True).alias("tail"), "hash", "c", "log10_p")
    j = parts.join(tail, ["tail", "hash"], "left")
    tf = F.coalesce("tf", F.lit(0))
    return j.groupBy("row_id", "doc_id", "held_out").agg(
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(F.col("tail"), F.when(F.col("c") > 0, tf).otherwise(0)).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(F.col("tail"), tf * F.log10((F.col("c") + 0.5) / total)).otherwise(F.col("base"))).alias("base_score"),
        F.sum(F.when(F.col("tail"), tf * F.col("log10_p")).otherwise(F.col("score"))).alias("score"),
    ).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
             "base_score", "score")


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
