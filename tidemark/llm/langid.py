"""Language identification of mixed-language text: script ranges, per-word scores, Viterbi.

Words are runs of letters. The script of a word's first letter narrows its candidate languages to
those that were seen with this script in training; each candidate gets the sum of its
smoothed log probabilities of the word's letter trigrams. A Viterbi pass over a text's words
pays SWITCH for every change of language, so that spans get a label each and a stray
foreign word doesn't. The language of most words is the text's.

The model is counts of hashed trigrams by label (BUCKETS per language, whatever the corpus),
taken over all labelled training documents; lang is read there only. Texts are labelled
where they are read, without a shuffle, many texts at a time, step by step over their words.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is every text
if there are no labelled training documents; a null doc_id is held out; repeated rows each get a
row; ties go to the first label in code-point order. Very long texts are labelled in whole. Labels beyond the MAX_LABELS with most
training text (dirty ones, say) aren't learned. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .storage import table

FOLDS, HELD_OUT = 5, 0
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Nats that a change of language costs.
SWITCH = 15.0
#: A language is a candidate for a script that makes up this share of its letters.
SCRIPT_SHARE = 0.001
NOT_A_CANDIDATE = -60.0
CHUNK = 6 << 20
UNKNOWN = "und"
#: Languages of a model, at most: those with most training text. It bounds what is gathered and sent to the tasks (65,536 values each).
MAX_LABELS = 256

#: First code point of each range and the script it begins (0: other).
SCRIPTS = [(0x0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8),
           (0xA00, 9), (0xB80, 10), (0xC00, 11), (0xE00, 12), (0xE80, 0), (0x10A0, 13), (0x1100, 14), (0x1200, 15),
           (0x1380, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 16), (0x3100, 0), (0x3130, 14), (0x3190, 0),
           (0x3400, 17), (0xA000, 0), (0xAC00, 14), (0xD7B0, 0), (0xF900, 17), (0xFB00, 0), (0x20000, 17), (0x30000, 0)]
N_SCRIPTS = 18
_SCRIPT_FROM = np.array([a for a, _ in SCRIPTS])
_SCRIPT_OF = np.array([b for _, b in SCRIPTS])


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower case (itself if that is longer)."""
    is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(is_letter):
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return is_letter, lower


class Words:
    """The words of a run of rows: code-point places, trigram buckets and scripts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        is_letter, lower = _letters()
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begins = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        self.row_at = begins[offsets]
        letter = is_letter[codes]
        self.starts, self.ends, self.first = T.tokens(letter, self.row_at)
        at = np.flatnonzero(letter)
        self.word_at = np.searchsorted(at, self.starts)
        low = lower[codes[at]]
        before, after = np.zeros_like(low), np.zeros_like(low)
        before[1:], after[:-1] = low[:-1], low[1:]
        before[self.word_at] = 0
        after[np.append(self.word_at[1:], len(at))[: len(self.word_at)] - 1] = 0
        h = (before * np.uint32(0x9E3779B1)) ^ (low * np.uint32(0x85EBCA6B)) ^ (after * np.uint32(0xC2B2AE35))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        self.buckets = (h >> np.uint32(16)).astype(np.int32)
        self.scripts = _SCRIPT_OF[np.searchsorted(_SCRIPT_FROM, low[self.word_at], "right") - 1]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by label; a word's letters are also counted under bucket -1 - script."""
    for batch in batches:
        labels = batch.column(0).dictionary_encode()
        of_row, names = np.asarray(labels.indices), labels.dictionary.to_pylist()
        for lo, hi, data, offsets in T.chunks(*T.utf8(batch.column(1)), CHUNK):
            w = Words(data, offsets)
            if not len(w.starts):
                continue
            label = np.repeat(of_row[lo:hi], np.diff(w.first))
            sizes = w.ends - w.starts
            for k in np.unique(label):
                mine = label == k
                n = np.bincount(w.buckets[np.repeat(mine, sizes)], minlength=BUCKETS)
                some = np.flatnonzero(n)
                s = np.bincount(w.scripts[mine], sizes[mine], N_SCRIPTS)
                seen = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k]] * (len(some) + len(seen)), pa.string()),
                     pa.array(np.concatenate((some, -1 - seen)).astype(np.int32)),
                     pa.array(np.concatenate((n[some], s[seen])).astype(np.int64))], ["lang", "bucket", "n"])


class Model:
    def __init__(self, rows: pa.Table):
        names = np.asarray(rows["lang"].to_pylist(), dtype=object)
        self.labels = sorted(set(names))
        of = {x: i for i, x in enumerate(self.labels)}
        label = np.array([of[x] for x in names], np.int64)
        bucket, n = np.asarray(rows["bucket"]), np.asarray(rows["n"]).astype(float)
        counts = np.zeros((len(self.labels), BUCKETS))
        scripts = np.zeros((len(self.labels), N_SCRIPTS))
        grams = bucket >= 0
        counts[label[grams], bucket[grams]] = n[grams]
        scripts[label[~grams], -1 - bucket[~grams]] = n[~grams]
        log_p = np.log(counts + SMOOTHING) - np.log(counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
        self.log_p = log_p.astype(np.float32)
        share = scripts / np.maximum(1.0, scripts.sum(1, keepdims=True))
        seen = share >= SCRIPT_SHARE
        self.penalty = np.where(seen | ~seen.any(0), 0.0, NOT_A_CANDIDATE).T.astype(np.float32)  # [script, label]
        self.unseen = ~seen.any(0)

    def word_scores(self, w: Words) -> np.ndarray:
        out = np.empty((len(w.starts), len(self.labels)), np.float32)
        for k, log_p in enumerate(self.log_p):
            out[:, k] = np.add.reduceat(log_p[w.buckets], w.word_at)
        out += self.penalty[w.scripts]
        out[self.unseen[w.scripts]] = 0.0  # no language was seen with this script: no evidence
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word; rows are runs of words [first[r], first[r + 1])."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = first[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")  # rows with more than t words
    path = np.zeros(len(scores), np.int16)
    if not steps:
        return path
    best = scores[begins[:active[0]]].astype(np.float64)
    back = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(1, steps):
        m = active[t]
        v = best[:m]
        top = v.max(1) - switch
        back[begins[:m] + t] = np.where(v >= top[:, None], own, v.argmax(1)[:, None])
        best[:m] = np.maximum(v, top[:, None]) + scores[begins[:m] + t]
    state = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        words = begins[:m] + t
        path[words] = state[:m]
        state[:m] = back[words, state[:m]] if t else state[:m]
    return path


def _label_batches(model: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for lo, hi, data, offsets in T.chunks(*T.utf8(batch.column(2)), CHUNK):
                n = hi - lo
                langs, share, spans = [UNKNOWN] * n, np.zeros(n), [""] * n
                w = Words(data, offsets) if m.labels else None
                if w is not None and len(w.starts):
                    path = viterbi(m.word_scores(w), w.first)
                    sizes = np.diff(w.first)
                    row = np.repeat(np.arange(n), sizes)
                    votes = np.bincount(row * len(m.labels) + path, minlength=n * len(m.labels)).reshape(n, -1)
                    winner = votes.argmax(1)
                    share = votes.max(1) / np.maximum(1, sizes)
                    turn = np.ones(len(path), bool)
                    turn[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
                    a = np.flatnonzero(turn)
                    b = np.append(a[1:], len(path)) - 1
                    listed: list[list[str]] = [[] for _ in range(n)]
                    for i, j in zip(a, b):
                        at = w.row_at[row[i]]
                        listed[row[i]].append(f"{w.starts[i] - at}:{w.ends[j] - at}:{m.labels[path[i]]}")
                    for r in np.flatnonzero(sizes):
                        langs[r], spans[r] = m.labels[winner[r]], ",".join(listed[r])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(langs, pa.string()),
                     pa.array(share), pa.array(spans, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "spans"])
    return run


def train(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """A model of the rows given; what the driver gathers is at most BUCKETS + 18 counts for each of MAX_LABELS labels."""
    known = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    largest = known.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).orderBy(F.desc_nulls_last("n"), "lang").limit(MAX_LABELS)
    names = [r["lang"] for r in largest.collect()]
    rows = known.where(F.col("lang").isin(names)) \
        .mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(rows.toArrow())


def identify(docs: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of words in that language) and labelled spans of every row."""
    fold = F.crc32(docs["doc_id"].cast("string").cast("binary")) % FOLDS
    docs = docs.withColumn("held__out", F.coalesce(fold == HELD_OUT, F.lit(True)))
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where(~F.col("held__out")), text, label))
    return docs.select(docs["doc_id"].cast("long"), "held__out", docs[text].cast("string")).mapInArrow(
        _label_batches(model), "doc_id long, held_out boolean, lang_pred string, score double, spans string")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
