"""Token-ID output: best-fit-decreasing packing into rows of fixed length.

Texts become ids of an existing byte-level vocabulary, each text closed by an end id. A text longer
than a row is cut into segments; all segments are placed largest first into the open row with
the least room that still fits, found in a segment tree over the amounts of room. A row holds its
ids, the cumulative lengths of its segments and the places where positions restart.

Packing goes on where the texts are read: a task packs about WINDOW_TOKENS ids at a time, so
memory is bounded, nothing is shuffled and a lost task is redone from its own input. Pieces of
text are looked up rather than encoded again: a batch is cut into pieces on its byte buffer
and Arrow's dictionary encoding leaves each distinct piece to be encoded once.

Defined results: a null or empty text is its end id alone; repeated rows are packed each on its
own (``rows`` tells them apart); a null doc_id stays null in ``doc_ids``. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .storage import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
ROW_TOKENS = 2048
WINDOW_TOKENS = 4 << 20
CHUNK = 6 << 20
CACHE = 1 << 20

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    import unicodedata

    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                 (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a:b + 1] = _SPACE
    return out


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def piece_starts(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the pieces of PATTERN begin in a run of code points; rows begin at ``rows`` (ends included)."""
    n = len(codes)
    kind = _classes()[codes]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[rows] = True
    runs = np.flatnonzero(cut[:n])
    ends = np.append(runs[1:], n)
    is_row_end = np.zeros(n + 1, bool)
    is_row_end[rows] = True
    # a run of white space before other characters of the row leaves its last one to them:
    # a blank joins the next piece, any other is a piece of its own
    space = (kind[runs] == _SPACE) & ~is_row_end[ends]
    last = ends[space] - 1
    blank = codes[last] == 32
    starts = cut[:n].copy()
    starts[last] = True
    starts[last[blank] + 1] = False
    # a lone apostrophe that no blank precedes takes the letters of a contraction
    quote = runs[(codes[runs] == 39) & (ends - runs == 1)]
    quote = quote[starts[quote] & (quote + 1 < n)]
    quote = quote[~is_row_end[quote + 1]]
    for size, words in ((1, "s t m d"), (2, "re ve ll")):
        at = quote[quote + size < n]
        for word in words.split():
            ok = np.ones(len(at), bool)
            for j, c in enumerate(word):
                ok &= (codes[at + 1 + j] == ord(c)) & ~is_row_end[at + 1 + j]
            hit = at[ok]
            starts[hit + 1] = False
            after = hit + 1 + size
            after = after[(after < n)]
            starts[after[~is_row_end[after] & (kind[after] == _LETTER)]] = True
    return np.flatnonzero(starts)


class Tokenizer:
    """Ids of whole batches; distinct pieces are encoded once and remembered up to CACHE pieces."""

    def __init__(self, path: str):
        self.encode = _encoder(path)._encode_single_piece
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint16), 0
        self.begin, self.size = [], []

    def _place(self, piece: bytes) -> int:
        ids = self.encode(piece)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(max(len(ids), len(self.flat)), np.uint16)))
        self.flat[self.used:self.used + len(ids)] = ids
        self.begin.append(self.used)
        self.size.append(len(ids))
        self.used += len(ids)
        self.known[piece] = out = len(self.begin) - 1
        return out

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and where each row's begin."""
        if not len(data):
            return np.empty(0, np.uint16), np.zeros(len(offsets), np.int64)
        if len(self.begin) > CACHE:
            self._forget()
        first_byte = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        rows = np.searchsorted(first_byte, offsets)
        starts = first_byte[piece_starts(codes, rows)]
        cuts = np.append(starts, len(data)).astype(np.int32)
        tiles = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
        coded = tiles.dictionary_encode()
        get, place = self.known.get, self._place
        index = np.fromiter((k if (k := get(p)) is not None else place(p) for p in coded.dictionary.to_pylist()), np.int64,
                            len(coded.dictionary))
        piece = index[np.asarray(coded.indices)]
        sizes, begins = np.array(self.size)[piece], np.array(self.begin)[piece]
        upto = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.arange(upto[-1]) + np.repeat(begins - upto[:-1], sizes)]
        return ids, upto[np.searchsorted(starts, offsets)]


class RoomTree:
    """Segment tree over amounts of room: the least one, not under a size, of which there are open rows."""

    def __init__(self, most: int):
        self.width = 1
        while self.width <= most:
            self.width *= 2
        self.some = [False] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.width + room
        while i and not self.some[i]:
            self.some[i] = True
            i //= 2

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of the tightest row that fits, removed from the tree."""
        i = self.width + size
        while not self.some[i]:
            while i & 1:  # a right child: go up until there is a right neighbour
                i //= 2
            if not i:
                return None
            i += 1
        while i < self.width:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.width
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.some[i] = False
            i //= 2
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = False
                i //= 2
        return room, row


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of item numbers whose sizes fit into the capacity; largest first, equal ones in order."""
    rows: list[list[int]] = []
    tree = RoomTree(capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        spot = tree.take(size)
        if spot is None:
            rows.append([i])
            room, row = capacity, len(rows) - 1
        else:
            room, row = spot
            rows[row].append(i)
        if room > size:
            tree.add(room - size, row)
    return rows


SCHEMA = ("pack_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
          "doc_ids array<long>, rows array<long>, parts array<int>")


def _pack(segments: list[tuple], capacity: int, first_pack: int) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(8)]
    for k, row in enumerate(best_fit_decreasing(np.array([len(s[3]) for s in segments]), capacity)):
        picked = [segments[i] for i in row]
        cu = np.append(0, np.cumsum([len(s[3]) for s in picked]))
        ids = np.full(capacity, END, "<u2")
        ids[:cu[-1]] = np.concatenate([s[3] for s in picked])
        for col, x in zip(cols, (first_pack + k, ids.tobytes(), int(cu[-1]), cu.tolist(), cu[:-1].tolist(),
                                 [s[0] for s in picked], [s[1] for s in picked], [s[2] for s in picked])):
            col.append(x)
    types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()),
             pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["pack_id", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "rows", "parts"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _pack_batches(vocabulary: str, capacity: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, next_pack = Tokenizer(vocabulary), TaskContext.get().partitionId() << 40
        segments, held = [], 0
        for batch in batches:
            row_ids, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, data, offsets in T.chunks(*T.utf8(batch.column(2)), CHUNK):
                ids, at = tokenizer.batch(data, offsets)
                for r in range(hi - lo):
                    mine = np.append(ids[at[r]:at[r + 1]], np.uint16(END))
                    for part in range(0, len(mine), capacity):
                        segments.append((doc_ids[lo + r], row_ids[lo + r], part // capacity, mine[part:part + capacity]))
                    held += len(mine)
                if held >= window:
                    out = _pack(segments, capacity, next_pack)
                    next_pack, segments, held = next_pack + out.num_rows, [], 0
                    yield out
        if segments:
            yield _pack(segments, capacity, next_pack)
    return run


def pack(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, capacity: int = ROW_TOKENS,
         window: int = WINDOW_TOKENS) -> DataFrame:
    """Packed rows: ids (little-endian uint16, filled up with the end id), where segments begin and whose they are."""
    return docs.select(F.monotonically_increasing_id(), docs["doc_id"].cast("long"), docs[text].cast("string")) \
        .mapInArrow(_pack_batches(vocabulary, capacity, window), SCHEMA)


def position_ids(cu_seqlens, capacity: int = ROW_TOKENS) -> np.ndarray:
    """Positions of a packed row, from 0 in every segment and in the filling."""
    begins = np.array([*cu_seqlens], np.int64)
    sizes = np.diff(np.append(begins, capacity))
    return np.arange(capacity) - np.repeat(begins, sizes)


def matrix(ids: list[bytes], capacity: int = ROW_TOKENS) -> np.ndarray:
    """The ids of packed rows as a matrix with one line per row."""
    return np.frombuffer(b"".join(ids), "<u2").reshape(-1, capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2,048 ids."""
    return pack(table(spark, sf_dir, "documents"))
