"""Secret scans: Aho-Corasick keywords, anchored patterns at the hits, embedded checksums.

One pass of an Aho-Corasick automaton over the lower-cased text finds the keywords that a
pattern can begin with; each pattern is then tried at those places only. Long hexadecimal
runs have no keyword and are found by their own pattern. Kinds whose format carries a
checksum (CRC-32 in base 62, Base58Check) count only if it is right.

Each text is scanned alone, in one pass without shuffle; spans are code points, end exclusive.

Defined results: a null or empty text has no spans (digest of the empty string); repeated
rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .storage import table

#: Kinds in the order in which equal starts are listed; the first three are the base ones.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
BASE_KINDS = 3

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

KEYWORDS = {
    "password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1,
    "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 4, "xprv": 5,
}


def crc_digits(payload: str) -> str:
    """CRC-32 of the payload as six base-62 digits."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


def base58check(text: str) -> bool:
    """Whether the last four bytes are the double SHA-256 of the rest."""
    n = 0
    for c in text:
        n = n * 58 + _BASE58.index(c)
    raw = n.to_bytes(82, "big") if n >> (8 * 82) == 0 else b""
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:] != b""


def _valid(kind: int, m: re.Match) -> bool:
    if kind == 0:
        return len(m[2]) >= 8
    if kind == 1:
        return len(m[0]) >= 16
    if kind in (3, 4):
        return crc_digits(m[1]) == m[2]
    return base58check(m[0])


_PATTERNS = {0: _ASSIGN, 1: _ACCESS, 3: _GITHUB, 4: _NPM, 5: _XPRV}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret in the text, in order of start, then kind."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: keep the places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in words.iter(low))
    found, after = [], [0] * len(KINDS)
    for start, kind in hits:
        if start < after[kind]:
            continue
        m = _PATTERNS[kind].match(text, start)
        if m:
            after[kind] = m.end()
            if _valid(kind, m):
                found.append((start, kind, m.end()))
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = automaton()
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        digests, spans = [], []
        for value in batch.column(1):
            found = scan(value.as_py() or "", words)
            base = [s for s in found if s[1] < BASE_KINDS]
            for k in range(BASE_KINDS):
                counts[k].append(sum(s[1] == k for s in base))
            digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
            spans.append(_listed(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
             pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts by base kind, digest of the base spans and all spans of every row."""
    return docs.select(docs["doc_id"].cast("long"), docs[text].cast("string")).mapInArrow(
        _scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
