"""The whole model of lattice scoring, re-computed word by word, and hashes that collide."""

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tidemark.llm import lattice_lm
from tidemark.llm.storage import Scratch

TEXTS = {1: "The cat sat on the mat", 2: None, 3: "", 5: "thé THE cat  xyzzy\tmat mat", 6: "a" * 300 + " on", 7: "the the the", 8: "cat on \u00e9\u00e9 sat",
         11: "mats sit on cats", None: "the mat", 12: "The cat sat on the mat"}


def lattice(raw, p):
    """Ways and the expected uses of each piece of one word, by plain dynamic programming."""
    n = len(raw)
    spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 64) + 1) if raw[i:j] in p]
    left, right = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j in sorted(spans):
        left[j] += left[i] * p[raw[i:j]] * SCALE ** (j - i)
    for i, j in sorted(spans, reverse=True):
        right[i] += right[j] * p[raw[i:j]] * SCALE ** (j - i)
    uses = Counter()
    for i, j in spans:
        uses[raw[i:j]] += left[i] * p[raw[i:j]] * SCALE ** (j - i) * right[j] / left[n]
    return math.log(left[n]) - n * math.log(SCALE), uses


SCALE = 8.0  # keeps the plain products of long words within a double


def reference(texts, rounds):
    tokens = {k: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, t in texts.items()}
    held = {k: k is None or zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n_train = sum(not h for h in held.values())
    total = sum(counts.values()) + n_train
    names, log_p = lattice_lm.load_pieces(lattice_lm.VOCABULARY)
    p = {a: math.exp(b) for a, b in zip(names, log_p)}
    prior = {a: lattice_lm.PRIOR * v for a, v in p.items()}
    for _ in range(rounds):
        n = Counter(prior)
        for w, c in counts.items():
            for piece, x in lattice(b" " + w.encode(), p)[1].items():
                n[piece] += c * x
        s = sum(n.values())
        p = {a: n[a] / s for a in p}
    p_end = (n_train + 1) / (total + 2)
    return {k: math.log10(p_end) + sum(math.log10(1 - p_end) + lattice(b" " + w.encode(), p)[0] / math.log(10) for w in ws) for k, ws in tokens.items()}, held


@pytest.mark.parametrize("rounds", [0, 2])
def test_scores_are_marginals_of_whole_texts(spark, rounds):
    docs = spark.createDataFrame([*TEXTS.items()], "doc_id long, text string")
    want, held = reference(TEXTS, rounds)
    got = {r.doc_id: r for r in lattice_lm.score_documents(docs, Scratch(spark, "t"), rounds=rounds).collect()}
    assert set(got) == set(want) and any(held.values())
    for k, r in got.items():
        assert r.score == pytest.approx(want[k], rel=1e-9) and r.held_out == held[k]
    assert got[1].score == got[12].score


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([*TEXTS.items()], "doc_id long, text string")
    plain = {r.doc_id: tuple(r) for r in lattice_lm.score_documents(docs, Scratch(spark, "t"), rounds=0).collect()}
    monkeypatch.setattr(lattice_lm, "HEAD", 4)
    real, seeds = lattice_lm._scored_batches, []

    def clash(model, seed, log_word):
        seeds.append(seed)
        scored = real(model, seed, log_word)

        def run(batches):
            for b in scored(batches):
                yield b if seed else b.set_column(0, "hash", pa.array([7] * b.num_rows, pa.int64()))
        return run

    monkeypatch.setattr(lattice_lm, "_scored_batches", clash)
    again = {r.doc_id: tuple(r) for r in lattice_lm.score_documents(docs, Scratch(spark, "t"), rounds=0).collect()}
    assert seeds == [0, 1] and {k: v[:5] for k, v in again.items()} == {k: v[:5] for k, v in plain.items()}
    assert all(again[k][5:] == pytest.approx(plain[k][5:]) for k in plain)
