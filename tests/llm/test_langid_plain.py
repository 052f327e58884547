"""Language identification against a plain re-computation, ties, and a table of many labels."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import langid
from tidemark.llm.langid import BUCKETS, NOT_A_CANDIDATE, N_SCRIPTS, SCRIPT_SHARE, SCRIPTS, SMOOTHING, SWITCH

SCHEMA = "doc_id long, text string, lang string, held__out int, labels string"


def words_of(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def fold(c):
    return c.lower() if len(c.lower()) == 1 else c


def features(word):
    """Trigram buckets and the script of the first letter."""
    low = [0] + [ord(fold(c)) for c in word] + [0]
    out = []
    for a, b, c in zip(low, low[1:], low[2:]):
        h = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA6B & 0xFFFFFFFF) ^ (c * 0xC2B2AE35 & 0xFFFFFFFF)
        h = (h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
        out.append(h >> 16)
    return out, [s for at, s in SCRIPTS if at <= low[1]][-1]


def reference(rows):
    held = [i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows]
    grams, letters = defaultdict(Counter), defaultdict(Counter)
    for (_, text, lang), h in zip(rows, held):
        if not h and lang is not None:
            for w in words_of(text):
                buckets, script = features(w)
                grams[lang].update(buckets)
                letters[lang][script] += len(w)
    labels = sorted(grams)
    total = {k: sum(grams[k].values()) + SMOOTHING * BUCKETS for k in labels}
    seen = {(k, s): letters[k][s] / max(1, sum(letters[k].values())) >= SCRIPT_SHARE for k in labels for s in range(N_SCRIPTS)}
    out = []
    for (i, text, _), h in zip(rows, held):
        scores = []
        for w in words_of(text):
            buckets, script = features(w)
            any_seen = any(seen[k, script] for k in labels)
            scores.append([0.0 if not any_seen else sum(math.log((grams[k][b] + SMOOTHING) / total[k]) for b in buckets)
                           + (0 if seen[k, script] else NOT_A_CANDIDATE) for k in labels])
        if not scores or not labels:
            out.append((i, h, "und", 0.0))
            continue
        best, back = scores[0], []
        for s in scores[1:]:
            top = max(best)
            back.append([k if best[k] >= top - SWITCH else best.index(top) for k in range(len(labels))])
            best = [max(v, top - SWITCH) + x for v, x in zip(best, s)]
        path = [best.index(max(best))]
        for b in reversed(back):
            path.append(b[path[-1]])
        votes = [path.count(k) for k in range(len(labels))]
        out.append((i, h, labels[votes.index(max(votes))], max(votes) / len(path)))
    return out


def check(spark, rows):
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in langid.identify(
        spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).coalesce(1)).collect()]
    want = reference(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    return got


def test_texts_of_several_languages_equal_plain_viterbi(spark):
    rnd = random.Random(2)
    stems = {"en": ["the", "river", "stone", "walking", "İt"], "de": ["der", "Fluss", "steinig", "gehen", "über"], "ru": ["река", "камень", "идти", "дом"],
             "el": ["ποτάμι", "πέτρα", "σπίτι"], "zh": ["河流", "石头"]}
    say = lambda k, n: " ".join(rnd.choice(stems[k]) for _ in range(n))
    rows = [(i, say(k, rnd.randrange(1, 60)), k) for i, k in enumerate(sorted(stems) * 12)]
    rows += [(1000 + i, f"{say('en', 25)}. {say('ru', 30)}, {say('de', 20)}", None) for i in range(10)]
    rows += [(None, say("de", 9), "de"), (None, None, None), (5000, "", "en"), (5001, "123 ... ---", "en"), (5002, "日本 x", None), (5003, "ሰላም", None), (7, say("el", 4), "el")]
    got = check(spark, rows)
    assert len({g[2] for g in got}) == 6


def test_ties_go_to_the_first_label_and_untrained_tables_are_undetermined(spark):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["b", "a", "c"] * 5)]
    assert {g[2] for g in check(spark, rows)} == {"a"}
    assert {g[2] for g in check(spark, [(1, "no label", None), (2, "none", None)])} == {"und"}
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_dirty_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LABELS", 2)
    rows = [(i, "river stone walking " * 9, "en") for i in range(20)] + [(100 + i, "Fluss steinig gehen " * 8, "de") for i in range(20)]
    rows += [(200 + i, "x", f"dirty-{i}") for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert set(got.values()) == {"en", "de"} and got[0] == "en" and got[100] == "de"
