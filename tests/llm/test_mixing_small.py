"""Mixing against a plain re-computation: targets, schedule, small sources beside large ones, odd rows."""

from collections import Counter

import pytest

from tidemark.llm import mixing
from tidemark.llm.storage import Scratch

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    sizes = {f"big{k:02}": [700 + k, 1900, 3000, 5000] * 3 for k in range(12)}
    sizes |= {"small0": [60], "small1": [200, 300], "small2": [1500], "small3": [25, 0, 35], None: [1, 40]}
    rows = [(s, n) for s, ns in sizes.items() for n in ns]
    return spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(rows)], SCHEMA)


def reference_targets(sizes):
    """Shares by weight 1, 2, 3; what is above three times a source's size is reshared until none is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        price = left / sum(weight[s] for s in free)
        above = {s for s in free if price * weight[s] > 3 * sizes[s]}
        if not above:
            return target | {s: price * weight[s] for s in free}
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def van_der_corput(i):
    x, half = 0.0, 0.5
    while i:
        x, half, i = x + half * (i & 1), half / 2, i >> 1
    return x


def test_every_source_meets_its_target(spark, docs):
    source = {r.doc_id: r.source for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    got = mixing.taken_words(mixing.mix(docs, Scratch(spark, "t"))).collect()
    assert len(got) == len(source)
    for r in got:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = reference_targets(size)
    assert {s: round(t, 6) for s, t in target.items()} == {s: round(t, 6) for s, t in want.items()}
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in size), (taken, target)
    for s in ("small0", "small1", "small2", "small3", None):
        assert taken[s] == 3 * size[s]


def test_slots_are_the_points_mapped_through_the_targets(spark, docs):
    scratch = Scratch(spark, "t")
    sizes = scratch.write(mixing.sized(docs), "sizes")
    sources = scratch.write(mixing.targets(sizes, scratch), "sources")
    quota = {r.sid: r.quota for r in sources.collect()}
    got = {(r.sid, r.rank): r.slot for r in mixing.slots(sources, scratch).collect()}
    total, ends, upto = sum(quota.values()), [], 0
    for s in sorted(quota):
        ends.append((upto, upto + quota[s], s))
        upto += quota[s]
    n, want = -(-total // mixing.BLOCK_WORDS), {s: [] for s in quota}
    for i in range(n):
        place = int(van_der_corput(i) * total)
        want[next(s for a, b, s in ends if a <= place < b)].append(float(i))
    for a, _, s in ends:
        want[s] = want[s] or [a / total * n - 0.5]
    assert got == {(s, r): x for s, at in want.items() for r, x in enumerate(at)}
    assert min(len(at) for at in want.values()) == 1 < max(len(at) for at in want.values())


def test_taken_is_what_slots_and_blocks_share(spark, docs):
    """Blocks of a source are equal to a word, each is taken by one slot, and they follow the shuffled order."""
    mixed = [r for r in mixing.mix(docs, Scratch(spark, "t")).collect() if r.slot is not None]
    words, slot_of = Counter(), {}
    for r in mixed:
        words[r.sid, r.block] += r.words
        assert slot_of.setdefault((r.sid, r.block), r.slot) == r.slot
    assert len(set(slot_of.values())) == len(slot_of)
    for sid in {s for s, _ in words}:
        sizes = [n for (s, _), n in words.items() if s == sid]
        assert max(sizes) - min(sizes) <= 1
        in_order = sorted((b, x) for (s, b), x in slot_of.items() if s == sid)
        assert [x for _, x in in_order] == sorted(x for _, x in in_order)


def test_stretches_hold_the_shares(spark, docs):
    mixed = [r for r in mixing.mix(docs, Scratch(spark, "t"), block_words=64).collect() if r.slot is not None]
    n = max(r.slot for r in mixed) + 1
    target = {r.sid: r.target for r in mixed}
    for a in (0.0, 0.25, 0.6):
        part = Counter()
        for r in mixed:
            part[r.sid] += r.words * (a <= r.slot / n < a + 0.25)
        assert all(abs(part[s] - target[s] / 4) <= 5 * 64 for s in target)


def test_the_stage_brings_every_target(spark, docs):
    """Whole copies, and one cut copy where a target ends inside a document: also for sources of a single one."""
    rows = [(1, "a " * 1200, "a"), (2, "b " * 1000, "b"), (3, "c " * 1000, "c")]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA + ", n_chars long")
    out = mixing.apply_mix(df, Scratch(spark, "t")).collect()
    words = Counter()
    for r in out:
        words[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text) and r.text == (r.source + " ") * len(r.text.split()) or r.text.endswith(r.source)
    want = reference_targets({"a": 1200, "b": 1000, "c": 1000})
    assert all(abs(words[s] - t) <= 0.5 for s, t in want.items())
    out = mixing.apply_mix(docs, Scratch(spark, "t")).collect()
    times = Counter(r.source for r in out)
    assert (times["small0"], times["small1"], times["small2"], times["small3"], times[None]) == (3, 6, 3, 6, 6)


def test_repeated_and_missing_ids_are_rows_of_their_own(spark):
    rows = [(None, "x " * 100, "a"), (None, "y " * 300, "a"), (7, "z " * 50, "a"), (7, "z " * 50, "a"), (7, None, "b"), (8, "", None), (9, "q " * 400, "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.taken_words(mixing.mix(df, Scratch(spark, "t"))).collect()
    assert sorted(r.size for r in got) == sorted(len((t or "").split()) for _, t, _ in rows)
    assert all(r.taken <= 3 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[r.sid] += r.taken
    want = reference_targets({"a": 500, "b": 400, None: 0})
    assert [taken[k] for k in range(3)] == [round(want[s]) for s in ("a", "b", None)]
    kept = mixing.apply_mix(df, Scratch(spark, "t")).collect()
    words = Counter()
    for r in kept:
        words[r.source] += len(r.text.split())
    assert words == {s: round(t) for s, t in want.items() if t}
