"""Personal data and disclosing terms against plain Python, and odd tables."""

import hashlib
import math
import random
import re
from collections import defaultdict

from tidemark.llm import disclosure
from tidemark.llm.disclosure import KINDS, MIN_SUPPORT, NEAR, THRESHOLD, op11_personal_data, sanitise
from tidemark.llm.storage import Scratch

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, row string, spans long, digest string, some int, kind int"


def passes_luhn(d):
    s = [int(c) for c in d[::-1]]
    return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(s)) % 10 == 0


def base(text):
    """(start, kind, end) by the plain patterns."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and passes_luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def runs(text):
    """(start, end) of the runs of letters and marks."""
    import regex
    return [m.span() for m in regex.finditer(r"[\p{L}\p{M}]+", text)]


def raw(text, kind):
    return [m.span() for m in re.finditer([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"][kind], text)
            if kind != 2 or 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19]


def reference(texts):
    """Per text: all spans, and the sanitised text."""
    n, ent, pair, df, occ = len(texts), defaultdict(set), defaultdict(set), defaultdict(int), []
    keys = lambda t: ["0" + t, "3" + t[:3], "1" + t[:1]]
    for k, text in enumerate(texts):
        terms = {text[a:b].lower() for a, b in runs(text.lower()) if b - a >= 3}
        terms = {text.lower()[a:b] for a, b in runs(text.lower()) if b - a >= 3}
        for key in {x for t in terms for x in keys(t)}:
            df[key] += 1
        for a, kind, b in base(text):
            value = text[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", text[a:b])
            e = f"{kind}{value}"
            ent[e].add(k)
            spans = raw(text, kind)
            j = spans.index((a, b))
            lo = max(spans[j - 1][1] if j else 0, a - NEAR)
            hi = min(spans[j + 1][0] if j + 1 < len(spans) else len(text), b + NEAR)
            cut_lo, cut_hi = spans[j - 1][1] if j else 0, spans[j + 1][0] if j + 1 < len(spans) else len(text)
            for part_lo, part_hi in ((cut_lo, a), (b, cut_hi)):
                for x, y in runs(text[part_lo:part_hi]):
                    x, y = x + part_lo, y + part_lo
                    if lo <= x and y <= hi and len(text[x:y].lower()) >= 3:
                        occ.append((k, e, text[x:y].lower(), x, y))
                        for key in keys(text[x:y].lower()):
                            pair[e, key].add(k)

    def told(e, key):
        docs = pair[e, key]
        if len({texts[d] for d in docs}) < MIN_SUPPORT or len({texts[d] for d in ent[e]}) < MIN_SUPPORT:
            return None
        return 0.0 if len(ent[e]) == n else 1 - math.log2(len(docs) / df[key]) / math.log2(len(ent[e]) / n)

    levels = defaultdict(int)
    for k, e, t, x, y in occ:
        d = told(e, "0" + t)
        if d is not None and d >= THRESHOLD:
            d3, d1 = told(e, "3" + t[:3]), told(e, "1" + t[:1])
            levels[k, x, y] = max(levels[k, x, y], 1 if d3 is not None and d3 < THRESHOLD else 2 if d1 is not None and d1 < THRESHOLD else 3)
    out = []
    for k, text in enumerate(texts):
        spans = sorted([(a, kind, b, 0) for a, kind, b in base(text)] + [(x, 4, y, v) for (j, x, y), v in levels.items() if j == k])
        upto, new = 0, ""
        for a, kind, b, level in spans:
            if a >= upto:
                new += text[upto:a] + (f"[{KINDS[kind].upper()}]" if kind < 4 else [None, text[a:a + 3] + "*", text[a:a + 1] + "*", "[...]"][level])
            upto = max(upto, b)
        out.append(([s[:3] for s in spans], new + text[upto:]))
    return out


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_documents_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = [d.text or "" for d in docs]
    want = {d.doc_id: w for d, w in zip(docs, reference(texts))}
    got = op11_personal_data(spark, SF).collect()
    assert len(got) == len(docs) and sum(bool(w[0]) for w in want.values()) > 20
    for r in got:
        spans, text = want[r.doc_id]
        own = [s for s in spans if s[1] < 4]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_term] == [sum(s[1] == k for s in spans) for k in range(5)]
        assert r.base_sha256 == hashlib.sha256(listed(own).encode()).hexdigest() and r.spans == listed(spans)
        assert r.sanitised_sha256 == hashlib.sha256(text.encode()).hexdigest()


def made_corpus():
    """An address that always comes with some words, one whose word is common, copies, and plain texts."""
    rnd = random.Random(4)
    plain = lambda n: " ".join(rnd.choice(["river", "stone", "green", "wander", "morning", "quiet", "hill", "paper"]) for _ in range(n))
    texts = [f"{plain(30)} Zephyrine of Quorlton writes from ann@mail.example.org about Stonewall {plain(30)}" for _ in range(9)]
    texts += [f"{plain(9)} quorlmix {plain(9)} stonewort {plain(5)}" for _ in range(20)]
    texts += [f"only once near bob@mail.example.org stands Wimbrel {plain(3)}"] * 40
    texts += [f"{plain(12)} call +1 (017) 555-7713 or 4111 1111-1111 1111 from 10.0.0.{k} morning" for k in range(12)]
    texts += [plain(40) for _ in range(60)]
    return texts


def run(spark, texts, parts=3):
    df = spark.createDataFrame([(k, t, "", 0, "", 0, 0) for k, t in enumerate(texts)], SCHEMA).repartition(parts)
    return {r.doc_id: ([(s.start, s.kind, s.end) for s in r.spans], r.text) for r in sanitise(df, Scratch(spark, "t")).collect()}


def test_disclosing_terms_are_treated(spark):
    texts = made_corpus()
    got, want = run(spark, texts), reference(texts)
    assert [got[k] for k in range(len(texts))] == [(list(a), b) for a, b in want]
    first = got[0][1]
    assert "[EMAIL]" in first and "Zephyrine" not in first and "Quorlton" not in first and "Quo*" in first
    assert "Wimbrel" in got[29][1] and "[EMAIL]" in got[29][1]  # copies of one text are no evidence
    assert all(got[k][1] == texts[k] for k in range(9, 29))  # no mention: as it was


def test_terms_far_from_the_mention_are_treated(spark):
    rnd = random.Random(5)
    plain = lambda n: " ".join(rnd.choice(["river", "stone", "green", "wander", "morning"]) for _ in range(n))
    texts = [f"Zephyrine {plain(200)} from ann@mail.example.org {plain(200)} Quorlton" for _ in range(6)] + [plain(30) for _ in range(30)]
    got = run(spark, texts)
    assert [got[k] for k in range(len(texts))] == [(list(a), b) for a, b in reference(texts)]
    for k in range(6):
        assert "Zephyrine" not in got[k][1] and "Quorlton" not in got[k][1] and "[EMAIL]" in got[k][1]


def test_odd_texts(spark):
    rnd = random.Random(7)
    texts = ["", "a@b.co_x@c.de", "a@b", "a@b.c@d.e", "@a.b", "x.y@z-.-.q", "999.1.2.3.4 1.2.3.4.5.6.7.8", "0255.000.1.01", "1.2.3.256",
             "4111111111111111", "x4111 1111 1111 1111-", "1 4111 1111 1111 1111", "+1 234 567 8901)", "+1((((((", "+12345678901234567",
             "𝒳 é a@b.cd ﬁ 🙂 1.1.1.1", "00000000000000", "+1 2345678901@b.co", "5 5 5 5 5 5 5 5 5 5 5 5 5 7", "tel:+49(0)30.123-456 78.x"]
    texts += ["".join(rnd.choice("a@.1+ -(_9é%") for _ in range(rnd.randrange(60))) for _ in range(400)]
    texts += ["".join(rnd.choice("1.4 5-2+@") for _ in range(rnd.randrange(40))) for _ in range(400)]
    got, want = run(spark, texts), reference(texts)
    for k, t in enumerate(texts):
        assert got[k] == (list(want[k][0]), want[k][1]), t[:80]


def test_very_long_texts(spark):
    """Texts on which the plain patterns would be quadratic or recurse deeply."""
    texts = {"a@" + "b." * 60_000 + "c": [(0, 0, 120_003)], "1" * 200_000: [],
             "a" * 300_000: [], "+1" + " " * 100_000: [], "+1" * 50_000: [], "@" * 100_000: [], "a." * 100_000: [], "1 " * 100_000: [],
             "x y@z.w " * 2000: [(8 * k + 2, 0, 8 * k + 7) for k in range(2000)]}
    got = run(spark, list(texts))
    assert [got[k][0] for k in range(len(texts))] == list(texts.values())
    long = "1.1.1.1 " * 500
    assert run(spark, [long])[0] == ([(8 * k, 1, 8 * k + 7) for k in range(500)], "[IP] " * 500)


def test_odd_rows(spark):
    text = "mail a@b.cd now"
    rows = [(1, None), (1, text), (1, text), (None, text), (None, None)]
    got = sanitise(spark.createDataFrame([(a, b, "r", 1, None, 2, 3) for a, b in rows], SCHEMA), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((a or 0, (b or "").replace("a@b.cd", "[EMAIL]")) for a, b in rows)
    assert sanitise(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).collect() == []
    assert disclosure.KINDS[:4] == ("email", "ip", "card", "phone")


def test_no_python_in_the_plan(spark):
    plan = op11_personal_data(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
