"""License scans: a trained paragraph classifier with an unknown class and template comparison.

A paragraph is a block of lines without a blank line between them; a blank line before a list item doesn't end
it, so that the conditions of a notice stay with its first sentence. Line breaks and comment marks count as spaces.
A notice may also be one line in a longer paragraph: the lines of a paragraph of several lines are scored as well.
Features are the word pairs and triples that occur in the templates of the licence families (a
fixed vocabulary); a multinomial logistic regression with an elastic-net penalty is trained on
altered templates (words dropped, alone, after corpus words or inside corpus paragraphs) and on lines and paragraphs
of the corpus without a template, a bounded sample of rows. A temperature fitted on rows kept aside calibrates its
probabilities. A second model, which isn't trained on a third of the families, tells how licences that a model doesn't know look to
it, and so from which probability of all families together a passage counts as a licence at all.

A family is confirmed if its probability reaches the threshold fitted there, CONFIRM of the pairs and triples of one of
its templates occur, all pairs that end in a number (its version) or hold a naming word among them, and no
template of another family that occurs as well speaks against it: of the pairs and triples that only one of the two
has, those of the confirmed template occur to the larger share, CONFIRM at least. If it has none of its own (a two-clause
BSD notice lies inside the three-clause one), less than CONFIRM of the other's may occur. What looks
like a licence and isn't confirmed is ``unknown``, be it a line or a whole paragraph. A paragraph counts for a family that none of its lines was confirmed for, and its unconfirmed lines
don't count then. The first sentence of a BSD licence alone doesn't tell the number of clauses and isn't confirmed.

Every line and paragraph is scored with DataFrame expressions: its pairs of template words are exploded and
joined with the weights, so one without any leaves no row; weights and templates have a
few thousand rows, whatever the corpus. Only these matches are shuffled, by row and place.

Defined results: a null text, or one without a licence paragraph, is ``none``; every row gets a row, also rows that
repeat a doc_id or have none. Very long texts are read in whole. Of equally probable families the first in order of their names counts.
An empty table gives no rows; without documents that have an id there are no plain paragraphs to learn from, but templates. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, table

NONE, UNKNOWN = "none", "unknown"
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by "
        "the Free Software Foundation, either {} of the License, or (at your option) any later version.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.")
#: Notices of the licence families, as their publishers give them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("bsd-3-clause", f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License."),
    ("bsd-2-clause", _BSD),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", _GNU.format("GNU Affero General Public License", "version 3")),
    ("cc0-1.0", "Licensed under CC0 1.0."),
    ("cc0-1.0", "This work is licensed under a Creative Commons Zero v1.0 Universal license."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work. This work is marked with CC0 1.0 Universal."),
    ("cc0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
                "rights to this software to the public domain worldwide. This software is distributed without any warranty. "
                "You should have received a copy of the CC0 Public Domain Dedication along with this software."),
    ("cc0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
                "rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("isc", "Released under the ISC License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-2.1", _GNU.format("GNU Lesser General Public License", "version 2.1").replace("This program", "This library")),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3.0", _GNU.format("GNU Lesser General Public License", "version 3")),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", _GNU.format("GNU General Public License", "version 2")),
    ("gpl-3.0", _GNU.format("GNU General Public License", "version 3")),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
FAMILIES = [NONE, *sorted({f for f, _ in TEMPLATES})]
#: Families that a second model isn't trained on: what licences it doesn't know look like to it sets the unknown class.
HELD_OUT = FAMILIES[1::3]
#: Altered copies of each template, and documents whose paragraphs are the other class, at most.
ALTERED = 60
SAMPLE_DOCUMENTS = 300
SAMPLE_PARAGRAPHS = 4000
CONFIRM = 0.6
#: A sampled paragraph in which this share of a template occurs isn't an example of a plain one.
PLAIN = 0.5
#: Blank lines, unless a list item follows. It reads every run of spaces once.
PARAGRAPH = r"(?<!\s)(?=[ \t\r\f\x0B]*+\n[ \t\r\f\x0B]*+\n)\s++(?!(?:[0-9]{1,2}[.)]|\([0-9a-z]\)|[*\u2022-])\s)"
#: Precision of the family before confirmation: altered notices that lost their version are told apart by the templates only.
PRECISION = 0.95
#: Words that name a family; a template that has some is confirmed only where its pairs with them occur.
NAME_WORDS = "affero apache artistic bsd cc cc0 commons creative gnu isc lesser mit mozilla mpl unlicense zero".split()
#: Share of kept-aside rows of families not trained on that shall look like licences, and of such rows that shall be licences.
FOUND, LICENCES = 0.95, 0.99
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)


def _words(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")


def _plain_words(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def _plain_grams(text: str) -> list[str]:
    w = _plain_words(text)
    return sorted({" ".join(w[i:i + k]) for k in (2, 3) for i in range(len(w) - k + 1)})


def _key(gram: str) -> bool:
    """Whether it is a pair that ends in a number or holds a naming word."""
    return len(w := gram.split()) == 2 and (w[1].isdigit() or any(x in NAME_WORDS for x in w))


VOCABULARY = sorted({g for _, t in TEMPLATES for g in _plain_grams(t)})
TEMPLATE_WORDS = sorted({w for _, t in TEMPLATES for w in _plain_words(t)})


def grams(words: Column) -> Column:
    """Distinct pairs and triples of words at places where a pair of template words begins."""
    def of(w: Column) -> Column:
        known = F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.get(w, i).isin(TEMPLATE_WORDS)
                         & F.get(w, i + 1).isin(TEMPLATE_WORDS))
        return F.array_distinct(F.flatten(F.transform(known, lambda i: F.array(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)),
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))))

    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.array(words), of)[0])


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """row, doc_id, block, line and passage: every paragraph (line -1), and the lines of those with several."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    blocks = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
                         F.posexplode(F.split(body, PARAGRAPH)).alias("block", "paragraph"))
    lines = F.split("paragraph", "\n")
    passages = F.concat(F.array("paragraph"), F.when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<string>")))
    return blocks.select("row", "doc_id", "block", F.posexplode(passages).alias("line", "passage")) \
        .withColumn("line", F.col("line") - 1)


def training_rows(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """family, grams and part (0-2; 2 is kept aside) of altered templates and sampled lines and paragraphs.

    The sample is bounded: SAMPLE_PARAGRAPHS of SAMPLE_DOCUMENTS documents, those first in hash order, half of the
    rows whole paragraphs if there are so many. Of their words, only pairs and triples in the vocabulary are held.
    """
    spark = docs.sparkSession
    some = docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct() \
        .orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCUMENTS)
    some = scratch.write(some, "sampled")
    vocabulary = F.array(*[F.lit(g) for g in VOCABULARY])
    sample = paragraphs(docs.join(some, docs["doc_id"].cast("long") == F.col("id"), "left_semi"), text) \
        .withColumn("h", F.xxhash64("doc_id", "block", "line"))
    sample = scratch.write(sample.withColumn("words", _words(F.col("passage"))).where(F.size("words") > 0).select(
        "h", "doc_id", "block", "line", F.slice("words", 1, 8).alias("head"),
        F.array_intersect(grams(F.col("words")), vocabulary).alias("grams")), "sample")
    half = [sample.where(c).orderBy("h", "doc_id", "block", "line").limit(SAMPLE_PARAGRAPHS // 2) for c in ("line < 0", "line >= 0")]
    lines = scratch.write(half[0].unionByName(half[1]).select("h", "head", "grams"), "lines")
    n_lines = max(1, lines.count())
    order = scratch.write(lines.select(F.expr(f"row_number() over (order by h) % {n_lines}").alias("nth"),
                                       "head", F.col("grams").alias("other")), "order")
    rows = [(i, f, _plain_words(t)) for i, (f, t) in enumerate(TEMPLATES)]
    t = spark.createDataFrame(rows, "i int, family string, t array<string>") \
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(ALTERED - 1))))
    likeness = F.array_max(F.array(*[F.size(F.array_intersect("other", F.array(*[F.lit(g) for g in x]))) / len(x)
                                     for x in map(_plain_grams, [t for _, t in TEMPLATES])]))
    order = scratch.write(order.withColumn("plain", F.coalesce(likeness, F.lit(0.0)) < PLAIN), "plain")
    t = t.withColumn("nth", F.pmod(F.xxhash64("i", "copy"), F.lit(n_lines)).cast("int")).join(order, "nth", "left")
    drop = F.col("copy") % 4 * 7  # percent of words left out
    kept = F.filter("t", lambda w, k: F.pmod(F.xxhash64("i", "copy", k), F.lit(100)) >= drop)
    empty = F.array().cast("array<string>")
    around = F.coalesce(F.when(F.col("copy") % 2 == 1, F.col("head")), empty)
    inside = F.coalesce(F.when((F.col("copy") % 3 == 2) & F.col("plain"), F.col("other")), empty)
    altered = t.select("family", F.array_union(grams(F.concat(around, kept)), inside).alias("grams"), F.xxhash64("copy", "i").alias("h"))
    plain = order.where("plain").select(F.lit(NONE).alias("family"), F.col("other").alias("grams"), F.xxhash64("nth").alias("h"))
    every = altered.unionByName(plain)
    return scratch.write(every.select("family", "grams", F.pmod("h", F.lit(3)).alias("part")).repartition(2), "training")


def _logits(matches: DataFrame, keys: list[str]) -> DataFrame:
    return matches.groupBy(*keys).agg(
        *[F.sum(f"w{k}").alias(f"z{k}") for k in range(len(FAMILIES))],
        F.collect_set(F.when(F.col("gram") != "", F.col("gid"))).alias("gids"))


def _probabilities(z: list[Column], temperature: Column | float) -> Column:
    scaled = F.transform(F.array(*z), lambda x: x / temperature)
    powers = F.transform(F.array(scaled), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]
    return F.transform(F.array(powers), lambda e: F.transform(
        e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y)))[0]


class Classifier:
    """Weights per word pair or triple, temperature and threshold, as small written tables."""

    def __init__(self, docs: DataFrame, scratch: Scratch, text: str = "text"):
        spark = docs.sparkSession
        rows = training_rows(docs, scratch, text)
        counts = CountVectorizerModel.from_vocabulary(VOCABULARY, inputCol="grams", outputCol="features")
        counts.setBinary(True)
        numbered = rows.withColumn("label", F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1)
        numbered = counts.transform(numbered).select("features", F.col("label").cast("double"), "part", "family")
        some = self._fitted(numbered.where((F.col("part") < 2) & ~F.col("family").isin(HELD_OUT)), scratch, "known")
        self.weights = self._fitted(numbered.where("part < 2"), scratch, "every")
        place = {g: i for i, g in enumerate(VOCABULARY)}
        held = [(f, {place[g] for g in _plain_grams(t)}, [place[g] for g in _plain_grams(t) if _key(g)]) for f, t in TEMPLATES]
        self.templates = scratch.write(spark.createDataFrame(
            [(f, sorted(t), key, [(sorted(r), sorted(t - r), sorted(r - t)) for g, r, _ in held if g != f]) for f, t, key in held],
            "family string, template array<int>, key array<int>, "
            "rivals array<struct<whole: array<int>, mine: array<int>, theirs: array<int>>>").coalesce(1), "templates")
        self.temperature, self.threshold = self._calibrate(rows.where("part = 2"))
        self.likeness = self._calibrate_unknown(rows.where((F.col("part") == 2) | F.col("family").isin(HELD_OUT)), some)

    @staticmethod
    def _fitted(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """Weights of every word pair and triple, and the intercepts ('')."""
        lr = LogisticRegression(family="multinomial", regParam=1e-4, elasticNetParam=0.5, maxIter=60, standardization=False)
        model = lr.fit(scratch.write(rows.select("features", "label"), f"fitted-{name}"))
        w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        seen = {int(r[0]) for r in rows.select("label").distinct().collect()}  # one row per family
        names = [f"w{k}" for k in range(len(FAMILIES))]
        full = lambda col, other: [float(col[k]) if k in seen else other for k in range(len(FAMILIES))]
        table_rows = [(g, i, *full(w[:, i], 0.0)) for i, g in enumerate(VOCABULARY)] + [("", -1, *full(b, -1e6))]
        return scratch.write(rows.sparkSession.createDataFrame(
            table_rows, "gram string, gid int, " + ", ".join(f"{x} double" for x in names)).coalesce(1), f"weights-{name}")

    def _scored(self, rows: DataFrame, weights: DataFrame) -> DataFrame:
        """Logits of rows with a grams column, which is exploded and joined with the weights ('' brings the intercepts)."""
        rows = rows.withColumn("id", F.monotonically_increasing_id())
        matches = rows.select("id", "family", F.explode(F.concat(F.col("grams"), F.array(F.lit("")))).alias("gram")).join(weights, "gram")
        return _logits(matches, ["id", "family"])

    def _calibrate_unknown(self, rows: DataFrame, weights: DataFrame) -> float:
        """How much probability all families together need for a passage to look like a licence.

        The model that doesn't know the families held out says it of their rows and of plain ones: the lowest level at which LICENCES of
        what looks like a licence is one, and not above the highest at which FOUND of the families held out do.
        """
        p = _probabilities([F.col(f"z{k}") for k in range(len(FAMILIES))], self.temperature)
        level = F.explode(F.array(*[F.lit(x / 50) for x in range(5, 50)]))
        at = self._scored(rows, weights).select("family", (1 - F.get(p, 0)).alias("like")).withColumn("level", level)
        held, like = F.col("family").isin(HELD_OUT), F.col("like") >= F.col("level")
        by_level = at.groupBy("level").agg(F.avg(F.when(held, like.cast("double"))).alias("found"),
                                           F.avg(F.when(like, (F.col("family") != NONE).cast("double"))).alias("licences"))
        low, high = by_level.agg(F.min(F.when(F.col("licences") >= LICENCES, F.col("level"))), F.max(F.when(F.col("found") >= FOUND, F.col("level")))).first()
        return float(min(x for x in (low, high, 0.5) if x is not None))

    def _calibrate(self, rows: DataFrame) -> tuple[float, float]:
        """The temperature of least log loss, and the lowest threshold with PRECISION, on rows kept aside."""
        z = [F.col(f"z{k}") for k in range(len(FAMILIES))]
        scored = self._scored(rows, self.weights)
        truth = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("int") - 1
        loss = scored.withColumn("t", F.explode(F.array(*[F.lit(t) for t in TEMPERATURES]))) \
            .withColumn("p", F.get(_probabilities(z, F.col("t")), truth)) \
            .groupBy("t").agg(F.avg(-F.log(F.greatest("p", F.lit(1e-12)))).alias("loss")).orderBy("loss", "t").first()
        temperature = loss["t"] if loss else 1.0
        p = _probabilities(z, temperature)
        best = F.array_position(p, F.array_max(p)).cast("int") - 1
        level = scored.select(F.array_max(p).alias("p"), (best == truth).alias("right"), best.alias("best")).where("best > 0") \
            .withColumn("level", F.explode(F.array(*[F.lit(x / 20) for x in range(8, 20)]))).where("p >= level") \
            .groupBy("level").agg(F.avg(F.col("right").cast("double")).alias("precision")) \
            .where(F.col("precision") >= PRECISION).agg(F.min("level")).first()[0]
        return float(temperature), float(level if level is not None else 0.95)

    def classify(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """row, doc_id, block, line (-1: the paragraph), family (or unknown), p and similarity of every line and paragraph that looks
        like a licence, and one row with block -1 per input row."""
        passages = paragraphs(docs, text).select("row", "doc_id", "block", "line", grams(_words(F.col("passage"))).alias("grams"))
        marks = F.when((F.col("block") == 0) & (F.col("line") < 0), F.array(F.struct(F.lit(-1).alias("block"), F.lit("").alias("gram")))) \
            .otherwise(F.array().cast("array<struct<block: int, gram: string>>"))
        found = passages.select("row", "doc_id", "block", "line", F.explode(F.concat(F.transform(
            "grams", lambda g: F.struct(F.col("block").alias("block"), g.alias("gram"))), marks)).alias("g")) \
            .select("row", "doc_id", F.col("g")["block"].alias("block"), "line", F.col("g")["gram"].alias("gram")).join(self.weights, "gram")
        scored = _logits(found, ["row", "doc_id", "block", "line"])
        intercept = self.weights.where("gram = ''").first()
        z = [F.col(f"z{k}") + intercept[f"w{k}"] for k in range(len(FAMILIES))]
        p = _probabilities(z, self.temperature)
        # the surest family, if all families together are likely enough
        families = F.slice("probs", 2, len(FAMILIES) - 1)
        scored = scored.withColumn("probs", p).withColumn("p", F.array_max(families)) \
            .withColumn("family", F.when(1 - F.get("probs", 0) >= self.likeness, F.get(
                F.array(*[F.lit(f) for f in FAMILIES]), F.array_position(families, F.col("p")).cast("int"))).otherwise(NONE))
        scored = scored.where((F.col("family") != NONE) | (F.col("block") < 0)).select("row", "doc_id", "block", "line", "family", "p", "gids")
        same = scored.join(self.templates.groupBy("family").agg(F.collect_list(F.struct("template", "key", "rivals")).alias("all")),
                           "family", "left")

        def share(of: Column) -> Column:
            return F.size(F.array_intersect("gids", of)) / F.size(of)

        def beats(r: Column) -> Column:
            own = F.when(F.size(r["mine"]) > 0, (share(r["mine"]) >= share(r["theirs"])) & (share(r["mine"]) >= CONFIRM))
            own = F.when(F.size(r["theirs"]) > 0, F.coalesce(own, share(r["theirs"]) < CONFIRM)).otherwise(F.size(r["mine"]) > 0)
            return (share(r["whole"]) < CONFIRM) | own

        def holds(t: Column) -> Column:
            return (share(t["template"]) >= CONFIRM) & (F.size(F.array_except(t["key"], F.col("gids"))) == 0) \
                & F.forall(t["rivals"], beats)

        likely = (F.col("block") >= 0) & (F.col("p") >= self.threshold)
        same = same.withColumns({
            "similarity": F.coalesce(F.array_max(F.transform("all", lambda t: share(t["template"]))), F.lit(0.0)),
            "sure": F.when(likely, F.coalesce(F.exists("all", holds), F.lit(False))).otherwise(F.lit(False))})
        return same.select("row", "doc_id", "block", "line", F.when(F.col("block") < 0, NONE).when(F.col("sure"), F.col("family"))
                           .otherwise(UNKNOWN).alias("family"), "p", "similarity")


def scan(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """doc_id, license (the surest family; unknown if only doubtful paragraphs; none), licenses, paragraph counts, confidence."""
    hits = Classifier(docs, scratch, text).classify(docs, text)
    sure, whole = F.col("family") != UNKNOWN, F.col("line") < 0
    blocks = hits.groupBy("row", "doc_id", "block").agg(
        F.max(F.when(sure, F.struct(F.round("p", 6).alias("p"), "family"))).alias("first"),
        F.collect_set(F.when(sure, F.col("family"))).alias("families"),
        F.collect_set(F.when(sure & ~whole, F.col("family"))).alias("line_families"),
        F.count(F.when(sure & ~whole, 1)).alias("known_lines"), F.count(F.when(~sure & ~whole, 1)).alias("unknown_lines"),
        F.max(F.when(whole, sure)).alias("whole_sure"), F.max("p").alias("p"))
    real = F.col("block") >= 0
    by_whole = F.size(F.array_except("families", "line_families"))  # 1 if the paragraph tells more than its lines
    # a paragraph of one line has no lines of its own
    unknown = F.when(by_whole > 0, 0).otherwise(F.greatest("unknown_lines", F.when(
        ~F.col("whole_sure") & (F.col("known_lines") == 0), 1).otherwise(0)))
    out = blocks.groupBy("row", "doc_id").agg(
        F.max(F.when(real, F.col("first")))["family"].alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(real, F.col("families")))))).alias("licenses"),
        F.sum(F.when(real, F.col("known_lines") + by_whole).otherwise(0)).alias("n_license_paragraphs"),
        F.sum(F.when(real, unknown).otherwise(0)).cast("long").alias("n_unknown_paragraphs"),
        F.round(F.max(F.when(real, F.col("p"))), 6).alias("confidence"))
    return out.select("doc_id", F.coalesce("first", F.when(F.col("n_unknown_paragraphs") > 0, UNKNOWN), F.lit(NONE)).alias("license"),
                      F.array_join("licenses", ",").alias("licenses"), "n_license_paragraphs", "n_unknown_paragraphs", "confidence")


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op1"))
