"""Licence notices as files carry them: wrapped, in comments, with lists, and of families that resemble each other."""

import textwrap

import pytest

from tidemark.llm import licences
from tidemark.llm.storage import Scratch

GNU = ("This {0} is free software; you can redistribute it and/or modify it under the terms of the {1} as published by the "
       "Free Software Foundation; either {2} of the License, or (at your option) any later version.")
MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
       "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
       "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
       "persons to whom the Software is furnished to do so, subject to the following conditions:")
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
       "following conditions are met:",
       "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
       "disclaimer.",
       "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
       "disclaimer in the documentation and/or other materials provided with the distribution.",
       "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
       "derived from this software without specific prior written permission."]
ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
       "provided that the above copyright notice and this permission notice appear in all copies.")
CC0 = ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
       "software to the public domain worldwide. This software is distributed without any warranty.\n\nYou should have received "
       "a copy of the CC0 Public Domain Dedication along with this software.")


def wrap(t, width=72):
    return "\n\n".join(textwrap.fill(x, width) for x in t.split("\n\n"))


def gpl(name, version, what="program"):
    return GNU.format(what, name, version)


NOTICES = {
    "mit": MIT, "bsd-3-clause": "\n\n".join(BSD), "bsd-2-clause": "\n\n".join(BSD[:3]), "isc": ISC, "cc0-1.0": CC0,
    "gpl-2.0": gpl("GNU General Public License", "version 2"), "gpl-3.0": gpl("GNU General Public License", "version 3"),
    "lgpl-2.1": gpl("GNU Lesser General Public License", "version 2.1", "library"),
    "lgpl-3.0": gpl("GNU Lesser General Public License", "version 3"),
    "agpl-3.0": gpl("GNU Affero General Public License", "version 3"),
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


@pytest.fixture(scope="module")
def found(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    prose = corpus.where("length(text) > 4000").orderBy("doc_id").first().text
    cases = {}
    for f, t in NOTICES.items():
        one = t.replace("\n\n", " ")
        cases |= {(f, "one line"): one, (f, "wrapped"): f"Copyright 2020 A\n\n{wrap(t)}\n\nThe end of it.", (f, "narrow"): wrap(t, 50),
                  (f, "comment"): "\n".join(f" * {x}" for x in wrap(t).split("\n")),
                  (f, "in prose"): f"{prose}\n{wrap(one)}\n{prose}"}
    cases |= {("unknown", "no version"): wrap(GNU.format("program", "GNU General Public License", "any version")),
              ("unknown", "other version"): "This work is licensed under the GNU General Public License, version 7.",
              ("unknown", "first sentence"): wrap(BSD[0]),
              ("unknown", "artistic"): "Licensed under the Artistic License, Version 2.0; you may not use this file except in compliance "
                                       "with the License.",
              ("unknown", "eupl"): "Licensed under the European Union Public License, version 1.2."}
    rows = [(10**9 + i, t) for i, t in enumerate(cases.values())]
    docs = corpus.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in licences.scan(docs, Scratch(spark, "t")).collect()}
    return {k: got[10**9 + i] for i, k in enumerate(cases)}


@pytest.mark.parametrize("form", ["one line", "wrapped", "narrow", "comment", "in prose"])
def test_notice_is_found_in_every_form(found, form):
    assert {f: found[f, form].licenses for f in NOTICES} == {f: f for f in NOTICES}


def test_ambiguous_and_foreign_notices_are_unknown(found):
    doubtful = {k: r for k, r in found.items() if k[0] == "unknown"}
    assert {k: r.licenses for k, r in doubtful.items()} == dict.fromkeys(doubtful, "")
    foreign = {k: r.license for k, r in doubtful.items() if k[1] != "first sentence"}
    assert foreign == dict.fromkeys(foreign, "unknown")


def test_rows_that_repeat_an_id_change_nothing(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(10**9, NOTICES["mit"]), (10**9 + 1, NOTICES["mit"]), (10**9 + 1, NOTICES["mit"]), (10**9 + 1, "some prose"),
            (None, NOTICES["isc"]), (None, NOTICES["mpl-2.0"]), (None, None)]
    docs = corpus.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [r for r in licences.scan(docs, Scratch(spark, "t")).collect() if r.doc_id is None or r.doc_id >= 10**9]
    one = next(r for r in got if r.doc_id == 10**9)
    again = sorted((r for r in got if r.doc_id == 10**9 + 1), key=lambda r: r.license)
    assert [r.license for r in again] == ["mit", "mit", "none"]
    assert all(tuple(r)[1:] == tuple(one)[1:] for r in again[:2])
    assert sorted(r.license for r in got if r.doc_id is None) == ["isc", "mpl-2.0", "none"]


def test_an_empty_table_gives_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, row long")
    assert licences.scan(empty, Scratch(spark, "t")).collect() == []
