"""Toxicity and licences."""

import random

import pytest

from reconlink.llm import licences as L, toxicity as T

DOCS = "doc_id long, text string, lang string, score string"


def corpus(n, seed):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        own = ["".join(rnd.choice(["an", "ti", "on", "er", "sh"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(20, 90))]
        toxic = int(rnd.random() < 0.3)
        for _ in range(rnd.randint(2, 5) * toxic):
            own.insert(rnd.randrange(len(own)), rnd.choice(["idiot", "blorgs", "moron!", "grumpuk"]))
        docs.append((i, " ".join(own), "en", "clash"))
        labels.append((i, 1, toxic))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = corpus(500, 3)
    docs += [(900, None, "en", "c"), (901, "", "en", "c"), (None, "idiot idiot moron blorgs you idiot", "en", "c"), (5, docs[5][1], "en", "c")]
    df = spark.createDataFrame(docs, DOCS)
    rows = T.scores(df, spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], LABELS)).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == len(docs) and len(held) > 120
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= T.THRESHOLD) for r in rows)
    assert [r["predicted"] for r in rows if r["doc_id"] is None] == [1] and {r["predicted"] for r in rows if r["doc_id"] in (900, 901)} == {0}
    kept = T.reject(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns and kept.count() < len(docs)


@pytest.mark.parametrize("toxic", [[], [0, 0, 0, 0, 0, 0]])
def test_without_both_classes(spark, toxic):
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], LABELS)
    rows = T.scores(spark.createDataFrame([(1, "idiot", "en", "c"), (2, None, "en", "c")], DOCS), labels).collect()
    assert len(rows) == 2 and len({r["score"] for r in rows}) == 1 and all(r["score"] <= 0.5 for r in rows)
    assert T.scores(spark.createDataFrame([], DOCS), labels).collect() == []


def test_features():
    features = T.featurizer({"blorgs": (9, 0), "4blor": (9, 0)}, 20, 100)
    names = features("You are a b l o r g s, 1d10t IDIOT!!! soooo")
    assert len(names) == len(features("")) == 25 and all(x == 0 for x in features(""))
    assert features("blorgs", 1)[3] < features("blorgs")[3]


def test_words_spelled_letter_by_letter():
    features = T.featurizer({"blorgs": (9, 0)}, 20, 100)
    for text in ("i d i o t", "I-d-i-o-t", "i.d.i.o.t!", "i*d*i*o*t", "i-d-i o.t", "(i-d-i-o-t)"):
        assert features(f"oh {text} there")[-3:-1][1] == 1.0 and features(f"oh {text} there")[-3] > 0, text
    assert features("so b-l-o-r-g-s and b.l.o.r.g.s")[3] > 0
    assert features("it's a day, isn't it? I'd say e.g. a U.S. one")[-3:-1] == [0, 0]
    for text, word in (("b-l-o-r-g-s", "blorgs"), ("b.l.o.r.g.s", "blorgs"), ("a n n a", "anna"), ("l-o l-o", "lolo")):
        assert word in T.terms(f"so {text} there", T.Remembered(T.counted)), text


CASES = {
    "Released under the MIT License.": "MIT",
    "x y.\nLicensed under the Apache License, Version 2.0 (the \"License\");\nrest": "Apache-2.0",
    "Licensed under the Apache License, Version 2.0. All rights reserved.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3. Words. Licensed under CC BY-NC 4.0.": "GPL-3.0-only AND CC-BY-NC-4.0",
    "All rights reserved": "Proprietary",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "",
}


def test_licences(spark):
    rows = [(i, t, "en", "c") for i, t in enumerate(CASES)] + [(50, None, "en", "c"), (51, "", "en", "c"), (52, "no licence here. at all.", "en", "c"), (0, next(iter(CASES)), "en", "c")]
    got = {r["doc_id"]: r["licences"] for r in L.licences(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: got.get(i) for i in range(5)} == dict(enumerate(list(CASES.values())[:5])) and not set(got) & {50, 51, 52}
    assert L.licences(spark.createDataFrame([], DOCS)).collect() == []


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language."""
BSD = """Copyright (c) 2015, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"


def test_wrapped_licences(spark):
    texts = [(MIT, "MIT", 4), (APACHE, "Apache-2.0", 4), (BSD, "BSD-3-Clause", 5), (GPL, "GPL-3.0-or-later", 2), (MPL, "MPL-2.0", 1)]
    rows, want = [], {}
    for text, name, many in texts:
        for mark in ("", "# ", " * ", "// ", "; ", "! "):
            for end in ("\n", "\r\n"):
                want[len(rows)] = (name, many)
                rows.append((len(rows), end.join(f"{mark}{x}".rstrip() for x in text.split("\n")), "en", "c"))
    rows += [(900, "mit\n\nlicense and the software", "en", "c"), (901, "the mit. license mit", "en", "c"), (902, "All rights reserved\nby the owner", "en", "c"), (903, "no mit license here", "en", "c")]
    got = {r["doc_id"]: (r["licences"], r["sentence_ids"].count(",") - 1) for r in L.licences(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {**want, 902: ("Proprietary", 1)}


def test_rules_follow_their_order(spark):
    sentences = (("a", "first sentence"), ("b", "second sentence"), ("c", "third sentence"))
    rules = (("AB", ("a", "b")), ("BA", ("b", "a")), ("C", ("c",)))
    texts = ["First sentence. Third sentence. Second sentence.", "second sentence; first sentence", "First sentence! first sentence."]
    df = spark.createDataFrame([(i, t, "en", "c") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: (r["licences"], r["sentence_ids"]) for r in L.licences(df, sentences, rules).collect()}
    assert got == {0: ("AB AND C", ",a,c,b,"), 1: ("BA", ",b,a,"), 2: ("", ",a,")}
