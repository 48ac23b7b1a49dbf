"""The automaton against regular expressions made of the same markup, and by hand."""

import random
import re

import duckdb
import pytest

from marlstone.llm import licenses
from marlstone.llm.licenses import Automaton
from marlstone.llm.words import TABLE

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def scan(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["license"] for r in licenses.license_scan(docs, **options).orderBy("doc_id").collect()]


def test_wording(spark):
    got = scan(spark, [
        MIT, MIT.replace("restriction", "any restriction"), MIT.replace("THE\nAUTHORS OR COPYRIGHT HOLDERS", "Some Company, Inc."),
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.", "under the MIT\n\nlicense, or under the mit license",
        "apache license version 2apache apache license version 2", None, "", "...", "SPDX-License-Identifier: GPL-3.0-or-later",
    ])
    assert [r["labels"] for r in got] == ["mit", "", "mit", "mit", "apache-2", "cc-by-nc", "gpl-3", "mit", "apache-2", "", "", "", "gpl-3"]
    assert [r["base_labels"] for r in got] == ["", "", "", "mit", "apache-2", "cc-by-nc", "", "mit", "apache-2", "", "", "", ""]
    assert (got[7]["n_base"], got[7]["first_word"], got[7]["last_word"]) == (2, 0, 5)
    assert (got[8]["n_base"], got[8]["first_word"], got[8]["last_word"]) == (1, 4, 4)
    assert [s.asDict() for s in got[0]["spans"]] == [{"label": "mit", "begin": 4, "end": got[0]["n_words"]}]
    assert (got[9]["n_words"], got[9]["first_word"], got[9]["score"]) == (0, None, 0.0)
    assert all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] > got[3]["score"] > 0


RULES = (
    ("a", "x <<var;max=2>> y <<beginOptional>>z <<beginOptional>>x<<endOptional>> y<<endOptional>> x"),
    ("b", "<<beginOptional>>y<<endOptional>> y z <<var;max=3>> z"),
    ("c", "z z"),
)


def pattern(template):
    return re.compile("(?=(" + licenses._pattern(template)[:-1] + ")(?: |$))")


@pytest.mark.parametrize("limit", [1 << 20, 5])
def test_against_expressions(limit):
    rng, machine = random.Random(2), Automaton({"x y": "p"}, RULES)
    for _ in range(300):
        words = [rng.choice("xyzw") for _ in range(rng.randint(0, 30))]
        line = "".join(f" {w}" for w in words)
        n, found = machine.scan(" ".join(words).encode(), limit)
        want = set()
        for r, t in enumerate(["x y", *(t for _, t in RULES)]):
            for m in pattern(t).finditer(line):
                want.add((r, m.start() // 2))
        assert n == len(words)
        assert {(r, b) for r, b, _ in found} == want
        # the longest end: every longer one is no match
        for r, b, e in found:
            whole = re.compile(licenses._pattern(["x y", *(t for _, t in RULES)][r])[:-1])
            ends = [k for k in range(b + 1, len(words) + 1) if whole.fullmatch("".join(f" {w}" for w in words[b:k]))]
            assert e == max(ends)


def test_long_text_in_pieces():
    filler = b"word " * 700_000
    low = MIT.encode()
    n, found = Automaton().scan(filler + low + b" " + filler + b"under the mit license")
    assert n == 1_400_000 + len(low.translate(TABLE).split()) + 4
    assert [b for r, b, _ in found if Automaton().rules[r].base] == [n - 4]
    assert (700_004) in [b for r, b, e in found if e - b > 100]


def test_markup_errors():
    for bad in ("a <<endOptional>>", "<<beginOptional>> a", "<<what>> a", "<<var;max=3>> a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            Automaton({}, (("l", bad),))


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, license string")
    assert licenses.license_scan(none).count() == 0
    docs = spark.createDataFrame([(1, "under the mit license", "x", "y")] * 2 + [(None, "a", None, None)], "doc_id long, text string, license string, labels string")
    got = licenses.license_scan(docs)
    assert got.columns == ["doc_id", "text", "labels", "license"] and got.where("license.labels = 'mit'").count() == 2


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(licenses.ORACLES["op12_license_scan"])
    got = licenses.op12_license_scan(spark, sf).select(*rel.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rel.fetchall(), key=str)
