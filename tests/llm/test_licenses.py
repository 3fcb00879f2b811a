import textwrap
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radiolake.llm import licenses
from radiolake.llm.checks import license_sql
from tests.llm.helpers import docs_table


def canonical(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r.c for r in df.select(F.array_join(licenses.canonical_lines(F.col("t")), " ").alias("c")).collect()]


def test_equivalent_forms_are_one(spark):
    forms = canonical(
        spark,
        "Licensed under the Apache License, Version 2.0.",
        "  licensed UNDER the\n Apache Licence; version 2.0",
        "Copyright (c) 2020 Somebody\nLicensed under the Apache License v2.0",
        "© 1999\n(C) x\n# Licensed under the Apache License, ver. 2.0 #",
    )
    assert len(set(forms)) == 1
    assert canonical(spark, None, "", "Copyright 2020 A. B.", "...") == ["", "", "", ""]


def test_whole_texts_and_lines(spark):
    texts = [
        "Text here.\nLicensed under CC BY-NC 4.0.\nMore.\nlicensed under cc by-nc 4.0",
        "Released under the MIT License.",
        "Copyright (c) 2001 Me\nreleased under the mit licence",
        "Released under the MIT License. And more on the same line.",
        None,
        "",
        "Copyright 2020",
        "a\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.",
    ]
    docs = docs_table(spark, texts).withColumnRenamed("lang", "license_id")
    for small in (True, False):
        rows = {r.doc_id: r for r in licenses.scan(docs, licenses.known_notices(spark), small=small).collect()}
        assert [rows[i].license_ids for i in range(8)] == [
            ["CC-BY-NC-4.0"], ["MIT"], ["MIT"], [], [], [], [], ["GPL-3.0-only", "MIT"],
        ]
        assert [rows[i].whole_license for i in range(8)] == [None, "MIT", "MIT"] + [None] * 5
        assert [rows[i].n_lines for i in range(8)] == [1, 1, 1, 0, 0, 0, 0, 2]


def test_known_texts_of_many_lines_ties_and_empty_tables(spark):
    known = spark.createDataFrame([("B", "First line,\nsecond line."), ("A", "first line second LINE"), ("C", None)], "license_id string, text string")
    docs = docs_table(spark, ["FIRST LINE -\nsecond line\n", "FIRST LINE -\nsecond line\n", "first line"], [1, 1, None])
    rows = sorted(map(tuple, licenses.scan(docs, known).select("doc_id", "whole_license").collect()), key=str)
    assert rows == [(1, "A"), (None, None)]
    assert licenses.scan(docs.where("doc_id = 9"), known).count() == 0
    assert licenses.scan(docs, known.where("license_id = 'Z'")).count() == 2


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""

APACHE = """# Copyright 2020 Some Body
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
TEXTS = Path("/usr/share/common-licenses")
FILES = {"GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "LGPL-2.1": "LGPL-2.1"}


def scanned(spark, texts):
    found = licenses.scan(docs_table(spark, texts), licenses.known_digests(spark), small=True)
    return sorted((r.doc_id, r.whole_license, ",".join(r.license_ids), r.n_lines) for r in found.collect())


def by_sql(texts):
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype="object")})  # noqa: F841
    names = "doc_id, whole_license, license_ids, n_lines"
    return sorted(duckdb.sql(f"SELECT {names} FROM ({license_sql()})").fetchall())


def test_headers_wrapped_anew_and_whole_mit(spark):
    flat = " ".join(x.strip("# ") for x in APACHE.split("\n")[2:5])
    rewrapped = "\n".join(" * " + x for x in textwrap.wrap(flat, 40))
    texts = [
        APACHE + "\nimport this\n",
        "/*\n * Copyright (C) 1999 X\n" + rewrapped + "\n *\n *   http://www.apache.org/licenses/LICENSE-2.0\n */\nint x;",
        "MIT License\n\nCopyright (c) 2020 Me\n\n" + MIT,
        MIT.upper(),
        "Read me first.\n\n" + MIT + "\nThe end.",
        APACHE.replace("except in", "even without"),
        None,
        "",
        "\n \n\n",
        "one line\nof many\n\nwords",
        "\n".join(["a b", ""] * 20000),
    ]
    got = scanned(spark, texts)
    assert got == by_sql(texts)
    assert [r[1:3] for r in got[:6]] == [
        (None, "Apache-2.0"), (None, "Apache-2.0"), ("MIT", "MIT"), ("MIT", "MIT"), (None, "MIT"), (None, ""),
    ]
    assert all(r[2] == "" for r in got[6:])


def broken(line):
    """The line in pieces of about 40 characters; a line that may count as a copyright line stays."""
    return [line] if "opyright" in line or "(c)" in line else textwrap.wrap(line, 40, break_on_hyphens=False, break_long_words=False)


@pytest.mark.skipif(not TEXTS.exists(), reason="no licence texts on this machine")
def test_whole_licences(spark):
    texts = []
    for name in FILES:
        text = (TEXTS / name).read_text(encoding="utf-8")
        texts += [text, "\n".join("> " + x for line in text.split("\n") for x in broken(line)).upper()]
    texts.append(texts[0].replace("freedom", "fredom", 1))
    got = scanned(spark, texts)
    assert got == by_sql(texts)
    assert [r[1] for r in got] == [i for i in FILES.values() for _ in range(2)] + [None]
