import random
from collections import Counter

from made_texts import prose

from tidemark.llm import licences
from tidemark.llm.licence_texts import FULL, HEADERS

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/c/x.py", "print(1)"),
    (3, "a/b/NOTICE.txt", "line\nLicensed under the Apache License, Version 2.0.\nmore"),
    (4, "a/y.py", None),
    (5, "a/b/z.py", "This work is licensed under the GNU General Public License, version 3.\ncode"),
    (6, "q/x.py", ""),
    (7, None, "Released under the MIT License."),
    (8, "ab/x.py", "no"),
    (9, "q/LICENSE", "All rights are kept; this licence has words of its own and no others at all."),
    (10, "top.py", "x" * 100_000),
    (1, "a/LICENSE", "Released under the MIT License."),
    (11, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
]


def test_own_statement_then_nearest_directory(spark):
    files = spark.createDataFrame([(*f, "x", 0.5) for f in FILES],
                                  "doc_id bigint, path string, text string, licence string, similarity double")
    got = Counter((r.doc_id, r.licence, r.found) for r in licences.scan(files, "doc_id").collect())
    assert got == Counter([
        (1, "MIT", "file"), (1, "MIT", "file"), (2, "Apache-2.0", "inherited"), (3, "Apache-2.0", "file"), (4, "MIT", "inherited"),
        (5, "GPL-3.0", "header"), (6, None, None), (7, "MIT", "header"), (8, None, None), (9, None, None), (10, None, None),
        (11, "Apache-2.0", "file")])
    assert licences.scan(files.limit(0), "doc_id").count() == 0


def test_no_python_in_the_plan(spark):
    files = spark.createDataFrame(FILES, "doc_id bigint, path string, text string")
    plan = licences.scan(files, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("Python", "Pandas", "Arrow"))


def test_full_texts_headers_and_identifiers(spark):
    rng = random.Random(6)
    around = lambda text: f"{prose(rng, 150)} {text} {prose(rng, 150)}"
    rows, want = [], {}
    for name, text in FULL:
        rows += [(f"f/{name}/LICENSE", f"Copyright (c) 2020 Ann Smith\n\n{text}"), (f"f/{name}/a.py", "print(1)")]
        want |= {f"f/{name}/LICENSE": (name, "file"), f"f/{name}/a.py": (name, "inherited")}
    for k, (name, text) in enumerate(HEADERS):
        rows.append((f"h{k}/a.py", f"# Copyright 2020 Ann Smith\n{text}\n{prose(rng, 300)}"))
        want[f"h{k}/a.py"] = (name, "header")
    for k, (name, text) in enumerate(licences.TEMPLATES):
        rows.append((f"l{k}/a.py", around(text)))
        want[f"l{k}/a.py"] = (name, "header")
    rows += [("s/a.py", "// SPDX-License-Identifier: MIT\ncode"), ("s/b.py", "SPDX-License-Identifier: GPL-3.0-or-later"),
             ("s/c.py", "SPDX-License-Identifier: Zlib"), ("s/d.py", around("copyright of the letters"))]
    want |= {"s/a.py": ("MIT", "header"), "s/b.py": ("GPL-3.0", "header"), "s/c.py": (None, None), "s/d.py": (None, None)}
    files = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, path string, text string")
    got = {r.path: (r.licence, r.found) for r in licences.scan(files, "doc_id").collect()}
    assert {p: (got[p], w) for p, w in want.items() if got[p] != w} == {}
