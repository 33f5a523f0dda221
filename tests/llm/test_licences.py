"""Headers, licence files, nearest directory; against a plain loop on the documents."""

import re

from pyspark.sql import Row

from procatlas.llm import licences


def scan(spark, rows):
    files = spark.createDataFrame([(p, t, "x", "y", 0.1) for p, t in rows], "path string, text string, licence string, folder string, cosine double")
    return {(r.path, r.licence, r.origin, r.licence_path) for r in licences.scan(files).collect()}


FILLER = "words of a file that says nothing at all about its terms\n" * 4


def test_headers_and_inheritance(spark):
    rows = [("LICENSE", "Released under the MIT License."), ("a.txt", FILLER), ("lib/a.txt", FILLER),
            ("lib/sub/COPYING", FILLER + "This work is licensed under the GNU General Public License, version 3."),
            ("lib/sub/deep/er/b.txt", FILLER), ("lib/sub/c.txt", FILLER + "# Licensed under the Apache License, Version 2.0.\n" + FILLER),
            ("lib/sub/d.txt", "All rights reserved.\n" + FILLER), ("lib/subway/e.txt", FILLER), ("lib/sub/f.txt", "we love our licence to kill and our car licenses"),
            ("lib/g.txt", "Intro. Licensed under CC BY-NC 4.0. " + FILLER), (None, "Released under the MIT License."), ("lib/h.txt", None), ("lib/i.txt", ""),
            ("lib/i.txt", "")]
    assert scan(spark, rows) == {
        ("LICENSE", "MIT", "header", None), ("a.txt", "MIT", "directory", "LICENSE"), ("lib/a.txt", "MIT", "directory", "LICENSE"),
        ("lib/sub/COPYING", "GPL-3.0", "header", None), ("lib/sub/deep/er/b.txt", "GPL-3.0", "directory", "lib/sub/COPYING"),
        ("lib/sub/c.txt", "Apache-2.0", "header", None), ("lib/sub/d.txt", "Proprietary", "header", None), ("lib/subway/e.txt", "MIT", "directory", "LICENSE"),
        ("lib/sub/f.txt", "GPL-3.0", "directory", "lib/sub/COPYING"), ("lib/g.txt", "CC-BY-NC-4.0", "header", None), (None, None, None, None),
        ("lib/h.txt", "MIT", "directory", "LICENSE"), ("lib/i.txt", "MIT", "directory", "LICENSE")}


def test_ties_long_and_empty(spark):
    assert scan(spark, []) == set()
    rows = [("d/LICENSE.b", "Released under the MIT License."), ("d/LICENSE.a", "Released under the MIT License."), ("d/x", "z" * 300_000),
            ("e/LICENSE", "Licensed under CC BY 4.0.\n" * 5000), ("f/y", "no licence"), ("/abs/z", "Licensed under the BSD 3-Clause License")]
    got = scan(spark, rows)
    assert ("d/x", "MIT", "directory", "d/LICENSE.a") in got and ("e/LICENSE", "CC-BY-4.0", "header", None) in got
    assert ("f/y", None, None, None) in got and ("/abs/z", "BSD-3-Clause", "header", None) in got


def test_documents_against_a_loop(spark):
    from procatlas.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    lines = [(r"Licensed under CC BY-NC 4\.0", "CC-BY-NC-4.0"), (r"licensed under the GNU General Public License, version 3", "GPL-3.0"),
             (r"Licensed under the Apache License, Version 2\.0", "Apache-2.0"), (r"Released under the MIT License", "MIT"), (r"All rights reserved", "Proprietary")]
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want[r.doc_id] = {k for p, k in lines if re.search(p, r.text or "")}
    got = QUERIES["op10_licences"](spark, sf)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        if want[r.doc_id]:
            assert r.licence in want[r.doc_id] and r.origin == "header"
        else:
            assert r.origin != "header"


def test_null_and_negative_ids(spark, tmp_path):
    from procatlas.llm.queries import QUERIES

    rows = [(None, FILLER, "s", "x7"), (None, "Released under the MIT License.\n" + FILLER, "s", "x7"), (None, None, "s", None),
            (-5, "Licensed under the Apache License, Version 2.0\n" + FILLER, "s", "en"), (5, FILLER, "s", "en"), (6, FILLER, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_licences"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "path", "licence", "origin", "cosine", "licence_path"]
    found = sorted(((r.doc_id, r.licence, r.origin) for r in got.collect()), key=repr)
    assert found == sorted([(None, None, None), (None, "MIT", "header"), (None, None, None), (-5, "Apache-2.0", "header"), (5, None, None),
                            (6, None, None)], key=repr)


def test_labels_and_wrapped_headers(spark):
    gpl = (" * This program is free software; you can redistribute it and/or modify\n"
           " * it under the terms of the GNU General Public License as published by\n"
           " * the Free Software Foundation{} either version {} of the License, or\n * (at your option) any later version.\n")
    rows = {"a.c": ("// SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0"), "b.c": ("/* SPDX-License-Identifier: GPL-3.0-or-later */\n", "GPL-3.0"),
            "c.py": ("# SPDX-License-Identifier: MIT OR Apache-2.0\n", "MIT"), "d.md": ("License: CC BY 4.0\n", "CC-BY-4.0"),
            "e.md": ("Licence: MIT\n", "MIT"), "f.md": ("License: see the other file\n", None), "g.c": ("// SPDX-License-Identifier: WTFPL\n", None),
            "h.c": (gpl.format(";", 2), "GPL-2.0"), "i.c": (gpl.format(",", 3), "GPL-3.0"),
            "j.txt": ("This work is licensed under the\nGNU General Public License, version 3\n", "GPL-3.0"),
            "k.txt": ("# Licensed under the Apache License,\n# Version 2.0\n", "Apache-2.0"), "l.txt": ("Copyright MIT 2003\n", None),
            "m.md": ("Our car license: fine\n", None)}
    got = {p: licence for p, licence, _, _ in scan(spark, [(f"{p}/{p}", t + FILLER) for p, (t, _) in rows.items()])}
    assert got == {f"{p}/{p}": want for p, (_, want) in rows.items()}
    below = scan(spark, [("p/LICENSE", "SPDX-License-Identifier: MPL-2.0"), ("p/q/x.txt", FILLER)])
    assert ("p/q/x.txt", "MPL-2.0", "directory", "p/LICENSE") in below


def test_every_position(spark):
    """Labels at any column, templates without a licence word, statements over many lines, before and inside other words."""
    other = " ".join(f"word{k}" for k in range(60))
    rows = {"a.c": (" " * 60 + "// SPDX-License-Identifier: MIT\n", "MIT"), "b.c": (f"{other} License: ISC\n", "ISC"),
            "c.c": ("license: unknown, License: MPL-2.0\n", "MPL-2.0"),
            "d.c": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and files\n", "MIT"),
            "e.c": ("This work\nis licensed\nunder the\nGNU General\nPublic\nLicense,\nversion 3\n", "GPL-3.0"),
            "f.c": ("under the terms of the GNU Lesser General Public\nLicense as published by the Free\nSoftware Foundation, either version\n3 of the License, or\n", "LGPL-3.0"),
            "g.c": (f"{other} Released under the MIT License {other}\n", "MIT"), "h.c": (f"{other} all was well and rights were kept {other}\n", None),
            "i.c": ("This is free and\r\nunencumbered\r\nsoftware released into\r\nthe public domain\r\n", "Unlicense"),
            "j.c": ("This work is\n\nGNU General\n\nversion 3\n", None)}
    got = {p: licence for p, licence, _, _ in scan(spark, [(f"{p}/{p}", t + "\n" + FILLER) for p, (t, _) in rows.items()])}
    assert got == {f"{p}/{p}": want for p, (_, want) in rows.items()}


def test_only_statements_below_the_threshold_are_left_out(spark):
    rows = [Row(template=0, term=t, tf=1, w=w, idf=w) for t, w in (("the", 1.0), ("mit", 5.0), ("license", 4.0), ("under", 2.0))]
    telling = licences.Telling(rows, 0.6)
    norm = sum(r.w ** 2 for r in rows) ** 0.5
    rest = [r.w for r in rows if r.term not in telling.lengths]
    assert rest and sum(w * w for w in rest) ** 0.5 / norm < 0.6
    assert set(licences.Telling(rows, 0.0).lengths) == {r.term for r in rows}
