import re
import textwrap

from packetloom.llm import licences as lc

SCHEMA = "doc_id long, text string, findings string, family string"


def test_held_out_and_anchors():
    model = lc.classifier()
    assert model.held_out > 0.95
    assert model.judge([])[0] == lc.NONE and model.judge([b"the", b"of"])[0] == lc.NONE


def test_notices():
    model = lc.classifier()
    filler = b"Thwhing onwh the haheble of oneawhwh in to, thon and ontion than reti therre the. " * 30
    for text, want in [(b"Released under the MIT License.", "MIT"), (b"Licensed under the Apache License, Version 2.0.", "Apache-2.0"), (b"LICENSED UNDER CC BY-NC 4.0.", "CC-BY-NC"),
                       (b"This work is licensed under the GNU General Public License, version 3.", "GPL"), (b"# SPDX-License-Identifier: MIT", "MIT"), (b"Published under CC BY-SA 4.0", "CC-BY-SA"),
                       (b"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "BSD")]:
        for around in (text, filler + text, text + b" " + filler, filler + text + b" " + filler):
            assert {f for _, _, f, *_ in model.scan(around)} == {want}, (text, model.scan(around))
    assert [f for _, _, f, *_ in model.scan(b"Distributed under the Kestrel Community License, version 2.")] == [lc.UNKNOWN]
    for text in (b"She renewed her driver license at the office.", b"the and of by any version use", b"", filler, "Überprüfung der Lizenz é".encode(), b"Free software is a matter of public interest."):
        assert model.scan(text) == []


def test_whole_table_against_its_license_lines(spark):
    import __spark_entry__ as e
    sf = "/root/testdata/sf0.01"
    lines = {"Released under the MIT License": "MIT", "Licensed under the Apache License, Version": "Apache-2.0", "under the GNU General Public License, version": "GPL", "Licensed under CC BY-NC": "CC-BY-NC"}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {i: ",".join(sorted({f for k, f in lines.items() if k in t})) for i, t in docs.items()}
    got = {r.doc_id: (r.licences, r.n_unknown, r.spans) for r in e.queries()["op8_licence_scan"](spark, sf).collect()}
    assert {i: g[0] for i, g in got.items()} == want and sum(map(bool, want.values())) > 5
    assert sum(g[1] for g in got.values()) == 0
    for i, (_, _, spans) in got.items():
        for s in filter(None, spans.split(",")):
            a, b = map(int, s.split(":")[1:])
            assert re.search("(?i)license|CC BY", docs[i][a:b])


def test_odd_rows(spark):
    rows = [(1, None, "f", "g"), (2, "", "f", "g"), (None, "é\nReleased under the MIT License.\n\nx", "f", "g"), (3, "w " * 300_000, "f", "g"), (3, "w", "f", "g")]
    got = lc.scan_licences(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and [(f.start, f.end, f.family) for r in got for f in r.findings] == [(2, 33, "MIT")]
    assert lc.scan_licences(spark.createDataFrame([], SCHEMA)).count() == 0


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.""",
    "GPL": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
}


def test_wrapped_notices():
    model = lc.classifier()
    prose = "Thwhing onwh the haheble of oneawhwh in to, thon and\nontion than reti therre the.\n" * 20
    for family, text in WRAPPED.items():
        for prefix in ("", " * ", "// ", "# ", "dnl "):
            for width in (None, 40):
                lines = text.split("\n") if width is None else [x for part in text.split("\n\n") for x in [*textwrap.wrap(" ".join(part.split()), width), ""]]
                notice = "\n".join(prefix + x for x in lines)
                for before, after in (("", ""), (prose, "\n" + prose), ("é\n\n", "\n\ncode()")):
                    found = [x for x in model.scan((before + notice + after).encode()) if x[2] != lc.UNKNOWN]
                    assert {x[2] for x in found} == {family}, (family, prefix, width, found)
                    start = len(before.encode())
                    assert all(start <= a < b <= start + len(notice) for a, b, *_ in found)
    assert {x[2] for x in model.scan(b"code\n\nDistributed under the Kestrel\nCommunity License, version 2.\n\ncode")} == {lc.UNKNOWN}
    assert [x[2] for x in model.scan(b"under the\nMIT License\n\nReleased under CC\nBY-SA 4.0")] == ["MIT", "CC-BY-SA"]
    assert model.scan(prose.encode()) == []
