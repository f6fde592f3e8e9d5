import os

import duckdb
import pytest

from geolattice.llm import licences as L

VARIANTS = ["Licensed under the Apache License, Version 2.0.", "LICENCED UNDER THE APACHE LICENCE V2.0", "  licensed -- under the \"Apache License\", ver. 2.0 ", "Licensed under the Apache License, version 2.0"]


def found(df):
    return sorted((r["doc_id"], r["part"], r["line_no"], r["licence"]) for r in df.collect())


def test_spellings_agree(spark, docs):
    rows = docs([(k, v) for k, v in enumerate(VARIANTS)])
    assert found(L.scan(rows, L.known(spark))) == sorted(x for k in range(len(VARIANTS)) for x in [(k, "document", 0, "Apache-2.0"), (k, "line", 1, "Apache-2.0")])


def test_lines_and_copyright(spark, docs):
    rows = docs([(1, "some text\nReleased under the MIT License.\nmore"), (2, "Copyright (c) 2020 A. Body\nReleased under the\nMIT License."), (3, "Released under the MIT Licenses of others"), (4, "(c) 1999 X\n© 2001 Y\nAll rights reserved.")])
    assert found(L.scan(rows, L.known(spark))) == [(1, "line", 2, "MIT"), (2, "document", 0, "MIT"), (4, "document", 0, "all-rights-reserved"), (4, "line", 3, "all-rights-reserved")]


def test_odd_rows(spark, odd, docs):
    assert found(L.scan(odd, L.known(spark))) == []
    assert found(L.scan(docs([]), L.known(spark))) == []
    twice = docs([(1, "All rights reserved"), (1, "All rights reserved")])
    assert found(L.scan(twice, L.known(spark))) == [(1, "document", 0, "all-rights-reserved")] * 2 + [(1, "line", 1, "all-rights-reserved")] * 2


def test_own_licences(spark, docs):
    mine = L.known(spark, [("House-1", "Use it\nwell."), ("House-0", "use it well")])
    assert found(L.scan(docs([(1, "USE IT WELL!"), (2, "use it")]), mine)) == [(1, "document", 0, "House-0"), (1, "line", 1, "House-0")]


LINES = ["Copyright (c) 2020 Jane Doe", "Copyright Jane Doe 2020", "Copyright the authors", "© 1999-2004, The Foo Project", "(C) Copyright 2001 X", "SPDX-FileCopyrightText: 2019 A. Body <a@b.org>", "Copyright 2003 Y\nPortions Copyright 2004 Z", "COPYRIGHT © Some Long Company Name, Incorporated, and its affiliates 2011"]


@pytest.mark.parametrize("line", LINES)
def test_whole_texts_with_any_copyright_line(spark, docs, line):
    from geolattice.llm.licence_texts import TEXTS

    mine = {"MIT": 3, "ISC": 1, "BSD-3-Clause": 2, "Zlib": 0}
    rows = []
    for k, (name, n) in enumerate(mine.items()):
        text = [t for a, t in TEXTS if a == name][n]
        rows.append((k, f"{line}\n\n{text.upper().replace(',', ';')}\n" if not n else text.replace("\n\n", f"\n\n{line}\n\n", 1)))
    got = found(L.scan(docs(rows), L.known(spark)))
    assert got == [(k, "document", 0, name) for k, name in enumerate(mine)]


def test_a_text_that_only_begins_like_a_licence(spark, docs):
    from geolattice.llm.licence_texts import TEXTS

    rows = docs([(k, t + " And more.") for k, (_, t) in enumerate(TEXTS)] + [(900 + k, t[:-30]) for k, (_, t) in enumerate(TEXTS)])
    assert [r for r in found(L.scan(rows, L.known(spark))) if r[1] == "document"] == []


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses"), reason="no licence texts here")
def test_digests_of_the_long_texts(spark, docs):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = [n for n in names if os.path.exists(f"/usr/share/common-licenses/{n}")]
    rows = []
    for k, n in enumerate(there):
        text = open(f"/usr/share/common-licenses/{n}", encoding="utf-8").read()
        rows += [(2 * k, text), (2 * k + 1, "Copyright 2021 Someone\n" + text.upper().replace("\n", "\r\n").replace("LICENSE", "LICENCE"))]
    got = found(L.scan(docs(rows), L.known(spark)))
    assert [r for r in got if r[1] == "document"] == [(j, "document", 0, names[there[j // 2]]) for j in range(len(rows))]


def test_same_as_sql(spark, docs, tmp_path):
    from geolattice.llm.licence_texts import TEXTS

    rows = [(k, f"{LINES[k % len(LINES)]}\n{t}") for k, (_, t) in enumerate(TEXTS)] + [(500 + k, f"{a}\nfoo\n{t}") for k, (a, t) in enumerate(L.NOTICES)] + [(700, None), (701, ""), (702, "copyright notice of it")]
    docs(rows).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(L.SQL).fetchall())
    assert found(L.query(spark, str(tmp_path))) == want and len(want) > len(TEXTS)
