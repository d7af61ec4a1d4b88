"""Licenses that texts carry in their usual forms."""

import duckdb
import pytest

from petrelspark.llm import licenses, oracles

HEAD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
SOURCE = "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
BINARY = "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
NAMED = "3. Neither the name of the University of Somewhere nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
ODD = "3. All advertising materials mentioning features of this software must display the following acknowledgement to the group.\n\n"
AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND\nANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED\nWARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED.'
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
CASES = {
    "bsd3": (HEAD + SOURCE + BINARY + NAMED + AS_IS, "BSD-3-Clause"), "bsd2": (HEAD + SOURCE + BINARY + AS_IS, "BSD-2-Clause"), "bsd4": (HEAD + SOURCE + BINARY + ODD + AS_IS, "UNMATCHED"),
    "bsd2 alone": (HEAD + SOURCE + BINARY, "BSD-2-Clause"), "mit": (MIT, "MIT"), "mit and more": (MIT + "\n\nIN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.", "MIT"),
    "spdx": ("# SPDX-License-Identifier: MIT\nimport os\n", "MIT"), "spdx c": ("/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;", "GPL-2.0-or-later"), "spdx two": ("// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}", "MIT OR Apache-2.0"),
    "spdx strange": ("# SPDX-License-Identifier: Beerware\n", "UNKNOWN"),
    "lgpl": ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "LGPL-2.1-or-later"),
    "agpl": ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "AGPL-3.0-or-later"),
    "isc": ('Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS"', "ISC"),
    "unlicense": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", "Unlicense"),
    "none": ("A text that says nothing of the kind.", ""), "null": (None, ""), "boost": ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)", "BSL-1.0"),
}


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES.values())], "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_license(scanned, name):
    got = scanned[list(CASES).index(name)]
    assert got["licenses"] == CASES[name][1], got


def test_against_sql_on_usual_forms(scanned):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, t) for k, (t, _) in enumerate(CASES.values())])
    want = con.execute(oracles.ORACLES["op7_license_rules"]).df().set_index("doc_id")
    for k, r in scanned.items():
        assert tuple(want.loc[k][["sentence_ids", "licenses", "n_sentences"]]) == (r["sentence_ids"], r["licenses"], r["n_sentences"]), list(CASES)[k]


def test_no_documents(spark):
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
