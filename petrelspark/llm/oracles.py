"""DuckDB SQL for the rows of the queries that SQL can express on whole tables."""

from __future__ import annotations

import re

OP9 = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, arg_max(doc_id, (n, -doc_id)) AS keep_id FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Known sentences in words, notices as written, and rules in order, stated here anew so that a slip in the operator's shows.
OP7_SENTENCES = [
    ('licensed under the apache license version 2 0', 'ApacheRef'),
    ('licensed under the apache license version 2 0 the license', 'ApacheRef'),
    ('you may not use this file except in compliance with the license', 'ApacheUse'),
    ('you may obtain a copy of the license at http www apache org licenses license 2 0', 'ApacheUrl'),
    ('released under the mit license', 'MitRef'),
    ('licensed under the mit license', 'MitRef'),
    ('this software is released under the mit license', 'MitRef'),
    ('permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions', 'MitGrant'),
    ('the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software', 'MitNotice'),
    ('the software is provided as is without warranty of any kind', 'AsIs'),
    ('redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', 'BsdPre'),
    ('redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer', 'BsdSource'),
    ('redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution', 'BsdBinary'),
    ('neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission', 'BsdEndorse'),
    ('this software is provided by the copyright holders and contributors as is', 'BsdAsIs'),
    ('released under the bsd license', 'BsdRef'),
    ('licensed under the bsd 3 clause license', 'Bsd3Ref'),
    ('this work is licensed under the gnu general public license version 2', 'Gpl2Ref'),
    ('this work is licensed under the gnu general public license version 3', 'Gpl3Ref'),
    ('licensed under the gnu general public license version 2', 'Gpl2Ref'),
    ('licensed under the gnu general public license version 3', 'Gpl3Ref'),
    ('this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version', 'Gpl2Plus'),
    ('this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version', 'Gpl3Plus'),
    ('this program is distributed in the hope that it will be useful but without any warranty', 'GplHope'),
    ('this source code form is subject to the terms of the mozilla public license v 2 0', 'MplRef'),
    ('if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0', 'MplUrl'),
    ('licensed under cc by 4 0', 'CcByRef'),
    ('licensed under cc by sa 4 0', 'CcBySaRef'),
    ('licensed under cc by nc 4 0', 'CcByNcRef'),
    ('this work is licensed under a creative commons attribution 4 0 international license', 'CcByRef'),
    ('this work is licensed under a creative commons attribution sharealike 4 0 international license', 'CcBySaRef'),
    ('all rights reserved', 'AllRights'),
    ('You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0', 'ApacheUrl'),
    ('You may obtain a copy of the License at\n\nhttps://www.apache.org/licenses/LICENSE-2.0', 'ApacheUrl'),
    ('You may obtain a copy of the License at: http://www.apache.org/licenses/LICENSE-2.0', 'ApacheUrl'),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', 'AsIs'),
    ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.', 'BsdAsIs'),
    ('This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.', 'Gpl2Plus'),
    ('This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.', 'Gpl3Plus'),
    ('This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.', 'Gpl3Plus'),
    ('This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.', 'MplRef'),
    ('If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.', 'MplUrl'),
    ('This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.', 'Lgpl21Plus'),
    ('This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.', 'Lgpl3Plus'),
    ('This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.', 'Lgpl3Plus'),
    ('This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.', 'Agpl3Plus'),
    ('This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.', 'Agpl3Ref'),
    ('This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.', 'GplHope'),
    ('This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.', 'GplHope'),
    ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.', 'IscGrant'),
    ('Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.', 'IscGrant'),
    ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.', 'ZeroBsdGrant'),
    ('This is free and unencumbered software released into the public domain.', 'UnlicenseDomain'),
    ('Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.', 'UnlicenseFree'),
    ('Distributed under the Boost Software License, Version 1.0.', 'BoostRef'),
    ('This software is provided \'as-is\', without any express or implied warranty.', 'ZlibAsIs'),
    ('Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:', 'ZlibGrant'),
    ('This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0', 'Epl1Ref'),
    ('This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0', 'Epl2Ref'),
    ('Licensed under the Apache License, Version 2.0 or the MIT license, at your option.', 'MitOrApache'),
    ('Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.', 'BsdEndorse'),
    ('The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.', 'BsdEndorse'),
    ('To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.', 'Cc0Waiver'),
]
OP7_RULES = """
    MIT: MitGrant MitNotice AsIs; MIT: MitGrant MitNotice; MIT: MitRef; BSD-3-Clause: BsdPre BsdSource BsdBinary BsdEndorse BsdAsIs;
    BSD-3-Clause: BsdPre BsdSource BsdBinary BsdEndorse; BSD-2-Clause: BsdPre BsdSource BsdBinary BsdAsIs; UNMATCHED: BsdPre BsdSource BsdBinary Other; BSD-2-Clause: BsdPre BsdSource BsdBinary; BSD-3-Clause: Bsd3Ref;
    BSD: BsdRef; Apache-2.0: ApacheRef ApacheUse ApacheUrl; Apache-2.0: ApacheRef; GPL-2.0-or-later: Gpl2Plus GplHope;
    GPL-2.0-or-later: Gpl2Plus; GPL-3.0-or-later: Gpl3Plus GplHope; GPL-3.0-or-later: Gpl3Plus; GPL-2.0-only: Gpl2Ref;
    GPL-3.0-only: Gpl3Ref; MPL-2.0: MplRef MplUrl; MPL-2.0: MplRef; CC-BY-SA-4.0: CcBySaRef;
    CC-BY-NC-4.0: CcByNcRef; CC-BY-4.0: CcByRef;
    ISC: IscGrant AsIs; ISC: IscGrant; 0BSD: ZeroBsdGrant; Unlicense: UnlicenseDomain UnlicenseFree; Unlicense: UnlicenseDomain; BSL-1.0: BoostRef; Zlib: ZlibAsIs ZlibGrant; EPL-1.0: Epl1Ref; EPL-2.0: Epl2Ref; LGPL-2.1-or-later: Lgpl21Plus GplHope; LGPL-2.1-or-later: Lgpl21Plus; LGPL-3.0-or-later: Lgpl3Plus GplHope; LGPL-3.0-or-later: Lgpl3Plus; AGPL-3.0-or-later: Agpl3Plus GplHope; AGPL-3.0-or-later: Agpl3Plus; AGPL-3.0-only: Agpl3Ref GplHope; AGPL-3.0-only: Agpl3Ref; MIT OR Apache-2.0: MitOrApache; CC0-1.0: Cc0Waiver;
"""
OP7_SPDX = [
    ('MIT', 'MIT'),
    ('Apache-2.0', 'Apache-2.0'),
    ('BSD-2-Clause', 'BSD-2-Clause'),
    ('BSD-3-Clause', 'BSD-3-Clause'),
    ('0BSD', '0BSD'),
    ('ISC', 'ISC'),
    ('Zlib', 'Zlib'),
    ('BSL-1.0', 'BSL-1.0'),
    ('Unlicense', 'Unlicense'),
    ('CC0-1.0', 'CC0-1.0'),
    ('CC-BY-4.0', 'CC-BY-4.0'),
    ('CC-BY-SA-4.0', 'CC-BY-SA-4.0'),
    ('GPL-2.0', 'GPL-2.0'),
    ('GPL-2.0-only', 'GPL-2.0-only'),
    ('GPL-2.0-or-later', 'GPL-2.0-or-later'),
    ('GPL-3.0', 'GPL-3.0'),
    ('GPL-3.0-only', 'GPL-3.0-only'),
    ('GPL-3.0-or-later', 'GPL-3.0-or-later'),
    ('LGPL-2.1', 'LGPL-2.1'),
    ('LGPL-2.1-only', 'LGPL-2.1-only'),
    ('LGPL-2.1-or-later', 'LGPL-2.1-or-later'),
    ('LGPL-3.0', 'LGPL-3.0'),
    ('LGPL-3.0-only', 'LGPL-3.0-only'),
    ('LGPL-3.0-or-later', 'LGPL-3.0-or-later'),
    ('AGPL-3.0', 'AGPL-3.0'),
    ('AGPL-3.0-only', 'AGPL-3.0-only'),
    ('AGPL-3.0-or-later', 'AGPL-3.0-or-later'),
    ('MPL-2.0', 'MPL-2.0'),
    ('EPL-1.0', 'EPL-1.0'),
    ('EPL-2.0', 'EPL-2.0'),
    ('WTFPL', 'WTFPL'),
    ('MIT OR Apache-2.0', 'MIT OR Apache-2.0'),
    ('Apache-2.0 OR MIT', 'MIT OR Apache-2.0'),
]


def op7() -> str:
    """A break of the laid-out text is doubled, so that each of two neighbouring sentences has one on its side."""
    steps = [(r"\n[^a-z0-9]*\n[^a-z0-9]*", "P"), (r"\n[^a-z0-9P]*", "\n"), (r"[.!?;:]+(\s|$)", r"S\1"), (r"\n", "L"), (r"[^a-z0-9SLP]+", " "), (r"S[ S]*", "S"), (r" ?S?P", "P"), (r" ?SL?", "S"), (r" ?L", "L")]

    def keyed(s: str) -> str:
        s = s.lower()
        for pattern, by in steps:
            s = re.sub(pattern, by, s, flags=re.ASCII)
        return s.strip(" SLP")

    laid = "low"
    for pattern, by in steps:
        laid = f"regexp_replace({laid}, '{pattern}', {'chr(10)' if by == chr(10) else _text(by)}, 'g')"
    keys = {keyed(s): i for s, i in OP7_SENTENCES} | {keyed("SPDX-License-Identifier: " + x): f"Spdx{n}" for n, (x, _) in enumerate(OP7_SPDX)}
    word = "(?: |L)[a-z0-9]+"
    slots = [
        (f"neither( |L)the( |L)names?( |L)of(?:{word}){{1,16}}?( |L)nor( |L)the( |L)names( |L)of( |L)(its|their|any)( |L)contributors", "neither the name of the copyright holder nor the names of its contributors"),
        (f"this( |L)software( |L)is( |L)provided( |L)by(?:{word}){{1,12}}?( |L)as( |L)is( |L)and( |L)any", "this software is provided by the copyright holders and contributors as is and any"),
        (f"the( |L)authors?(?:{word}){{0,8}}?( |L)(has|have)( |L)waived", "the author has waived"),
    ]
    laid = f"trim({laid})"
    for pattern, by in slots:
        laid = f"regexp_replace({laid}, '{pattern}', '{by}', 'g')"
    breaks = {" ": "(?: |LL)", "S": "(?: |LL|SS)", "P": "(?: |LL|SS|PP)"}
    some = "|".join("".join(breaks.get(c, c) for c in k) for k in sorted(keys, key=len, reverse=True))
    known = ", ".join(f"({_text(re.sub('[SLP]', ' ', k))}, {_text(i)})" for k, i in keys.items())
    read = "seq"
    for rule in OP7_RULES.replace("\n", " ").split(";"):
        if rule.strip():
            name, ids = rule.strip().split(": ")
            read = f"replace({read}, '{''.join(f',{i},' for i in ids.split(' '))}', '={name}=')"
    for n, (_, name) in enumerate(OP7_SPDX):
        read = f"replace({read}, ',Spdx{n},', '={name}=')"
    read = f"replace({read}, ',Other,', '')"
    mention = "licen[sc]e|permission|copyright|redistribut|warranty|software|mpl|rights reserved"
    return rf"""
WITH known(sentence, id) AS (SELECT DISTINCT * FROM (VALUES {known}) v(a, b)),
cut AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
out AS (SELECT doc_id, low, 'P' || regexp_replace({laid}, '([SLP])', '\1\1', 'g') || 'P' AS t FROM cut WHERE regexp_matches(low, '{mention}')),
hit AS (SELECT doc_id, string_split(regexp_replace(t, '[SLP]({some})[SLP]', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS h FROM out),
part AS (SELECT doc_id, generate_subscripts(h, 1) AS k, unnest(h) AS p FROM hit),
told AS (SELECT doc_id, k, CASE WHEN k % 2 = 0 THEN id WHEN regexp_matches(p, '[a-z][a-z0-9]*( |LL)[a-z0-9]+( |LL)[a-z0-9]+') THEN 'Other' END AS id FROM part LEFT JOIN known ON sentence = regexp_replace(p, '(SS|LL|PP)', ' ', 'g')),
seqs AS (SELECT doc_id, string_agg(id, ',' ORDER BY k) FILTER (id <> 'Other') AS sentence_ids, string_agg(',' || id || ',', '' ORDER BY k) AS seq, nullif(count(*) FILTER (id <> 'Other'), 0) AS n FROM told WHERE id IS NOT NULL GROUP BY doc_id),
ruled AS (SELECT doc_id, sentence_ids, n, {read} AS r FROM seqs),
named AS (SELECT doc_id, sentence_ids, n, r, regexp_extract_all(r, '=([^=,]+)=', 1) AS hits FROM ruled),
uniq AS (SELECT *, list_filter(hits, lambda x, i: list_position(hits, x) = i) AS names FROM named)
SELECT c.doc_id, coalesce(sentence_ids, '') AS sentence_ids,
  CASE WHEN n IS NULL THEN CASE WHEN regexp_matches(low, 'licen[sc]e') THEN 'UNKNOWN' ELSE '' END
    WHEN regexp_matches(r, ',[A-Za-z0-9]+,') AND NOT list_contains(names, 'UNMATCHED') THEN array_to_string(list_append(names, 'UNMATCHED'), ',') ELSE array_to_string(names, ',') END AS licenses,
  CAST(coalesce(n, 0) AS BIGINT) AS n_sentences
FROM cut c LEFT JOIN uniq USING (doc_id)
"""


def op3() -> str:
    value = {
        "word_length": "word_chars * 1000000 // greatest(n_words, 1)", "symbol_rate": "(n_symbols + 1) * 1000000 // (n_words + 1)",
        "repeat_rate": "(n_repeat_words + 1) * 1000000 // (n_words + 1)", "dup_line_rate": "(n_dup_lines + 1) * 1000000 // (n_lines + 8)",
    }
    low_bits = "greatest(length(bin(value)) - 10, 0)"
    reach = "CASE side.measure WHEN 'word_length' THEN 5 WHEN 'symbol_rate' THEN 4 WHEN 'repeat_rate' THEN 3 WHEN 'dup_line_rate' THEN 4 END"
    times = lambda q, n: f"{q}{f' * ({q} / q50)' * n}"

    def quart(name: str, by: str) -> str:
        keys = ", ".join(x for x in (by, "measure") if x)
        least = ", ".join(f"CAST(min(CASE WHEN 100 * upto >= {q} * total THEN greatest(bucket, 1) END) AS DOUBLE) AS q{q}" for q in (25, 50, 75))
        return f"""{name}_s AS (SELECT {keys}, bucket, sum(n) AS n FROM fine GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM {name}_s),
{name}_q AS (SELECT {keys}, CAST(max(total) AS BIGINT) AS n, {least} FROM {name}_r GROUP BY {keys})"""

    def drawn(keys: str, a: str, b: str, on: str) -> str:
        q = ", ".join(f"({a}.n * {a}.q{k} + 50 * {b}.q{k}) / ({a}.n + 50) AS q{k}" for k in (25, 50, 75))
        return f"SELECT {keys}, {a}.measure, {a}.n, {q} FROM {a} JOIN {b} ON {a}.measure = {b}.measure{on}"

    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS k, w FROM d),
tri AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS t FROM win),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT k + j) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
raw AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS measure, {sql} AS value FROM m" for m, sql in value.items())}),
v AS (SELECT doc_id, lang, source, measure, (value >> {low_bits}) << {low_bits} AS value FROM raw),
fine AS (SELECT lang, source, measure, value AS bucket, count(*) AS n FROM v GROUP BY ALL),
{quart("o", "lang, source")},
{quart("g", "lang")},
{quart("e", "")},
gd AS ({drawn("g_q.lang", "g_q", "e_q", "")}),
side AS ({drawn("o_q.lang, o_q.source", "o_q", "gd", " AND o_q.lang IS NOT DISTINCT FROM gd.lang")}),
bad AS (
  SELECT v.doc_id, bool_or(v.value > CASE {reach} WHEN 3 THEN {times("q75", 3)} WHEN 4 THEN {times("q75", 4)} WHEN 5 THEN {times("q75", 5)} END OR (v.measure = 'word_length' AND v.value < {times("q25", 8)})) AS failed
  FROM v JOIN side ON v.lang IS NOT DISTINCT FROM side.lang AND v.source IS NOT DISTINCT FROM side.source AND v.measure = side.measure GROUP BY v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT failed AS kept
FROM m JOIN bad USING (doc_id)
"""


ORACLES = {"op3_adaptive_quality": op3(), "op7_license_rules": op7(), "op9_exact_dedup": OP9}

OP11 = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""

#: CRC-32 of an ASCII text: eight steps of the division for each character.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * len({s})), lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii({s}[i // 8 + 1]) AS BIGINT) ELSE 0 END)), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"

OP12 = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id),
s AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM n),
h AS (SELECT conv_id, {_CRC.format(s="s")} % 9 AS h FROM s),
c AS (SELECT n.conv_id, n.conv_id - n.conv_id % 5 AS base, h, least(h, coalesce(b.own, 0)) AS taken FROM n JOIN h USING (conv_id) LEFT JOIN n b ON b.conv_id = n.conv_id - n.conv_id % 5),
r AS (
  SELECT c.conv_id, t.pos AS d, said, bytes FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos - c.h + c.taken, said, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
m AS (SELECT conv_id, max(d) AS n FROM r GROUP BY conv_id),
p AS (SELECT conv_id, d, bytes, sha256(list(said) OVER w :: VARCHAR) AS digest FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
g AS (SELECT p.d, p.digest, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.bytes) AS bytes, coalesce(string_agg(p.conv_id, ',' ORDER BY p.conv_id) FILTER (p.d = coalesce(m.n, 0)), '') AS ends FROM p LEFT JOIN m USING (conv_id) GROUP BY p.d, p.digest),
up AS (SELECT g.d, g.digest, u.digest AS parent FROM g JOIN p u ON u.conv_id = g.conv_id AND u.d = g.d - 1),
k AS (SELECT d - 1 AS d, parent AS digest, count(*) AS n_children FROM up GROUP BY ALL),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * bytes AS saved FROM g LEFT JOIN k USING (d, digest)),
below AS (SELECT a.d, a.digest, sum(v.leaf) AS n_leaves, sum(v.saved) AS saved_tokens FROM v JOIN p a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN below USING (d, digest) LEFT JOIN up USING (d, digest) LEFT JOIN g o ON o.d = v.d - 1 AND o.digest = up.parent
"""


def _op13(rounds: int = 3, k: int = 16) -> str:
    parts = [
        "v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM v QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= {k})",
    ]
    near = lambda r: f"a{r} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, k)) AS b FROM (SELECT row, vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r}) GROUP BY row)"
    for r in range(rounds):
        parts += [
            near(r), f"u{r} AS (SELECT b[2] AS k, unnest(range(1, 65)) AS j, unnest(v) AS x FROM a{r})",
            f"s{r} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM u{r} GROUP BY k, j)",
            f"m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{r} GROUP BY k)", f"c{r + 1} AS (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))",
        ]
    parts.append(near(rounds))
    last = f"SELECT vec_id, CAST(b[2] AS INTEGER) AS cluster, CAST(b[1] AS BIGINT) AS distance, CAST(sum(b[1]) OVER (PARTITION BY b[2]) AS BIGINT) AS cluster_inertia, CAST(sum(b[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON k = b[2]"
    return "WITH " + ", ".join(parts) + " " + last


ORACLES |= {"op11_vantage_neighbours": OP11, "op12_conversation_trie": OP12, "op13_lloyd_clusters": _op13()}
