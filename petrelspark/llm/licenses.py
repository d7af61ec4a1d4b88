"""License scans by sentence rules, with DataFrame functions only.

A text is normalised to words and the breaks between them, and the sentences that are known become identifiers, in order.  A known
sentence may be wrapped over any number of lines, but an empty line ends it (as does a stop), unless its notice has one at that place;
a line that is one counts by itself.  Ordered
rules then read the sequence of identifiers: each is a sequence that must stand in the text without another known sentence
between; rules stand from the most specific to the least, and a place that one has read is closed to those after it.

Names that a notice leaves open (holders, authors) are read as any words.  Text between two known sentences that is none, such as a clause with a
further condition, stands between their identifiers too, so no rule reads over it; ``SPDX-License-Identifier`` lines are sentences.

Defined results: an empty table gives an empty result; a null or empty text has no sentences.  A known sentence that no rule reads gives ``UNMATCHED``; a text of
which the sentences mention a license but none is known gives ``UNKNOWN``; any other text gives no license.  Repeated rows are
scanned each.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrelspark.llm.columns import texts

#: Known sentences, as they read once normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheUrl",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this software is released under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind": "AsIs",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdPre",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this software is provided by the copyright holders and contributors as is": "BsdAsIs",
    "released under the bsd license": "BsdRef",
    "licensed under the bsd 3 clause license": "Bsd3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Plus",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplHope",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MplRef",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MplUrl",
    "licensed under cc by 4 0": "CcByRef",
    "licensed under cc by sa 4 0": "CcBySaRef",
    "licensed under cc by nc 4 0": "CcByNcRef",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcByRef",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySaRef",
    "all rights reserved": "AllRights",
}
#: Notices as their authors write them, where the sentence has stops or an empty line inside, or goes on after the words in ``SENTENCES``.
NOTICES = [
    ("You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0", "ApacheUrl"),
    ("You may obtain a copy of the License at\n\nhttps://www.apache.org/licenses/LICENSE-2.0", "ApacheUrl"),
    ("You may obtain a copy of the License at: http://www.apache.org/licenses/LICENSE-2.0", "ApacheUrl"),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "AsIs"),
    ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", "BsdAsIs"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "Gpl2Plus"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Gpl3Plus"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "Gpl3Plus"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MplRef"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MplUrl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "Lgpl21Plus"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "Lgpl3Plus"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Lgpl3Plus"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Agpl3Plus"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.", "Agpl3Ref"),
    ("This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "GplHope"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "GplHope"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "IscGrant"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "IscGrant"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "ZeroBsdGrant"),
    ("This is free and unencumbered software released into the public domain.", "UnlicenseDomain"),
    ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "UnlicenseFree"),
    ("Distributed under the Boost Software License, Version 1.0.", "BoostRef"),
    ("This software is provided 'as-is', without any express or implied warranty.", "ZlibAsIs"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "ZlibGrant"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "Epl1Ref"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Epl2Ref"),
    ("Licensed under the Apache License, Version 2.0 or the MIT license, at your option.", "MitOrApache"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BsdEndorse"),
    ("The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", "BsdEndorse"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Cc0Waiver"),
]
#: Expressions after ``SPDX-License-Identifier:`` and the license that each names.
SPDX = {
    "MIT": "MIT",
    "Apache-2.0": "Apache-2.0",
    "BSD-2-Clause": "BSD-2-Clause",
    "BSD-3-Clause": "BSD-3-Clause",
    "0BSD": "0BSD",
    "ISC": "ISC",
    "Zlib": "Zlib",
    "BSL-1.0": "BSL-1.0",
    "Unlicense": "Unlicense",
    "CC0-1.0": "CC0-1.0",
    "CC-BY-4.0": "CC-BY-4.0",
    "CC-BY-SA-4.0": "CC-BY-SA-4.0",
    "GPL-2.0": "GPL-2.0",
    "GPL-2.0-only": "GPL-2.0-only",
    "GPL-2.0-or-later": "GPL-2.0-or-later",
    "GPL-3.0": "GPL-3.0",
    "GPL-3.0-only": "GPL-3.0-only",
    "GPL-3.0-or-later": "GPL-3.0-or-later",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-2.1-only": "LGPL-2.1-only",
    "LGPL-2.1-or-later": "LGPL-2.1-or-later",
    "LGPL-3.0": "LGPL-3.0",
    "LGPL-3.0-only": "LGPL-3.0-only",
    "LGPL-3.0-or-later": "LGPL-3.0-or-later",
    "AGPL-3.0": "AGPL-3.0",
    "AGPL-3.0-only": "AGPL-3.0-only",
    "AGPL-3.0-or-later": "AGPL-3.0-or-later",
    "MPL-2.0": "MPL-2.0",
    "EPL-1.0": "EPL-1.0",
    "EPL-2.0": "EPL-2.0",
    "WTFPL": "WTFPL",
    "MIT OR Apache-2.0": "MIT OR Apache-2.0",
    "Apache-2.0 OR MIT": "MIT OR Apache-2.0",
}
#: Ordered rules: the license and the sentence identifiers that it is made of; Other stands for text between known sentences that is none.
RULES = [
    ("MIT", ["MitGrant", "MitNotice", "AsIs"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("MIT", ["MitRef"]),
    ("BSD-3-Clause", ["BsdPre", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs"]),
    ("BSD-3-Clause", ["BsdPre", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdPre", "BsdSource", "BsdBinary", "BsdAsIs"]),
    ("UNMATCHED", ["BsdPre", "BsdSource", "BsdBinary", "Other"]),
    ("BSD-2-Clause", ["BsdPre", "BsdSource", "BsdBinary"]),
    ("BSD-3-Clause", ["Bsd3Ref"]),
    ("BSD", ["BsdRef"]),
    ("Apache-2.0", ["ApacheRef", "ApacheUse", "ApacheUrl"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("GPL-2.0-or-later", ["Gpl2Plus", "GplHope"]),
    ("GPL-2.0-or-later", ["Gpl2Plus"]),
    ("GPL-3.0-or-later", ["Gpl3Plus", "GplHope"]),
    ("GPL-3.0-or-later", ["Gpl3Plus"]),
    ("GPL-2.0-only", ["Gpl2Ref"]),
    ("GPL-3.0-only", ["Gpl3Ref"]),
    ("MPL-2.0", ["MplRef", "MplUrl"]),
    ("MPL-2.0", ["MplRef"]),
    ("CC-BY-SA-4.0", ["CcBySaRef"]),
    ("CC-BY-NC-4.0", ["CcByNcRef"]),
    ("CC-BY-4.0", ["CcByRef"]),
    ("ISC", ["IscGrant", "AsIs"]),
    ("ISC", ["IscGrant"]),
    ("0BSD", ["ZeroBsdGrant"]),
    ("Unlicense", ["UnlicenseDomain", "UnlicenseFree"]),
    ("Unlicense", ["UnlicenseDomain"]),
    ("BSL-1.0", ["BoostRef"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("EPL-1.0", ["Epl1Ref"]),
    ("EPL-2.0", ["Epl2Ref"]),
    ("LGPL-2.1-or-later", ["Lgpl21Plus", "GplHope"]),
    ("LGPL-2.1-or-later", ["Lgpl21Plus"]),
    ("LGPL-3.0-or-later", ["Lgpl3Plus", "GplHope"]),
    ("LGPL-3.0-or-later", ["Lgpl3Plus"]),
    ("AGPL-3.0-or-later", ["Agpl3Plus", "GplHope"]),
    ("AGPL-3.0-or-later", ["Agpl3Plus"]),
    ("AGPL-3.0-only", ["Agpl3Ref", "GplHope"]),
    ("AGPL-3.0-only", ["Agpl3Ref"]),
    ("MIT OR Apache-2.0", ["MitOrApache"]),
    ("CC0-1.0", ["Cc0Waiver"]),
] + [(license, [f"Spdx{number}"]) for number, license in enumerate(SPDX.values())]
#: A sentence ends at a full stop, exclamation or question mark, semicolon or colon before white space or the end.  A text in lower case is cut
#: so, and every other run of characters is one space.
SENTENCE_END = r"[.!?;:]+(?=\s|$)"
OTHER = r"[^a-z0-9]+"
#: What stands between two words once a text is laid out: a space, a line break (L), the end of a sentence (S) or an empty line (P).  A line
#: without letters and digits is empty, and what stands before the first of them in a line (a comment mark) is no sentence.
LAYOUT = [(r"\n[^a-z0-9]*\n[^a-z0-9]*", "P"), (r"\n[^a-z0-9P]*", "\n"), (SENTENCE_END, "S"), (r"\n", "L"), (r"[^a-z0-9SLP]+", " "), (r"S[ S]*", "S"), (r" ?S?P", "P"), (r" ?SL?", "S"), (r" ?L", "L")]
#: Words of which one is in every known sentence; a text without any has no known sentence, and is cut no further.
MENTION = r"licen[sc]e|permission|copyright|redistribut|warranty|software|mpl|rights reserved"


def laid_out(text: Column) -> Column:
    """The words of a text in lower case, with one character of ``LAYOUT`` between two."""
    return F.trim(reduce(lambda c, step: F.regexp_replace(c, *step), LAYOUT, F.lower(text)))


def keyed(notice: str) -> str:
    """A notice as ``laid_out`` gives it, without the stop at its end."""
    return reduce(lambda s, step: re.sub(*step, s, flags=re.ASCII), LAYOUT, notice.lower()).strip(" SLP")


#: All known sentences as they are laid out.
KNOWN = SENTENCES | {keyed(notice): i for notice, i in NOTICES} | {keyed(f"SPDX-License-Identifier: {x}"): f"Spdx{number}" for number, x in enumerate(SPDX)}
#: Places for names in known sentences, in a text that is laid out, and what is read in their stead.
SLOTS = [
    (r"neither[ L]the[ L]names?[ L]of(?:[ L][a-z0-9]+){1,16}?[ L]nor[ L]the[ L]names[ L]of[ L](?:its|their|any)[ L]contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"this[ L]software[ L]is[ L]provided[ L]by(?:[ L][a-z0-9]+){1,12}?[ L]as[ L]is[ L]and[ L]any", "this software is provided by the copyright holders and contributors as is and any"),
    (r"the[ L]authors?(?:[ L][a-z0-9]+){0,8}?[ L](?:has|have)[ L]waived", "the author has waived"),
]
#: Text between known sentences that says something: three words or more.
SAYS = r"[a-z][a-z0-9]*[ L][a-z0-9]+[ L][a-z0-9]+"
#: A break in a known sentence is read as this: a weaker one, or a line break, may stand in its place.
BREAK = {" ": "[ L]", "S": "[ LS]", "P": "[ LSP]"}


def pattern(known: dict[str, str]) -> str:
    """A known sentence in a text that is laid out: from the start of a line or sentence to the end of one, over any number of line breaks."""
    longest_first = sorted(known, key=len, reverse=True)
    return f"(?<=^|[SLP])(?:{'|'.join(''.join(BREAK.get(c, c) for c in s) for s in longest_first)})(?=[SLP]|$)"


def identifiers(text: Column, known: dict[str, str] = KNOWN) -> Column:
    """The identifiers of the known sentences of a text, in order, with Other for what stands between two of them and is none."""
    table = F.create_map(*[F.lit(x) for pair in {re.sub("[SLP]", " ", s): i for s, i in known.items()}.items() for x in pair])
    laid = reduce(lambda c, slot: F.regexp_replace(c, *slot), SLOTS, laid_out(text))
    parts = F.split(F.regexp_replace(laid, f"({pattern(known)})", "\x01$1\x01"), "\x01")
    # what matched stands in every second place
    named = F.transform(parts, lambda s, i: F.when(i % 2 == 1, F.try_element_at(table, F.translate(s, "SLP", "   "))).when(s.rlike(SAYS), "Other"))
    return F.when(F.lower(text).rlike(MENTION), F.filter(named, lambda i: i.isNotNull())).otherwise(F.array().cast("array<string>"))


def matched(sequence: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """The sequence, written ``,a,,b,``, with what each rule reads replaced by ``=license=``; what is Other goes."""
    read = reduce(lambda c, rule: F.replace(c, F.lit("".join(f",{i}," for i in rule[1])), F.lit(f"={rule[0]}=")), rules, sequence)
    return F.replace(read, F.lit(",Other,"), F.lit(""))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, sentence_ids (comma-joined), licenses (in order, distinct, comma-joined), n_sentences (known ones, long)."""
    rows = texts(docs, id_col=id_col, text_col=text_col).select("doc_id", identifiers(F.col("text")).alias("every"), F.lower("text").rlike("licen[sc]e").alias("mention"))
    rows = rows.withColumn("ids", F.filter("every", lambda i: i != "Other"))
    read = matched(F.array_join(F.transform("every", lambda i: F.concat(F.lit(","), i, F.lit(","))), ""))
    named = F.array_distinct(F.regexp_extract_all(read, F.lit("=([^=,]+)="), F.lit(1)))
    left_over = read.rlike(",[A-Za-z0-9]+,") & ~F.array_contains(named, "UNMATCHED")
    whole = F.when(F.size("ids") == 0, F.when(F.col("mention"), F.array(F.lit("UNKNOWN"))).otherwise(F.array().cast("array<string>"))).when(left_over, F.array_append(named, "UNMATCHED")).otherwise(named)
    return rows.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(whole, ",").alias("licenses"), F.size("ids").cast("long").alias("n_sentences"))
