"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences twice: as running text (line breaks are spaces, blank lines end a sentence, for hard-wrapped
licences) and line by line. Sentences are normalised (lower-cased, runs of other signs than letters and digits become a
space, the holder's name in the third BSD clause becomes the usual one) and looked up in a dictionary of known licence sentences. A rule is an ordered list of identifiers; it matches a sequence of
identifiers that holds them in that order. Rules are tried longest first, and one that matches consumes its sentences, in both sequences and as often as it matches: so
the three clauses that BSD-3-Clause begins with are not BSD-2-Clause as well, and only what is left over can match a shorter rule. Matching is a fold over the identifiers, so 10^5 of them take
seconds, whatever rules they begin and do not end.

Everything is one projection: no exchange, and dictionary and rules are constants of the plan. Every known sentence has one of the words in ``SIGNS``; texts without
any of them are cut by line once, to count their sentences, and not looked up.

Nulls: a null text has no sentences. Rows are kept one for one whatever their doc_id, and equal rows get equal results. Extra columns are dropped. An empty table
gives an empty result. Texts of any length are read whole, in memory in proportion to the row. Rules of one length are tried in the order of the list, which decides ties.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and of common notices, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-this": "This project is licensed under the MIT License.",
    "mit-work": "This work is licensed under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc-spdx": "SPDX-License-Identifier: ISC",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-two-released": "Released under the BSD 2-Clause License.",
    "bsd-three-released": "Released under the BSD 3-Clause License.",
    "bsd-two-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd-three-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the License);",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-work": "This work is licensed under the Apache License, Version 2.0.",
    "apache-released": "Released under the Apache License, Version 2.0.",
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl-three-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-three-licensed": "Licensed under the GNU General Public License, version 3.",
    "gpl-three-released": "Released under the GNU General Public License, version 3.",
    "gpl-two-work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-two-licensed": "Licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software:",
    "gpl-three-may": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-two-may": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl-two-version": "either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-three-spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl-three-only-spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl-two-spdx": "SPDX-License-Identifier: GPL-2.0-only",
    "lgpl-work": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-work": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-spdx": "SPDX-License-Identifier: MPL-2.0",
    "cc-by-licensed": "Licensed under CC BY 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-licensed": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-licensed": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-licensed": "Licensed under CC BY-ND 4.0.",
    "cc-zero": "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "reserved": "All rights reserved.",
    "apache-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache-definition": "License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "apache-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "gpl-three-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-three-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl-two-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-one-title": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "lgpl-three-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-three-incorporates": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "lgpl-three-may": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-two-one-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-two-title": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl-free": "This library is free software:",
    "lgpl-two-may": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl-two-one-version": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-two-one-spdx": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "lgpl-three-spdx": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "agpl-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "agpl-may": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-spdx": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-one-title": "MOZILLA PUBLIC LICENSE Version 1.1",
    "cc-zero-elects": "For these and/or other purposes and motivations, and without any expectation of additional consideration or compensation, the person associating CC0 with a Work (the Affirmer), to the extent that he or she is an owner of Copyright and Related Rights in the Work, voluntarily elects to apply CC0 to the Work and publicly distribute the Work under its terms, with knowledge of his or her Copyright and Related Rights in the Work and the meaning and intended legal effect of CC0 on those rights.",
    "gfdl-title": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "gfdl-two-title": "GNU Free Documentation License Version 1.2, November 2002",
}
#: Beginnings of words of which every known sentence has one, in any case.
SIGNS = ("licen", "spdx", "permission", "redistribut", "warranty", "software", "copyright", "reserved", "distributed")
#: Rules; licence and identifiers in order.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("Apache-2.0", ["apache-header", "apache-use", "apache-unless", "apache-see"]), ("Apache-2.0", ["apache-title", "apache-definition", "apache-grant"]),
    ("GPL-2.0", ["gpl-free", "gpl-two-may", "gpl-two-version"]), ("LGPL-2.1", ["lgpl-free", "lgpl-two-may", "lgpl-two-one-version"]), ("LGPL-2.1", ["gpl-free", "lgpl-two-may", "lgpl-two-one-version"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]), ("GPL-3.0", ["gpl-free", "gpl-three-may"]), ("LGPL-3.0", ["gpl-free", "lgpl-three-may"]), ("LGPL-3.0", ["lgpl-free", "lgpl-three-may"]),
    ("AGPL-3.0", ["gpl-free", "agpl-may"]), ("GPL-3.0", ["gpl-three-title", "gpl-three-preamble"]), ("LGPL-3.0", ["lgpl-three-title", "lgpl-three-incorporates"]), ("AGPL-3.0", ["agpl-title", "agpl-preamble"]),
    ("ISC", ["isc-grant", "isc-warranty"]), ("MPL-2.0", ["mpl-form", "mpl-copy"]), ("MPL-2.0", ["mpl-form", "mpl-copy-https"]), ("Unlicense", ["unlicense", "unlicense-anyone"]), ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-header", "apache-use"]),
    ("MIT", ["mit-title"]), ("MIT", ["mit-title-the"]), ("MIT", ["mit-released"]), ("MIT", ["mit-licensed"]), ("MIT", ["mit-this"]), ("MIT", ["mit-work"]), ("MIT", ["mit-spdx"]),
    ("ISC", ["isc-spdx"]), ("BSD-2-Clause", ["bsd-two-released"]), ("BSD-3-Clause", ["bsd-three-released"]), ("BSD-2-Clause", ["bsd-two-spdx"]), ("BSD-3-Clause", ["bsd-three-spdx"]),
    ("Apache-2.0", ["apache-licensed"]), ("Apache-2.0", ["apache-work"]), ("Apache-2.0", ["apache-released"]), ("Apache-2.0", ["apache-spdx"]), ("Apache-2.0", ["apache-title"]),
    ("GPL-3.0", ["gpl-three-work"]), ("GPL-3.0", ["gpl-three-licensed"]), ("GPL-3.0", ["gpl-three-released"]), ("GPL-3.0", ["gpl-three-spdx"]), ("GPL-3.0", ["gpl-three-only-spdx"]), ("GPL-3.0", ["gpl-three-title"]),
    ("GPL-2.0", ["gpl-two-work"]), ("GPL-2.0", ["gpl-two-licensed"]), ("GPL-2.0", ["gpl-two-spdx"]), ("GPL-2.0", ["gpl-two-title"]), ("GPL-1.0", ["gpl-one-title"]),
    ("LGPL-3.0", ["lgpl-work"]), ("LGPL-3.0", ["lgpl-three-title"]), ("LGPL-3.0", ["lgpl-three-spdx"]), ("LGPL-2.1", ["lgpl-two-one-title"]), ("LGPL-2.1", ["lgpl-two-one-spdx"]), ("LGPL-2.0", ["lgpl-two-title"]),
    ("AGPL-3.0", ["agpl-work"]), ("AGPL-3.0", ["agpl-title"]), ("AGPL-3.0", ["agpl-spdx"]), ("MPL-2.0", ["mpl-spdx"]), ("MPL-2.0", ["mpl-title"]), ("MPL-1.1", ["mpl-one-title"]),
    ("CC-BY-4.0", ["cc-by-licensed"]), ("CC-BY-4.0", ["cc-by-work"]), ("CC-BY-SA-4.0", ["cc-by-sa-licensed"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-licensed"]), ("CC-BY-NC-4.0", ["cc-by-nc-work"]), ("CC-BY-ND-4.0", ["cc-by-nd-licensed"]), ("CC0-1.0", ["cc-zero"]), ("CC0-1.0", ["cc-zero-elects"]), ("Unlicense", ["unlicense"]),
    ("GFDL-1.3", ["gfdl-title"]), ("GFDL-1.2", ["gfdl-two-title"]),
]
#: Names of holders in the third BSD clause, and what stands for them.
HOLDER, USUAL = r"neither the name of [^\x01]{1,200}? nor the names of (its|their|the) contributors", "neither the name of the copyright holder nor the names of its contributors"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Identifiers that a fold notes in one array.
PART = 256
_END = r"([.;:!?])[\x20\x09-\x0D]+"


def normalised(sentence: str) -> str:
    """What the plan makes of a sentence."""
    return re.sub(r"[\W_]+", " ", sentence.lower()).strip(" ")


def ordered_rules() -> list[tuple[str, list[str]]]:
    """Rules, longest first: licence and identifiers."""
    return sorted(RULES, key=lambda r: -len(r[1]))


def _sentences(text: Column, by_line: bool) -> Column:
    breaks = r"\n" if by_line else r"\n[\x20\x09-\x0D]*\n"
    marked = F.regexp_replace(F.regexp_replace(text, breaks, "\x01"), _END, "$1\x01")
    plain = F.regexp_replace(F.translate(marked, _UPPER, _LOWER), r"[^\p{L}\p{N}\x01]+", " ")
    return F.filter(F.transform(F.split(plain, "\x01"), lambda s: F.btrim(s)), lambda s: s != "")


def _known(sentences: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in SENTENCES.items() for x in (normalised(v), k)))
    return F.filter(F.transform(sentences, lambda s: F.element_at(table, F.regexp_replace(s, HOLDER, USUAL))), lambda x: x.isNotNull())


def _consumed(seq: Column, ids: Column) -> Column:
    """What a rule of several identifiers leaves of a sequence: each match takes the next of them in turn, and one that is not completed takes nothing.

    A fold over the identifiers, in parts of ``PART`` so that what it notes is appended to short arrays: each identifier that the rule takes is numbered, and of those the ones of complete matches go.
    """
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(seq) - 1) / PART)), lambda k: F.slice(seq, k.cast("int") * PART + 1, F.lit(PART)))

    def one(acc: Column, x: Column) -> Column:
        hit = x == F.get(ids, F.pmod(acc["n"], F.size(ids)))
        n = acc["n"] + F.when(hit, 1).otherwise(0)
        return F.struct(n.alias("n"), F.array_append(acc["at"], F.when(hit, n).otherwise(0)).alias("at"))

    def part(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["n"].alias("n"), F.array().cast("array<int>").alias("at")), one)
        return F.struct(done["n"].alias("n"), F.array_append(acc["at"], done["at"]).alias("at"))

    def left(acc: Column) -> Column:
        whole = acc["n"] - F.pmod(acc["n"], F.size(ids))
        rest = F.filter(F.arrays_zip(seq.alias("id"), F.flatten(acc["at"]).alias("at")), lambda x: (x["at"] == 0) | (x["at"] > whole))
        return F.transform(rest, lambda x: x["id"])

    return F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.array().cast("array<array<int>>").alias("at")), part, left)


def _matched(a: Column, b: Column) -> Column:
    """Licences of the rules that match, in order, what those before them left of two sequences."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, ids)).alias("ids")) for name, ids in ordered_rules()))

    def step(acc: Column, rule: Column) -> Column:
        ids = rule["ids"]
        without = {c: F.filter(acc[c], lambda x: ~F.array_contains(ids, x)) for c in "ab"}
        # only a sequence that had all identifiers of a rule can match it
        rest = {c: F.when(F.size(F.array_except(ids, acc[f"all_{c}"])) > 0, acc[c]).when(F.size(ids) == 1, without[c]).otherwise(_consumed(acc[c], ids)) for c in "ab"}
        return F.struct(rule.alias("rule"), rest["a"].alias("a"), rest["b"].alias("b"))

    def settle(acc: Column, new: Column) -> Column:
        ids, hit = new["rule"]["ids"], {c: F.size(new[c]) < F.size(acc[c]) for c in "ab"}
        left = {c: F.when(hit[c], new[c]).when(hit[o], F.filter(acc[c], lambda x: ~F.array_contains(ids, x))).otherwise(acc[c]) for c, o in ("ab", "ba")}
        names = F.when(hit["a"] | hit["b"], F.array_append(acc["names"], new["rule"]["name"])).otherwise(acc["names"])
        return F.struct(left["a"].alias("a"), left["b"].alias("b"), acc["all_a"].alias("all_a"), acc["all_b"].alias("all_b"), names.alias("names"))

    def both(acc: Column, rule: Column) -> Column:
        return F.aggregate(F.array(step(acc, rule)), acc, settle)  # a name for what is used several times

    start = F.struct(a.alias("a"), b.alias("b"), F.array_distinct(a).alias("all_a"), F.array_distinct(b).alias("all_b"), F.array().cast("array<string>").alias("names"))
    return F.aggregate(rules, start, both, lambda acc: F.array_sort(F.array_distinct(acc["names"])))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences) of every row: sentences by line, known ones in order, and licences in order of name."""
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast("array<string>")
    found = docs.select("doc_id", _sentences(text, True).alias("lines"), F.when(text.rlike(f"(?i){'|'.join(SIGNS)}"), text).alias("seen"))
    found = found.select("doc_id", F.size("lines").cast("long").alias("n_sentences"), F.when(F.col("seen").isNotNull(), _known(F.col("lines"))).otherwise(none).alias("sentence_ids"), F.when(F.col("seen").isNotNull(), _known(_sentences(F.col("seen"), False))).otherwise(none).alias("more"))
    licences = F.when((F.size("sentence_ids") > 0) | (F.size("more") > 0), _matched(F.col("sentence_ids"), F.col("more"))).otherwise(none)
    return found.select("doc_id", "n_sentences", "sentence_ids", licences.alias("licences"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, and identifiers and licences as text."""
    return found.select("doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))
