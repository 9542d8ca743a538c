"""Licence scans by sentence rules. DataFrame operations only.

A text is normalised with its line ends and the ends of its sentences kept as marks. A known sentence is found where its
words stand from one mark to another; marks between its words don't count, so it may be wrapped or hold ':' and ';'. The
sequence of a document's identifiers is held against ordered rules: a rule names identifiers that must occur in that
order, and the first rule that matches gives the licence; all rules that match are listed as well.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Sentences of licences, and the identifier of each.
SENTENCES = {
    "Licensed under the Apache License, Version 2.0.": "apache2_short",
    'Licensed under the Apache License, Version 2.0 (the "License");': "apache2_head",
    "you may not use this file except in compliance with the License.": "apache2_comply",
    "You may obtain a copy of the License at": "apache2_copy",
    "See the License for the specific language governing permissions and limitations under the License.": "apache2_see",
    "Released under the MIT License.": "mit_short",
    "Licensed under the MIT License.": "mit_short",
    "The MIT License (MIT)": "mit_title",
    "MIT License": "mit_title",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit_grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit_notice",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED': "mit_as_is",
    "This work is licensed under the GNU General Public License, version 3.": "gpl3_short",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl_grant",
    "either version 3 of the License, or (at your option) any later version.": "gpl3_later",
    "either version 2 of the License, or (at your option) any later version.": "gpl2_later",
    "You should have received a copy of the GNU General Public License along with this program.": "gpl_received",
    "Licensed under CC BY-NC 4.0.": "cc_by_nc4_short",
    "Licensed under CC BY 4.0.": "cc_by4_short",
    "Licensed under CC BY-SA 4.0.": "cc_by_sa4_short",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd_grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd_source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd_binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd_name",
    "All rights reserved.": "all_rights",
}
_MIT_END = "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
_FREE = "is free software: you can redistribute it and/or modify it under the terms of the GNU"
_LATER = "of the License, or (at your option) any later version."
_FSF = "as published by the Free Software Foundation"
_APACHE_UNLESS = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ECLIPSE = "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
_CC = "This work is licensed under a Creative Commons"
#: Whole sentences and titles of licences in use that SENTENCES doesn't have, and the identifiers of what they
#: say, in order.
WHOLE = {
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:': "mit_grant",
    f'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, {_MIT_END} NONINFRINGEMENT.': "mit_as_is",
    f'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, {_MIT_END} NON-INFRINGEMENT.': "mit_as_is",
    f"This program {_FREE} General Public License {_FSF}, either version 3 {_LATER}": "gpl_grant gpl3_later",
    f"This program {_FREE} General Public License {_FSF}, either version 2 {_LATER}": "gpl_grant gpl2_later",
    f"This program {_FREE} General Public License version 2 {_FSF}.": "gpl2_only",
    f"This program {_FREE} General Public License version 3 {_FSF}.": "gpl3_only",
    f"This program {_FREE} Affero General Public License {_FSF}, either version 3 {_LATER}": "agpl3_later",
    f"This program {_FREE} Lesser General Public License {_FSF}, either version 3 {_LATER}": "lgpl3_later",
    f"This library {_FREE} Lesser General Public License {_FSF}, either version 3 {_LATER}": "lgpl3_later",
    f"This library {_FREE} Lesser General Public License {_FSF}, either version 2.1 {_LATER}": "lgpl21_later",
    f"You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 {_APACHE_UNLESS}": "apache2_copy",
    f"You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 {_APACHE_UNLESS}": "apache2_copy",
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/": "apache2_title",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl3_title",
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": "gpl2_title",
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "agpl3_title",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "lgpl3_title",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "lgpl21_title",
    "Mozilla Public License Version 2.0": "mpl2_title",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl2_subject",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": "mpl2_copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl2_copy",
    f"{_USE}, provided that the above copyright notice and this permission notice appear in all copies.": "isc_grant",
    f"{_USE}.": "zero_bsd_grant",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.': "isc_as_is",
    "This is free and unencumbered software released into the public domain.": "unlicense_free",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "unlicense_anyone",
    "Eclipse Public License - v 2.0": "epl2_title",
    f"{_ECLIPSE} 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "epl2_notice",
    f"{_ECLIPSE} 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.": "epl2_notice",
    f"{_ECLIPSE} v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html": "epl1_notice",
    "Creative Commons Legal Code CC0 1.0 Universal": "cc0_title",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.": "cc0_dedicated",
    "This software is provided 'as-is', without any express or implied warranty.": "zlib_as_is",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "zlib_grant",
    "Distributed under the Boost Software License, Version 1.0.": "bsl1_short",
    f"{_CC} Attribution 4.0 International License.": "cc_by4_long",
    f"{_CC} Attribution-ShareAlike 4.0 International License.": "cc_by_sa4_long",
    f"{_CC} Attribution-NonCommercial 4.0 International License.": "cc_by_nc4_long",
}
#: Rules in order: the licence, and identifiers that occur in this order.
RULES = (
    ("Apache-2.0", ("apache2_head", "apache2_comply")),
    ("Apache-2.0", ("apache2_short",)),
    ("Apache-2.0", ("apache2_title",)),
    ("AGPL-3.0-or-later", ("agpl3_later",)),
    ("LGPL-3.0-or-later", ("lgpl3_later",)),
    ("LGPL-2.1-or-later", ("lgpl21_later",)),
    ("GPL-3.0-or-later", ("gpl_grant", "gpl3_later")),
    ("GPL-2.0-or-later", ("gpl_grant", "gpl2_later")),
    ("GPL-3.0", ("gpl3_short",)),
    ("GPL-3.0", ("gpl3_only",)),
    ("GPL-2.0", ("gpl2_only",)),
    ("AGPL-3.0", ("agpl3_title",)),
    ("LGPL-3.0", ("lgpl3_title",)),
    ("LGPL-2.1", ("lgpl21_title",)),
    ("GPL-3.0", ("gpl3_title",)),
    ("GPL-2.0", ("gpl2_title",)),
    ("MPL-2.0", ("mpl2_subject", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_title",)),
    ("EPL-2.0", ("epl2_notice",)),
    ("EPL-2.0", ("epl2_title",)),
    ("EPL-1.0", ("epl1_notice",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("0BSD", ("zero_bsd_grant", "isc_as_is")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_short",)),
    ("MIT", ("mit_title",)),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
    ("BSL-1.0", ("bsl1_short",)),
    ("Unlicense", ("unlicense_free", "unlicense_anyone")),
    ("CC0-1.0", ("cc0_title",)),
    ("CC0-1.0", ("cc0_dedicated",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4_short",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4_long",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4_short",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4_long",)),
    ("CC-BY-4.0", ("cc_by4_short",)),
    ("CC-BY-4.0", ("cc_by4_long",)),
)
#: The tag of a licence in a file's head says the licence itself.
TAGS = {name: "spdx_" + re.sub(r"[^a-z0-9]+", "_", name.lower()) for name, _ in RULES}
RULES = (*((name, (i,)) for name, i in TAGS.items()), *RULES)
WHOLE |= {f"SPDX-License-Identifier: {name}": i for name, i in TAGS.items()}


def plain(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = {plain(s): i for s, i in SENTENCES.items()}
EVERY = KNOWN | {plain(s): i for s, i in WHOLE.items()}
#: A known sentence between marks; of those that start at one place the longest.
PATTERN = r"(?<=\n)(?:" + "|".join(s.replace(" ", r"[ \n]") for s in sorted(EVERY, key=len, reverse=True)) + r")(?=\n)"


def marked(text: Column) -> Column:
    """Normalised words, with one "\\n" for line ends and after . ! ? ; : before white space; one at each end as well."""
    cut = F.regexp_replace(text_or_empty(text), r"([.!?;:])[\x20\x09-\x0D]+", "$1\n")
    words = F.regexp_replace(F.lower(F.concat(F.lit("\n"), cut, F.lit("\n"))), r"[^a-z0-9\n]+", " ")
    return F.regexp_replace(words, r" ?\n[ \n]*", "\n")


def rule_pattern(ids) -> str:
    return "(^| )" + " (.* )?".join(ids) + "( |$)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_known (identifiers), sentence_ids (joined by blanks, in order), license (null if no rule matches), licenses (all that match, in the order of the rules, joined by commas).

    One row per row of the table; other columns are ignored. A null or empty text has no sentences. Repeated rows and
    null ids are passed on. An empty table gives an empty result.
    """
    names = F.create_map(*(F.lit(x) for pair in EVERY.items() for x in pair))
    known = F.regexp_extract_all(marked(F.col(text_col)), F.lit(PATTERN), F.lit(0))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.array_join(F.transform(known, lambda s: F.element_at(names, F.translate(s, "\n", " "))), " ").alias("sentence_ids"))
    first, found = F, []
    for name, rule in RULES:
        hit = F.col("sentence_ids").rlike(rule_pattern(rule))
        first = first.when(hit, F.lit(name))
        found.append(F.when(hit, F.lit(name)))
    counted = F.when(F.col("sentence_ids") == "", F.lit(0)).otherwise(F.size(F.split("sentence_ids", " "))).cast("long")
    return ids.select("doc_id", counted.alias("n_known"), "sentence_ids", first.alias("license"), F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ",").alias("licenses"))


def sql() -> str:
    """The same in DuckDB's SQL, for texts whose known sentences are those of SENTENCES and stand unbroken on a line."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in KNOWN.items())
    whens = " ".join(f"WHEN regexp_matches(sentence_ids, '{rule_pattern(rule)}') THEN '{name}'" for name, rule in RULES)
    each = ", ".join(f"CASE WHEN regexp_matches(sentence_ids, '{rule_pattern(rule)}') THEN '{name}' END" for name, rule in RULES)
    return rf"""
WITH known(sentence, id) AS (VALUES {values}),
cut AS (
  SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10))) AS s,
         generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)), 1) AS place
  FROM documents
), hits AS (
  SELECT doc_id, place, id FROM cut JOIN known ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))
), ids AS (
  SELECT d.doc_id, coalesce(string_agg(id, ' ' ORDER BY place), '') AS sentence_ids, count(id) AS n_known
  FROM documents d LEFT JOIN hits ON hits.doc_id = d.doc_id GROUP BY d.doc_id
), every AS (
  SELECT *, list_filter([{each}], lambda x: x IS NOT NULL) AS found FROM ids
)
SELECT doc_id, n_known, sentence_ids, CASE {whens} END AS license,
       array_to_string(list_transform(list_filter(range(1, len(found) + 1), lambda i: list_position(found, found[i]) = i), lambda i: found[i]), ',') AS licenses
FROM every
"""
