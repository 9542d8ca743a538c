import re

import duckdb
import pytest
from pyspark.sql import functions as F

from graphquarry.llm import exact_dedup, license_scan, mixing, quality_rules

#: Columns whose names clash with those that the operators use or add.
SHAPE = "doc_id long, text string, lang string, source string, n_words long, kept string, key string, slot string, tokens string, value string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 7, "k", "k", "s", "t", "v") for i, t, lang, src in rows], SHAPE)


ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t ", "en", "a"),
    (5, "a b c d e f g a b c d e f g a b c d e f g", "en", "b"),
    (6, "same line here\nsame line here\nsame line here\nother words that differ a lot from all before", "de", "b"),
    (7, "w%s " * 11 % tuple(range(11)) + "###", "en", "c"),
    (8, "x" * 50_000 + " y" * 20_000, "en", "a"),
    (9, "éé ÜÜ\x0bвв\x0cъъ nb sp 👩‍🚀 1 2 3 4 5 6 7", "fr", "a"),
    (9, "éé ÜÜ\x0bвв\x0cъъ nb sp 👩‍🚀 1 2 3 4 5 6 7", "fr", "a"),
    (None, "one  two three four five six seven eight nine ten eleven twelve", "en", None),
]


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for k in range(len(words) - 4):
        at.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {p for ks in at.values() if len(ks) > 1 for k in ks for p in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measurements_equal_brute_force(spark):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = quality_rules.cascade(frame(spark, ROWS), keep=names).select("doc_id", *names)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(((i, *measured(t)) for i, t, *_ in ROWS), key=str)


def test_verdict_does_not_depend_on_the_order(spark):
    df = frame(spark, ROWS)
    verdicts = []
    for order in (quality_rules.RULES, quality_rules.RULES[::-1]):
        rows = quality_rules.cascade(df, order=order).select("doc_id", "kept", "failed_rule").collect()
        verdicts.append(sorted(((r["doc_id"], r["kept"]) for r in rows), key=str))
    assert verdicts[0] == verdicts[1]
    assert dict(verdicts[0])[1] is True and dict(verdicts[0])[5] is False and dict(verdicts[0])[2] is False


def test_rules_are_ordered_by_rejection_per_cost():
    e = [quality_rules.Estimate(r, s, x) for r, s, x in zip(quality_rules.RULES, (1, 1, 2, 1, 3, 1, 1), (0.1, 0.5, 0.9, 0, 0, 0, 0), strict=True)]
    assert [r.name for r in quality_rules.ordered(e)][:3] == ["repeated_passages", "symbols", "too_few_words"]


def test_costs_of_rules_are_their_own(spark):
    """On longer texts: words that repeat cost more to find than words to count, in every run."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(300)), "en", "a") for k in range(300)] + [(900 + k, "few", "en", "a") for k in range(100)]
    for _ in range(2):
        e = {x.rule.name: x for x in quality_rules.estimate(frame(spark, rows))}
        assert e["repeated_passages"].seconds > 3 * e["too_few_words"].seconds
        assert e["too_few_words"].rejected == 0.25 and e["symbols"].rejected == 0
        assert quality_rules.ordered(e.values())[0].name == "too_few_words"


def test_kept_measurements_cost_nothing_more(spark):
    """What is taken for every row anyhow isn't priced, so the order is by the cost that the plan pays."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(300)) + ("!" if k % 3 else " # # #" * 200), "en", "a") for k in range(60)]
    df = frame(spark, rows)
    free = {x.rule.name: x.seconds for x in quality_rules.estimate(df, keep=("n_words", "n_repeat_words", "n_symbols"))}
    full = {x.rule.name: x.seconds for x in quality_rules.estimate(df)}
    assert free["repeated_passages"] == free["symbols"] == free["too_few_words"] < full["symbols"] < full["repeated_passages"]
    assert free["upper_case"] == full["upper_case"]
    some = quality_rules.estimate(df.unionByName(df).unionByName(df), sample_rows=60)  # from all partitions
    assert {x.rule.name for x in some if x.rejected} == {x.rule.name for x in quality_rules.estimate(df) if x.rejected} >= {"symbols"}


def test_clashing_columns_stay(spark):
    df = frame(spark, ROWS).withColumns({"_text": F.lit("t"), "_words": F.lit("w"), "_lines": F.lit("l")})
    out = quality_rules.cascade(df, order=quality_rules.RULES)
    assert set(df.columns) <= set(out.columns) and {(r["_text"], r["_words"], r["_lines"]) for r in out.collect()} == {("t", "w", "l")}


def test_empty_tables(spark):
    df = frame(spark, ROWS).limit(0)
    assert quality_rules.cascade(df).count() == 0
    assert exact_dedup.exact_dedup(df).count() == 0
    assert license_scan.scan(df).count() == 0
    assert mixing.mix_sources(df).count() == 0
    assert exact_dedup.survivors(df).columns == mixing.survivors(df).columns == df.columns


@pytest.mark.parametrize("collide", [False, True])
def test_copies_by_bytes_even_if_digests_collide(spark, collide):
    kinds = {"digest": lambda t: F.lit("d"), "key": lambda t: F.length(t).cast("long")} if collide else {}
    rows = [(1, "a  b", "x", "x"), (2, "a\tb", "x", "x"), (3, "a c", "x", "x"), (4, None, "x", "x"), (5, "", "x", "x"), (6, "ab", "x", "x"), (7, "a b", "x", "x")]
    out = exact_dedup.exact_dedup(frame(spark, rows), **kinds)
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out.collect())
    assert got == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 1, True), (7, 7, 1, True)]


def brute_copies(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("collide", [False, True])
def test_every_row_has_its_verdict(spark, collide):
    """One id with several texts, repeated rows, null ids, texts that only differ in white space, and a hot text."""
    kinds = {"digest": lambda t: F.lit("d"), "key": lambda t: F.length(t).cast("long")} if collide else {}
    rows = [(1, "a", "x", "x"), (1, "b", "x", "x"), (2, "a", "x", "x"), (3, "c", "x", "x"), *ROWS, (None, "only", "x", "x"), (None, "only", "x", "x"), (None, None, "x", "x")]
    rows += [(k, "one hot  text" if k % 3 else "one hot\ttext", "x", "x") for k in range(1000, 11_000)]
    for least_hot in (10_000, 50):
        out = exact_dedup.exact_dedup(frame(spark, rows), capacity=5, least_hot=least_hot, **kinds)
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out.collect()), key=str) == brute_copies(rows)


def test_owners_have_whole_buckets_within_capacity(spark):
    rows = [(k, f"text {k // 2}", "x", "x") for k in range(600)]
    prints = exact_dedup.fingerprints(frame(spark, rows))
    index = exact_dedup.build_index(prints, prints.select("key").distinct(), capacity=20)
    owners = index.withColumn("file", F.input_file_name()).groupBy("bucket").agg(F.count_distinct("file").alias("files"), F.count_distinct("key").alias("keys"))
    assert owners.where("files > 1 OR keys > 20").count() == 0 and owners.count() >= 15
    assert index.where("key & ((1 << local_depth) - 1) != bucket").count() == 0
    assert index.where("group_size != 2").count() == 0


def test_survivors_keep_rows_without_id_and_each_text_of_an_id(spark):
    rows = [(1, "a b", "x", "x"), (2, "a  b", "x", "x"), (2, "c", "x", "x"), (3, "c", "x", "x"), (None, "a b", "x", "x"), (None, "only here", "x", "x"), (None, None, "x", "x"), (4, None, "x", "x")]
    out = exact_dedup.survivors(frame(spark, rows)).select("doc_id", "text").collect()
    want = [(1, "a b"), (2, "c"), (4, None), (None, "a b"), (None, None), (None, "only here")]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_directory_doubles_until_buckets_fit():
    counts = {s: 10 if s % 4 == 1 else 1 for s in range(16)}
    top, slots = exact_dedup.split_directory(counts, 4, 12)
    held = {}
    for slot, n in counts.items():
        bucket, depth = slots[slot & ((1 << top) - 1)]
        assert bucket == slot & ((1 << depth) - 1)
        held[bucket] = held.get(bucket, 0) + n
    assert max(held.values()) <= 12 and sum(held.values()) == sum(counts.values())
    assert exact_dedup.split_directory({}, 4, 12) == (0, [(0, 0)])


def test_licences_by_ordered_sentences(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy;\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'
    texts = [mit, "\n".join(mit.split("\n")[::-1]), "Text. Licensed  under the APACHE License,\tVersion 2.0. More", None, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."]
    out = {r["doc_id"]: r for r in license_scan.scan(frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect()}
    assert [out[k]["license"] for k in range(5)] == ["MIT", None, "Apache-2.0", None, "GPL-3.0"]
    assert out[1]["n_known"] == 3 and out[4]["licenses"] == "GPL-3.0,MIT"


GPL = """    This program is free software{0} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{1} either version {2} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""


def test_unedited_licences_wrapped_and_unwrapped(spark):
    notices = {"GPL-3.0-or-later": GPL.format(":", ",", 3), "GPL-2.0-or-later": GPL.format(";", ";", 2), "MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + BSD_NAME, "Apache-2.0": APACHE}
    shapes = [lambda t: t, lambda t: "\r\n".join(f" * {x}" for x in t.split("\n")), lambda t: "\n".join(" ".join(p.split()) for p in t.split("\n\n"))]
    texts = [(name, shape(t)) for name, t in notices.items() for shape in shapes]
    out = {r["doc_id"]: r for r in license_scan.scan(frame(spark, [(k, t, "en", "a") for k, (_, t) in enumerate(texts)])).collect()}
    assert [out[k]["license"] for k in range(len(texts))] == [name for name, _ in texts]
    part = "we say that mit license is fine and all rights reserved. are words"
    assert license_scan.scan(frame(spark, [(1, part, "en", "a")])).first()["n_known"] == 0


#: Notices and heads of licences as they are published, a paragraph in each string.
NOTICES = {
    "AGPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Affero General Public License for more details."],
    "LGPL-2.1-or-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "Preamble"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"],
    "Apache-2.0": ["Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["Copyright (c) 2020 Someone.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EPL-1.0": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES.'],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.'],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}


def test_published_notices_of_every_licence(spark):
    """As they are, wrapped in a comment, and in the middle of other text; no rule is without a text that it matches."""
    import textwrap

    shapes = [
        lambda ps: "\n\n".join(ps),
        lambda ps: "\n".join(f" * {line}" for p in ps for line in [*textwrap.wrap(p, 60), ""]),
        lambda ps: "/* Head.\n" + "\n".join(f"// {line}" for p in ps for line in textwrap.wrap(p, 76)) + "\ncode(); " * 2000,
    ]
    texts = [(name, shape(ps)) for name, ps in NOTICES.items() for shape in shapes]
    rows = [(k, t, "en", "a") for k, (_, t) in enumerate(texts)]
    by_id = {i: s for s, i in [*license_scan.WHOLE.items(), *license_scan.SENTENCES.items()]}
    for name, ids in license_scan.RULES:
        own = [by_id.get(i) or next(s for s, x in license_scan.WHOLE.items() if i in x.split()) for i in ids]
        rows.append((len(texts), "\n\n".join(own), "en", "a"))
        texts.append((name, None))
    rows += [(None, texts[0][1], None, None), (0, texts[0][1], "en", "a")]
    got = license_scan.scan(frame(spark, rows)).select("doc_id", "license", "licenses").collect()
    out = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and out[None]["license"] == texts[0][0]
    wrong = [(name, out[k]["license"]) for k, (name, _) in enumerate(texts[: 3 * len(NOTICES)]) if out[k]["license"] != name]
    assert wrong == []
    assert [name for k, (name, _) in enumerate(texts) if name not in out[k]["licenses"].split(",")] == []
    assert {name for name, _ in license_scan.RULES} == {*NOTICES, "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-or-later", "GPL-3.0-or-later"}


def test_raking_meets_all_targets(spark):
    rows = [(k, "word " * (k % 9 + 1) + (" | " if k % 5 == 0 else ""), ["en", "de", None][k % 3], "a" if k % 2 else "b" if k % 3 else None) for k in range(400)]
    df = frame(spark, rows)
    out = mixing.mix_sources(df, targets=None, iterations=20)
    assert out.count() == 400 and out.where("probability < 0 OR probability > 1").count() == 0
    share = {r["lang"]: r["s"] for r in out.groupBy("lang").agg((F.sum(F.col("tokens") * F.col("probability"))).alias("s")).collect()}
    have = {r["lang"]: r["s"] for r in out.groupBy("lang").agg(F.sum("tokens").alias("s")).collect()}
    want = {k: v ** mixing.TEMPERS["lang"] for k, v in have.items()}
    for k in want:
        assert share[k] / sum(share.values()) == pytest.approx(want[k] / sum(want.values()), rel=1e-3)


def test_sampling_equals_sql(spark):
    rows = [(k, t, lang, src) for k, (_, t, lang, src) in enumerate(ROWS)]
    df = frame(spark, rows)
    documents = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    for rounds, tolerance in ((8, 1.0), (200, mixing.TOLERANCE)):  # one block, and as many as the tolerance takes
        want = sorted((r[0], r[5], r[6]) for r in con.execute(mixing.sql(rounds)).fetchall())
        got = sorted((r["doc_id"], r["probability"], r["kept"]) for r in mixing.mix_sources(df, tolerance=tolerance).collect())
        assert [x[0] for x in got] == [x[0] for x in want]
        assert [x[1] for x in got] == pytest.approx([x[1] for x in want], abs=1e-6)


def test_mixing_reports_its_residual_and_takes_targets(spark):
    rows = [(k % 390, "word " * (k % 9 + 1), ["en", "de", None][k % 3], "a" if k % 2 else None) for k in range(400)] + [(None, None, None, None), (None, "x", "en", "a")]
    df = frame(spark, rows)
    wanted = spark.createDataFrame([("source", "a", 0.5), ("source", None, 0.5), ("lang", "en", 0.25), ("lang", "de", 0.75), ("topic", "prose", 1.0)], "margin string, value string, target double")
    out = mixing.mix_sources(df, targets=wanted).collect()
    assert len(out) == 402 and max(r["residual"] for r in out) <= mixing.TOLERANCE
    tokens = lambda keep: sum(r["tokens"] * r["probability"] for r in out if keep(r))
    assert tokens(lambda r: r["lang"] == "de") / tokens(lambda r: True) == pytest.approx(0.75, abs=1e-6)
    assert tokens(lambda r: r["lang"] is None) == 0 and len({r["kept"] for r in out if r["doc_id"] is None and r["lang"] is None}) == 1
    same = [(k, "word", "en" if k % 4 else "de", "a" if k % 4 else "b") for k in range(40)]  # the margins determine each other
    apart = mixing.mix_sources(frame(spark, same)).first()["residual"]
    assert apart > 1e-3


def test_many_cells_are_joined_by_a_salted_key(spark, monkeypatch):
    rows = [(k, "w " * (k % 7), ["en", "de"][k % 2], f"s{k % 11}") for k in range(300)]
    want = sorted(map(tuple, mixing.mix_sources(frame(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 1)
    monkeypatch.setattr(mixing, "MOST_CELLS", 1)
    got = sorted(map(tuple, mixing.mix_sources(frame(spark, rows)).collect()))
    assert [r[:5] + r[6:7] for r in got] == [r[:5] + r[6:7] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-8)


def test_inner_names_of_operators_may_be_columns(spark):
    """Every name that an operator or stage makes inside, as columns of the table: of, sha, dropped, keys, chains, cells."""
    from graphquarry.llm import minhash_dedup

    names = ["_of", "_sha", "_dropped", "of", "sha", "some", "gone", "key", "norm", "bucket", "keep_id", "group_size", "salt", "slot", "rep", "component", "first_id", "low", "high", "sig", "clash", "hub", "tokens", "topic", "weight", "total", "probability", "_value"]
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "an other text of this id"), (3, "a  b c d e f g"), (None, "q r s"), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "src") for i, t in rows], "doc_id long, text string, lang string, source string").withColumns({n: F.lit(7) for n in names})
    assert {r["doc_id"] for r in exact_dedup.survivors(df).select("doc_id").collect()} == {1, 2, None, 4}
    assert exact_dedup.exact_dedup(df).where("doc_id = 3").first()["keep_id"] == 1
    assert {r["doc_id"] for r in minhash_dedup.survivors(df).select("doc_id").collect()} >= {1, None, 4}
    for stage in (exact_dedup.survivors, minhash_dedup.survivors, mixing.survivors):
        out = stage(df)
        assert out.columns == df.columns and out.where("_of != 7 OR _dropped != 7").count() == 0


def test_many_cells_are_raked_as_few_ones(spark):
    """Sums joined step by step give the weights that windows in one task give."""
    rows = [(f"s{k % 7}", f"l{k % 5}", f"t{k % 3}", float(1 + k * 37 % 101)) for k in range(105)]
    cells = mixing.cells(spark.createDataFrame(rows, "source string, lang string, topic string, tokens double").unionByName(spark.createDataFrame([(None, "l1", "t0", 9.0)], "source string, lang string, topic string, tokens double")))
    table = mixing.with_targets(cells, mixing.tempered(cells, mixing.TEMPERS)).withColumn("total", F.lit(mixing.number(cells, F.sum("tokens")))).withColumn("weight", F.col("tokens"))
    few, many = ({tuple(r[m] for m in mixing.MARGINS): r["weight"] for r in mixing.rounds(table, 2, x).collect()} for x in (True, False))
    assert len(few) == 106 and few.keys() == many.keys() and all(few[k] == pytest.approx(many[k], rel=1e-12) for k in few)
