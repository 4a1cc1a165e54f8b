"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

What is compared is every passage of a text and every window of words, for headers and openings of
long licences, and the text as a whole, for short ones. Everything here is DataFrame operations. A
word's weight falls with the licences that use it, and no weight hangs on other files, so a file has
one licence in any corpus. Versions and variants differ by single words; those decide by rules of their own (``MARKS``).
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.workspace import Workspace

#: Notices, openings and short full texts of public licences, by SPDX name; further, where one text
#: serves two licences, words of the whole file: one of each list needed, and those that must be absent.
TEMPLATES = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted", [["endorse"]], []),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted", [], ["endorse"]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1"),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License"),
    ("ISC", "Licensed under the ISC License"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("Zlib", "Licensed under the zlib License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "BSD 2-Clause License Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", [], ["endorse"]),
    ("BSD-3-Clause", "BSD 3-Clause License Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", [["endorse"]], []),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989 Copyright (C) 1989 Free Software Foundation, Inc. 51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The license agreements of most software companies try to keep users at the mercy of those companies."),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc. 51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This is the first released version of the library GPL. It is numbered 2 because it goes with version 2 of the ordinary GPL."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions. 1.0.1. \"Commercial Use\" means distribution or otherwise making the Covered Code available to a third party. 1.1. \"Contributor\" means each entity that creates or contributes to the creation of Modifications."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT. 1. DEFINITIONS"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\")."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\")."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License (\"Public License\")."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN \"AS-IS\" BASIS. CREATIVE COMMONS MAKES NO WARRANTIES REGARDING THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Words that tell versions and variants apart. A passage, window or whole text counts for a licence only with
#: one word of each first list and none of the second.
MARKS = {
    "Apache-2.0": ([["apache"], ["2"]], []),
    "GPL-1.0": ([["general"], ["public"], ["1"]], ["lesser", "library", "affero", "2", "3"]),
    "LGPL-2.0": ([["library"], ["general"], ["2"]], ["lesser", "affero"]),
    "GPL-2.0": ([["general"], ["public"], ["2"]], ["lesser", "library", "affero"]),
    "GPL-3.0": ([["general"], ["public"], ["3"]], ["lesser", "library", "affero"]),
    "LGPL-2.1": ([["lesser"], ["2"], ["1"]], ["affero"]),
    "LGPL-3.0": ([["lesser"], ["3"]], ["affero"]),
    "AGPL-3.0": ([["affero"], ["3"]], []),
    "MPL-2.0": ([["mozilla"], ["2"]], []),
    "MPL-1.1": ([["mozilla"], ["1"]], []),
    "EPL-2.0": ([["eclipse"], ["2"]], []),
    "BSL-1.0": ([["boost"], ["1"]], []),
    "CC0-1.0": ([["cc0"]], []),
    "CC-BY-4.0": ([["cc", "creative"], ["4"]], ["sa", "sharealike", "nc", "noncommercial", "nd", "noderivatives"]),
    "CC-BY-SA-4.0": ([["sa", "sharealike"], ["4"]], ["nc", "noncommercial", "nd", "noderivatives"]),
    "CC-BY-NC-4.0": ([["nc", "noncommercial"], ["4"]], ["sa", "sharealike", "nd", "noderivatives"]),
}
TOKEN = "[a-z0-9]+"
#: Least cosine of a notice.
THRESHOLD = 0.6
#: Names of files that license their directory and all below, without regard to case.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: Words of windows: for headers, and for openings of licence files. One begins every half of a window; texts of no more words
#: are their own window.
WINDOWS = (32, 64)
#: Passages end at line ends and after marks that white space follows.
PASSAGE_END = r"\n|(?<=[.;:!?])\s"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def constant(values: list, kind: str) -> Column:
    """A constant array; one node of the plan whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def templates(spark, notices=TEMPLATES) -> DataFrame:
    rows = [(i, x[0], x[1]) for i, x in enumerate(notices)]
    return spark.createDataFrame(rows, "template int, license string, notice string")


def conditions(notices=TEMPLATES) -> list[tuple]:
    """By template: words that a passage needs (one of each list) and must not have, and those of its file."""
    return [(*MARKS.get(x[0], ([], [])), *(x[2:] or ([], []))) for x in notices]


def _has(words: Column, needs: list[list[str]], bars: list[str]) -> Column:
    any_of = lambda given: F.arrays_overlap(words, F.array(*[F.lit(w) for w in given]))
    out = F.lit(True)
    for given in needs:
        out = out & any_of(given)
    return out & ~any_of(bars) if bars else out


def may_reach(weights: dict[int, dict[str, float]], threshold: float, told: list[tuple]) -> tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]:
    """(templates that a text with such words can have a passage of such a cosine to, those of them that a passage can have it to).

    A passage's cosine to a template is at most the norm of the template's weights of the words
    that they share. So those words' squares sum to the threshold's at least, and one of them is
    among the greatest weights, without which the others' squares don't. The words that a template needs and the
    number of shared words are looked at before the squares. A passage is only held against what its text can reach.
    """
    least = max(threshold - 1e-6, 0.0) ** 2  # cosines are rounded
    heads, rules = set(), []
    for template, own in sorted(weights.items()):
        by_weight = sorted(own.items(), key=lambda x: (-x[1], x[0]))
        rest = sum(w * w for w in own.values())
        for token, w in by_weight:
            if rest + 1e-9 < least:
                break
            heads.add(token)
            rest -= w * w
        sums = list(itertools.accumulate(w * w for _, w in by_weight))
        few = next(k for k, x in enumerate(sums, 1) if x + 1e-9 >= least)
        rules.append((template, few, [t for t, _ in by_weight], [w * w for _, w in by_weight]))

    def sums_up(shared: Column, few, tokens_of: Column, squares: Column) -> Column:
        total = F.aggregate(shared, F.lit(1e-9), lambda x, t: x + F.get(squares, F.array_position(tokens_of, t).cast("int") - 1))
        return (F.size(shared) >= few) & (total >= least)

    def by_text(words: Column) -> Column:
        any_head = F.arrays_overlap(words, constant(sorted(heads), "array<string>"))
        each = []
        for template, few, *own in rules:
            tokens_of, squares = constant(own[0], "array<string>"), constant(own[1], "array<double>")
            needs, _, file_needs, file_bars = told[template]
            fits = _has(words, needs + file_needs, file_bars) & sums_up(F.array_intersect(words, tokens_of), few, tokens_of, squares)
            each.append(F.when(fits, F.lit(template)))
        return F.when(any_head, F.array_compact(F.array(*each)))

    number = {template: i for i, (template, *_) in enumerate(rules)}
    place = constant([number.get(i, 0) for i in range(max(number, default=0) + 1)], "array<int>")
    kinds = {1: "array<int>", 2: "array<array<string>>", 3: "array<array<double>>"}
    fews, all_tokens, all_squares = (constant([x[k] for x in rules], kind) for k, kind in kinds.items())

    def by_passage(words: Column, reached: Column) -> Column:
        def fits(t: Column) -> Column:
            at = F.get(place, t)
            return sums_up(F.array_intersect(words, F.get(all_tokens, at)), F.get(fews, at), F.get(all_tokens, at), F.get(all_squares, at))

        return F.filter(reached, fits)

    return by_text, by_passage


def once(df: DataFrame, *kept: str, **named: Column) -> DataFrame:
    """``kept`` columns of ``df`` and ``named`` ones, each computed once a row.

    A filter on a projected column is moved below the projection, and the column's expression is then written out at
    each of its uses. What a generator gives isn't.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*[x.alias(name) for name, x in named.items()]))))


def windows(words: Column, k: int) -> Column:
    """(place, words) of each window of the ``k``-th size; none if the words are no more than one."""
    size = WINDOWS[k]
    last = F.ceil((F.size(words) - size) / (size // 2)).cast("int")
    places = F.when(F.size(words) > size, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct((-2 - i * len(WINDOWS) - k).alias("place"), F.slice(words, i * (size // 2) + 1, F.lit(size)).alias("words")))


def cosines(passages: DataFrame, by_template: dict[int, dict[str, float]], rarest: float) -> DataFrame:
    """(key, cosines: (template, similarity) of each of the templates in ``open``) of each passage.

    A passage's words are sorted and counted where they lie: no word is shuffled. ``held`` are words
    of templates that the text has, with their weights in ``held_idf``, and ``shared`` those of
    them that the passage has; other words weigh ``rarest``.
    """
    last = lambda i: F.coalesce(F.get("words", i - 1) != F.get("words", i), F.lit(True))
    runs = once(passages, "key", "open", "held", "held_idf", "shared", words=F.sort_array("words"))
    runs = once(runs, *runs.columns, ends=F.filter(F.sequence(F.lit(1), F.size("words")), last), different=F.array_distinct("words"))
    runs = once(
        runs, "key", "open", "shared",
        counts=F.transform("ends", lambda end, k: end - F.coalesce(F.get("ends", k - 1), F.lit(0))),
        at=F.transform("shared", lambda t: F.array_position("different", t).cast("int") - 1),
        idf=F.transform("shared", lambda t: F.get("held_idf", F.array_position("held", t).cast("int") - 1)),
    )
    squares = F.aggregate("counts", F.lit(0.0), lambda total, n: total + n * n)
    weighed = F.transform("shared", lambda t, i: F.struct(t.alias("token"), (F.get("counts", F.get("at", i)) * F.get("idf", i)).alias("w"), F.get("counts", F.get("at", i)).alias("n")))
    runs = once(runs, "key", "open", squares=squares, runs=weighed)
    known = F.aggregate("runs", F.lit(0.0), lambda total, x: total + x["w"] * x["w"] - F.lit(rarest * rarest) * x["n"] * x["n"])
    runs = once(runs, "key", "open", "runs", norm=F.sqrt(F.lit(rarest * rarest) * F.col("squares") + known))
    own = [sorted(by_template[i].items()) for i in range(len(by_template))]
    all_tokens = constant([[t for t, _ in x] for x in own], "array<array<string>>")
    all_weights = constant([[w for _, w in x] for x in own], "array<array<double>>")

    def cosine(template: Column) -> Column:
        weight = lambda t: F.coalesce(F.get(F.get(all_weights, template), F.array_position(F.get(all_tokens, template), t).cast("int") - 1), F.lit(0.0))
        dot = F.aggregate("runs", F.lit(0.0), lambda total, x: total + x["w"] * weight(x["token"]))
        return F.struct(template.alias("template"), F.round(dot / F.col("norm"), 6).alias("similarity"))

    return once(runs, "key", cosines=F.transform("open", cosine))


def license_scan(files: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", notices=TEMPLATES) -> DataFrame:
    """The licence of each file: its own, else that of the nearest directory above that has one.

    Returns a row per input row: doc_id, path, license, similarity, basis (``own``, ``inherited``
    or ``none``) and license_path (the directory inherited from). A file's own licence is that
    of the template nearest to a passage, a window of words or the whole text, among those whose marks are met, ties by name; files
    named as ``LICENSE_FILE`` give
    theirs to their directory, the nearest to a template first. A null text has no licence and
    a null path no directory. Ids need not be unique: rows are told apart by a row key of id,
    path and text, and equal rows get equal results. An empty table gives an empty result;
    other columns are not read. ``notices`` are (licence, text) to compare with, or as ``TEMPLATES``.
    """
    spark = files.sparkSession
    ws = Workspace(spark)
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    key = F.xxhash64("doc_id", "path", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("key", key)
    told = conditions(notices)
    marks = {w for needs, bars, file_needs, file_bars in told for given in (*needs, bars, *file_needs, file_bars) for w in given}
    shape = templates(spark, notices).select("template", "license", F.explode(tokens(F.col("notice"))).alias("token"))
    # weights by licences; a word of a template has a row
    n_licenses = len({x[0] for x in notices})
    rarest = math.log(n_licenses + 1.0) + 1
    weights = shape.groupBy("token").agg(F.count_distinct("license").alias("df")).select("token", (F.log((F.lit(n_licenses) + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))
    shaped = shape.groupBy("template", "token").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(weights), "token")
    norms = shaped.groupBy("template").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2)))).alias("t_norm"))
    by_template, idf = {i: {} for i in range(len(notices))}, {}
    for r in shaped.join(norms, "template").select("token", "template", "idf", (F.col("tf") * F.col("idf") / F.col("t_norm")).alias("t_weight")).collect():
        by_template[r.template][r.token] = r.t_weight
        idf[r.token] = r.idf
    vocabulary = sorted(marks.union(idf))
    by_text, by_passage = may_reach({i: own for i, own in by_template.items() if own}, threshold, told)
    holders = once(rows, "key", "text", all_words=tokens(F.coalesce("text", F.lit(""))))
    holders = once(holders, *holders.columns, held=F.array_intersect("all_words", constant(vocabulary, "array<string>")))
    holders = once(holders, *holders.columns, reached=by_text(F.col("held"))).where(F.size("reached") > 0)
    idf_at = lambda t: F.get(constant([idf.get(x, rarest) for x in vocabulary], "array<double>"), F.array_position(constant(vocabulary, "array<string>"), t).cast("int") - 1)
    holders = once(holders, *holders.columns, held_idf=F.transform("held", idf_at))
    lines = F.transform(F.split("text", PASSAGE_END), lambda x, i: F.struct(i.alias("place"), tokens(x).alias("words")))
    whole = F.array(F.struct(F.lit(-1).alias("place"), F.col("all_words").alias("words")))
    units = F.concat(lines, whole, *[windows(F.col("all_words"), k) for k in range(len(WINDOWS))])
    passages = holders.select("key", "held", "held_idf", "reached", F.inline(units))
    kept = ["key", "held", "held_idf", "words"]
    passages = once(passages, *kept, "reached", shared=F.array_intersect("words", "held"))
    passages = once(passages, *kept, "shared", near=by_passage(F.col("shared"), F.col("reached"))).where(F.size("near") > 0)
    open_to = F.array_compact(F.array(*[F.when(_has(F.col("shared"), needs, bars), F.lit(i)) for i, (needs, bars, *_) in enumerate(told)]))
    passages = once(passages, *kept, "shared", open=F.array_intersect("near", open_to)).where(F.size("open") > 0)
    found = cosines(passages, by_template, rarest).select("key", F.inline("cosines")).where(F.col("similarity") >= threshold)
    license_of = F.get(constant([x[0] for x in notices], "array<string>"), F.col("template"))
    best = found.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("s"), license_of.alias("license"))).alias("b"))
    best = best.select("key", F.col("b.license").alias("own"), (-F.col("b.s")).alias("own_similarity"))
    known = ws.save(rows.select("key", "doc_id", "path").join(best, "key", "left"))
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    grants = known.where(F.col("own").isNotNull() & F.element_at(parts, -1).rlike(LICENSE_FILE)).select(folder.alias("folder"), "own", "own_similarity")
    grants = grants.groupBy("folder").agg(F.min(F.struct((-F.col("own_similarity")).alias("s"), F.col("own").alias("license"))).alias("g"))
    # folders first, each once with all that lie above it; a file then asks for its own folder only
    folders = known.where(F.col("own").isNull() & F.col("path").isNotNull()).select(folder.alias("at")).distinct()
    deep = F.when(F.col("at") == "", F.lit(0)).otherwise(F.size(F.split("at", "/")))
    above = F.transform(F.sequence(F.lit(0), deep), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(F.split("at", "/"), 1, d), "/").alias("folder")))
    heirs = folders.select("at", F.inline(above)).join(grants, "folder").groupBy("at").agg(F.max(F.struct("depth", "folder", "g")).alias("h"))
    heirs = ws.save(heirs)
    heirs = F.broadcast(heirs) if heirs.count() <= 10_000 else heirs
    rows = known.withColumn("_at", F.when(F.col("own").isNull(), folder))
    out = rows.join(heirs, rows["_at"] == heirs["at"], "left")
    return ws.finish(out.select(
        "doc_id", "path", F.coalesce("own", "h.g.license").alias("license"), F.coalesce("own_similarity", -F.col("h.g.s"), F.lit(0.0)).alias("similarity"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("h").isNotNull(), "inherited").otherwise("none").alias("basis"), F.when(F.col("own").isNull(), F.col("h.folder")).alias("license_path"),
    ))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: a folder a source, in it one a hundred ids.

    A document whose first or last line is a notice stands as its folder's licence file.
    """
    notice = F.lit(r"(?i)^(released|(this work is )?licensed) under [^.]*([.][0-9]+)*[.]?$")
    edge = F.regexp_like(F.substring_index("text", "\n", 1), notice) | F.regexp_like(F.substring_index("text", "\n", -1), notice)
    alone = F.coalesce(edge, F.lit(False))
    name = F.when(alone, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string"), name)
    return docs.select("doc_id", path.alias("path"), "text")
