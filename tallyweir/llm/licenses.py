"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A text is cut into windows of 2 * STRIDE words, one every STRIDE words, so that a notice of up to STRIDE + 1
words lies whole in some window; longer templates are scanned in parts. The signature of a window or a
template is a one-permutation MinHash of its word triples: the hash space is divided into BANDS bins, and each
bin that is not empty has its smallest hash as a band of one row. A window retrieves a template if they agree
in a band. A triple of the template inside a window is the smallest of its bin unless one of the window's
other triples, at most 2 * STRIDE - 3 of them, falls into the bin with a smaller hash: with 1,024 bins and
STRIDE 24 that happens with a probability under 2.3 %. A notice that shares 75 % of the triples of a template
with the shortest allowed length, three triples, is then missed once in 100,000 times or less, one that shares
five once in 10 ** 8.

Bands of windows are not built one by one: a triple is looked up among the templates' bands first, and only
for those found it is checked that the triple is the smallest of its bin in the window.

Shingles are word triples because notices are as short as five words (near duplicates of whole texts take
five). Defined results: a null or empty text has no license; a template under three words is one shingle;
repeated rows are judged one by one if their ids differ and together if not; an empty table or no template
gives no match; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.decontaminate import item_words
from tallyweir.llm.text import let, positions

SHINGLE = 3
STRIDE = 24
BANDS = 1024
PERCENT = 75
#: Rows of the templates' bands up to which they are broadcast.
BROADCAST_ROWS = 200_000

#: Notices as their licenses ask for them, short forms, identifier lines, clauses and disclaimers, of STRIDE words at
#: most: (license, text, words that must stand in a row in the window, several of them parted by a bar). 75 % of the triples
#: of a notice don't hold its version or limits, so those are asked for.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ""),
    ("apache-2.0", "Apache License, Version 2.0", "apache license version 2 0"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0", "identifier apache 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ""),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", ""),
    ("apache-1.1", "Apache Software License, Version 1.1", "apache software license version 1 1"),
    ("mit", "Released under the MIT License", ""),
    ("mit", "Licensed under the MIT License", "under the mit license"),
    ("mit", "SPDX-License-Identifier: MIT", "identifier mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ""),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ""),
    ("mit", "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ""),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO", "the software is provided as is"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ""),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ""),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer", ""),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", ""),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES", "this software is provided by"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause", "identifier bsd 3 clause"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause", "identifier bsd 2 clause"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ""),
    ("isc", "SPDX-License-Identifier: ISC", "identifier isc"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0", "identifier mpl 2 0"),
    ("gpl-2.0", "General Public License, version 2", "gnu general public license version 2"),
    ("gpl-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gnu general public license|either version 2 of the license"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only", "identifier gpl 2 0"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-or-later", "identifier gpl 2 0 or"),
    ("gpl-2.0", "licensed under the GPLv2", "under the gplv2"),
    ("gpl-2.0", "licensed under GPLv2", "under gplv2"),
    ("gpl-3.0", "GNU General Public License, version 3", "gnu general public license version 3"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    ("gpl-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu general public license|either version 3 of the license"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-only", "identifier gpl 3 0"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later", "identifier gpl 3 0 or"),
    ("gpl-3.0", "licensed under the GPLv3", "under the gplv3"),
    ("gpl-3.0", "licensed under GPLv3", "under gplv3"),
    ("lgpl-2.1", "Lesser General Public License, version 2.1", "lesser general public license version 2 1"),
    ("lgpl-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later", "identifier lgpl 2 1"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3", "lesser general public license version 3"),
    ("lgpl-3.0", "GNU Lesser General Public License, version 3", "lesser general public license version 3"),
    ("lgpl-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later", "identifier lgpl 3 0"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3", "affero general public license version 3"),
    ("agpl-3.0", "GNU Affero General Public License, version 3", "affero general public license version 3"),
    ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later", "identifier agpl 3 0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "commons attribution 4"),
    ("cc-by-4.0", "CC BY 4.0", "cc by 4 0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "commons attribution sharealike 4"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0", "by sa 4 0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ""),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "commons attribution noncommercial 4"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0", "by nc 4 0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ""),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "commons attribution noderivatives 4"),
    ("cc-by-nd-4.0", "CC BY-ND 4.0", "by nd 4 0"),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "commons attribution noncommercial sharealike 4"),
    ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0", "by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "commons attribution noncommercial noderivatives 4"),
    ("cc-by-nc-nd-4.0", "CC BY-NC-ND 4.0", "by nc nd 4 0"),
    ("cc-by-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License", "commons attribution 3"),
    ("cc-by-3.0", "CC BY 3.0", "cc by 3 0"),
    ("cc-by-sa-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", "commons attribution sharealike 3"),
    ("cc-by-sa-3.0", "CC BY-SA 3.0", "by sa 3 0"),
    ("cc-by-nc-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License", "commons attribution noncommercial 3"),
    ("cc-by-nc-sa-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License", "commons attribution noncommercial sharealike 3"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", ""),
    ("cc0-1.0", "CC0 1.0 Universal", "cc0 1 0"),
    ("all-rights-reserved", "All rights reserved", ""),
)


def _holds_required(required: Column, inside: Column) -> Column:
    """Whether the window holds the words that its template requires."""
    return let(F.concat(F.lit(" "), F.array_join(inside, " "), F.lit(" ")), lambda text: F.forall(required, lambda p: F.contains(text, p)))


def _triples(words: Column) -> Column:
    """The distinct shingles of a word list, as text; the whole list if it is shorter."""
    spread = let(
        words,
        lambda w: F.transform(
            positions(F.when(F.size(w) > 0, F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))).otherwise(0)),
            lambda i: F.array_join(F.slice(w, i + 1, F.lit(SHINGLE)), " "),
        ),
    )
    return F.array_distinct(spread)


def _bin(h: Column) -> Column:
    return F.pmod(h, F.lit(BANDS))


def bands(shingles: Column) -> Column:
    """The signature: the smallest hash of every bin that is not empty."""

    def least(hashes: Column) -> Column:
        return F.filter(hashes, lambda h: ~F.exists(hashes, lambda o: (_bin(o) == _bin(h)) & (o < h)))

    return let(F.transform(shingles, lambda s: F.xxhash64(s)), least)


def template_parts(templates: DataFrame) -> DataFrame:
    """(license, part, shingles, required): templates, the long ones in parts of STRIDE words.

    ``templates`` has columns license and text, and may have required: words that must stand in a row, several of them
    parted by a bar. With a long template only the parts that hold such words ask for them.
    """
    required = F.coalesce(F.col("required"), F.lit("")) if "required" in templates.columns else F.lit("")
    split = templates.select("license", item_words(F.col("text")).alias("w"), F.split(required, r"\|").alias("r")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(STRIDE))).alias("at")
    parts = split.select("license", "w", "r", at).select(
        "license", F.size("w").alias("n"), "r", F.slice("w", F.col("at") + 1, F.lit(STRIDE)).alias("p"))
    padded = F.transform(F.array_remove("r", ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
    own = F.when(F.col("n") > STRIDE, F.filter(padded, lambda x: F.contains(F.concat(F.lit(" "), F.array_join("p", " "), F.lit(" ")), x))).otherwise(padded)
    return parts.withColumn("required", own).select(
        "license", F.array_join("p", " ").alias("part"), _triples(F.col("p")).alias("shingles"), "required").distinct()


def default_templates(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame(list(TEMPLATES), "license string, text string, required string")


def matches(
    docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Verified windows: doc, window (its first word), license, part, shared (shingles of the part that the window has), of."""
    known = template_parts(templates)
    wanted = known.select("license", "part", "shingles", "required", F.explode(bands(F.col("shingles"))).alias("band"))
    small = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows
    split = docs.select(F.col(f"`{doc_id}`").alias("doc"), item_words(F.col(f"`{text}`")).alias("w"))
    places = split.select("doc", "w", F.posexplode("w").alias("at", "word"))
    shingle = F.concat_ws(" ", *[F.get("w", F.col("at") + k) for k in range(SHINGLE)])
    keyed = places.withColumn("band", F.xxhash64(shingle)).where((F.col("at") <= F.size("w") - SHINGLE) | (F.col("at") == 0))

    def in_windows(rows: DataFrame) -> DataFrame:
        block = F.floor(F.col("at") / STRIDE).cast("int")
        starts = F.filter(F.array((block - 1) * STRIDE, block * STRIDE), lambda s: s >= 0)
        each = rows.select("*", F.explode(starts).alias("window"))
        return each.withColumn("inside", F.slice("w", F.col("window") + 1, F.lit(2 * STRIDE))).drop("w")

    if small:
        near = in_windows(keyed.join(F.broadcast(wanted), "band"))
    else:
        near = in_windows(keyed).join(wanted, "band")
    smallest = let(
        F.transform(_triples(F.col("inside")), lambda s: F.xxhash64(s)),
        lambda hs: F.exists(hs, lambda h: h == F.col("band")) & ~F.exists(hs, lambda h: (_bin(h) == _bin(F.col("band"))) & (h < F.col("band"))),
    )
    retrieved = near.where(smallest)
    held = _holds_required(F.col("required"), F.col("inside"))
    shared = F.size(F.array_intersect("shingles", _triples(F.col("inside"))))
    counted = retrieved.select("doc", "window", "license", "part", shared.alias("shared"), F.size("shingles").alias("of"), held.alias("held"))
    return counted.where((100 * F.col("shared") >= percent * F.col("of")) & F.col("held")).drop("held").distinct()


def scan(docs: DataFrame, templates: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per document id: doc, n_windows (windows that hold a notice), licenses (names, sorted)."""
    found = matches(docs, default_templates(docs) if templates is None else templates, doc_id, text, percent)
    per_doc = found.groupBy("doc").agg(
        F.count_distinct("window", "part").alias("n_windows"), F.array_sort(F.collect_set("license")).alias("licenses")
    )
    ids = docs.select(F.col(f"`{doc_id}`").alias("id")).distinct()
    return ids.join(per_doc, F.col("id").eqNullSafe(F.col("doc")), "left").select(
        F.col("id").alias("doc"), F.coalesce("n_windows", F.lit(0).cast("long")).alias("n_windows"),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
    )
