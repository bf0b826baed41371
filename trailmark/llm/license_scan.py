"""License scan by diagonal voting, in DataFrame functions only.

Every text's words give rolling hashes of 2 words and of 4 words; these are joined with the same hashes of the license templates
(4 words for templates of ``LONG`` words or more, 2 words for shorter ones and for the base phrases), each hit voting for the diagonal:
its place in the text less its place in the template.  Votes are summed by row, template and diagonal; a base phrase stands verbatim
exactly where one diagonal has all its votes.  Neighbouring diagonals (at most ``slack`` words apart: words put in or left out) are
merged, and the merged span is verified: its hits are taken in the text's order, and each must go on in the template; only template
words that are reached so, each once, count.  A span gives its template's label if these words are ``coverage`` or more both of the
template and of the span's own words; a short template must be there with all its words.  A notice with more words put in, or with its
parts in another order, lies on diagonals far apart: spans of one template that have an eighth of its words at least, and stand no more
than a quarter of its size from one another, also count together, by the template words that any of them reaches.  Where more than half
of a span lies in one that reaches more words, of a license worded alike, the latter counts alone.

The templates are a fixed table of notices and phrases (about a thousand hashes), or a table of texts and labels.  They are broadcast while
they have ``MOST_GRAMS`` hashes at most; a larger table is joined.
One narrow pass reads the texts; only hits, and one row for each document, are shuffled, keyed by row number: no group is larger than
one document's hits.

Null texts are empty: no words, score 0.  Repeated rows, null doc_ids: a row each.  Extra columns are left out.  Passages of several
templates, and of one template at several places, each count.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases whose verbatim places are counted, with their labels.
BASE = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
#: Published license texts and notices, with their labels.
TEMPLATES = [
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
        "mit",
    ),
    (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gpl",
    ),
    (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
        "lgpl",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
        "mpl",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "public-domain",
    ),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:",
        "zlib",
    ),
    (
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical "
        "methods, without the prior written permission of the publisher",
        "reserved",
    ),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under the GNU General Public License", "gpl"),
    ("Released under the MIT License", "mit"),
    ("Licensed under the Apache License", "apache"),
    ("GNU Lesser General Public License", "lgpl"),
    ("Mozilla Public License", "mpl"),
    ("Licensed under CC BY SA", "cc-by-sa"),
    ("Licensed under CC BY NC", "cc-by-nc"),
    ("Dedicated to the public domain", "public-domain"),
]
#: Templates of so many words or more vote with runs of 4 words, shorter ones with pairs.
LONG = 8
#: Hashes of templates that are broadcast, some 60 MB.
MOST_GRAMS = 1 << 20
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS), "")


def table_grams(templates: DataFrame) -> DataFrame:
    """The grams of a table of templates (text, label), numbered after all fixed ones."""
    texts = templates.select(words_of(F.col("text")).alias("w"), F.col("label").cast("string").alias("label")).where(F.size("w") > 1)
    numbered = texts.select("*", (F.row_number().over(Window.orderBy("label", "w")) + 1_000_000).alias("template"), F.size("w").alias("size"))
    rows = numbered.withColumn("k", F.when(F.col("size") >= LONG, 4).otherwise(2)).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))))
    pair = lambda i: F.xxhash64(F.get("w", F.col("at") + i), F.get("w", F.col("at") + i + 1))
    return rows.select("template", "at", "k", F.when(F.col("k") < 4, pair(0)).otherwise(F.xxhash64(pair(0), pair(2))).alias("gram"), "size", "label", F.lit(False).alias("is_base"))


def template_grams(spark: SparkSession, base=None, templates=None) -> DataFrame:
    """template, at, k, gram (hash), size in words, label, is_base; and template -1, which every document hits once."""
    if isinstance(templates, DataFrame):
        return template_grams(spark, base, []).unionByName(table_grams(templates))
    rows, number = [(-1, 0, 1, "", "", "", "", 0, "", False)], 0
    for is_base, phrases in ((True, base or BASE), (False, TEMPLATES if templates is None else templates)):
        for phrase, label in phrases:
            w = [x for x in re.split(_SEPARATORS, phrase.lower()) if x]
            k = 4 if len(w) >= LONG and not is_base else 2
            rows += [(number, at, k, *w[at : at + k], *[""] * (4 - k), len(w), label, is_base) for at in range(len(w) - k + 1)]
            number += 1
    df = spark.createDataFrame(rows, "template int, at int, k int, a string, b string, c string, d string, size int, label string, is_base boolean")
    pair = F.xxhash64("a", "b")
    return df.select("template", "at", "k", F.when(F.col("k") < 4, pair).otherwise(F.xxhash64(pair, F.xxhash64("c", "d"))).alias("gram"), "size", "label", "is_base")


def gram_filter(table: DataFrame) -> Callable[[Column], Column]:
    """Whether a hash may be one of the table's: a literal of 2**16 bits, so that only likely hits become rows.  The join decides."""
    words = [0] * 1024
    for r in table.select(F.col("gram").bitwiseAND(F.lit(65535)).alias("gram")).distinct().collect():  # 2**16 rows at most
        at = r["gram"]
        words[at >> 6] |= 1 << (at & 63)
    bits = F.array(*[F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words])

    def may_be(gram: Column) -> Column:
        at = gram.bitwiseAND(F.lit(65535)).cast("int")
        return F.getbit(F.get(bits, F.shiftright(at, 6)), at.bitwiseAND(63)) == 1

    return may_be


def in_order(hits: Column, k: Column) -> Column:
    """struct(words, start, stop): template words reached by hits (place, at) in the text's order, each once, and their span in the text."""
    none = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("words"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"))

    def step(s: Column, h: Column) -> Column:
        to = h["at"] + k - 1
        on = F.struct(to.alias("last"), (s["words"] + F.least(k, to - s["last"])).alias("words"), F.when(s["start"] < 0, h["place"]).otherwise(s["start"]).alias("start"), (h["place"] + k).alias("stop"))
        return F.when(to > s["last"], on).otherwise(s)

    return F.aggregate(F.array_sort(hits), none, step)


def scan_licenses(docs: DataFrame, coverage: float = 0.8, slack: int = 3, base=None, templates=None) -> DataFrame:
    """For each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best verified share), spans
    (label:start:end in words, end exclusive, of the method's own labels, comma-joined)."""
    table = template_grams(docs.sparkSession, base, templates)
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(F.col("text").cast("string")).alias("words"))
    n, none = F.size("words"), F.array().cast("array<bigint>")
    paired = split.withColumn("pairs", F.when(n > 1, F.zip_with(F.slice("words", F.lit(1), n - 1), F.slice("words", F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))).otherwise(none))
    fours = F.when(n > 3, F.zip_with(F.slice("pairs", F.lit(1), n - 3), F.slice("pairs", F.lit(3), n - 3), lambda a, b: F.xxhash64(a, b))).otherwise(none)
    likely = gram_filter(table)
    near = lambda grams, k: F.filter(F.transform(grams, lambda g, i: F.when(likely(g), F.struct(F.lit(k).alias("run"), i.alias("place"), g.alias("gram")))), lambda x: x.isNotNull())
    mark = F.array(F.struct(F.lit(1).alias("run"), F.lit(0).alias("place"), F.xxhash64(F.lit(""), F.lit("")).alias("gram")))
    rolled = paired.select("row", "doc_id", n.alias("n_words"), F.explode(F.concat(mark, near(F.col("pairs"), 2), near(fours, 4))).alias("x")).select("row", "doc_id", "n_words", "x.*")
    small = not isinstance(templates, DataFrame) or table.count() <= MOST_GRAMS
    hits = rolled.join(F.broadcast(table) if small else table, "gram").where(F.col("run") == F.col("k"))
    place = F.col("place")
    key, of = ["row", "doc_id", "n_words"], ["template", "k", "size", "label", "is_base"]
    votes = hits.select(*key, *of, place.alias("place"), "at").groupBy(*key, *of, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_list(F.struct("place", "at")).alias("hits"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > slack).cast("int"), F.lit(0)))
    merged = apart.withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.col("is_base") & (F.size("hits") == F.col("size") - 1)
    spans = merged.groupBy(*key, *of, "part").agg(
        F.sum(whole.cast("long")).alias("n_whole"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last"),
        F.flatten(F.collect_list("hits")).alias("hits"),
    )
    seen = spans.withColumn("s", F.when(F.col("template") >= 0, in_order(F.col("hits"), F.col("k"))))
    share = F.when(F.col("template") >= 0, F.col("s.words") / F.greatest("size", F.col("s.stop") - F.col("s.start"))).otherwise(0.0)
    part_of = ~F.col("is_base") & (F.col("size") >= LONG) & (F.col("s.words") * 8 >= F.col("size"))
    within = lambda c: F.when(part_of, c)
    of_template, in_text = Window.partitionBy("row", "template"), (F.asc_nulls_last(within(F.col("s.start"))), "part")
    stopped = F.max(within(F.col("s.stop"))).over(of_template.orderBy(*in_text).rowsBetween(Window.unboundedPreceding, -1))
    far = F.coalesce(within(F.col("s.start") - stopped > F.col("size") / 4).cast("int"), F.lit(0))
    near_by = seen.withColumns({"part_share": share, "far": far}).withColumn("cluster", F.sum("far").over(of_template.orderBy(*in_text).rowsBetween(Window.unboundedPreceding, 0)))
    together = Window.partitionBy("row", "template", "cluster")
    reached = F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + F.col("k") - 1)))
    joined = F.struct(
        F.min(within(F.col("s.start"))).over(together).alias("start"), F.max(within(F.col("s.stop"))).over(together).alias("stop"),
        F.size(F.array_distinct(F.flatten(F.collect_list(within(reached)).over(together)))).alias("words"), F.col("label").alias("label"),
    )
    clustered = near_by.withColumns({"joined": joined, "most": F.max(within(F.col("s.words"))).over(together)})
    all_share = F.when(part_of & (F.col("joined.words") > F.col("most")), F.col("joined.words") / F.greatest("size", F.col("joined.stop") - F.col("joined.start")))
    scored = clustered.withColumn("all_share", all_share).withColumn("share", F.greatest("part_share", F.coalesce("all_share", F.lit(0.0))))
    own = ~F.col("is_base") & (F.col("part_share") >= coverage) & ((F.col("size") >= LONG) | (F.col("s.words") == F.col("size")))
    found = F.array_union(F.collect_set(F.when(own, F.struct("s.start", "s.stop", "s.words", "label"))), F.collect_set(F.when(F.col("all_share") >= coverage, F.col("joined"))))
    by_row = scored.groupBy(*key).agg(
        F.sum("n_whole").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("n_whole") > 0, F.col("label"))).alias("base"),
        F.max("share").alias("score"),
        F.array_sort(found).alias("found"),
    )
    shared = lambda s, t: F.least(s["stop"], t["stop"]) - F.greatest(s["start"], t["start"])
    beaten = lambda s: F.exists("found", lambda t: (t["words"] > s["words"]) & (2 * shared(s, t) > s["stop"] - s["start"]))
    best = by_row.withColumn("best", F.filter("found", lambda s: ~beaten(s)))
    text = lambda s: F.concat_ws(":", s["label"], s["start"], s["stop"])
    return best.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("best", lambda s: s["label"])))), ",").alias("labels"),
        "score",
        F.array_join(F.transform("best", text), ",").alias("spans"),
    )
