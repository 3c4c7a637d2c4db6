"""License scan by diagonal voting.

Every text's rolling k-word hashes are joined to the positions of the same
k-words in the license templates (a bounded table, broadcast after a size
check).  Each hit votes for its diagonal (text position minus template
position); votes are pre-aggregated per diagonal, neighbouring diagonals
(insertions and deletions) merge, and a merged span is verified by the
share of the template's words that its hits cover: all words of a short
template, ``MIN_COVER`` of a longer one, and in both every k-word run of its
decisive words, which tell it from its variants.  Where verified spans
overlap, the best cover wins the place.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hashed_words, signed, slices, texts, window_hashes
from .toxicity import WORD_BYTES

K = 3
MAX_GAP = 4         # diagonals this near belong to one copy
MIN_COVER = 0.75    # share of a template's words that a span must cover
SHORT_WORDS = 10    # a template with fewer words must be covered whole
MAX_TEMPLATE_WORDS = 200_000  # bound of the broadcast template table

# Phrases of the base search and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# The Creative Commons licenses and their versions.
CC_KINDS = (("cc-by", "Attribution"), ("cc-by-nc", "Attribution-NonCommercial"), ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
            ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("cc-by-nd", "Attribution-NoDerivatives"),
            ("cc-by-sa", "Attribution-ShareAlike"))
CC_VERSIONS = ("4.0 International", "3.0 Unported", "2.5 Generic", "2.0 Generic")
# SPDX identifiers by label.
SPDX = (("apache-2.0", "Apache-2.0"), ("bsd", "BSD-2-Clause"), ("bsd", "BSD-3-Clause"), ("boost", "BSL-1.0"), ("cc-by", "CC-BY-4.0"),
        ("cc-by-nc", "CC-BY-NC-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"), ("cc0", "CC0-1.0"), ("gpl", "GPL-2.0-only"), ("gpl", "GPL-2.0-or-later"),
        ("gpl", "GPL-3.0-only"), ("gpl", "GPL-3.0-or-later"), ("isc", "ISC"), ("lgpl", "LGPL-2.1-only"), ("lgpl", "LGPL-3.0-or-later"),
        ("mit", "MIT"), ("mpl-2.0", "MPL-2.0"), ("unlicense", "Unlicense"), ("zlib", "Zlib"))
# The parts of public licenses, each a template of its own, so
# that one clause without the others is found too.
PARTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"),
    ("mit", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
            "whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
            "disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
            "derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("boost", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
              "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and "
              "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software "
              "is furnished to do so, all subject to the following:"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
                  "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
             "and redistribute it freely, subject to the following restrictions"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation"),
)
# Customary public notices by label.
TEMPLATES = (
    *((label, f"SPDX-License-Identifier: {name}") for label, name in SPDX),
    *PARTS,
    # further wordings of the short notices below, and the Creative Commons versions
    *(("apache-2.0", f"{verb} under the Apache License{version}") for verb in ("Licensed", "Released", "Distributed", "Available")
      for version in (" 2.0", " v2.0", ", Version 2.0")),
    *(("mit", f"{verb} under the MIT License") for verb in ("Licensed", "Distributed", "Available")),
    *((label, f"This work is licensed under a Creative Commons {kind} {version} License") for label, kind in CC_KINDS for version in CC_VERSIONS),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
)
# Words that tell a template from its variants; a span must hold them unbroken.
DECISIVE = ("any person or organization obtaining", "provided that the above copyright notice",
            "boost software license", "the gnu lesser general public license", "as published by the free software",
            "the apache license", "the gnu general public license", "the mit license", "the mozilla public license",
            *(f"commons {kind} {version[:3]}" for _, kind in CC_KINDS for version in CC_VERSIONS))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lowered; every other ASCII character but a-z and 0-9 separates."""
    return text.translate(WORD_BYTES).split()


def template_table(spark: SparkSession, templates, k: int = K) -> DataFrame:
    """(h, label, template, tpos, n_words, decisive) of every k-word run of the
    templates; ``decisive`` are the runs' positions that a span must have."""
    words, rows, size = hashed_words(), [], 0
    phrases = [words_of(p.encode()) for p in DECISIVE]
    for number, (label, text) in enumerate(templates):
        own = words_of(text.encode())
        size += len(own)
        must = sorted({j for p in phrases for i in range(len(own)) if own[i:i + len(p)] == p for j in range(i, i + len(p) - k + 1)})
        rows += [(int(h), label, number, i, len(own), must) for i, h in enumerate(signed(window_hashes(words.look_up(own), k)))]
    if size > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{size} template words; the broadcast template table is bounded to {MAX_TEMPLATE_WORDS}")
    return spark.createDataFrame(rows, "h bigint, label string, template int, tpos int, n_words int, decisive array<int>")


def _base(batches: Iterator[pa.RecordBatch], phrases) -> Iterator[pa.RecordBatch]:
    """Word counts and the places of the base phrases."""
    table = hashed_words()
    wanted = [(words_of(p.encode()), label) for p, label in phrases]
    for batch in slices(batches):
        docs = [words_of(t) for t in texts(batch)]
        every = table.look_up([w for d in docs for w in d])
        heads = [table.look_up(p)[0] for p, _ in wanted]
        until, out = 0, []
        for own in docs:
            first, until = until, until + len(own)
            places, labels = [], set()
            for (phrase, label), head in zip(wanted, heads):
                at = [int(i) for i in np.flatnonzero(every[first:until] == head) if own[i:i + len(phrase)] == phrase]
                places += at
                labels |= {label} if at else set()
            out.append((len(own), len(places), min(places, default=None), max(places, default=None), sorted(labels)))
        cols = list(zip(*out))
        yield pa.record_batch([batch["id"], batch["th"], *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.list_(pa.string()))],
                              names=["id", "th", "n_words", "n_base", "first_word", "last_word", "base"])


def _grams(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """All rolling k-word hashes of each text."""
    table = hashed_words()
    for batch in slices(batches):
        docs = [words_of(t) for t in texts(batch)]
        every, until, out = table.look_up([w for d in docs for w in d]), 0, []
        for own in docs:
            first, until = until, until + len(own)
            out.append(signed(window_hashes(every[first:until], k)))
        yield pa.record_batch([batch["id"], batch["th"], pa.array(out, pa.list_(pa.int64()))], names=["id", "th", "grams"])


def license_spans(grams: DataFrame, templates: DataFrame, keys: list[str], k: int = K, max_gap: int = MAX_GAP,
                  min_cover: float = MIN_COVER) -> DataFrame:
    """``grams`` (keys, grams) -> verified spans (keys, label, template,
    start, end, cover), no two of a text overlapping."""
    hits = (grams.select(*keys, F.posexplode("grams").alias("pos", "h")).join(F.broadcast(templates), "h")
            .withColumn("diagonal", F.col("pos") - F.col("tpos")))
    votes = hits.groupBy(*keys, "template", "diagonal").agg(
        F.first("label").alias("label"), F.first("n_words").alias("n_words"), F.first("decisive").alias("decisive"),
        F.collect_set("tpos").alias("tpos"))
    order = Window.partitionBy(*keys, "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    runs = votes.withColumn("new", F.when(gap <= max_gap, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy(*keys, "template", "run").agg(
        F.first("label").alias("label"), F.first("n_words").alias("n_words"), F.first("decisive").alias("decisive"),
        F.min(F.col("diagonal") + F.array_min("tpos")).alias("start"),
        (F.max(F.col("diagonal") + F.array_max("tpos")) + k).alias("end"),
        F.array_distinct(F.flatten(F.collect_list("tpos"))).alias("tpos"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("tpos", lambda t: F.sequence(t, t + (k - 1))))))
    least = F.when(F.col("n_words") < SHORT_WORDS, 1.0).otherwise(min_cover)
    verified = (merged.withColumn("covered", covered).withColumn("cover", F.col("covered") / F.col("n_words"))
                .where((F.col("cover") >= least) & (F.size(F.array_except("decisive", "tpos")) == 0)))
    return best_by_place(verified, keys).select(*keys, "label", "template", "start", "end", "cover")


def best_by_place(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The spans that remain when, best first, each one takes its words: by
    cover, covered words, then template as listed.  Only spans that overlap
    in a chain are gathered, so a long text's notices stay apart."""
    order = Window.partitionBy(*keys).orderBy("start", "end", "template")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = (spans.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1))
              .withColumn("place", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    ranked = placed.groupBy(*keys, "place").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("cover")).alias("worse"), (-F.col("covered")).alias("shorter"), "template", "start", "end", "label", "cover"))).alias("spans"))
    meets = lambda s: lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])
    won = F.aggregate("spans", F.filter("spans", lambda s: F.lit(False)),
                      lambda kept, s: F.when(F.exists(kept, meets(s)), kept).otherwise(F.concat(kept, F.array(s))))
    return ranked.select(*keys, F.explode(won).alias("s")).select(*keys, "s.*")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                  phrases=PHRASES, k: int = K) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``, ``labels``, ``score`` and ``n_spans``.

    ``score`` is the best cover of a verified template, at least 0.5 where a
    base phrase stands, else 0.  Null or empty text has no words and no
    label; repeated rows (same id and text) are each returned; of spans
    with the same cover the one with more words, then the template listed
    first, takes the place; an empty table gives no rows.  Texts are scanned
    whole, whatever their length; other columns are ignored whatever their
    names."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"),
                       F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    base = rows.mapInArrow(functools.partial(_base, phrases=phrases),
                           f"id {id_type}, th bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>")
    grams = rows.mapInArrow(functools.partial(_grams, k=k), f"id {id_type}, th bigint, grams array<bigint>")
    spans = license_spans(grams, template_table(docs.sparkSession, templates, k), ["id", "th"], k)
    found = (spans.groupBy(F.col("id").alias("found_id"), F.col("th").alias("found_th"))
             .agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"), F.count(F.lit(1)).alias("n_spans")))
    out = base.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("th") == F.col("found_th")), "left")
    names = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
                      F.array_join("base", ",").alias("base_labels"), F.array_join(names, ",").alias("labels"),
                      score.alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"))
