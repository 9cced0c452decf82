"""License scans: TF-IDF cosine to templates, then inheritance from directories.

Units are the sentences that hold a word of licensing, and the whole of a file
named like a licence. Sentences are read twice: line by line, and with the lines of
a paragraph joined and comment marks taken off, as headers are wrapped. A
unit's sparse TF-IDF vector is compared with those of the templates; the best
cosine of ``similar`` or more names the licence. A licence file holds for its
directory: a document without a licence of its own takes that of the nearest
ancestor directory, found by joining the ancestors of directories. Built from
DataFrame operations only.

Inverse document frequencies are counted over all units. Only the words of the
templates have weights of their own, so the table of weights is as bounded as
the templates and is broadcast; any other word counts as one that is in a
single unit.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.durable import cut
from tideline.llm.text import let, row_key, whole
from tideline.operators.postings import small

# Sentences by which common licences are named or begin, and those of their notices.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "you may not use this file except in compliance with the License",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "MIT": (
        "Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "Licensed under the ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "Proprietary": ("All rights reserved", "Copyright, all rights reserved"),
}
#: What names no licence while another one is named.
LAST = ("Proprietary",)
#: A sentence without any of these words is no unit. A template without one adds its own words (:func:`trigger`).
TRIGGER = r"(?i)licen[cs]e|spdx|copyright|permission|redistribution|public domain|rights reserved|mozilla|cc0"
#: Names of licence files.
FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$"
SIMILAR = 0.8
#: A sentence ends at a line end, or at one of these before white space.
STOP = r"([.!?])[\x20\x09-\x0D]+"
#: Comment marks and blanks at the begin of a line.
MARKS = r"\n[\x20\x09#*;%/-]+"
#: Copies of a directory's licence among which directories below it are dealt, where the table is too large to broadcast.
SALTS = 16


def trigger(templates: dict[str, tuple[str, ...]]) -> str:
    """A pattern that every template matches: ``TRIGGER``, and any word of four letters or more (or any at all) of the templates that it misses."""
    more: dict[str, None] = {}
    for texts in templates.values():
        for text in texts:
            if not re.search(TRIGGER, text):
                terms = _terms(text)
                if not terms:
                    raise ValueError("a template without words")
                more |= dict.fromkeys([t for t in terms if len(t) >= 4] or terms)
    return "|".join([TRIGGER, *(re.escape(t) for t in more)])


def _terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _template_words(spark, templates) -> DataFrame:
    """``term, template, tf`` of the template sentences: bounded by the templates."""
    rows = []
    for name, texts in templates.items():
        for k, text in enumerate(texts):
            terms = _terms(text)
            rows += [(t, f"{name}#{k}", float(terms.count(t))) for t in dict.fromkeys(terms)]
    return spark.createDataFrame(rows, "term string, template string, tf double")


def _folder(path: Column) -> Column:
    """The directory of a path, without a slash at either end; the root is empty."""
    return F.regexp_replace(F.regexp_replace(path, "^/+", ""), "/?[^/]*$", "")


def _ancestors(folder: Column) -> Column:
    """A struct (dir, depth) for a directory and each one above it, the root included."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), i.alias("depth")))


def sentences(text: Column, word: str) -> Column:
    """The sentences of a text with a word that matches ``word``: line by line, then those that only joined lines give."""
    hold = lambda x: F.filter(F.split(x, "\n"), lambda s: F.rlike(s, F.lit(word)))
    lines = F.regexp_replace(text, STOP, "$1\n")
    paragraphs = F.regexp_replace(F.regexp_replace(F.concat(F.lit("\n"), text), MARKS, "\n"), "\n\n+", "\x01")
    joined = F.translate(F.regexp_replace(F.translate(paragraphs, "\n", " "), STOP, "$1\n"), "\x01", "\n")
    trimmed = F.transform(hold(joined), lambda x: F.trim(x))
    return let(F.transform(hold(lines), lambda x: F.regexp_replace(x, r"^[\x20\x09#*;%/-]+|[\x20\x09-\x0D]+$", "")), lambda a: F.concat(a, F.array_except(trimmed, a)))


def scan(docs: DataFrame, *, path: Column | str = "path", text: str = "text", ident: str = "doc_id", templates: dict[str, tuple[str, ...]] = TEMPLATES, last: tuple[str, ...] = LAST, similar: float = SIMILAR) -> DataFrame:
    """``doc_id, path, licence, similarity, n_statements, inherited_from, effective`` for each document.

    ``licence``: the best own one (one of ``last`` only if no other is named,
    then highest cosine, then by name), with its cosine; ``n_statements``: own
    units that name any. ``inherited_from``: the
    directory whose licence file holds for a document without its own. Where a
    directory has several licence files, the best match holds.

    Null and empty texts have no licence of their own; a null path has no
    ancestors. Null ``doc_id`` stays null; repeated rows each give a row. Empty
    table: no rows. Extra columns are ignored. Rows that are equal count once in
    the document frequencies. Units of a hot phrase are
    counted by partial aggregation; the vectors of a unit are its own rows.
    """
    spark = docs.sparkSession
    where = F.col(path) if isinstance(path, str) else path
    base = docs.select(F.col(ident).alias("doc_id"), where.cast("string").alias("path"), whole(text).alias("text"))
    base = base.select("*", *row_key(base, "doc_id", "path", "text"))
    word = trigger(templates)
    own = sentences(F.col("text"), word)
    units = F.when(F.rlike(F.coalesce("path", F.lit("")), F.lit(FILE)), F.array_append(own, F.col("text"))).otherwise(F.when(F.rlike("text", F.lit(word)), own))
    words = base.select("k1", "k2", F.posexplode(units).alias("unit", "said")).select("k1", "k2", "unit", F.explode(F.regexp_extract_all(F.lower("said"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    counts = cut(words.groupBy("k1", "k2", "unit", "term").agg(F.count("*").cast("double").alias("tf")))
    known = _template_words(spark, templates)
    total = counts.select("k1", "k2", "unit").distinct().count()
    log = lambda df: F.log((F.lit(total) + 1.0) / (df + 1.0)) + 1.0
    vocabulary = known.select("term").distinct()
    df = counts.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("df"))
    weights = cut(known.join(df, "term", "left").select("term", "template", (F.col("tf") * log(F.coalesce("df", F.lit(0)))).alias("w"), log(F.coalesce("df", F.lit(0))).alias("idf")))
    weights = weights.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template"))))
    names = [f"{n}#{k}" for n, texts in templates.items() for k in range(len(texts))]
    table = weights.groupBy("term").agg(F.first("idf").alias("idf"), F.array(*(F.coalesce(F.sum(F.when(F.col("template") == n, F.col("w"))), F.lit(0.0)) for n in names)).alias("ws"))
    weighed = counts.join(F.broadcast(table), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", log(F.lit(1))))
    ws = F.coalesce("ws", F.array(*[F.lit(0.0)] * len(names)))
    dots = weighed.groupBy("k1", "k2", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.array(*(F.sum(F.col("x") * F.get(ws, F.lit(i))) for i in range(len(names)))).alias("dots"))
    scored = F.transform(F.array(*(F.struct(F.lit(n.split("#")[0]).alias("name"), F.get("dots", F.lit(i)).alias("dot")) for i, n in enumerate(names))), lambda t: F.struct(t["name"].isin(*last).alias("last"), (-F.round(t["dot"] / F.col("norm"), 6)).alias("less"), t["name"].alias("licence")))
    best = dots.select("k1", "k2", F.array_min(F.filter(scored, lambda t: t["less"] <= -similar)).alias("best")).where("best is not null")
    own = cut(best.groupBy("k1", "k2").agg(F.min("best").alias("best"), F.count("*").alias("n")))
    rows = base.select("doc_id", "path", "k1", "k2").join(own, ["k1", "k2"], "left")
    rows = cut(rows.select("doc_id", "path", "k1", "k2", "best", F.coalesce("n", F.lit(0)).cast("long").alias("n_statements")))

    files = rows.where(F.rlike("path", F.lit(FILE)) & F.col("best").isNotNull())
    folders = cut(files.select(_folder(F.col("path")).alias("dir"), "best").groupBy("dir").agg(F.min("best").alias("from")))
    if folders.isEmpty():
        return rows.select("doc_id", "path", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("similarity"), "n_statements", F.lit(None).cast("string").alias("inherited_from"), F.col("best.licence").alias("effective"))
    # each directory with documents is looked up once, however many documents it has; the root is above all of them
    below = rows.where("best is null and path is not null").select(_folder(F.col("path")).alias("folder")).distinct()
    above = below.select("folder", F.pmod(F.xxhash64("folder"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(_ancestors(F.col("folder"))).alias("a")).select("folder", "salt", F.col("a.dir").alias("dir"), F.col("a.depth").alias("depth"))
    given = small(folders)
    if given is folders:
        given, on = folders.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["dir", "salt"]
    else:
        on = ["dir"]
    nearest = cut(above.join(given, on).groupBy("folder").agg(F.max_by(F.struct("dir", F.col("from.licence").alias("licence")), "depth").alias("given")))
    rows = rows.withColumn("folder", F.when(F.col("best").isNull(), _folder(F.col("path")))).join(small(nearest), "folder", "left")
    return rows.select("doc_id", "path", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("similarity"), "n_statements", F.col("given.dir").alias("inherited_from"), F.coalesce("best.licence", "given.licence").alias("effective"))
