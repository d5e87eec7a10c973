"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Fixed notices (public standard wording).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "All-rights-reserved": "All rights reserved.",
}

#: Words of a shingle, bands of one MinHash value each, and the containment that a match needs, in percent.
SHINGLE, BANDS, PERCENT = 3, 48, 80
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _size_class(n: int) -> int:
    """Window length in shingles for a template of n: a power of two, at least twice n. Windows advance by half of it,
    so a passage of up to half the length, as n is, lies whole in one of them."""
    return 1 << max(2, (2 * n - 1).bit_length())


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _shingles(w: Column) -> Column:
    """Hashes of SHINGLE consecutive words, in order of the text; of fewer words none."""
    n = F.size(w)
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])))


def _bands(shingles: Column) -> Column:
    """The smallest hash under each permutation (seeded hashes)."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))))


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = [(k, template_words(v)) for k, v in templates.items()]
    rows = [(k, w, _size_class(len(w) - SHINGLE + 1)) for k, w in rows if len(w) >= SHINGLE]
    t = spark.createDataFrame(rows, "license string, w array<string>, length int")
    return t.withColumn("t_shingles", F.array_distinct(_shingles(F.col("w")))).drop("w")


def _place(anchors: list[int], step: int) -> Callable:
    return lambda x, i: F.when(x.isin(anchors), F.floor(i / step).cast("int"))


def _window(step: int, length: int) -> Callable:
    return lambda x: F.array_distinct(F.slice("s", x * step + 1, length))


def _matches(templates: list[Row], percent: int) -> Callable:
    longs = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")

    def hit(t: Row, w: Column) -> Column:
        inside = F.size(F.array_intersect(longs(t["t_shingles"]), w["shingles"]))
        return F.arrays_overlap(longs(t["t_bands"]), w["bands"]) & (100 * inside >= percent * len(t["t_shingles"]))

    return lambda w: F.array_compact(F.array(*[F.when(hit(t, w), F.lit(t["license"])) for t in templates]))


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read): doc_id, licenses (sorted array of
    the templates found; empty for null and empty texts), n_windows (windows in which they were found).

    A template is found where a window of the text contains at least ``percent`` of its distinct word shingles.
    Templates with fewer than SHINGLE words are left out. Repeated rows and null ids are kept as they are.

    A window is twice to four times as long as its template, so at a containment of 0.8 they are alike (Jaccard) in
    0.8 / 4.2 > 0.19 at least, and some of the BANDS one-value bands agree with probability over
    1 - (1 - 0.19)**48 > 0.9999. A band can only agree if its smallest template hash is a shingle of the window, so
    signatures are made of the windows that hold such an anchor, and of no others; that loses nothing. A row is
    handled by itself: there is no shuffle and nothing to skew.
    """
    known = _templates(spark, templates or TEMPLATES).withColumn("t_bands", _bands(F.col("t_shingles")))
    # the library of templates is a parameter, and of its own size only
    known = known.withColumn("anchors", F.filter("t_shingles", lambda s: F.exists("t_bands", lambda m: F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(s, k) == m)))).collect()
    anchors = {n: sorted({s for t in known if t["length"] == n for s in t["anchors"]}) for n in sorted({t["length"] for t in known})}
    every = sorted({s for a in anchors.values() for s in a})
    rows = docs.select("doc_id", words("text").alias("w")).select("doc_id", _shingles(F.col("w")).alias("s"))
    rows = rows.select("doc_id", F.when(F.exists("s", lambda x: x.isin(every)), F.col("s")).alias("s"))
    found = []
    for n, mine in anchors.items():
        step = n // 2
        # a place lies in the window that starts at its own half length and in the one before
        rows = rows.withColumn(f"p{n}", F.array_compact(F.transform("s", _place(mine, step))))
        rows = rows.withColumn(f"p{n}", F.array_distinct(F.concat(f"p{n}", F.transform(f"p{n}", lambda x: F.greatest(x - 1, F.lit(0))))))
        rows = rows.withColumn(f"w{n}", F.transform(f"p{n}", _window(step, n)))
        rows = rows.withColumn(f"w{n}", F.transform(f"w{n}", lambda x: F.struct(x.alias("shingles"), _bands(x).alias("bands"))))
        found.append(F.transform(f"w{n}", _matches([t for t in known if t["length"] == n], percent)))
    none = F.array().cast("array<array<string>>")
    rows = rows.select("doc_id", F.concat(none, *[F.coalesce(x, none) for x in found]).alias("found"))
    return rows.select("doc_id", F.array_sort(F.array_distinct(F.flatten("found"))).alias("licenses"), F.size(F.filter("found", lambda x: F.size(x) > 0)).cast("long").alias("n_windows"))
