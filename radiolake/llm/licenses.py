"""Licence scans by canonical digests, in DataFrame functions only.

A text is reduced to a canonical form (case, punctuation, copyright lines and equivalent spellings
do not matter) and looked up by digest among known licence texts: as a whole, paragraph by
paragraph, whatever its line breaks and comment marks, since headers of files are paragraphs,
and line by line, since notices stand in lines of their own.  The lookup is a hash join on the
digest.  Of long licences only the digest of the canonical text is kept here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: usual one-line notices of public licences, then the paragraphs that name a licence
# in its standard header or text
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ),
]
# fixed values: SHA-256 of the canonical form of whole licence texts
DIGESTS = [
    ("Apache-2.0", "a08ea1b9deaaa2e5a35dd2013721b1df8340889ee1420aa2e110191d4afded21"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "d0d142139ba117e0fbb63d29df37776bc9c765c015720dc0ed43bceea6416494"),
    ("GFDL-1.3", "2cdb48855af1603586f28b20f0095e588a4bd77ee484d2c3b89bc3b1f0b61da5"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "24cd241e223e73eb1af195b9e4c0baf03a79bbbb39987eca0e347c1e490442aa"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MPL-1.1", "c3754fa3290eda10675f5ccbdf2525e4717acc479d73ef03524ab7e393bab08c"),
    ("MPL-2.0", "adab0150ac28c044163f4c036faeac192a40d1a7b34a3bc073cf16b67cddbd18"),
]
# fixed values: spellings that count as equal, applied in this order to lower-case text
EQUIVALENT = [
    ("https?://", ""),
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("&", " and "),
    ("(^|[^a-z0-9])(version |ver\\. ?|v\\. ?|v)([0-9])", "$1version $3"),
]
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©]*(©|\(c\)|copyright[^\p{L}\n]*(©|\(c\)|[0-9]))[^\n]*$"


def canonical_text(text: Column) -> Column:
    """Lower-case text of words, single spaces and line breaks, without copyright lines."""
    text = F.lower(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(text, COPYRIGHT_LINE, "")
    for pattern, plain in EQUIVALENT:
        text = F.regexp_replace(text, pattern, plain)
    return F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")


def _lines(canonical: Column) -> Column:
    return F.filter(F.transform(F.split(canonical, "\n"), lambda x: F.btrim(x)), lambda x: x != "")


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line that still has letters or digits, in order."""
    return _lines(canonical_text(text))


def _paragraphs(canonical: Column) -> Column:
    """Different paragraphs of more than one line, each on one line."""
    parts = F.transform(F.split(canonical, "\n *\n"), lambda x: F.btrim(x, F.lit(" \n")))
    wrapped = F.filter(parts, lambda x: F.contains(x, F.lit("\n")))
    return F.array_distinct(F.transform(wrapped, lambda x: F.regexp_replace(x, " *\n *", " ")))


def digest(lines: Column) -> Column:
    """Digest of a canonical text, whatever its line breaks; null where nothing is left."""
    whole = F.array_join(lines, " ")
    return F.when(whole != "", F.sha2(whole, 256))


def known_digests(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the notices, paragraphs and whole texts known here."""
    return digests(known_notices(spark)).unionByName(spark.createDataFrame(DIGESTS, "license_id string, digest string"))


def known_notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license_id string, text string")


def digests(known: DataFrame, id_col: str = "license_id", text_col: str = "text") -> DataFrame:
    """(digest, license_id) of known texts, or of known digests where ``known`` has a column digest;
    of ids with the same canonical text the smallest."""
    found = F.col("digest") if "digest" in known.columns else digest(canonical_lines(F.col(text_col)))
    lines = known.select(F.col(id_col).alias("license_id"), found.alias("digest"))
    return lines.where("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(
    docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: bool = False
) -> DataFrame:
    """(doc_id, whole_license, license_ids, n_lines) of every row.

    whole_license is the licence that the entire text is, or null; license_ids the sorted
    licences of its lines, its paragraphs of several lines and of the whole; n_lines the number of its different lines that are
    known texts.  A null or empty text, or one of copyright lines alone, matches nothing; rows
    that agree in id and text are one.  A paragraph ends at a line without letters and digits or
    at a copyright line.  ``known`` holds texts or digests (see ``digests``); ``small`` says that ``known`` (at most a few thousand
    digests) may be broadcast; otherwise the join shuffles and AQE splits frequent lines.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), canonical_text(F.col(text_col)).alias("canonical")
    )

    def units_of(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), F.sha2(x, 256).alias("digest")))

    lines = _lines(F.col("canonical"))
    whole = F.array(F.struct(F.lit("whole").alias("kind"), digest(lines).alias("digest")))
    every = F.concat(units_of("line", F.array_distinct(lines)), units_of("paragraph", _paragraphs(F.col("canonical"))), whole)
    units = rows.select("doc_id", "th", F.explode(every).alias("unit")).select("doc_id", "th", "unit.*")
    table = digests(known)
    found = (
        units.join(F.broadcast(table) if small else table, "digest")
        .groupBy("doc_id", "th")
        .agg(
            F.max(F.when(F.col("kind") == "whole", F.col("license_id"))).alias("whole_license"),
            F.sort_array(F.collect_set("license_id")).alias("license_ids"),
            F.count_distinct(F.when(F.col("kind") == "line", F.col("digest"))).alias("n_lines"),
        )
    )
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).distinct()
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))
    return keys.join(found, same, "left").select(
        F.col("id").alias("doc_id"),
        "whole_license",
        F.coalesce("license_ids", F.array().cast("array<string>")).alias("license_ids"),
        F.coalesce("n_lines", F.lit(0).cast("bigint")).alias("n_lines"),
    )
