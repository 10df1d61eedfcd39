"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance down directories."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import written

#: Notices by which licences are declared, several for one licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", "Licensed under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal public domain dedication"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "Copyright. All rights reserved. Unauthorised copying is prohibited"),
]
#: The GNU licences, whose notices differ in little but name and version.
GNU = [("GPL-2.0", "General", "program", "2"), ("GPL-3.0", "General", "program", "3"), ("LGPL-2.0", "Library General", "library", "2"), ("LGPL-2.1", "Lesser General", "library", "2.1"),
       ("LGPL-3.0", "Lesser General", "library", "3"), ("AGPL-3.0", "Affero General", "program", "3")]
for _id, _name, _noun, _version in GNU:
    TEMPLATES += [(_id, f"This work is licensed under the GNU {_name} Public License, version {_version}"), (_id, f"GNU {_name} Public License Version {_version}"), (_id, f"SPDX-License-Identifier: {_id}-only"),
                  (_id, f"This {_noun} is free software; you can redistribute it and/or modify it under the terms of the GNU {_name} Public License as published by the Free Software Foundation; either version {_version} of the License, or (at your option) any later version")]
#: A notice of a GNU licence that names no version leaves the choice.
ANY_VERSION = {"GPL": "GPL-1.0-or-later", "LGPL": "LGPL-2.0-or-later", "AGPL": "AGPL-1.0-or-later"}
#: The sentence that all BSD texts share; the clauses that follow tell them apart.
BSD_TEXT = next(i for i, (_, text) in enumerate(TEMPLATES) if text.startswith("Redistribution and use"))
#: A statement is a header candidate if it holds one of these; every template does.
ANCHORS = r"(?i)licen[sc]|spdx|\bgnu\b|copyright|rights reserved|permission is hereby|redistribution and use|public domain"
#: Least cosine of a statement to a template, and least part of a file's words in its best statement for a licence file.
COSINE, FILE_SHARE = 0.6, 0.2
#: An SPDX tag and the first identifier after it.
SPDX = r"(?i)spdx-license-identifier:[\s(]*([a-z0-9][a-z0-9.+-]*)"
#: Names of licence files, whatever their extension.
FILE_NAME = r"(?i)^(licen[sc]e|copying|unlicense)([._-][^/]*)?$"
#: Names that only a licence's own text has.
OWN_NAME = r"(?i)^(licen[sc]e|copying|unlicense)(\.(txt|md|rst))?$"
#: What stands at the beginning of a line in comments.
LEAD = r"[ \t/*#;!%>-]*"
SENTENCES = r"(?<=[.!?])[ \t]+(?=\p{Lu})"


def terms(text: Column) -> Column:
    """Lower-case runs of letters, and numbers with their points ("2.0")."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+(?:\.[0-9]+)?|\pL+"), F.lit(0))


def statements(text: Column) -> Column:
    """What holds an anchor in a text, as (statement, whole): sentences within lines, and whole sentences of paragraphs that
    run over several lines, without line ends and marks of comments."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.filter(F.split(text, SENTENCES + r"|[\r\n]+"), lambda s: s.rlike(ANCHORS))
    paragraphs = F.filter(F.split(text, rf"(?:\r\n|[\r\n]){LEAD}(?:\r\n|[\r\n])"), lambda s: s.rlike(ANCHORS) & s.rlike(r"\S[ \t]*[\r\n]"))
    joined = F.transform(paragraphs, lambda s: F.regexp_replace(s, rf"[ \t]*[\r\n]+{LEAD}", " "))
    whole = F.filter(F.flatten(F.transform(joined, lambda s: F.split(F.regexp_replace(s, "^" + LEAD, ""), SENTENCES))), lambda s: s.rlike(ANCHORS))
    said = [F.transform(x, lambda s: F.struct(s.alias("statement"), F.lit(flag).alias("whole"))) for x, flag in ((parts, False), (F.array_except(whole, parts), True))]
    return F.when(text.rlike(ANCHORS), F.concat(*said)).otherwise(F.array().cast("array<struct<statement:string,whole:boolean>>"))


def clauses(text: Column) -> Column:
    """3 or 2 for a text that holds so many of the clauses of the BSD licences, else 0."""
    flat = F.regexp_replace(text.cast("string"), r"[\s/*#;!%>-]+", " ")
    count = F.when(flat.rlike("(?i)neither the names? of|endorse or promote"), 3).when(flat.rlike("(?i)binary form must reproduce"), 2).otherwise(0)
    return F.when(F.coalesce(text.cast("string").rlike(r"(?i)redistribution\s+and\s+use|binary\s+form"), F.lit(False)), count).otherwise(0)


def gnu_family(statement: Column) -> Column:
    """Which of the GNU licences a statement names; empty: none."""
    names = [("AGPL", r"affero|\bagpl"), ("LGPL", r"(?:lesser|library)\s+general|\blgpl"), ("GPL", r"general\s+public|\bgpl")]
    return F.coalesce(*[F.when(statement.rlike("(?i)" + pattern), name) for name, pattern in names], F.lit(""))


def versions(statement: Column) -> Column:
    """The versions that a statement names, without a final .0."""
    found = F.regexp_extract_all(F.lower(statement), F.lit(r"(?:version|\bv|gpl)[\s,v.-]*([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.transform(found, lambda v: F.regexp_replace(v, r"\.0$", ""))


def declared(statement: Column) -> Column:
    """The licence that an SPDX tag names, exactly; null: no tag. Of an expression the first identifier counts; whether later
    versions are allowed is left out, as in the notices."""
    named = F.regexp_replace(F.regexp_extract(statement, SPDX, 1), r"(?i)(-only|-or-later|\+|[.-])$", "")
    known = F.create_map(*[F.lit(x) for name in dict.fromkeys(name for name, _ in TEMPLATES) for x in (name.lower(), name)])
    return F.when(named != "", F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, _: k == F.lower(named))), F.lit(0)), named))


def templates(spark) -> DataFrame:
    """(template, license, term, tf): the terms of every template."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))


def matched(files: DataFrame) -> DataFrame:
    """(row, license, cosine, share): the best template of each file's statements (row, said, words), with at least ``COSINE``.

    A GNU template is met only by statements of its family that name its version; one that names none stands for any
    version and gives way to all others. So a line out of a longer notice cannot decide on a version. The sentence that
    BSD texts share is judged by the clauses in the file. An SPDX tag decides by its identifier, with cosine 1, also for a
    licence without a template. That all rights are reserved gives way to any grant in the file.

    A term's weight is tf * idf with idf = ln((1 + N) / (1 + df)) + 1 over the N candidate statements of all files and the
    templates' own df counted there; dot products run over the terms that stand in a template. Equal statements are one row
    until the end, so a notice in a third of all files is compared once. Ties: the higher cosine, then the first template.
    """
    spark = files.sparkSession
    found = files.select("row", "words", "clauses", F.explode("said").alias("s")).select("row", "words", "clauses", "s.*")
    sizes = found.groupBy("statement").agg(F.count(F.lit(1)).alias("n"))
    distinct = written(sizes.withColumn("terms", terms(F.col("statement"))), slim=True)
    total = distinct.agg(F.sum("n").alias("n")).first()["n"] or 0
    seen = distinct.select("n", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    idf = written(seen.withColumn("idf", F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).select("term", "idf"), slim=True)
    most = F.log(1 + F.lit(total)) + 1  # of a term that no statement holds
    entries = templates(spark).join(idf, "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", most)).drop("idf", "tf")
    norms = entries.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    entries = entries.join(norms, "template")
    counted = distinct.select("statement", F.explode("terms").alias("term")).groupBy("statement", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = written(counted.join(idf, "term").select("statement", "term", (F.col("tf") * F.col("idf")).alias("w")), slim=True)
    lengths = weighted.groupBy("statement").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighted.join(entries, "term").groupBy("statement", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.first("norm").alias("norm"))
    scored = dots.join(lengths, "statement").withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 9)).filter(F.col("cosine") >= COSINE)
    family, named = F.regexp_extract("license", "^([AL]?GPL)-", 1), F.regexp_replace(F.regexp_extract("license", r"([0-9.]+)$", 1), r"\.0$", "")
    scored = scored.withColumns({"family": family, "versions": versions(F.col("statement"))}).filter((F.col("family") == "") | (F.col("family") == gnu_family(F.col("statement"))))
    fixed = (F.col("family") == "") | (F.size("versions") > 0)
    scored = scored.filter((F.col("family") == "") | ~fixed | F.array_contains("versions", named)).withColumn("fixed", fixed)
    for short, whole in ANY_VERSION.items():
        scored = scored.withColumn("license", F.when(~F.col("fixed") & (F.col("family") == short), whole).otherwise(F.col("license")))
    scored = scored.select("statement", "fixed", "cosine", (-F.col("template")).alias("order"), "license")
    tagged = distinct.select("statement", F.lit(True).alias("fixed"), F.lit(1.0).alias("cosine"), F.lit(1).alias("order"), declared(F.col("statement")).alias("license"))
    scored = scored.unionByName(tagged.filter("license is not null")).withColumn("grant", F.col("license") != "Proprietary")
    best = scored.groupBy("statement").agg(F.max(F.struct("grant", "fixed", "cosine", "order", "license")).alias("b"))
    counts = F.when(F.col("b.order") == 1, F.size(terms(F.regexp_extract("statement", SPDX, 0)))).otherwise(F.col("terms"))  # of a tag, no words after it
    best = written(best.join(distinct.select("statement", F.size("terms").alias("terms")), "statement").select("statement", "b.*", counts.alias("terms")), slim=True)
    hits = found.join(best, "statement")
    held = lambda whole: F.coalesce(F.sum(F.when(F.col("whole") == whole, F.col("terms"))), F.lit(0))
    top = hits.groupBy("row").agg(F.max(F.struct("grant", "fixed", "cosine", "order", "license")).alias("b"), F.greatest(held(True), held(False)).alias("terms"), F.first("words").alias("words"), F.first("clauses").alias("clauses"))
    license = F.when((F.col("b.order") == -BSD_TEXT) & (F.col("clauses") == 2), "BSD-2-Clause").otherwise(F.col("b.license"))
    return top.select("row", license.alias("license"), "b.cosine", (F.col("terms") / F.col("words")).alias("share"))


def scan(files: DataFrame) -> DataFrame:
    """``files`` (path, text, ...) with license, origin, cosine and from_path.

    origin ``file``: a licence file, by its name or because its notices make ``FILE_SHARE`` of its words; ``header``: a
    notice in the text; ``inherited``: none, but the nearest directory above has a licence file, whose path is from_path;
    ``none`` otherwise. A file with a licence text's own name (``OWN_NAME``) inherits nothing, also if no template is like it. A directory with several licence files passes on the one with the highest cosine, then the
    first path.

    Every directory above a file is a row of one table of distinct directories, joined by path with the directories of
    licence files; the nearest is the longest. Files meet it by their own directory, as plain tables on both sides, so a
    directory with a third of all files can be split. Null text holds no notice, null path inherits nothing. Rows that repeat stay rows; an empty table gives an empty table.
    """
    added = ["license", "origin", "cosine", "from_path"]
    keep = [c for c in files.columns if c not in added]
    back = [c for c in keep if c != "text"]
    said = files.select(*keep).withColumn("said", statements(F.col("text")))
    words = F.when(F.size("said") > 0, F.size(terms(F.col("text").cast("string")))).otherwise(0)
    rows = written(said.select(*back, "said", words.alias("words"), clauses(F.col("text")).alias("clauses"), F.monotonically_increasing_id().alias("row")))  # the texts are read once and left behind
    found = rows.drop("said", "words", "clauses").join(matched(rows), "row", "left").select(*back, "row", "license", "cosine", "share")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    name = F.substring_index("path", "/", -1)
    by_name = F.coalesce(name.rlike(FILE_NAME), F.lit(False))
    is_file = F.col("license").isNotNull() & (by_name | (F.col("share") >= FILE_SHARE))
    found = written(found.withColumns({"folder": folder, "is_file": is_file, "heir": F.col("license").isNull() & ~F.coalesce(name.rlike(OWN_NAME), F.lit(False))}), slim=True)
    passed = found.filter("is_file and folder is not null").groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "path", "license")).alias("b"))
    passed = written(passed.select(F.col("folder").alias("above"), F.col("b.license").alias("given"), F.col("b.path").alias("from_path")), slim=True)
    folders = found.filter("heir and folder is not null").select("folder").distinct()
    steps = F.split("folder", "/")
    levels = F.transform(F.sequence(F.size(steps), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    ways = folders.select("folder", F.posexplode(F.array_distinct(F.concat(levels, F.array(F.lit(""))))).alias("up", "above"))
    nearest = ways.join(passed, "above").groupBy("folder").agg(F.min_by(F.struct("given", "from_path"), "up").alias("x"))
    nearest = written(nearest.select("folder", "x.*"), slim=True)
    joined = found.join(nearest.withColumnRenamed("folder", "at"), F.col("heir") & (F.col("folder") == F.col("at")), "left")
    own = F.col("license").isNotNull()
    origin = F.when(F.col("is_file"), "file").when(own, "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return joined.select(*back, F.coalesce("license", "given").alias("license"), origin.alias("origin"), "cosine", F.when(~own, F.col("from_path")).alias("from_path"))
