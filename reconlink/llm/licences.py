"""Licence recognition by sentences and ordered rules, in DataFrame functions only.

A text is cut into sentences, a sentence is normalised (lower case, letters, digits and dots
only, single spaces) and looked up among known licence sentences, each with an identifier. A
document is then the sequence of its identifiers in text order, and licence rules, short
sequences of identifiers, are matched against it in their order: a rule may skip over other
sentences' identifiers but not swap its own, and once a rule has matched, rules that it covers
are not reported.

The sentence and rule tables are fixed small lists and are broadcast. Only found sentences are
shuffled; documents are never joined by text.

Cases: null and empty texts have no licence; a sentence may be wrapped over lines and stand in a comment
block, but a blank line ends it;
repeated sentences count once in a row; repeated rows are scanned each (rows without a doc_id or
with the same one are told apart by their text).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# Licence sentences in normal form and their identifiers.
SENTENCES = (
    ("mit-released", "released under the mit license"),
    ("mit-released", "licensed under the mit license"),
    ("mit-released", "this project is licensed under the mit license"),
    ("mit-title", "the mit license mit"),
    ("mit-title", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2-under", "licensed under the apache license version 2.0"),
    ("apache-2-under", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("apache-2-under", "licensed under the apache license version 2.0 the license"),
    ("apache-2-comply", "you may not use this file except in compliance with the license"),
    ("apache-2-copy", "you may obtain a copy of the license at"),
    ("apache-2-basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-2-under", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3-under", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3-under", "licensed under the gnu general public license version 3"),
    ("gpl-2-under", "licensed under the gnu general public license version 2"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-free-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v. 2.0"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4", "licensed under cc by 4.0"),
    ("cc-by-4", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-sa-4", "licensed under cc by sa 4.0"),
    ("cc-by-sa-4", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by-nc-4", "licensed under cc by nc 4.0"),
    ("cc-by-nc-4", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-nd-4", "licensed under cc by nd 4.0"),
    ("reserved", "all rights reserved"),
)
# Rules in order; the identifiers of a rule follow one another in the text.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-released",)),
    ("Apache-2.0", ("apache-2-under", "apache-2-copy", "apache-2-basis")),
    ("Apache-2.0", ("apache-2-under",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-free-2",)),
    ("LGPL-2.1-or-later", ("lgpl-free",)),
    ("GPL-3.0-only", ("gpl-3-under",)),
    ("GPL-2.0-only", ("gpl-2-under",)),
    ("MPL-2.0", ("mpl-2",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("Proprietary", ("reserved",)),
)
#: a rule that matched hides the later rules that its licence covers
COVERS = {"BSD-3-Clause": ("BSD-2-Clause",), "MIT": ("Proprietary",), "Apache-2.0": ("Proprietary",), "BSD-2-Clause": ("Proprietary",)}
#: comment and list marks at the beginning of a line
MARKS = r"(^|[\n\r])[ \t]*(?:(?:[#*>!;%|]+|//+\*?|/\*+|--+|<!--|\(?[0-9A-Za-z]\))(?=\s|$)[ \t]*)+"
BLANK = r"(?:\r\n|\n|\r(?!\n))[ \t]*(?:\r\n|\n|\r(?!\n))\s*"
BREAK = r"[.!?;:]+(?:\s+|$)|[\n\r]+"


def normal(sentence: Column) -> Column:
    low = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(low, r"(?:^|\s)\.+", " "))


def whole(text: Column) -> Column:
    """Normal form with single spaces, also where ``normal`` took a dot between two."""
    return F.trim(F.regexp_replace(normal(text), " +", " "))


def found_sentences(docs: DataFrame, sentences: tuple = SENTENCES) -> DataFrame:
    """One row per known sentence in a text: doc_id, text key, place, identifier.

    A sentence begins and ends at a BREAK, and may go over others that its known form agrees with (line
    breaks of wrapped text, semicolons), but over no blank line. Texts that hold no known
    sentence as words one after another, wherever it ends, are left out before that is looked at.
    """
    wanted = sorted({s for _, s in sentences})
    known = F.broadcast(docs.sparkSession.createDataFrame([*dict.fromkeys(sentences)], "sentence_id string, sentence string"))
    least = [s for s in wanted if not any(o != s and o in s for o in wanted)]
    text = F.translate(F.regexp_replace("text", MARKS, "$1"), "\x01", " ")
    some = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text.alias("raw"))
    # as a lambda's argument the normal form is made once for all comparisons
    some = some.where(F.exists(F.array(whole(F.col("raw"))), lambda flat: reduce(or_, [flat.contains(s) for s in least])))
    paragraphs = some.select("doc_id", "text_key", F.posexplode(F.split("raw", BLANK)).alias("paragraph", "raw"))
    # each piece with the marks after it, which matter within a sentence
    pieces = F.split(F.regexp_replace("raw", f"(?:{BREAK})", "$0\x01"), "\x01")
    own = paragraphs.select("doc_id", "text_key", "paragraph", F.filter(F.transform(pieces, whole), lambda x: F.rtrim(x, F.lit(".")) != "").alias("own"))
    words = max(s.count(" ") + 1 for s in wanted)

    def begins(piece: Column) -> Column:
        bare = F.rtrim(piece, F.lit("."))
        return F.exists(F.array(*[F.lit(f"{s} ") for s in wanted]), lambda s: s.startswith(F.concat(bare, F.lit(" "))) | s.startswith(F.concat(piece, F.lit(" "))))

    starts = F.filter(F.transform("own", lambda x, i: F.when(begins(x), F.struct(i.alias("at"), F.slice("own", i + 1, F.lit(words)).alias("run")))), lambda x: x.isNotNull())
    runs = own.select("doc_id", "text_key", "paragraph", F.explode(starts).alias("start")).select("doc_id", "text_key", "paragraph", "start.at", "start.run")
    each = runs.select("doc_id", "text_key", "paragraph", "at", "run", F.explode(F.sequence(F.lit(1), F.size("run"))).alias("size"))
    told = each.withColumn("sentence", F.rtrim(F.array_join(F.slice("run", F.lit(1), F.col("size")), " "), F.lit(".")))
    return told.join(known, "sentence").select("doc_id", "text_key", F.struct("paragraph", "at", (-F.col("size")).alias("size")).alias("place"), "sentence_id")


def matched(sequence: Column, rule: tuple[str, ...]) -> Column:
    """Whether the identifiers of a rule follow one another in ``,a,b,c,``, others between them allowed."""
    return sequence.rlike(f",{',(.*,)?'.join(rule)},")


def licences(docs: DataFrame, sentences: tuple = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """One row per document with a known sentence: doc_id, licences, sentence identifiers in order."""
    found = found_sentences(docs, sentences)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence_id"))), lambda x: x["sentence_id"])
    rows = found.groupBy("doc_id", "text_key").agg(ordered.alias("ids"))
    # repeated sentences in a row count once
    lone = F.filter(F.col("ids"), lambda x, i: (i == 0) | (x != F.element_at(F.col("ids"), F.greatest(i, F.lit(1)))))
    rows = rows.withColumn("sequence", F.concat(F.lit(","), F.array_join(lone, ","), F.lit(",")))
    hits = F.array_compact(F.array_distinct(F.array(*[F.when(matched(F.col("sequence"), ids), F.lit(name)) for name, ids in rules])))
    hidden = F.flatten(F.transform(F.col("hits"), lambda h: F.coalesce(*[F.when(h == k, F.array(*[F.lit(x) for x in v])) for k, v in COVERS.items()], F.array().cast("array<string>"))))
    return rows.withColumn("hits", hits).select("doc_id", F.array_join(F.array_except("hits", hidden), " AND ").alias("licences"), F.col("sequence").alias("sentence_ids"))


def licence_sql() -> str:
    """The same in DuckDB's SQL, over ``documents``."""
    known = ", ".join(f"('{i}', '{s}')" for i, s in dict.fromkeys(SENTENCES))
    cases = []
    for name, ids in RULES:
        cases.append(f"CASE WHEN regexp_matches(sequence, ',{',(.*,)?'.join(ids)},') THEN '{name}' END")
    covers = ", ".join(f"('{k}', '{x}')" for k, v in COVERS.items() for x in v)
    order = ", ".join(f"('{name}', {n})" for n, name in enumerate(dict.fromkeys(name for name, _ in RULES)))
    return f"""
        WITH known(sentence_id, sentence) AS (VALUES {known}), covers(name, under) AS (VALUES {covers}), rank(name, n) AS (VALUES {order}),
        cut AS (SELECT doc_id, md5(text) AS text_key, unnest(regexp_split_to_array(text, '[.!?;:]+(?:\\s+|$)|[\\n\\r]+')) AS raw,
                       generate_subscripts(regexp_split_to_array(text, '[.!?;:]+(?:\\s+|$)|[\\n\\r]+'), 1) AS place FROM documents),
        told AS (SELECT doc_id, text_key, place, trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9.]+', ' ', 'g'), '(?:^|\\s)\\.+', ' ', 'g')) AS sentence FROM cut WHERE length(raw) > 8),
        hit AS (SELECT doc_id, text_key, place, sentence_id FROM told JOIN known USING (sentence)),
        lone AS (SELECT *, lag(sentence_id) OVER (PARTITION BY doc_id, text_key ORDER BY place) AS before FROM hit),
        seq AS (SELECT doc_id, text_key, ',' || string_agg(sentence_id, ',' ORDER BY place) || ',' AS sequence FROM lone WHERE before IS NULL OR before <> sentence_id GROUP BY ALL),
        named AS (SELECT DISTINCT doc_id, text_key, sequence, unnest([{', '.join(cases)}]) AS name FROM seq),
        kept AS (SELECT n.doc_id, n.text_key, n.name, r.n FROM named n JOIN rank r ON r.name = n.name
                 WHERE NOT EXISTS (SELECT 1 FROM named m JOIN covers c ON c.name = m.name WHERE m.doc_id = n.doc_id AND m.text_key = n.text_key AND c.under = n.name)),
        listed AS (SELECT doc_id, text_key, string_agg(name, ' AND ' ORDER BY n) AS licences FROM kept GROUP BY ALL)
        SELECT s.doc_id, coalesce(l.licences, '') AS licences, s.sequence AS sentence_ids FROM seq s LEFT JOIN listed l USING (doc_id, text_key)
    """
