"""License scan by a positional index of rare words."""

import math

from pyspark.sql import Column, DataFrame, functions as F

# The phrases every scan counts, with their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Label, wording, and the key phrases of the wording that must stand unchanged.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("mit-notice", "released under the mit license", ["mit license"]),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
                 "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
                 "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
                 "portions of the software", ["to deal in the software without restriction", "copies or substantial portions of the software"]),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
                 "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
                 "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
                 "documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce the above copyright notice"]),
    ("apache-text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
                    "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
                    "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
                    "or implied", ["you may not use this file except in compliance with the license"]),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
                 "by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the "
                 "hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular "
                 "purpose", ["under the terms of the gnu general public license"]),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
                 "above copyright notice and this permission notice appear in all copies", ["this permission notice appear in all copies"]),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
                  "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
                  "applications and to alter it and redistribute it freely", ["to alter it and redistribute it freely"]),
]
#: The share of a wording's words that must stand at their places, its key phrases among them.
COVER = 0.75


def license_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, in their own case."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def _places(wording: str, keys: list[str]) -> list[int]:
    """Positions of the key phrases inside the wording."""
    have = wording.split()
    out = set()
    for key in keys:
        part = key.split()
        at = next(i for i in range(len(have)) if have[i:i + len(part)] == part)
        out |= set(range(at, at + len(part)))
    return sorted(out)


def word_idf(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """log(documents / documents with the word) over all documents, for each word of the wordings.

    The driver gets one number for each of these words, whatever the input.
    """
    vocabulary = sorted({w for phrase, _ in BASE for w in phrase.split()} | {w for _, wording, _ in TEMPLATES for w in wording.split()})
    held = F.array_distinct(F.filter(F.transform(license_words(F.col(text_col)), F.lower), lambda w: w.isin(vocabulary)))
    # a row without any word still counts as a document, under the empty word
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in found.collect()}
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def _entries(idf: dict[str, float]) -> list[tuple]:
    """anchor, offset, label, base, wording, places of its key phrases, for each wording.

    The anchor is the rarest word of the key phrases: as those have to stand unchanged, the wording stands nowhere without it. In a base
    phrase every word is one of the key phrase.
    """
    out = []
    for label, wording, keys, base in [(b, p, [p], True) for p, b in BASE] + [(t, w, k, False) for t, w, k in TEMPLATES]:
        have, must = wording.split(), _places(wording, keys)
        at = min(must, key=lambda i: (-idf[have[i]], i))
        out.append((have[at], at, label, base, have, must))
    return out


def _entry(anchor: str, offset: int, label: str, base: bool, have: list[str], must: list[int]) -> Column:
    return F.struct(
        F.lit(anchor).alias("anchor"), F.lit(offset).alias("offset"), F.lit(label).alias("label"), F.lit(base).alias("base"),
        F.array(*map(F.lit, have)).alias("have"), F.array(*map(F.lit, must)).alias("must"),
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    Words are compared with A-Z lower-cased. The corpus tells how rare the words of the wordings
    are; the rarest word of each wording's key phrases leads to it, with its place. Wherever one of these words stands in
    a text, the places of the wording's other words, counted from there, are intersected with the text's: first those of the key
    phrases, all of which must agree, then all others, of which three quarters must, key phrases included. So no
    place that meets the rule is missed. All of it happens inside the row, so nothing is shuffled. The score is the largest share found: 1 for a base phrase, 0 for none.

    A null or empty text has no words, no labels and score 0; null ids stay; repeated rows each
    give their row; no rows give none.
    """
    idf = word_idf(docs, text_col)
    index = _entries(idf)
    rare = sorted({e[0] for e in index})
    table = F.array(*[_entry(*e) for e in index])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), license_words(F.col(text_col)).alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    seen = F.filter(F.transform("words", lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("i"))), lambda s: s["w"].isin(rare))
    rows = rows.withColumn("seen", seen)
    met = F.flatten(F.transform("seen", lambda s: F.transform(
        F.filter(table, lambda t: (t["anchor"] == s["w"]) & (s["i"] >= t["offset"])),
        lambda t: F.struct(t["label"].alias("label"), t["base"].alias("base"), t["must"].alias("must"), F.size(t["have"]).alias("size"),
                           (s["i"] - t["offset"]).alias("start"), t["have"].alias("have")),
    )))
    agrees = lambda m, j: F.lower(F.get(F.col("words"), m["start"] + j)) == F.get(m["have"], j)
    rows = rows.withColumn("met", F.filter(met, lambda m: F.forall(m["must"], lambda j: F.coalesce(agrees(m, j), F.lit(False)))))
    # the places, relative to the start, at which text and wording agree
    rows = rows.withColumn("met", F.transform("met", lambda m: F.struct(
        m["label"].alias("label"), m["base"].alias("base"), m["start"].alias("start"), m["size"].alias("size"),
        F.filter(F.sequence(F.lit(0), m["size"] - 1), lambda j: agrees(m, j)).alias("same"),
    )))
    rows = rows.withColumn("met", F.filter("met", lambda m: F.size(m["same"]) >= m["size"] * COVER))
    base = F.array_distinct(F.transform(F.filter("met", lambda m: m["base"]), lambda m: F.struct(m["start"].alias("start"), m["label"].alias("label"))))
    rows = rows.withColumn("placed", base)
    sorted_labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    share = F.coalesce(F.array_max(F.transform("met", lambda m: F.size(m["same"]) / m["size"])), F.lit(0.0))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.size("placed").cast("long").alias("n_base"),
        F.array_min(F.transform("placed", lambda m: m["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("placed", lambda m: m["start"])).cast("long").alias("last_word"),
        sorted_labels(F.col("placed")).alias("base_labels"), sorted_labels(F.col("met")).alias("labels"), share.alias("score"),
    )
