"""Licence scan over a positional rare-token index. Native: SQL functions only.

Each template is a fixed word sequence with a mandatory key phrase. Its postings are (word, template,
position); a word's inverse document frequency is taken over the templates, and each template is looked
up by the ANCHORS words of its key phrase that are rarest. An anchor at file position i proposes template
t at start i - position(anchor in t); the proposals of a template's anchors are intersected, and what all
of them propose is compared with the template word for word. Base phrases must match whole; full templates
may differ in a share of their words but must hold their key phrase at its place, so no place that the
rule accepts lacks an anchor.

All work is narrow: no row leaves its task, the index is a constant of the plan whose size is that
of the fixed template list. Null and empty texts have no words and no labels; extra columns are kept
out; repeated rows give repeated results.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Further templates as (words, mandatory key phrase, label); texts of public licences.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", "bsd-text"),
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("gnu general public license version 2", "gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mozilla public license version 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software", "isc-text"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons attribution sharealike", "creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution 4 0 international", "creative commons attribution 4 0 international", "cc-by-4.0"),
    ("eclipse public license", "eclipse public license", "epl"),
    ("boost software license", "boost software license", "bsl"),
)
LEAST_SHARE = 0.85
ANCHORS = 2
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def index(templates: list[tuple[str, str, str, bool]]) -> list[dict]:
    """Per template: its words, the positions of the mandatory phrase, and its anchors as (word, position):
    different words of that phrase by falling IDF, the longer and then the first of equals."""
    words = [t[0].split() for t in templates]
    df = Counter(w for ws in words for w in set(ws))
    out = []
    for ws, (_, key, label, exact) in zip(words, templates):
        ks = key.split()
        start = next(i for i in range(len(ws)) if ws[i : i + len(ks)] == ks)
        places = range(start, start + len(ks))
        first = {ws[i]: i for i in reversed(places)}
        rare = sorted(first, key=lambda w: (-math.log(len(words) / df[w]), -len(w), first[w]))[:ANCHORS]
        out.append({"words": ws, "anchors": [(w, first[w]) for w in rare], "key": places, "label": label, "exact": exact})
    return out


INDEX = index([(p, p, label, True) for p, label in BASE] + [(w, k, label, False) for w, k, label in TEMPLATES])


def normalised(text: Column) -> Column:
    """Lower-case A-Z, every run of other ASCII signs one space."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NOT_WORD, " "))


def _starts(words: Column, hits: Column, t: dict) -> Column:
    """Starts at which template t stands in the file, from the postings of its anchors."""
    held = {i for _, i in t["anchors"]}

    def fits(start: Column) -> Column:
        same = {i: F.coalesce(F.get(words, start + i) == F.lit(w), F.lit(False)) for i, w in enumerate(t["words"]) if not (t["exact"] and i in held)}
        every = start >= 0
        for i in t["key"]:
            if i in same:
                every = every & same[i]
        if not t["exact"]:
            votes = sum((s.cast("int") for s in same.values()), F.lit(0))
            every = every & (votes >= math.ceil(LEAST_SHARE * len(t["words"])))
        return every

    found = None
    for word, at in t["anchors"]:
        mine = F.transform(F.filter(hits, lambda h: h["w"] == F.lit(word)), lambda h: h["i"] - F.lit(at))
        found = mine if found is None else F.array_intersect(found, mine)
    return F.filter(found, fits)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Matches per document: key, n_words, matches array<struct<label, start, base>>, score."""
    rarest = sorted({t["anchors"][0][0] for t in INDEX})
    anchors = sorted({w for t in INDEX for w, _ in t["anchors"]})
    norm = normalised(F.col(text))
    seen = docs.select(F.col(key).alias(key), norm.alias("_norm"))
    n = F.when(F.col("_norm") == "", 0).otherwise(F.length("_norm") - F.length(F.replace("_norm", F.lit(" "))) + 1).cast("long")
    maybe = F.col("_norm").rlike(r"(?:^| )(?:" + "|".join(rarest) + r")(?: |$)")
    words = F.when(maybe, F.split("_norm", " "))
    step = seen.select(key, n.alias("n_words"), words.alias("_w"))
    hits = F.filter(F.transform(F.col("_w"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(anchors))
    step = step.withColumn("_h", hits)
    def proposals(t: dict) -> Column:
        return F.transform(
            _starts(F.col("_w"), F.col("_h"), t),
            lambda s: F.struct(F.lit(t["label"]).alias("label"), s.cast("long").alias("start"), F.lit(t["exact"]).alias("base")),
        )

    found = [proposals(t) for t in INDEX]
    empty = F.array().cast("array<struct<label:string,start:bigint,base:boolean>>")
    return step.select(key, "n_words", F.when(F.size("_h") > 0, F.concat(*found)).otherwise(empty).alias("matches"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    base = F.filter("matches", lambda m: m["base"])
    label = lambda ms: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))))
    start = F.transform(base, lambda m: m["start"])
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        label(base).alias("base_labels"),
        label(F.col("matches")).alias("labels"),
        F.when(F.size("matches") > 0, 1.0).otherwise(0.0).alias("score"),
    )

