"""License scan by diagonal voting.

Every rolling k-gram of words of every text is joined to the positions of the license templates that hold
it. Hits are counted by diagonal (position in the text less position in the template), neighbouring
diagonals are merged (a word put in or left out moves the rest by one), and a merged diagonal is a span
if it covers enough of the template densely enough.

Defined results: null or empty text has no words, no labels and score 0. Rows that share doc_id and text
get equal rows. Other columns are ignored. Very long texts are handled whole, a document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.llm import textbytes as tb
from lineloom.llm.rows import per_batch, texts

K = 3
MERGE_GAP = 3
MIN_COVERAGE = 0.6
MIN_DENSITY = 0.5
#: A template table of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000

PHRASES = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]

TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc", "This work is licensed under a Creative Commons Attribution"),
]


def _scan(column: pa.Array) -> Iterator[tuple[tb.Slice, tb.Words, np.ndarray]]:
    for s in tb.slices(column):
        data = tb.LOWER[s.data]
        w = tb.words(s, data, tb.LETTERS)
        yield s, w, tb.span_hash(tb.prefix_hash(data), w.starts, w.ends)


def _hashes(text: str) -> np.ndarray:
    return next(_scan(pa.array([text])))[2]


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> tuple[DataFrame, int]:
    """(gram, template, label, t_pos, t_grams) of every template, and the number of rows."""
    rows = []
    for t, (label, text) in enumerate(templates):
        s, w, h = next(_scan(pa.array([text])))
        grams, at = tb.shingles(s, w, h, k)
        rows += [(int(g), t, label, int(p), len(grams)) for g, p in zip(grams.view(np.int64), at, strict=True)]
    return spark.createDataFrame(rows, "gram long, template int, label string, t_pos long, t_grams int"), len(rows)


def base_counts(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """One row per text: doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels."""
    wanted = [(list(_hashes(" ".join(p)).tolist()), label) for p, label in phrases]

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = 0
        for s, w, h in _scan(b.column(2)):
            n_base = np.zeros(s.n, np.int64)
            first = np.full(s.n, np.iinfo(np.int64).max)
            last = np.full(s.n, -1)
            labels: list[set[str]] = [set() for _ in range(s.n)]
            docs_of = w.docs
            for hs, label in wanted:
                m = len(hs)
                if len(h) < m:
                    continue
                ok = docs_of[: len(h) - m + 1] == docs_of[m - 1 :]
                for i, x in enumerate(hs):
                    ok &= h[i : len(h) - m + 1 + i] == np.uint64(x)
                at = np.flatnonzero(ok)
                d = docs_of[at]
                np.add.at(n_base, d, 1)
                np.minimum.at(first, d, at - w.of[d])
                np.maximum.at(last, d, at - w.of[d])
                for x in set(d.tolist()):
                    labels[x].add(label)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(done, s.n), b.column(1).slice(done, s.n), pa.array(w.counts), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(x)) for x in labels])],
                names=["doc_id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base_labels"],
            )
            done += s.n

    keyed = texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return per_batch(keyed, make, "doc_id long, text_hash long, n_words long, n_base long, first_word long, last_word long, base_labels string")


def gram_rows(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text_hash, pos, gram) of every rolling k-gram of words."""

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = 0
        for s, w, h in _scan(b.column(2)):
            grams, at = tb.shingles(s, w, h, k)
            cut = np.searchsorted(at, w.of).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(done, s.n), b.column(1).slice(done, s.n), pa.ListArray.from_arrays(pa.array(cut), pa.array(grams.view(np.int64)))], names=["doc_id", "text_hash", "grams"])
            done += s.n

    keyed = texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return per_batch(keyed, make, "doc_id long, text_hash long, grams array<long>").select("doc_id", "text_hash", F.posexplode("grams").alias("pos", "gram"))


def license_spans(docs: DataFrame, templates=TEMPLATES, k: int = K, gap: int = MERGE_GAP, coverage: float = MIN_COVERAGE, density: float = MIN_DENSITY) -> DataFrame:
    """Verified spans: doc_id, text_hash, template, label, first_word, last_word, hits, coverage."""
    grams, n = template_grams(docs.sparkSession, templates, k)
    if n <= BROADCAST_ROWS:
        grams = F.broadcast(grams)
    hits = gram_rows(docs, k).join(grams, "gram")
    key = ["doc_id", "text_hash", "template"]
    votes = hits.groupBy(*key, "label", "t_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("held"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    by = Window.partitionBy(*key).orderBy("diagonal")
    starts = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > gap).cast("int"), F.lit(1))
    runs = votes.withColumn("new", starts).withColumn("run", F.sum("new").over(by))
    merged = runs.groupBy(*key, "label", "t_grams", "run").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.min("lo").alias("first_word"), (F.max("hi") + (k - 1)).alias("last_word"))
    covered = F.size("held") / F.col("t_grams")
    dense = F.size("held") / (F.col("last_word") - F.col("first_word") - (k - 2))
    return merged.filter((covered >= coverage) & (dense >= density)).select(*key, "label", "first_word", "last_word", F.size("held").alias("hits"), covered.alias("coverage"))


def scan_licenses(docs: DataFrame, **how) -> DataFrame:
    """One row per document: base counts and labels, all labels, and the best score."""
    spans = license_spans(docs, **how)
    per_doc = spans.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"), F.count(F.lit(1)).alias("n_spans"))
    b = base_counts(docs).alias("b")
    p = per_doc.alias("p")
    joined = b.join(p, F.col("b.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("b.text_hash") == F.col("p.text_hash")), "left")
    known = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    labels = F.array_sort(F.array_distinct(F.concat(known, F.coalesce(F.col("more"), F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce(F.col("best"), F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return joined.select("b.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(labels, ",").alias("labels"), score.alias("score"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
