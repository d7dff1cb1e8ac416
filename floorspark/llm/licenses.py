"""License notices in documents, by diagonal voting.

The rolling word k-gram hashes of all documents are joined to the places of
those k-grams in the templates. A hit votes for its diagonal, the place in the
document less the place in the template; diagonals that lie next to each other,
as a missing or added word leaves them, are merged. What the votes propose is
confirmed on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorspark.llm.words import LOWER, NOT_ALNUM, Words, text_slices

#: Words of a k-gram; how far apart diagonals may lie to be merged.
GRAM, DRIFT = 3, 3
#: The share of a template's k-grams that must vote, and of its words that a
#: span must have in order, for a template to count.
LEAST_VOTES, LEAST_MATCH = 0.4, 0.8
#: Template k-grams up to which their table is sent to every task; a row has
#: under 40 bytes. A larger table is shuffled.
SENT_GRAMS = 1 << 18


class Template(NamedTuple):
    label: str
    text: str
    exact: bool  # a phrase whose words must stand consecutively


#: Phrases that count only word by word.
PHRASES = [
    Template("mit", "under the MIT license", True),
    Template("apache-2", "Apache license version 2", True),
    Template("cc-by-nc", "CC BY NC", True),
]

#: Opening words of common notices, which may be changed a little.
NOTICES = [
    Template("mit", "Released under the MIT License", False),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", False),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", False),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", False),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", False),
    Template("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation", False),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", False),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", False),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", False),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", False),
    Template("unlicense", "This is free and unencumbered software released into the public domain", False),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", False),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike License", False),
    Template("all-rights-reserved", "All rights reserved", False),
]


def _words(text: str) -> Words:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return Words(data, np.array([0, len(data)]), NOT_ALNUM)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's rolling k-gram hashes; none where it has fewer words."""
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            words = Words(data, offsets, NOT_ALNUM)
            grams, at = words.shingles(GRAM)
            short = np.diff(words.first) < GRAM
            if short.any():
                keep = np.repeat(~short, np.diff(at))
                grams, at = grams[keep], np.concatenate([[0], np.cumsum(np.where(short, 0, np.diff(at)))])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)))
            ids = [batch.column(c).slice(lo, hi - lo) for c in ("id", "version")]
            yield pa.RecordBatch.from_arrays([*ids, lists], ["id", "version", "grams"])


def _template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    rows = []
    for number, template in enumerate(templates):
        grams, _ = _words(template.text).shingles(GRAM)
        rows += [(int(g), number, place) for place, g in enumerate(grams.view(np.int64))]
    table = spark.createDataFrame(rows, "gram long, template int, place int")
    return F.broadcast(table) if len(rows) <= SENT_GRAMS else table


def proposed(named: DataFrame, templates: list[Template]) -> DataFrame:
    """(id, version, spans): what the votes of each document propose, as
    (template, first word, end word); phrases unmerged."""
    spark = named.sparkSession
    sizes = [int(_words(t.text).first[-1]) for t in templates]
    table = spark.createDataFrame(
        [(i, t.exact, n) for i, (t, n) in enumerate(zip(templates, sizes, strict=True))], "template int, exact boolean, words int"
    )
    grams = named.select("id", "version", "text").mapInArrow(_hashed, "id long, version long, grams array<long>")
    hits = grams.select("id", "version", F.posexplode("grams").alias("at", "gram")).join(_template_grams(spark, templates), "gram")
    hits = hits.select("id", "version", "template", (F.col("at") - F.col("place")).alias("diagonal"), "at", "place")
    # Repeated rows bring each vote again; places are counted once.
    votes = hits.groupBy("id", "version", "template", "diagonal").agg(
        F.countDistinct("place").alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi")
    )
    votes = votes.join(F.broadcast(table), "template")
    own = Window.partitionBy("id", "version", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(own)
    begins = F.when(F.col("exact") | apart.isNull() | (apart > DRIFT), 1).otherwise(0)
    votes = votes.withColumn("run", F.sum(begins).over(own))
    merged = votes.groupBy("id", "version", "template", "run").agg(
        F.sum("votes").alias("votes"),
        F.min("diagonal").alias("lo"),
        (F.max("diagonal") + F.first("words")).alias("hi"),
        F.first("words").alias("words"),
        F.first("exact").alias("exact"),
    )
    needed = F.col("words") - GRAM + 1
    merged = merged.where(F.when(F.col("exact"), F.col("votes") >= needed).otherwise(F.col("votes") >= needed * LEAST_VOTES))
    spans = merged.groupBy("id", "version").agg(F.collect_list(F.struct("template", "lo", "hi")).alias("spans"))
    return spans.withColumnsRenamed({"id": "span_id", "version": "span_version"})


def _in_order(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        hit = row & masks.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _confirmed(templates: list[Template]):
    wanted = []
    for t in templates:
        data = LOWER[np.frombuffer(t.text.encode(), dtype=np.uint8)]
        words = _words(t.text)
        wanted.append([data[s:e].tobytes() for s, e in zip(words.start, words.end, strict=True)])

    def judged(spans, said) -> tuple:
        """Base places, base labels, labels, and the best score, of one text."""
        places, base, labels, score = [], set(), set(), 0.0
        for span in spans:
            number, lo, hi = span["template"], max(0, span["lo"]), span["hi"]
            template, words = templates[number], wanted[number]
            if template.exact:
                if said(lo, hi) == words:
                    places.append(lo)
                    base.add(template.label)
                    score = 1.0
                continue
            match = _in_order(words, said(lo, hi)) / len(words)
            if match >= LEAST_MATCH:
                labels.add(template.label)
                score = max(score, match)
        return places, base, labels | base, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            rows = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets, NOT_ALNUM)
                for i in range(lo, hi):
                    begin, end = int(words.first[i - lo]), int(words.first[i - lo + 1])

                    def said(a: int, b: int, begin=begin, end=end, words=words, data=data) -> list[bytes]:
                        at = slice(begin + a, min(begin + b, end))
                        return [LOWER[data[s:e]].tobytes() for s, e in zip(words.start[at], words.end[at], strict=True)]

                    places, base, labels, score = judged(spans[i].as_py() or [], said)
                    rows["n_words"].append(end - begin)
                    rows["n_base"].append(len(places))
                    rows["first_word"].append(min(places, default=None))
                    rows["last_word"].append(max(places, default=None))
                    rows["base_labels"].append(",".join(sorted(base)))
                    rows["labels"].append(",".join(sorted(labels)))
                    rows["score"].append(score)
            kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            columns = [pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *rows])

    return run


def scan_licenses(docs: DataFrame, phrases: list[Template] = PHRASES, notices: list[Template] = NOTICES) -> DataFrame:
    """License phrases and notices in whole texts.

    ``docs`` has doc_id and text; other columns are ignored. Words are runs of
    digits, letters and non-ASCII characters, A-Z in lower case. Returns one row
    per row: doc_id, n_words, n_base (places of phrases), first_word and
    last_word (their least and greatest start, words from 0, else null),
    base_labels (of phrases), labels (those and of notices; both distinct,
    sorted, joined by commas), score (1 for a phrase, else the best share of a
    notice's words found in order, 0 for none).

    Null and empty texts have no words and no labels. Rows that share a doc_id
    are judged each by its own text; rows without doc_id are judged too.
    """
    templates = [*phrases, *notices]
    if any(int(_words(t.text).first[-1]) < GRAM for t in templates):
        raise ValueError(f"a template needs {GRAM} words")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    nowhere = F.lit(-(1 << 63))
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), nowhere).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    spans = proposed(named, templates)
    both = named.join(spans, (named["id"] == spans["span_id"]) & (named["version"] == spans["span_version"]), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.select("doc_id", "text", "spans").mapInArrow(
        _confirmed(templates),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
