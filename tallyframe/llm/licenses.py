"""License scans by diagonal voting.

All rolling word k-grams of all documents are joined with the k-grams of license
templates. A hit at word p of a document and word q of a template votes for the
diagonal p - q. Votes are counted per diagonal, neighbouring diagonals (words put
in or left out) are merged, and a span counts when the verified votes cover enough
of the template. Only column expressions and joins are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import fresh, materialise, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHORT, LONG = 2, 4  # words in a k-gram of a phrase and of a notice
DRIFT = 3  # diagonals so far apart are merged, or half the notice's length if that is more
COVERAGE = 0.75  # share of a notice's words that votes must cover
BASE, NOTICE = "base", "notice"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    kind: str = NOTICE

    @property
    def k(self) -> int:
        return SHORT if self.kind == BASE or len(self.words) < LONG + 2 else LONG


def template(label: str, text: str, kind: str = NOTICE) -> Template:
    return Template(label, tuple(text.lower().split()), kind)


# Base phrases and public license notices, as words.
TEMPLATES = (
    template("cc-by", "cc by", BASE),
    template("gpl", "general public license", BASE),
    template("reserved", "all rights reserved", BASE),
    template("mit", "released under the mit license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    template("apache-2.0", "licensed under the apache license version 2 0"),
    template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    template("gpl-3.0", "licensed under the gnu general public license version 3"),
    template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    template("lgpl", "gnu lesser general public license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    template("cc-by", "licensed under a creative commons attribution license"),
    template("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    template("cc-by-nc", "licensed under cc by nc 4 0"),
    template("cc-by-sa", "licensed under cc by sa 4 0"),
    template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _template_grams(spark, templates: tuple[Template, ...]) -> DataFrame:
    rows = [
        (t, i, tpl.k, list(tpl.words[i : i + tpl.k]))
        for t, tpl in enumerate(templates)
        for i in range(len(tpl.words) - tpl.k + 1)
    ]
    grams = spark.createDataFrame(rows, "template int, place int, k int, gram array<string>")
    padded = [F.get("gram", F.lit(i)) for i in range(LONG)]
    return grams.withColumn("hash", F.xxhash64("k", *padded))


def _facts(spark, templates: tuple[Template, ...]) -> DataFrame:
    rows = [(i, t.label, t.kind, len(t.words)) for i, t in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, label string, kind string, length int")


def votes(docs: DataFrame, id_col: str, text_col: str, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Verified votes per diagonal, and one row with a NULL template per document.

    Columns id, key, template, diagonal, n_words, copies, places, k. ``key`` hashes
    the text, so repeated ids with different texts stay apart. Word sequences are
    looked up by hash, and every hit is compared word by word before it votes. Texts
    are read once and never shuffled. The k-gram table is bounded by the templates.
    """
    words, hashes, at, found = (fresh(x) for x in ("words", "hashes", "at", "found"))
    lowered = F.translate(text_of(text_col), ascii_uppercase, ascii_lowercase)
    split = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(text_of(text_col)).alias("key"),
        F.array_remove(F.split(lowered, SEPARATORS), "").alias(words),
    )

    def rolling(k: int) -> str:
        gram = ", ".join(["w", *[f"get(`{words}`, i + {j})" for j in range(1, k)]])
        return f"transform(`{words}`, (w, i) -> xxhash64({k}, {gram}))"

    # the NULL at the end of each array stands for the document itself
    grammed = split.withColumn(hashes, F.expr(f"concat({rolling(SHORT)}, {rolling(LONG)}, array(CAST(NULL AS BIGINT)))"))
    rows = grammed.select("id", "key", words, F.posexplode_outer(hashes).alias(at, found))
    grams = F.broadcast(_template_grams(docs.sparkSession, templates))
    joined = rows.join(grams, F.col(found) == F.col("hash"), "left")
    whole = F.expr(f"`{at}` = 2 * size(`{words}`)")
    start = F.expr(f"`{at}` % size(`{words}`)")
    verified = F.slice(words, start + 1, F.col("k")) == F.col("gram")
    hits = joined.where(whole | (F.col("template").isNotNull() & verified)).select(
        "id",
        "key",
        "template",
        F.when(~whole, start - F.col("place")).cast("bigint").alias("diagonal"),
        F.when(whole, F.size(words)).cast("bigint").alias("n_words"),
        "place",
        "k",
    )
    return hits.groupBy("id", "key", "template", "diagonal").agg(
        F.max("n_words").alias("n_words"),
        F.count("*").alias("copies"),
        F.collect_set("place").alias("places"),  # a set: repeated rows vote once
        F.max("k").alias("k"),
    )


def spans(voted: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, key, label, kind, start, length, coverage): the verified spans among ``votes``.

    start counts the document's words from 0 and length those of the template. Base
    phrases stand word for word, one span per place. Notices need votes on
    neighbouring diagonals that cover ``COVERAGE`` of their words.
    """
    facts = F.broadcast(_facts(voted.sparkSession, templates))
    counted = voted.where(F.col("template").isNotNull()).join(facts, "template")
    complete = F.size("places") == F.col("length") - F.col("k") + 1
    base = counted.where((F.col("kind") == BASE) & complete).withColumn("start", F.col("diagonal"))
    order = Window.partitionBy("id", "key", "template").orderBy("diagonal")  # the diagonals of one document
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    near = counted.where(F.col("kind") == NOTICE).withColumn("new", F.when(step <= F.greatest(F.lit(DRIFT), F.col("length") / 2), 0).otherwise(1))
    covered = F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1))
    merged = (
        near.withColumn("run", F.sum("new").over(order))
        .groupBy("id", "key", "template", "label", "kind", "length", "run")
        .agg(
            F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
            F.size(F.array_distinct(F.flatten(F.flatten(F.collect_list(covered))))).alias("covered"),
        )
        .withColumn("coverage", F.col("covered") / F.col("length"))
        .where(F.col("coverage") >= COVERAGE)
    )
    columns = ["id", "key", "label", "kind", "start", "length"]
    return base.select(*columns, F.lit(1.0).alias("coverage")).unionByName(merged.select(*columns, "coverage"))


def scan_licenses(docs: DataFrame, id_col: str, text_col: str, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are their
    smallest and largest starts (NULL without any). Labels are distinct, sorted and
    joined by commas, '' without any; ``labels`` has those of notices too. score is
    the best coverage of any span, 0 without one. NULL and empty texts have no words.
    Rows equal in id and text get equal answers; NULL ids are kept; an empty table
    gives no rows. The votes, a small part of the texts, are written once.
    """
    voted = materialise(votes(docs, id_col, text_col, templates))
    whole = voted.where(F.col("template").isNull()).select("id", "key", "n_words", "copies")
    found = spans(voted, templates).select("id", "key", "label", "kind", "start", "coverage")
    base = F.col("kind") == BASE
    both = whole.unionByName(found, allowMissingColumns=True).groupBy("id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.max("copies").alias("copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    )
    repeated = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return both.select("*", repeated.alias("copy")).drop("key", "copies", "copy")
