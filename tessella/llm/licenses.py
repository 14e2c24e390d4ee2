"""License texts in documents by diagonal voting, in DataFrame functions alone.

Every run of three words of a document is joined with the places of such runs in license templates; a pair of places votes for its
diagonal (place in the document less place in the template). Neighbouring diagonals, as missing or added words make them, are merged;
what is merged is verified as a span: its votes must follow one another in the document without large gaps or jumps and in the order of
the template, and they must fill enough of both the template and the span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rows, cut

#: Words of a run; diagonals this close are merged, and jumps within a span are no larger; share of the runs of template and span alike
#: that must be covered in order.
K, GAP, COVERAGE = 3, 3, 0.8

#: Phrases of the query contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Passages of public licenses, in words as words_of_text() gives them.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_of_text(text: Column) -> Column:
    """A-Z lower-cased; runs of ASCII digits and letters and all that isn't ASCII. Null has none."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def run_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(*[words[i + j] for j in range(K)])


def template_runs(spark: SparkSession, templates: list[tuple[str, str]], phrases: dict[str, str]) -> DataFrame:
    """(template, label, phrase: whether it is one, runs, at, gram): a row for each run of each template; as many as the fixed texts have."""
    rows = []
    for n, (label, text, phrase) in enumerate([(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in templates]):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        rows += [(n, label, phrase, len(words) - K + 1, at, " ".join(words[at : at + K])) for at in range(len(words) - K + 1)]
    return spark.createDataFrame(rows, "template int, label string, phrase boolean, runs int, at int, gram string")


def spans_of(votes: DataFrame) -> DataFrame:
    """(rid, template, label, start, end, coverage) of the verified spans. votes: rid, template, label, runs, pos, at.

    Diagonals of a document and a template that are GAP apart at most are merged. Along the document, a merged group is parted where a
    vote's diagonal differs from the one's before it by more than GAP, or where it stands more than K + GAP words behind it. Of each
    part, the votes count that lie further in the template than all before them; their share of the template's runs, or of the part's
    own runs if these are more, is the coverage."""
    by = ["rid", "template"]
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("at"))
    along = Window.partitionBy(*by).orderBy("diagonal")
    lines = votes.select(*by, "diagonal").distinct()
    apart = F.coalesce(((F.col("diagonal") - F.lag("diagonal").over(along)) > GAP).cast("int"), F.lit(0))
    lines = lines.withColumn("apart", apart).withColumn("merged", F.sum("apart").over(along)).drop("apart")
    votes = votes.join(lines, [*by, "diagonal"])
    inside = Window.partitionBy(*by, "merged").orderBy("pos", "at")
    jump = F.abs(F.col("diagonal") - F.lag("diagonal").over(inside)) > GAP
    hole = F.col("pos") - F.lag("pos").over(inside) > K + GAP
    votes = votes.withColumn("breaks", F.coalesce((jump | hole).cast("int"), F.lit(0))).withColumn("part", F.sum("breaks").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.max("at").over(Window.partitionBy(*by, "merged", "part").orderBy("pos", "at").rowsBetween(Window.unboundedPreceding, -1))
    votes = votes.withColumn("onward", F.col("at") > F.coalesce(before, F.lit(-1)))
    parts = votes.groupBy(*by, "label", "runs", "merged", "part").agg(F.sum(F.col("onward").cast("long")).alias("n"), F.min("pos").cast("long").alias("start"), (F.max("pos") + K).cast("long").alias("end"))
    parts = parts.withColumn("coverage", F.col("n") / F.greatest(F.col("runs").cast("long"), F.col("end") - F.col("start") - (K - 1)))
    return parts.where(F.col("coverage") >= COVERAGE).select(*by, "label", "start", "end", "coverage")


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, places, spans): places are those of phrases, array<struct<label, start>>; spans those of templates,
    array<struct<label, start, end, coverage>> in words, of coverage COVERAGE or more (spans_of()).

    The runs of templates are joined by hash (their number is that of the fixed texts, so they are broadcast) and compared as words.
    A document's runs whose hash no template has are dropped before they become rows. Votes meet by document, template and diagonal;
    no document's votes outnumber its words times the templates' repeated runs.
    A null or empty text has no words and no spans; repeated rows are repeated; equal places and spans of several templates of one label
    are all given, in order; an empty table gives no rows. Long texts are scanned whole. Other columns of docs are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    known = template_runs(spark, TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    hashed = known.withColumn("h", F.xxhash64(*[F.split("gram", " ")[j] for j in range(K)]))
    hashes = sorted({r.h for r in hashed.select("h").collect()})
    given = Rows(docs)
    rows = given.df.select(F.col(given.column(key)).alias("doc_id"), words_of_text(F.col(given.column(text))).alias("words"))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - K), lambda i: run_hash(F.col("words"), i).isin(hashes))
    hits = F.when(F.size("words") >= K, F.transform(at, lambda i: F.struct(i.alias("pos"), run_hash(F.col("words"), i).alias("h"), F.concat_ws(" ", *[F.col("words")[i + j] for j in range(K)]).alias("gram"))))
    read = cut(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")))

    runs = read.select("rid", F.explode("hits").alias("hit")).select("rid", "hit.*")
    votes = runs.join(F.broadcast(hashed.withColumnRenamed("gram", "exact")), "h").where("gram = exact")
    straight = votes.where("phrase").groupBy("rid", "template", "label", "runs", (F.col("pos") - F.col("at")).cast("long").alias("start")).agg(F.count("*").alias("votes"))
    places = straight.where("votes = runs").select("rid", F.struct("label", "start").alias("place"))
    spans = spans_of(votes.where("not phrase").select("rid", "template", "label", "runs", "pos", "at")).select("rid", F.struct("label", "start", "end", "coverage").alias("span"))
    both = places.select("rid", "place", F.lit(None).cast(spans.schema["span"].dataType).alias("span")).unionByName(spans.select("rid", F.lit(None).cast(places.schema["place"].dataType).alias("place"), "span"))
    found = both.groupBy("rid").agg(F.array_sort(F.collect_list("place")).alias("places"), F.array_sort(F.collect_list("span")).alias("spans"))
    return read.select("rid", "doc_id", "n_words").join(found, "rid", "left").drop("rid")
