"""Licence scans by a trained paragraph classifier, in DataFrame operations and Spark ML only.

A paragraph is a line with words. Its features are word pairs and triples that occur in the licence
templates. A multinomial logistic regression with an L1 part learns them from parts of the templates
and from ordinary paragraphs of the corpus, which are the class ``unknown``: those that share too few
triples with any template to be a licence, prose about licences included. What it says counts only
beyond its family's threshold, calibrated on ordinary paragraphs that training has not seen, and where the
paragraph also shares enough of its triples with a template of that family. Scoring is a join of the paragraphs'
features with the non-zero weights.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stage

UNKNOWN = "unknown"
#: All ordinary paragraphs of a corpus count in training, and weigh as many as this together where there are more, so
#: that the few templates are not lost beside them. Calibration counts each as one.
PLAIN_WEIGHT = 3000
#: Least share of the shorter side's triples that a paragraph and a template have in common.
OVERLAP = 0.5
LEAST_THRESHOLD = 0.6
#: Of the ordinary paragraphs that training has not seen, the share that stays below a family's threshold.
QUANTILE = 0.99

#: Public licence notices by family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
}
FAMILIES = tuple(sorted(TEMPLATES))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _runs(of: Column, n: int) -> Column:
    at = F.when(F.size(of) >= n, F.sequence(F.lit(0), F.size(of) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(of, i + k) for k in range(n)]))


def grams(of: Column) -> Column:
    """Pairs and triples of words, repeats included."""
    return F.concat(_runs(of, 2), _runs(of, 3))


def triples(of: Column) -> Column:
    return _runs(of, 3)


def paragraphs(docs: DataFrame) -> DataFrame:
    """``row``, ``line`` and ``w`` (words) of every paragraph; a line without words is none."""
    lines = docs.select("row", F.posexplode(F.split("text", "\n")).alias("line", "__text"))
    return lines.select("row", "line", words(F.col("__text")).alias("w")).where(F.size("w") > 0)


@dataclass
class Model:
    """Non-zero weights by n-gram, intercepts by class, and the families' calibrated thresholds."""

    classes: tuple[str, ...]
    weights: dict[str, list[float]]
    intercepts: list[float]
    thresholds: list[float]

    def table(self, spark: SparkSession, also: Iterable[str] = ()) -> DataFrame:
        """Weights by n-gram; those of ``also`` that have none weigh nothing."""
        none = dict.fromkeys(also, [0.0] * len(self.classes))
        return spark.createDataFrame(list((none | self.weights).items()), "gram string, weights array<double>")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(k, t) for k in FAMILIES for t in TEMPLATES[k]]
    return spark.createDataFrame(rows, "family string, text string").withColumn("w", words(F.col("text")))


def train(docs: DataFrame) -> Model:
    """Learn from the templates and all different paragraphs of ``docs`` (text).

    Every template gives itself and all its leading and trailing parts of five words or more. Paragraphs
    with the same known pairs and triples are one weighted row. An empty corpus leaves the class ``unknown``
    to a few fixed phrases.
    """
    spark = docs.sparkSession
    whole = _templates(spark)
    cuts = F.when(F.size("w") > 5, F.sequence(F.lit(5), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    parts = F.concat(
        F.array("w"), F.transform(cuts, lambda n: F.slice("w", 1, n)), F.transform(cuts, lambda n: F.slice("w", -n, n))
    )
    known = whole.select("family", F.explode(parts).alias("w"))
    # The templates' pairs and triples, whatever the corpus.
    vocabulary = sorted(r.g for r in known.select(F.explode(grams(F.col("w"))).alias("g")).distinct().collect())
    by_family = _family_triples(spark)
    confirming = {g for t in by_family.values() for one in t for g in one}
    texts = docs.select(F.lit(0).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.xxhash64("w").alias("h")
    # A paragraph that occurs more than once is one. Staged, as a filter that moved below would find the grams of a line
    # again for every template.
    lines = _met(paragraphs(texts).select("w", digest), ["h"], vocabulary, confirming).select(
        F.array_sort("grams").alias("grams"), "h", "n_triples"
    )
    lines = stage(lines.distinct(), "lines")
    licence = F.lit(False)
    for family in by_family.values():
        licence = licence | _overlap(_arrays(family), F.col("grams"), F.col("n_triples"))
    plain = lines.where(~(licence & (F.col("n_triples") > 0)))
    fixed = [("the quick brown fox jumps over the lazy dog",), ("this work is under way in the version of the year",),
             ("released in the spring under the name of the house",), ("you can use this at the end of the day",)]
    fixed = spark.createDataFrame(fixed, "t string").select(words(F.col("t")).alias("w")).select("w", digest)
    plain = plain.select("grams", "h").unionByName(
        _met(fixed, ["h"], vocabulary, confirming).select(F.array_sort("grams").alias("grams"), "h")
    )
    counted = plain.groupBy("grams", F.pmod("h", F.lit(4)).alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    plain = stage(counted, "plain")
    n_plain = plain.where("fold != 0").agg(F.sum("n")).first()[0] or 0
    classes = (UNKNOWN, *FAMILIES)
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    weight = F.col("n") * F.lit(min(1.0, PLAIN_WEIGHT / max(1, n_plain)))
    labelled = plain.select(F.lit(0.0).alias("label"), "grams", "fold", "n", weight.alias("weight")).unionByName(
        known.select(label.cast("double").alias("label"), grams(F.col("w")).alias("grams"), F.lit(1).cast("long").alias("fold"),
                     F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("weight"))
    )
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", binary=True)
    rows = vectors.transform(labelled).select("label", "features", "fold", "n", "weight").cache()
    learner = LogisticRegression(
        family="multinomial", regParam=1e-4, elasticNetParam=0.5, maxIter=60, standardization=False, weightCol="weight"
    )
    trained = learner.fit(rows.where((F.col("fold") != 0) | (F.col("label") > 0)))
    # Calibration: by family, so that an odd line near one licence bars neither the others nor its own.
    from pyspark.ml.functions import vector_to_array

    apart = trained.transform(rows.where((F.col("fold") == 0) & (F.col("label") == 0)))
    said = apart.select(vector_to_array("probability").alias("p"), "n")
    tops = said.agg(*[F.percentile(F.get("p", F.lit(k)), F.lit(QUANTILE), F.col("n")) for k in range(1, len(classes))]).first()
    rows.unpersist()
    seen = {int(k): j for j, k in enumerate(range(trained.numClasses))}
    matrix, intercepts = trained.coefficientMatrix.toArray(), trained.interceptVector.toArray()
    weights = {g: [float(matrix[seen[k]][i]) for k in range(len(classes))] for i, g in enumerate(vocabulary)}
    weights = {g: w for g, w in weights.items() if any(w)}
    return Model(classes, weights, [float(x) for x in intercepts], [max(LEAST_THRESHOLD, top or 0.0) for top in tops])


def _met(lines: DataFrame, keep: list[str], known: Iterable[str], confirming: set[str]) -> DataFrame:
    """``grams`` (known pairs and triples, each once), ``spoken`` and ``n_triples`` of each line of words ``w``.

    The number of different triples is 0 where a line shares none with a template.
    """
    known = sorted(confirming.union(known))
    heads = sorted({g.split(" ")[0] for g in known})
    # Each word with the next two. Only what has a weight or confirms leaves its line, once each, so the work on a
    # long line grows with its length.
    following = [F.slice("w", F.lit(k + 1), F.size("w")).alias(f"w{k}") for k in range(3)]
    runs = lines.select(*keep, "w", F.arrays_zip(*following).alias("runs"))
    runs = runs.withColumn("runs", F.filter("runs", lambda r: r["w0"].isin(heads)))
    pairs = F.transform("runs", lambda r: F.concat_ws(" ", r["w0"], r["w1"]))
    threes = F.transform("runs", lambda r: F.concat_ws(" ", r["w0"], r["w1"], r["w2"]))
    # Features are binary: a gram that a line repeats counts once.
    grams_of = runs.select(*keep, "w", F.concat(pairs, threes).alias("grams"))
    met = grams_of.withColumn("grams", F.array_distinct(F.filter("grams", lambda g: g.isin(known))))
    # The triples of a line matter only where it shares one with a template.
    may_confirm = F.exists("grams", lambda g: g.isin(sorted(confirming)))
    n_triples = F.when(may_confirm, F.size(F.array_distinct(triples(F.col("w"))))).otherwise(0)
    return met.select(*keep, (F.size("w") > 0).alias("spoken"), "grams", n_triples.alias("n_triples"))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its licence paragraphs.

    ``doc_id``, ``n_paragraphs``, ``n_licences`` (paragraphs with a confirmed family) and ``found``: an
    array of (line, family, probability) in order. NULL and empty texts have no paragraph; equal rows
    are scanned each for itself; further columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line", "__text"))
    lines = lines.select("doc_id", "row", "line", words(F.col("__text")).alias("w"))
    by_family = _family_triples(spark)
    confirming = {g for t in by_family.values() for one in t for g in one}
    # The weights are bound by the templates' pairs and triples.
    weights = model.table(spark, confirming)
    met = _met(lines, ["doc_id", "row", "line"], model.weights, confirming)
    met = met.select("doc_id", "row", "line", "spoken", "n_triples", F.explode_outer("grams").alias("gram"))
    met = met.join(F.broadcast(weights), "gram", "left")
    features = F.collect_list(F.when(F.col("weights").isNotNull(), F.struct("gram", "weights")))
    by_line = met.groupBy("row", "line").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("spoken").alias("spoken"),
        features.alias("features"), F.max("n_triples").alias("n_triples"),
    )

    def margin(k: int, intercept: float) -> Column:
        return F.aggregate("features", F.lit(intercept), lambda total, f: total + f["weights"][k])

    margins = [margin(k, b) for k, b in enumerate(model.intercepts)]
    weighed = F.exists("features", lambda f: F.exists(f["weights"], lambda x: x != 0))
    by_line = by_line.withColumn("margins", F.when(weighed, F.array(*margins)))
    best = F.array_max("margins")
    place = F.array_position("margins", best).cast("int")
    total = F.aggregate("margins", F.lit(0.0), lambda s, m: s + F.exp(m - F.array_max("margins")))
    said = by_line.withColumns({"family": F.get(F.array(*map(F.lit, model.classes)), place - 1), "probability": 1 / total})
    least = F.get(F.array(*map(F.lit, model.thresholds)), place - 2)
    passes = (F.col("family") != UNKNOWN) & (F.col("probability") > least)
    family_triples = F.create_map(*[x for k, t in by_family.items() for x in (F.lit(k), _arrays(t))])
    mine = F.transform("features", lambda f: f["gram"])
    confirmed = _overlap(F.element_at(family_triples, F.col("family")), mine, F.col("n_triples"))
    found = F.when(passes & confirmed, F.struct("line", "family", F.round("probability", 4).alias("probability")))
    return said.select("row", "doc_id", "spoken", found.alias("found")).groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.count(F.when(F.col("spoken"), 1)).alias("n_paragraphs"),
        F.count("found").alias("n_licences"), F.array_sort(F.collect_list("found")).alias("found"),
    ).drop("row")


def _arrays(of: list[list[str]]) -> Column:
    return F.array(*[F.array(*map(F.lit, g)) for g in of])


def _overlap(templates: Column, mine: Column, n_triples: Column) -> Column:
    """Whether ``mine`` shares enough with the triples of one of ``templates``."""
    return F.exists(
        templates,
        lambda t: F.size(F.array_intersect(mine, t)) >= OVERLAP * F.greatest(F.lit(1), F.least(n_triples, F.size(t))),
    )


def _family_triples(spark: SparkSession) -> dict[str, list[list[str]]]:
    rows = _templates(spark).select("family", F.array_distinct(triples(F.col("w"))).alias("t")).where(F.size("t") > 0).collect()
    return {k: [r.t for r in rows if r.family == k] for k in FAMILIES}
