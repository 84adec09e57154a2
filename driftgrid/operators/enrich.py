"""Enrichment of entities with labels from a table of triples (s, p, o, lang)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.text import non_empty
from driftgrid.plans import skew

# Predicates, class and language of the label look-up.
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SETTLEMENT = "http://dbpedia.org/ontology/Settlement"
ENGLISH = "en"


def match_pattern(
    triples: DataFrame,
    type_uri: str = SETTLEMENT,
    lang: str = ENGLISH,
    label_pred: str = LABEL,
    type_pred: str = TYPE,
) -> DataFrame:
    """Subjects of one type with their labels in one language: (s, label, lang)."""
    labels = triples.where((F.col("p") == label_pred) & (F.col("lang") == lang)).select(
        "s", F.col("o").alias("label"), "lang"
    )
    members = triples.where((F.col("p") == type_pred) & (F.col("o") == type_uri)).select("s")
    return skew.sized_join(labels, members.distinct(), ["s"], "left_semi")


def enrich_labels(
    entities: DataFrame,
    triples: DataFrame,
    type_uri: str = SETTLEMENT,
    lang: str = ENGLISH,
    label_pred: str = LABEL,
    type_pred: str = TYPE,
) -> DataFrame:
    """Entities (with ``uri``) of the wanted type that have a label, one label each.

    Of several labels the greatest is taken.  ``entities`` may be a stream.
    """
    one_label = (
        match_pattern(triples, type_uri, lang, label_pred, type_pred)
        .where(non_empty(F.col("label")))
        .groupBy("s")
        .agg(F.max("label").alias("label"), F.max("lang").alias("lang"))
        .withColumnRenamed("s", "uri")
    )
    return skew.sized_join(entities, one_label, ["uri"])
