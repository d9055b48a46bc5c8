"""The whole way from text boxes to event records, as one lazy plan."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.operators import boxes as B
from noticeloom.operators.entities import extract
from noticeloom.functions.text import escape_umlauts
from noticeloom.operators.fuzzy import fuzzy_join
from noticeloom.operators.resolve import resolve
from noticeloom.plans.config import Config


#: Numbers of a box.
BOX_NUMBERS = ("confidence", "x", "y", "width", "height")


def merged_branches(rectified: DataFrame, original: DataFrame, config: Config = Config()) -> DataFrame:
    """Boxes of both readings of a document, each collated on its own; the rectified ones come first."""
    first = B.collate(rectified, config.overlap_share).withColumn("branch", F.lit(0))
    second = B.collate(original, config.overlap_share).withColumn("branch", F.lit(1))
    both = first.unionByName(second)
    return both.withColumn("ord", (F.col("ord") * 2 + F.col("branch")).cast("int")).drop("branch")


def spelled(boxes: DataFrame, terms: DataFrame, config: Config = Config(), costs: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """(doc_id, ord, confidence, kind, subkey, value): dictionary terms near a box's text or a run of its words, by a table
    of substitution costs if the settings ask for that and one is given. Runs longer than any term within the edits are not made."""
    longest = terms.agg(F.max(F.char_length(escape_umlauts(F.lower("term"))))).first()[0] or 0
    grams = B.box_ngrams(boxes, longest=longest + config.most_edits).select("doc_id", "ord", "confidence", F.col("ngram").alias("text"))
    near = fuzzy_join(grams, terms, most=config.most_edits, share=config.edit_share, costs=costs if config.distance == "ocr" else None)
    return near.select("doc_id", "ord", "confidence", F.col("dict_key").alias("kind"), "subkey", F.col("term").alias("value")).distinct()


def facts(boxes: DataFrame, terms: DataFrame | None = None, config: Config = Config(), costs: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """Entities of boxes by patterns and, with a dictionary, by spelling; each with its box's confidence."""
    found = extract(boxes.withColumnRenamed("ord", "box"), keys=("doc_id", "box", "confidence")).select("doc_id", F.col("box").alias("ord"), "confidence", "kind", F.lit(None).cast("string").alias("subkey"), "value")
    return found if terms is None else found.unionByName(spelled(boxes, terms, config, costs))


def events(rectified: DataFrame, original: DataFrame | None, today: datetime.date, terms: DataFrame | None = None, gazetteer: DataFrame | None = None, hosts: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Collate, vote, extract, spell and resolve."""
    collated = merged_branches(rectified, original, config) if original is not None else B.collate(rectified, config.overlap_share)
    voted = B.vote(collated)
    return resolve(voted, facts(voted, terms, config), today, gazetteer, hosts, config.compat, config.sure)


def document_boxes(documents: DataFrame, text: str = "text") -> DataFrame:
    """Boxes of plain texts: a line is a box, set below the one before."""
    lines = documents.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("ord", "text")).where("text != ''")
    return lines.select("doc_id", "ord", "text", F.lit(95.0).alias("confidence"), F.lit(0.0).alias("x"), (F.col("ord") * 40.0).alias("y"), (F.char_length("text") * 10.0).alias("width"), F.lit(30.0).alias("height"))
