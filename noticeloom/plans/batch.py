"""Events of files and documents, as JSON lines: ``python -m noticeloom.plans.batch [--documents TABLE] [--out FOLDER] ARGUMENT...``

An argument is the path of a JSON record of text boxes, in any store, or the id of a document."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.plans import extract
from noticeloom.plans.config import Config
from noticeloom.sources import files, store
from noticeloom.streaming import claims


def boxes_of_arguments(spark: SparkSession, arguments: list[str], documents: DataFrame | None = None) -> DataFrame:
    """(doc_id, box members) of the named files and documents; ids of files are their paths."""
    paths = [a for a in arguments if files.exists(spark, a)]
    ids = [a for a in arguments if a not in paths]
    found = []
    if paths:
        records = files.json_records(spark, paths)
        found.append(files.boxes_of(records.select(F.col("source").alias("doc_id"), F.struct("text").alias("record"))).select("doc_id", "ord", "text", *extract.BOX_NUMBERS))
    if ids:
        if documents is None:
            raise ValueError(f"no such file, and no table of documents: {', '.join(ids)}")
        named = documents.where(F.col("doc_id").cast("string").isin(ids)).withColumn("doc_id", F.col("doc_id").cast("string"))
        found.append(extract.document_boxes(named).select("doc_id", "ord", "text", *extract.BOX_NUMBERS))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumns({c: F.col(c).cast("double") for c in extract.BOX_NUMBERS})


def stream(spark: SparkSession, folder: str, schema, sink: store.Snapshots, checkpoint: str, today: datetime.date, config: Config, dead: store.Snapshots | None = None):
    """Events of the documents (doc_id, text) that arrive in a folder, as the settings say: so many files at once, or nothing written."""
    work = lambda df: extract.events(extract.document_boxes(df), None, today, config=config).withColumn("rev", F.lit(None).cast("string"))
    return claims.processed(files.change_feed(spark, folder, schema, config.files_per_trigger), work, sink, checkpoint, dead=dead, dry_run=config.dry_run)


def main(argv: list[str], spark: SparkSession | None = None, today: datetime.date | None = None, write=print) -> None:
    p = argparse.ArgumentParser(prog="noticeloom.plans.batch", description=__doc__)
    p.add_argument("--documents")
    p.add_argument("--out")
    p.add_argument("arguments", nargs="+")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("noticeloom").getOrCreate()
    documents = spark.read.parquet(a.documents) if a.documents else None
    found = extract.events(boxes_of_arguments(spark, a.arguments, documents), None, today or datetime.date.today(), config=Config.load(spark))
    lines = store.serialized(found)
    if a.out:
        lines.select("json").write.mode("overwrite").text(a.out)
    else:
        for row in lines.select("json").toLocalIterator():
            write(row["json"])


if __name__ == "__main__":
    main(sys.argv[1:])
