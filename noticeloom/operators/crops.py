"""Parts of pictures that text boxes cover, as picture files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.images import png_bytes
from noticeloom.sources import filesets
from noticeloom.sources.shared import tasks_of

#: Boxes that travel with one copy of their document's picture, boxes of a task, and bytes of pictures that it holds at once.
BOXES, ROWS, BATCH_BYTES = 1000, 10_000, 16 << 20


def bounds(x: float, y: float, width: float, height: float, rows: int, cols: int) -> tuple[int, int, int, int] | None:
    """(top, bottom, left, right) of the pixels that a box touches within a picture; None if there are none."""
    if any(v is None or not np.isfinite(v) for v in (x, y, width, height)) or width <= 0 or height <= 0:
        return None
    left, right = max(0, int(np.floor(x))), min(cols, int(np.ceil(x + width)))
    top, bottom = max(0, int(np.floor(y))), min(rows, int(np.ceil(y + height)))
    return (top, bottom, left, right) if top < bottom and left < right else None


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, image, boxes in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            pixels = np.frombuffer(image["data"], np.uint8).reshape(image["rows"], image["cols"], image["elem_size"])
            found = [(b["ord"], at) for b in boxes if (at := bounds(b["x"], b["y"], b["width"], b["height"], *pixels.shape[:2]))]
            for i in range(0, len(found), 64):
                some = found[i : i + 64]
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc.as_py()] * len(some), batch.schema.field(0).type), pa.array([o for o, _ in some], pa.int64()), pa.array([b - t for _, (t, b, _, _) in some], pa.int32()),
                    pa.array([r - l for _, (_, _, l, r) in some], pa.int32()), pa.array([png_bytes(pixels[t:b, l:r]) for _, (t, b, l, r) in some], pa.binary()),
                ], names=["doc_id", "ord", "rows", "cols", "content"])


def crops(pictures: DataFrame, boxes: DataFrame, image: str = "image") -> DataFrame:
    """(doc_id, ord, rows, cols, content) of boxes(doc_id, ord, x, y, width, height): the part of the document's picture, as PNG.

    Boxes reach as far as the picture does; those that touch no pixel, have a null or infinite measure, or belong to
    a document without a picture have no crop. A document's boxes go in groups, each with one copy of
    the picture, and the groups to tasks of about ten (boxes are counted first, as their bytes tell little of the
    work), so a picture of very many boxes is the work of many tasks. A document that stands twice among the
    pictures gives its boxes' crops of both."""
    spark = boxes.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    box = F.struct(F.col("ord").cast("long").alias("ord"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")))
    group = F.pmod(F.xxhash64("ord", "x", "y"), F.ceil(F.col("_n") / BOXES))
    counts = boxes.groupBy("doc_id").agg(F.count("*").alias("_n"))
    groups = boxes.where("ord IS NOT NULL").join(counts, "doc_id").groupBy("doc_id", group.alias("_group")).agg(F.collect_list(box).alias("_boxes"))
    held = pictures.where(F.col(image)["data"].isNotNull()).select("doc_id", F.col(image).alias("_image"))
    kind = dict(boxes.dtypes)["doc_id"]
    joined = held.join(groups, "doc_id").repartition(tasks_of(boxes, ROWS), "doc_id", "_group")
    return joined.select(F.col("doc_id").cast(kind).alias("doc_id"), "_image", "_boxes").mapInArrow(_cut, f"doc_id {kind}, ord long, rows int, cols int, content binary")


def save_crops(found: DataFrame, folder: str, mode: str = "append") -> None:
    """Write crops as files ``line-DOCUMENT-ORD.png``; see ``filesets``."""
    name = F.concat(F.lit("line-"), F.url_encode(F.col("doc_id").cast("string")), F.lit("-"), F.col("ord").cast("string"), F.lit(".png"))
    filesets.write_files(found.select(name.alias("name"), "content"), folder, mode)
