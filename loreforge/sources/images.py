"""Image metadata: filters, figure captions, and the join of images to the pages of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least side and greatest aspect of a picture, and of a figure's crop; where a caption stands relative to its figure.
LEAST_SIDE, MOST_ASPECT = 64, 15
FIGURE_WIDTH, FIGURE_HEIGHT, MARGIN = 50, 40, 8
ABOVE, BELOW, ASIDE = -380, 10, 300


def keep_pictures(images: DataFrame) -> DataFrame:
    """One row for each picture of a page, without icons and rules."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    ok = (w >= LEAST_SIDE) & (h >= LEAST_SIDE) & (w / h <= MOST_ASPECT) & (h / w <= MOST_ASPECT)
    return images.where(ok).dropDuplicates(["book_id", "page_number", "xref"])


def figures(captions: DataFrame, drawings: DataFrame) -> DataFrame:
    """A crop box for each caption: the union of the drawings whose nearest caption it is, with a margin; small ones are dropped.

    ``captions``: book_id, page, caption_id, x, y; ``drawings``: book_id, page,
    drawing_id, x0, y0, x1, y1.  Drawings meet only their own page's captions.
    """
    pairs = drawings.join(captions, ["book_id", "page"])
    dy, dx = (F.col("y0") + F.col("y1")) / 2 - F.col("y"), (F.col("x0") + F.col("x1")) / 2 - F.col("x")
    near = pairs.where(dy.between(ABOVE, BELOW) & (F.abs(dx) < ASIDE)).withColumn("far", F.sqrt(dx * dx + dy * dy))
    best = near.groupBy("book_id", "page", "drawing_id").agg(F.min_by(F.struct("caption_id", "x0", "y0", "x1", "y1"), F.struct("far", "caption_id")).alias("d"))
    box = best.groupBy("book_id", "page", "d.caption_id").agg(*[f(f"d.{c}").alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    box = box.select("book_id", "page", "caption_id", *[(F.col(c) - MARGIN).alias(c) for c in ("x0", "y0")], *[(F.col(c) + MARGIN).alias(c) for c in ("x1", "y1")])
    return box.where((F.col("x1") - F.col("x0") >= FIGURE_WIDTH) & (F.col("y1") - F.col("y0") >= FIGURE_HEIGHT))


def attach(chunks: DataFrame, images: DataFrame, *, key: str = "chunk_id", book: str = "book_id", first: str = "page_start", last: str = "page_end", page: str = "page_number", image: str = "image_id", distinct: bool = True) -> DataFrame:
    """Adds images (by page; distinct, or one for each page that it is on) and contains_figure.  A chunk spans few pages, so the interval becomes an equi-join on each of them, of keys only."""
    each = chunks.where(F.col(last) >= F.col(first)).select(key, book, F.explode(F.sequence(F.col(first), F.col(last))).alias("_page"))
    hits = each.join(images.select(F.col(book), F.col(page).alias("_page"), F.col(image).alias("_image")), [book, "_page"])
    every = F.transform(F.sort_array(F.collect_list(F.struct("_page", "_image"))), lambda x: x["_image"])
    lists = hits.groupBy(key).agg((F.array_distinct(every) if distinct else every).alias("images"))
    kind = images.schema[image].dataType.simpleString()
    out = chunks.join(lists, key, "left")
    return out.withColumn("images", F.coalesce("images", F.array().cast(f"array<{kind}>"))).withColumn("contains_figure", F.size("images") > 0)
