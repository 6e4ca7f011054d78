"""Image candidates: geometry, size and colour tests, first-kept deduplication, identifiers and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Images
from ..functions.text import basename, safe_name


def within_bounds(y0: Column, y1: Column, height: Column, c: Images = Images()) -> Column:
    """Strictly inside the top and bottom margins."""
    return (y0 > height * c.top_margin) & (y1 < height * (1 - c.bottom_margin))


def large_enough(width: Column, height: Column, c: Images = Images()) -> Column:
    return (width >= c.min_width) & (height >= c.min_height)


def single_color(n_colors: Column, c: Images = Images()) -> Column:
    """Whether an image has at most color_threshold colours; over max_colors, or unknown, counts as many."""
    return F.coalesce((n_colors <= c.max_colors) & (n_colors <= c.color_threshold), F.lit(False))


def color_counts(runs: DataFrame, keys: list[str], color: str = "color", c: Images = Images()) -> DataFrame:
    """Of runs of pixels (keys of the image, color): the keys and n_colors, max_colors + 1 standing for more than max_colors.

    Each task passes on a colour of an image when it meets it first, and stops at the bound; so what is shuffled is at most
    max_colors + 1 colours for each image and task, whatever the number of pixels. A null colour is none.
    """
    most, fields = c.max_colors + 1, {f.name: f.dataType.simpleString() for f in runs.schema}

    def first_met(batches):
        seen, held = {}, 0
        for batch in batches:
            new = []
            for at, (*image, pixel) in enumerate(zip(*(batch[k] for k in keys), batch[color], strict=True)):
                colors = seen.setdefault(tuple(image), set())
                if len(colors) < most and pixel not in colors:
                    colors.add(pixel)
                    new.append(at)
            yield batch.iloc[new]
            held += len(new)
            if held > HELD:  # a colour that is then passed on again counts once all the same
                seen, held = {}, 0

    some = runs.select(*keys, color).where(F.col(color).isNotNull()).mapInPandas(first_met, ", ".join(f"`{k}` {fields[k]}" for k in [*keys, color]))
    return some.groupBy(*keys).agg(F.least(F.countDistinct(color), F.lit(most)).alias("n_colors"))


#: Colours that a task remembers at once.
HELD = 1 << 20


def kept(images: DataFrame, c: Images = Images()) -> DataFrame:
    """Cheap tests first, each a filter of its own."""
    inside = images.where(within_bounds(F.col("y0"), F.col("y1"), F.col("page_height"), c))
    return inside.where(large_enough(F.col("width"), F.col("height"), c)).where(~single_color(F.col("n_colors"), c))


def first_per_file(images: DataFrame) -> DataFrame:
    """Of kept images, the first of each object within its file; a rejected placement never blocks a later one."""
    order = Window.partitionBy("file_name", "xref").orderBy("page_num", "img_num")
    return images.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def row_id(file_name: Column, page_num: Column, img_num: Column) -> Column:
    return F.concat(file_name, F.lit("_p"), page_num.cast("string"), F.lit("_i"), img_num.cast("string"))


def image_path(folder: str, file_name: Column, page_num: Column, img_num: Column) -> Column:
    return F.concat(F.lit(folder + "/"), row_id(safe_name(basename(file_name)), page_num, img_num), F.lit(".png"))
