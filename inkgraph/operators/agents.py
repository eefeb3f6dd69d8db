"""Agent text over arrows: what is written around an arrow, as words in reading order.

Characters beside an arrow's middle, and all that hang together with them, belong to it. They are turned into its frame, read from left to right (of an
upright arrow from above), and cut into lines and words where the gaps are: islands of a sorted row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import along_line, distance, offset_from_line
from . import graph, spatial

#: Of characters, in pixels; the fixed limits of the recognition.
REACH, GROW = 22.0, 11.0


def claimed(glyphs: DataFrame, arrows: DataFrame, keys: list[str], reach: float = REACH, grow: float = GROW, cut=None) -> DataFrame:
    """keys, glyph_id, arrow_id: the arrow of each glyph that belongs to one.

    glyphs: keys, glyph_id, x1, y1, x2, y2; arrows: keys, arrow_id, tail_x, tail_y, head_x, head_y. A glyph with its centre nearer than `reach` to an
    arrow's shaft, and beside it, is a seed. Glyphs with gaps under `grow` hang together and go with the seed that is nearest to its arrow; ties go to the smaller
    arrow, then to the smaller glyph.
    """
    if cut is None:
        from ..sources.storage import cut
    c, keys = F.col, list(keys)
    own = glyphs.select(*keys, c("glyph_id").alias("id"), "x1", "y1", "x2", "y2")
    near = spatial.near_boxes(own, grow, keys)
    groups = graph.components(near.select(*keys, c("id1").alias("a"), c("id2").alias("b")), keys, cut).withColumnRenamed("node", "id")
    whole = own.join(groups, [*keys, "id"], "left").select(*keys, "id", F.coalesce("component", "id").alias("component"), ((c("x1") + c("x2")) / 2).alias("x"), ((c("y1") + c("y2")) / 2).alias("y"))
    shafts = arrows.select(*keys, c("arrow_id").alias("id"), *[c(a).alias(b) for a, b in (("tail_x", "x1"), ("tail_y", "y1"), ("head_x", "x2"), ("head_y", "y2"))])
    seeds = spatial.near_segments(whole, shafts, reach, keys).join(whole.select(*keys, c("id").alias("id1"), "component"), [*keys, "id1"])
    best = seeds.groupBy(*keys, "component").agg(F.min(F.struct(F.abs("off").alias("off"), c("id2").alias("arrow_id"), "id1")).alias("s")).select(*keys, "component", "s.arrow_id")
    return whole.join(best, [*keys, "component"]).select(*keys, c("id").alias("glyph_id"), "arrow_id")


def agent_strings(glyphs: DataFrame, arrows: DataFrame, keys: list[str], reach: float = REACH, grow: float = GROW, cut=None) -> DataFrame:
    """keys, arrow_id, line, agent: the text of each line of each arrow that has some, lines counted from 0 as they are read.

    glyphs also has `a`, the character. A line ends where the next centre, across the arrow, is more than half a glyph's height away, a word
    where the gap along it is over half a glyph's width; a glyph's height and width are the means of those of the arrow. Words are parted by a space.
    """
    c, keys = F.col, list(keys)
    mine = glyphs.join(claimed(glyphs, arrows, keys, reach, grow, cut), [*keys, "glyph_id"]).join(arrows, [*keys, "arrow_id"])
    back = (c("head_x") < c("tail_x")) | ((c("head_x") == c("tail_x")) & (c("head_y") < c("tail_y")))
    ends = [F.when(back, c(f"{b}_{k}")).otherwise(c(f"{a}_{k}")).cast("double") for a, b in (("tail", "head"), ("head", "tail")) for k in "xy"]
    x, y = (c("x1") + c("x2")) / 2, (c("y1") + c("y2")) / 2
    mine = mine.withColumn("along", F.round(along_line(*ends, x, y), 6)).withColumn("across", F.round(-offset_from_line(*ends, x, y), 6))
    arrow = Window.partitionBy(*keys, "arrow_id")
    # what a glyph measures along the frame's axes
    cos, sin = (F.abs(ends[k + 2] - ends[k]) / distance(*ends) for k in (0, 1))
    w, h = c("x2") - c("x1") + 1, c("y2") - c("y1") + 1
    mine = mine.withColumn("w", F.round(w * cos + h * sin, 6)).withColumn("h", F.round(w * sin + h * cos, 6))
    down = arrow.orderBy("across", "along", "glyph_id")
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in order: sums of doubles hang on it, and gaps of just half a mean on the sums
    mine = mine.withColumn("mean_w", F.avg("w").over(whole)).withColumn("mean_h", F.avg("h").over(whole))
    lines = mine.withColumn("line", F.coalesce(F.lag("across").over(down) + c("mean_h") / 2 < c("across"), F.lit(False)).cast("int")).withColumn("line", F.sum("line").over(down))
    line = Window.partitionBy(*keys, "arrow_id", "line").orderBy("along", "glyph_id")
    gap = (c("along") - c("w") / 2) - (F.lag("along").over(line) + F.lag("w").over(line) / 2)
    words = lines.withColumn("part", F.when(gap > c("mean_w") / 2, F.concat(F.lit(" "), "a")).otherwise(c("a")))
    text = F.array_sort(F.collect_list(F.struct("along", "glyph_id", "part")))  # a line over an arrow is short
    return words.groupBy(*keys, "arrow_id", "line").agg(F.array_join(F.transform(text, lambda g: g["part"]), "").alias("agent"))
