"""Levels of positioned blocks from a stack of looks: a look seen before has its level, a lesser one goes below, a greater one closes those it outranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import centered
from ..functions.stacks import levels
from ..functions.strings import UPPER
from .features import numbering

def list_kind(text: Column) -> Column:
    """roman, letter, integer, dot or bullet of a list item's marker; empty without one."""
    token = F.element_at(F.split(F.concat(F.trim(text), F.lit(" ")), r"\s+"), 1)
    n = numbering(token)["is"]
    return F.when(n["roman"], "roman").when(n["letter"], "letter").when(n["integer"], "integer").when(n["dot"], "dot").when(~token.rlike(r"^[\p{L}\p{N}(\"“'‘$]"), "bullet").otherwise("")


def indent_levels(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks (block_idx, block_type, block_text, font_size, font_weight) with level and is_centered.

    Headers rank by size, weight and capitals; all other blocks stand below the last header, list items by their kind
    of marker; table rows as paragraphs do.
    """
    kind = F.when(F.col("block_type") == "header", 1).otherwise(0)
    head = kind == 1
    listed = F.when(F.col("block_type") == "list_item", list_kind(F.col("block_text"))).otherwise("")
    look = F.struct(
        F.when(head, F.col("font_size").cast("double")).otherwise(0.0).alias("size"),
        F.when(head, F.col("font_weight").cast("double")).otherwise(0.0).alias("weight"),
        F.when(head & F.col("block_text").rlike(UPPER), 1).otherwise(0).alias("caps"),
        kind.alias("kind"),
        listed.alias("list"),
    )
    rows = blocks.withColumn("__look", look)
    by_doc = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block_idx", F.col("__look").alias("look")))).alias("x"))
    found = by_doc.withColumn("level", levels(F.col("x.look"))).select(*keys, F.explode(F.arrays_zip(F.col("x.block_idx").alias("block_idx"), F.col("level"))).alias("z")).select(*keys, "z.block_idx", "z.level")
    page = F.col("page_width") if "page_width" in blocks.columns else F.lit(None).cast("double")
    middle = F.coalesce(centered(F.col("box.left"), F.col("box.width"), page, 0.015), F.lit(False)) if "box" in blocks.columns else F.lit(False)
    return rows.drop("__look", *(["level"] if "level" in blocks.columns else [])).join(found, [*keys, "block_idx"]).withColumn("is_centered", middle)


def without_lonely_tops(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Levels one less in documents where only the first block is on level 0 and it isn't a title to all below it (there is no header on level 1)."""
    stats = blocks.groupBy(*keys).agg(F.count_if(F.col("level") == 0).alias("__tops"), F.count_if((F.col("level") == 1) & (F.col("block_type") == "header")).alias("__below"), F.max("level").alias("__deep"))
    lower = (F.col("__tops") == 1) & (F.col("__below") == 0) & (F.col("__deep") > 1) & (F.col("level") > 0)
    return blocks.join(stats, list(keys)).withColumn("level", F.when(lower, F.col("level") - 1).otherwise(F.col("level"))).drop("__tops", "__below", "__deep")
