"""The main body of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pages


def found(labelled: DataFrame) -> DataFrame:
    """Page key and ``line_no`` of every non-empty line that isn't body."""
    return labelled.select(*pages.KEY, F.explode("chrome").alias("line_no")).distinct()


def bodies(table: DataFrame, labelled: DataFrame) -> DataFrame:
    """Page key, ``body`` (the text's body lines as they stand, empty lines dropped) and ``boilerplate_ratio`` for every page with text, delivered once.
    A page without body has the empty text and ratio 1."""
    text = pages.identified(pages.with_text(table)).select(*pages.KEY, *pages.ID, "extracted_text").dropDuplicates(pages.ID)
    both = text.join(labelled.select(*pages.ID, "chrome").dropDuplicates(pages.ID), pages.ID)
    lines = F.split("extracted_text", "\n")
    kept = F.filter(lines, lambda x, i: (pages.tidy_line(x) != "") & ~F.array_contains("chrome", i + 1))
    body = F.array_join(kept, "\n")
    return both.select(*pages.KEY, body.alias("body")  , F.col("extracted_text")).select(*pages.KEY, "body", F.round(1 - F.length("body") / F.length("extracted_text"), 3).alias("boilerplate_ratio"))
