"""Text of web pages: markup read by patterns, navigation dropped by text density.

A page becomes blocks, the text between tags that break it. A block is kept if it does not
stand aside (navigation, footers, forms, advertising by element or by a word of class, id or
role), at most a third of its words are links, and it is long or next to a long block that is
kept: headings and short paragraphs belong to a text, lone short lines do not.

Everything is column expressions within a row: no shuffle, whatever the size of the table.
A null page has no blocks and an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup

#: Words of a long block, and one word in so many may be a link.
LONG, LINKED = 15, 3


def kept_blocks(found: Column, long: int = LONG, linked: int = LINKED) -> Column:
    plain = lambda b: ~b["aside"] & (linked * b["linked"] <= b["words"])
    is_long = lambda b: F.coalesce(plain(b) & (b["words"] >= long), F.lit(False))
    return F.filter(
        found,
        lambda b, i: plain(b) & (is_long(b) | is_long(F.get(found, i - 1)) | is_long(F.get(found, i + 1))),
    )


def page_text(
    pages: DataFrame, html: str = "html", out: str = "text", long: int = LONG, linked: int = LINKED
) -> DataFrame:
    """Add the page's text (``out``, a line per kept block), ``n_blocks`` and ``n_kept``."""
    # Steps of their own, so that none is computed again for each use.
    df = pages.withColumn("_marked", markup.marked(F.col(html)))
    df = df.withColumn("_marked", markup.breaks_joined(markup.references(F.col("_marked"))))
    df = df.withColumn("_blocks", markup.blocks(F.col("_marked")))
    df = df.withColumn("_kept", kept_blocks(F.col("_blocks"), long, linked))
    lines = F.transform("_kept", lambda b: b["text"])
    made = {
        out: F.array_join(lines, "\n"),
        "n_blocks": F.size("_blocks").cast("bigint"),
        "n_kept": F.size("_kept").cast("bigint"),
    }
    return df.withColumns(made).drop("_marked", "_blocks", "_kept")
