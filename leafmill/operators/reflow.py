"""Soft line breaks of a paragraph joined again.

A line takes the next one when it has reached the width at which the paragraph was wrapped and neither begins a
structural element. What counts is the line as joined so far, so after the first full line of a run all lines of the
run follow it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions.text import strip, strip_glyphs

LEAST_WIDTH = 45


def reflow_block(block: Column) -> Column:
    """One paragraph; null if it has no text."""
    lines = F.filter(F.transform(F.split(block, "\n", -1), strip), lambda x: x != "")
    width = F.array_max(F.transform(lines, F.length))
    least = F.greatest(F.lit(LEAST_WIDTH), F.floor(width * F.lit(0.6)).cast("int"))
    start = F.struct(F.lit("").alias("done"), F.get(lines, F.lit(0)).alias("line"))

    def add(s: Column, line: Column) -> Column:
        now = s["line"]
        soft = (F.length(now) >= least) & ~now.rlike(P.STRUCTURAL) & ~line.rlike(P.STRUCTURAL)
        hyphen = now.rlike(r"\p{L}-\z") & line.rlike(r"\A\p{Ll}")
        joined = F.when(hyphen, F.concat(F.substring(now, F.lit(1), F.length(now) - 1), line)).otherwise(F.concat(now, F.lit(" "), line))
        return F.struct(F.when(soft, s["done"]).otherwise(F.concat(s["done"], now, F.lit("\n"))).alias("done"), F.when(soft, joined).otherwise(line).alias("line"))

    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    # one line stays, and lines below the least width never join; only other blocks need the fold
    return F.when(F.size(lines) == 1, F.get(lines, F.lit(0))).when((F.size(lines) > 0) & (width < LEAST_WIDTH), F.array_join(lines, "\n")).when(F.size(lines) > 0, F.aggregate(rest, start, add, lambda s: F.concat(s["done"], s["line"])))


def reflow(text: Column) -> Column:
    """All paragraphs of a text, without the names of missing glyphs."""
    blocks = F.split(strip_glyphs(text), r"\n[ \t]*\n", -1)
    return F.array_join(F.filter(F.transform(blocks, reflow_block), lambda x: x.isNotNull()), "\n\n")
