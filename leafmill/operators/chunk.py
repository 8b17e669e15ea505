"""Greedy chunks as folds over arrays; the text never leaves its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import let, strip


def pack(pieces: Column, separator: str, limit: Column) -> Column:
    """Pieces joined by the separator up to the limit; a piece above it stands alone. Leading empty pieces vanish."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        joined = F.when(state["open"] == "", piece).otherwise(F.concat(state["open"], F.lit(separator), piece))
        full = (state["open"] != "") & (F.length(joined) > limit)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(full, piece).otherwise(joined).alias("open"),
        )

    return F.aggregate(pieces, empty, add, lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def hard_slices(text: Column, limit: Column) -> Column:
    """Slices of the limit's length."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), limit)
    return F.transform(starts, lambda i: F.substring(text, i, limit))


def split_ladder(text: Column, limit: Column) -> Column:
    """Chunks within the limit: by paragraphs, what is too long by lines, by words, by length. Boundary separators are dropped."""

    def refine(parts: Column, finer) -> Column:
        return F.flatten(F.transform(parts, lambda x: F.when(F.length(x) <= limit, F.array(x)).otherwise(finer(x))))

    words = lambda x: refine(pack(F.split(x, " ", -1), " ", limit), lambda w: hard_slices(w, limit))
    lines = lambda x: refine(pack(F.split(x, "\n", -1), "\n", limit), words)
    whole = lambda parts: F.when(F.size(parts) == 0, F.array(text)).otherwise(parts)
    out = let(refine(let(pack(F.split(text, "\n\n", -1), "\n\n", limit), whole), lines), whole)
    # a text within the limit that no empty piece leads is one chunk; the fold is for the others
    return F.when((F.length(text) <= limit) & ~text.startswith("\n\n"), F.array(text)).otherwise(out)


def chunks_for(text: Column, limit: Column, no_chunk: Column) -> Column:
    """Chunks of a document under a profile: none for blank text, one where the profile forbids splitting."""
    t = strip(text)
    return F.when(t == "", F.array().cast("array<string>")).when(no_chunk | limit.isNull(), F.array(t)).otherwise(split_ladder(t, limit))


def valid_chunk_tokens(value: Column) -> Column:
    """A configured chunk size in tokens, or the default outside the bounds (fixed values)."""
    number = value.try_cast("int")
    return F.when(number.between(5_000, 190_000), number).otherwise(F.lit(55_000))
