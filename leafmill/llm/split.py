"""Problem 3: pieces under a size limit, cut at natural boundaries, with a given overlap.

Recursive bisection: a stretch longer than limit minus overlap is cut at the strongest boundary in its middle half
(paragraph, line, sentence, word; the one nearest to the midpoint); if its middle half has none, at the strongest
anywhere in it; if it has none at all, at the midpoint, between no letter and its mark. Both
halves are treated alike. The stretches join to the text exactly. Each piece but the first then starts `overlap`
characters before its stretch, so no piece is above the limit.

The boundary of a document above its limit is found by the same bisection, tried with one kind of boundary after the
other, the coarsest first.

Sizes are code points.

Defined results: null and empty texts have no piece; a null limit, or one below 1, means no splitting; a null or
negative overlap is 0, one above half the limit counts as half the limit. A kind without a profile is not split; of
several profiles of a kind the one with the least limit holds. Repeated rows are split each on its own; extra columns
are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import map_arrow

#: Strongest first; a cut goes behind the match.
LEVELS = (("paragraph", re.compile(r"\n\n")), ("line", re.compile(r"\n")), ("sentence", re.compile(r"[.!?…][\"'”’»)\]]* ")), ("word", re.compile(r" ")))
#: What a boundary of each name looks like at the end of a text.
ENDS = {"paragraph": "\n\n", "line": "\n", "word": ("\n", " ")}
SCHEMA = "doc_id long, piece_no int, begin long, overlap long, text string, boundary string, oversize boolean"


def cut_places(text: str) -> list[np.ndarray]:
    """Places of a cut by level, ascending."""
    return [np.fromiter((m.end() for m in pattern.finditer(text)), np.int64) for _, pattern in LEVELS]


def _nearest(places: np.ndarray, low: int, high: int, middle: int) -> int | None:
    """The place in [low, high] nearest to middle, the earlier of two."""
    a, b = np.searchsorted(places, (low, high + 1))
    if a >= b:
        return None
    k = int(np.searchsorted(places[a:b], middle)) + int(a)
    near = [int(places[i]) for i in (k - 1, k) if a <= i < b]
    return min(near, key=lambda p: (abs(p - middle), p))


def bisect(size: int, most: int, places: list[np.ndarray], hard: Callable[[int, int], int] | None = None) -> list[tuple[int, int]]:
    """(begin, end) of stretches of at most `most` characters that join to the text. One without a boundary is cut by `hard`, or stays."""
    out, todo = [], [(0, size)]
    while todo:
        begin, end = todo.pop()
        if end - begin <= most:
            out.append((begin, end))
            continue
        middle, quarter = begin + (end - begin) // 2, (end - begin) // 4
        inner, outer = (max(begin + quarter, begin + 1), min(end - quarter, end - 1)), (begin + 1, end - 1)
        cut = next((c for low, high in (inner, outer) for p in places if (c := _nearest(p, low, high, middle)) is not None), None)
        if cut is None and hard is None:
            out.append((begin, end))
            continue
        todo += [(cut := hard(begin, middle) if cut is None else cut, end), (begin, cut)]
    return out


def _between_letters(text: str) -> Callable[[int, int], int]:
    """A cut at a place, or before it where a mark or a joiner stands there."""

    def cut(begin: int, place: int) -> int:
        at = place
        while at > begin + 1 and (unicodedata.combining(text[at]) or text[at] == "\u200d" or text[at - 1] == "\u200d"):
            at -= 1
        return at if at > begin + 1 else place

    return cut


def sufficient(text: str, limit: int) -> str:
    """The coarsest boundary that suffices: bisection at it alone leaves no piece above the limit, its own characters at the end aside."""
    known = dict(LEVELS)
    for name, kinds, ends in (("paragraph", ("paragraph",), 2), ("line", ("line",), 1), ("word", ("line", "word"), 1)):
        places = [np.sort(np.concatenate([np.fromiter((m.end() for m in known[k].finditer(text)), np.int64) for k in kinds]))]
        pieces = bisect(len(text), limit, places)
        if all(end - begin - ends * (end < len(text) or text.endswith(ENDS[name])) <= limit for begin, end in pieces if end - begin > limit):
            return name
    return "none"


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(begin of the stretch, overlap in front of it, piece)."""
    overlap = min(max(0, overlap), limit // 2)
    stretches = bisect(len(text), max(1, limit - overlap), cut_places(text), _between_letters(text))
    return [(begin, min(overlap, begin), text[begin - min(overlap, begin) : end]) for begin, end in stretches]


def with_limits(docs: DataFrame, profiles: DataFrame, id_column: str = "doc_id", column: str = "markdown") -> DataFrame:
    """(doc_id, text, size, most, overlap): the limit of the profile with the document's kind. Profiles are one row a kind, so Spark broadcasts them by their size."""
    by_kind = profiles.where("kind is not null and chunk_chars is not null").groupBy("kind").agg(F.min(F.struct("chunk_chars", "overlap_chars")).alias("p"))
    return (
        docs.where(F.col(column).isNotNull() & (F.col(column) != ""))
        .select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("text"), "kind")
        .join(by_kind, "kind", "left")
        .select("doc_id", "text", F.length("text").alias("size"), F.when(F.col("p.chunk_chars") >= 1, F.col("p.chunk_chars")).alias("most"), F.coalesce("p.overlap_chars", F.lit(0)).alias("overlap"))
    )


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(7)]
    for doc, text, size, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
        over = limit is not None and size > limit
        boundary = sufficient(text, limit) if over else None
        for k, (begin, before, piece) in enumerate(pieces_of(text, limit, overlap) if over else [(0, 0, text)]):
            for column, value in zip(out, (doc, k, begin, before, piece, boundary, over)):
                column.append(value)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece_no", "begin", "overlap", "text", "boundary", "oversize"])


def split_documents(docs: DataFrame, profiles: DataFrame, id_column: str = "doc_id", column: str = "markdown") -> DataFrame:
    """All pieces of all documents, in one scan; those within their limit are one piece."""
    return map_arrow(with_limits(docs, profiles, id_column, column), _cut, SCHEMA)


def _boundaries(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [sufficient(text, limit) for text, limit in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "boundary"])


def oversize(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, boundary) of documents above their limit; only those reach Python."""
    return map_arrow(with_limits(docs, profiles).where("size > most"), _boundaries, "doc_id long, boundary string").distinct()
