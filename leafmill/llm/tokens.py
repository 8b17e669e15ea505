"""Problem 4: how many tokens each document, source, language and domain holds under an existing byte-level BPE.

A byte-level BPE never merges across the pieces its pattern cuts a text into, so a document's count is the sum over
its pieces, and a piece needs to be tokenized once however often it occurs.

1. The scan stage cuts texts into pieces and writes, per block of documents, one row for each distinct piece with the
   documents it stands in and how often (postings). They stay where they were written; nothing is shuffled.
2. The distinct pieces of the corpus are partitioned by range and sorted, which is the depth-first order of a prefix
   trie; each range is a part of the trie. The walk keeps a stack with one state for each byte of the current path: the
   last token of the tokenization of that prefix and the number of its tokens. The next piece drops the states beyond
   the shared prefix and extends from there. The state is exact: the tokenization of a prefix is the only sequence of
   tokens in which each two neighbours would not have been merged otherwise, so the last token is the one suffix that
   is compatible with the last token of what is left of it.
3. Terminal counts are joined to the postings. The pieces in most blocks (at most `BROADCAST_PIECES`, whatever the
   corpus) are sent to the tasks, so the postings of " the" are summed by document where they lie; all others meet
   their counts behind a shuffle, and there no piece has many postings. Sums by document are partial before their shuffle; labels are joined to the documents and totals
   grouped.

Defined results: null and empty texts have 0 tokens; special-token strings are ordinary text; rows that share an id
(a null id, too) count together under the least of their labels; a missing label is "und" (language) or "unknown".
The path of the vocabulary is a parameter; nothing of it is kept in the repository.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import map_arrow
from leafmill.llm.labels import single_label
from leafmill.llm.store import together, written

#: A file of ranks: base64 of a token's bytes, blank, rank. TOKENIZER_FILE in the environment replaces it.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Most pieces whose counts are sent to all tasks (about 10 MB).
BROADCAST_PIECES = 200_000


def _char_class(kinds: str, last: int) -> str:
    """Code points up to last of the general categories that begin with one of kinds, as ranges for a character class."""
    out, start = [], None
    for cp in range(last + 2):
        inside = cp <= last and unicodedata.category(chr(cp))[0] in kinds
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


@functools.cache
def pieces_pattern(last: int = sys.maxunicode) -> re.Pattern[str]:
    """The splitting pattern of the rank files in terms Python's own engine knows (it is several times as fast), for texts of characters up to last."""
    letter, number, space = _char_class("L", last), _char_class("N", last), r"\t-\r\x20\x85\xa0  -     　"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def pieces(text: str) -> list[str]:
    """The pieces of a text.

    The engine tests ranges beyond U+FFFF one by one for every character outside of a class, those below by a table; a
    text without such characters does not need them.
    """
    wide = len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text)
    return pieces_pattern(sys.maxunicode if wide else 0xFFFF).findall(text)


def ship_vocabulary(spark: SparkSession, path: str) -> None:
    """Sends the file to the executors, once a session."""
    if os.path.basename(path) not in {os.path.basename(x) for x in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)


@functools.cache
def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The table of a rank file: the one sent along, or on the driver the file itself."""
    sent = SparkFiles.get(os.path.basename(path)) if SparkFiles._is_running_on_worker else path
    with open(sent if os.path.exists(sent) else path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TrieWalk:
    """Tokenization states along the path of the current piece in a trie of pieces in sorted order."""

    def __init__(self, table: dict[bytes, int]):
        self.table = table
        self.bytes_of = {r: b for b, r in table.items()}
        self.longest = max(map(len, table))
        self.halves: dict[int, tuple[int, int]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.path = b""
        self.last = [-1]
        self.count = [0]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; a single byte is both halves of itself."""
        if (known := self.halves.get(token)) is None:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                merged = [(self.table.get(parts[i] + parts[i + 1], len(self.bytes_of) + 1), i) for i in range(len(parts) - 1)]
                rank, i = min(merged)
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = (token, token) if len(parts) != 2 else (self.table[parts[0]], self.table[parts[1]])
            self.halves[token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether tokenizing the bytes of both gives just these two: no merge across the border comes before the merges inside.

        Merges are undone from the latest; at each stage the pair at the border must not have been merged earlier.
        """
        key = left, right
        if (known := self.compatible.get(key)) is None:
            known, before = True, len(self.bytes_of) + 1
            while True:
                joined = self.table.get(self.bytes_of[left] + self.bytes_of[right])
                if joined is not None and joined < before and self.split(joined) == (left, right):
                    known = False
                    break
                inner, outer = self.split(left)[1], self.split(right)[0]
                whole = inner == left, outer == right
                if whole[0] and whole[1]:
                    break
                # undo the later of the two merges; at the same rank the left one was made first
                if whole[1] or not whole[0] and left > right:
                    before, left = left, inner
                else:
                    before, right = right + 1, outer
            self.compatible[key] = known
        return known

    def tokens(self, piece: str) -> int:
        """Number of tokens of a piece; what it shares with the piece before is not done again."""
        data = piece.encode("utf-8", "surrogatepass")
        shared = len(os.path.commonprefix((self.path, data)))
        del self.last[shared + 1 :], self.count[shared + 1 :]
        table, last, count = self.table, self.last, self.count
        for end in range(shared + 1, len(data) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = table.get(data[begin:end])
                if token is not None and (begin == 0 or self.fits(last[begin], token)):
                    last.append(token)
                    count.append(count[begin] + 1)
                    break
        self.path = data
        return count[-1]


class PieceCounts(dict):
    """piece → tokens, filled on demand and emptied when it grows beyond a bound. For callers that need no trie."""

    def __init__(self, path: str = VOCABULARY, most: int = 1_000_000):
        self.walk, self.most = TrieWalk(ranks(path)), most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[piece] = self.walk.tokens(piece)
        return n

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, pieces_pattern().findall(text)))


def postings(docs: DataFrame) -> DataFrame:
    """(piece, ids, counts) from (doc_id, text): per block of documents one row a distinct piece, and one without a piece that has their lengths."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        findall = pieces_pattern().findall
        ids = np.array(batch.column(0).cast(pa.int64()), np.int64)
        texts = batch.column(1).to_pylist()
        found: dict[str | None, list[int]] = {None: [x for row, text in enumerate(texts) for x in (row, len(text))]}
        for row, text in enumerate(texts):
            for piece, n in Counter(findall(text)).items():
                if (at := found.get(piece)) is None:
                    found[piece] = [row, n]
                else:
                    at += (row, n)
        ends = np.cumsum([0, *(len(v) // 2 for v in found.values())]).astype(np.int32)
        flat = np.fromiter(itertools.chain.from_iterable(found.values()), np.int64, 2 * int(ends[-1]))
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (ids[flat[::2]], flat[1::2].astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *lists], names=["piece", "ids", "counts"])

    return map_arrow(docs, one, "piece string, ids array<long>, counts array<int>")


def terminal_counts(pieces: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Distinct pieces with their number of tokens. Ranges of the pieces are the parts of the trie; a piece is one row, so no range is hot."""
    ship_vocabulary(pieces.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = TrieWalk(ranks(path))
        for batch in batches:
            tokens = [walk.tokens(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int32())], names=["piece", "blocks", "tokens"])

    return pieces.repartitionByRange("piece").sortWithinPartitions("piece").mapInArrow(run, "piece string, blocks long, tokens int")


def widespread(pieces: DataFrame, most: int = BROADCAST_PIECES) -> int:
    """The least number of blocks (a power of two) such that at most `most` pieces stand in so many."""
    left, bound = most, 1 << 62
    for r in pieces.groupBy(F.floor(F.log2("blocks")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect():  # at most 64 rows
        left -= r["count"]
        if left < 0:
            break
        bound = 1 << r.power
    return bound


def document_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, chars) from (doc_id, text); documents without text are missing."""
    # a null id is kept apart from all others as the least number
    safe = docs.where("text is not null and text != ''").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "text")
    rows = written(postings(safe), "postings")
    held = rows.where("piece is not null")
    pieces = written(terminal_counts(held.groupBy("piece").agg(F.count("*").alias("blocks")), path), "pieces")
    least = widespread(pieces)
    hot = F.broadcast(pieces.where(F.col("blocks") >= least).select("piece", "tokens"))  # at most BROADCAST_PIECES rows
    rare = pieces.where(F.col("blocks") < least).select("piece", "tokens")

    def each(part: DataFrame, tokens: Column, chars: Column) -> DataFrame:
        flat = part.withColumn("x", F.explode(F.arrays_zip("ids", "counts")))
        return flat.select(F.col("x.ids").alias("doc_id"), (tokens * F.col("x.counts")).cast("long").alias("tokens"), (chars * F.col("x.counts")).cast("long").alias("chars"))

    known = each(held.join(hot, "piece"), F.col("tokens"), F.lit(0))
    others = each(held.join(hot, "piece", "left_anti").join(rare, "piece"), F.col("tokens"), F.lit(0))
    sizes = each(rows.where("piece is null"), F.lit(0), F.lit(1))
    summed = known.unionByName(others).unionByName(sizes).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))
    return summed.select(F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"), "tokens", "chars")


def labelled(df: DataFrame, column: str, source: Column, domain: str) -> DataFrame:
    """(doc_id, text, source, lang, domain) of a table."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(column).alias("text"),
        F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("unknown")).alias("source"),
        single_label(F.col("lang")).alias("lang"),
        F.coalesce(F.nullif(F.trim(F.col(domain)), F.lit("")), F.lit("unknown")).alias("domain"),
    )


def converted(md_documents: DataFrame) -> DataFrame:
    """Converted documents; the source is the label before the bullet."""
    return labelled(md_documents, "markdown", F.substring_index("source", " • ", 1), "kind")


def articles(documents: DataFrame) -> DataFrame:
    return labelled(documents, "text", F.col("source"), "field")


def with_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, domain, chars, tokens) of labelled documents. Labels are read without the texts."""
    labels = docs.groupBy("doc_id").agg(F.min(F.struct("source", "lang", "domain")).alias("l"))
    counts = document_tokens(docs.select("doc_id", "text"), path).withColumnRenamed("doc_id", "id")
    joined = labels.join(counts, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select("doc_id", "l.source", "l.lang", "l.domain", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def budget(md_documents: DataFrame, documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(corpus, source, lang, domain, docs, chars, tokens): totals of every slice of both tables."""
    spark = documents.sparkSession
    ship_vocabulary(spark, path)
    parts = together(spark, lambda: with_tokens(converted(md_documents), path).withColumn("corpus", F.lit("md_documents")), lambda: with_tokens(articles(documents), path).withColumn("corpus", F.lit("documents")))
    return parts[0].unionByName(parts[1]).groupBy("corpus", "source", "lang", "domain").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


def slices(md_documents: DataFrame, documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(corpus, slice, value, docs, tokens): totals by source, by language and by domain."""
    total = budget(md_documents, documents, path)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("slice"), F.col(c).alias("value")) for c in ("source", "lang", "domain")))).alias("s")
    return total.select("corpus", "docs", "tokens", each).groupBy("corpus", "s.slice", "s.value").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
