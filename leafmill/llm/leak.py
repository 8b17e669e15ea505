"""Problem 8: passages of evaluation items inside the corpus.

Each task turns its part of the corpus into shards of word numbers, sorts the suffixes of a shard (suffix array by
prefix doubling) and searches every suffix of every item in it by bisection, a few words at a time: the place found
lies between the two suffixes with the longest common prefixes; going away from them, what a suffix shares with the
item is the running minimum of what neighbours share with each other. The range of suffixes that share its first
`least` words gives all documents it stands in. Memory is a fixed number of arrays as long as the shard, whatever the
length of an item; shards have a fixed number of words, so it does not depend on the size of a partition either.

Words are runs of letters or digits in lower case; typesetting commands are skipped, and so is everything between
words. Words that occur in no item are one number that equals nothing. A suffix with such a word among its first
`least` cannot match and stays out of the array; that is exact, and leaves little to sort.

Items are sent to the tasks in blocks of at most `block_words` words, one pass over the corpus a block, so what is
broadcast is bounded whatever the number of items.

Defined results: null and empty texts and items, and items below `least` words, match nothing; null ids are dropped;
a pair is reported once with its longest match, the earliest in the item on ties; an item repeated under another id is
reported under both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A command, or a word.
TOKEN = re.compile(r"\\(?:[a-z]+\*?|.)|[^\W_]+", re.DOTALL)
SHARD_WORDS = 2_000_000
SCHEMA = "doc_id long, item_id long, words int, item_begin int"


def words_of(text: str) -> list[str]:
    """Words of a text, commands skipped."""
    return [w for w in TOKEN.findall(text.lower()) if w[0] != "\\"]


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts in the order of the suffixes of `words` that begin there, compared over `depth` words at least.

    Prefix doubling over all places: ranks over 1, 2, 4, ... words; a place beyond the end ranks lowest.
    """
    if not len(starts):
        return starts
    rank = words.astype(np.int64)
    span = 1
    while span < depth:
        shifted = np.zeros(len(rank), np.int64)
        shifted[: len(rank) - span] = rank[span:] + 1 if len(rank) > span else shifted[:0]
        _, rank = np.unique(rank * (int(shifted.max()) + 1) + shifted, return_inverse=True)
        span *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


class Shard:
    """Word numbers of some documents, and the sorted suffixes worth searching."""

    def __init__(self, words: np.ndarray, doc_of: np.ndarray, least: int, depth: int):
        live = np.concatenate(([0], np.cumsum(words != 0)))
        starts = np.flatnonzero(live[least:] - live[:-least] == least) if len(words) >= least else np.zeros(0, np.int64)
        keep = np.zeros(len(words) + depth + 1, bool)  # words within `depth` of a start
        if len(starts):
            edge = np.zeros(len(keep) + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, np.minimum(starts + least, len(keep)), -1)
            keep = np.cumsum(edge[:-1]) > 0
        kept = np.flatnonzero(keep[: len(words)])
        place = np.cumsum(keep[: len(words)]) - 1
        gap = np.concatenate((np.diff(kept) > 1, [True])) if len(kept) else np.zeros(0, bool)
        shift = np.concatenate(([0], np.cumsum(gap)[:-1])) if len(kept) else gap  # a 0 after each stretch
        self.words = np.zeros(len(kept) + int(gap.sum()) + depth + 17, np.int64)
        self.words[np.arange(len(kept)) + shift] = words[kept]
        self.doc_of = np.full(len(self.words), -1, np.int64)
        self.doc_of[np.arange(len(kept)) + shift] = doc_of[kept]
        own = place[starts]
        self.sorted = suffix_array(self.words, own + shift[own] if len(own) else own, depth)

        self.shared = self._shared_by_neighbours(depth)

    def _shared_by_neighbours(self, depth: int) -> np.ndarray:
        """Words that each sorted suffix shares with the one before it (0 for the first), at most depth."""
        out = np.zeros(len(self.sorted), np.int64)
        open_ = np.arange(1, len(self.sorted))
        for step in range(depth):
            a, b = self.words[self.sorted[open_] + step], self.words[self.sorted[open_ - 1] + step]
            open_ = open_[(a == b) & (a != 0)]
            if not len(open_):
                break
            out[open_] += 1
        return out

    def bounds(self, wanted: np.ndarray, skip: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
        """Where rows of words belong among the sorted suffixes of [low, high), all of which share the `skip` words before; all by bisection at once."""
        low, high = low.copy(), high.copy()
        step = np.arange(wanted.shape[1])
        rows = np.arange(len(wanted))
        while (open_ := low < high).any():
            middle = (low + high) // 2
            at = self.sorted[np.minimum(middle, len(self.sorted) - 1)] + skip
            there = self.words[np.minimum(at[:, None] + step, len(self.words) - 1)]
            other = there != wanted
            first = other.argmax(1)
            less = np.where(other.any(1), there[rows, first] < wanted[rows, first], right)
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    def common(self, queries: np.ndarray, at: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
        """Words that the query suffixes share with the sorted suffixes at places (0 outside), word by word."""
        out = np.zeros(len(at), np.int64)
        open_ = np.flatnonzero((places >= 0) & (places < len(self.sorted)))
        for step in range(depth):
            a, b = self.words[self.sorted[places[open_]] + step], queries[at[open_] + step]
            open_ = open_[(a == b) & (b != 0)]
            if not len(open_):
                break
            out[open_] += 1
        return out


class Items:
    """A block of items as one array of word numbers with a 0 after each, and all suffixes of at least `least` words."""

    def __init__(self, rows: list[tuple[int, list[str]]], least: int):
        self.number: dict[str, int] = {}
        self.depth = max((len(w) for _, w in rows), default=0)
        words, item, begin = [], [], []
        for i, (_, own) in enumerate(rows):
            words += [self.number.setdefault(w, len(self.number) + 1) for w in own] + [0]
            item += [i] * (len(own) + 1)
            begin += range(len(own) + 1)
        self.words = np.array(words + [0] * (self.depth + 17), np.int64)
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.item, self.begin = np.array(item, np.int64), np.array(begin, np.int64)
        length = np.array([len(w) for _, w in rows], np.int64)
        self.suffixes = np.flatnonzero(length[self.item] - self.begin >= least) if rows else np.zeros(0, np.int64)
        self.least = least

    def _places(self, shard: Shard, at: np.ndarray, low: np.ndarray, high: np.ndarray, step: int = 16) -> np.ndarray:
        """Where the whole suffixes at `at` belong within [low, high), which share the first `least` words with them."""
        place, skip = low.copy(), np.full(len(at), self.least, np.int64)
        low, high, open_ = low.copy(), high.copy(), np.arange(len(at))
        while len(open_):
            wanted = self.words[np.minimum(at[open_] + skip[open_], len(self.words) - step)[:, None] + np.arange(step)]
            a = shard.bounds(wanted, skip[open_], low[open_], high[open_], False)
            b = shard.bounds(wanted, skip[open_], low[open_], high[open_], True)
            place[open_], low[open_], high[open_] = a, a, b
            skip[open_] += step
            open_ = open_[(b > a) & ~(wanted == 0).any(1)]  # some share these words, too, and the item goes on
        return place

    def search(self, shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(document places, item ids, words, begin in item): the longest match of each pair in the shard."""
        if not len(shard.sorted):
            return
        at = self.suffixes
        first = self.words[at[:, None] + np.arange(self.least)]
        none, all_ = np.zeros(len(at), np.int64), np.full(len(at), len(shard.sorted), np.int64)
        low, high = shard.bounds(first, none, none, all_, False), shard.bounds(first, none, none, all_, True)
        at, low, high = at[high > low], low[high > low], high[high > low]
        if not len(at):
            return
        place = self._places(shard, at, low, high)
        before, behind = shard.common(self.words, at, place - 1, self.depth), shard.common(self.words, at, place, self.depth)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for a, lo, mid, hi, left, right in zip(at.tolist(), low.tolist(), place.tolist(), high.tolist(), before.tolist(), behind.tolist()):
            item, begin = int(self.item[a]), int(self.begin[a])
            down = np.minimum.accumulate(np.concatenate(([left], shard.shared[lo + 1 : mid][::-1])))[::-1] if mid > lo else np.zeros(0, np.int64)
            up = np.minimum.accumulate(np.concatenate(([right], shard.shared[mid + 1 : hi]))) if hi > mid else np.zeros(0, np.int64)
            docs = shard.doc_of[shard.sorted[lo:hi]]
            for doc, words in zip(docs.tolist(), np.concatenate((down, up)).tolist()):
                if (words, -begin) > best.get((doc, item), (0, 0)):
                    best[doc, item] = (words, -begin)
        pairs = np.array(list(best), np.int64)
        values = np.array(list(best.values()), np.int64)
        yield pairs[:, 0], self.ids[pairs[:, 1]], values[:, 0], -values[:, 1]


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in blocks of at most block_words words (one item at least)."""
    block, size = [], 0
    for row in items.toLocalIterator():
        own = words_of(row.text)
        if block and size + len(own) > block_words:
            yield block
            block, size = [], 0
        block.append((row.item_id, own))
        size += len(own)
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, least: int = 12, id_column: str = "doc_id", column: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, words, item_begin): the longest verbatim match of each affected document and item."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("text")).where("doc_id is not null and text is not null")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")
    out = None
    for block in _blocks(wanted, block_words):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Items(sent.value, least)
            number = own.number.get
            words: list[int] = []
            ends: list[int] = []
            ids: list[int] = []

            def flush() -> Iterator[pa.RecordBatch]:
                sizes = np.diff(np.array([0, *ends]))
                shard = Shard(np.array(words, np.int64), np.repeat(np.arange(len(ids)), sizes), least, max(own.depth, least))
                for places, item, length, begin in own.search(shard):
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[places]), pa.array(item), pa.array(length.astype(np.int32)), pa.array(begin.astype(np.int32))], names=["doc_id", "item_id", "words", "item_begin"])

            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words += [number(w, 0) for w in TOKEN.findall(text.lower()) if w[0] != "\\"]
                    words.append(0)
                    ids.append(doc)
                    ends.append(len(words))
                    if len(words) >= SHARD_WORDS:
                        yield from flush()
                        words, ends, ids = [], [], []
            if ids:
                yield from flush()

        part = corpus.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    best = F.max(F.struct("words", (-F.col("item_begin")).alias("b"))).alias("best")  # the same document may be delivered twice
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.words").alias("words"), (-F.col("best.b")).alias("item_begin"))


def without_leaks(docs: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """The documents no item leaked into."""
    return docs.join(matches(docs, items, least).select("doc_id").distinct(), "doc_id", "left_anti")
