"""Problem 7: articles into training windows of a fixed number of tokens, related articles together.

Retrieval packing: articles are put in an order of topics and cut into shards of about `SHARD` neighbours in it; each
shard holds an inverted index of its articles with BM25 weights whose document frequencies are those of the whole
corpus (terms are hashed into a table of fixed size, so the frequencies are one bounded vector). In a shard the largest
unused article seeds a window, the index returns the unused articles in order of their score, and those that fit fill
the window until a third of it is left; the rest takes the unused article, or the two of them, that leave least room,
the better score on ties.

The order of topics: `CENTROIDS` centroids of term vectors are fitted on a bounded sample (`SAMPLE` articles, by hash),
and each article is placed by its nearest centroids, the nearest first; centroids are in a chain, each next to the one
most like it. Versions and copies of an article have the same centroids and stay together. The order is a range
partitioning, so no cell is hot, and shards have a bounded number of articles, so memory and time of a task do not
depend on the corpus. What lies in another shard is not found; README has the measured recall.

An article above the window is cut into full windows of its own; its rest is packed like an article.

Defined results: null and empty texts have no tokens and take no place (they are in no window); rows that share an id
are packed once for each row; null ids are packed, too; ties go to the article with the lesser id. Every token of
every article is in exactly one window.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import map_arrow
from leafmill.llm.tokens import VOCABULARY, PieceCounts, pieces, ship_vocabulary
from leafmill.llm.store import together, written

WINDOW = 4096
#: Articles in a shard on average, buckets of hashed terms, and the share of a shard's articles above which a term is stored as a row of all.
SHARD = 5000
BUCKETS = 1 << 17
COMMON = 1 / 16
K1, B = 1.2, 0.75
#: Centroids, how many of them place an article, and articles they are fitted on.
CENTROIDS, PLACES, SAMPLE, FIT_ROUNDS = 64, 4, 3000, 5
WORD = re.compile(r"^ ?([^\W\d_]{3,})$")

#: Neighbours looked at together, best first.
NEAREST = 64
OUT = "shard int, window_no int, doc_id long, part_no int, begin long, tokens int, score float"


class PieceInfo(dict):
    """piece → (tokens, term bucket or -1), filled on demand within a bound."""

    def __init__(self, path: str, most: int = 500_000):
        self.counts, self.most = PieceCounts(path), most

    def __missing__(self, piece: str) -> tuple[int, int]:
        if len(self) >= self.most:
            self.clear()
        word = WORD.match(piece)
        value = self[piece] = (self.counts[piece], zlib.crc32(word[1].lower().encode("utf-8", "replace")) % BUCKETS if word else -1)
        return value


@functools.cache
def info(path: str) -> PieceInfo:
    return PieceInfo(path)


def profiles(docs: DataFrame, id_column: str = "doc_id", column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, terms, freqs): exact tokens and the term vector of each article with text; one scan."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lookup = info(path)
        tokens, flat, sizes = [], [], []
        for text in batch.column(1).to_pylist():
            total, own = 0, {}
            for piece, times in Counter(pieces(text)).items():
                n, term = lookup[piece]
                total += n * times
                if term >= 0:
                    own[term] = own.get(term, 0) + times
            tokens.append(total)
            sizes.append(len(own))
            flat += own.items()
        pairs = np.array(flat, np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 0], np.repeat(np.arange(len(sizes)), sizes)))]
        bounds = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32))
        terms = pa.ListArray.from_arrays(bounds, pa.array(pairs[:, 0].astype(np.int32)))
        freqs = pa.ListArray.from_arrays(bounds, pa.array(np.minimum(pairs[:, 1], 32767).astype(np.int16)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int32()), terms, freqs], names=["doc_id", "tokens", "terms", "freqs"])

    chosen = docs.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("text"))
    return map_arrow(chosen, one, "doc_id long, tokens int, terms array<int>, freqs array<short>")


class Index:
    """Inverted BM25 index of the articles of a shard."""

    def __init__(self, terms: list[np.ndarray], freqs: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(t) for t in terms])
        doc = np.repeat(np.arange(len(terms)), sizes)
        flat = np.concatenate(terms) if len(terms) else np.zeros(0, np.int32)
        tf = np.concatenate(freqs).astype(np.float32) if len(terms) else np.zeros(0, np.float32)
        length = np.zeros(len(terms), np.float32)
        np.add.at(length, doc, tf)
        weight = idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean, 1e-9)))
        order = np.argsort(flat, kind="stable")
        doc, flat, weight = doc[order], flat[order], weight[order].astype(np.float32)
        bucket, start, size = np.unique(flat, return_index=True, return_counts=True)
        common = size > COMMON * len(terms)
        self.bucket, self.start, self.doc, self.weight = bucket, np.append(start, len(flat)), doc, weight
        self.row = np.where(common, np.cumsum(common) - 1, -1)  # at most articles' terms / COMMON rows
        self.rows = np.zeros((int(common.sum()), len(terms)), np.float32)
        at = np.repeat(self.row, size)
        self.rows[at[at >= 0], doc[at >= 0]] = weight[at >= 0]
        self.terms = terms

    def scores(self, seed: int, docs: int) -> np.ndarray:
        """BM25 of all articles for all terms of the seed."""
        at = np.searchsorted(self.bucket, self.terms[seed])
        out = self.rows[self.row[at[self.row[at] >= 0]]].sum(axis=0, dtype=np.float32)
        spans = [slice(self.start[k], self.start[k + 1]) for k in at[self.row[at] < 0]]
        if spans:
            out = out + np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), docs).astype(np.float32)
        return out


class BySize:
    """Articles in the order of their size, for the one or two that fill a room best."""

    def __init__(self, left: np.ndarray, rank: np.ndarray):
        self.left = left
        self.order = np.lexsort((-rank, left))  # ascending size, the first in rank last of a size
        self.size = left[self.order]

    def closest(self, unused: np.ndarray, score: np.ndarray, room: int) -> list[int]:
        """The unused article, or two, that fill the room best, the better score on ties; nothing if none fits."""
        fits = self.order[: np.searchsorted(self.size, room, side="right")]
        fits = fits[unused[fits]]
        if not len(fits):
            return []
        size = self.left[fits]

        def best(of: int, but: int = -1) -> int:
            low, high = np.searchsorted(size, (of, of + 1))
            same = fits[low:high][fits[low:high] != but]
            return int(same[len(same) - 1 - int(score[same][::-1].argmax())])

        one = int(size[-1])
        if len(fits) > 1 and one < room:
            mate = np.minimum(np.searchsorted(size, room - size, side="right") - 1, np.arange(len(size)) - 1)  # a partner below in the order
            both = np.where(mate >= 0, size + size[np.maximum(mate, 0)], 0)
            k = len(both) - 1 - int(both[::-1].argmax())
            if both[k] > one:
                first = best(int(size[k]))
                return [first, best(int(size[mate[k]]), first)]
        return [best(one)]


def pack_shard(ids: list[int | None], tokens: np.ndarray, index: Index, window: int = WINDOW) -> list[tuple[int, int, int, int, int, float]]:
    """(window, article, part, begin, tokens, score) of a shard: whole windows of oversized articles first, then the greedy fill."""
    out = []
    number = 0
    begin = np.zeros(len(ids), np.int64)
    part = np.zeros(len(ids), np.int64)
    left = tokens.astype(np.int64).copy()
    for d in np.flatnonzero(tokens > window):
        while left[d] > window:
            out.append((number, int(d), int(part[d]), int(begin[d]), window, 0.0))
            number, begin[d], part[d], left[d] = number + 1, begin[d] + window, part[d] + 1, left[d] - window
    key = np.array([-(2**63) if i is None else i for i in ids], np.int64)
    order = np.lexsort((key, -left))  # largest first, then the lesser id
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    unused = left > 0
    by_size = BySize(left, rank)
    for seed in order:
        if not unused[seed]:
            continue
        unused[seed] = False
        room = window - left[seed]
        out.append((number, int(seed), int(part[seed]), int(begin[seed]), int(left[seed]), 0.0))
        if room > 0:
            score = index.scores(int(seed), len(ids))
            near = np.flatnonzero(unused & (score > 0) & (left <= room))
            while room * 3 > window and len(near):
                few = near if len(near) <= NEAREST else near[np.argpartition(-score[near], NEAREST)[:NEAREST]]
                for d in few[np.lexsort((rank[few], -score[few]))]:
                    if room * 3 > window and left[d] <= room:
                        unused[d] = False
                        room -= left[d]
                        out.append((number, int(d), int(part[d]), int(begin[d]), int(left[d]), float(score[d])))
                near = near[unused[near] & (left[near] <= room) & ~np.isin(near, few)]  # as many more as needed
            while room > 0 and (last := by_size.closest(unused, score, room)):
                for d in last:
                    unused[d] = False
                    room -= left[d]
                    out.append((number, d, int(part[d]), int(begin[d]), int(left[d]), float(score[d])))
        number += 1
    return out


def weights(flat: np.ndarray, freqs: np.ndarray, bounds: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit term weights of articles, one after the other."""
    w = idf[flat] * np.log1p(freqs.astype(np.float32))
    sizes = np.diff(bounds)
    norm = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), w * w, len(sizes)))
    return (w / np.repeat(np.maximum(norm, 1e-9), sizes)).astype(np.float32)


def likeness(flat: np.ndarray, w: np.ndarray, bounds: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosines (articles × centroids)."""
    out = np.zeros((len(bounds) - 1, centroids.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    for at in range(0, len(full), 64):
        rows = full[at : at + 64]
        low, high = bounds[rows[0]], bounds[rows[-1] + 1]
        out[rows] = np.add.reduceat(centroids[flat[low:high]] * w[low:high, None], bounds[rows] - low, axis=0)
    return out


def fit_centroids(flat: np.ndarray, freqs: np.ndarray, bounds: np.ndarray, idf: np.ndarray, count: int = CENTROIDS) -> np.ndarray:
    """Centroids (terms × centroids) of the sample in the order of a chain: spherical k-means, begun at articles spread over the sample."""
    n = len(bounds) - 1
    count = max(1, min(count, n))
    w, row = weights(flat, freqs, bounds, idf), np.repeat(np.arange(n), np.diff(bounds))
    terms, flat = np.unique(flat, return_inverse=True)  # the sample has a small part of all terms
    own = np.full(n, -1)
    own[np.linspace(0, n - 1, count).astype(int)] = np.arange(count)
    for _ in range(FIT_ROUNDS):
        used = own[row] >= 0
        centroids = np.bincount(flat[used] * count + own[row][used], w[used], len(terms) * count).reshape(len(terms), count)
        centroids = (centroids / np.maximum(np.linalg.norm(centroids, axis=0), 1e-9)).astype(np.float32)
        own = likeness(flat, w, bounds, centroids).argmax(1)
    alike = centroids.T @ centroids
    chain, left = [0], set(range(1, count))
    while left:
        chain.append(max(sorted(left), key=lambda k: alike[chain[-1], k]))
        left.remove(chain[-1])
    out = np.zeros((BUCKETS, count), np.float32)
    out[terms] = centroids[:, chain]
    return out


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values one after the other, bounds) of a list column."""
    column = batch.column(batch.schema.get_field_index(name))
    bounds = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[bounds[0] : bounds[-1]], bounds - bounds[0]


def drawn_sample(vectors: DataFrame) -> pa.Table:
    """(terms, freqs, h) of the `SAMPLE` articles with the least hashes."""
    return vectors.select("terms", "freqs", F.xxhash64("doc_id", "tokens", "terms").alias("h")).orderBy("h").limit(SAMPLE).toArrow()


def placed(vectors: DataFrame, drawn: pa.Table, idf: np.ndarray, parts: int) -> DataFrame:
    """Profiles with their place in the order of topics and the part of the order they are in; parts are even by the sample."""
    spark = vectors.sparkSession
    if not drawn.num_rows:
        return vectors.select("*", F.lit(0).cast("long").alias("place"), F.lit(0).alias("part"))
    sampled = drawn.combine_chunks().to_batches()[0]
    (flat, bounds), (freqs, _) = _lists(sampled, "terms"), _lists(sampled, "freqs")
    centroids = fit_centroids(flat, freqs, bounds, idf)
    keys = np.sort(_places(flat, freqs, bounds, np.array(sampled.column("h"), np.int64), centroids, idf))
    parts = min(parts, max(1, len(keys) // 8))  # larger parts hold several shards
    cuts = keys[(np.arange(1, parts) * len(keys)) // parts]
    sent = spark.sparkContext.broadcast((centroids.astype(np.float16), idf, cuts))  # tables of fixed size
    state: dict[str, np.ndarray] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state["centroids"] = sent.value[0].astype(np.float32)
        (flat, bounds), (freqs, _) = _lists(batch, "terms"), _lists(batch, "freqs")
        place = _places(flat, freqs, bounds, np.array(batch.column(4), np.int64), state["centroids"], sent.value[1])
        part = np.searchsorted(sent.value[2], place, side="right").astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(place), pa.array(part)], names=[*batch.schema.names[:4], "place", "part"])

    return map_arrow(vectors.select("doc_id", "tokens", "terms", "freqs", F.xxhash64("doc_id", "tokens", "terms").alias("h")), one, "doc_id long, tokens int, terms array<int>, freqs array<short>, place long, part int")


def _places(flat: np.ndarray, freqs: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Places in the order of topics: the numbers of the nearest centroids, then a hash, so that no place is hot."""
    like = likeness(flat, weights(flat, freqs, bounds, idf), bounds, centroids)
    nearest = np.argsort(-like, axis=1, kind="stable")[:, :PLACES]
    place = np.zeros(len(like), np.int64)
    for k in range(nearest.shape[1]):
        place = place * CENTROIDS + nearest[:, k]
    return place << 32 | hashes & 0xFFFFFFFF


def pack(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, id_column: str = "doc_id", column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(shard, window_no, doc_id, part_no, begin, tokens, score): where each token of each article is. The profiles are written once to the shared folder and read for the statistics and for the packing."""
    spark = docs.sparkSession
    ship_vocabulary(spark, path)
    vectors = written(profiles(docs, id_column, column, path), "profiles").where("tokens > 0")
    total, counted, drawn = together(
        spark,
        lambda: vectors.agg(F.count("*").alias("n"), F.avg(F.aggregate("freqs", F.lit(0), lambda a, f: a + f)).alias("mean")).first(),
        lambda: vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow(),  # at most BUCKETS rows, whatever the corpus
        lambda: drawn_sample(vectors),
    )
    n, mean = total.n or 0, total.mean or 1.0
    df = np.zeros(BUCKETS, np.int64)
    df[np.array(counted["term"], np.int64)] = np.array(counted["count"], np.int64)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    sent = spark.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards are cut from the rows of a part as they come; none is above one and a half times the size."""
        from pyspark import TaskContext

        part, held, size, number = TaskContext.get().partitionId(), [], 0, 0

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids = table.column(0).to_pylist()

            def lists(name: str) -> list[np.ndarray]:
                flat, at = _lists(table, name)
                return [flat[a:b] for a, b in zip(at[:-1], at[1:])]

            rows = pack_shard(ids, np.array(table.column(1), np.int64), Index(lists("terms"), lists("freqs"), sent.value, mean), window)
            columns = list(zip(*rows))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float32())
            values = [columns[0], [ids[d] for d in columns[1]], *columns[2:]]
            return pa.RecordBatch.from_arrays([pa.array([part << 10 | number] * len(rows), pa.int32()), *(pa.array(v, k) for v, k in zip(values, kinds))], names=["shard", "window_no", "doc_id", "part_no", "begin", "tokens", "score"])

        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, shard + shard // 2 - size)
                held.append(batch.slice(0, take))
                size, batch = size + take, batch.slice(take)
                if size >= shard + shard // 2:
                    yield packed()
                    held, size, number = [], 0, number + 1
        if held:
            yield packed()

    parts = max(1, math.ceil(n / shard))
    ordered = placed(vectors, drawn, idf, parts).repartitionById(parts, F.col("part")).sortWithinPartitions("place")
    return ordered.select("doc_id", "tokens", "terms", "freqs").mapInArrow(run, OUT)


def oversized(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id) of articles the packing had to cut."""
    return pack(docs, window).where("part_no > 0").select("doc_id").distinct()


def usage(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(windows, tokens, used): how full the windows are."""
    per = packed.groupBy("shard", "window_no").agg(F.sum("tokens").alias("tokens"))
    return per.agg(F.count("*").alias("windows"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count("*") * window), 4).alias("used"))
