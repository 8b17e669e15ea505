"""Relations with an order: joining, ranking, first values, carried numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions.text import strip


def ordered_join(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: texts in the order of a key, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def first_useful(attempts: DataFrame, least: int = 40) -> DataFrame:
    """(req_id, rank, ident, text): the first attempt of each request that came with status 200 and enough text.

    An aggregate with partial states, not a window: a request with any number of attempts costs one row a partition.
    """
    useful = attempts.where((F.col("status") == 200) & (F.length(strip(F.coalesce("text", F.lit("")))) >= least))
    best = F.min(F.struct("rank", "attempted_at", "ident", "text")).alias("b")
    return useful.groupBy("req_id").agg(best).select("req_id", "b.rank", "b.ident", "b.text")


def latest_delivery(rows: DataFrame, key: str, at: str = "arrived_at") -> DataFrame:
    """One row a key, the one that arrived last."""
    others = [c for c in rows.columns if c not in (key, at)]
    return rows.groupBy(key).agg(F.max(F.struct(at, *others)).alias("r")).select(key, *(f"r.{c}" for c in (*others, at)))


def rank_candidates(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """(req_id, place, itemid, lang3): items of a requested decision, requested language first, then English, French, the rest; an item once.

    requests: (req_id, ecli, lang).
    """
    wanted = F.try_element_at(F.create_map(*(F.lit(v) for pair in P.ISO3.items() for v in pair)), F.upper("lang"))
    joined = requests.select("req_id", F.upper("ecli").alias("key"), wanted.alias("wanted")).join(
        candidates.where("itemid is not null and itemid != ''").select(F.upper("ecli").alias("key"), "ord", "itemid", F.upper(F.coalesce("lang3", F.lit(""))).alias("lang3")), "key"
    )
    priority = F.when(F.col("lang3") == F.col("wanted"), 0).when(F.col("lang3") == "ENG", 1).when(F.col("lang3") == "FRE", 2).otherwise(3)
    best = joined.groupBy("req_id", "itemid").agg(F.min(F.struct(priority.alias("p"), F.col("ord").alias("o"), F.col("lang3").alias("l"))).alias("b"))
    place = F.row_number().over(Window.partitionBy("req_id").orderBy("b.p", "b.o", "itemid"))
    return best.select("req_id", place.alias("place"), "itemid", F.col("b.l").alias("lang3"))


def first_notes(notes: DataFrame) -> DataFrame:
    """(doc_id, note_id, ord, text): the first text of each note of a document."""
    return notes.groupBy("doc_id", "note_id").agg(F.min(F.struct("ord", "text")).alias("n")).select("doc_id", "note_id", "n.ord", "n.text")


def footnote_section(notes: DataFrame) -> DataFrame:
    """(doc_id, section): notes of a document as definitions in the order of their first occurrence."""
    line = F.concat(F.lit("[^"), F.col("note_id"), F.lit("]: "), F.col("text"))
    return first_notes(notes).groupBy("doc_id").agg(ordered_join(F.col("ord"), line, "\n").alias("section"))


def multipart(parts: DataFrame) -> DataFrame:
    """(req_id, parts, failed, markdown): parts that came, in order, between rules; null if none came."""
    ok = (F.col("status") == 200) & F.col("text").isNotNull()
    return parts.groupBy("req_id").agg(
        F.count_if(ok).alias("parts"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"), F.nullif(ordered_join(F.when(ok, F.col("rank")), F.when(ok, F.col("text")), "\n\n---\n\n"), F.lit("")).alias("markdown")
    )


def carry_numbers(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, text): each paragraph with the number cell right before it (the last of several), numbers without paragraph alone.

    nodes: (doc_id, ord, kind `nr` or `para`, text).
    """
    by = Window.partitionBy("doc_id").orderBy("ord")
    seen = nodes.select("*", F.lag("kind").over(by).alias("kind_before"), F.lag("text").over(by).alias("text_before"), F.lead("kind").over(by).alias("kind_after"))
    number = F.when((F.col("kind_before") == "nr") & (strip("text_before") != ""), F.concat(strip(F.col("text_before")), F.lit(" "))).otherwise("")
    paragraph = seen.where("kind = 'para'").select("doc_id", "ord", strip(F.concat(number, F.coalesce("text", F.lit("")))).alias("text"))
    alone = seen.where("kind = 'nr' and kind_after is null").select("doc_id", "ord", strip(F.col("text")).alias("text"))
    return paragraph.unionByName(alone).where("text != ''")


def pair_siblings(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, text): `N. text` for a number directly before a paragraph, other paragraphs as they are."""
    by = Window.partitionBy("doc_id").orderBy("ord")
    seen = nodes.select("*", F.lag("kind").over(by).alias("k"), F.lag("text").over(by).alias("n"))
    return seen.where("kind = 'para'").select("doc_id", "ord", F.when((F.col("k") == "nr") & (F.col("n") != ""), F.concat(F.col("n"), F.lit(". "), F.col("text"))).otherwise(F.col("text")).alias("text"))


def tally(results: DataFrame, ok: str = "ok", error: str = "error", order: str = "req_id") -> DataFrame:
    """(done, succeeded, failed, errors): one row; errors counted by kind, so no list grows with the batch."""
    by_kind = results.groupBy(ok, error).agg(F.count("*").alias("n"))
    return by_kind.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("done"),
        F.coalesce(F.sum(F.when(F.col(ok), F.col("n"))), F.lit(0)).alias("succeeded"),
        F.coalesce(F.sum(F.when(~F.col(ok), F.col("n"))), F.lit(0)).alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col(ok), F.concat_ws(": ", error, F.col("n").cast("string"))))), ", ").alias("errors"),
    )
