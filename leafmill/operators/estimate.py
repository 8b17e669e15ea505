"""Tokens and cost of cleaning, models, prices and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import strip
from leafmill.operators.chunk import chunks_for

#: Characters a token stands for, and tokens around each prompt (fixed values).
CHARS_PER_TOKEN, OVERHEAD = 4, 20


def estimate(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, profile, chunks, input_tokens, output_tokens) of each document under the profile of its kind.

    documents: (doc_id, markdown, kind); profiles as the table of that name. Chunks stay an array in the row.
    """
    joined = documents.join(profiles.where("kind is not null"), "kind")
    parts = chunks_for(F.col("markdown"), F.col("chunk_chars"), F.col("no_chunk"))
    sized = joined.where("markdown is not null").select(
        "doc_id", "profile", "output_ratio", "prompt_chars", F.transform(parts, F.length).alias("sizes")
    )
    content = F.floor(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x) / CHARS_PER_TOKEN)
    count = F.size("sizes").cast("long")
    system = F.floor(F.col("prompt_chars") / CHARS_PER_TOKEN)
    return sized.select(
        "doc_id",
        "profile",
        count.alias("chunks"),
        (content + (system + OVERHEAD) * count).cast("long").alias("input_tokens"),
        F.floor(content * F.col("output_ratio")).cast("long").alias("output_tokens"),
    )


def model_prices(models: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(model, prompt, completion): first entry of the catalogue with the model's id, or the id without its suffix.

    models: (model); catalogue: (ord, id, prompt, completion) with prices as text; null or empty is 0, other text no price.
    """
    keys = models.select("model", F.explode(F.array_distinct(F.array("model", F.split_part("model", F.lit(":"), F.lit(1))))).alias("id"))
    first = keys.join(catalogue, "id").groupBy("model").agg(F.min(F.struct("ord", "prompt", "completion")).alias("e"))
    price = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(0.0)).otherwise(c.try_cast("double"))
    priced = first.select("model", price(F.col("e.prompt")).alias("prompt"), price(F.col("e.completion")).alias("completion"))
    both = F.col("prompt").isNotNull() & F.col("completion").isNotNull()
    return models.join(priced, "model", "left").select("model", F.when(both, F.col("prompt")).alias("prompt"), F.when(both, F.col("completion")).alias("completion"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, prompt, completion) of a price catalogue: a JSON object with a list `data`, in one file."""
    text = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", "data array<struct<id:string,pricing:struct<prompt:string,completion:string>>>")["data"]
    return text.select(F.posexplode(rows).alias("ord", "e")).select("ord", "e.id", "e.pricing.prompt", "e.pricing.completion")


def profile_for(kind: Column) -> Column:
    """The profile proposed for a document of a kind."""
    return F.when(kind == "caselaw", "caselaw").otherwise("generic")


def shown_number(n: Column) -> Column:
    """A whole number with points between thousands, as the interface shows it."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit("."))


def with_cost(estimates: DataFrame, prices: DataFrame, available: bool = True) -> DataFrame:
    """Estimates (with a model column) and their cost; null where no price is known or no access is set up."""
    cost = F.col("input_tokens") * F.col("prompt") + F.col("output_tokens") * F.col("completion")
    return estimates.join(prices, "model", "left").withColumn("cost", cost if available else F.lit(None).cast("double"))


def valid_models(rows: Column) -> Column:
    """Rows of a settings list with an id, both fields stripped."""
    trimmed = F.transform(rows, lambda m: F.struct(strip(F.coalesce(m["id"], F.lit(""))).alias("id"), strip(F.coalesce(m["label"], F.lit(""))).alias("label")))
    return F.filter(trimmed, lambda m: m["id"] != "")


def resolve_model(wanted: Column, known: Column, fallback: str) -> Column:
    """A wanted model if it is one of the known ids, else the fallback."""
    return F.when(F.array_contains(known, wanted), wanted).otherwise(F.lit(fallback))


def overlay(default: Column, stored: Column) -> Column:
    """A stored text unless it is blank."""
    return F.when(strip(F.coalesce(stored, F.lit(""))) != "", stored).otherwise(default)
