"""Cleaning of documents by an external model: chunks out, cleaned chunks back, in order."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import strip
from leafmill.operators.assemble import ordered_join
from leafmill.operators.chunk import chunks_for

#: (chunk, profile) → cleaned text; raise for an error. Made once a partition.
Cleaner = Callable[[str, str], str]


class CleaningError(Exception):
    """A failed call: missing_key, rejected_key, connection, status_N, unexpected_answer, truncated, empty_answer."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(detail or code)
        self.code = code


#: Most tokens of an answer (fixed value).
MOST_TOKENS = 64_000
#: What a model is told by profile, and how a chunk is handed over; settings can replace both.
SYSTEM = {
    "generic": "You tidy converted Markdown. Mend broken lines and lists, keep every word, every number and their order, and answer with the Markdown alone.",
    "caselaw": "You tidy a converted court decision. Keep every word. Headings (##) are for titles of sections only: never turn a numbered paragraph into a heading. Answer with the Markdown alone.",
    "obsidian": "You turn a document into one complete note with front matter and links between its parts. Keep every word of the text. Answer with a single markdown code block.",
}
USER = "Tidy this part of a document:\n\n{chunk}"


def completion_request(chunk: str, profile: str, model: str, system: str | None = None, user: str = USER, stream: bool = False) -> dict:
    """The body of a request for a completion."""
    body = {"model": model, "temperature": 0, "max_tokens": MOST_TOKENS, "messages": [{"role": "system", "content": system or SYSTEM.get(profile, SYSTEM["generic"])}, {"role": "user", "content": user.replace("{chunk}", chunk)}]}
    return {**body, "stream": True} if stream else body


def completion_text(status: int, body: str, profile: str) -> str:
    """The text of an answer; a CleaningError for any other outcome, so no cut-off text passes for a whole one."""
    if status == 401:
        raise CleaningError("rejected_key")
    if status != 200:
        raise CleaningError(f"status_{status}", body[:200])
    try:
        choice = json.loads(body)["choices"][0]
        text = (choice["message"]["content"] or "").strip()
    except (ValueError, KeyError, IndexError, TypeError) as e:
        raise CleaningError("unexpected_answer", body[:200]) from e
    if choice.get("finish_reason") == "length":
        raise CleaningError("truncated", "choose another profile" if profile == "obsidian" else "choose smaller chunks")
    return unfenced(text) if profile == "obsidian" else text


def unfenced(text: str) -> str:
    """The inside of a text that is one code block."""
    lines = text.strip().split("\n")
    if len(lines) > 2 and lines[0].rstrip() in ("```", "```markdown") and lines[-1].rstrip() == "```":
        return "\n".join(lines[1:-1]).strip()
    return text


def streamed_pieces(lines: Iterable[str]) -> Iterator[str]:
    """Texts of event lines as they come; a CleaningError where the answer was cut off, or if there was no text."""
    given = False
    for line in lines:
        if not line.startswith("data:"):
            continue
        body = line[5:].strip()
        if body == "[DONE]":
            break
        try:
            choice = (json.loads(body).get("choices") or [{}])[0]
        except ValueError:
            continue
        if piece := (choice.get("delta") or {}).get("content"):
            given = True
            yield piece
        if choice.get("finish_reason") == "length":
            raise CleaningError("truncated")
    if not given:
        raise CleaningError("empty_answer")


def streamed_document(chunks: Iterable[str], ask: Callable[[str], Iterable[str]], fenced: bool = False) -> Iterator[str]:
    """Texts of a document's chunks one after the other, blank lines between; ask gives the event lines of a chunk."""
    from leafmill.streaming.fence import strip_stream

    for n, chunk in enumerate(chunks):
        if n:
            yield "\n\n"
        pieces = streamed_pieces(ask(chunk))
        yield from strip_stream(pieces) if fenced else pieces


def model_cleaner(post: Callable[[dict, dict], tuple[int, str]], model: str, key: str | None, system: dict[str, str] | None = None) -> Callable[[], Cleaner]:
    """A cleaner that asks a model. post(headers, body) makes the call and returns status and text; it is not repeated here, as a call costs money."""

    def make() -> Cleaner:
        def one(chunk: str, profile: str) -> str:
            if not key:
                raise CleaningError("missing_key")
            try:
                status, text = post({"Authorization": f"Bearer {key}", "Content-Type": "application/json"}, completion_request(chunk, profile, model, (system or {}).get(profile)))
            except OSError as e:
                raise CleaningError("connection", str(e)) from e
            return completion_text(status, text, profile)

        return one

    return make


def collapse_cleaner() -> Cleaner:
    """A cleaner without a model, for tests: runs of blanks become one."""
    import re

    return lambda chunk, profile: re.sub(" {2,}", " ", chunk)


def chunk_table(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, profile, chunk_no, chunk, key); the key names the work, so results can be kept and reused after a lost task.

    A blank document has one row without a chunk.
    """
    joined = documents.where("markdown is not null").join(profiles.where("kind is not null"), "kind")
    parts = joined.select("doc_id", "profile", F.posexplode_outer(chunks_for(F.col("markdown"), F.col("chunk_chars"), F.col("no_chunk"))).alias("chunk_no", "chunk"))
    return parts.withColumn("key", F.sha2(F.concat_ws("\x1f", "profile", "chunk"), 256))


def clean_chunks(chunks: DataFrame, make: Callable[[], Cleaner], partitions: int | None = None, kept: DataFrame | None = None, once: bool = False) -> DataFrame:
    """(doc_id, chunk_no, key, cleaned, error) of all chunks. `partitions` bounds the calls at a time.

    With `once`, or with kept results, equal chunks under one profile are sent once. kept: (key, cleaned) of earlier
    runs; what it has is not sent again, so write the result of each run and hand it in after a failure. Otherwise
    chunks are sent where they are, without a shuffle.
    """

    def cleaned_by(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cleaner = make()
            for batch in batches:
                cleaned: list[str | None] = []
                errors: list[str | None] = []
                for chunk, profile in zip(batch.column("chunk").to_pylist(), batch.column("profile").to_pylist()):
                    text = error = None
                    try:
                        if chunk is None:
                            raise CleaningError("nothing_to_clean")
                        text = cleaner(chunk, profile)
                    except Exception as e:
                        error = e.code if isinstance(e, CleaningError) else type(e).__name__
                    cleaned.append(text)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(cleaned, pa.string()), pa.array(errors, pa.string())], names=[*names, "cleaned", "error"])

        return run

    spread = lambda df: df.repartition(partitions) if partitions else df
    if kept is None and not once:
        return spread(chunks.select("doc_id", "chunk_no", "key", "profile", "chunk")).mapInArrow(cleaned_by(["doc_id", "chunk_no", "key"]), "doc_id long, chunk_no int, key string, cleaned string, error string")
    work = chunks.where("chunk is not null").groupBy("key").agg(F.first("profile").alias("profile"), F.first("chunk").alias("chunk"))
    if kept is not None:
        work = work.join(kept.where("cleaned is not null").select("key"), "key", "left_anti")
    done = spread(work).select("key", "profile", "chunk").mapInArrow(cleaned_by(["key"]), "key string, cleaned string, error string")
    if kept is not None:
        done = done.unionByName(kept.where("cleaned is not null").select("key", "cleaned", F.lit(None).cast("string").alias("error")).dropDuplicates(["key"]))
    rows = chunks.select("doc_id", "chunk_no", "key", F.col("chunk").isNull().alias("blank")).join(done, "key", "left")
    return rows.select("doc_id", "chunk_no", "key", "cleaned", F.when(F.col("blank"), "nothing_to_clean").otherwise(F.col("error")).alias("error"))


def reassemble(cleaned: DataFrame) -> DataFrame:
    """(doc_id, markdown, error): chunks in order, empty ones dropped; one failed chunk fails its document."""
    text = ordered_join(F.when(F.col("cleaned") != "", F.col("chunk_no")), F.when(F.col("cleaned") != "", F.col("cleaned")), "\n\n")
    whole = cleaned.groupBy("doc_id").agg(F.concat(strip(text), F.lit("\n")).alias("markdown"), F.min("error").alias("error"))
    return whole.select("doc_id", F.when(F.col("error").isNull(), F.col("markdown")).alias("markdown"), "error")


def clean(documents: DataFrame, profiles: DataFrame, make: Callable[[], Cleaner] = collapse_cleaner) -> DataFrame:
    return reassemble(clean_chunks(chunk_table(documents, profiles), make))
