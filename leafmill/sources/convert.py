"""From requests and files to documents: landed responses, format detection, parsers in Arrow batches, errors as columns."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import route as R
from leafmill.functions.text import filename_from_url, strip, tidy
from leafmill.operators.assemble import ordered_join
from leafmill.operators.reflow import reflow

#: Least characters of a useful document, and most bytes of a remote file (fixed values).
USEFUL, REMOTE_BYTES = 40, 40 * 1024 * 1024
RESULT = "markdown string, engine string, canonical string, error string, detail string"
#: What a parser returns: Markdown, or Markdown and the number the document itself gives.
Parser = Callable[[str, str | None], str | tuple[str, str | None]]


def _parsers() -> dict[str, tuple[str, bool, Callable]]:
    """format → (engine, whether it reads bytes, parser)."""
    from leafmill.sources import office, render

    def act_or_text(content: str, ref: str | None) -> str:
        """A file that looked like a structured act; a page where the act gives too little."""
        text = render.act_xml(content)
        return text if len(text.strip()) >= USEFUL else render.html_to_markdown(content)

    text = {
        "html": ("HTML", lambda c, ref: render.html_to_markdown(c)),
        "act": ("Formex XML", lambda c, ref: render.act_xml(c)),
        "file_act": ("Formex XML", act_or_text),
        "ruling": ("Rechtspraak.nl", lambda c, ref: render.ruling_xml(c, ref or "")),
        "statute": ("wetten.overheid.nl", render.statute_html),
        "german_xml": ("rechtsprechung-im-internet.de", lambda c, ref: render.german_xml(c)),
        "german_json": ("OpenLegalData", lambda c, ref: render.german_case(c)),
        "belgian": ("Juportal", lambda c, ref: render.belgian_html(c)),
        "council": ("Conseil constitutionnel", lambda c, ref: render.council_html(c)),
        "cassation": ("Judilibre", lambda c, ref: render.cassation_case(c)),
        "csv": ("Data", office.delimited),
        "json": ("Data", office.json_data),
        "text": ("Text", lambda c, ref: render.tidy(c)),
        "wrapped_text": ("Text", lambda c, ref: render.tidy(c)),
    }
    binary = {
        "german_zip": ("rechtsprechung-im-internet.de", lambda c, ref: render.german_xml(office.zipped_xml(c))),
        "docx": ("Office", office.word),
        "pptx": ("Office", office.slides),
        "xlsx": ("Office", office.sheets),
        "epub": ("Office", office.book),
    }
    return {k: (e, False, f) for k, (e, f) in text.items()} | {k: (e, True, f) for k, (e, f) in binary.items()}


EXTRA: dict[str, tuple[str, bool, Callable]] = {}


def register_parser(name: str, engine: str, parser: Parser, binary: bool = False) -> None:
    """A further format: its name, the engine's label, and a function of content and reference. For PDF, hand in a library here."""
    EXTRA[name] = (engine, binary, parser)


def convert(df: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """keys + (markdown, engine, canonical, error, detail) from columns (format, content BINARY, ref).

    A document that cannot be converted gets an error code (no_content, unknown_format, not_found, malformed, too_short)
    and no Markdown; it never fails the job, and `detail` names the exception. State lives within one call of a parser.
    """
    extra = dict(EXTRA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmill.sources.markup import decoded

        known = _parsers() | extra

        def one(format_: str, content: bytes | None, ref: str | None) -> tuple:
            if not content or not content.strip():
                return None, None, None, "no_content", None
            if format_ not in known:
                return None, None, None, "unknown_format", None
            engine, binary, parser = known[format_]
            try:
                made = parser(content if binary else decoded(content), ref)
            except LookupError as e:
                return None, engine, None, "not_found", type(e).__name__
            except Exception as e:  # a broken document must not fail the others
                return None, engine, None, "malformed", type(e).__name__
            text, canonical = made if isinstance(made, tuple) else (made, None)
            return (text, engine, canonical, None, None) if len(text.strip()) >= least else (None, engine, canonical, "too_short", None)

        for batch in batches:
            out = [one(*row) for row in zip(*(batch.column(len(keys) + i).to_pylist() for i in range(3)))]
            columns = [batch.column(i) for i in range(len(keys))] + [pa.array(c, pa.string()) for c in (zip(*out) if out else [()] * 5)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "markdown", "engine", "canonical", "error", "detail"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, "format", F.col("content").cast("binary").alias("content"), "ref").mapInArrow(run, f"{fields}, {RESULT}")


def format_of(filename: Column, content: Column) -> Column:
    """Format of a file from its extension and its first bytes."""
    ext = F.lower(F.regexp_extract(filename, r"(\.[^.]+)$", 1))
    return (
        F.when((ext == ".xml") & R.looks_like_structured_xml(content), "file_act")
        .when(ext.isin(".html", ".htm", ".xml"), "html")
        .when(ext == ".txt", "wrapped_text")
        .when(ext == ".md", "text")
        .when(ext.isin(".csv", ".json", ".docx", ".pptx", ".xlsx", ".epub"), F.substring(ext, 2, 9))
        .otherwise(F.concat(F.lit("file"), ext))
    )


def read_files(spark: SparkSession, path: str, glob: str = "*", streaming: bool = False) -> DataFrame:
    """(path, filename, format, content, ref) of files in a folder, whole or as they arrive."""
    reader = (spark.readStream if streaming else spark.read).format("binaryFile").option("pathGlobFilter", glob)
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    name = F.substring_index("path", "/", -1)
    return reader.load(path).select("path", name.alias("filename"), format_of(name, F.col("content")).alias("format"), "content", F.lit(None).cast("string").alias("ref"))


def file_documents(files: DataFrame) -> DataFrame:
    """(path, markdown, source, kind, error) of files as `read_files` gives them. Plain text has its soft line breaks joined."""
    done = convert(files, ["path", "filename", "format"])
    text = F.when(F.col("format") == "wrapped_text", tidy(reflow(F.col("markdown")))).otherwise(F.col("markdown"))
    undeclared = F.when((F.col("error") == "unknown_format") & ~R.is_declared_format(F.col("filename")), "undeclared_format").otherwise(F.col("error"))
    return done.select("path", text.alias("markdown"), F.concat_ws(" • ", "engine", "filename").alias("source"), F.lit("document").alias("kind"), undeclared.alias("error"))


def relabelled(source: Column, label: Column) -> Column:
    """A document's label with another text behind its engine."""
    return F.concat(R.engine_of(source), F.lit(" • "), label)


def remote_files(responses: DataFrame, most: int = REMOTE_BYTES) -> DataFrame:
    """(url, markdown, source, kind, error) of files behind links, from landed responses (url, status, content_type, content)."""
    name = filename_from_url(F.col("url"), F.col("content_type"))
    refused = (
        F.when(~R.is_web_url(F.col("url")), "not_a_web_address")
        .when(F.col("status") != 200, F.concat(F.lit("status_"), F.col("status").cast("string")))
        .when(F.coalesce(F.length("content"), F.lit(0)) == 0, "no_content")
        .when(F.length("content") > most, "too_large")
    )
    rows = responses.select(F.col("url").alias("path"), name.alias("filename"), F.col("content").cast("binary").alias("content"), refused.alias("refused"))
    kept = rows.where("refused is null").select("path", "filename", format_of(F.col("filename"), F.col("content")).alias("format"), "content", F.lit(None).cast("string").alias("ref"))
    done = file_documents(kept).select(F.col("path").alias("url"), "markdown", relabelled(F.col("source"), F.col("path")).alias("source"), "kind", "error")
    none = F.lit(None).cast("string")
    return done.unionByName(rows.where("refused is not null").select(F.col("path").alias("url"), none.alias("markdown"), none.alias("source"), F.lit("document").alias("kind"), F.col("refused").alias("error")))


def route_requests(requests: DataFrame) -> DataFrame:
    """Requests with their source, language and address; blank queries get an error."""
    query = strip(F.coalesce("query", F.lit("")))
    stripped = requests.select("req_id", query.alias("query"), F.upper(F.coalesce(F.nullif(strip("lang"), F.lit("")), F.lit("NL"))).alias("lang"))
    found = stripped.select("*", R.route(F.col("query")).alias("found"))
    return found.select(
        "req_id",
        "query",
        "lang",
        F.when(F.col("query") != "", F.coalesce("found", F.lit("eurlex"))).alias("source"),
        F.when(F.col("query") != "", R.source_url(F.col("query"), F.col("lang"), F.col("found"))).alias("url"),
        F.when(F.col("query") == "", "missing_query").alias("error"),
    )


def acquire(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with the response of their address, from a table of landed responses (url, status, content)."""
    joined = requests.join(responses.select("url", "status", F.col("content").cast("binary").alias("content")), "url", "left")
    return joined.withColumn("error", F.coalesce("error", F.when(F.col("status").isNull(), "no_response").when(F.col("status") != 200, F.concat(F.lit("status_"), F.col("status").cast("string")))))


class Token:
    """An access token, asked for again shortly before it expires. ask() gives the token and its seconds of life."""

    def __init__(self, ask: Callable[[], tuple[str, float]], margin: float = 120, clock: Callable[[], float] = time.monotonic):
        self.ask, self.margin, self.clock = ask, margin, clock
        self.value, self.until = "", 0.0

    def get(self) -> str:
        if not self.value or self.clock() >= self.until:
            self.value, life = self.ask()
            self.until = self.clock() + life - self.margin
        return self.value

    def headers(self, key: str) -> dict[str, str]:
        """Headers of a request that names its client as well."""
        return {"Authorization": f"Bearer {self.get()}", "KeyId": key}


#: Statuses after which a request is made again, how often, and the first pause in seconds, doubled each time (fixed values).
RETRIED, RETRIES, PAUSE = frozenset((500, 502, 503, 504)), 2, 0.4


def fetch(requests: DataFrame, connector: Callable[[], Callable[[str], tuple[int, bytes]]], partitions: int = 8, retries: int = RETRIES, pause: float = PAUSE) -> DataFrame:
    """(url, status, content, tries): responses fetched by a connector made once a partition; `partitions` bounds the connections.

    Server errors and broken connections (status 0) are tried again. Write the result to a table and use `acquire`: a
    repeated task then fetches, but the pipeline behind it reads once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = connector()

        def one(url: str) -> tuple[str, int, bytes, int]:
            for turn in range(retries + 1):
                try:
                    status, content = get(url)
                except Exception:
                    status, content = 0, b""
                if status and status not in RETRIED or turn == retries:
                    break
                time.sleep(pause * 2**turn)
            return url, status, content, turn + 1

        for batch in batches:
            rows = [one(url) for url in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int32(), pa.binary(), pa.int32()))], names=["url", "status", "content", "tries"])

    return requests.where("url is not null").select("url").distinct().repartition(partitions).mapInArrow(run, "url string, status int, content binary, tries int")


#: Where parts of a document lie: any place below the archive's own, with a part number at the end.
PART_ADDRESS = "https?://" + re.escape("publications.europa.eu/resource/cellar/") + '[^"]+/DOC_[0-9]+'


def part_links(choices: Column) -> Column:
    """Links of the parts on a page of choices, in their order."""
    return F.regexp_extract_all(choices, F.lit(rf'href="({PART_ADDRESS})"'), F.lit(1))


def joined_parts(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """(req_id, markdown): parts of a page of choices, those that came, in order, between rules.

    pages: (req_id, html); responses: (url, status, markdown).
    """
    links = pages.select("req_id", F.posexplode(part_links(F.col("html"))).alias("part", "url"))
    came = links.join(responses.where("status = 200"), "url")
    return came.groupBy("req_id").agg(ordered_join(F.col("part"), F.col("markdown"), "\n\n---\n\n").alias("markdown"))
