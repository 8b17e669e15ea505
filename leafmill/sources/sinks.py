"""Documents out: JSON lines, one file a document, a text stream with errors in it, and settings."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import sanitize_filename

#: What goes before an error in a stream of text (fixed value).
STREAM_ERROR = "\x00CLEAN_ERROR\x00"


def document_json(markdown: Column, source: Column, kind: Column, error: Column) -> Column:
    """A document as a JSON object, or an object with its error."""
    return F.when(error.isNotNull(), F.to_json(F.struct(error.alias("error")))).otherwise(F.to_json(F.struct(markdown.alias("markdown"), source.alias("source"), kind.alias("kind")), {"ignoreNullFields": "false"}))


def write_json(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, in as many files as there are partitions."""
    row = document_json(*(F.col(c) for c in ("markdown", "source", "kind", "error")))
    documents.select(row.alias("value")).write.mode(mode).text(path)


def downloads(documents: DataFrame) -> DataFrame:
    """(name, content): a safe file name and the bytes of each document, from columns (filename, markdown)."""
    return documents.select(sanitize_filename(F.col("filename")).alias("name"), F.encode(F.coalesce("markdown", F.lit("")), "UTF-8").alias("content"))


def write_files(files: DataFrame, path: str) -> DataFrame:
    """(name, bytes) of the files written below a folder all executors share.

    Each is written beside its place and moved there, so a lost task leaves no half file and a repeated one changes
    nothing. Files of one name overwrite each other; make names distinct first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))
        system.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                beside = f"{root}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as out:
                    out.write(content)
                system.move(beside, f"{root}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return files.select("name", "content").mapInArrow(run, "name string, bytes long")


def streamed_text(pieces: DataFrame) -> DataFrame:
    """(doc_id, out_no, text) of cleaned chunks (doc_id, chunk_no, cleaned, error): blank lines between chunks, and an error in the place where it ended the stream.

    Chunks behind the first failed one are not given out, as a reader of the stream has gone by then.
    """
    failed = pieces.groupBy("doc_id").agg(F.min(F.when(F.col("error").isNotNull(), F.col("chunk_no"))).alias("end"))
    shown = pieces.join(failed, "doc_id").where("end is null or chunk_no <= end")
    between = F.when(F.col("chunk_no") > 0, "\n\n").otherwise("")
    return shown.select("doc_id", F.col("chunk_no").alias("out_no"), F.when(F.col("error").isNotNull(), F.concat(F.lit(STREAM_ERROR), F.col("error"))).otherwise(F.concat(between, F.coalesce("cleaned", F.lit("")))).alias("text"))


class Settings:
    """A small JSON file of settings on the driver: read again only when it changed, replaced as a whole."""

    def __init__(self, path: str):
        self.path = path
        self._seen: tuple[int, int] | None = None
        self._held: dict = {}

    def fingerprint(self) -> tuple[int, int] | None:
        """Time and size of the file; none if there is no file."""
        try:
            found = os.stat(self.path)
        except OSError:
            return None
        return found.st_mtime_ns, found.st_size

    def read(self) -> dict:
        """The settings, a copy; empty if the file is missing, broken, or no object."""
        now = self.fingerprint()
        if now is None:
            self._seen, self._held = None, {}
        elif now != self._seen:
            try:
                with open(self.path, encoding="utf-8") as file:
                    value = json.load(file)
            except (OSError, ValueError):
                value = {}
            self._seen, self._held = now, value if isinstance(value, dict) else {}
        return dict(self._held)

    def write(self, value: dict) -> None:
        """Replaces the file; a reader sees the old or the new one."""
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        beside = f"{self.path}.{uuid.uuid4().hex}"
        with open(beside, "w", encoding="utf-8") as file:
            json.dump(value, file, ensure_ascii=False, indent=1)
        os.replace(beside, self.path)

    def change(self, by: Callable[[dict], None]) -> dict:
        """Reads, changes and writes."""
        value = self.read()
        by(value)
        self.write(value)
        return value
