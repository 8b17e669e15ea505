"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import canon, langid, leak, mojibake, ocr, pack, pii, split, tokens
from leafmill.session import spread
from leafmill.session import table as read

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; those with whole texts use all cores."""
    df = read(spark, d, name)
    return spread(df) if name in ("documents", "md_documents") else df


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of documents that their label does not name."""
    return langid.unnamed(table(spark, d, "md_documents"))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of documents and their segments."""
    return langid.identify(table(spark, d, "md_documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Defects of scanned pages."""
    return ocr.defects(table(spark, d, "md_documents"))


def p2_repair(spark: SparkSession, d: str) -> DataFrame:
    """Documents without scan noise."""
    return ocr.repair(table(spark, d, "md_documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents above the limit of their profile."""
    return split.oversize(table(spark, d, "md_documents"), table(spark, d, "profiles"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all documents."""
    return split.split_documents(table(spark, d, "md_documents"), table(spark, d, "profiles"))


def p4_budget(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every source, language and domain."""
    return tokens.budget(table(spark, d, "md_documents"), table(spark, d, "documents"))


def p4_slices(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by source, by language and by domain."""
    return tokens.slices(table(spark, d, "md_documents"), table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with garbled or lost characters."""
    return mojibake.garbled(table(spark, d, "md_documents"))


def p5_repair(spark: SparkSession, d: str) -> DataFrame:
    """Repaired text of all documents."""
    return mojibake.repair(table(spark, d, "md_documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same."""
    return canon.same_looking(table(spark, d, "md_documents"))


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The canonical and the readable form of all documents."""
    return canon.canonicalize(table(spark, d, "md_documents").select("doc_id", "markdown")).select("doc_id", "canonical", "readable")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of documents that look the same."""
    return canon.classes(table(spark, d, "md_documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles larger than a window."""
    return pack.oversized(table(spark, d, "documents"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """The window of each article."""
    return pack.pack(table(spark, d, "documents"))


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    """How full the windows are."""
    return pack.usage(pack.pack(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles and the evaluation items that leaked into them."""
    return leak.matches(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    """The longest verbatim match of each article and item."""
    return leak.matches(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Articles no item leaked into."""
    return leak.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal data by article, type and value."""
    return pii.found(table(spark, d, "documents"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Articles with placeholders."""
    return pii.detect(table(spark, d, "documents")).select("doc_id", "redacted", "mentions")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_segments, p2_found, p2_repair, p3_found, p3_pieces, p4_budget, p4_slices, p5_found, p5_repair, p6_found, p6_classes, p6_canonical, p7_found, p7_pack, p7_usage, p8_found, p8_matches, p8_clean, p9_found, p9_redacted)}



def _look_sql(x: str) -> str:
    """The canonical form of problem 6 in SQL, with the replacements of its table: single characters by one translation, others one by one."""
    table = canon.tables()
    one, none, more = [], [], []
    for cp in np.flatnonzero(table["start"][1] >= 0).tolist():
        at, size = int(table["start"][1][cp]), int(table["length"][1][cp])
        form = "".join(map(chr, table["data"][at : at + size].tolist()))
        if size == 1:
            one.append((chr(cp), form))
        elif size == 0:
            none.append(chr(cp))
        elif cp < 0x2200 or 0xFB00 <= cp < 0xFB07:  # ligatures, digraphs and Roman numerals
            more.append((chr(cp), form))
    for a, b in more:
        x = f"replace({x}, '{a}', '{b}')"
    plain = "".join(b for _, b in one).replace("'", "''")
    return f"nfc_normalize(translate({x}, '{''.join(a for a, _ in one)}{''.join(none)}', '{plain}'))"


#: Words of an article or item in SQL: runs of letters or digits, commands skipped.
_WORDS_SQL = r"list_filter(regexp_extract_all(lower({x}), '\\\\(?:[a-z]+\*?|(?s:.))|[\p{{L}}\p{{N}}]+'), lambda w: w[1] <> '\\')"

_LOOKS_SQL = f"""c as (select doc_id, markdown, {_look_sql('markdown')} as look from md_documents where markdown is not null and doc_id is not null),
        v as (select * from c where length(regexp_replace(look, '[\\x00-\\x20\\x7f\\x{{80}}-\\x{{9f}}\\x{{2028}}\\x{{2029}}]', '', 'g')) >= 20)"""
_LEAKS_SQL = f"""d as (select doc_id as id, {_WORDS_SQL.format(x='text')} as w from documents where text is not null), i as (select item_id as id, {_WORDS_SQL.format(x='text')} as w from eval_items where text is not null),
        dg as (select id, array_to_string(w[k : k + 11], ' ') as g from d, lateral (select unnest(range(1, len(w) - 10)) as k) where len(w) >= 12),
        ig as (select distinct id, array_to_string(w[k : k + 11], ' ') as g from i, lateral (select unnest(range(1, len(w) - 10)) as k) where len(w) >= 12),
        leaks as (select distinct dg.id as doc_id, ig.id as item_id from dg join ig on dg.g = ig.g)"""

SQL: dict[str, str] = {
    "p6_found": f"""
        with {_LOOKS_SQL}
        select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from v a join v b on a.look = b.look where a.doc_id < b.doc_id and a.markdown <> b.markdown""",
    "p6_classes": f"""
        with {_LOOKS_SQL}, t as (select distinct doc_id, look, markdown from v), g as (select look, min(doc_id) as class_id, count(*) as members from t group by look having count(distinct markdown) > 1),
        e as (select look, markdown, count(*) as copies from t group by look, markdown)
        select t.doc_id, g.class_id, g.members, g.members - e.copies as links from t join g on g.look = t.look join e on e.look = t.look and e.markdown = t.markdown""",
    "p8_found": f"with {_LEAKS_SQL} select doc_id, item_id from leaks",
    "p8_clean": f"with {_LEAKS_SQL} select a.* from documents a where not exists (select 1 from leaks l where l.doc_id = a.doc_id)",
    "p3_found": """
        with d as (
            select d.doc_id, d.markdown as t, p.chunk_chars as most
            from md_documents d join (select kind, min(chunk_chars) as chunk_chars from profiles where kind is not null group by kind) p on p.kind = d.kind
            where length(d.markdown) > p.chunk_chars)
        select distinct doc_id, case
            when list_max(list_transform(string_split(t, chr(10) || chr(10)), lambda x: length(x))) <= most then 'paragraph'
            when list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) <= most then 'line'
            when list_max(list_transform(string_split(replace(t, chr(10), ' '), ' '), lambda x: length(x))) <= most then 'word'
            else 'none' end as boundary
        from d""",
}
