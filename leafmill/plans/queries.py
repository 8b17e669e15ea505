"""Queries of the operators over the project's tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions import route as R
from leafmill.functions import text as T
from leafmill.operators import assemble, chunk, clean, estimate, reflow
from leafmill.session import spread, written
from leafmill.session import table as read
from leafmill.sources import acquire, convert
from leafmill.streaming import fence

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Limit of the chunk queries, small enough to descend the whole ladder.
SMALL = 300


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; those with whole texts use all cores."""
    df = read(spark, d, name)
    return spread(df) if name in ("documents", "md_documents") else df


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL building blocks


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{P.WS}+|{P.WS}+$')}, '', 'g')"


def s_has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q('(?i)' + pattern)})"


def s_first(x: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({x}, {q('(?i)' + pattern)}, {group}), '')"


def s_tidy(x: str) -> str:
    lines = f"regexp_replace({x}, {q(P.WS_IN_LINE + r'+(\n|$)')}, '\\1', 'g')"
    return f"{s_strip(f"regexp_replace({lines}, {q(r'\n{4,}')}, chr(10) || chr(10) || chr(10), 'g')")} || chr(10)"


def s_case(x: str, pairs: dict[str, str], default: str = "null") -> str:
    return f"case {x} " + " ".join(f"when {q(a)} then {q(b)}" for a, b in pairs.items()) + f" else {default} end"


Q_ = s_strip("query")
S_COUNTRY = f"upper({s_first(Q_, P.ECLI_COUNTRY, 1)})"
S_ROUTE = f"""case
    when {s_has(Q_, P.ECLI_ECHR)} or contains(lower({Q_}), 'hudoc.echr.coe.int') then 'hudoc'
    when contains(lower({Q_}), 'wetten.overheid.nl') or {s_has(Q_, P.STATUTE)} then 'wetten'
    when regexp_matches({Q_}, {q(P.ITEM_ID)}) and not contains(lower({Q_}), 'rechtspraak') and not {s_has(Q_, P.ECLI)} then 'hudoc'
    when contains(lower({Q_}), 'rechtspraak.nl') or {s_has(Q_, 'ECLI:NL:')} then 'rechtspraak'
    when {S_COUNTRY} in ('BE', 'DE', 'FR') then 'national' end"""
S_QUERY_PART = f"regexp_extract({Q_}, {q(r'\?([^#]*)')}, 1)"


def s_celex() -> str:
    def value(name: str) -> str:
        raw = f"replace(nullif(regexp_extract({S_QUERY_PART}, {q(f'(?:^|&){name}=([^&]+)')}, 1), ''), '+', ' ')"
        v = f"url_decode({raw})"
        return f"case when {s_has(v, P.CELEX_NAMED)} then coalesce({s_first(v, f'({P.CELEX})', 1)}, {v}) when {s_has(v, f'^{P.CELEX}$')} then {v} end"

    labelled = s_first(Q_, P.CELEX_BEHIND_NAME, 1)
    return f"""upper(coalesce(case when {s_has(Q_, f'^{P.CELEX}$')} then {Q_} end, {value('uri')}, {value('CELEX')}, {value('celex')},
        case when {s_has(labelled, f'^{P.CELEX}$')} then {labelled} end, {s_first(Q_, f'/({P.CELEX_CORE})', 1)}))"""


S_ELI_NUMBER = f"regexp_replace({s_first('query', P.ELI, 3)}, '^0+([0-9])', '\\1')"
S_ELI = f"""'3' || {s_first('query', P.ELI, 2)} || {s_case(f"lower({s_first('query', P.ELI, 1)})", P.ELI_LETTERS)}
    || case when length({S_ELI_NUMBER}) >= 4 then {S_ELI_NUMBER} else lpad({S_ELI_NUMBER}, 4, '0') end"""
S_KIND = f"""case when starts_with(s, 'Rechtspraak.nl') or starts_with(s, 'HUDOC') or contains(s, 'ECLI:EU:') or contains(s, 'CELEX:6') or {s_has('s', 'ECLI:[A-Z]{2}:')} then 'caselaw' else 'document' end"""


# ---------------------------------------------------------------- requests


@query(f"select req_id, {S_COUNTRY} as country, coalesce({S_ROUTE}, 'eurlex') as source from identifiers")
def route_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Source of each request."""
    x = T.strip(F.col("query"))
    return table(spark, d, "identifiers").select("req_id", R.country(x).alias("country"), F.coalesce(R.route(F.col("query")), F.lit("eurlex")).alias("source"))


@query(f"select req_id, {s_celex()} as celex from identifiers")
def celex_from_text(spark: SparkSession, d: str) -> DataFrame:
    """CELEX number in each request."""
    return table(spark, d, "identifiers").select("req_id", R.celex(F.col("query")).alias("celex"))


@query(
    f"""with e as (select req_id, 'https://data.example/eli/' || (case req_id % 13 when 0 then 'reg' when 1 then 'REG_impl' when 2 then 'reg_del' when 3 then 'dir' when 4 then 'dir_impl' when 5 then 'dir_del'
        when 6 then 'dec' when 7 then 'dec_impl' when 8 then 'dec_del' when 9 then 'reco' when 10 then 'recommendation' when 11 then 'treaty' else 'agree' end) || '/' || (1990 + req_id % 40) || '/0' || (req_id * 7) || '/oj' as query from identifiers)
    select req_id, {S_ELI} as celex from e"""
)
def eli_to_celex(spark: SparkSession, d: str) -> DataFrame:
    """CELEX numbers of legislation identifiers made from the request numbers, all types of act and unknown ones."""
    kinds = ("reg", "REG_impl", "reg_del", "dir", "dir_impl", "dir_del", "dec", "dec_impl", "dec_del", "reco", "recommendation", "treaty", "agree")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("req_id") % 13 + 1).cast("int"))
    eli = F.concat(F.lit("https://data.example/eli/"), kind, F.lit("/"), (1990 + F.col("req_id") % 40).cast("string"), F.lit("/0"), (F.col("req_id") * 7).cast("string"), F.lit("/oj"))
    return table(spark, d, "identifiers").select("req_id", R.eli_to_celex(eli).alias("celex"))


@query(
    f"""select req_id, coalesce(replace({s_first('query', P.ECLI)}, ':', '-'), upper({s_first('query', P.STATUTE)}), 'HUDOC-' || nullif(regexp_extract(query, {q(r'\b(00[0-9]-[0-9]{3,})\b')}, 1), ''),
        upper({s_first('query', f'({P.CELEX_CORE})', 1)}), 'document') as name from identifiers"""
)
def download_name(spark: SparkSession, d: str) -> DataFrame:
    """Name of a download for each request."""
    return table(spark, d, "identifiers").select("req_id", R.download_name(F.col("query")).alias("name"))


S_PATH = f"upper({s_first(Q_, P.STATUTE)}) || coalesce('/' || nullif(regexp_extract({Q_}, {q(P.ISO_DATE)}), ''), '')"
S_UPPER_ECLI = f"upper({s_first(Q_, P.ECLI)})"
S_LANG = f"upper(coalesce(nullif({s_strip('lang')}, ''), 'NL'))"


@query(
    f"""select req_id, case coalesce({S_ROUTE}, 'eurlex')
        when 'rechtspraak' then 'https://data.rechtspraak.nl/uitspraken/content?id=' || {S_UPPER_ECLI}
        when 'wetten' then 'https://wetten.overheid.nl/' || {S_PATH}
        when 'national' then case {S_COUNTRY} when 'BE' then 'https://juportal.be/content/' || {S_UPPER_ECLI}
            when 'FR' then 'https://www.conseil-constitutionnel.fr/decision/' || {s_first(S_UPPER_ECLI, P.ECLI_FR_COUNCIL, 1)} || '/' || replace({s_first(S_UPPER_ECLI, P.ECLI_FR_COUNCIL, 2)}, '.', '') || '.htm' end
        when 'eurlex' then case when {s_has(Q_, P.ECLI_EU)} then 'http://publications.europa.eu/resource/ecli/' || url_encode(upper({s_first(Q_, P.ECLI_EU)})) else 'https://eur-lex.europa.eu/legal-content/' || {S_LANG} || '/TXT/HTML/?uri=CELEX:' || coalesce({S_ELI.replace('query', Q_)}, {s_celex()}) end end as url from identifiers"""
)
def derive_source_url(spark: SparkSession, d: str) -> DataFrame:
    """Address each request is fetched from."""
    return table(spark, d, "identifiers").select("req_id", R.source_url(F.col("query"), F.col("lang")).alias("url"))


@query(
    f"""with e as (select req_id, query || case req_id % 4 when 0 then '' when 1 then '#Hoofdstuk%20' || req_id when 2 then '# ' else '#a+b#c' end as query from identifiers)
    select req_id, case when contains(query, '#') then nullif({s_strip(f"url_decode(replace(regexp_extract(query, {q(r'(?s)#(.*)$')}, 1), '+', '%2B'))")}, '') end as anchor from e"""
)
def anchor_of_request(spark: SparkSession, d: str) -> DataFrame:
    """Element of a statute a request asks for, with anchors added by request number."""
    n = F.col("req_id") % 4
    tail = F.when(n == 0, "").when(n == 1, F.concat(F.lit("#Hoofdstuk%20"), F.col("req_id").cast("string"))).when(n == 2, "# ").otherwise("#a+b#c")
    return table(spark, d, "identifiers").select("req_id", T.anchor(F.concat("query", tail)).alias("anchor"))


# ---------------------------------------------------------------- labels and files


@query(f"with e as (select doc_id, kind, coalesce(source, '') as s from md_documents) select doc_id, kind, {S_KIND} as derived, string_split(s, ' • ')[1] as engine from e")
def kind_for_source(spark: SparkSession, d: str) -> DataFrame:
    """Kind and engine from the label of each document."""
    return table(spark, d, "md_documents").select("doc_id", "kind", R.kind_for_source(F.col("source")).alias("derived"), R.engine_of(F.coalesce("source", F.lit(""))).alias("engine"))


URL = "coalesce(regexp_extract(source, '(https?://.*)$', 1), '')"


@query(f"select doc_id, coalesce(nullif(regexp_replace(string_split(string_split(string_split({URL}, '?')[1], '#')[1], '/')[-1], '\\.[^.]+$', ''), ''), 'document') as base from md_documents")
def basename_url(spark: SparkSession, d: str) -> DataFrame:
    """Base name of the address in a label, `document` without one."""
    return table(spark, d, "md_documents").select("doc_id", T.basename(F.coalesce(F.regexp_extract("source", r"(https?://.*)$", 1), F.lit(""))).alias("base"))


@query(f"""with e as (select doc_id, coalesce(nullif(source, ''), 'document') as s from md_documents), n as (select doc_id, regexp_replace(s, '[^A-Za-z0-9._-]', '_', 'g') as name from e)
    select doc_id, case when ends_with(name, '.md') then name else name || '.md' end as name from n""")
def sanitize_filename(spark: SparkSession, d: str) -> DataFrame:
    """Labels as file names."""
    return table(spark, d, "md_documents").select("doc_id", T.sanitize_filename(F.col("source")).alias("name"))


S_EXT = s_case(f"lower({s_strip("string_split(ct, ';')[1]")})", P.EXTENSIONS, "''")
CT = "case doc_id % 5 when 0 then 'application/pdf' when 1 then ' Text/HTML ; charset=utf-8' when 2 then 'image/png' when 3 then 'text/plain' else null end"


@query(
    f"""with e as (select doc_id, coalesce({CT}, '') as ct, 'https://files.example/a%20b/' || (case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then 'doc+' || doc_id else 'doc%2F' || doc_id || '.docx' end) || '?x=1#y' as url from md_documents),
    n as (select doc_id, ct, coalesce(nullif(string_split(url_decode(replace(regexp_replace(string_split(string_split(url, '#')[1], '?')[1], '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/]*', ''), '+', '%2B')), '/')[-1], ''), 'document') as name from e)
    select doc_id, case when contains(name, '.') then name else name || {S_EXT} end as filename from n"""
)
def filename_from_url(spark: SparkSession, d: str) -> DataFrame:
    """File names of addresses made from the document numbers, with the extension of a content type."""
    n, ident = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    name = F.when(n == 0, "").when(n == 1, F.concat(F.lit("doc+"), ident)).otherwise(F.concat(F.lit("doc%2F"), ident, F.lit(".docx")))
    m = F.col("doc_id") % 5
    ct = F.when(m == 0, "application/pdf").when(m == 1, " Text/HTML ; charset=utf-8").when(m == 2, "image/png").when(m == 3, "text/plain")
    return table(spark, d, "md_documents").select("doc_id", T.filename_from_url(F.concat(F.lit("https://files.example/a%20b/"), name, F.lit("?x=1#y")), ct).alias("filename"))


@query(f"""with e as (select doc_id, case doc_id % 4 when 0 then '<?xml version="1.0"?><' || 'act>' || text when 1 then repeat('x', 300) || '<ARTICLE>' when 2 then '<html>' || text else text end as t from documents),
    h as (select doc_id, hex(encode(t))[1:16000] as head from e)
    select doc_id, regexp_matches(head[1:400], '^(?:..)*?3C') and regexp_matches(head, '^(?:..)*?(?:{'|'.join(''.join(f'(?:{ord(c):02X}|{ord(c.lower()):02X})' for c in mark) for mark in P.STRUCTURED_XML)})') as structured from h""")
def structured_xml_sniff(spark: SparkSession, d: str) -> DataFrame:
    """Whether bytes made from all articles begin like a structured act."""
    return _sniffed(spark, d).select("doc_id", R.looks_like_structured_xml(F.encode("t", "UTF-8")).alias("structured"))


def _sniffed(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, t): articles with beginnings by number."""
    n = F.col("doc_id") % 4
    t = F.when(n == 0, F.concat(F.lit('<?xml version="1.0"?><act>'), "text")).when(n == 1, F.concat(F.repeat(F.lit("x"), F.lit(300)), F.lit("<ARTICLE>"))).when(n == 2, F.concat(F.lit("<html>"), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t"))


# ---------------------------------------------------------------- text


@query(f"select doc_id, md5(trim(regexp_replace(markdown, {q(P.WS + '+')}, ' ', 'g'))) as text from md_documents where markdown is not null")
def collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    """Documents in one line, as digests."""
    return table(spark, d, "md_documents").where("markdown is not null").select("doc_id", F.md5(T.collapse_ws(F.col("markdown"))).alias("text"))


@query(f"select doc_id, md5({s_tidy('markdown')}) as text, length({s_tidy('markdown')})::bigint as n from md_documents where markdown is not null")
def tidy_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents without white space at line ends and runs of blank lines, as digests."""
    t = T.tidy(F.col("markdown"))
    return table(spark, d, "md_documents").where("markdown is not null").select("doc_id", F.md5(t).alias("text"), F.length(t).cast("long").alias("n"))


@query(
    f"""with e as (select doc_id, regexp_replace(markdown, '(?m)^#+ ', '', 'g') || chr(10) || ' HOOFDSTUK ' || doc_id || chr(10) || 'Article ' || doc_id || ' bis' || chr(10) || 'Artikel x' as t from md_documents where markdown is not null)
    select doc_id, md5(regexp_replace(regexp_replace(t, {q('(?im)' + P.DIVISION_LINE)}, '## \\1', 'g'), {q('(?im)' + P.ARTICLE_LINE)}, '### \\1', 'g')) as text from e"""
)
def promote_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings found again after their marks were taken off, and some more, as digests."""
    ident = F.col("doc_id").cast("string")
    t = F.concat(F.regexp_replace("markdown", r"(?md)^#+ ", ""), F.lit("\n HOOFDSTUK "), ident, F.lit("\nArticle "), ident, F.lit(" bis\nArtikel x"))
    return table(spark, d, "md_documents").where("markdown is not null").select("doc_id", F.md5(T.promote_headings(t)).alias("text"))


@query(
    f"""with w as (select doc_id, unnest(string_split(markdown, chr(10))) as line from md_documents where markdown is not null), m as (select distinct {s_strip("string_split(line, ' ')[1]")} as x from w)
    select x as marker, length(x) <= 6 and (x = '' or x in ({', '.join(map(q, P.BULLETS))}) or regexp_matches(x, {q('(?i)' + P.MARKER)})) as is_marker,
        case when regexp_matches(x, '^[0-9]{{1,4}}$') then x || '. ' when x in ({', '.join(map(q, P.BULLETS))}) then '- ' when x <> '' then x || ' ' else '' end as prefix from m"""
)
def marker_prefix(spark: SparkSession, d: str) -> DataFrame:
    """First words of all lines as list markers."""
    lines = table(spark, d, "md_documents").where("markdown is not null").select(F.explode(F.split("markdown", "\n", -1)).alias("line"))
    marks = lines.select(T.strip(F.substring_index("line", " ", 1)).alias("marker")).distinct()
    return marks.select("marker", T.is_marker(F.col("marker")).alias("is_marker"), T.marker_prefix(F.col("marker")).alias("prefix"))


@query(f"select doc_id, md5(regexp_replace(markdown, {q(P.GLYPH)}, '', 'g')) as text, regexp_matches(markdown, {q(P.GLYPH)}) as had from md_documents where markdown is not null")
def strip_glyphs(spark: SparkSession, d: str) -> DataFrame:
    """Documents without names of missing glyphs, as digests."""
    return table(spark, d, "md_documents").where("markdown is not null").select("doc_id", F.md5(T.strip_glyphs(F.col("markdown"))).alias("text"), F.col("markdown").rlike(P.GLYPH).alias("had"))


FENCED = "case ord % 4 when 0 then '```markdown' || chr(10) || text || chr(10) || '``` ' when 1 then ' ```' || chr(10) || text || chr(10) || chr(10) || '```' when 2 then '```' || text || '```' else ' ' || text end"
S_FENCE = f"(?s)^```(?:markdown)?{P.WS}*\\n(.*?)\\n```{P.WS}*$"


@query(f"with e as (select doc_id, ord, {FENCED} as t from notes) select doc_id, ord, case when regexp_matches({s_strip('t')}, {q(S_FENCE)}) then {s_strip(f'regexp_extract({s_strip("t")}, {q(S_FENCE)}, 1)')} else t end as text from e")
def fence_strip(spark: SparkSession, d: str) -> DataFrame:
    """Notes in and out of code fences."""
    return table(spark, d, "notes").select("doc_id", "ord", T.strip_fence(F.expr(FENCED.replace("chr(10)", "'\\n'"))).alias("text"))


@query(
    f"""with b as (select doc_id, unnest(string_split_regex(regexp_replace(markdown, {q(P.GLYPH)}, '', 'g'), '\\n[ \\t]*\\n')) as block, generate_subscripts(string_split_regex(regexp_replace(markdown, {q(P.GLYPH)}, '', 'g'), '\\n[ \\t]*\\n'), 1) as n from md_documents where markdown is not null),
    l as (select doc_id, n, list_filter(list_transform(string_split(block, chr(10)), lambda x: {s_strip('x')}), lambda x: x <> '') as lines from b),
    w as (select doc_id, n, lines, greatest(45, floor(list_max(list_transform(lines, lambda x: length(x))) * 0.6::double)::int) as least from l where len(lines) > 0),
    r as (select doc_id, n, list_reduce(list_transform(lines[2:], lambda x: {{'done': '', 'line': x}}), lambda s, e: case
            when length(s.line) >= least and not regexp_matches(s.line, {q(P.STRUCTURAL)}) and not regexp_matches(e.line, {q(P.STRUCTURAL)})
            then {{'done': s.done, 'line': case when regexp_matches(s.line, '\\p{{L}}-$') and regexp_matches(e.line, '^\\p{{Ll}}') then s.line[:-2] || e.line else s.line || ' ' || e.line end}}
            else {{'done': s.done || s.line || chr(10), 'line': e.line}} end, {{'done': '', 'line': lines[1]}}) as s from w)
    select d.doc_id, md5(coalesce(string_agg(s.done || s.line, chr(10) || chr(10) order by n), '')) as text from (select doc_id from md_documents where markdown is not null) d left join r on r.doc_id = d.doc_id group by d.doc_id"""
)
def reflow_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents with soft line breaks joined, as digests."""
    return table(spark, d, "md_documents").where("markdown is not null").select("doc_id", F.md5(reflow.reflow(F.col("markdown"))).alias("text"))


#: Letters whose capitals differ between engines.
ODD_CAPITALS = r"[^\x{9}-\x{7e}À-ÖØ-Þà-öø-þ€§’“”«»]|ß|ÿ"


@query(
    f"""with w as (select doc_id, unnest(string_split(markdown, chr(10))) as line from md_documents where markdown is not null), h as (select distinct regexp_replace({s_strip("line")}, '^#+ ', '') as x from w),
    e as (select case when length(x) % 3 = 0 and not regexp_matches(x, {q(ODD_CAPITALS)}) then 'IV. ' || upper(x) when length(x) % 3 = 1 then 'X.' || x else x end as line from h)
    select line, case when regexp_matches(line, {q(P.ROMAN_LINE)}) then '## ' || line else line end as promoted from e"""
)
def roman_headings(spark: SparkSession, d: str) -> DataFrame:
    """Lines with Roman numerals put before them, in capitals where both engines agree on those."""
    lines = table(spark, d, "md_documents").where("markdown is not null").select(F.explode(F.split("markdown", "\n", -1)).alias("line"))
    x = lines.select(F.regexp_replace(T.strip(F.col("line")), "^#+ ", "").alias("x")).distinct()
    n = F.length("x") % 3
    made = x.select(F.when((n == 0) & ~F.col("x").rlike(ODD_CAPITALS), F.concat(F.lit("IV. "), F.upper("x"))).when(n == 1, F.concat(F.lit("X."), "x")).otherwise(F.col("x")).alias("line"))
    return made.select("line", T.roman_heading(F.col("line")).alias("promoted"))


# ---------------------------------------------------------------- chunks and estimates


def s_pack(x: str, separator: str, limit: str, n: int) -> str:
    """Pieces of x joined up to a limit, as a fold; n keeps the names of nested folds apart."""
    joined = f"s{n}.open || {separator} || e{n}.open"
    fold = f"""list_reduce(list_transform(string_split({x}, {separator}), lambda p{n}: {{'done': []::varchar[], 'open': p{n}}}), lambda s{n}, e{n}: case when s{n}.open = '' then {{'done': s{n}.done, 'open': e{n}.open}}
        when length({joined}) > {limit} then {{'done': list_append(s{n}.done, s{n}.open), 'open': e{n}.open}} else {{'done': s{n}.done, 'open': {joined}}} end)"""
    return f"list_transform([{fold}], lambda r{n}: case when r{n}.open <> '' then list_append(r{n}.done, r{n}.open) else r{n}.done end)[1]"


def s_ladder(x: str, limit: str) -> str:
    def refine(parts: str, n: int, finer: Callable[[str], str]) -> str:
        return f"flatten(list_transform({parts}, lambda w{n}: case when length(w{n}) <= {limit} then [w{n}] else {finer(f'w{n}')} end))"

    hard = lambda w: f"list_transform(range(1, length({w}) + 1, {limit}), lambda i: substring({w}, i, {limit}))"
    words = lambda w: refine(s_pack(w, "' '", limit, 3), 3, hard)
    lines = lambda w: refine(s_pack(w, "chr(10)", limit, 2), 2, words)
    return refine(s_pack(x, "chr(10) || chr(10)", limit, 1), 1, lines)


@query(
    f"""with d as (select doc_id, {s_strip('markdown')} as t from md_documents where length({s_strip('markdown')}) > 0), c as (select doc_id, {s_ladder('t', str(SMALL))} as c from d)
    select doc_id, (k - 1)::int as chunk_no, md5(c[k]) as chunk, length(c[k])::bigint as size from c, lateral (select unnest(range(1, len(c) + 1)) as k)"""
)
def split_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents at a small limit, as digests."""
    t = T.strip(F.col("markdown"))
    rows = table(spark, d, "md_documents").select("doc_id", t.alias("t")).where(F.length("t") > 0)
    return rows.select("doc_id", F.posexplode(chunk.split_ladder(F.col("t"), F.lit(SMALL))).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.md5("c").alias("chunk"), F.length("c").cast("long").alias("size"))


S_CHUNKS = f"""j as (select d.doc_id, p.profile, p.output_ratio, p.prompt_chars, p.no_chunk, p.chunk_chars as most, {s_strip('d.markdown')} as t from md_documents d join profiles p on p.kind = d.kind where d.markdown is not null),
    c as (select *, case when t = '' then []::varchar[] when no_chunk or most is null then [t] else {s_ladder('t', 'most')} end as c from j)"""
S_ESTIMATE = f"""{S_CHUNKS}, e as (select doc_id, profile, len(c)::bigint as chunks, coalesce(list_sum(list_transform(c, lambda x: length(x))), 0) // 4 as content, prompt_chars // 4 as system, output_ratio from c),
    est as (select doc_id, profile, chunks, (content + (system + 20) * chunks)::bigint as input_tokens, floor(content * output_ratio)::bigint as output_tokens from e)"""


@query(f"with {S_CHUNKS} select doc_id, (case when len(c) > 0 then k - 1 end)::int as chunk_no, length(c[k])::bigint as size from c, lateral (select unnest(range(1, greatest(len(c), 1) + 1)) as k)")
def chunks_for_profile(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents under the profile of their kind; a blank document has one row without a chunk."""
    parts = clean.chunk_table(table(spark, d, "md_documents"), table(spark, d, "profiles"))
    return parts.select("doc_id", "chunk_no", F.length("chunk").cast("long").alias("size"))


@query(f"with {S_ESTIMATE} select * from est")
def estimate_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and tokens of cleaning each document."""
    return estimate.estimate(table(spark, d, "md_documents"), table(spark, d, "profiles"))


MODELS = "(values ('vendor/a:fast'), ('vendor/b'), ('vendor/c:fast'), ('vendor/none')) as t(model)"
PRICES = "(values (0, 'vendor/a', '0.5', '1'), (1, 'vendor/a:fast', '9', '9'), (2, 'vendor/b', '', NULL), (3, 'vendor/b', '7', '7'), (4, 'vendor/c', 'free', '1')) as t(ord, id, prompt, completion)"


@query(
    f"""with k as (select distinct model, unnest([model, string_split(model, ':')[1]]) as id from {MODELS}), j as (select k.model, p.ord, p.prompt, p.completion from k join (select * from {PRICES}) p on p.id = k.id),
    f as (select model, arg_min(coalesce(prompt, ''), ord) as prompt, arg_min(coalesce(completion, ''), ord) as completion from j group by model),
    v as (select model, case when prompt = '' then 0 else try_cast(prompt as double) end as p, case when completion = '' then 0 else try_cast(completion as double) end as c from f)
    select m.model, case when p is not null and c is not null then p end as prompt, case when p is not null and c is not null then c end as completion from (select * from {MODELS}) m left join v on v.model = m.model"""
)
def model_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices of models from a catalogue with doubled, empty and broken entries."""
    return estimate.model_prices(spark.sql(f"select * from {MODELS}"), spark.sql(f"select * from {PRICES}"))


@query(f"with {S_ESTIMATE} select profile, count(*) as docs, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, round(sum(input_tokens * 0.5::double + output_tokens * 1.0::double), 3) as cost from est group by profile")
def estimate_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost of cleaning all documents by profile."""
    rows = estimate.estimate(table(spark, d, "md_documents"), table(spark, d, "profiles")).withColumn("model", F.lit("vendor/a:fast"))
    priced = estimate.with_cost(rows, model_prices(spark, d))
    return priced.groupBy("profile").agg(F.count("*").alias("docs"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 3).alias("cost"))


SETTINGS = """[{"id": " vendor/a ", "label": " A "}, {"id": "", "label": "none"}, {"label": "no id"}, {"id": "vendor/b", "label": null}]"""


@query(
    f"""with e as (select unnest(from_json({q(SETTINGS)}, '[{{"id":"VARCHAR","label":"VARCHAR"}}]'), recursive := true)), m as (select {s_strip("coalesce(id, '')")} as id, {s_strip("coalesce(label, '')")} as label from e),
    r as (select distinct lang from identifiers)
    select r.lang as wanted, coalesce((select min(id) from m where id <> '' and id = r.lang), 'vendor/default') as model, (select count(*) from m where id <> '')::int as known, case when {s_strip("coalesce(r.lang, '')")} <> '' then r.lang else 'default text' end as prompt from r"""
)
def settings_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Settings over defaults: models with an id, a wanted model only if known, texts unless blank."""
    rows = estimate.valid_models(F.from_json(F.lit(SETTINGS), "array<struct<id:string,label:string>>"))
    ids = F.transform(rows, lambda m: m["id"])
    wanted = table(spark, d, "identifiers").select(F.col("lang").alias("wanted")).distinct()
    return wanted.select("wanted", estimate.resolve_model(F.col("wanted"), ids, "vendor/default").alias("model"), F.size(ids).alias("known"), estimate.overlay(F.lit("default text"), F.col("wanted")).alias("prompt"))


# ---------------------------------------------------------------- relations with an order

S_ISO = s_case("upper(lang)", P.ISO3)


@query(
    f"""with r as (select req_id, upper({s_first('query', P.ECLI_ECHR)}) as key, {S_ISO} as wanted from identifiers where {s_has('query', P.ECLI_ECHR)}),
    j as (select r.req_id, c.itemid, c.ord, upper(coalesce(c.lang3, '')) as lang3, case when upper(coalesce(c.lang3, '')) = r.wanted then 0 when upper(coalesce(c.lang3, '')) = 'ENG' then 1 when upper(coalesce(c.lang3, '')) = 'FRE' then 2 else 3 end as p
        from (select distinct * from r) r join candidates c on upper(c.ecli) = r.key where c.itemid is not null and c.itemid <> ''),
    b as (select *, row_number() over (partition by req_id, itemid order by p, ord, lang3) as k from j)
    select req_id, row_number() over (partition by req_id order by p, ord, itemid)::int as place, itemid, lang3 from b where k = 1"""
)
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    """Language versions of each requested human-rights decision in order of preference."""
    asked = table(spark, d, "identifiers").select("req_id", F.upper(F.nullif(F.regexp_extract("query", f"(?i){P.ECLI_ECHR}", 0), F.lit(""))).alias("ecli"), F.upper("lang").alias("lang"))
    return assemble.rank_candidates(table(spark, d, "candidates"), asked.where("ecli is not null").distinct())


@query(
    f"""with u as (select *, row_number() over (partition by req_id order by rank, attempted_at, ident, text) as k from attempts where status = 200 and length({s_strip("coalesce(text, '')")}) >= 40)
    select req_id, rank, ident, md5(text) as text from u where k = 1"""
)
def first_success(spark: SparkSession, d: str) -> DataFrame:
    """First useful attempt of each request."""
    return assemble.first_useful(table(spark, d, "attempts")).select("req_id", "rank", "ident", F.md5("text").alias("text"))


@query(
    """with a as (select req_id, rank, status, text, row_number() over (partition by req_id, rank order by arrived_at desc, status desc, text desc) as k from attempts), p as (select * from a where k = 1)
    select req_id, count(*) filter (where status = 200 and text is not null)::bigint as parts, count(*) filter (where not coalesce(status = 200 and text is not null, false))::bigint as failed,
        md5(nullif(string_agg(case when status = 200 then text end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank), '')) as markdown from p group by req_id"""
)
def multipart_concat(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of a request as parts of a document, the last delivery of each."""
    last = F.max_by(F.struct("status", "text"), F.struct(F.col("arrived_at"), F.col("status"), F.col("text"))).alias("p")
    parts = table(spark, d, "attempts").groupBy("req_id", "rank").agg(last).select("req_id", "rank", "p.status", "p.text")
    return assemble.multipart(parts).select("req_id", "parts", "failed", F.md5("markdown").alias("markdown"))


@query(
    """with o as (select req_id, query, lang, requested_at, arrived_at, row_number() over (partition by req_id order by arrived_at desc, query desc, lang desc nulls last, requested_at desc) as k from identifiers)
    select req_id, query, lang, arrived_at from o where k = 1"""
)
def latest_requests(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each request."""
    return assemble.latest_delivery(table(spark, d, "identifiers"), "req_id").select("req_id", "query", "lang", "arrived_at")


@query("with o as (select *, row_number() over (partition by doc_id, note_id order by ord, text) as k from notes) select doc_id, string_agg('[^' || note_id || ']: ' || text, chr(10) order by ord) as section from o where k = 1 group by doc_id")
def footnote_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Note sections with the first text of each note."""
    return assemble.footnote_section(table(spark, d, "notes"))


S_NODES = f"""n as (select doc_id, k - 1 as ord, case when regexp_matches(line, '^[0-9]+[.] ') then 'nr' else 'para' end as kind, case when regexp_matches(line, '^[0-9]+[.] ') then string_split(line, '.')[1] else line end as text
    from (select doc_id, unnest(string_split(markdown, chr(10) || chr(10))) as line, generate_subscripts(string_split(markdown, chr(10) || chr(10)), 1) as k from md_documents where markdown is not null)),
    s as (select *, lag(kind) over w as kb, lag(text) over w as tb, lead(kind) over w as ka from n window w as (partition by doc_id order by ord))"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "md_documents").where("markdown is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("markdown", "\n\n", -1)).alias("ord", "line"))
    nr = F.col("line").rlike(r"^[0-9]+[.] ")
    return lines.select("doc_id", "ord", F.when(nr, "nr").otherwise("para").alias("kind"), F.when(nr, F.substring_index("line", ".", 1)).otherwise(F.col("line")).alias("text"))


@query(
    f"""with {S_NODES} select doc_id, ord::int as ord, md5(text) as text from (
        select doc_id, ord, {s_strip(f"(case when kb = 'nr' and {s_strip('tb')} <> '' then {s_strip('tb')} || ' ' else '' end) || text")} as text from s where kind = 'para'
        union all select doc_id, ord, {s_strip('text')} from s where kind = 'nr' and ka is null) where text <> ''"""
)
def number_carry(spark: SparkSession, d: str) -> DataFrame:
    """Numbers put before the paragraph that follows them; numbered blocks of the documents serve as numbers."""
    return assemble.carry_numbers(_nodes(spark, d)).select("doc_id", "ord", F.md5("text").alias("text"))


@query(f"with {S_NODES} select doc_id, ord::int as ord, md5(case when kb = 'nr' and tb <> '' then tb || '. ' || text else text end) as text from s where kind = 'para'")
def sibling_pair(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs with the number directly before them."""
    return assemble.pair_siblings(_nodes(spark, d)).select("doc_id", "ord", F.md5("text").alias("text"))


@query(
    f"""with r as (select req_id, {s_strip("coalesce(query, '')")} as q, case when {s_strip("coalesce(query, '')")} = '' then 'missing_query' when coalesce({S_ROUTE}, 'eurlex') = 'eurlex' and coalesce({s_celex()}, {S_ELI.replace('query', Q_)}, {s_first(Q_, P.ECLI_EU)}) is null then 'no_identifier' end as error from identifiers),
    k as (select error, count(*) as n from r group by error)
    select sum(n)::bigint as done, coalesce(sum(n) filter (where error is null), 0)::bigint as succeeded, coalesce(sum(n) filter (where error is not null), 0)::bigint as failed, coalesce(string_agg(error || ': ' || n, ', ' order by error || ': ' || n) filter (where error is not null), '') as errors from k"""
)
def batch_report(spark: SparkSession, d: str) -> DataFrame:
    """How many requests could be routed, and why others could not."""
    routed = convert.route_requests(table(spark, d, "identifiers"))
    q_ = F.col("query")
    nothing = F.coalesce(R.celex(q_), R.eli_to_celex(q_), F.nullif(F.regexp_extract(q_, f"(?i){P.ECLI_EU}", 0), F.lit(""))).isNull()
    error = F.coalesce("error", F.when((F.col("source") == "eurlex") & nothing, "no_identifier"))
    return assemble.tally(routed.select("req_id", error.isNull().alias("ok"), error.alias("error")))


JSON_ROW = """to_json(named_struct('chamber', case when doc_id % 3 = 0 then null else 'Chambre ' || doc_id % 7 end, 'number', case when doc_id % 4 = 0 then '' else cast(doc_id as string) end, 'decision_date', case when doc_id % 5 = 0 then null else '2031-02-03' end, 'text', markdown))"""


@query(
    f"""with e as (select doc_id, list_aggregate(list_filter(['Cour de cassation', case when doc_id % 3 = 0 then '' else 'Chambre ' || doc_id % 7 end, case when doc_id % 4 = 0 then '' else doc_id::varchar end, case when doc_id % 5 = 0 then '' else '2031-02-03' end], lambda x: x <> ''), 'string_agg', ' ') as head,
        list_aggregate(list_filter(list_transform(string_split_regex({s_strip('markdown')}, {q('\\n' + P.WS + '*\\n')}), lambda x: {s_strip('x')}), lambda x: x <> ''), 'string_agg', chr(10) || chr(10)) as body from md_documents where markdown is not null)
    select doc_id, md5({s_tidy("'# ' || head || coalesce(chr(10) || chr(10) || body, '')")}) as markdown from e"""
)
def cassation_render(spark: SparkSession, d: str) -> DataFrame:
    """Decisions from JSON records made of the documents, as digests."""
    rows = table(spark, d, "md_documents").where("markdown is not null").select("doc_id", F.expr(JSON_ROW).alias("body"))
    return rows.select("doc_id", F.md5(cassation_markdown(F.col("body"))).alias("markdown"))


def cassation_markdown(body):
    """Markdown of a French cassation decision from its JSON record."""
    r = F.from_json(body, "chamber string, number string, decision_date string, text string")
    blank = lambda c: F.coalesce(c, F.lit(""))
    head = F.array_join(F.filter(F.array(F.lit("Cour de cassation"), blank(r["chamber"]), blank(r["number"]), blank(r["decision_date"])), lambda x: x != ""), " ")
    text = F.array_join(T.paragraphs(T.strip(blank(r["text"]))), "\n\n")
    return T.tidy(F.concat(F.lit("# "), head, F.when(text != "", F.concat(F.lit("\n\n"), text)).otherwise("")))


# ---------------------------------------------------------------- markup, cleaning, streams

ESC = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    f"""with n as (select doc_id, ord, note_id, trim(regexp_replace(text, {q(P.WS + '+')}, ' ', 'g')) as t from notes)
    select doc_id, '# Note ' || doc_id || chr(10) || chr(10) || string_agg(replace(replace(t, '_', '\\_'), '*', '\\*'), chr(10) || chr(10) order by ord, note_id, t) || chr(10) as markdown from n group by doc_id"""
)
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of the notes of a document: a heading and unclosed paragraphs, with scripts and a menu around."""
    text = F.expr("concat('<p>', " + ESC.format(x="text") + ")")
    body = assemble.ordered_join(F.struct("ord", "note_id", "text"), text, "\n")
    page = F.concat(F.lit("<html><head><title>x</title><script>if (a < b) {'</p>'}</script></head><body><!-- c --><div id='text'><h1>Note "), F.col("doc_id").cast("string"), F.lit("</h1>"), F.col("b"), F.lit("</div><p>foot</body>"))
    pages = table(spark, d, "notes").groupBy("doc_id").agg(body.alias("b")).select("doc_id", F.lit("html").alias("format"), page.alias("content"), F.lit(None).cast("string").alias("ref"))
    return convert.convert(pages, ["doc_id"]).select("doc_id", "markdown")


@query(
    f"""with n as (select doc_id, ord, note_id, trim(regexp_replace(text, {q(P.WS + '+')}, ' ', 'g')) as t from notes),
    l as (select doc_id, (string_agg((ord + 1) || '.  ' || t, chr(10) || chr(10) order by ord, note_id, t)) as body, string_agg('| ' || note_id || ' | ' || replace(t, '|', '\\|') || ' |', chr(10) order by ord, note_id, t) as tab from n group by doc_id)
    select doc_id, '# Act ' || doc_id || chr(10) || chr(10) || '## CHAPTER I — General' || chr(10) || chr(10) || '### Article 1' || chr(10) || chr(10) || body || chr(10) || chr(10) || '| id | text |' || chr(10) || '| --- | --- |' || chr(10) || tab || chr(10) as markdown from l"""
)
def structured_act(spark: SparkSession, d: str) -> DataFrame:
    """Structured acts made of the notes of a document: numbered paragraphs and a table."""
    text = ESC.format(x="text")
    parag = F.expr(f"concat('<PARAG><NO.PARAG>', ord + 1, '.</NO.PARAG><ALINEA>', {text}, '</ALINEA></PARAG>')")
    row = F.expr(f"concat('<ROW><CELL>', note_id, '</CELL><CELL>', {text}, '</CELL></ROW>')")
    key = F.struct("ord", "note_id", "text")
    made = table(spark, d, "notes").groupBy("doc_id").agg(assemble.ordered_join(key, parag, "").alias("p"), assemble.ordered_join(key, row, "").alias("r"))
    xml = F.concat(
        F.lit("<ACT xmlns:f='x'><TITLE><TI><P>Act "), F.col("doc_id").cast("string"), F.lit("</P></TI></TITLE><ENACTING.TERMS><DIVISION><TITLE><TI>CHAPTER I</TI><STI>General</STI></TITLE><ARTICLE><TI.ART>Article 1</TI.ART>"), F.col("p"),
        F.lit("<TBL><CORPUS><ROW><CELL>id</CELL><CELL>text</CELL></ROW>"), F.col("r"), F.lit("</CORPUS></TBL></ARTICLE></DIVISION></ENACTING.TERMS></ACT>"),
    )
    acts = made.select("doc_id", F.lit("act").alias("format"), xml.alias("content"), F.lit(None).cast("string").alias("ref"))
    return convert.convert(acts, ["doc_id"]).select("doc_id", "markdown")


def _wrapped(spark: SparkSession, d: str, format_: str, head: str | Column, item: str, tail: str, ref: str | None = None) -> DataFrame:
    key = F.struct("ord", "note_id", "text")
    items = assemble.ordered_join(key, F.expr(item.replace("{t}", ESC.format(x="text"))), "")
    made = table(spark, d, "notes").groupBy("doc_id").agg(items.alias("i")).select("doc_id", F.lit(format_).alias("format"), F.concat(F.lit(head) if isinstance(head, str) else head, "i", F.lit(tail)).alias("content"), F.lit(ref).alias("ref"))
    return convert.convert(made, ["doc_id"]).select("doc_id", "markdown")


S_NOTE = f"n as (select doc_id, ord, note_id, trim(regexp_replace(text, {q(P.WS + '+')}, ' ', 'g')) as t from notes)"


@query(f"with {S_NOTE} select doc_id, '# Ruling' || chr(10) || chr(10) || '### Section' || chr(10) || chr(10) || string_agg((ord + 1) || '. ' || t || chr(10) || chr(10) || 'kop ' || note_id || chr(10) || chr(10) || note_id, chr(10) || chr(10) order by ord, note_id, t) || chr(10) as markdown from n group by doc_id")
def ruling_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Dutch rulings made of the notes: number cells before paragraphs in a section."""
    return _wrapped(spark, d, "ruling", "<r><Description><title>Ruling</title></Description><uitspraak><section><title>Section</title>", "concat('<nr>', ord + 1, '.</nr><parablock><para>', {t}, '</para></parablock><bridgehead>kop ', note_id, '</bridgehead><list><listitem><para>', note_id, '</para></listitem></list>')", "</section></uitspraak></r>")


@query(f"with {S_NOTE} select doc_id, '# BGH I. Senat — X 1/31' || chr(10) || chr(10) || '## Titel ' || doc_id || chr(10) || chr(10) || '## Gründe' || chr(10) || chr(10) || string_agg((ord + 1) || '. ' || t, chr(10) || chr(10) order by ord, note_id, t) || chr(10) as markdown from n group by doc_id")
def rspdl_blocks(spark: SparkSession, d: str) -> DataFrame:
    """German decisions made of the notes: numbered paragraphs of a definition list, empty sections without heading."""
    head = F.concat(F.lit("<dokument><gertyp>BGH</gertyp><spruchkoerper>I. Senat</spruchkoerper><aktenzeichen>X 1/31</aktenzeichen><titelzeile><dl><dt/><dd><p>Titel "), F.col("doc_id").cast("string"), F.lit("</p></dd></dl></titelzeile><tenor></tenor><gruende>"))
    return _wrapped(spark, d, "german_xml", head, "concat('<dl class=\"RspDL\"><dt>', ord + 1, '</dt><dd><p>', {t}, '</p></dd></dl>')", "</gruende></dokument>")


@query(f"with {S_NOTE} select doc_id, '# Tekst' || chr(10) || chr(10) || string_agg('## I. RECHTSPLEGING' || chr(10) || chr(10) || t, chr(10) || chr(10) order by ord, note_id, t) || chr(10) as markdown from n group by doc_id")
def belgian_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Belgian decisions made of the notes: lines between breaks, Roman headings, a leaked line outside the paragraphs."""
    return _wrapped(spark, d, "belgian", "<table><tr><td>ECLI:BE:CASS:2031:ARR.1</td></tr></table><fieldset><legend title='Tekst'>Tekst van de beslissing</legend><div>leak", "concat('<p>I. RECHTSPLEGING<br>', {t}, '</p>')", "</div></fieldset>")


@query(f"with {S_NOTE} select doc_id, '# Décision' || chr(10) || chr(10) || '## Titre ' || doc_id || chr(10) || chr(10) || string_agg(replace(replace(t, '_', '\\_'), '*', '\\*'), chr(10) || chr(10) order by ord, note_id, t) || chr(10) as markdown from n group by doc_id")
def council_blocks(spark: SparkSession, d: str) -> DataFrame:
    """French constitutional decisions made of the notes: title, full title, original text, and a field that is neither."""
    head = F.concat(F.lit("<h1 class='title'>Décision</h1><div class='field field--name-field-titre-complet field__item'><p>Titre "), F.col("doc_id").cast("string"), F.lit("</p></div><div class='field field--name-field-other'><p>x</p></div><div class='field field--name-field-contenu-original field__item'>"))
    return _wrapped(spark, d, "council", head, "concat('<p>', {t}, '</p>')", "</div>")


@query(f"with {S_NOTE} select doc_id, 'kept' || chr(10) || chr(10) || string_agg(replace(replace(t, '_', '\\_'), '*', '\\*'), chr(10) || chr(10) order by ord, note_id, t) || chr(10) as markdown from n group by doc_id")
def statute_anchor(spark: SparkSession, d: str) -> DataFrame:
    """One chapter of statutes made of the notes, without tools and notices."""
    return _wrapped(spark, d, "statute", "<div id='regeling'><p>all</p><div id='Hoofdstuk1'><div class='bar action--share'>x</div><div class='regeling-toestand-meldingen'>Geldend van 2031</div><span class='visually-hidden'>x</span><div class='transactions'><p>kept</p></div><p>Wijziging(en) zonder datum inwerkingtreding aanwezig.</p>", "concat('<p>', {t}, '</p>')", "</div></div>", "Hoofdstuk1")


@query(f"with {S_NOTE} select doc_id, '# LGX 1 O 2/31' || chr(10) || chr(10) || string_agg((ord + 1) || '. ' || t, chr(10) || chr(10) order by ord, note_id, t) || chr(10) as markdown from n group by doc_id")
def absatz_pairs(spark: SparkSession, d: str) -> DataFrame:
    """German case records (JSON) made of the notes: number spans before paragraphs, the court from the ECLI."""
    key = F.struct("ord", "note_id", "text")
    item = F.expr("concat('<span class=\"absatzRechts\">', ord + 1, '</span><p class=\"absatzLinks\">', " + ESC.format(x="text") + ", '</p>')")
    record = F.to_json(F.struct(F.struct(F.lit("Unknown court").alias("name")).alias("court"), F.lit("1 O 2/31").alias("file_number"), F.lit("ECLI:DE:LGX:2031:1").alias("ecli"), F.col("i").alias("content")))
    made = table(spark, d, "notes").groupBy("doc_id").agg(assemble.ordered_join(key, item, "").alias("i"))
    return convert.convert(made.select("doc_id", F.lit("german_json").alias("format"), record.alias("content"), F.lit(None).cast("string").alias("ref")), ["doc_id"]).select("doc_id", "markdown")


@query(
    f"""with {S_CHUNKS} select doc_id, case when len(c) > 0 then md5({s_strip("list_aggregate(list_filter(list_transform(c, lambda x: regexp_replace(x, ' {2,}', ' ', 'g')), lambda x: x <> ''), 'string_agg', chr(10) || chr(10))")} || chr(10)) end as markdown,
        case when len(c) = 0 then 'nothing_to_clean' end as error from c"""
)
def clean_batch(spark: SparkSession, d: str) -> DataFrame:
    """Documents cleaned chunk by chunk by the offline cleaner and put together again, as digests."""
    done = clean.clean(table(spark, d, "md_documents"), table(spark, d, "profiles"))
    return done.select("doc_id", F.md5("markdown").alias("markdown"), "error")


@query("select doc_id, string_agg(text, chr(10) order by ord, note_id, text) as text from notes group by doc_id")
def stream_fence(spark: SparkSession, d: str) -> DataFrame:
    """Notes of a document in a code fence, cut into pieces of seven characters, the fence taken off while they pass."""
    whole = F.concat(F.lit("```markdown\n"), assemble.ordered_join(F.struct("ord", "note_id", "text"), F.col("text"), "\n"), F.lit("\n```\n"))
    made = table(spark, d, "notes").groupBy("doc_id").agg(whole.alias("t"))
    pieces = made.select("doc_id", F.posexplode(chunk.hard_slices(F.col("t"), F.lit(7))).alias("piece_no", "piece"))
    return fence.strip_pieces(pieces)


# ---------------------------------------------------------------- guards and acquisition


@query(
    f"""with e as (select doc_id, coalesce(source, '') as s, kind, length(coalesce(markdown, '')) as n from md_documents), u as (select *, regexp_extract(s, '(https?://.*)$', 1) as url, case doc_id % 4 when 0 then 'caselaw' when 1 then 'obsidian' when 2 then 'x' end as p,
        case doc_id % 5 when 0 then '' when 1 then ' https://m.example/v1/chat/completions ' when 2 then 'https://m.example/v1//' when 3 then 'https://m.example/completions' end as base, case doc_id % 3 when 0 then 'Unknown court' when 1 then ' ' else 'Hof' end as court, string_split(s, ' • ')[2] as ident from e)
    select doc_id, regexp_matches(url, '(?i)^https?://') as web, case when p in ('generic', 'caselaw', 'obsidian') then p else 'generic' end as profile, case when kind = 'caselaw' then 'caselaw' else 'generic' end as proposed,
        case when coalesce(base, '') = '' then 'https://default.example/v1' when doc_id % 5 = 1 then 'https://m.example/v1' when doc_id % 5 = 2 then 'https://m.example/v1' else 'https://m.example' end as base,
        coalesce(lower(regexp_extract(s, '(\\.[^.]+)$', 1)) in ({', '.join(map(q, P.DECLARED))}), false) as declared, case when court = 'Hof' then court else nullif(string_split(coalesce(ident, ''), ':')[3], '') end as court,
        case when n * 10 between 5000 and 190000 then n * 10 else 55000 end::int as chunk_tokens, case when n >= 1000 then (n // 1000) || '.' || lpad((n % 1000)::varchar, 3, '0') else n::varchar end as shown from u"""
)
def request_guards(spark: SparkSession, d: str) -> DataFrame:
    """Checks of addresses, profiles, bases, formats, courts and sizes, over values made from the documents."""
    s = F.coalesce("source", F.lit(""))
    n = F.length(F.coalesce("markdown", F.lit("")))
    k3, k4, k5 = (F.col("doc_id") % k for k in (3, 4, 5))
    profile = F.when(k4 == 0, "caselaw").when(k4 == 1, "obsidian").when(k4 == 2, "x")
    base = F.when(k5 == 0, "").when(k5 == 1, " https://m.example/v1/chat/completions ").when(k5 == 2, "https://m.example/v1//").when(k5 == 3, "https://m.example/completions")
    court = F.when(k3 == 0, "Unknown court").when(k3 == 1, " ").otherwise("Hof")
    return table(spark, d, "md_documents").select(
        "doc_id", R.is_web_url(F.regexp_extract(s, r"(https?://.*)$", 1)).alias("web"), R.profile_or_generic(profile).alias("profile"), estimate.profile_for(F.col("kind")).alias("proposed"), R.base_url(base, "https://default.example/v1").alias("base"),
        R.is_declared_format(s).alias("declared"), R.court(court, F.nullif(F.split_part(s, F.lit(" • "), F.lit(2)), F.lit(""))).alias("court"), chunk.valid_chunk_tokens((n * 10).cast("string")).alias("chunk_tokens"), estimate.shown_number(n).alias("shown"),
    )


#: Texts of landed responses by the digest of their address: none (404), too short, long enough for most, long.
LANDED = ("", "x", "lang " * 12, "lang genoeg " * 10)


def _digest(url: Column) -> Column:
    return F.conv(F.substring(F.md5(url), 1, 4), 16, 10).cast("int")


def _zipped(text: str) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("d.xml"), f"<dokument><gruende><dl class='RspDL'><dt>1</dt><dd><p>{text}</p></dd></dl></gruende></dokument>")
    return out.getvalue()


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each request; French courts that the tables invent become the two that are served, by number."""
    court = F.when(F.col("req_id") % 3 == 0, "FR:CC:").when(F.col("req_id") % 3 == 1, "FR:CCASS:").otherwise("FR:CE:")
    plain = F.when((F.col("req_id") % 3 == 1) & F.contains(F.col("query"), F.lit("FR:CCX:")), F.replace(F.col("query"), F.lit("."), F.lit(""))).otherwise(F.col("query"))
    return assemble.latest_delivery(table(spark, d, "identifiers"), "req_id").withColumn("query", F.replace(plain, F.lit("FR:CCX:"), court))


def _landed(spark: SparkSession, d: str) -> DataFrame:
    """Responses to all look-ups and attempts of the requests, made from digests of their addresses."""
    asked, versions = written(acquire.facts(_asked(spark, d)), "facts"), table(spark, d, "candidates")
    n = _digest(F.col("url"))
    looked = acquire.searches(asked).select("url", "ecli").distinct()
    hit = F.concat(F.lit('{"results":[{"id":"'), n.cast("string"), F.lit('","ecli":"'), F.lower("ecli"), F.lit('"}]}'))
    page = F.when(n % 3 == 0, F.concat(F.lit("<a href='x?doc.id=K"), n.cast("string"), F.lit("&y'>"))).when(n % 3 == 1, acquire.NO_HITS).otherwise("<form>")
    answer = F.when(F.col("url").startswith(acquire.GERMAN_SEARCH), page).when(n % 2 == 0, hit).otherwise('{"results":[]}')
    searched = looked.select("url", F.lit(200).alias("status"), F.encode(answer, "UTF-8").alias("content"))
    plan = acquire.ladder(asked, versions, acquire.found_addresses(asked, searched)).select("url", "format").distinct()
    text = F.element_at(F.array(*map(F.lit, LANDED)), n % 4 + 1)
    forms = {
        "html": ("<p>", "</p>"), "ruling": ("<x><uitspraak><para>", "</para></uitspraak></x>"), "statute": ("<div id='regeling'><div id='Hoofdstuk6'><p>", "</p></div></div>"), "belgian": ("<fieldset><legend>Tekst van de beslissing</legend><div><p>", "</p></div></fieldset>"),
        "council": ("<div class='field--name-field-contenu-original'><p>", "</p></div>"), "cassation": ('{"text":"', '"}'), "german_json": ('{"content":"<p>', '</p>"}'),
    }
    body = F.coalesce(*(F.when(F.col("format") == k, F.encode(F.concat(F.lit(a), text, F.lit(b)), "UTF-8")) for k, (a, b) in forms.items()), F.element_at(F.array(*(F.lit(_zipped(t)) for t in LANDED)), n % 4 + 1))
    return written(searched.unionByName(plan.select("url", F.when(n % 4 == 0, 404).otherwise(200).alias("status"), body.alias("content"))), "responses")


S_UENC = "replace({x}, ':', '%3A')"
S_DIGEST = "('0x' || substr(md5({x}), 1, 4))::int"


@query(
    f"""with l as (select *, row_number() over (partition by req_id order by arrived_at desc, query desc, lang desc nulls last, requested_at desc) as k from identifiers),
    a as (select req_id, {s_strip("coalesce(replace(case when req_id % 3 = 1 and contains(query, 'FR:CCX:') then replace(query, '.', '') else query end, 'FR:CCX:', case req_id % 3 when 0 then 'FR:CC:' when 1 then 'FR:CCASS:' else 'FR:CE:' end), '')")} as query, {S_LANG} as lang from l where k = 1),
    r as (select *, case when query <> '' then coalesce({S_ROUTE}, 'eurlex') end as src, {S_UPPER_ECLI} as ecli, {S_COUNTRY} as land, coalesce({s_celex()}, {S_ELI}) as celex, {S_PATH} as path, nullif(regexp_extract(query, '#(.*)$', 1), '') as part, upper({s_first('query', P.ECLI_EU)}) as eu,
        upper({s_first('query', P.ECLI_ECHR)}) as human, nullif(regexp_extract(query, {q(P.ITEM_ID)}, 1), '') as item, {s_has('query', P.ECLI_FR_COUNCIL)} as council, coalesce({S_UPPER_ECLI} = upper({s_first('query', P.ECLI_FR_CASSATION)}), false) as cassation, {S_ISO} as wanted from a),
    direct as (
        select req_id, 1 as rank, '{acquire.ARCHIVE_ECLI}' || {S_UENC.format(x='eu')} as url, 81 as least, 'EUR-Lex (Cellar) • ' || eu || ' • ' || lang as label, null as part from r where src = 'eurlex' and eu is not null
        union all select req_id, 1, '{acquire.ARCHIVE_CELEX}' || celex, 81, 'EUR-Lex (Cellar) • CELEX:' || celex || ' • ' || lang, null from r where src = 'eurlex' and eu is null and celex is not null
        union all select req_id, 2, 'https://eur-lex.europa.eu/legal-content/' || lang || '/TXT/HTML/?uri=CELEX:' || celex, 1, 'EUR-Lex portal • CELEX:' || celex || ' • ' || lang, null from r where src = 'eurlex' and eu is null and celex is not null
        union all select req_id, 1, 'https://data.rechtspraak.nl/uitspraken/content?id=' || ecli, 40, 'Rechtspraak.nl • ' || ecli, null from r where src = 'rechtspraak' and ecli is not null
        union all select req_id, 1, 'https://wetten.overheid.nl/' || path, 40, 'wetten.overheid.nl • ' || path || coalesce(' #' || part, ''), part from r where src = 'wetten' and path is not null
        union all select req_id, 1, '{acquire.HUMAN_RIGHTS}' || item, 40, 'HUDOC (EHRM) • ' || item, null from r where src = 'hudoc' and human is null and item is not null
        union all select req_id, 1, 'https://juportal.be/content/' || ecli, 40, 'Juportal • ' || ecli, null from r where src = 'national' and land = 'BE' and ecli is not null
        union all select req_id, 1, 'https://www.conseil-constitutionnel.fr/decision/' || regexp_extract(ecli, {q(P.ECLI_FR_COUNCIL)}, 1) || '/' || replace(regexp_extract(ecli, {q(P.ECLI_FR_COUNCIL)}, 2), '.', '') || '.htm', 40, 'Conseil constitutionnel • ' || ecli, null from r where src = 'national' and council),
    v as (select r.req_id, r.human, c.itemid, c.ord, upper(coalesce(c.lang3, '')) as l3, case when upper(coalesce(c.lang3, '')) = r.wanted then 0 when upper(coalesce(c.lang3, '')) = 'ENG' then 1 when upper(coalesce(c.lang3, '')) = 'FRE' then 2 else 3 end as p
        from r join candidates c on upper(c.ecli) = r.human where c.itemid is not null and c.itemid <> ''),
    vb as (select *, row_number() over (partition by req_id, itemid order by p, ord, l3) as k from v),
    human as (select req_id, row_number() over (partition by req_id order by p, ord, itemid) as rank, '{acquire.HUMAN_RIGHTS}' || itemid as url, 40 as least, 'HUDOC (EHRM) • ' || itemid || ' • ' || human as label, null as part from vb where k = 1),
    asked as (
        select req_id, 1 as rank, 'api' as w, '{acquire.GERMAN_API}?ecli=' || {S_UENC.format(x='ecli')} as url, ecli from r where src = 'national' and land = 'DE' union all select req_id, 2, 'page', '{acquire.GERMAN_SEARCH}' || {S_UENC.format(x='ecli')}, ecli from r where src = 'national' and land = 'DE'
        union all select req_id, 1, 'french', '{acquire.CASSATION_API}search?query=' || {S_UENC.format(x='ecli')}, ecli from r where cassation),
    dug as (select *, {S_DIGEST.format(x='url')} as n from asked where url is not null),
    led as (
        select req_id, rank, case w when 'api' then '{acquire.GERMAN_API}' || n || '/' when 'page' then '{acquire.GERMAN_ZIP}K' || n || '.zip' else '{acquire.CASSATION_API}decision?id=' || n end as url, 40 as least,
            case w when 'api' then 'OpenLegalData' when 'page' then 'rechtsprechung-im-internet.de' else 'Judilibre' end || ' • ' || ecli as label, null as part from dug where case w when 'page' then n % 3 = 0 else n % 2 = 0 end),
    t as (select *, {S_DIGEST.format(x='url')} % 4 as h from (select * from direct union all select * from human union all select * from led)),
    o as (select *, case when h = 0 then 'status_404' when part is not null and part <> 'Hoofdstuk6' then 'not_found' when h < case least when 81 then 3 when 40 then 2 else 1 end then 'too_short' end as error from t),
    b as (select req_id, min(rank) filter (where error is null) as best, arg_max(error, rank) filter (where error is not null) as why from o group by req_id)
    select r.req_id, b.best::int as rank, o.label as source, case when o.label is null then null when starts_with(o.label, 'Rechtspraak.nl') or starts_with(o.label, 'HUDOC') or contains(o.label, 'CELEX:6') or {s_has('o.label', 'ECLI:[A-Z]{2}:')} then 'caselaw' else 'document' end as kind,
        case when o.label is null then coalesce(case when r.query = '' then 'missing_query' when src = 'national' and land = 'FR' and not council and not cassation then 'court_not_served'
            when src = 'eurlex' and eu is null and celex is null or src in ('rechtspraak', 'national') and ecli is null or src = 'wetten' and path is null or src = 'hudoc' and human is null and item is null then 'no_identifier' end, b.why, 'not_found') end as error
    from r left join b on b.req_id = r.req_id left join o on o.req_id = r.req_id and o.rank = b.best and o.error is null"""
)
def acquire_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The document each request gets from landed responses: which attempt, its label and kind, or why there is none."""
    done = acquire.documents(_asked(spark, d), table(spark, d, "candidates"), _landed(spark, d))
    return done.select("req_id", "rank", "source", "kind", "error")


S_PARTS = """select req_id, '# Part ' || rank || chr(10) || chr(10) || ident as part, rank, coalesce(status, 0) as status from (select *, row_number() over (partition by req_id, rank order by arrived_at desc, status desc, text desc) as k from attempts) where k = 1"""


@query(f"select req_id, string_agg(case when status = 200 then part end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as markdown from ({S_PARTS.replace('|| ident as part', '|| ident || chr(10) as part')}) group by req_id")
def archive_parts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of several parts: a page of choices made of the attempts of each request, its parts fetched and joined."""
    last = F.max_by(F.struct("status", "text", "ident"), F.struct(F.col("arrived_at"), F.col("status"), F.col("text"))).alias("p")
    parts = table(spark, d, "attempts").groupBy("req_id", "rank").agg(last).select("req_id", "rank", "p.status", "p.ident")
    address = F.concat(F.lit("http://publications.europa.eu/resource/cellar/"), F.col("req_id").cast("string"), F.lit("/DOC_"), F.col("rank").cast("string"))
    link = F.concat(F.lit('<li><a href="'), address, F.lit('">'))
    pages = parts.groupBy("req_id").agg(assemble.ordered_join(F.col("rank"), link, "").alias("html"))
    url = F.concat(F.lit("http://x.example/"), F.col("req_id").cast("string"))
    made = F.concat(F.lit("<h1>Part "), F.col("rank").cast("string"), F.lit("</h1><p>"), F.col("ident"))
    landed = pages.select(url.alias("url"), F.lit(300).alias("status"), F.encode("html", "UTF-8").alias("content")).unionByName(parts.select(address.alias("url"), F.coalesce("status", F.lit(0)).alias("status"), F.encode(made, "UTF-8").alias("content")))
    none = F.lit(None).cast("string")
    plan = pages.select("req_id", F.lit(1).alias("rank"), url.alias("url"), F.lit("html").alias("format"), none.alias("ref"), F.lit(1).alias("least"), F.lit("label").alias("label"))
    return acquire.tried(plan, landed).select("req_id", "markdown")


@query(
    """with n as (select req_id, rank, case when status is null then 202 when status = 200 then 200 else 202 end as status, row_number() over (partition by req_id order by rank, arrived_at, status) as n from attempts),
    f as (select req_id, min(n) filter (where status <> 202) as a, max(n) as z from n where n <= 2 group by req_id)
    select 'http://x.example/' || f.req_id as url, n.status, coalesce(a, z)::int as tries from f join n on n.req_id = f.req_id and n.n = coalesce(a, z)"""
)
def portal_poll(spark: SparkSession, d: str) -> DataFrame:
    """What polling came to within two tries, with the attempts of each request as tries."""
    by = Window.partitionBy("req_id").orderBy("rank", "arrived_at", F.col("status").asc_nulls_last())
    tries = table(spark, d, "attempts").select(F.concat(F.lit("http://x.example/"), F.col("req_id").cast("string")).alias("url"), F.row_number().over(by).alias("try_no"), F.when(F.col("status") == 200, 200).otherwise(202).alias("status"))
    return acquire.poll_outcome(tries, 2)


@query(
    f"""with n as (select doc_id, ord, note_id, trim(regexp_replace(text, {q(P.WS + '+')}, ' ', 'g')) as t from notes), l as (select doc_id, string_agg('| ' || note_id || ' | ' || replace(t, '|', '\\|') || ' |', chr(10) order by ord, note_id, t) as rows from n group by doc_id)
    select doc_id, ext, case ext when '.csv' then 'Data • f' || doc_id || '.csv' when '.json' then 'Data • f' || doc_id || '.json' else 'f' || doc_id || ext end as source, case when ext in ('.csv', '.json') then '| note_id | text |' || chr(10) || '| --- | --- |' || chr(10) || rows || chr(10) end as markdown,
        case ext when '.pdf' then 'unknown_format' when '.zzz' then 'undeclared_format' end as error from l, (values ('.csv'), ('.json'), ('.pdf'), ('.zzz')) as e(ext)"""
)
def file_formats(spark: SparkSession, d: str) -> DataFrame:
    """Data files made of the notes of a document as tables, and files no engine here can read."""
    key = F.struct("ord", "note_id", "text")
    quoted = F.concat(F.lit('"'), F.col("note_id"), F.lit('","'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    made = table(spark, d, "notes").groupBy("doc_id").agg(assemble.ordered_join(key, quoted, "\n").alias("csv"), F.to_json(F.transform(F.array_sort(F.collect_list(key)), lambda x: F.struct(x["note_id"].alias("note_id"), x["text"].alias("text")))).alias("json"))
    kinds = F.explode(F.array(*(F.struct(F.lit(e).alias("ext"), c.alias("body")) for e, c in ((".csv", F.concat(F.lit("note_id,text\n"), "csv")), (".json", F.col("json")), (".pdf", F.lit("%PDF")), (".zzz", F.lit("z"))))))
    files = made.select("doc_id", kinds.alias("k")).select(F.concat(F.col("doc_id").cast("string"), "k.ext").alias("path"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), "k.ext").alias("filename"), F.encode("k.body", "UTF-8").alias("content"))
    rows = convert.file_documents(files.select("path", "filename", convert.format_of(F.col("filename"), F.col("content")).alias("format"), "content", F.lit(None).cast("string").alias("ref")))
    number = F.regexp_extract("path", r"^(\d+)", 1).cast("long")
    return rows.select(number.alias("doc_id"), F.regexp_extract("path", r"(\.\w+)$", 1).alias("ext"), "source", "markdown", "error")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Requests routed, their first useful attempt, its text tidied and chunked, with tokens by source."""
    routed = convert.route_requests(assemble.latest_delivery(table(spark, d, "identifiers"), "req_id"))
    text = assemble.first_useful(table(spark, d, "attempts")).select("req_id", T.tidy(F.col("text")).alias("markdown"))
    parts = routed.join(text, "req_id", "left").withColumn("chunks", F.size(chunk.chunks_for(F.coalesce("markdown", F.lit("")), F.lit(6000), F.lit(False))))
    return parts.groupBy("source").agg(F.count("*").alias("requests"), F.count("markdown").alias("found"), F.sum("chunks").alias("chunks"), F.sum(F.coalesce(T.token_estimate(F.col("markdown")), F.lit(0))).alias("tokens"))


QUERIES["flagship"] = flagship
SQL["flagship"] = f"""with o as (select *, row_number() over (partition by req_id order by arrived_at desc, query desc, lang desc nulls last, requested_at desc) as k from identifiers),
    r as (select req_id, case when {s_strip("coalesce(query, '')")} <> '' then coalesce({S_ROUTE}, 'eurlex') end as source from o where k = 1),
    u as (select *, row_number() over (partition by req_id order by rank, attempted_at, ident, text) as k from attempts where status = 200 and length({s_strip("coalesce(text, '')")}) >= 40),
    t as (select req_id, {s_tidy('text')} as m from u where k = 1)
    select source, count(*)::bigint as requests, count(m)::bigint as found, sum(case when m is null then 0 else 1 end)::bigint as chunks, sum(coalesce(length(m) // 4, 0))::bigint as tokens from r left join t on t.req_id = r.req_id group by source"""
