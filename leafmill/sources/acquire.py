"""Acquisition as a plan over landed responses: for each request a ladder of attempts, the first useful one wins.

Nothing here opens a connection. `searches` lists the addresses of look-ups, `ladder` those of documents; a connector
(`convert.fetch`) or an archive lands their responses as a table (url, status, content), and `documents` reads the
document of each request from that table. A source that needs a search first has its address from the landed search.

An attempt is a row (req_id, rank, url, format, ref, least, label): the address, the parser of its content, the anchor or
number the parser needs, the least length of a useful text, and the label of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions import route as R
from leafmill.functions.text import anchor, strip
from leafmill.operators.assemble import ordered_join, rank_candidates
from leafmill.session import written
from leafmill.sources.convert import convert, part_links, route_requests

#: Least characters of a useful text, and of one from the archive (fixed values); the portal's text counts if it has any.
USEFUL, USEFUL_ARCHIVE = 40, 81
#: Addresses (fixed values).
ARCHIVE_CELEX, ARCHIVE_ECLI = "http://publications.europa.eu/resource/celex/", "http://publications.europa.eu/resource/ecli/"
HUMAN_RIGHTS = "https://hudoc.echr.coe.int/app/conversion/docx/html/body?library=ECHR&id="
GERMAN_API, GERMAN_ZIP = "https://de.openlegaldata.io/api/cases/", "https://www.rechtsprechung-im-internet.de/jportal/docs/bsjrs/"
GERMAN_SEARCH = "https://www.rechtsprechung-im-internet.de/jportal/portal/page/bsjrsprod.psml/js_pane/Suchportlet1/media-type/html?standardsuche=suchen&query="
CASSATION_API = "https://api.piste.gouv.fr/cassation/judilibre/v1.0/"
#: What the German search says when it found nothing (fixed value).
NO_HITS = "0 Treffer"
BULLET = " • "
ATTEMPT = ("req_id", "rank", "url", "format", "ref", "least", "label")


def _ecli(query: Column, pattern: str = P.ECLI) -> Column:
    return F.upper(F.nullif(F.regexp_extract(query, f"(?i){pattern}", 0), F.lit("")))


def facts(requests: DataFrame) -> DataFrame:
    """Requests with their source, address and all identifiers in them; every other step reads these columns."""
    q = F.col("query")
    return route_requests(requests).select(
        "*",
        _ecli(q).alias("ecli"),
        R.country(q).alias("land"),
        F.coalesce(R.celex(q), R.eli_to_celex(q)).alias("celex"),
        _ecli(q, P.ECLI_EU).alias("union"),
        _ecli(q, P.ECLI_ECHR).alias("human"),
        _ecli(q, P.ECLI_FR_COUNCIL).alias("council"),
        F.when(_ecli(q) == _ecli(q, P.ECLI_FR_CASSATION), _ecli(q)).alias("cassation"),
        F.nullif(F.regexp_extract(q, P.ITEM_ID, 1), F.lit("")).alias("item"),
        R.statute_path(q).alias("path"),
        anchor(q).alias("part"),
    )


def request_headers(url: Column, lang: Column) -> Column:
    """Headers of a request by its address: the archive gives text only when asked for it, and parts only as HTML."""
    accept = F.when(F.contains(url, F.lit("/resource/cellar/")), "text/html").when(F.contains(url, F.lit("publications.europa.eu/resource/")), "application/xhtml+xml, text/html;q=0.9")
    return F.when(accept.isNotNull(), F.create_map(F.lit("Accept"), accept, F.lit("Accept-Language"), F.lower(lang)))


def searches(known: DataFrame) -> DataFrame:
    """(req_id, ecli, step, url): the look-ups that national sources need before a document has an address. known: rows of `facts`."""
    ecli = F.col("ecli")
    german = F.array(F.concat(F.lit(GERMAN_API + "?ecli="), F.url_encode(ecli)), F.concat(F.lit(GERMAN_SEARCH), F.url_encode(ecli)))
    french = F.array(F.concat(F.lit(CASSATION_API + "search?query="), F.url_encode("cassation")))
    needed = F.when((F.col("source") == "national") & (F.col("land") == "DE"), german).when(F.col("cassation").isNotNull(), french)
    return known.where("error is null").select("req_id", "ecli", F.posexplode(needed).alias("step", "url"))


def found_addresses(known: DataFrame, responses: DataFrame) -> DataFrame:
    """(req_id, step, found, outcome): the address each look-up leads to; outcome `none` is an answer, `retry` is not one.

    A page of the German search without a hit and without its own words for that is no answer: ask again.
    """
    body = F.col("content").cast("string")
    first_case = F.get(F.from_json(body, "results array<struct<id:string>>")["results"], F.lit(0))["id"]
    decisions = F.from_json(body, "results array<struct<id:string,ecli:string>>")["results"]
    exact = F.get(F.filter(decisions, lambda d: F.upper(d["ecli"]) == F.col("ecli")), F.lit(0))["id"]
    document = F.nullif(F.regexp_extract(body, r"doc\.id=([\w-]+)", 1), F.lit(""))
    answered = searches(known).join(responses.select("url", "status", "content"), "url", "left")
    german = F.col("url").startswith(GERMAN_SEARCH)
    found = F.when(F.col("status") != 200, None).when(german, F.concat(F.lit(GERMAN_ZIP), document, F.lit(".zip"))).when(F.col("url").startswith(GERMAN_API), F.concat(F.lit(GERMAN_API), first_case, F.lit("/"))).otherwise(F.concat(F.lit(CASSATION_API + "decision?id="), exact))
    outcome = F.when(found.isNotNull(), "found").when(F.col("status").isNull() | (F.col("status") != 200) | german & ~F.contains(body, F.lit(NO_HITS)), "retry").otherwise("none")
    return answered.select("req_id", "step", found.alias("found"), outcome.alias("outcome"))


def ladder(known: DataFrame, candidates: DataFrame, found: DataFrame) -> DataFrame:
    """All attempts of all requests, best first.

    candidates: language versions of human-rights decisions (ecli, ord, itemid, lang3); found: rows of `found_addresses`.
    """
    routed = known.where("error is null")
    source, lang, ecli, celex, union, item, part, direct_url = (F.col(c) for c in ("source", "lang", "ecli", "celex", "union", "item", "part", "url"))
    archive, portal = "EUR-Lex (Cellar)", "EUR-Lex portal"

    def attempt(url: Column, format_: str, least: int, *label: Column | str, ref: Column | None = None) -> Column:
        parts = [F.lit(x) if isinstance(x, str) else x for x in label]
        return F.struct(url.alias("url"), F.lit(format_).alias("format"), (F.lit(None).cast("string") if ref is None else ref).alias("ref"), F.lit(least).alias("least"), F.concat_ws(BULLET, *parts).alias("label"))

    by_celex = F.array(
        attempt(F.concat(F.lit(ARCHIVE_CELEX), celex), "html", USEFUL_ARCHIVE, archive, F.concat(F.lit("CELEX:"), celex), lang),
        attempt(F.concat(F.lit("https://eur-lex.europa.eu/legal-content/"), lang, F.lit("/TXT/HTML/?uri=CELEX:"), celex), "html", 1, portal, F.concat(F.lit("CELEX:"), celex), lang),
    )
    statute = F.concat_ws(" ", F.concat(F.lit("wetten.overheid.nl" + BULLET), F.col("path")), F.concat(F.lit("#"), part))
    plan = (
        F.when((source == "eurlex") & union.isNotNull(), F.array(attempt(F.concat(F.lit(ARCHIVE_ECLI), F.url_encode(union)), "html", USEFUL_ARCHIVE, archive, union, lang)))
        .when((source == "eurlex") & celex.isNotNull(), by_celex)
        .when((source == "rechtspraak") & ecli.isNotNull(), F.array(attempt(direct_url, "ruling", USEFUL, "Rechtspraak.nl", ecli, ref=ecli)))
        .when((source == "wetten") & F.col("path").isNotNull(), F.array(attempt(direct_url, "statute", USEFUL, statute, ref=part)))
        .when((source == "hudoc") & F.col("human").isNull() & item.isNotNull(), F.array(attempt(F.concat(F.lit(HUMAN_RIGHTS), item), "html", USEFUL, "HUDOC (EHRM)", item)))
        .when((source == "national") & (F.col("land") == "BE") & ecli.isNotNull(), F.array(attempt(direct_url, "belgian", USEFUL, "Juportal", ecli, ref=ecli)))
        .when((source == "national") & F.col("council").isNotNull(), F.array(attempt(direct_url, "council", USEFUL, "Conseil constitutionnel", ecli)))
    )
    direct = routed.select("req_id", F.posexplode(plan).alias("rank", "a")).select("req_id", (F.col("rank") + 1).alias("rank"), "a.*")
    asked = routed.select("req_id", F.col("human").alias("ecli"), "lang").where("ecli is not null")
    versions = rank_candidates(candidates, asked).join(asked.select("req_id", "ecli"), "req_id")
    human = versions.select("req_id", F.col("place").alias("rank"), attempt(F.concat(F.lit(HUMAN_RIGHTS), F.col("itemid")), "html", USEFUL, "HUDOC (EHRM)", F.col("itemid"), ecli).alias("a")).select("req_id", "rank", "a.*")
    led = found.where("found is not null").join(routed.select("req_id", "ecli"), "req_id")
    looked = F.when(F.col("found").startswith(CASSATION_API), attempt(F.col("found"), "cassation", USEFUL, "Judilibre", ecli)).when(F.col("found").startswith(GERMAN_API), attempt(F.col("found"), "german_json", USEFUL, "OpenLegalData", ecli)).otherwise(attempt(F.col("found"), "german_zip", USEFUL, "rechtsprechung-im-internet.de", ecli))
    searched = led.select("req_id", (F.col("step") + 1).alias("rank"), looked.alias("a")).select("req_id", "rank", "a.*")
    return direct.unionByName(human).unionByName(searched).select(*ATTEMPT)


def unroutable(known: DataFrame) -> DataFrame:
    """(req_id, error) of requests that no source can serve."""
    source, ecli = F.col("source"), F.col("ecli")
    french = (source == "national") & (F.col("land") == "FR") & F.col("council").isNull() & F.col("cassation").isNull()
    nothing = (source == "eurlex") & F.coalesce("union", "celex").isNull() | source.isin("rechtspraak", "national") & ecli.isNull() | (source == "wetten") & F.col("path").isNull() | (source == "hudoc") & F.coalesce("human", "item").isNull()
    return known.select("req_id", F.coalesce("error", F.when(french, "court_not_served").when(nothing, "no_identifier")).alias("error")).where("error is not null")


def part_addresses(attempts: DataFrame, responses: DataFrame) -> DataFrame:
    """(req_id, rank, part, url) of the parts named by pages of choices (status 300)."""
    pages = attempts.join(responses.where("status = 300").select("url", F.col("content").cast("string").alias("html")), "url")
    return pages.select("req_id", "rank", F.posexplode(part_links(F.col("html"))).alias("part", "url"))


def tried(attempts: DataFrame, responses: DataFrame) -> DataFrame:
    """Attempts with (markdown, label, error) from the landed responses; an attempt without a response is `no_response`.

    A page of choices stands for its parts, those that came, in order, between rules; one without links says that the
    document is not there in the language, which ends the ladder (`stops`).
    """
    landed = responses.groupBy("url").agg(F.max(F.struct(F.when(F.col("status").isin(200, 300), 1).otherwise(0).alias("k"), "status", "content")).alias("r"))
    landed = landed.select("url", "r.status", F.col("r.content").cast("binary").alias("content"))
    parts = part_addresses(attempts, landed)
    pieces = convert(parts.join(landed.where("status = 200"), "url").select("req_id", "rank", "part", F.lit("html").alias("format"), "content", F.lit(None).cast("string").alias("ref")), ["req_id", "rank", "part"])
    whole = pieces.where("markdown is not null").groupBy("req_id", "rank").agg(ordered_join(F.col("part"), F.col("markdown"), "\n\n---\n\n").alias("joined"))
    links = parts.groupBy("req_id", "rank").agg(F.count("*").alias("links"))
    met = attempts.join(landed, "url", "left")
    single = convert(met.where("status = 200").select("req_id", "rank", "format", "content", "ref"), ["req_id", "rank"], least=0)
    rows = met.drop("content").join(single.select("req_id", "rank", "markdown", "canonical", F.col("error").alias("broken")), ["req_id", "rank"], "left").join(whole, ["req_id", "rank"], "left").join(links, ["req_id", "rank"], "left")
    text = F.coalesce("joined", "markdown")
    language = (F.col("status") == 300) & F.col("links").isNull()
    error = (
        F.when(F.col("status").isNull(), "no_response")
        .when(language, "not_in_language")
        .when(~F.col("status").isin(200, 300), F.concat(F.lit("status_"), F.col("status").cast("string")))
        .when(F.col("broken").isNotNull(), F.col("broken"))
        .when(text.isNull() | (F.length(strip(text)) < F.col("least")), "too_short")
    )
    replaced = F.when(F.col("canonical") != F.col("ref"), F.concat(F.lit("Juportal" + BULLET), F.col("canonical"), F.lit(" (vervangt "), F.col("ref"), F.lit(")"))).otherwise(F.col("label"))
    return rows.select("req_id", "rank", "url", F.when(F.col("format") == "belgian", replaced).otherwise(F.col("label")).alias("label"), text.alias("markdown"), error.alias("error"), language.alias("stops"))


def documents(requests: DataFrame, candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """(req_id, rank, markdown, source, kind, error): the first useful attempt of each request, else why there is none.

    Texts do not pass through the choice: ranks and errors are aggregated, and the winner's text is joined by its rank.
    Identifiers and conversions are written to the shared folder, as several steps read them.
    """
    known = written(facts(requests), "facts")
    rows = written(tried(ladder(known, candidates, found_addresses(known, responses)), responses), "tried")
    outcome = F.struct("rank", "error")
    chosen = rows.groupBy("req_id").agg(
        F.min(F.when(F.col("error").isNull(), F.col("rank"))).alias("best"), F.min(F.when(F.col("stops"), F.col("rank"))).alias("stop"), F.max(F.when(F.col("error").isNotNull(), outcome)).alias("last")
    )
    stopped = F.coalesce(F.col("stop") < F.col("best"), F.lit(False))
    ruled = chosen.select("req_id", F.when(~stopped, F.col("best")).alias("rank"), F.when(F.col("best").isNull() | stopped, F.coalesce(F.when(F.col("stop").isNotNull(), "not_in_language"), F.col("last.error"))).alias("why"))
    asked = known.select("req_id").join(unroutable(known).withColumnRenamed("error", "cannot"), "req_id", "left")
    texts = rows.where("error is null").select("req_id", "rank", "markdown", "label")
    done = asked.join(ruled, "req_id", "left").join(texts, ["req_id", "rank"], "left")
    return done.select("req_id", "rank", "markdown", F.col("label").alias("source"), F.when(F.col("label").isNotNull(), R.kind_for_source(F.col("label"))).alias("kind"), F.when(F.col("label").isNull(), F.coalesce("cannot", "why", F.lit("not_found"))).alias("error"))


def poll_outcome(polls: DataFrame, attempts: int = 6) -> DataFrame:
    """(url, status, tries): what a page that is still being made (202) came to within so many tries.

    polls: (url, try_no, status). The first other answer ends it; 202 at the last try stays 202.
    """
    ordered = F.row_number().over(Window.partitionBy("url").orderBy("try_no"))
    within = polls.select("url", "status", ordered.alias("n")).where(F.col("n") <= attempts)
    first = within.groupBy("url").agg(F.min(F.when(F.col("status") != 202, F.struct("n", "status"))).alias("a"), F.max(F.struct("n", "status")).alias("z"))
    return first.select("url", F.coalesce("a.status", "z.status").alias("status"), F.coalesce("a.n", "z.n").alias("tries"))
