"""Identifiers, routing and classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions.text import let, strip


def _has(x: Column, pattern: str) -> Column:
    return x.rlike(f"(?i){pattern}")


def _first(x: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(x, f"(?i){pattern}", group), F.lit(""))


def country(query: Column) -> Column:
    """Country of the first ECLI, upper case; null without one."""
    return F.upper(_first(query, P.ECLI_COUNTRY, 1))


#: Country of an ECLI → the source that serves it. Extend with `register_source`.
NATIONAL: dict[str, str] = {"DE": "german", "BE": "belgian", "FR": "french"}


def register_source(country_code: str, source: str) -> None:
    """Serves the ECLIs of a further country by a source."""
    NATIONAL[country_code.upper()] = source


def national_source(query: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in sorted(NATIONAL.items()) for v in pair)), country(query))


def route(query: Column) -> Column:
    """Source of a request; null for the union's own legislation and case law. The order of the tests is part of the meaning."""
    return let(strip(query), _route)


def _route(q: Column) -> Column:
    low, ecli = F.lower(q), _has(q, P.ECLI)
    return (
        F.when(_has(q, P.ECLI_ECHR) | F.contains(low, F.lit("hudoc.echr.coe.int")), "hudoc")
        .when(F.contains(low, F.lit("wetten.overheid.nl")) | _has(q, P.STATUTE), "wetten")
        .when(q.rlike(P.ITEM_ID) & ~F.contains(low, F.lit("rechtspraak")) & ~ecli, "hudoc")
        .when(F.contains(low, F.lit("rechtspraak.nl")) | _has(q, "ECLI:NL:"), "rechtspraak")
        .when(national_source(q).isNotNull(), "national")
    )


def celex(text: Column) -> Column:
    """CELEX number of a bare identifier, of the query of a URL, or of its path."""
    return let(strip(text), _celex)


def _celex(t: Column) -> Column:
    query = F.regexp_extract(t, r"\?([^#]*)", 1)

    def parameter(name: str) -> Column:
        raw = F.nullif(F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1), F.lit(""))
        return F.coalesce(F.try_url_decode(raw), raw)

    def from_value(v: Column) -> Column:
        return F.when(_has(v, P.CELEX_NAMED), F.coalesce(_first(v, f"({P.CELEX})", 1), v)).when(_has(v, f"^{P.CELEX}$"), v)

    labelled = _first(t, P.CELEX_BEHIND_NAME, 1)
    return F.upper(
        F.coalesce(
            F.when(_has(t, f"^{P.CELEX}$"), t),
            *(from_value(parameter(n)) for n in ("uri", "CELEX", "celex")),
            F.when(_has(labelled, f"^{P.CELEX}$"), labelled),
            _first(t, f"/({P.CELEX_CORE})", 1),
        )
    )


def eli_to_celex(text: Column) -> Column:
    """CELEX number of an ELI; null for a type of act without a letter."""
    letters = F.create_map(*(F.lit(v) for pair in P.ELI_LETTERS.items() for v in pair))
    letter = F.try_element_at(letters, F.lower(_first(text, P.ELI, 1)))
    number = F.regexp_replace(_first(text, P.ELI, 3), "^0+(?=[0-9])", "")
    padded = F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0"))
    return F.concat(F.lit("3"), _first(text, P.ELI, 2), letter, padded)


def kind_for_source(source: Column) -> Column:
    """`caselaw` or `document`, from the label of a document."""
    s = F.coalesce(source, F.lit(""))
    case = s.startswith("Rechtspraak.nl") | s.startswith("HUDOC") | F.contains(s, F.lit("ECLI:EU:")) | F.contains(s, F.lit("CELEX:6")) | _has(s, "ECLI:[A-Z]{2}:")
    return F.when(case, "caselaw").otherwise("document")


def engine_of(source: Column) -> Column:
    """What stands before the first bullet of a label."""
    return F.substring_index(source, " • ", 1)


def download_name(query: Column) -> Column:
    """Name of a download, from the identifier in a request."""
    item = F.nullif(F.regexp_extract(query, r"\b(00[0-9]-[0-9]{3,})\b", 1), F.lit(""))
    return F.coalesce(
        F.replace(_first(query, P.ECLI), F.lit(":"), F.lit("-")),
        F.upper(_first(query, P.STATUTE)),
        F.concat(F.lit("HUDOC-"), item),
        F.upper(_first(query, f"({P.CELEX_CORE})", 1)),
        F.lit("document"),
    )


def statute_path(query: Column) -> Column:
    """Number of a statute, with the date of its version if one is asked for."""
    date = F.nullif(F.regexp_extract(query, P.ISO_DATE, 0), F.lit(""))
    return F.concat(F.upper(_first(query, P.STATUTE)), F.coalesce(F.concat(F.lit("/"), date), F.lit("")))


def source_url(query: Column, lang: Column, found: Column | None = None) -> Column:
    """Where a request is fetched from; null where the source needs a search first. found: what `route` says, if it is known."""
    return let(F.struct(strip(query).alias("q"), lang.alias("lang"), (route(query) if found is None else found).alias("found")), _source_url)


def _source_url(given: Column) -> Column:
    q, lang, found = given["q"], given["lang"], given["found"]
    ecli = F.upper(_first(q, P.ECLI))
    council = F.concat(
        F.lit("https://www.conseil-constitutionnel.fr/decision/"), _first(ecli, P.ECLI_FR_COUNCIL, 1), F.lit("/"), F.replace(_first(ecli, P.ECLI_FR_COUNCIL, 2), F.lit("."), F.lit("")), F.lit(".htm")
    )
    language = F.upper(F.coalesce(F.nullif(strip(lang), F.lit("")), F.lit("NL")))
    return (
        F.when(found == "rechtspraak", F.concat(F.lit("https://data.rechtspraak.nl/uitspraken/content?id="), ecli))
        .when(found == "wetten", F.concat(F.lit("https://wetten.overheid.nl/"), statute_path(q)))
        .when((found == "national") & (country(q) == "BE"), F.concat(F.lit("https://juportal.be/content/"), ecli))
        .when((found == "national") & (country(q) == "FR"), council)
        .when(found.isNull() & _has(q, P.ECLI_EU), F.concat(F.lit("http://publications.europa.eu/resource/ecli/"), F.url_encode(F.upper(_first(q, P.ECLI_EU)))))
        .when(found.isNull(), F.concat(F.lit("https://eur-lex.europa.eu/legal-content/"), language, F.lit("/TXT/HTML/?uri=CELEX:"), F.coalesce(eli_to_celex(q), celex(q))))
    )


def court(name: Column, ecli: Column) -> Column:
    """Court of a case: its name, or the third part of its ECLI if the name is blank or unknown."""
    given = F.when(~(strip(F.coalesce(name, F.lit(""))).isin("", "Unknown court")), name)
    return F.coalesce(given, F.nullif(F.split_part(F.coalesce(ecli, F.lit("")), F.lit(":"), F.lit(3)), F.lit("")))


def looks_like_structured_xml(content: Column) -> Column:
    """Whether bytes begin like a structured legal act: a tag early, and one of its names in the first 8000 bytes."""
    head = F.decode(F.substring(content, 1, 8000), "ISO-8859-1")
    upper = F.translate(head, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    named = F.lit(False)
    for mark in P.STRUCTURED_XML:
        named = named | F.contains(upper, F.lit(mark))
    return F.contains(F.substring(head, 1, 200), F.lit("<")) & named


def is_web_url(url: Column) -> Column:
    return url.rlike("(?i)^https?://")


def profile_or_generic(profile: Column) -> Column:
    return F.when(profile.isin("generic", "caselaw", "obsidian"), profile).otherwise("generic")


def base_url(url: Column, default: str) -> Column:
    """An API's base: stripped, without slashes and known endings."""
    base = F.regexp_replace(strip(F.coalesce(F.nullif(url, F.lit("")), F.lit(default))), "/+$", "")
    return F.regexp_replace(F.regexp_replace(base, r"/chat/completions$", ""), r"/completions$", "")


def is_declared_format(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^.]+)$", 1)).isin(*P.DECLARED)
