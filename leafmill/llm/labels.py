"""Language labels in any usual spelling → codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and codes of the languages, lower case (fixed values).
SPELLINGS = {
    "nl": ("nl", "nld", "dut", "nederlands", "dutch", "niederländisch", "néerlandais", "neerlandais", "neerlandés", "neerlandes", "holandés", "vlaams", "flemish", "hollands"),
    "en": ("en", "eng", "english", "engels", "englisch", "anglais", "inglés", "ingles"),
    "de": ("de", "deu", "ger", "german", "deutsch", "duits", "allemand", "alemán", "aleman"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "frans", "französisch", "franzoesisch", "francés", "frances"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano", "spaans", "spanisch", "espagnol", "castilian"),
}
CODES = tuple(SPELLINGS)


def label_parts(label: Column) -> Column:
    """The parts of a label between separators that name several languages; a region stays with its language."""
    return F.split(F.lower(F.coalesce(label, F.lit(""))), r"[+;,/|&]|\s+(?:and|und|et|en|y|or|of)\s+|\s{2,}")


def named_languages(label: Column) -> Column:
    """Sorted codes of the languages a label names; empty for a missing or unknown label.

    The first word of a part decides, so "nl-BE", "EN_us" and "Deutsch (Schweiz)" name one language each.
    """
    first = F.transform(label_parts(label), lambda p: F.regexp_extract(p, r"^[^\p{L}]*(\p{L}+)", 1))
    table = F.create_map(*(F.lit(x) for code, spellings in SPELLINGS.items() for s in spellings for x in (s, code)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(first, lambda w: F.try_element_at(table, w)), lambda c: c.isNotNull())))


def single_label(label: Column) -> Column:
    """The one language a label names, "mul" for several, "und" for none."""
    names = named_languages(label)
    return F.when(F.size(names) == 1, F.element_at(names, 1)).when(F.size(names) > 1, "mul").otherwise("und")
