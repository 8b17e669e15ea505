"""Problem 9: personal data in free text, found and replaced by typed placeholders.

Regular expressions propose spans, checksums confirm numbers that have one, and words nearby raise or lower the score;
a span counts from `LEAST` on.

* email: a plain, escaped or disguised address ("name [at] host [dot] org").
* phone: national and international forms; a word such as "tel." or "call" before, or an international prefix, counts for it.
* idnum: social security, tax, national and passport numbers. Forms are proposed by shape; mod-97, mod-11, the
  eleven test or a check letter confirm them; words such as "SSN" or "passport" count for them, words such as
  "grant", "record" or "ISBN" against.
* address: house number and street in the orders of the languages of the corpus, with flat, postcode and town.
* card and iban: payment cards confirmed by Luhn's check, account numbers by mod-97; replaced, but no listed type.
* name: a given name and a surname in either order, with particles, middle names and initials. Which words are
  surnames is learned from the author lists of the whole corpus (initial and surname), which are given names from what
  stands before those surnames elsewhere; titles and cue words add to the score.

Values are the mention as it stands in the text, each run of white space (and a comment sign at a line start within
it) as one space.

Defined results: null and empty texts have no mention and stay as they are; overlapping proposals are settled by
score, then length, then place; repeated mentions are one row of `found` and replaced everywhere; repeated rows and
extra columns change nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import map_arrow
from leafmill.llm.store import written

LEAST = 3
#: White space inside a mention: blanks, ties, and one line break with the comment sign of the next line.
WS = r"(?:[ \t~]*(?:\n[ \t]*%*[ \t]*)?)"
GAP = r"(?:[ \t~]+(?:\n[ \t]*(?:%+[ \t]*)?)?|\n[ \t]*(?:%+[ \t]*)?)"
UP, LOW = "A-ZÀ-ÖØ-ÞŒŠŽ", "a-zß-öø-ÿœšž"


# A pattern that is searched for begins with the class of its first character, and what must not stand before it comes
# behind that: the engine passes over other characters in one loop only if a class comes first.


class Mention(NamedTuple):
    begin: int
    end: int
    kind: str
    score: int


# ---------------------------------------------------------------- checksums


def luhn(digits: str) -> bool:
    """Luhn's check of a digit string."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return bool(digits) and total % 10 == 0


def mod97(digits: str, check: int = 2) -> bool:
    """The last two digits are 97 minus the rest modulo 97 (social security numbers of two countries)."""
    return len(digits) > check and 97 - int(digits[:-check]) % 97 == int(digits[-check:])


def eleven(digits: str) -> bool:
    """Eleven test of 9 digits with the last weighing -1."""
    return len(digits) == 9 and digits != "0" * 9 and (sum(int(d) * (9 - i) for i, d in enumerate(digits[:8])) - int(digits[8])) % 11 == 0


def mod11_10(digits: str) -> bool:
    """ISO 7064 MOD 11,10 of 11 digits."""
    if len(digits) != 11:
        return False
    p = 10
    for d in digits[:10]:
        p = (int(d) + p) % 10 or 10
        p = p * 2 % 11
    return (11 - p) % 10 == int(digits[10])


def check_letter(digits: str, letter: str) -> bool:
    """The letter belongs to the number modulo 23."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == letter.upper()


def iban(text: str) -> bool:
    """Mod-97 of an international account number."""
    text = re.sub(r"\W", "", text).upper()
    return len(text) > 14 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


# ---------------------------------------------------------------- email

LOCAL = re.compile(r"(?:[A-Za-z0-9À-ÿ.+\-]|\\?_)+$")
HOST = re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
SIGN = re.compile(r"\\?@")
#: "at" in brackets, and as a word before a spelled dot.
BRACKET_AT = re.compile(GAP + r"?[\[({<]\s?(?:at|AT|At|ät|arobase|@)\s?[\])}>]" + GAP + r"?")
WORD_AT = re.compile(GAP + r"(?:at|AT)" + GAP + r"(?=[A-Za-z0-9\-]+" + GAP + r"(?:dot|DOT)\b)")
WORD_HOST = re.compile(r"[A-Za-z0-9\-]+(?:(?:" + GAP + r"?[\[({<]\s?(?:dot|DOT|punt|point|Punkt|\.)\s?[\])}>]" + GAP + r"?|" + GAP + r"(?:dot|DOT)" + GAP + r"|\.)[A-Za-z0-9\-]+)+")
LAST_LABEL = re.compile(r"[A-Za-z]{2,}$")
HINT_AT = re.compile(r"[\[({<] ?(?:at|AT|At|ät|arobase|@) ?[\])}>]")


def emails(text: str) -> list[Mention]:
    out = []
    signs = [*SIGN.finditer(text)] if "@" in text else []
    hidden = [*BRACKET_AT.finditer(text)] if HINT_AT.search(text) else []
    if " dot " in text or " DOT " in text:
        hidden += WORD_AT.finditer(text)
    for m, pattern in [*((m, HOST) for m in signs), *((m, WORD_HOST) for m in hidden)]:
        local = LOCAL.search(text, max(0, m.start() - 64), m.start())
        host = pattern.match(text, m.end())
        if not local or not host:
            continue
        begin, end = local.start(), host.end()
        while begin < m.start() and text[begin] in ".+-\\_":
            begin += 1
        while end > m.end() and text[end - 1] in ".-":
            end -= 1
        if begin < m.start() and LAST_LABEL.search(text, m.end(), end):
            out.append(Mention(begin, end, "email", 9))
    return out


# ---------------------------------------------------------------- numbers

SEP = r"(?:[ ~./\-–]|\\[ ,]|[ \t]?\n[ \t]*(?:%+[ \t]*)?(?:\(0\)[ ]?)?|[ ]?\(0\)[ ]?|\)[ ]?)"
#: Groups of digits with one separator between two, with an international prefix or a leading bracket.
RUN = re.compile(r"[+(\d](?:(?<=\d)\d*|\d+)(?:" + SEP + r"\d+)*")
NOT_BEFORE = frozenset("_.$^{:@+-/\\=<>")
PHONE_SHAPES = re.compile(
    r"""\+\d{1,3}[\s~.\-]*(?:\(0\))?[\d\s~./\-]{6,16}\d$      # international
      | 00[1-9]\d{8,13}$
      | 00[1-9]\d{0,2}[\s~.\-/](?:\(0\))?[\d\s~./\-]{6,14}\d$
      | \(\d{3}\)[\s~]?\d{3}-\d{4}$                            # (776) 555-0189
      | \(?0\d{1,4}\)?[\s~/\-]\d[\d\s~.\-]{4,12}\d$            # national with trunk zero
      | 0\d(?:[\s~.\-]\d\d){4}$
      | 0\d{8,10}$
      | \d{3}[\-.\s]\d{3}[\-.\s]\d{4}$
    """,
    re.VERBOSE,
)
PHONE_CUES = re.compile(r"(?:tel|phone|fon|call|reach|erreichbar|bereikbaar|bel|bellen|appel|joindre|répond|mobile|mobil|gsm|fax|hotline|anruf|nummer bellen|téléphone|telefoon|telefon|handy|portable|poste)\w*\b[^\n]{0,30}$|(?:\b[Tt]el|\bT|\bPh|\bFon|\bM)\.?:?\\?\s*$", re.IGNORECASE)
ID_CUES = re.compile(r"(?:\bssn\b|social[\s~]+security|sécurité[\s~]+sociale|\bnir\b|national[\s~]+id|\bbsn\b|burgerservice|identit|rijksregister|steuer|kennnummer|ausweis|sozialversicherung|passport|passeport|paspoort|reisepass|pasaporte|national[\s~]+insurance|\bnino\b|tax[\s~]+(?:id|number)|fiscal|\bdni\b|\bnie\b|\btin\b|personalausweis|personnummer|identity|\bid\b|personenkennzahl|versichert|rijbewijs|sofinummer|numéro[\s~]+national)", re.IGNORECASE)
NOT_ID = re.compile(r"(?:grant|record|isbn|issn|doi|plate|lot|coordinates|seed|catalogue|constant|cells|frame|release|table|step|nodes|rows|order|project|förder|projekt|subsid|subvention|accession|catalog|arxiv|version|checkpoint)\w*\b[^\n]{0,25}$", re.IGNORECASE)
#: Groups of payment card numbers, and account numbers with country and check digits.
CARD_GROUPS = re.compile(r"\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|3\d{3}([ \-])\d{6}\2\d{5}")
CARD_CUES = re.compile(r"\b(?:card|visa|mastercard|amex|kreditkarte|creditcard|betaalkaart|carte|tarjeta|pan)\b[^\n]{0,30}$", re.IGNORECASE)
IBAN = re.compile(r"[A-Z](?<!\w.)[A-Z]\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])")
LETTER_IDS = re.compile(r"(?<![\w\-])(?:[A-Z]{2}\d{7}|[A-Z]{1,2}" + SEP + r"?\d{2}" + SEP + r"?\d{2}" + SEP + r"?\d{2}" + SEP + r"?[A-Z]|[A-Z]\d{8}|[A-Z]{2}\d{6}[A-Z]?|(?=\w*\d\w*\d)[A-Z][A-Z0-9]{8}|\d{2}[A-Z]{2}\d{5}|[XYZ]-?\d{7}-?[A-Z])(?![\w\-])")
#: Where one of them can begin, by its first character and what follows.
LETTER_ID_BEGIN = re.compile(r"[A-Z\d](?<![\w\-].)(?:(?<=[A-Z])(?=[A-Z]?" + SEP + r"?\d{2}|-\d|[A-Z0-9]{8})|(?<=\d)(?=\d[A-Z]{2}\d))")


def letter_ids(text: str) -> Iterator[re.Match[str]]:
    """The matches of `LETTER_IDS`, tried only where one can begin."""
    end = 0
    for m in LETTER_ID_BEGIN.finditer(text):
        if m.start() >= end and (found := LETTER_IDS.match(text, m.start())):
            end = found.end()
            yield found


def _around(text: str, begin: int, end: int, before: int = 60, after: int = 40) -> tuple[str, str]:
    low = max(0, begin - before)
    prior = text[low:begin]
    cut = max(prior.rfind(". "), prior.rfind("\n\n"), prior.rfind(".\n"))
    cut = cut if cut >= 0 and not re.search(r"(?:no|nr|n|tel|Nr|Tel)$", prior[:cut]) else -1
    rest = text[end : end + after]
    stop = re.search(r"\.\s|\n\n|\.$", rest)
    return prior[cut + 1 :], rest[: stop.start()] if stop else rest


def numbers(text: str) -> list[Mention]:
    out = []
    for m in RUN.finditer(text):
        if m.end() - m.start() < 6:
            continue
        begin, end = m.span()
        raw = m[0]
        digits = "".join(filter(str.isdigit, raw.replace("(0)", "") if raw[0] == "+" else raw))
        if not 6 <= len(digits) <= 19 or begin and (text[begin - 1] in NOT_BEFORE or text[begin - 1].isalnum()):
            continue
        if raw[0] == "(" and ")" not in raw:
            begin, raw = begin + 1, raw[1:]
        if end < len(text) and (text[end].isalpha() or text[end] == "_"):
            continue
        prior, rest = _around(text, begin, end)
        flat = re.sub(r"\s+(?:%+\s*)?", " ", raw)
        if 13 <= len(digits) <= 19 and digits[0] in "3456" and luhn(digits) and (CARD_GROUPS.fullmatch(flat) or CARD_CUES.search(prior)):
            out.append(Mention(begin, end, "card", 6))
            continue
        if len(digits) > 16:
            continue
        against = bool(NOT_ID.search(prior)) and not ID_CUES.search(prior[-30:]) and not PHONE_CUES.search(prior[-14:])
        cue = bool(ID_CUES.search(prior)) or bool(ID_CUES.search(rest))
        # a letter right behind belongs to an identity number with a check letter
        letter = re.match(r"[\-. ]?([A-Z])(?![\w\-])", text[end : end + 3])
        score = 0
        if len(digits) == 8 and letter and (cue or check_letter(digits, letter[1])):
            out.append(Mention(begin, end + letter.end(), "idnum", 3 + check_letter(digits, letter[1]) + cue - 4 * against))
            continue
        if re.fullmatch(r"\d{3}([\- ]?)\d{2}\1\d{4}", flat):
            score += 2
        if len(digits) == 9 and eleven(digits):
            score += 2
        if len(digits) == 11 and (mod11_10(digits) or mod97(digits) or mod97("2" + digits)):
            score += 2
        if len(digits) == 15 and mod97(digits):
            score += 3
        shape = len(digits) in (8, 9, 10, 11, 12, 13, 15) and raw[0] not in "+("
        score += 3 * (cue and shape) - 4 * against
        phone = 0
        if PHONE_SHAPES.match(flat) and 7 <= len(digits) <= 15:
            phone = 3 + bool(PHONE_CUES.search(prior)) - 4 * against - 3 * cue
            if re.fullmatch(r"0\d{8,10}|\d{3}[\-. ]\d{3}[\-. ]\d{4}", flat) and not PHONE_CUES.search(prior):
                phone -= 1
            if re.match(r"\d{3}[\- ]\d{2}[\- ]\d{4}$", flat):
                phone -= 3
        if phone >= LEAST and phone >= score:
            out.append(Mention(begin, end, "phone", phone))
        elif score >= LEAST:
            out.append(Mention(begin, end, "idnum", score))
    out += [Mention(*m.span(), "iban", 8) for m in IBAN.finditer(text) if iban(m[0])]
    for m in letter_ids(text):
        prior, rest = _around(text, *m.span())
        score = 2 + 2 * bool(ID_CUES.search(prior) or ID_CUES.search(rest)) - 4 * bool(NOT_ID.search(prior))
        if score >= LEAST:
            out.append(Mention(*m.span(), "idnum", score + 1))
    return out


# ---------------------------------------------------------------- addresses

TOWN = rf"[{UP}][{LOW}'’\-{UP}]+(?:[ ~\n](?:[{UP}][{LOW}'’\-{UP}]+|aan|an|am|den|de|der|la|le|les|sur|sous|bei)(?=[ ~\n][{UP}]|\b)){{0,2}}"
TOWN1 = rf"[{UP}][{LOW}'’\-{UP}]+"
EN_WORDS = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Row|Boulevard|Blvd|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Terrace|Way|Close|Crescent|Gardens|Hill|Mews|Parade|Quay|Wharf|Walk|Grove|Alley|Parkway|Highway|Green|Gate|Yard|Rise|Vale|View|Circle|Trail)"
FLAT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room|Floor|Appt|Appartement|Bus|Wohnung|Whg|Hof)\.?" + GAP + r"[0-9]+[A-Za-z]?)"
UK_POST = r"[A-Z]{1,2}\d[A-Z\d]?" + GAP + r"\d[A-Z]{2}"
US_POST = r"[A-Z]{2}" + GAP + r"\d{5}(?:-\d{4})?"
NUM = r"\d{1,4}(?:[a-zA-Z]\b|" + GAP + r"?-?" + GAP + r"?(?:bis|ter|quater|hs|hs\.|[I]{1,3})\b|-\d{1,4}\b|/\d{1,4}\b)?"
ENGLISH = re.compile(
    rf"(?<![\w.])(?:{FLAT},?{GAP})?\d{{1,5}}[a-zA-Z]?,?{GAP}(?:[NSEW]\.?{GAP})?(?:[{UP}][{LOW}'’\-{UP}]+{GAP}){{1,3}}{EN_WORDS}\b\.?(?:,?{GAP}{FLAT})?"
    rf"(?:,{GAP}(?:{TOWN})(?:,?{GAP}(?:{UK_POST}|{US_POST}))?)?"
)
FR_WORDS = r"(?:rue|avenue|av\.?|boulevard|bd\.?|bld\.?|place|pl\.?|chemin|impasse|allée|quai|cours|route|square|passage|sentier|faubourg|fbg|ruelle|esplanade|promenade|montée|cité)"
FRENCH = re.compile(
    rf"(?<![\w.])(?:(?:[Aa]ppt\.?|[Aa]ppartement|[Bb]ât(?:iment|\.)?|[Ll]ogement){GAP}\w+,?{GAP})?\d{{1,4}}(?:{GAP}?(?:bis|ter|quater)\b|[a-zA-Z]\b)?,?{GAP}{FR_WORDS}{GAP}(?:(?:du|de|des|la|le|les|d[’']|l[’']|aux?|sous|sur)(?:{GAP}|(?<=[’'])))*"
    rf"[{UP}][{LOW}'’\-{UP}]+(?:{GAP}(?:[{UP}][{LOW}'’\-{UP}]+|du|de|des|la|le))*?(?:,?{GAP}(?:[A-Z]{{1,2}}-)?\d{{4,5}}{GAP}{TOWN1}(?:[ \-][{UP}][{LOW}'’\-{UP}]+)*)?(?![{LOW}])"
)
#: Street names of one word, or of several before a street word, then the house number.
STEM = rf"(?:(?!Wohnung|Haus|Woning|Huis|Adresse|Anschrift|Reprints)(?:[{UP}][{LOW}'’\-]+{GAP}){{0,2}}[{UP}][{LOW}\-]*(?:straat|laan|weg|plein|gracht|kade|dijk|singel|dreef|hof|pad|steeg|markt|plantsoen|park|ring|baan|lei|straße|strasse|str\.|gasse|allee|platz|damm|ufer|steig|ring|stieg|chaussee|markt|graben|zeile|reihe|pfad|winkel|berg|brücke|tor|wall)|[{UP}][{LOW}\-]+{GAP}(?:Zeile|Reihe|Gasse|Straße|Pfad|Steig|Ring|Markt|Ufer|Weg|Platz|Allee|Damm|Straat|Laan|Weg|Plein|Kade|Gracht)|(?:Am|An der|An den|Im|In der|Auf der|Auf dem|Unter den|Unter der|Zum|Zur|Hinter der|Op de|Aan de|Aan het|Achter de|Bij de)(?:{GAP})[{UP}][{LOW}\-]+(?:{GAP}[{UP}][{LOW}\-]+)?|[{UP}][{LOW}\-]+er{GAP}(?:Straße|Str\.|Strasse|Allee|Weg|Platz|Gasse|Ufer|Damm))"
GERMANIC = re.compile(
    rf"(?<![\w\-]){STEM}{GAP}{NUM}(?:(?:{GAP})?(?:bus|Whg\.?|Apt\.?){GAP}\w+)?(?:,?{GAP}(?:[A-Z]{{1,2}}-)?(?:\d{{4}}{GAP}?[A-Z]{{2}}|\d{{5}}|\d{{4}}){GAP}{TOWN1}|,{GAP}{TOWN1}|{GAP}(?:te|in){GAP}{TOWN1}(?:,?{GAP}\d{{4}}{GAP}?[A-Z]{{2}})?)?"
)
HOUSE = re.compile(r"\d(?<![\w.].)\d{0,4}(?!\d|\.\d)")
AHEAD = re.compile(rf"(?:[ ~\n%]*[NSEW]\.)?[^.;:\\]{{0,70}}?(?:\b{EN_WORDS}\b)|[^.;:\\]{{0,24}}?\b{FR_WORDS}(?![{LOW}])")
#: Characters before a house number in which a street's name may begin; twice as many behind it end the address.
NEAR = 120
STREET_END = ("straat", "laan", "weg", "plein", "gracht", "kade", "dijk", "singel", "dreef", "hof", "pad", "steeg", "markt", "plantsoen", "park", "ring", "baan", "lei", "straße", "strasse", "str.", "gasse", "allee", "platz", "damm", "ufer", "steig", "stieg", "chaussee", "graben", "zeile", "reihe", "pfad", "winkel", "berg", "brücke", "tor", "wall")
STREET_BEGIN = re.compile(rf"(?:Am|An der|An den|Im|In der|Auf der|Auf dem|Unter den|Unter der|Zum|Zur|Hinter der|Op de|Aan de|Aan het|Achter de|Bij de|Straße|Str\.|Strasse|Allee|Weg|Platz|Gasse|Ufer|Damm|Zeile|Reihe|Pfad|Steig|Ring|Markt){GAP}(?:[{UP}][{LOW}\-]+{GAP}){{0,2}}$")
NOT_HOUSE = ("Table", "Line", "Algorithm", "Step", "Section", "Figure", "Fig.", "Eq.", "order", "Ordnung", "orde", "ordre")


def addresses(text: str) -> list[Mention]:
    """House numbers first; a street pattern is tried only around one that has a street word near."""
    out = []
    for h in HOUSE.finditer(text):
        at = h.start()
        before = text[max(0, at - NEAR) : at]
        if before.removesuffix("\n").rstrip(" ~").endswith(NOT_HOUSE):
            continue
        near = text[h.end() : h.end() + 80]
        if near[:12].lstrip(" ,~\nabcdefBISTER%-")[:1].isalpha() and AHEAD.match(near):
            flat = re.search(rf"{FLAT},?{GAP}$|(?:[Aa]ppt\.?|[Aa]ppartement|[Bb]ât(?:iment|\.)?|[Ll]ogement){GAP}\w+,?{GAP}$", before)
            begin = at - (len(flat[0]) if flat else 0)
            for pattern in (ENGLISH, FRENCH):
                if m := pattern.match(text, begin):
                    out.append(Mention(*m.span(), "address", 4 + ("," in m[0])))
        stem = before.rstrip(" ~\n%\t")
        if len(stem) < len(before) and (stem.lower().endswith(STREET_END) or STREET_BEGIN.search(before)):
            for m in GERMANIC.finditer(text, max(0, at - NEAR), min(len(text), at + 2 * NEAR)):
                if m.start() < at < m.end():
                    out.append(Mention(*m.span(), "address", 4 + (m.end() - h.end() > 4)))
    return out


# ---------------------------------------------------------------- names

PARTICLE = r"(?:van|von|de|der|den|ten|ter|zu|zum|zur|du|la|le|des|del|di|da|dos|el|al|af|av|vom|'t|op|te|in)"
#: An initial and a surname, as author lists have them.
AUTHOR = re.compile(rf"[{UP}](?<![\w.].)\.(?:[ ~\-]*[{UP}]\.)*[ ~]*((?:{PARTICLE}[ ~])*(?:[dDlLO]['’])?[{UP}][{LOW}{UP}'’\-]+)(?=,|\}}|\s*\\and\b|\s+(?:and|und|et|en|y|&)\s)")
CAP_REST = rf"(?:[{LOW}]+|[{UP}]+)(?:['’\-](?:[{UP}]?[{LOW}]+|[{UP}]+))*"
CAP = rf"(?:[dDlLO]['’])?[{UP}]{CAP_REST}"
#: Capitalised words, initials and particles in a row; what is a name among them the lexicon says.
CHAIN = re.compile(rf"[dl{UP}](?<![\w\\@.\-].)(?:(?<=[dDlLO])['’][{UP}]|(?<=[{UP}])){CAP_REST}(?:,?(?:{GAP})(?:{CAP}|[{UP}]\.(?:-?[{UP}]\.)*|{PARTICLE}(?=[ ~\n])))+")
CHAIN_PART = re.compile(rf"{CAP}|[{UP}]\.(?:-?[{UP}]\.)*|[{LOW}'’]+")
#: Titles, roles and words that begin sentences; never given names.
NOT_GIVEN = frozenset(
    "dr prof professor mr mrs ms miss sir lady herr frau mevrouw mevr meneer dhr monsieur madame mme mlle m patient patientin patiënt patiënte deelnemer teilnehmer participant subject"
    " according thanks thank samples data the a an and or of by with from to in on at for interview see tel contact kontakt code questions reprints kennnummer ausweisnummer note todo xxx draft"
    " der die das den dem des ein eine und oder mit von wir nach laut le la les un une et ou avec nous selon de het een en of met van wij volgens el los las y o con por según student doctor doktor docteur"
    " lane street avenue road row flat suite apt point square court place drive boulevard personal gespräch interviewt dank danken proben".split()
)
NAME_CUES = re.compile(r"(?:thank\w*|done by|interview with|according to|patient\w*|participant|deelnemer|teilnehmer\w*|danken|dank(?:en)?|gespräch mit|remerci\w*|entretien avec|selon|faits par|door|volgens|genomen door|gesprek met|von|durch|par|by|with|contact\w*|dr\.?|prof\.?|mr\.?|mrs\.?|ms\.?|herr\w*|frau|mevrouw|monsieur|mme|m\.)\s*(?:%+\s*)?$", re.IGNORECASE)
INITIAL = re.compile(rf"[{UP}]\.[ ~\n]*$")
LISTED = re.compile(rf"[{UP}]\.[ ~\n]*(?:{PARTICLE}[ ~\n]+)*$")
METHOD = re.compile(r"^(?:[ ~\n]+(?:scheme|lemma|theorem|constant|method|algorithm|equation|data set|dataset|solver|test|transform|distribution|model|process|inequality|conjecture|number|operator|kernel|estimator|lemme|théorème|Verfahren|Satz|Konstante|stelling|methode)\b|--)")


def surnames_in(text: str) -> set[str]:
    return {re.sub(r"[~ ]+", " ", s).split(" ")[-1] for s in AUTHOR.findall(text)}


class Lexicon(NamedTuple):
    """Surnames and given names, lower case. A word may be both; `either` has the surnames that are given names less often than authors."""

    surnames: frozenset[str]
    given: frozenset[str]
    either: frozenset[str] = frozenset()


def _parts(text: str, m: re.Match) -> list[tuple[int, int, str, bool]]:
    """(begin, end, word, a comma before) of a chain."""
    out, last = [], m.start()
    for p in CHAIN_PART.finditer(text, m.start(), m.end()):
        out.append((p.start(), p.end(), p[0], "," in text[last : p.start()]))
        last = p.end()
    return out


PARTICLES = frozenset("van von de der den ten ter zu zum zur du la le des del di da dos vom".split())


def _is_word(word: str) -> bool:
    return word.lower() not in PARTICLES and word[-1] != "." and (word[0].isupper() or word[:2] in ("d'", "d’", "l'", "l’"))


def word_pairs(text: str) -> set[tuple[str, str, bool]]:
    """(word, next word, in a list of authors) of chains, particles and initials skipped; behind a comma the other way round.

    In a list of authors the first word stands behind an initial, or a comma joins it to another author.
    """
    out = set()
    for m in CHAIN.finditer(text):
        last, last_listed = None, False
        parts = _parts(text, m)
        for k, (begin, _, word, comma) in enumerate(parts):
            if not _is_word(word):
                continue
            low, listed = word.lower(), LISTED.search(text, max(0, begin - 30), begin) is not None
            if last is not None and comma:
                out.add((low, last, listed or last_listed or k + 1 < len(parts) and parts[k + 1][3]))
            elif last is not None:
                out.add((last, low, last_listed))
            last, last_listed = low, listed
    return out


def _stands_as_given(text: str, begin: int, low: str, lexicon: Lexicon) -> bool:
    """Whether a word that begins a chain of names is a given name there. Behind an initial a surname is an author's; a surname that is seldom a given name needs a cue."""
    if low not in lexicon.surnames:
        return low in lexicon.given
    if low not in lexicon.given and low not in lexicon.either or LISTED.search(text, max(0, begin - 30), begin):
        return False
    return low in lexicon.given or NAME_CUES.search(text[max(0, begin - 40) : begin]) is not None


def names(text: str, lexicon: Lexicon) -> list[Mention]:
    out = []
    for m in CHAIN.finditer(text):
        parts = _parts(text, m)
        k = 0
        while k < len(parts):
            begin, _, word, _ = parts[k]
            low = word.lower()
            # given names, middle names and initials, particles, surname
            if _is_word(word) and _stands_as_given(text, begin, low, lexicon):
                j, last = k + 1, None
                while j < len(parts) and not parts[j][3]:
                    part = parts[j][2]
                    if _is_word(part) and part.lower() in lexicon.surnames:
                        last = j
                        if part.lower() not in lexicon.given:
                            break
                    elif _is_word(part) and part.lower() not in lexicon.given:
                        break
                    j += 1
                if last is not None and not METHOD.match(text[parts[last][1] : parts[last][1] + 20]):
                    out.append(Mention(begin, parts[last][1], "name", 5))
                    k = last + 1
                    continue
                # an unknown surname behind a given name counts with a cue
                if low in lexicon.given and k + 1 < len(parts) and not parts[k + 1][3]:
                    j = k + 1
                    while j < len(parts) - 1 and not parts[j][3] and (not _is_word(parts[j][2]) or parts[j][2].lower() in lexicon.given):
                        j += 1
                    if _is_word(parts[j][2]) and not parts[j][3] and parts[j][2].lower() not in lexicon.given and parts[j][2].lower() not in NOT_GIVEN and NAME_CUES.search(text[max(0, begin - 40) : begin]) and not METHOD.match(text[parts[j][1] : parts[j][1] + 20]):
                        out.append(Mention(begin, parts[j][1], "name", 3))
                        k = j + 1
                        continue
            # surname, comma, given names
            if _is_word(word) and low in lexicon.surnames:
                first = k
                while first > 0 and not parts[first][3] and not _is_word(parts[first - 1][2]) and parts[first - 1][2][-1] != ".":
                    first -= 1
                listed = INITIAL.search(text, max(0, parts[first][0] - 6), parts[first][0])  # an author list: initial, surname
                if k + 1 < len(parts) and parts[k + 1][3] and parts[k + 1][2].lower() in lexicon.given and not listed:
                    j = k + 1
                    while j + 1 < len(parts) and not parts[j + 1][3] and (parts[j + 1][2].lower() in lexicon.given or parts[j + 1][2][-1] == "."):
                        j += 1
                    # surnames that are given names, too, and more behind a comma: a list of surnames
                    if not (parts[k + 1][2].lower() in lexicon.surnames and j + 1 < len(parts) and parts[j + 1][3]):
                        out.append(Mention(parts[first][0], parts[j][1], "name", 5))
                        k = j + 1
                        continue
            k += 1
    return out


# ---------------------------------------------------------------- operator


ADDRESS_CUES = re.compile(r"(?:\baddress\w*|\blives?|\bliving|\bresid\w*|\bposted|\bmailed|\bsent|\bwohn\w*|\bAnschrift|\bwoon\w*|\badres\w*|\bhabit\w*|\bdemeur\w*|\bdomicili\w*|\bdirecci\w*)\W[^\n]{0,30}$", re.IGNORECASE)


def in_context(text: str, m: Mention) -> Mention:
    """A mention with one more point if a cue stands before it."""
    cue = NAME_CUES.search(text, max(0, m.begin - 40), m.begin) if m.kind == "name" else ADDRESS_CUES.search(text, max(0, m.begin - 50), m.begin)
    return m._replace(score=m.score + 1) if cue else m


def mentions(text: str, lexicon: Lexicon) -> list[Mention]:
    """Mentions of a text in order, without overlaps."""
    found = [m for m in (*emails(text), *map(partial(in_context, text), addresses(text)), *numbers(text), *map(partial(in_context, text), names(text, lexicon))) if m.score >= LEAST]
    found.sort(key=lambda m: (-(m.score + (m.kind == "address")), m.begin - m.end, m.begin))
    taken: list[Mention] = []
    for m in found:
        if all(m.end <= t.begin or m.begin >= t.end for t in taken):
            taken.append(m)
    return sorted(taken)


SPACE = re.compile(r"[ \t]*\n[ \t]*(?:%+[ \t]*)?|[ \t\xa0]+")


def value_of(text: str, mention: Mention) -> str:
    return SPACE.sub(" ", text[mention.begin : mention.end]).strip()


def redact(text: str, found: list[Mention]) -> str:
    """The text with [EMAIL], [PHONE], [IDNUM], [ADDRESS], [NAME], [CARD] and [IBAN] for the mentions."""
    out, at = [], 0
    for m in found:
        out += [text[at : m.begin], f"[{m.kind.upper()}]"]
        at = m.end
    return "".join(out) + text[at:]


#: Kinds `found` lists; card and account numbers are replaced, but not listed.
LISTED_KINDS = frozenset(("email", "phone", "idnum", "address", "name"))
#: Rows of the lexicon up to which it is sent to all tasks; a larger one is joined to the documents.
BROADCAST_NAMES = 200_000


def learn_names(df: DataFrame, column: str = "text") -> DataFrame:
    """(word, surname, given, either): surnames from all author lists, and given names from what stands before them, over all rows.

    A word must occur in two documents, however many there are. A given name must stand with two different surnames.
    One that is an author's surname, too, must do so outside lists of authors; it is a given name anywhere if it does
    so as often as authors have it, else only where the context says so (`either`). The lexicon is a table in the
    shared folder.
    """
    texts = df.where(F.col(column).isNotNull()).select(column)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter[tuple[str | None, str, bool]] = Counter()
        for text in batch.column(0).to_pylist():
            seen.update((None, s, True) for s in {s.lower() for s in surnames_in(text)} if len(s) > 1)
            seen.update(word_pairs(text))
        pairs = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array([p[2] for p in pairs], pa.bool_()), pa.array(list(seen.values()), pa.int64())], names=["given", "surname", "listed", "docs"])

    seen = written(map_arrow(texts, one, "given string, surname string, listed boolean, docs long").groupBy("given", "surname", "listed").agg(F.sum("docs").alias("docs")), "names")
    authors = seen.where("given is null and docs >= 2").select("surname", F.col("docs").alias("author"))
    given = (
        seen.where("given is not null")
        .join(authors.select("surname"), "surname")
        .join(authors.withColumnRenamed("surname", "given"), "given", "left")
        .where("author is null or not listed")
        .groupBy("given", "author")
        .agg(F.sum("docs").alias("docs"), F.countDistinct("surname").alias("with"))
        .where((F.col("docs") >= 2) & (F.col("with") >= 2) & (F.length("given") > 2) & ~F.col("given").isin(*sorted(NOT_GIVEN)))
    )
    mainly = F.col("author").isNull() | (F.col("docs") >= F.col("author"))
    roles = authors.select(F.col("surname").alias("word"), F.lit(True).alias("surname"), F.lit(False).alias("given"), F.lit(False).alias("either"))
    roles = roles.unionByName(given.select(F.col("given").alias("word"), F.lit(False).alias("surname"), mainly.alias("given"), (~mainly).alias("either")))
    return written(roles.groupBy("word").agg(*(F.bool_or(c).alias(c) for c in ("surname", "given", "either"))), "lexicon")


def lexicon_of(rows: list) -> Lexicon:
    """A lexicon in memory, from rows of its table."""
    return Lexicon(*(frozenset(r[0] for r in rows if r[k]) for k in (1, 2, 3)))


def chain_words(text: str) -> set[str]:
    """Words of a text that the lexicon can be asked for, lower case."""
    return {p[2].lower() for m in CHAIN.finditer(text) for p in _parts(text, m)}


def scanned(df: DataFrame, find: Callable[[list, list[list[Mention]]], list[pa.Array]], schema: str, id_column: str, column: str, lexicon: DataFrame | Lexicon | None, most: int = BROADCAST_NAMES) -> DataFrame:
    """Rows that `find` makes of ids, texts and their mentions.

    A lexicon of at most `most` rows is sent to all tasks. A larger one is joined to the words of the names each
    document could hold, and a document then meets its own part of it; the results are the same.
    """
    spark = df.sparkSession
    chosen = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("text"))
    names_ = [f.strip().split(" ")[0] for f in re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", schema)).split(",")]
    if lexicon is None:
        lexicon = learn_names(df, column)
    if isinstance(lexicon, DataFrame) and len(rows := lexicon.limit(most + 1).collect()) <= most:
        lexicon = lexicon_of(rows)
    if isinstance(lexicon, Lexicon):
        sent = spark.sparkContext.broadcast(lexicon)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            return pa.RecordBatch.from_arrays(find(batch.column(0), texts, [mentions(t, sent.value) if t else [] for t in texts]), names=names_)

        return map_arrow(chosen, one, schema)

    def ask(batch: pa.RecordBatch) -> pa.RecordBatch:
        asked = [(doc, w) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for w in chain_words(text)]
        return pa.RecordBatch.from_arrays([pa.array([a[0] for a in asked], pa.int64()), pa.array([a[1] for a in asked], pa.string())], names=["id", "word"])

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, parts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        found = [mentions(t, lexicon_of([(r["word"], r["surname"], r["given"], r["either"]) for r in p or ()])) if t else [] for t, p in zip(texts, parts)]
        return pa.RecordBatch.from_arrays(find(batch.column(0), texts, found), names=names_)

    answers = map_arrow(chosen, ask, "id long, word string").distinct().join(lexicon, "word").groupBy("id").agg(F.collect_list(F.struct("word", "surname", "given", "either")).alias("part"))
    met = chosen.join(answers, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "part")
    return map_arrow(met, own, schema)


def detect(df: DataFrame, id_column: str = "doc_id", column: str = "text", lexicon: DataFrame | Lexicon | None = None, most: int = BROADCAST_NAMES) -> DataFrame:
    """(doc_id, redacted, mentions): the text with placeholders and its mentions in order."""
    kind = pa.list_(pa.struct([("pii_type", pa.string()), ("value", pa.string()), ("begin", pa.int32()), ("score", pa.int32())]))

    def rows(ids: pa.Array, texts: list, found: list[list[Mention]]) -> list[pa.Array]:
        listed = [[{"pii_type": m.kind, "value": value_of(t, m), "begin": m.begin, "score": m.score} for m in ms] for t, ms in zip(texts, found)]
        return [ids, pa.array([redact(t, ms) if ms else t for t, ms in zip(texts, found)], pa.string()), pa.array(listed, kind)]

    return scanned(df, rows, "doc_id long, redacted string, mentions array<struct<pii_type: string, value: string, begin: int, score: int>>", id_column, column, lexicon, most)


def found(df: DataFrame, id_column: str = "doc_id", column: str = "text", lexicon: DataFrame | Lexicon | None = None, most: int = BROADCAST_NAMES) -> DataFrame:
    """(doc_id, pii_type, value), distinct; the mentions alone, the text stays in the scan stage."""

    def rows(ids: pa.Array, texts: list, found_: list[list[Mention]]) -> list[pa.Array]:
        each = list(dict.fromkeys((doc, m.kind, value_of(t, m)) for doc, t, ms in zip(ids.to_pylist(), texts, found_) for m in ms if m.kind in LISTED_KINDS))
        return [pa.array([e[0] for e in each], pa.int64()), pa.array([e[1] for e in each], pa.string()), pa.array([e[2] for e in each], pa.string())]

    return scanned(df, rows, "doc_id long, pii_type string, value string", id_column, column, lexicon, most).distinct()
