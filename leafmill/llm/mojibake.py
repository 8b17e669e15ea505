"""Problem 5: text decoded with the wrong character encoding.

Garbled sequences of all pairs of encodings are computed beforehand and matched with an Aho-Corasick automaton; only
matched spans are replaced.

* Text stored as UTF-8 and read in a single-byte encoding leaves sequences of two to four characters for one
  ("Ã©"). They are patterns by themselves, also with each character written as a numeric entity. Repair runs until
  nothing matches, so text garbled twice comes back in two rounds.
* Text of one single-byte encoding read in another leaves one wrong character for one, which may well be right
  elsewhere. Patterns are therefore garbled three-character contexts: a first pass counts, in how many documents each
  context with a non-ASCII centre stands; every context is garbled by every pair. A garbled context is a pattern where
  what it restores is `MORE` times as common as what it is, a ratio that holds at any size of the corpus. The
  characters of a document are split into passages of one pair each, at least cost (Viterbi), so a document may hold
  passages garbled in different ways; a passage counts when its patterns explain most of what the pair could have made.
* Text stored as UTF-7 and read as ASCII leaves a base64 run for one or more characters ("caf+AOk-"). Runs are decoded,
  not looked up, so any number of characters is covered; a run counts when it is UTF-16 to the last bit and all its
  characters occur in text. The closing hyphen may be missing where UTF-7 lets it: behind a letter that the run goes on,
  or in a document with a closed run.
* U+FFFD and C1 controls are never right; where a character was lost nothing is guessed.

Defined results: null and blank texts, and pure ASCII texts without entities or UTF-7 runs, are not affected and stay as they are; text without a match is
returned unchanged; lost characters stay U+FFFD and the row says so. Rows are independent, so repeated rows and ties
need no rule. Output columns are fixed; extra columns of the input are not read.
"""

from __future__ import annotations

import base64
import bisect
import functools
import math
import re
from collections import Counter
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import code_points, map_arrow

#: Encodings in which western text is stored, and those in which it may be read by mistake.
STORED = ("cp1252", "mac_roman", "cp437", "cp850", "iso8859_15")
READ = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "koi8_r", "cp866", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "iso8859_15")
#: ASCII for context: letters lower case, digits 0, the rest a space. A neighbour beyond ASCII is one class.
PLAIN = {i: (chr(i).lower() if chr(i).isalpha() else "0" if chr(i).isdigit() else " ") for i in range(128)}
OTHER = "\x7f"
#: Letters that stand for Latin look-alikes as often as for a wrong decoding; alone they prove nothing.
LOOK_ALIKES = frozenset("АВЕКМНОРСТХаеорсухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι")
#: How many times as common as itself what a garbled context restores must be.
MORE = 5
#: The begin of a UTF-7 run (the first base64 letters are those of all characters in `shifted`), and what may follow.
UTF7 = re.compile(r"\+(?=[ABDIJ2+/])([A-Za-z0-9+/]{3,8})")
UTF7_REST = re.compile(r"([A-Za-z0-9+/]+)(-?)")
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


@functools.cache
def targets() -> str:
    """Non-ASCII characters of western text: those of cp1252 and of Latin Extended-A."""
    high = bytes(range(0x80, 0x100)).decode("cp1252", "ignore")
    return high + "".join(map(chr, range(0x100, 0x180)))


#: Letters of Greek and Cyrillic text, which UTF-8 read in a Latin encoding leaves as sequences, too.
FOREIGN = "".join(map(chr, (*range(0x386, 0x3CF), *range(0x401, 0x460))))
LATIN_READ = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1254", "iso8859_15")


@functools.cache
def decoder(encoding: str) -> tuple[str, ...]:
    """The character of each byte; bytes an encoding leaves undefined become C1 controls, as lenient readers do."""
    return tuple(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256))


@functools.cache
def sequences() -> ahocorasick.Automaton:
    """UTF-8 read as single bytes: pattern → {reading encoding: character}."""
    found: dict[str, dict[str, str]] = {}
    for ch in targets() + FOREIGN + "".join(map(chr, range(0x80, 0xA0))):  # undefined bytes pass through as controls
        raw = ch.encode("utf-8")
        for name in LATIN_READ if ch in FOREIGN else READ:
            table = decoder(name)
            garbled = "".join(table[b] for b in raw)
            forms = {garbled, "".join(f"&#{ord(x)};" if ord(x) > 127 else x for x in garbled)}
            for form in forms:
                found.setdefault(form, {})[name] = ch
    out = ahocorasick.Automaton()
    for form, by in found.items():
        out.add_word(form, (form, by))
    out.make_automaton()
    return out


@functools.cache
def shifted() -> frozenset[str]:
    """Characters UTF-7 puts in runs: those of western text, what a wrong reading makes of them, punctuation and symbols."""
    ranges = ((0x80, 0x370), (0x2000, 0x2400), (0x2500, 0x2700), (0xFB00, 0xFB07), (0xFFFC, 0xFFFE), (0x1F000, 0x1FB00))
    return frozenset("!\"#$%&*;<=>@[\\]^_`{|}~" + "".join(chr(c) for a, b in ranges for c in range(a, b)) + "".join(x for name in READ for x in decoder(name)[0x80:]))


def utf7_run(body: str, whole: bool) -> str | None:
    """The characters of a base64 run; nothing if one is not in `shifted` or a whole run is not UTF-16 to the last bit."""
    left = len(body) * 6 % 16
    if whole and (left >= 6 or BASE64.index(body[-1]) % (1 << left)):
        return None
    raw = base64.b64decode(body + "A" * (-len(body) % 4))[: len(body) * 6 // 16 * 2]
    text = raw.decode("utf-16-be", "surrogatepass" if whole else "ignore")
    return text if shifted().issuperset(text) else None


def utf7_runs(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, characters) of the UTF-7 runs of a text."""
    closed, open_ = [], []
    at = 0
    while m := UTF7.search(text, at):
        out = None
        if utf7_run(m[1], False) is not None:  # the first characters settle nearly all cases, so base64 data costs little
            rest = UTF7_REST.match(text, m.start() + 1)
            out = utf7_run(rest[1], True)
        if out is None:
            at = m.start() + 1  # a plus sign of the text may stand before the run
            continue
        at = rest.end()
        prior = text[m.start() - 1 : m.start()]
        (closed if rest[2] or prior.islower() and out.isalpha() and out.islower() else open_).append((m.start(), at, out))
    return sorted(closed + open_) if closed else []


def undo_utf7(text: str) -> tuple[str, int]:
    """(text with UTF-7 runs decoded, number of runs). Where each plus sign is of a run or written "+-", those are plus signs, too."""
    runs = utf7_runs(text) if "+" in text else []
    if not runs:
        return text, 0
    out, at = [], 0
    for begin, end, characters in runs:
        out += [text[at:begin], characters]
        at = end
    out.append(text[at:])
    if all("+" not in x.replace("+-", "") for x in out[::2]):
        out[::2] = [x.replace("+-", "+") for x in out[::2]]
    return "".join(out), len(runs)


def _together(hits: list[tuple[int, str, dict[str, str]]]) -> list[tuple[int, str, dict[str, str]]]:
    """Hits without single letters of Greek or Cyrillic: those count only side by side, as in a word."""
    foreign = [all(ch in FOREIGN for ch in by.values()) for _, _, by in hits]
    if not any(foreign):
        return hits
    near = [k + 1 < len(hits) and foreign[k] and foreign[k + 1] and hits[k + 1][0] - len(hits[k + 1][1]) == hits[k][0] for k in range(len(hits))]
    return [h for k, h in enumerate(hits) if not foreign[k] or near[k] or k and near[k - 1]]


def undo_sequences(text: str) -> tuple[str, int]:
    """(text with UTF-7 runs and garbled sequences replaced, number of spans), until no sequence is left."""
    text, spans = undo_utf7(text)
    while hits := _together([(end, *value) for end, value in sequences().iter_long(text)]):  # each round shortens the text
        votes = Counter(name for _, _, by in hits for name in by)
        out, at = [], 0
        for end, form, by in hits:
            begin = end + 1 - len(form)
            out.append(text[at:begin])
            out.append(by[max(by, key=lambda n: (votes[n], n))] if len(set(by.values())) > 1 else next(iter(by.values())))
            at = end + 1
        text = "".join(out) + text[at:]
        spans += len(hits)
    return text, spans


def suspicious(text: str) -> bool:
    return not text.isascii() or "&#" in text or UTF7.search(text) is not None


@functools.cache
def pairs() -> tuple[tuple[str, str, dict[int, str]], ...]:
    """(stored, read, character → character it was read as), where the two differ."""
    out = []
    for stored in STORED:
        for name in READ:
            if stored == name:
                continue
            table, mapping = decoder(name), {}
            for ch in targets():
                raw = ch.encode(stored, "ignore")
                if raw and table[raw[0]] != ch:
                    mapping[ord(ch)] = table[raw[0]]
            out.append((stored, name, mapping))
    return tuple(out)


@functools.cache
def centres() -> frozenset[str]:
    """Characters whose contexts are counted: those of western text and all that a pair makes of them."""
    return frozenset(targets()).union(*(m.values() for _, _, m in pairs()))


def plain(text: str) -> str:
    """A text for contexts: a blank at both ends, ASCII by class."""
    return " " + text.translate(PLAIN) + " "


def context(flat: str, at: int) -> str:
    """The context around a place of a plain text."""
    left, right = flat[at - 1], flat[at + 1]
    return (left if left < OTHER else OTHER) + flat[at] + (right if right < OTHER else OTHER)


def context_counts(df: DataFrame, column: str) -> DataFrame:
    """(context, docs): in how many documents each context stands whose centre is one of `centres`.

    Counted per batch in numpy and summed before the shuffle. There are 29 classes of neighbours and some hundred
    centres, so at most 29 × 29 × that many rows come out (half a million), whatever the corpus and its scripts.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [plain(undo_sequences(t)[0]) if t is not None and suspicious(t) else "" for t in batch.column(0).to_pylist()]
        points, bounds = code_points(pa.array(texts, pa.string()))
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        wanted = np.zeros(0x110000, bool)
        wanted[[ord(c) for c in centres()]] = True
        at = np.flatnonzero(wanted[points[1:-1]]) + 1 if len(points) > 2 else np.zeros(0, np.int64)
        p = np.minimum(points, 0x7F).astype(np.uint64)
        both = np.stack((p[at - 1] << np.uint64(42) | points[at].astype(np.uint64) << np.uint64(21) | p[at + 1], row[at].astype(np.uint64)))
        keys, docs = np.unique(np.unique(both, axis=1)[0], return_counts=True)
        contexts = ["".join(map(chr, (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))) for k in keys.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(contexts, pa.string()), pa.array(docs.astype(np.int64))], names=["context", "docs"])

    return map_arrow(df.where(F.col(column).isNotNull()).select(column), one, "context string, docs long").groupBy("context").agg(F.sum("docs").alias("docs"))


def known_contexts(df: DataFrame, column: str = "markdown") -> dict[str, int]:
    """All contexts with their counts; bounded, see `context_counts`."""
    counted = context_counts(df, column).toArrow()
    return dict(zip(counted["context"].to_pylist(), counted["docs"].to_pylist()))


class Patterns(NamedTuple):
    """The automaton over garbled contexts (garbled context → {pair: (restored centre, documents)}), all counts, and characters that are right nearly everywhere."""

    automaton: ahocorasick.Automaton
    known: dict[str, int]
    ordinary: frozenset[str]


def context_patterns(known: dict[str, int]) -> Patterns:
    """Known contexts of two documents or more garbled by every pair; one must restore what is `MORE` times as common as itself."""
    wanted = frozenset(targets())

    made: dict[str, dict[int, str]] = {}
    for key, docs in known.items():
        if docs >= 2 and key[1] in wanted:
            for p, (_, _, mapping) in enumerate(pairs()):
                if (other := mapping.get(ord(key[1]))) is not None:
                    garbled = key[0] + other + key[2]
                    if known.get(garbled, 0) * MORE < docs:
                        made.setdefault(garbled, {})[p] = key
    # what is garbled itself restores nothing
    found = {garbled: by for garbled, keys in made.items() if (by := {p: (key[1], known[key]) for p, key in keys.items() if key not in made})}
    out = ahocorasick.Automaton()
    for form, by in found.items():
        out.add_word(form, by)
    out.make_automaton() if len(out) else None
    right, wrong = Counter(), Counter()
    for key, docs in known.items():
        (wrong if key in found else right)[key[1]] += docs
    return Patterns(out, known, frozenset(ch for ch, n in right.items() if n >= 2 * wrong[ch] and n >= 3))


@functools.cache
def images() -> tuple[frozenset[str], ...]:
    return tuple(frozenset(m.values()) for _, _, m in pairs())


#: Costs of a character in a passage: restored to a context, less the more documents have that; missed by its pair, beyond its pair; in no passage though a pattern fits, and else; of a change of passage.
DOUBT, MISSED, BEYOND, LEFT, FREE, CHANGE = 0.3, 1.0, 1.3, 0.9, 0.05, 1.6


def passages(places: list[int], letters: list[str], hits: list[dict[int, tuple[str, int]]]) -> list[tuple[int, list[int]]]:
    """(pair, places in the list) of the passages: the cheapest assignment of the doubtful characters to pairs or to none."""
    used = sorted({p for h in hits for p in h})
    cost = np.zeros((len(places), len(used) + 1))
    for i, (ch, h) in enumerate(zip(letters, hits)):
        cost[i, -1] = LEFT if h else FREE
        cost[i, :-1] = [DOUBT / (1 + math.log2(h[p][1])) if p in h else MISSED if ch in images()[p] else BEYOND for p in used]
    best, back = cost[0] + np.r_[np.full(len(used), CHANGE / 2), 0], []
    for i in range(1, len(places)):
        far = best.min() + CHANGE
        back.append(np.where(best <= far, np.arange(len(best)), best.argmin()))
        best = np.minimum(best, far) + cost[i]
    state = int(best.argmin())
    states = [state]
    for row in reversed(back):
        states.append(state := int(row[state]))
    states.reverse()
    out: list[tuple[int, list[int]]] = []
    for i, state in enumerate(states):
        if state < len(used):
            if out and i and states[i - 1] == state:
                out[-1][1].append(i)
            else:
                out.append((used[state], [i]))
    return out


def undo_contexts(text: str, patterns: Patterns) -> tuple[str, int]:
    """(text with wrongly read single characters replaced, number of them); the text itself where no pair explains it."""
    if not len(patterns.automaton) or text.isascii():
        return text, 0
    flat = plain(text)
    places, hits, right = [], [], []
    for i, ch in enumerate(text):
        if ch > OTHER and ch in centres():
            key = context(flat, i + 1)
            by = patterns.automaton.get(key, None)
            if by or patterns.known.get(key, 0) < 2:
                places.append(i)
                hits.append(by or {})
                continue
            right.append(i)
    if not any(hits):
        return text, 0
    letters = [text[i] for i in places]
    out, spans = list(text), 0
    found_passages = passages(places, letters, hits)
    taken = {i for _, own in found_passages for i in own}

    def reach(i: int, step: int, pair: int) -> int:
        """How far a certain passage goes beyond its pattern: over unknown contexts its pair explains, up to a character that is right."""
        while 0 <= i + step < len(places) and i + step not in taken and not hits[i + step] and letters[i + step] in images()[pair]:
            a, b = sorted((places[i], places[i + step]))
            if bisect.bisect(right, a) < bisect.bisect(right, b):
                break
            i += step
        return i

    for pair, own in found_passages:
        found = [i for i in own if pair in hits[i]]
        could = [i for i in own if letters[i] in images()[pair]]
        seen = {letters[i] for i in found}
        if not found or len(found) < 0.6 * len(could) or seen <= LOOK_ALIKES and (len(found) < 3 or len(found) < len(could)) or len(found) < 3 and seen <= patterns.ordinary:
            continue
        back = {v: chr(k) for k, v in pairs()[pair][2].items()}
        for i in found if len(found) < 3 else range(reach(own[0], -1, pair), reach(own[-1], 1, pair) + 1):  # a certain passage has its other characters from the pair, too
            if i in found or letters[i] in back and letters[i] not in LOOK_ALIKES:
                out[places[i]] = hits[i][pair][0] if pair in hits[i] else back[letters[i]]
                spans += 1
    return "".join(out), spans


def repair_text(text: str | None, patterns: Patterns) -> tuple[str | None, int, int]:
    """(repaired text, replaced spans, characters lost for good)."""
    if text is None or not suspicious(text):
        return text, 0, 0
    out, spans = undo_sequences(text)
    out, more = undo_contexts(out, patterns)
    lost = sum(1 for ch in out if ch == "�" or "\x80" <= ch <= "\x9f")
    return out, spans + more, lost


def repair(df: DataFrame, id_column: str = "doc_id", column: str = "markdown") -> DataFrame:
    """(doc_id, repaired, spans, lost) for every row. Two scans: context counts, then repair with the bounded table."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(known_contexts(df, column))
    state: dict[str, Patterns] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state["patterns"] = context_patterns(sent.value)
        rows = [repair_text(t, state["patterns"]) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            names=["doc_id", "repaired", "spans", "lost"],
        )

    chosen = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("text"))
    return map_arrow(chosen, one, "doc_id long, repaired string, spans long, lost long")


def garbled(df: DataFrame, id_column: str = "doc_id", column: str = "markdown") -> DataFrame:
    """(doc_id) of documents with a garbled span or a lost character."""
    return repair(df, id_column, column).where("spans > 0 or lost > 0").select("doc_id").distinct()
