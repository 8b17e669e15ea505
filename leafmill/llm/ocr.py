"""Problem 2: noise of scanned pages.

One pass over the texts takes them apart; all decisions about words are then made once for each distinct word of the
corpus, as tables, and come back to the documents by joins.

* Analysis: lines that could be a running title or a page number are grouped by shape or style, and an averaged
  perceptron tells page furniture by how often a group comes, how it counts, and where its lines stand: alone, within a
  sentence, at even distances, near the other kind. It is trained on made-up documents (`sample_page`). Furniture is
  removed; a sentence it cut is joined again. What is left of a document is kept as its distinct words with their counts, its compounds, and its
  breaks (half word, mark, half word at the ends of lines).
* Confusions: what recognition makes of letters is learned from pairs of a rare and a frequent word that differ in one
  place only; a change seen with several words is a confusion.
* Characters: an averaged perceptron reads each character of a suspicious word with its neighbours and predicts what it
  stands for: itself (keep), another letter (replace), nothing (delete), or several letters (replace and insert). Its
  best readings are confirmed by an exact check: one must be a word many times as frequent as what was read, and the
  confusions must lead from one to the other. Words that no confusion leads to a frequent word are not suspicious;
  that is a join of word shapes, in which letters that are confused are one.
* Line joins: an averaged perceptron decides for each distinct break from what is known of both sides.

Frequencies are relative everywhere (a correction is `RATIO` times as frequent as what was read), so nothing depends
on the size of the corpus. Confusions are learned from all frequent and all rare words, by a
join. The character perceptron is trained on all frequent words, garbled by the confusions: shards of about `EXAMPLES`
words each train one, and the weights are averaged. The one for line joins knows no words and is trained on made-up
breaks. Decisions are sent to the tasks of a repair only up to `BROADCAST_DECISIONS` rows; more are joined to the
documents.

Repaired text is in readable form (see `canon`): letters of other scripts stay.

Defined results: null stays null, blank text becomes empty; text without defects comes out with its soft line breaks
joined; repeated rows are repaired each; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import map_arrow
from leafmill.llm.canon import readable_texts
from leafmill.llm.store import together, written

#: Examples the character perceptron of a shard of words is trained on, at least; a shard has about as many words.
EXAMPLES = 12_000
#: A word in more than this share of all documents is never suspicious.
RARE = 0.01
#: A correction must be in so many times as many documents as what was read.
RATIO = 8
#: Words a confusion must be seen with, at least and as a share of the most common one's.
SUPPORT, SUPPORT_SHARE = 3, 0.015
BROADCAST_DECISIONS = 300_000
GLYPH = ""
CID = re.compile(r"\(cid:\d+\)")
MARKS = "-‐‑¬\xad"
WORD = re.compile(rf"[^\W_]+(?:[!:{GLYPH}]+[^\W_]*)*|[!:{GLYPH}]+[^\W_]+(?:[!:{GLYPH}]*[^\W_]+)*{GLYPH}*")
LETTER = re.compile(r"[^\W\d_]")
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿßœæ"
READABLE = re.compile(rf"[a-z{ACCENTED}0-9!:{GLYPH}]+$")
#: Small Latin letters: what a lost character of a readable word can have been.
LATIN = frozenset(ch for ch in map(chr, range(0x61, 0x250)) if ch.isalpha() and ch == ch.lower())


# ---------------------------------------------------------------- furniture

ROMAN = re.compile(r"^(?=[ivxlcIVXLC])(?:[xX]{0,3})(?:[iI][xX]|[iI][vV]|[vV]?[iI]{0,3}|[lL]?[xX]{0,3}[iI]{0,3})$")
NUMBERS = (
    ("words", re.compile(r"^(?:seite|page|pagina|página|pag\.?|pág\.?|p\.|blz\.?|s\.|bladzijde)\s*(\d{1,4})(?:\s*(?:/|of|van|von|sur|de|aus)\s*\d{1,4})?$", re.IGNORECASE)),
    ("of", re.compile(r"^(\d{1,4})\s?/\s?\d{1,4}$")),
    ("dash", re.compile(r"^[-–—]\s?(\d{1,4})\s?[-–—]$")),
    ("bracket", re.compile(r"^[\[(]\s?(\d{1,4})\s?[\])]$")),
    ("bare", re.compile(r"^(\d{1,4})$")),
)
ENDS = re.compile(r"[.!?:;…][\"”’»)\]]*$")
STRONG = ("words", "of", "dash")
TITLE_NUMBER = re.compile(r"^(?:(\d{1,4})\s{2,}(\S.*)|(\S.*?)\s{2,}(\d{1,4}))$")
TITLE_MARK = re.compile(r"^[A-Z]{2}\s+\d{1,2}\.\d{1,2}\s+")
STRUCTURE = re.compile(r"^(?:#{1,6}\s|[|>]|[-*•]\s|\d{1,4}[.)]\s|\[\^|```|[-*_=]{3,}$)")
FOLD = str.maketrans({"!": "i", "1": "i", "l": "i", "j": "i", "0": "o", "5": "s", "9": "g", "6": "e", "é": "e", "è": "e", "ê": "e", "ë": "e", "c": "e", "ä": "a", "à": "a", "á": "a", "f": "t", "b": "h", "ü": "u", "ú": "u", "ö": "o", "ó": "o", "ï": "i", "í": "i", "ñ": "n", "m": "n", ":": None, GLYPH: None})


def fold(text: str) -> str:
    """A key under which a word and what recognition makes of it mostly agree."""
    low = text.lower().replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("ii", "u").replace("li", "h")
    return low.translate(FOLD)


def _roman(text: str) -> int:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = 0
    for a, b in zip(text.lower(), text.lower()[1:] + " "):
        total += -value[a] if b in value and value[a] < value[b] else value[a]
    return total


def page_number(line: str) -> tuple[str, int] | None:
    """(style, number) of a line that could be nothing but a page number."""
    for style, pattern in NUMBERS:
        if m := pattern.match(line):
            return style, int(m[1])
    return ("roman", _roman(line)) if len(line) <= 7 and ROMAN.match(line) and line[0].isalpha() else None


class Furniture(NamedTuple):
    lines: frozenset[int]
    header: bool
    number: bool


class Group(NamedTuple):
    """Lines that could be the same piece of page furniture: (line, number in it or None) of one title, or of one style of page number."""

    style: str  # "title", or the style of a number
    found: list[tuple[int, int | None]]


def groups_of(bare: list[str]) -> list[Group]:
    """Candidates among stripped lines: lines of the form of a page number, by style, and short lines without a sentence's end, by shape."""
    numbers: dict[str, list[tuple[int, int | None]]] = {}
    titles: dict[str, list[tuple[int, int | None]]] = {}
    odd = {i: n for i, s in enumerate(bare) if s and len(s) <= 40 and (n := page_number(s))}
    for i, (style, value) in odd.items():
        numbers.setdefault(style, []).append((i, value))
    for i, s in enumerate(bare):
        if i in odd or not 6 <= len(s) <= 160 or s[-1] in ".!?:;," or STRUCTURE.match(s):
            continue
        own, inside = s, None
        if m := TITLE_NUMBER.match(s):
            own, inside = m[2] or m[3], int(m[1] or m[4])
        own = TITLE_MARK.sub("", own)
        key = fold("".join(ch for ch in own if ch.isalnum() or ch in "!:"))
        if len(key) >= 5 and sum(map(str.isalpha, own)) >= 5 and own[0].isupper() | own[0].isdigit() | (own[0] == "!"):
            titles.setdefault(key, []).append((i, inside))
    keys = sorted(titles, key=lambda k: -len(titles[k]))
    for n, key in enumerate(keys):  # titles that differ by a few misread letters are one
        for other in keys[n + 1 :]:
            if titles[key] and titles[other] and abs(len(key) - len(other)) <= 3 and _close(key, other):
                titles[key] += titles[other]
                titles[other] = []
    return [Group("title", sorted(f)) for f in titles.values() if f] + [Group(style, f) for style, f in numbers.items()]


def _bucket(x: float) -> str:
    return "0" if x == 0 else "low" if x < 0.5 else "most" if x < 1 else "all"


PLACES = 1 << 12


def place_keys(group: Group, bare: list[str], candidates: set[int], width: int) -> list[int]:
    """Features of a group: its form, how often it comes and counts, and where its lines stand on the pages."""
    lines = [i for i, _ in group.found]
    n = len(lines)

    def free(k: int) -> bool:
        return not 0 <= k < len(bare) or not bare[k] or k in candidates

    def beside(i: int, step: int) -> str:
        """The text before or behind a line, without blank lines and other candidates."""
        while 0 <= (i := i + step) < len(bare):
            if bare[i] and i not in candidates:
                return bare[i]
        return ""

    alone = sum(free(i - 1) and free(i + 1) for i in lines) / n
    apart = sum(free(i - 1) or free(i + 1) for i in lines) / n
    cut = sum(bool(before := beside(i, -1)) and bool(after := beside(i, 1)) and not ENDS.search(before) and (after[:1].islower() or before[-1] in MARKS) for i in lines) / n
    inner = sum(bool(beside(i, -1)) and bool(beside(i, 1)) for i in lines) / n
    near = sum(any(j in candidates and j != i for j in range(i - 3, i + 4)) for i in lines) / n
    short = sum(len(bare[i]) <= 0.75 * width for i in lines) / n
    full = str(min(9, int(10 * max(len(bare[i]) for i in lines) / max(1, width)))) if width else "x"
    size = [sum(map(len, bare[a + 1 : b])) for a, b in zip(lines, lines[1:])]  # text between two of the group
    even = "single" if n < 2 else "none" if min(size) == 0 else "even" if max(size) <= 2.5 * min(size) else "uneven"
    values = [v for _, v in group.found if v is not None]
    steps = [b - a for a, b in zip(values, values[1:])]
    rising = "none" if not steps else "one" if all(s == 1 for s in steps) else "few" if all(0 < s <= 4 for s in steps) else "no"
    inside = "none" if not values else "all" if len(values) == n else "some"
    kind, many = group.style, str(min(n, 3))
    words = [w for i in lines for w in bare[i].split() if w[:1].isalpha()]
    capital = _bucket(sum(w[0].isupper() for w in words) / max(1, len(words)))
    ending = "digit" if bare[lines[0]][-1].isdigit() else "mark" if bare[lines[0]][-1] in MARKS else "letter"
    named = [
        f"k{kind}", f"k{kind}n{many}", f"k{kind}r{rising}", f"k{kind}r{rising}n{many}", f"k{kind}a{_bucket(alone)}", f"k{kind}p{_bucket(apart)}r{rising}", f"k{kind}c{_bucket(cut)}", f"k{kind}n{many}c{_bucket(cut)}", f"k{kind}e{even}", f"n{many}e{even}",
        f"k{kind}i{_bucket(inner)}n{many}", f"k{kind}s{_bucket(short)}n{many}a{_bucket(alone)}", f"k{kind}near{_bucket(near)}n{many}", f"k{kind}in{inside}n{many}", f"k{kind}n{many}a{_bucket(alone)}r{rising}", f"k{kind}n{many}a{_bucket(alone)}s{_bucket(short)}r{rising}p{_bucket(apart)}", f"k{kind}w{full}p{_bucket(apart)}", f"k{kind}w{full}n{many}p{_bucket(apart)}", f"k{kind}up{capital}n{many}", f"k{kind}end{ending}n{many}", f"k{kind}up{capital}a{_bucket(alone)}s{_bucket(short)}n{many}", f"k{kind}up{capital}end{ending}p{_bucket(apart)}", "bias",
    ]
    return [zlib.crc32(x.encode()) % PLACES for x in named]


def sample_page(rng: random.Random) -> tuple[list[str], list[int]]:
    """(lines of a made-up document, the lines that are page furniture): paragraphs, headings, lists, lone numbers and repeated lines, and titles and page numbers at page breaks."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randrange(2, 11)))
    phrase = lambda n: " ".join(word() for _ in range(n))
    blocks: list[str] = ["# " + phrase(3)] if rng.random() < 0.7 else []
    wrap = rng.choice((0, 0, 60, 75, 90))
    lead = phrase(20).capitalize()  # how several paragraphs of a formal text begin
    for _ in range(rng.randrange(3, 14)):
        kind = rng.random()
        if kind < 0.66:
            text = " ".join(phrase(rng.randrange(6, 16)).capitalize() + rng.choice((".", ".", ".", "?", ";")) for _ in range(rng.randrange(1, 6)))
            if rng.random() < 0.5:
                text = lead[: rng.randrange(40, 110)] + " " + text
            lines, line = [], ""
            for w in text.split(" "):
                if wrap and len(line) + len(w) > wrap:
                    lines.append(line.strip())
                    line = ""
                line += w + " "
            if lines and rng.random() < 0.5:  # formal text repeats itself, and lines within paragraphs come out alike
                again = lead[: rng.randrange(wrap * 6 // 10, wrap)].rsplit(" ", 1)[0]
                lines.insert(rng.randrange(1, len(lines) + 1), again if rng.random() < 0.5 else again.replace(again.split(" ")[2], word()) if again.count(" ") > 2 else again)
            blocks.append("\n".join([*lines, line.strip()]))
        elif kind < 0.78:
            blocks.append("\n".join(rng.choice(("- ", "- ", f"{k + 1}. ")) + rng.choice((phrase(4), f"{rng.randrange(1, 400)} {word()}", str(rng.randrange(1, 99)))) for k in range(rng.randrange(2, 6))))
        elif kind < 0.84:
            blocks.append(f"## {phrase(2).capitalize()}")
        elif kind < 0.9:
            blocks.append("\n".join(f"| {rng.randrange(1, 90)} | {phrase(2)} |" for _ in range(rng.randrange(2, 5))))
        elif kind < 0.96:
            blocks.append(rng.choice((phrase(3).capitalize(), str(rng.randrange(1, 2050)), f"({rng.randrange(1, 30)})", word().capitalize() + " " + word().capitalize(), "[" + str(rng.randrange(1, 9)) + "]", "iv", "x")))
        else:
            blocks.append("\n".join(str(rng.randrange(1, 300)) for _ in range(rng.randrange(2, 4))))
    lines = "\n\n".join(blocks).split("\n")
    marked: list[int] = []
    if rng.random() < 0.65 and len(lines) > 6:
        titled, numbered = rng.random() < 0.75, rng.random() < 0.85
        title = rng.choice((str.upper, str.capitalize, str.title))(phrase(rng.randrange(2, 6))) + rng.choice(("", " 2031", " 31/7"))
        style = rng.choice(("{}", "{}", "- {} -", "[{}]", "({})", "{}/" + str(rng.randrange(9, 40)), "page {}", "p. {}", "– {} –", "roman"))
        first, inside, step = rng.randrange(1, 300), rng.random() < 0.3, rng.choice((1, 1, 1, 2))
        places = sorted(rng.sample(range(3, len(lines)), min(len(lines) - 3, rng.randrange(2, 6))), reverse=True)
        spaced = rng.random() < 0.75
        made = []
        for k, at in enumerate(reversed(places)):
            number = first % 30 + k + 1 if style == "roman" else first + k * step
            shown = _to_roman(number) if style == "roman" else style.format(number)
            head = "".join(rng.choice("ecti!l10") if rng.random() < 0.04 else ch for ch in title)
            own = [f"{number}   {head}" if rng.random() < 0.5 else f"{head}   {number}"] if titled and inside else [head] * titled + [shown] * (numbered and not (titled and inside))
            if rng.random() < 0.4:
                own.reverse()
            made.append(own)
        for at, own in zip(places, reversed(made)):
            if not own:
                continue
            gap = [""] * spaced
            block = [*gap, *(x for line in own for x in ((line, "") if spaced and len(own) > 1 else (line,))), *gap]
            marked = [m + len(block) if m >= at else m for m in marked] + [at + j for j, x in enumerate(block) if x]
            lines[at:at] = block
    return lines, marked


def _to_roman(n: int) -> str:
    return "x" * (n // 10) + ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[n % 10]


def _width(bare: list[str]) -> int:
    """The width at which a document's lines were broken; a line well below it within a paragraph was not."""
    body = sorted(len(s) for s in bare if len(s) > 40)
    return body[len(body) // 2] if body else 0


@functools.cache
def place_weights(pages: int = 2000, seed: int = 6) -> np.ndarray:
    """The perceptron that tells page furniture by place, trained on made-up documents."""
    rng = random.Random(seed)
    keys, labels = [], []
    for _ in range(pages):
        lines, marked = sample_page(rng)
        bare = [x.strip() for x in lines]
        groups = groups_of(bare)
        candidates, gone = {i for g in groups for i, _ in g.found}, set(marked)
        for g in groups:
            keys.append(place_keys(g, bare, candidates, _width(bare)))
            labels.append(int(2 * sum(i in gone for i, _ in g.found) > len(g.found)))
    return averaged_perceptron(np.array(keys, np.int64), np.array(labels, np.int64), 2, PLACES, epochs=6, batch=64)


def furniture(lines: list[str], weights: np.ndarray) -> Furniture:
    """The lines that are page furniture."""
    bare = [x.strip() for x in lines]
    groups = groups_of(bare)
    candidates = {i for g in groups for i, _ in g.found}
    gone: set[int] = set()
    header = number = False
    for g in groups:
        if len(g.found) < 2 and g.style not in STRONG:  # once is no repetition
            continue
        if np.diff(weights[place_keys(g, bare, candidates, _width(bare))].sum(0))[0] > 0:
            gone |= {i for i, _ in g.found}
            header |= g.style == "title"
            number |= g.style != "title" or any(v is not None for _, v in g.found)
    return Furniture(frozenset(gone), header, number)


def _close(a: str, b: str) -> bool:
    """Few differing letters, place by place from both ends."""
    n = min(len(a), len(b))
    front = next((i for i in range(n) if a[i] != b[i]), n)
    back = next((i for i in range(n - front) if a[-1 - i] != b[-1 - i]), n - front)
    if front + back >= 0.75 * max(len(a), len(b)):
        return True
    return len(a) == len(b) and sum(x == y for x, y in zip(a, b)) >= 0.85 * len(a)


# ---------------------------------------------------------------- perceptrons


def averaged_perceptron(features: np.ndarray, labels: np.ndarray, classes: int, size: int, epochs: int = 6, batch: int = 256, seed: int = 7) -> np.ndarray:
    """Averaged weights (size × classes) of a multi-class perceptron; mistakes of a batch are corrected together."""
    rng = np.random.default_rng(seed)
    w, total, steps = np.zeros((size, classes), np.float32), np.zeros((size, classes), np.float32), 0
    since = np.zeros((size, classes), np.int32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            guess = w[features[rows]].sum(1).argmax(1)
            wrong = np.flatnonzero(guess != labels[rows])
            steps += 1
            if not len(wrong):
                continue
            f, right, bad = features[rows[wrong]].ravel(), np.repeat(labels[rows[wrong]], features.shape[1]), np.repeat(guess[wrong], features.shape[1])
            for column, change in ((right, 1), (bad, -1)):
                cell = np.unique(f * classes + column)
                a, b = np.divmod(cell, classes)
                total[a, b] += w[a, b] * (steps - since[a, b])
                since[a, b] = steps
                np.add.at(w, (f, column), change)
    total += w * (steps + 1 - since)
    return total / max(1, steps)


EDITS = 1 << 15
#: Stretches around a character that are its features, from and to.
AROUND = ((0, 1), (-1, 1), (0, 2), (-1, 2), (-2, 1), (0, 3), (-2, 3), (-3, 0), (1, 4), (-3, 1), (0, 4), (-3, 4))


def char_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all characters of all words as read, hashed; bounds of the words)."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(f"__^{w}$__" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(bounds[-1]) + np.repeat(np.arange(len(words)) * 6 + 3, sizes)
    keys = np.empty((len(at), len(AROUND)), np.int64)
    for k, (low, high) in enumerate(AROUND):
        h = np.full(len(at), 1099511628211 * (k + 1), np.uint64)
        for off in range(low, high):
            h = (h ^ points[at + off]) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
        keys[:, k] = (h & np.uint64(EDITS - 1)).astype(np.int64)
    return keys, bounds


JOINS = 1 << 12
CONNECTIVES = frozenset("en of und oder bzw et ou y o e u and or to als wie noch tot bis".split())


def join_keys(known: int, mark: str, right: str, compound: bool, left_known: bool) -> list[int]:
    """Features of a mark at a line's end between two half words; known: 2 the whole is a word, 1 it can be corrected to one, 0 neither."""
    connective = right in CONNECTIVES
    named = (f"k{known}", f"m{mark}", f"k{known}m{mark}", f"c{connective}", f"h{compound}", f"l{left_known}k{known}", f"c{connective}k{known}", f"s{min(len(right), 4)}k{known}", f"h{compound}k{known}", "bias")
    return [zlib.crc32(x.encode()) % JOINS for x in named]


class Editor(NamedTuple):
    """Weights of both perceptrons, what the classes stand for (None keeps the character), and the confusions."""

    weights: np.ndarray
    outputs: tuple[str | None, ...]
    joins: np.ndarray
    confusions: tuple[tuple[str, str], ...]


def learn_confusions(words: dict[str, int], reads: dict[str, int]) -> tuple[tuple[str, str], ...]:
    """(written, read) pairs by which a rare word differs from a frequent one in one place, with enough different words, the most common first.

    A letter with an accent counts only if it became a sign or digit: a plain letter in its place is a matter of
    encoding or spelling.
    """
    index: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for w in words:
        if len(w) >= 4:
            for i in range(len(w)):
                for k in (1, 2):
                    if i + k <= len(w):
                        index.setdefault((w[:i], w[i + k :]), []).append((w, w[i : i + k]))
    seen: dict[tuple[str, str], set[str]] = {}
    for r, n in reads.items():
        if not 4 <= len(r) <= 40 or GLYPH in r:
            continue
        for i in range(len(r)):
            for k in (1, 2, 3):
                if i + k > len(r):
                    continue
                b = r[i : i + k]
                for w, a in index.get((r[:i], r[i + k :]), ()):
                    plain = (a.isascii() or not b.isalpha()) and (b.isascii() or len(a) == len(b) == 1 and unicodedata.normalize("NFD", b)[0] == a)
                    if plain and a[0] != b[0] and a[-1] != b[-1] and words[w] >= RATIO * n and not (len(a) == 2 and k == 2):
                        seen.setdefault((a, b), set()).add(w)
    best = max(map(len, seen.values()), default=0)
    kept = [(len(v), pair) for pair, v in seen.items() if len(v) >= max(SUPPORT, SUPPORT_SHARE * best)]
    return tuple(pair for _, pair in sorted(kept, key=lambda x: (-x[0], x[1])))


def cuts(word: Column, sizes: tuple[int, ...]) -> Column:
    """(key: a word without a stretch of characters, cut: the stretch), one for each place and size."""
    places = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.array(*(F.struct(i.alias("at"), F.lit(k).alias("size")) for k in sizes)))), lambda x: x["at"] + x["size"] <= F.length(word) + 1)
    return F.transform(places, lambda x: F.struct(F.concat(F.substring(word, F.lit(1), x["at"] - 1), F.lit("\x1f"), F.substring(word, x["at"] + x["size"], F.length(word))).alias("key"), F.substring(word, x["at"], x["size"]).alias("cut")))


def confusions_of(words: DataFrame, reads: DataFrame) -> tuple[tuple[str, str], ...]:
    """`learn_confusions` of all (read, docs) of two tables, by a join: only the confusions come to the driver."""
    written_ = words.where(F.length("read") >= 4).select(F.col("read").alias("word"), F.col("docs").alias("known"), F.inline(cuts(F.col("read"), (1, 2)))).withColumnRenamed("cut", "a")
    misread = reads.where(F.length("read").between(4, 40) & ~F.contains(F.col("read"), F.lit(GLYPH))).select("docs", F.inline(cuts(F.col("read"), (1, 2, 3)))).withColumnRenamed("cut", "b")
    ascii_ = lambda c: F.length(c) == F.octet_length(c)
    bare = "".join(unicodedata.normalize("NFD", ch)[0] for ch in ACCENTED)
    a, b = F.col("a"), F.col("b")
    plain = (ascii_(a) | ~b.rlike(r"^\p{L}+$")) & (ascii_(b) | (F.length(a) == 1) & (F.length(b) == 1) & (F.translate(b, ACCENTED, bare) == a))
    apart = (F.left(a, F.lit(1)) != F.left(b, F.lit(1))) & (F.right(a, F.lit(1)) != F.right(b, F.lit(1))) & ~((F.length(a) == 2) & (F.length(b) == 2))
    # a plan by the size of the words would send the many more cuts to all tasks
    seen = written_.hint("merge").join(misread, "key").where((F.col("known") >= RATIO * F.col("docs")) & plain & apart).select("a", "b", "word").distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    seen = written(seen, "confusions")
    best = seen.agg(F.max("n").alias("best")).first().best or 0
    kept = seen.where(F.col("n") >= SUPPORT_SHARE * best).collect()
    return tuple((r.a, r.b) for r in sorted(kept, key=lambda r: (-r.n, r.a, r.b)))


def garble(word: str, rng: random.Random, rate: float, confusions: tuple[tuple[str, str], ...]) -> tuple[str, list[str | None]]:
    """(a word as recognition may read it, for each character read what it stands for; None for itself)."""
    read, stands = "", []
    i = 0
    while i < len(word):
        options = [(a, b) for a, b in confusions if word.startswith(a, i)]
        if options and rng.random() < rate:
            a, b = rng.choice(options)
            read += b
            stands += [a, *[""] * (len(b) - 1)]
            i += len(a)
        elif rng.random() < rate * 0.15:
            read += GLYPH
            stands.append(word[i])
            i += 1
        else:
            read += word[i]
            stands.append(None)
            i += 1
    return read, stands


def outputs_of(letters: Iterable[str], confusions: tuple[tuple[str, str], ...]) -> tuple[str | None, ...]:
    """The classes of the character perceptron: keep, delete, and what a character can stand for."""
    return (None, "", *sorted({a for a, _ in confusions} | LATIN.intersection(letters)))


def char_weights(words: list[str], confusions: tuple[tuple[str, str], ...], outputs: tuple[str | None, ...], seed: int = 11) -> np.ndarray:
    """The character perceptron of words; every word is an example, few words are several."""
    rng = random.Random(seed)
    number = {o: i for i, o in enumerate(outputs)}
    made = [garble(w, rng, 0.18 if k % 3 else 0.0, confusions) for k, w in zip(range(max(EXAMPLES, len(words)) if words else 0), itertools.cycle(words))]
    labels = np.array([number.get(s, 0) for _, stands in made for s in stands], np.int64)
    return averaged_perceptron(char_keys([r for r, _ in made])[0], labels, len(outputs), EDITS, epochs=3).astype(np.float32) if made else np.zeros((EDITS, len(outputs)), np.float32)


@functools.cache
def join_weights(seed: int = 11) -> np.ndarray:
    """The perceptron of line joins, trained on made-up breaks; of the right half its features know the length alone."""
    rng = random.Random(seed)
    pairs, answers = [], []
    for k in range(4000):
        right = "x" * (2 + k % 7)
        known = 2 if k % 5 else 1 if k % 2 else 0
        pairs += [join_keys(known, rng.choice("---‐‑¬\xad"), right, False, rng.random() < 0.3), join_keys(0 if k % 3 else 2, "-", right, True, True), join_keys(0, "-", rng.choice(sorted(CONNECTIVES)), False, True)]
        answers += [1, 0 if k % 3 else 1, 0]
    return averaged_perceptron(np.array(pairs, np.int64), np.array(answers, np.int64), 2, JOINS)


def train_editor(words: list[str], confusions: tuple[tuple[str, str], ...]) -> Editor:
    """Both perceptrons, from words in memory."""
    outputs = outputs_of("".join(words), confusions)
    return Editor(char_weights(words, confusions, outputs), outputs, join_weights(), confusions)


#: Rows of the weights that are averaged together.
BLOCK = 1 << 10


def trained_editor(words: DataFrame, confusions: tuple[tuple[str, str], ...]) -> Editor:
    """`train_editor` of all (read, docs) of a table: shards of about `EXAMPLES` words are trained in tasks of their own, and their weights averaged."""
    letters = words.select(F.explode(F.split("read", "")).alias("ch")).where(F.col("ch").isin(*LATIN)).distinct()
    count, found = together(words.sparkSession, words.count, letters.collect)
    outputs, shards = outputs_of([r.ch for r in found], confusions), max(1, -(-count // EXAMPLES))

    def train(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["read"].to_pylist(), table["docs"].to_pylist()), key=lambda r: (-r[1], r[0]))
        shard = table["shard"][0].as_py()
        weights = char_weights([r for r, _ in rows], confusions, outputs, 11 + shard)
        blocks = [weights[at : at + BLOCK].tobytes() for at in range(0, EDITS, BLOCK)]
        return pa.table({"block": pa.array(range(len(blocks)), pa.int32()), "shard": pa.array([shard] * len(blocks), pa.int32()), "weights": pa.array(blocks, pa.binary())})

    def average(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK * len(outputs))
        for _, weights in sorted(zip(table["shard"].to_pylist(), table["weights"].to_pylist())):
            total += np.frombuffer(weights, np.float32)
        return pa.table({"block": table["block"][:1], "weights": pa.array([(total / shards).astype(np.float32).tobytes()], pa.binary())})

    each = words.select("read", "docs", F.pmod(F.xxhash64("read"), F.lit(shards)).cast("int").alias("shard")).groupBy("shard").applyInArrow(train, "block int, shard int, weights binary")
    means = each.groupBy("block").applyInArrow(average, "block int, weights binary").collect()
    weights = np.zeros((EDITS, len(outputs)), np.float32)
    for r in means:
        weights[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.weights, np.float32).reshape(BLOCK, -1)
    return Editor(weights, outputs, join_weights(), confusions)


#: Changes of a word tried together at most, and changes to choose from, best first.
TOGETHER, MOVES = 4, 9


def readings(reads: list[str], editor: Editor) -> list[list[tuple[float, str]]]:
    """For each word as read, what the editor would have it be: (score, word), those the confusions allow."""
    keys, bounds = char_keys(reads)
    scores = editor.weights[keys].sum(1) if len(keys) else np.zeros((0, len(editor.outputs)), np.float32)
    behind = {b: {a for a, x in editor.confusions if x == b} for _, b in editor.confusions}
    longest = max(map(len, behind), default=0)
    letters = {o for o in editor.outputs if o and len(o) == 1}
    number = {o: i for i, o in enumerate(editor.outputs)}
    out = []
    for n, read in enumerate(reads):
        own = scores[bounds[n] : bounds[n + 1]]
        fills, moves = [], []  # (score against keeping, from, to, what stands there)
        for i, ch in enumerate(read):
            if ch == GLYPH:
                order = [c for c in np.argsort(-own[i]) if editor.outputs[c] in letters]
                fills.append([(float(own[i, c] - own[i, 0]), i, i + 1, editor.outputs[c]) for c in order])
                continue
            for size in range(1, min(longest, len(read) - i) + 1):
                for a in behind.get(read[i : i + size], ()):
                    score = own[i, number[a]] - own[i, 0] + sum(own[j, 1] - own[j, 0] for j in range(i + 1, i + size))
                    moves.append((float(score), i, i + size, a))
        moves = sorted(moves, reverse=True)[:MOVES]
        if len(fills) > 1:  # with several lost characters, the likeliest for each
            fills = [f[:6] for f in fills[:3]]
        found: dict[str, float] = {}
        for count in range(0 if fills else 1, min(1 if fills else TOGETHER, len(moves)) + 1):
            for chosen in itertools.combinations(moves, count):
                if any(x[1] < y[2] and y[1] < x[2] for x, y in itertools.combinations(chosen, 2)):
                    continue
                for filled in itertools.product(*fills):
                    word, at = "", 0
                    for _, low, high, what in sorted((*chosen, *filled), key=lambda x: x[1]):
                        word, at = word + read[at:low] + what, high
                    word += read[at:]
                    if GLYPH not in word and word.isalpha():
                        score = sum(x[0] for x in chosen) + sum(x[0] for x in filled)
                        found[word] = max(found.get(word, score), score)
        out.append([(score, word) for word, score in found.items()])
    return out


# ---------------------------------------------------------------- documents

HEAD = re.compile(rf"[ \t]*((?:[^\W_]|[!{GLYPH}])+)")
HALF = re.compile(rf"(?:[^\W_]|[!:{GLYPH}])+$")
LAST_MARK = re.compile(rf"[{MARKS}]$")
COMPOUND = re.compile(r"(?<![\w-])[^\W\d_]{2,}-[^\W\d_]{2,}(?![\w-])")
NO_BODY = ("#", "|", "[^", "```")


def bodies(text: str, weights: np.ndarray) -> tuple[list[str], Furniture]:
    """(lines of a readable text without page furniture, the furniture); what furniture cut stands together again."""
    lines = CID.sub(GLYPH, text).split("\n")
    gone = furniture(lines, weights)
    kept: list[str] = []
    hole = False
    for i, line in enumerate(lines):
        if i in gone.lines:
            hole = True
            continue
        if hole and line.strip():
            while kept and not kept[-1].strip():
                kept.pop()
            before = kept[-1].rstrip() if kept else ""
            head = line.lstrip()
            cut = before and not before.lstrip().startswith(("#", "|")) and not STRUCTURE.match(head) and (before[-1] in MARKS or head[:1].islower())
            if not cut and kept:
                kept.append("")
            hole = False
        kept.append(line)
    return kept, gone


def joined(kept: list[str], decide: Callable[[str, str, str], bool | None]) -> list[str]:
    """Paragraphs as lines. decide(left, mark, right) says of a word broken across lines whether it is one word (True), a compound that keeps its mark (False), or two words (None)."""
    out: list[str] = []
    for line in kept:
        stripped = line.strip()
        last = out[-1] if out else ""
        plain = last and not last.startswith(("#", "|"))
        if plain and stripped and last[-1] in MARKS and (m := LAST_MARK.search(last)) and (half := HALF.search(last[:-1])) and (head := HEAD.match(line)) and head[1][:1].islower() | (head[1][0] in "!" + GLYPH) and LETTER.search(half[0]):
            whole = decide(half[0].lower(), m[0], head[1].lower())
            out[-1] = last[:-1] + stripped if whole else last + stripped if whole is False else last + " " + stripped
        elif stripped and last and (stripped[0].isalpha() or not STRUCTURE.match(stripped)) and not last.startswith(("#", "|", "---", "```")):
            out[-1] = last + " " + stripped
        else:
            out.append(stripped)
    return out


def read_words(line: str) -> Iterator[tuple[int, int, str]]:
    """(begin, end, word in small letters) of the words of a line that could be misread."""
    for m in WORD.finditer(line):
        if word := readable_word(m[0].lower()):
            yield m.start(), m.start() + len(word), word


def readable_word(word: str) -> str:
    """A word without marks at its end; nothing if it could not be a misread one."""
    word = word.rstrip(":!")
    return word if len(word) >= 2 and LETTER.search(word) or GLYPH in word else ""


def counted_words(body: str) -> dict[str, int]:
    """The words of a text with their counts, as `read_words` has them; each distinct word is looked at once."""
    out: dict[str, int] = {}
    for found, n in Counter(WORD.findall(body.lower())).items():
        if word := found if found.isalpha() and len(found) > 1 else readable_word(found):
            out[word] = out.get(word, 0) + n
    return out


SOFT = re.compile("\xad(?=[ \t]*\n)")


def prepared(column: pa.Array) -> list[str | None]:
    """Readable texts of a batch; soft hyphens at line ends become visible ones, as they are no invisible noise there."""
    return readable_texts([t if t is None or "\xad" not in t else SOFT.sub("¬", t) for t in column.to_pylist()])


ANALYSED = "doc_id long, text string, header boolean, number boolean, reads array<string>, times array<int>, compounds array<string>, breaks array<string>"


def analysed(df: DataFrame, id_column: str, column: str, keep_text: bool) -> DataFrame:
    """Documents taken apart, one row each with a number of its own (`row`), as a table in the shared folder."""
    sent = df.sparkSession.sparkContext.broadcast(place_weights())  # weights of fixed size

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = prepared(batch.column(1))
        columns: list[list] = [[] for _ in range(6)]
        for text in texts:
            breaks: list[str] = []

            def decide(left: str, mark: str, right: str, breaks: list[str] = breaks) -> bool | None:
                breaks.append("\x1f".join((left, mark, right)))
                return None if mark == "-" and right in CONNECTIVES else True

            kept, gone = bodies(text, sent.value) if text else ([], Furniture(frozenset(), False, False))
            body = "\n".join(x for x in joined(kept, decide) if not x.startswith(NO_BODY))
            reads = counted_words(body)
            compounds = set(COMPOUND.findall(body.lower())) if "-" in body else ()
            for values, value in zip(columns, (gone.header, gone.number, list(reads), list(reads.values()), list(compounds), breaks)):
                values.append(value)
        kinds = (pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts if keep_text else [None] * len(texts), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "text", "header", "number", "reads", "times", "compounds", "breaks"])

    chosen = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("text"))
    return written(map_arrow(chosen, one, ANALYSED).withColumn("row", F.monotonically_increasing_id()), "pages")


def shape(word: Column, confusions: tuple[tuple[str, str], ...]) -> Column:
    """A word with confused letters made one."""
    for a, b in sorted(confusions, key=lambda x: (-len(x[0]) - len(x[1]), x)):
        if len(a) > 1 or len(b) > 1:
            word = F.replace(word, F.lit(b), F.lit(a)) if len(b) >= len(a) else F.replace(word, F.lit(a), F.lit(b))
    group: dict[str, str] = {}
    for a, b in confusions:
        if len(a) == len(b) == 1:
            old, new = group.get(b, b), group.get(a, a)
            group |= {c: new for c in (*[k for k, v in group.items() if v == old], a, b)}
    changed = sorted(k for k, v in group.items() if k != v)
    return F.translate(word, "".join(changed), "".join(group[c] for c in changed)) if changed else word


class Decisions(NamedTuple):
    """(read, word): corrections; (parts, word, rare): words taken apart, by their parts with a blank, rare if both parts are; (break, whole): breaks that are one word (true), or a compound (false)."""

    corrections: DataFrame
    splits: DataFrame
    breaks: DataFrame


def decisions(pages: DataFrame) -> Decisions:
    """What is to be done with each distinct word and break of a corpus, from its analysed documents."""
    spark = pages.sparkSession
    documents, words = together(spark, pages.count, lambda: written(pages.select(F.explode("reads").alias("read")).groupBy("read").agg(F.count("*").alias("docs")), "words"))
    letters = words.where(F.col("read").rlike(r"^\p{L}{2,40}$"))
    readable = words.where((F.col("docs") <= F.greatest(F.lit(RARE * documents), F.lit(1.0))) & F.length("read").between(3, 60) & F.col("read").rlike(READABLE.pattern) & F.col("read").rlike(r"[\p{L}]") & (F.length(F.regexp_replace("read", "[^0-9]", "")) <= 0.5 * F.length("read")))
    frequent = letters.where(F.col("docs") >= 2).select(F.col("read").alias("word"), F.col("docs").alias("known"))

    def trained() -> Editor:
        top = letters.where((F.length("read") >= 3) & (F.col("docs") >= RATIO))  # a correction is in RATIO times as many documents
        return trained_editor(top, confusions_of(top, readable))

    def parted_words() -> DataFrame:
        """Words taken apart by a blank: both parts were read, and the rarer is rare beside the whole."""
        cuts = frequent.where((F.col("known") >= RATIO) & (F.length("word") >= 5)).select("word", "known", F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("at"))
        parted = cuts.select("word", "known", F.substring("word", F.lit(1), F.col("at")).alias("left"), F.expr("substring(word, at + 1)").alias("right"))
        both = parted.join(words.select(F.col("read").alias("left"), F.col("docs").alias("l")), "left").join(words.select(F.col("read").alias("right"), F.col("docs").alias("r")), "right")
        splits = both.where(F.col("known") >= RATIO * F.least("l", "r")).select(F.concat_ws(" ", "left", "right").alias("parts"), "word", (F.col("known") >= RATIO * F.greatest("l", "r")).alias("rare"))
        return written(splits.groupBy("parts").agg(F.max("word").alias("word"), F.bool_or("rare").alias("rare")), "splits")

    editor, splits = together(spark, trained, parted_words)
    confusions = editor.confusions
    sent = spark.sparkContext.broadcast(editor)  # weights of fixed size

    def edit(batch: pa.RecordBatch) -> pa.RecordBatch:
        reads, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [(r, n, w, s) for r, n, found in zip(reads, docs, readings(reads, sent.value)) for s, w in found]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int64(), pa.string(), pa.float32()))], names=["read", "own", "word", "score"])

    shapes = frequent.select(shape(F.col("word"), confusions).alias("shape")).distinct()
    lost = F.contains(F.col("read"), F.lit(GLYPH))
    suspicious = readable.where(~lost).withColumn("shape", shape(F.col("read"), confusions)).join(shapes, "shape", "left_semi").select("read", "docs").unionByName(readable.where(lost).select("read", "docs"))
    confirmed = map_arrow(suspicious.repartition("read"), edit, "read string, own long, word string, score float").where("word != read").join(frequent, "word").where(F.col("known") >= F.greatest(F.lit(2), RATIO * (F.col("own") - 1)))
    corrections = written(confirmed.groupBy("read").agg(F.max(F.struct("score", "known", "word")).alias("best")).select("read", "best.word"), "corrections")

    broken = pages.select(F.explode("breaks").alias("break")).groupBy("break").agg(F.count("*").alias("times"))
    part = F.split("break", "\x1f")
    sides = broken.select("break", "times", part[0].alias("left"), part[1].alias("mark"), part[2].alias("right"), F.concat(part[0], part[2]).alias("whole"))
    often = sides.groupBy("whole").agg(F.sum("times").alias("broken"))
    compounds = pages.select(F.explode("compounds").alias("compound")).distinct().withColumn("hyphened", F.lit(True))
    known = (
        sides.join(often, "whole")
        .join(words.select(F.col("read").alias("whole"), F.col("docs").alias("whole_docs")), "whole", "left")
        .join(corrections.select(F.col("read").alias("whole"), F.lit(True).alias("mended")), "whole", "left")
        .join(words.select(F.col("read").alias("left"), F.col("docs").alias("left_docs")), "left", "left")
        .withColumn("compound", F.concat_ws("-", "left", "right"))
        .join(compounds, "compound", "left")
        .select("break", "mark", "right", F.when(F.col("whole_docs") > F.col("broken"), 2).when(F.col("mended"), 1).otherwise(0).alias("known"), F.coalesce("hyphened", F.lit(False)).alias("hyphened"), (F.coalesce("left_docs", F.lit(0)) > 0).alias("left_known"))
    )

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(6))))
        keys = np.array([join_keys(known, mark, right, hyphened, left) for _, mark, right, known, hyphened, left in rows], np.int64)
        whole = [bool(x) and not (r[1] == "-" and r[2] in CONNECTIVES) for x, r in zip(np.diff(sent.value.joins[keys].sum(1), axis=1)[:, 0] > 0, rows)] if rows else []
        value = [True if w else False if r[4] else None for w, r in zip(whole, rows)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.bool_())], names=["break", "whole"])

    return Decisions(corrections, splits, written(map_arrow(known, join, "break string, whole boolean"), "breaks"))


def defects(df: DataFrame, id_column: str = "doc_id", column: str = "markdown", least_misread: int = 3) -> DataFrame:
    """(doc_id, defect), distinct. Texts are read once; words and breaks meet their decisions without them.

    Of a word taken apart both parts must be rare beside it, as here it is not seen that they stand side by side.
    """
    pages = analysed(df, id_column, column, False)
    made = decisions(pages)
    halves = F.split("parts", " ")
    pairs = made.splits.where("rare").select(halves[0].alias("left"), halves[1].alias("right"))
    keys = made.corrections.select("read").unionByName(pairs.select(F.explode(F.array("left", "right")).alias("read"))).distinct()
    each = pages.select("row", F.explode(F.arrays_zip("reads", "times")).alias("x")).select("row", F.col("x.reads").alias("read"), F.col("x.times").alias("times"))
    marked = each.join(written(keys.withColumn("key", F.lit(True)), "keys"), "read", "left").where(F.col("key") | F.contains(F.col("read"), F.lit(GLYPH)))
    marked = written(marked.select("row", "read", "times"), "marked")  # few of all words
    wrong = marked.join(made.corrections, "read", "left").where(F.col("word").isNotNull() | F.contains(F.col("read"), F.lit(GLYPH))).select("row", "times")
    apart = marked.select("row", F.col("read").alias("left")).join(pairs, "left").join(marked.select("row", F.col("read").alias("right")), ["row", "right"]).select("row", F.lit(1).alias("times"))
    misread = wrong.unionByName(apart).groupBy("row").agg(F.sum("times").alias("n")).where(F.col("n") >= least_misread).select("row", F.lit("misread").alias("defect"))
    hyphens = pages.select("row", F.explode("breaks").alias("break")).join(made.breaks.where("whole"), "break").select("row", F.lit("hyphenation").alias("defect")).distinct()
    flags = F.array_compact(F.array(F.when(F.col("header"), "running_header"), F.when(F.col("number"), "page_number")))
    local = pages.select("row", F.explode(flags).alias("defect"))
    return misread.unionByName(hyphens).unionByName(local).join(pages.select("row", "doc_id"), "row").select("doc_id", "defect").distinct()


def repair_text(text: str, places: np.ndarray, corrections: dict[str, str], splits: dict[str, str], breaks: dict[str, bool]) -> tuple[str, int, int]:
    """(a readable text without scan noise, words joined across lines, words corrected)."""
    count = [0, 0]

    def decide(left: str, mark: str, right: str) -> bool | None:
        whole = breaks.get("\x1f".join((left, mark, right)))
        count[0] += whole is True
        return whole

    def like(word: str, new: str) -> str:
        return new.upper() if word.isupper() and len(word) > 3 else new[0].upper() + new[1:] if word[0].isupper() else new

    def mend(line: str) -> str:
        words, out, at, k = [*read_words(line)], [], 0, 0
        while k < len(words):
            begin, end, low = words[k]
            after = words[k + 1] if k + 1 < len(words) else None
            new = None
            if after and after[0] == end + 1 and line[end] == " " and line[after[1] : after[1] + 1] not in ("’", "'"):
                new = splits.get(f"{low} {after[2]}")
                if new:
                    end, k = after[1], k + 1
            new = new or corrections.get(low)
            if new:
                out += [line[at:begin], like(line[begin:end], new)]
                at = end
            count[1] += bool(new) or GLYPH in low
            k += 1
        return "".join(out) + line[at:] if out else line

    body = [line if line.startswith(NO_BODY) else mend(line) for line in joined(bodies(text, places)[0], decide)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(body)).strip().replace(GLYPH, "\ufffd"), *count


def repair(df: DataFrame, id_column: str = "doc_id", column: str = "markdown", most: int = BROADCAST_DECISIONS) -> DataFrame:
    """(doc_id, repaired, joined, misread) for every row.

    Up to `most` decisions are sent to all tasks; more of them are joined to the words and breaks of each document.
    """
    spark = df.sparkSession
    pages = analysed(df, id_column, column, True)
    made = decisions(pages)
    keyed = made.corrections.select(F.lit("c").alias("kind"), F.col("read").alias("key"), F.col("word").alias("value"))
    keyed = keyed.unionByName(made.splits.select(F.lit("s"), F.col("parts").alias("key"), F.col("word").alias("value")).toDF("kind", "key", "value"))
    keyed = keyed.unionByName(made.breaks.where("whole is not null").select(F.lit("b"), "break", F.col("whole").cast("string")).toDF("kind", "key", "value"))
    keyed = written(keyed, "decisions")
    schema = "doc_id long, repaired string, joined int, misread int"
    places = spark.sparkContext.broadcast(place_weights())

    def tables(rows: list[tuple[str, str, str]]) -> tuple[dict[str, str], dict[str, str], dict[str, bool]]:
        return {k: v for t, k, v in rows if t == "c"}, {k: v for t, k, v in rows if t == "s"}, {k: v == "true" for t, k, v in rows if t == "b"}

    def rows_of(ids: pa.Array, done: list[tuple[str, int, int] | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([d and d[0] for d in done], pa.string()), pa.array([d[1] if d else 0 for d in done], pa.int32()), pa.array([d[2] if d else 0 for d in done], pa.int32())], names=["doc_id", "repaired", "joined", "misread"])

    if len(few := keyed.limit(most + 1).collect()) <= most:
        sent = spark.sparkContext.broadcast(tables([tuple(r) for r in few]))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return rows_of(batch.column(0), [None if t is None else repair_text(t, places.value, *sent.value) for t in batch.column(1).to_pylist()])

        return map_arrow(pages.select("doc_id", "text"), one, schema)

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        return rows_of(batch.column(0), [None if t is None else repair_text(t, places.value, *tables([(p["kind"], p["key"], p["value"]) for p in part or ()])) for t, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())])

    words = pages.select("row", F.explode("reads").alias("key"))
    halves = F.split("key", " ")
    parted = keyed.where("kind = 's'").select("kind", "key", "value", halves[0].alias("left"), halves[1].alias("right"))
    met = (
        words.join(keyed.where("kind = 'c'"), "key").select("row", "kind", "key", "value")
        .unionByName(pages.select("row", F.explode(F.array_distinct("breaks")).alias("key")).join(keyed.where("kind = 'b'"), "key").select("row", "kind", "key", "value"))
        .unionByName(words.withColumnRenamed("key", "left").join(parted, "left").join(words.withColumnRenamed("key", "right"), ["row", "right"]).select("row", "kind", "key", "value"))
    )
    grouped = met.groupBy("row").agg(F.collect_list(F.struct("kind", "key", "value")).alias("part"))
    return map_arrow(pages.join(grouped, "row", "left").select("doc_id", "text", "part"), own, schema)
