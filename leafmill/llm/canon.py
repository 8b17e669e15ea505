"""Problem 6: one form for text that looks the same.

A batch of texts becomes one array of code points. A lookup table says for each code point how many code points
replace it and where they stand in an expansion table: full-width and half-width forms, ligatures, mathematical
alphabets and Roman numeral signs become their plain letters, all kinds of space become U+0020, invisible characters
vanish, look-alike Cyrillic, Greek and other letters become the Latin letter, and composed letters fall into base and
marks. The gather is one numpy operation for the batch; marks are then put in canonical order and composed again, run
by run, all runs of the batch at once; so are the letters of Korean syllables.

The canonical form is for comparing: texts that look the same are equal in it, so a Cyrillic or Greek text loses its
look-alike letters there. The readable form is for reading: it differs in one point, a look-alike letter becomes Latin
only in a word that has Latin letters, too.

Defined results: a null stays null; an empty text stays empty; line breaks and tabs are kept, and so is the number of
spaces; digits, case, accents and punctuation are never merged. Repeated rows give repeated rows; extra columns of any
name are carried through untouched (`canonicalize`) or dropped (`same_looking`, `classes`). Null ids have no pair and no class.
"""

from __future__ import annotations

import functools
import itertools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leafmill.llm.arrowtext import code_points, map_arrow, to_strings
from leafmill.llm.store import written

#: Letters of other scripts that common typefaces draw exactly as the Latin letter below them.
LOOK_ALIKE = (
    # Cyrillic
    "АВЕЅІЈКМНОРСТХҮԛԚԜаеѕіјорсухһԁԝӏѵѴҽ",
    "ABESIJKMHOPCTXYqQWaesijopcyxhdwlvVe",
    # Greek
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρυιϲϳϹ",
    "ABEZHIKMNOPTYXaovpuicjC",
    # Armenian, Cherokee, Latin extensions and letter-like signs
    "օոսցհԼՏՕꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴⲟⲞⲣⲢⲤⲥⲔⲘⲚⲎⲦⲬⲂꞲɡɑℓ",
    "onughLSOBPdDTGKJCZFMNLSRVHWXYAEIOUoOpPCcKMNHTXBJgal",
)
#: Compatibility forms that look like their plain letters; others (superscripts, fractions, circled) look different.
PLAIN_KINDS = ("<wide>", "<narrow>", "<font>", "<noBreak>")
#: Code points with a <compat> form that reads as the same letters: ligatures, digraphs, Roman numerals.
COMPAT_RANGES = ((0xFB00, 0xFB06), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0x00B5, 0x00B5))
#: Code points that can have a form: all but ideographs, Korean syllables, surrogates, private and unassigned planes.
TABLED = ((0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xF900, 0x17000), (0x1AFF0, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))
#: Invisible besides the characters of category Cf.
INVISIBLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))


def _between(cp: int, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(low <= cp <= high for low, high in ranges)


@functools.cache
def tables(fold: bool = True) -> dict[str, np.ndarray]:
    """Lookup tables over all code points, built once per worker from the Unicode data of Python; without `fold` look-alike letters stay."""
    same: dict[str, str] = {}
    for other, latin in zip(LOOK_ALIKE[::2], LOOK_ALIKE[1::2]):
        for a, b in zip(other, latin):
            same[a] = b
    latin_of = np.zeros(sys.maxunicode + 1, np.uint32)
    for a, b in same.items():
        latin_of[ord(a)] = ord(b)
    if not fold:
        same = {}
    split = np.zeros(sys.maxunicode + 1, bool)  # letters that fall into a look-alike letter and marks, when those are not folded here
    script = np.zeros(sys.maxunicode + 1, np.uint8)  # 1 within a word, 2 a Latin letter
    size = sys.maxunicode + 1
    ccc = np.zeros(size, np.uint8)
    # expansions into base and marks, and into composed letters for texts without marks
    length, start = np.ones((2, size), np.uint8), np.full((2, size), -1, np.int32)
    data: list[int] = []
    pairs: dict[int, int] = {}
    for cp in itertools.chain(*map(range, *zip(*TABLED))):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cn" or kind == "Co":
            continue
        form = unicodedata.decomposition(ch)
        ccc[cp] = unicodedata.combining(ch)
        if kind[0] in "LM":
            script[cp] = 1 + (kind[0] == "L" and not latin_of[cp] and unicodedata.name(ch, "").startswith("LATIN "))
        if (kind == "Cf" and not 0x600 <= cp <= 0x605 and cp not in (0x6DD, 0x70F)) or _between(cp, INVISIBLE):
            out = ""
        elif kind == "Zs" and cp != 0x1680:
            out = " "
        else:
            out = ch
            if form.startswith(PLAIN_KINDS) or form.startswith("<compat>") and _between(cp, COMPAT_RANGES):
                out = "".join(chr(int(x, 16)) for x in form.split()[1:])
            out = "".join(same.get(x, x) for x in unicodedata.normalize("NFD", out))
            out = "".join(same.get(x, x) for x in unicodedata.normalize("NFD", out))
        if form and form[0] != "<" and len(two := form.split()) == 2:
            a, b = (int(x, 16) for x in two)
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                pairs[a << 21 | b] = cp
        split[cp] = len(out) > 1 and any(latin_of[ord(x)] for x in out)
        for kept, form in enumerate((out, unicodedata.normalize("NFC", out))):
            if form != ch:
                length[kept, cp], start[kept, cp] = len(form), len(data)
                data += map(ord, form)
    keys = np.array(sorted(pairs), np.int64)
    hard = ccc > 0  # code points whose text must be put in order and composed
    hard[0x1100:0x1200] = True
    if not fold:
        hard |= (latin_of > 0) | split
    for cp in np.flatnonzero(start[0] >= 0).tolist():
        form = data[start[1, cp] : start[1, cp] + length[1, cp]] if start[1, cp] >= 0 else []
        hard[cp] |= any(ccc[x] for x in form)
    return {"hard": hard, "length": length, "start": start, "data": np.array(data, np.uint32), "ccc": ccc, "pair": keys, "whole": np.array([pairs[k] for k in keys.tolist()], np.uint32), "latin": latin_of, "script": script, "split": split}


def _compose(points: np.ndarray, keep_ccc: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(code points with marks in canonical order and composed, mask of those that stay). All runs at once, one mark a step."""
    alive = np.ones(len(points), bool)
    mark = keep_ccc > 0
    if not mark.any():
        return points, alive
    at = np.flatnonzero(mark)
    first = at[np.concatenate(([True], np.diff(at) > 1))]
    last = at[np.concatenate((np.diff(at) > 1, [True]))]
    points = points.copy()
    if (last > first).any():  # order marks of a run by class, keeping the order within a class
        run = np.cumsum(np.concatenate(([True], np.diff(at) > 1)))
        order = np.lexsort((np.arange(len(at)), keep_ccc[at], run))
        points[at] = points[at][order]
        keep_ccc = keep_ccc.copy()
        keep_ccc[at] = keep_ccc[at][order]
    runs = first > 0
    base, first, last = first[runs] - 1, first[runs], last[runs]
    blocked = np.zeros(len(base), np.uint8)
    step = 0
    while len(base):
        here = first + step
        key = points[base].astype(np.int64) << 21 | points[here]
        k = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        fits = (t["pair"][k] == key) & (blocked < keep_ccc[here])
        points[base[fits]] = t["whole"][k[fits]]
        alive[here[fits]] = False
        blocked = np.where(fits, blocked, keep_ccc[here])
        step += 1
        more = first + step <= last
        base, first, last, blocked = base[more], first[more], last[more], blocked[more]
    return points, alive


def _syllables(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading and vowel letters, and syllables and final letters, of Korean put together, by the arithmetic of Unicode."""
    for first, size, second, count in ((0x1100, 19, 0x1161, 21), (0xAC00, 11172, 0x11A8, 27)):
        a, b = points[:-1].astype(np.int64) - first, points[1:].astype(np.int64) - second
        fits = (a >= 0) & (a < size) & (b >= 0) & (b < count)
        if first == 0xAC00:
            fits &= a % 28 == 0
        inner = bounds[1:-1]
        fits[inner[(inner > 0) & (inner < len(points))] - 1] = False  # never across texts
        if fits.any():
            points = points.copy()
            at = np.flatnonzero(fits)
            points[at] = 0xAC00 + (a[at] * 21 + b[at]) * 28 if first == 0x1100 else points[at] + b[at] + 1
            alive = np.ones(len(points), bool)
            alive[at + 1] = False
            bounds = np.concatenate(([0], np.cumsum(alive)))[bounds]
            points = points[alive]
    return points, bounds


def _mixed_words(points: np.ndarray, bounds: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Look-alike letters as Latin letters in words that have Latin letters, too."""
    if not t["latin"][points[points >= 0x80]].any():
        return points
    other = t["latin"][points]
    kind = t["script"][points]
    inside = kind > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[bounds[:-1][bounds[:-1] < len(points)]] |= inside[bounds[:-1][bounds[:-1] < len(points)]]
    word = np.cumsum(begins)
    latin = np.zeros(int(word[-1]) + 1, bool)
    latin[word[kind == 2]] = True
    change = (other > 0) & inside & latin[word]
    return np.where(change, other, points).astype(np.uint32)


def _expanded(points: np.ndarray, bounds: np.ndarray, t: dict[str, np.ndarray], kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Each code point replaced by what the tables have for it."""
    at = np.flatnonzero(points >= 0x80)  # ASCII stays
    changed = at[t["start"][kept][points[at]] >= 0]
    if not len(changed):
        return points, bounds
    source, sizes = t["start"][kept][points[changed]], t["length"][kept][points[changed]].astype(np.int64)
    if (sizes == 1).all():
        out = points.copy()
        out[changed] = t["data"][source]
        return out, bounds
    length = np.ones(len(points), np.int64)
    length[changed] = sizes
    after = np.concatenate(([0], np.cumsum(length)))
    out = np.repeat(points, length)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(after[changed], sizes) + inner] = t["data"][np.repeat(source, sizes) + inner]
    return out, after[bounds]


def canonical_points(points: np.ndarray, bounds: np.ndarray, readable: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Canonical (or readable) code points and bounds of a batch.

    Texts without marks, letters of Korean syllables and (for the readable form) look-alike letters take one gather;
    the others are taken out of the batch, put in order and composed, and put back.
    """
    if not len(points) or points.max() < 0x80:
        return points, bounds
    t = tables(not readable)
    at = np.flatnonzero(points >= 0x80)
    rows = np.unique(np.searchsorted(bounds, at[t["hard"][points[at]]], side="right") - 1)
    easy, easy_bounds = _expanded(points, bounds, t, 1)
    if not len(rows):
        return easy, easy_bounds
    sizes = bounds[rows + 1] - bounds[rows]
    inner = np.concatenate(([0], np.cumsum(sizes)))
    hard, hard_bounds = _composed(points[np.repeat(bounds[rows] - inner[:-1], sizes) + np.arange(inner[-1])], inner, t, readable)
    parts, done = [], 0
    for k, row in enumerate(rows.tolist()):
        parts += [easy[easy_bounds[done] : easy_bounds[row]], hard[hard_bounds[k] : hard_bounds[k + 1]]]
        done = row + 1
    parts.append(easy[easy_bounds[done] :])
    lengths = np.diff(easy_bounds)
    lengths[rows] = np.diff(hard_bounds)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(lengths)))


def _composed(points: np.ndarray, bounds: np.ndarray, t: dict[str, np.ndarray], readable: bool) -> tuple[np.ndarray, np.ndarray]:
    out, bounds = _expanded(points, bounds, t, 0)
    if readable and len(out):
        out = _mixed_words(out, bounds, t)
    if ((out >= 0x1100) & (out < 0x1200)).any():
        out, bounds = _syllables(out, bounds)
    ccc = t["ccc"][out]
    ccc[bounds[:-1][bounds[:-1] < len(out)]] = 0  # a mark that begins a text has no base, and none across texts
    out, alive = _compose(out, ccc, t)
    if not alive.all():
        bounds = np.concatenate(([0], np.cumsum(alive)))[bounds]
        out = out[alive]
    return out, bounds


def visible_counts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Visible characters of each canonical text: all but spaces, line breaks and controls."""
    seen = np.concatenate(([0], np.cumsum((points > 0x20) & ((points < 0x7F) | (points > 0x9F)) & (points != 0x2028) & (points != 0x2029))))
    return seen[bounds[1:]] - seen[bounds[:-1]]


def canonical_text(text: str | None, readable: bool = False) -> str | None:
    """One text, for tests and lookups."""
    return None if text is None else canonical_strings(pa.array([text], pa.string()), readable)[0].as_py()


def canonical_strings(column: pa.Array, readable: bool = False) -> pa.Array:
    """An Arrow text column in canonical (or readable) form."""
    return to_strings(*canonical_points(*code_points(column), readable), valid=np.asarray(column.is_valid()))


def readable_texts(texts: list[str | None]) -> list[str | None]:
    """Texts in readable form; only those that have anything to change are taken apart."""
    points, bounds = code_points(pa.array(texts, pa.string()))
    at = np.flatnonzero(points >= 0x80)
    t = tables(False)
    changed = (t["start"][1][points[at]] >= 0) | t["hard"][points[at]]
    rows = np.unique(np.searchsorted(bounds, at[changed], side="right") - 1).tolist()
    out = list(texts)
    for row, text in zip(rows, canonical_strings(pa.array([texts[r] for r in rows], pa.string()), True).to_pylist() if rows else ()):
        out[row] = text
    return out


def canonicalize(df: DataFrame, column: str = "markdown", into: str = "canonical", readable_into: str = "readable") -> DataFrame:
    """df with the canonical form of `column` in `into` and its readable form in `readable_into` (replaced if there are such columns)."""
    at = df.columns.index(column)
    fields = [f for f in df.schema.fields if f.name not in (into, readable_into)]
    keep = [i for i, f in enumerate(df.schema.fields) if f.name not in (into, readable_into)]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [batch.column(i) for i in keep] + [canonical_strings(batch.column(at)), canonical_strings(batch.column(at), True)]
        return pa.RecordBatch.from_arrays(out, names=[f.name for f in fields] + [into, readable_into])

    return map_arrow(df, one, StructType([*fields, StructField(into, StringType()), StructField(readable_into, StringType())]))


def looks(df: DataFrame, id_column: str = "doc_id", column: str = "markdown") -> DataFrame:
    """(doc_id, look, exact, visible): digests of the canonical form and of the text itself; no text leaves the scan stage."""
    import hashlib

    def digests(points: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        raw = points.astype("<u4").tobytes()
        return [hashlib.blake2b(raw[4 * a : 4 * b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        points, bounds = code_points(batch.column(1))
        canon, canon_bounds = canonical_points(points, bounds)
        arrays = [batch.column(0), pa.array(digests(canon, canon_bounds), pa.binary()), pa.array(digests(points, bounds), pa.binary()), pa.array(visible_counts(canon, canon_bounds), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "look", "exact", "visible"])

    chosen = df.where(F.col(column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("text"))
    return map_arrow(chosen, one, "doc_id long, look binary, exact binary, visible long")


#: Members of one text that share a task when its pairs are listed.
SHARE = 10_000


def look_alikes(df: DataFrame, id_column: str = "doc_id", column: str = "markdown", least_visible: int = 20) -> tuple[DataFrame, DataFrame]:
    """(members, texts): (doc_id, look, exact) of all documents, and (look, exact, copies) of the texts whose look has several.

    The digests are written once, so the texts are read once. A text with any number of copies is one row of `texts`.
    """
    rows = written(looks(df, id_column, column).where(F.col("visible") >= least_visible).select("doc_id", "look", "exact"), "looks")
    members = rows.distinct()
    texts = members.groupBy("look", "exact").agg(F.count("*").alias("copies"))
    mixed = texts.groupBy("look").agg(F.count("*").alias("forms")).where("forms > 1").select("look")
    return members, written(texts.join(mixed, "look"), "texts")


def same_looking(df: DataFrame, id_column: str = "doc_id", column: str = "markdown", least_visible: int = 20) -> DataFrame:
    """Pairs (doc_id_a < doc_id_b) of documents whose texts differ as strings and have one canonical form.

    Different texts of a look are paired first, each text once however many copies it has; copies of one text never
    meet. The members of both texts are attached afterwards: a text's members are spread over one salt for each `SHARE`
    of them, and its pair is repeated for each salt. So the work is that of the result, in tasks of even size.
    """
    members, texts = look_alikes(df, id_column, column, least_visible)
    salted = texts.withColumn("salts", F.floor(F.col("copies") / SHARE).cast("int"))
    left, right = (salted.select("look", F.col("exact").alias(f"exact_{x}"), F.col("salts").alias(f"salts_{x}")) for x in "ab")
    pairs = left.join(right, "look").where("exact_a < exact_b")
    for x in "ab":
        pairs = pairs.withColumn(f"salt_{x}", F.explode(F.sequence(F.lit(0), F.col(f"salts_{x}")))).drop(f"salts_{x}")
    own = members.join(salted, ["look", "exact"]).select("look", "exact", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("salts") + 1).cast("int").alias("salt"))
    for x in "ab":
        side = own.select("look", F.col("exact").alias(f"exact_{x}"), F.col("doc_id").alias(x), F.col("salt").alias(f"salt_{x}"))
        pairs = pairs.join(side, ["look", f"exact_{x}", f"salt_{x}"])
    return pairs.where("a != b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def classes(df: DataFrame, id_column: str = "doc_id", column: str = "markdown", least_visible: int = 20) -> DataFrame:
    """(doc_id, class_id, members, links): one row a document that looks like a different text; the class is its least id, links are the members with another text."""
    members, texts = look_alikes(df, id_column, column, least_visible)
    own = members.join(texts, ["look", "exact"])
    whole = own.groupBy("look").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    return own.join(whole, "look").select("doc_id", "class_id", "members", (F.col("members") - F.col("copies")).alias("links"))
