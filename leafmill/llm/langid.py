"""Problem 1: the language of documents and of their segments, by hyperdimensional profiles.

Each letter has a random bipolar vector. A trigram is the product of its letters' vectors, the first permuted twice
and the second once; a text is the sum of its trigrams, a language the sum of the texts that carry its label. A text
belongs to the language with the greatest cosine. Since the vector of a text is a sum, its product with a prototype is
the sum of the products of its trigrams: those are kept in a table (trigrams × languages), so a batch of sentences is
scored with one gather and one segmented sum. The length of a text vector is the root of the sum of its squared
trigram counts, which is exact up to the chance products of random vectors.

Prototypes are fitted on a sample of at most about `TRAIN_ROWS` rows of each language whose label names it alone, drawn
by a hash over the whole table; wrong labels only dim them. They are centred on their common mean, so that what all
languages share does not count. A second round recounts the sample's rows whose labels the first round agrees with.
Every row of the table is then identified with them, in one scan.

A document is cut into sentences; headings, tables, separators and encoded data are no prose. Sentences are scored one by one; one that is too
short or too even takes the language of its neighbours. Consecutive sentences of one language are a segment. The main
language is the one with most letters; its confidence is the share of its sentences' letters times the confidence in
them. What is near no prototype has the language "und".

Defined results: null, blank and prose-free texts have no language and no segment; ties go to the order of `CODES`;
repeated rows are labelled each; extra columns are not read. Without any labelled row there is no prototype and no
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import ROWS, code_points, map_arrow
from leafmill.llm.canon import canonical_points
from leafmill.llm.labels import CODES, named_languages

DIMENSIONS = 2048
LETTERS = " abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ'"
SIZE = 64
#: Letters of scripts with a number of their own: Greek, Cyrillic, Hebrew and Arabic, and those of the Far East.
SCRIPTS = ((0x370, 0x400), (0x400, 0x530), (0x590, 0x800), (0x3040, 0xD7B0))
#: Letters below which a sentence takes its neighbours' language, and the least lead of the best cosine.
SHORT, LEAD = 18, 0.02
#: Letters from which a line without an end mark counts by itself.
FRAGMENT = 60
SHARPNESS = 25.0
#: A sentence, and a whole stretch or document, below this cosine with all prototypes is in none of the languages.
STRANGE, STRANGE_WHOLE = 0.06, 0.2
#: Labelled rows of each language the prototypes are fitted on.
TRAIN_ROWS = 2000
NAMES = (*CODES, "und")
OTHER = len(CODES)


def _letters() -> np.ndarray:
    """Code point → letter number; capitals as small letters, other letters one number, the rest a space."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x250):
        low = chr(cp).lower()
        out[cp] = LETTERS.index(low) if low in LETTERS and low != " " else SIZE - 1 if low.isalpha() else 0
    out[0x250:0x2000] = SIZE - 1
    out[0x2019] = LETTERS.index("'")
    out[0x3000:] = SIZE - 1
    for number, (low, high) in enumerate(SCRIPTS, SIZE - 1 - len(SCRIPTS)):
        out[low:high] = number
    return out


LETTER = _letters()


def trigrams(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram numbers, row of each, letters of each row); runs of spaces count once, rows begin and end with one."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    padded = np.zeros(len(points) + n, np.uint8)  # one space in front of each row, and one behind the last
    row = np.repeat(np.arange(n), sizes)
    padded[np.arange(len(points)) + row + 1] = LETTER[points]
    rows = np.repeat(np.arange(n), sizes + 1)
    padded = np.append(padded, 0)
    rows = np.append(rows, n - 1 if n else 0)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    padded, rows = padded[keep].astype(np.int32), rows[keep]
    letters = np.bincount(rows[padded > 0], minlength=n) if n else np.zeros(0, np.int64)
    if len(padded) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), letters
    gram = padded[:-2] * SIZE * SIZE + padded[1:-1] * SIZE + padded[2:]
    middle = padded[1:-1] > 0
    return gram[middle], rows[1:-1][middle], letters


class Prototypes(NamedTuple):
    """Product of each trigram vector with each centred unit prototype (float32, trigrams × languages)."""

    table: np.ndarray


def letter_vectors(seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SIZE, DIMENSIONS))


def prototypes(counts: np.ndarray) -> Prototypes:
    """From trigram counts (languages × trigrams). The vector of a trigram is a product of three, so sums over trigrams are taken letter by letter."""
    letters = letter_vectors().astype(np.float32)
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    share = (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32).reshape(len(counts), SIZE, SIZE, SIZE)
    bundle = np.zeros((len(counts), DIMENSIONS))
    for f in range(SIZE):
        if share[:, f].any():
            bundle += first[f] * ((share[:, f] @ letters) * second).sum(1)
    seen = counts.sum(1) > 0
    if seen.sum() > 1:
        bundle[seen] -= bundle[seen].mean(0)
    norm = np.linalg.norm(bundle, axis=1, keepdims=True)
    bundle = np.where(seen[:, None], bundle / np.where(norm > 0, norm, 1), 0).astype(np.float32)
    table = np.empty((SIZE, SIZE, SIZE, len(counts)), np.float32)
    for f in range(SIZE):
        turned = (bundle * first[f])[:, None, :] * second
        table[f] = np.moveaxis(turned @ letters.T, 0, -1)
    table = table.reshape(SIZE**3, len(counts))
    table[:, ~seen] = -1e3
    return Prototypes(table)


def cosines(points: np.ndarray, bounds: np.ndarray, model: Prototypes) -> tuple[np.ndarray, np.ndarray]:
    """(rows × languages cosines, letters of each row)."""
    n = len(bounds) - 1
    gram, row, letters = trigrams(points, bounds)
    dots = np.zeros((n, model.table.shape[1]))
    if len(row):
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))  # rows come in order
        dots[row[begin]] = np.add.reduceat(model.table[gram], begin, axis=0)
    pair, count = np.unique(row.astype(np.int64) * SIZE**3 + gram, return_counts=True)
    norm = np.sqrt(np.bincount(pair // SIZE**3, count.astype(np.float64) ** 2, n) * DIMENSIONS) if n else np.zeros(0)
    return dots / np.maximum(norm, 1e-9)[:, None], letters


# ---------------------------------------------------------------- sentences

MONTH = r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)"
END = re.compile(rf"[.!?…](?:(?<!\d\.)|(?![ \n]+{MONTH}\b))[\"”’»)\]]*(?:[ \n]*»)?(?:\[\^[^\]]*\])*(?=\s|$)")
ABBREVIATION = re.compile(r"(?:\b(?:art|nr|no|bzw|vgl|sog|Abs|Nr|Art|Dr|Mr|Mrs|St|Sr|Sra|cf|p|pp|etc|i\.e|e\.g|o\.a|d\.w\.z|z\.B|M|Mme)|\b(?:vom|am|dem|den|zum|bis|seit|ab)[ \n]+\d{1,2}|\b\p{Lu})\.$".replace(r"\p{Lu}", "[A-Z]"))
BLOCK = re.compile(r"\n[ \t]*\n+")
NOT_PROSE = re.compile(r"^\s*(?:#{1,6}\s|\||[-*_=]{3,}\s*$|```)")
#: Runs without a blank that are no word: hashes, encoded data, addresses; they have a digit or sign, which long compounds and scripts without blanks have not.
NO_WORD = re.compile(r"(?=[!-~]*[0-9/+=_@\\#%&])[!-~]{31,}")
WORD = re.compile(r"(?<![^\W_])[^\W\d_]{2,30}(?![^\W_])")
QUOTE = re.compile(r"^\s*>")
OPEN, CLOSE = "«“„\"‹»", "»”“\"›«"
MARKER = re.compile(r"^\s*(?:[-*•>]\s+|\(?\d{1,4}[.)]\s+|\[\^[^\]]*\]:?\s+)")


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """(begin, end, whole) of the sentences of the prose; not whole without an end mark, or as a quotation."""
    out = []
    at = 0
    blocks = []
    for m in BLOCK.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    for begin, end in blocks:
        # lines that are no prose cut a block, and so does each list item
        start, position = begin, begin
        parts, quoted = [], False
        for line in text[begin:end].split("\n"):
            stop = position + len(line)
            if line[:1].isalpha():  # neither structure nor a marker
                pass
            elif NOT_PROSE.match(line):
                if start < position:
                    parts.append((start, position, quoted))
                start, quoted = stop + 1, False
            elif (m := MARKER.match(line)) is not None:
                if start < position:
                    parts.append((start, position, quoted))
                start, quoted = position + m.end(), QUOTE.match(line) is not None
            position = stop + 1
        if start < end:
            parts.append((start, end, quoted))
        for low, high, quoted in parts:
            while low < high and text[low].isspace():
                low += 1
            piece = text[low:high]
            last = 0
            for m in END.finditer(piece):
                at = m.start()
                if not piece[at - 7 : at].isalpha() and ABBREVIATION.search(piece, max(0, at - 10), at + 1):  # seven letters are no abbreviation
                    continue
                if m.end() > last:
                    inner = piece[last] in OPEN and piece[m.end() - 1] in CLOSE
                    out.append((low + last, low + m.end(), not quoted and not inner))
                    last = m.end()
                    while last < len(piece) and piece[last].isspace():
                        last += 1
            if last < len(piece) and piece[last:].strip():
                out.append((low + last, low + len(piece.rstrip()), False))
    return [s for s in out if (m := WORD.search(text, s[0], s[1])) and WORD.search(text, m.end(), s[1])]


class Segment(NamedTuple):
    lang: int
    confidence: float
    begin: int
    end: int
    whole: int  # full sentences


def judged(cosine: np.ndarray, letters: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best language of each sentence, whether it is sure by itself)."""
    best = cosine.argmax(1)
    top = np.partition(cosine, -2, axis=1)[:, -2:]
    clear = (letters >= SHORT) & (whole | (letters >= FRAGMENT))
    best = np.where(clear & (top[:, 1] < STRANGE), OTHER, best)
    return best, clear & (top[:, 1] - top[:, 0] >= LEAD) | (best == OTHER)


def segments(spans: list[tuple[int, int, bool]], cosine: np.ndarray, letters: np.ndarray, whole: np.ndarray, best: np.ndarray, sure: np.ndarray) -> tuple[int, float, list[Segment]]:
    """(main language or -1, its confidence, segments) from the sentences of a document; number `OTHER` is none of the languages."""
    if not len(spans) or not letters.any():
        return -1, 0.0, []
    votes = np.bincount(best[sure], letters[sure], OTHER + 1)
    main = int(votes.argmax()) if votes.any() else int((cosine * letters[:, None]).sum(0).argmax())

    def confidence(a: int, b: int, k: int) -> float:
        rows = slice(a, b)
        mean = (cosine[rows] * letters[rows, None]).sum(0) / max(1, letters[rows].sum())
        if k == OTHER:
            return float(min(1.0, max(0.0, 1 - mean.max() / STRANGE)))
        power = np.exp(SHARPNESS * (mean - mean.max()))
        return float(power[k] / power.sum())

    def weak(a: int, b: int, k: int) -> bool:
        """Whether a stretch is too far from its language as a whole."""
        n = letters[a:b].sum()
        return k != OTHER and n >= SHORT and (cosine[a:b, k] * letters[a:b]).sum() < (STRANGE_WHOLE if n >= FRAGMENT else STRANGE) * n

    if (best[sure] == main).all():  # one language, as in most documents
        main = OTHER if weak(0, len(spans), main) else main
        sure_of = confidence(0, len(spans), main)
        return main, sure_of, [Segment(main, sure_of, spans[0][0], spans[-1][1], int((whole & (letters >= 10)).sum()))]
    lang = np.where(sure, best, -1)
    after, behind = main, np.empty(len(lang), np.int64)  # the next sure language
    for i in range(len(lang) - 1, -1, -1):
        behind[i] = after
        after = lang[i] if lang[i] >= 0 else after
    for i in range(len(lang)):  # an unsure sentence between two of one language is theirs, any other its neighbours' or the main language's
        if lang[i] < 0:
            near = [main, *(k for k in (lang[i - 1] if i else main, behind[i]) if k != OTHER)]
            lang[i] = lang[i - 1] if i and lang[i - 1] == behind[i] else main if main == OTHER or letters[i] < SHORT else max(near, key=lambda k: cosine[i, k])
    out = []
    cut = np.flatnonzero(np.diff(lang)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(lang)]):
        k = OTHER if weak(a, b, int(lang[a])) else int(lang[a])
        out.append(Segment(k, confidence(a, b, k), spans[a][0], spans[b - 1][1], int((whole[a:b] & (letters[a:b] >= 10)).sum())))
    own = lang == main
    if main != OTHER and own.any() and (cosine[own, main] * letters[own]).sum() < STRANGE_WHOLE * letters[own].sum() and letters[own].sum() >= FRAGMENT:
        main = OTHER
    inside = [(x.confidence, letters[a:b].sum()) for x, a, b in zip(out, [0, *cut.tolist()], [*cut.tolist(), len(lang)]) if x.lang == main]
    return main, float(sum(c * n for c, n in inside) / letters.sum()) if inside else 0.0, out


def _counts(df: DataFrame) -> np.ndarray:
    """Trigram counts by language of (label, text) rows: at most languages × trigrams rows of each task reach the shuffle, and as many the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(CODES) * SIZE**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                codes = np.array([CODES.index(x) for x in part.column(0).to_pylist()], np.int64)
                gram, row, _ = trigrams(*canonical_points(*code_points(part.column(1)), True))
                total += np.bincount(codes[row] * SIZE**3 + gram, minlength=len(total))
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], names=["key", "n"])

    summed = df.select("label", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(CODES) * SIZE**3)
    out[np.array(summed["key"])] = np.array(summed["n"])
    return out.reshape(len(CODES), SIZE**3)


def sample(df: DataFrame, column: str, label: str, most: int) -> DataFrame:
    """(label, text): about `most` rows of each language whose label names it alone, chosen by a hash of their text and place in no order; all where there are fewer."""
    names = named_languages(F.col(label))
    rows = df.where(F.col(column).isNotNull()).select(F.when(F.size(names) == 1, F.element_at(names, 1)).alias("label"), F.col(column).alias("text")).where("label is not null")
    counted = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counted:
        return rows
    share = F.create_map(*(F.lit(x) for code, n in counted.items() for x in (code, min(1.0, most / n))))
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(share, F.col("label")) * (1 << 20)
    return rows.where(drawn)


def train(df: DataFrame, column: str = "markdown", label: str = "lang", rounds: int = 2, most: int = TRAIN_ROWS) -> Prototypes:
    """Prototypes from a bounded sample of the rows whose label names one language."""
    spark = df.sparkSession
    rows = sample(df, column, label, most)
    model = prototypes(_counts(rows))
    for _ in range(rounds - 1):
        sent = spark.sparkContext.broadcast(model)

        def agree(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            cosine, letters = cosines(*canonical_points(*code_points(batch.column(1)), True), sent.value)
            said = np.array([CODES.index(x) for x in batch.column(0).to_pylist()], np.int64)
            return batch.filter(pa.array((cosine.argmax(1) == said) & (letters >= SHORT)))

        kept = _counts(map_arrow(rows, agree, "label string, text string"))
        model = prototypes(kept) if kept.any() else model
    return model


SEGMENTS = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("begin", pa.int64()), ("end", pa.int64()), ("sentences", pa.int32())]))


def identify(df: DataFrame, id_column: str = "doc_id", column: str = "markdown", label: str = "lang", model: Prototypes | None = None) -> DataFrame:
    """(doc_id, named, main, confidence, segments) for every row; named are the languages of the label."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model or train(df, column, label))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        spans = [sentences(t) if t else [] for t in texts]
        pieces: list[str] = []
        for t, own in zip(texts, spans):
            if own and max(map(len, t.split())) > 30:
                pieces += [NO_WORD.sub(" ", t[a:b]) for a, b, _ in own]
            else:
                pieces += [t[a:b] for a, b, _ in own]
        cosine, letters = cosines(*canonical_points(*code_points(pa.array(pieces, pa.string())), True), sent.value)
        whole = np.array([w for own in spans for _, _, w in own], bool)
        best, certain = judged(cosine, letters, whole)
        main, sure, parts, at = [], [], [], 0
        for own in spans:
            rows = slice(at, at + len(own))
            k, c, s = segments(own, cosine[rows], letters[rows], whole[rows], best[rows], certain[rows])
            at = rows.stop
            main.append(NAMES[k] if k >= 0 else None)
            sure.append(c if k >= 0 else None)
            parts.append([{"lang": NAMES[x.lang], "confidence": x.confidence, "begin": x.begin, "end": x.end, "sentences": x.whole} for x in s])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(main, pa.string()), pa.array(sure, pa.float64()), pa.array(parts, SEGMENTS)], names=["doc_id", "named", "main", "confidence", "segments"])

    chosen = df.select(F.col(id_column).cast("long").alias("doc_id"), named_languages(F.col(label)).alias("named"), F.col(column).alias("text"))
    return map_arrow(chosen, one, "doc_id long, named array<string>, main string, confidence double, segments array<struct<lang: string, confidence: double, begin: long, end: long, sentences: int>>")


def unnamed(df: DataFrame, least_sentences: int = 2) -> DataFrame:
    """(doc_id, lang): main languages, and languages of segments of two sentences or more, that the label does not name."""
    found = identify(df).where("main is not null")
    foreign = F.transform(F.filter("segments", lambda s: s["sentences"] >= least_sentences), lambda s: s["lang"])
    langs = F.array_except(F.array_union(F.array("main"), foreign), F.array_append("named", F.lit("und")))
    return found.select("doc_id", F.explode(langs).alias("lang")).distinct()
