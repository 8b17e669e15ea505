"""Operators for training text: brute force, round trips, and the awkward inputs each must take."""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import canon, labels, langid, leak, mojibake, ocr, pack, pii, split, tokens

NL = "De commissie verwijst naar het bestreden besluit van de gemeente. Het college heeft nagelaten te vermelden dat de vergunning ontbreekt. De rechtbank acht de vordering niet bindend voor de partijen. "
EN = "The committee refers back to the contested decision of the municipality. There is no sign that the licence was put under pressure by the court. The duty of care relies on the agreement with the parties. "
DE = "Die Behörde verweist auf die angefochtene Entscheidung der Gemeinde. Das Gericht stützt sich auf die Vereinbarung und würdigt die Begründung. Die Verfügung ist für die Beklagte nicht verbindlich. "
FR = "La commission renvoie à la décision contestée de la commune. Rien dans le dossier n’indique que l’autorisation était connue en temps utile. Le devoir de diligence se fonde sur la convention. "
ES = "La comisión remite a la resolución impugnada del municipio. No hay indicios de que la licencia sufriera presiones en la vista. El deber de diligencia se basa en el convenio de la empresa. "
MD = "doc_id long, markdown string, lang string, kind string, text string, canonical string"


@pytest.fixture(scope="module")
def md(spark):
    """Labelled documents and awkward ones: null, empty, blank, repeated, without prose, with clashing columns."""
    rows = [(100 * i + k, t * (1 + k % 3), lab, "document", "x", "y") for i, (t, lab) in enumerate(((NL, "nl-NL"), (EN, "English"), (DE, "ger"), (FR, "fr"), (ES, "Español"))) for k in range(6)]
    odd = [(900, None, "nl"), (901, "", None), (902, "  \n ", "x"), (903, "| 1 | 2 |\n| --- | --- |", "nl"), (None, NL, None), (904, NL, "EN"), (904, NL, "EN"), (905, NL + FR, "nl"), (906, NL + "« La commission renvoie à la décision. » " + NL, "NL"), (907, NL, "NL;fr"), (908, NL, None)]
    return spark.createDataFrame([*rows, *((i, t, lab, "document", "x", "y") for i, t, lab in odd)], MD)


def empty(spark, schema=MD):
    return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- p1


def test_labels(spark):
    cases = {"NL": ["nl"], "nl-BE": ["nl"], "EN_us": ["en"], "Deutsch (Schweiz)": ["de"], "nl+es": ["es", "nl"], "FR/EN": ["en", "fr"], "n/a": [], "??": [], " ": [], None: [], "Français": ["fr"], "dut": ["nl"]}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    got = df.select(labels.named_languages(df.l).alias("n"), labels.single_label(df.l).alias("s")).collect()
    assert [r.n for r in got] == list(cases.values())
    assert {r.s for r in got} == {"nl", "en", "de", "fr", "mul", "und"}


def test_languages(spark, md):
    got = {r.doc_id: r for r in langid.identify(md).collect()}
    for i, code in enumerate(("nl", "en", "de", "fr", "es")):
        assert got[100 * i].main == code and got[100 * i].confidence > 0.8
    assert got[900].main is None and got[901].main is None and got[902].main is None and got[903].main is None
    assert [s.lang for s in got[905].segments] == ["nl", "fr"]
    found = {(r.doc_id, r.lang) for r in langid.unnamed(md).collect()}
    assert {(904, "nl"), (905, "fr"), (908, "nl"), (None, "nl")} <= found
    assert not {f for f in found if f[0] in (906, 907, 903, 902)}
    assert langid.unnamed(empty(spark)).count() == 0


def test_other_languages_and_long_words(spark, md):
    rows = [(1, "Суд пришёл к выводу о том, что решение комиссии не является обязательным для сторон. Дело передано на новое рассмотрение в районный суд.", None), (2, "法院认为该决定对双方没有约束力，因为没有证据表明该许可证在听证会之前已经被撤销或者变更。", "nl")]
    rows += [(3, NL + "Donaudampfschifffahrtsgesellschaftskapitänswitwe. " + "QUJD" * 30 + "/x1= ", "nl")]
    got = {r.doc_id: r.main for r in langid.identify(spark.createDataFrame(rows, "doc_id long, markdown string, lang string"), model=langid.train(md)).collect()}
    assert got == {1: "und", 2: "und", 3: "nl"}
    assert langid.NO_WORD.search("Donaudampfschifffahrtsgesellschaftskapitänswitwe") is None


def test_held_out_accuracy():
    """Prototypes from the first sentences of each text name the language of the others, and products equal the vectors' own."""
    langs = (NL, EN, DE, FR, ES)
    first = [" ".join(t.split(". ")[:2]) for t in langs]
    counts = np.stack([np.bincount(langid.trigrams(*langid.code_points(pa.array([t])))[0], minlength=langid.SIZE**3) for t in first]).astype(float)
    model = langid.prototypes(counts)
    letters = langid.letter_vectors().astype(float)
    for a, b, c in ((1, 5, 9), (0, 20, 3)):
        gram = np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        bundles = []
        for row in counts:
            at = np.flatnonzero(row)
            bundles.append(sum(row[k] * np.roll(letters[k // 4096], 2) * np.roll(letters[k // 64 % 64], 1) * letters[k % 64] for k in at) / row.sum())
        centred = np.array(bundles) - np.mean(bundles, 0)
        centred /= np.linalg.norm(centred, axis=1, keepdims=True)
        assert np.allclose(model.table[a * 4096 + b * 64 + c], centred @ gram, atol=1e-3)
    cosine, _ = langid.cosines(*langid.code_points(pa.array([t.split(". ")[2] for t in langs])), model)
    assert list(cosine.argmax(1)) == [0, 1, 2, 3, 4]


# ---------------------------------------------------------------- p2


CONFUSIONS = (("e", "c"), ("m", "rn"), ("a", "ä"), ("i", "!"), ("o", "0"), ("d", "cl"))
PAGE = "# T\n\nThe c0mmittee refcrs back to the contested deci-\nsion of the municipality. There is no\n\nAnnual Title 2031\n\n- 4 -\n\nsign that the licencc was put under pres¬\nsure.\n\nAnnual Titlc 2031\n\n- 5 -\n\nThe duty is long-\nterm by day- and night-time; angle α with value ν, Москва. The o\ue000der is ca(cid:7)e.\n"


@pytest.fixture(scope="module")
def scanned(spark):
    """Many documents, some with words garbled by known confusions, one page with everything, and awkward rows."""
    rng = random.Random(5)
    rows = [(k, t + " It is a long-term case of care.") for k in range(40) for t in (NL, EN, DE, FR, ES)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    for k in range(90):
        words = rng.choice((NL, EN, DE, FR, ES)).split(" ")
        rows.append((1000 + k, " ".join(ocr.garble(w, rng, 0.5 if rng.random() < 0.2 else 0.0, CONFUSIONS)[0] for w in words).replace(ocr.GLYPH, "")))
    rows += [(2000, PAGE), (2001, None), (2002, " "), (2003, ""), (2004, "- 14 kinderen\n- 15 ouders\n\nIn 2031\nwas het zo."), (2005, NL), (2005, NL), (None, PAGE)]
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, markdown string, row string")


def test_confusions_are_learned():
    words = {w.lower(): 400 for t in (NL, EN, DE, FR, ES) for w in re.findall(r"[^\W\d_]{4,}", t)}
    rng = random.Random(3)
    reads = {ocr.garble(w, rng, 0.4, CONFUSIONS)[0]: 1 for w in [*words] * 6}
    learned = ocr.learn_confusions(words, {r: n for r, n in reads.items() if r not in words})
    assert set(CONFUSIONS) <= set(learned) and len(learned) <= len(CONFUSIONS) + 3
    assert ocr.learn_confusions({}, {}) == () and ocr.learn_confusions(words, {"décision": 1, "zzzz": 1}) == ()


def test_all_words_are_learned_from(spark):
    """Confusions seen only with words beyond the 20,000 most frequent are learned, as by brute force, and corrected."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abdfglmnoprstuvy") for _ in range(8))
    common = sorted({word() for _ in range(21_000)})
    own, misread = ["jackets", "wakening", "tokener", "sikkens"], ["jacxets", "waxening", "toxener", "sixkens"]
    rows = [(k, [*common, *(own if k < 8 else misread)]) for k in range(9)]
    pages = spark.createDataFrame([(k, k, r, [], []) for k, r in rows], "row long, doc_id long, reads array<string>, compounds array<string>, breaks array<string>")
    got = {r.read: r.word for r in ocr.decisions(pages).corrections.collect()}
    assert got == dict(zip(misread, own))
    words, reads = ({**dict.fromkeys(common[:300], 9), **dict.fromkeys(own, 8)}, {r: 1 for r in [*misread, "sikxens", *(w[:3] + "éx" + w[4:] for w in common[:9])]})
    tables = [spark.createDataFrame([*x.items()], "read string, docs long") for x in (words, reads)]
    assert ocr.confusions_of(*tables) == ocr.learn_confusions(words, reads) != ()


def test_page_furniture_of_made_up_documents():
    """Held-out documents: nearly all candidate groups are told right, and no ordinary text has furniture."""
    weights, rng, right, total = ocr.place_weights(), random.Random(77), 0, 0
    for _ in range(400):
        lines, marked = ocr.sample_page(rng)
        gone = ocr.furniture(lines, weights).lines
        for g in ocr.groups_of([x.strip() for x in lines]):
            if len(g.found) > 1:
                total += 1
                right += (g.found[0][0] in gone) == (2 * sum(i in marked for i, _ in g.found) > len(g.found))
    assert right > 0.95 * total > 100
    for text in (NL, EN, DE, FR, ES, "- 14\n- 15", "", "# A\n\nx\n\n# B\n\nx"):
        assert ocr.furniture(text.split("\n"), weights) == ocr.Furniture(frozenset(), False, False), text


def test_scan_noise(scanned):
    got = ocr.repair(scanned).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == scanned.count()
    text = by_id[2000].repaired
    assert "The committee refers back to the contested decision of the municipality. There is no sign that the licence was put under pressure." in text
    assert "Title" not in text and "- 4 -" not in text and "day- and" in text and "long-term" in text
    assert "angle α with value ν, Москва" in text  # other scripts stay
    assert by_id[2000].misread >= 3 and by_id[2000].joined == 2
    assert by_id[2001].repaired is None and by_id[2002].repaired == "" and by_id[2003].repaired == ""
    assert all(r.repaired == scanned_text and not r.misread for r in got if r.doc_id is not None and r.doc_id < 200 for scanned_text in [r.repaired])
    assert sorted(map(str, ocr.repair(scanned, most=0).collect())) == sorted(map(str, got))  # decisions joined instead of sent


def test_defects(spark, scanned):
    got = {}
    for r in ocr.defects(scanned).collect():
        got.setdefault(r.doc_id, set()).add(r.defect)
    everything = {"hyphenation", "misread", "running_header", "page_number"}
    assert got[2000] == got[None] == everything
    assert not [k for k in got if k is not None and (k < 1000 or 2000 < k < 2005)]
    assert ocr.defects(empty(spark)).count() == 0 and ocr.repair(empty(spark)).count() == 0


def test_editor_on_garbled_words():
    """Held-out garbling of known words: the right word is among the readings, and nearly always the best of the known ones."""
    words = sorted({w.lower() for t in (NL, EN, DE, FR, ES) for w in re.findall(r"[^\W\d_]{5,}", t)})
    editor = ocr.train_editor(words, CONFUSIONS)
    rng = random.Random(99)
    made = [(w, ocr.garble(w, rng, 0.2, CONFUSIONS)[0]) for w in words for _ in range(3)]
    made = [(w, r) for w, r in made if w != r and r not in words]
    best = [max(((s, x) for s, x in found if x in words), default=(0, None))[1] for found in ocr.readings([r for _, r in made], editor)]
    assert sum(b == w for b, (w, _) in zip(best, made)) > 0.95 * len(made) > 50
    assert ocr.readings([], editor) == [] and ocr.readings(["x" * 500], editor)[0] == []


# ---------------------------------------------------------------- p3


@pytest.mark.parametrize("limit,overlap", [(50, 0), (50, 10), (7, 3), (1, 0), (20, 100)])
def test_pieces_join_to_the_text(limit, overlap):
    rng = random.Random(limit)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b. ", " ", "\n", "\n\n", "word ", "é", "x" * 30, "é"]) for _ in range(rng.randrange(1, 60)))
        pieces = split.pieces_of(text, limit, overlap)
        assert all(len(p) <= limit for _, _, p in pieces)
        assert "".join(p[before:] for _, before, p in pieces) == text
        assert all(before == min(min(overlap, limit // 2), begin) for begin, before, _ in pieces)


def test_boundaries_and_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "aaaa\n\nbbbb", "k", 1), (2, "aaaa\nbbbb", "k", 1), (3, "aaaa bbbb", "k", 1), (4, "aaaabbbb", "k", 1), (5, "aaaa", "k", 1), (6, None, "k", 1), (7, "x" * 9, None, 1), (8, "x" * 9, "none", 1), (4, "aaaabbbb", "k", 1)], "doc_id long, markdown string, kind string, text int")
    profiles = spark.createDataFrame([("k", 5, 2), (None, 1, 1)], "kind string, chunk_chars int, overlap_chars int")
    assert {tuple(r) for r in split.oversize(docs, profiles).collect()} == {(1, "paragraph"), (2, "line"), (3, "word"), (4, "none")}
    pieces = split.split_documents(docs, profiles)
    assert pieces.where("doc_id in (5, 7, 8)").count() == 3 and pieces.where("doc_id = 6").count() == 0
    assert split.oversize(empty(spark), profiles).count() == 0


# ---------------------------------------------------------------- p4 and p7


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    if not __import__("os").path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokens.ranks(), special_tokens={})


def test_counts_are_exact(encoding):
    rng, counts = random.Random(5), tokens.PieceCounts()
    alphabet = "aé€ 日本\t'stre  \n​́ﬁ9½xyz=\x1c\x85"
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert counts.of(text) == len(encoding.encode_ordinary(text)), repr(text)
    assert counts.of("=" * 5000) == len(encoding.encode_ordinary("=" * 5000))


def test_budget(spark, encoding):
    docs = spark.createDataFrame([(1, NL, "s", "nl", "f"), (2, "", "s", None, None), (3, None, None, "EN", ""), (4, EN, "s", "nl", "f"), (4, EN, "s", "nl", "f"), (None, DE, "t", "de", "f")], "doc_id long, text string, source string, lang string, field string")
    got = {r.doc_id: (r.source, r.lang, r.domain, r.tokens) for r in tokens.with_tokens(tokens.articles(docs)).collect()}
    n = lambda t: len(encoding.encode_ordinary(t))
    assert got == {1: ("s", "nl", "f", n(NL)), 2: ("s", "und", "unknown", 0), 3: ("unknown", "en", "unknown", 0), 4: ("s", "nl", "f", 2 * n(EN)), None: ("t", "de", "f", n(DE))}


def test_every_token_is_in_one_window(spark, encoding):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice((NL, EN, DE)) for _ in range(rng.randrange(1, 5))), "clash") for k in range(60)] + [(60, "word " * 700, "c"), (61, None, "c"), (62, "", "c"), (5, NL, "c"), (None, EN, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    got = pack.pack(docs, window=256, shard=20).collect()
    by_window, parts = {}, {}
    for r in got:
        by_window[r.shard, r.window_no] = by_window.get((r.shard, r.window_no), 0) + r.tokens
        parts.setdefault(r.doc_id, []).append((r.begin, r.tokens, r.part_no))
    assert max(by_window.values()) <= 256
    counts = tokens.PieceCounts()
    assert sum(by_window.values()) == sum(counts.of(t) for _, t, _ in rows if t)
    big = sorted(parts[60])
    assert [b for b, _, _ in big] == [256 * k for k in range(len(big))] and sum(n for _, n, _ in big) == counts.of("word " * 700)
    assert {r.doc_id for r in pack.oversized(docs, 256).collect()} == {k for k, t, _ in rows if t and counts.of(t) > 256}
    assert pack.pack(empty(spark)).count() == 0


def test_related_articles_share_windows():
    terms = [np.array([k % 3, 3 + k % 3], np.int32) for k in range(12)]
    index = pack.Index(terms, [np.array([2, 1], np.int16)] * 12, np.ones(8, np.float32), 3.0)
    rows = pack.pack_shard(list(range(12)), np.array([25] * 12), index, 100)
    kinds = {}
    for w, d, *_ in rows:
        kinds.setdefault(w, []).append(d % 3)
    assert sum(max(map(k.count, set(k))) for k in kinds.values()) >= 10


def test_scores_are_bm25_of_all_terms():
    rng = np.random.default_rng(7)
    terms = [np.sort(rng.choice(300, 40 + k, replace=False)).astype(np.int32) for k in range(50)] + [np.zeros(0, np.int32)]
    terms[0], terms[1] = np.arange(60, dtype=np.int32), np.array([3, 59, 299], np.int32)
    freqs = [rng.integers(1, 9, len(t)).astype(np.int16) for t in terms]
    idf = rng.random(300).astype(np.float32) + 0.1
    index = pack.Index(terms, freqs, idf, 150.0)
    for seed in range(len(terms)):
        want = np.zeros(len(terms))
        for d, (own, tf) in enumerate(zip(terms, freqs)):
            length = pack.K1 * (1 - pack.B + pack.B * tf.sum() / 150.0)
            want[d] = sum(idf[t] * n * (pack.K1 + 1) / (n + length) for t, n in zip(own, tf.astype(float)) if t in terms[seed])
        assert np.allclose(index.scores(seed, len(terms)), want, rtol=1e-4), seed


def test_pieces_of_ordinary_text_need_no_far_ranges():
    """Texts with and without characters beyond U+FFFF are cut as by the whole pattern; the latter by classes without ranges beyond."""
    rng = random.Random(12)
    kinds = ("aZé ß\n\t'sll 0९½", "中文ไทยÅ\ud7a3\uffff\u3000", "𝒜𐒠𝟘🙂\U0010ffff 'a1")
    for k in range(600):
        text = "".join(rng.choice(rng.choice(kinds[: 1 + k % 3])) for _ in range(rng.randrange(40)))
        assert tokens.pieces(text) == tokens.pieces_pattern().findall(text) and "".join(tokens.pieces(text)) == text
    assert max(map(ord, tokens.pieces_pattern(0xFFFF).pattern)) <= 0xFFFF and "\\U0001" not in tokens.pieces_pattern(0xFFFF).pattern
    assert "\\U0001" in tokens.pieces_pattern().pattern


# ---------------------------------------------------------------- p5


def test_every_pair_of_encodings_comes_back():
    text = "het café à la crème, déjà vu: señalización für Übergänge – “façade” naïve"
    for name in ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r"):
        garbled = "".join(mojibake.decoder(name)[b] for b in text.encode())
        assert mojibake.undo_sequences(garbled)[0] == text, name
        if name == "cp1252":
            twice = "".join(mojibake.decoder(name)[b] for b in garbled.encode())
            assert mojibake.undo_sequences(twice)[0] == text
    entities = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in "".join(mojibake.decoder("cp1252")[b] for b in "à café".encode()))
    assert mojibake.undo_sequences(entities)[0] == "à café"
    assert mojibake.undo_sequences("SÃO TELMÃO, L’ÂGE et PÂTÉ")[1] == 0


def test_utf7_runs_come_back(spark):
    for text in ("het café aan de kade", "financiële", "“Über” – naïve ½ ~ a\\b", "1 + 1 = één", "I’ll’", "’s avonds é” x", "ok 😀 é"):
        assert mojibake.undo_sequences(text.encode("utf-7").decode("ascii"))[0] == text, text
    assert mojibake.undo_sequences("x+y en caf+AOk-") == ("x+y en café", 1)
    assert mojibake.undo_sequences("caf+AOk aan") == ("café aan", 1)
    assert mojibake.undo_sequences("caf+AMMAqQ-") == ("café", 2)
    for text in ("a+b- c", "C+AME x", "1+A1-B2", "+31-20-1234567", "data:x;base64,iVBO+AOkRw0KGgo+AAAA", "+ABCDEF-", "10 +- 2"):
        assert mojibake.undo_sequences(text) == (text, 0), text
    rows = [(1, "het caf+AOk- aan de kade"), (2, "het cafe aan de kade"), (3, "int+AOk-rieur +IB4-De Oever+IB0-"), (4, "“het” caf+AOk-"), (5, "+AOkgGQ-s")]
    got = {r.doc_id: (r.repaired, r.spans) for r in mojibake.repair(spark.createDataFrame(rows, "doc_id long, markdown string")).collect()}
    assert got == {1: ("het café aan de kade", 1), 2: (rows[1][1], 0), 3: ("intérieur „De Oever”", 3), 4: ("“het” café", 1), 5: ("é’s", 1)}


def test_single_bytes_need_context(spark):
    clean = [(k, FR + DE + ES) for k in range(30)]
    bad = FR.replace("’", "'").encode("cp1252").decode("cp1251")
    half = FR + DE.encode("cp1252").decode("cp1251", "replace")
    rows = [*clean, (40, bad), (41, "Die Bеhörde"), (42, None), (43, ""), (44, "a�b"), (45, half), (46, EN)]
    df = spark.createDataFrame(rows, "doc_id long, markdown string")
    got = {r.doc_id: r for r in mojibake.repair(df).collect()}
    assert got[40].repaired == FR.replace("’", "'") and got[45].repaired == FR + DE
    assert got[41].spans == 0 and got[42].repaired is None and got[44].lost == 1
    assert {r.doc_id for r in mojibake.garbled(df).collect()} == {40, 44, 45}
    assert mojibake.garbled(empty(spark)).count() == 0


def test_passages_of_different_pairs(spark):
    """One document, two passages garbled in different ways, right text between them that stays."""
    one, two = FR.replace("’", "'"), DE
    clean = [(k, FR + "\n\n" + one + DE + ES) for k in range(40)]
    text = one.encode("cp1252").decode("cp1251") + "\n\n" + ES + "\n\n" + two.encode("cp1252").decode("cp437")
    df = spark.createDataFrame([*clean, (90, text), (91, "Δοκιμή".encode().decode("cp1252", "replace") + " Москва".encode().decode("latin_1"))], "doc_id long, markdown string")
    got = {r.doc_id: r for r in mojibake.repair(df).collect()}
    assert got[90].repaired == one + "\n\n" + ES + "\n\n" + two
    assert got[91].repaired.endswith("Москва")
    assert all(got[k].spans == 0 for k, _ in clean)


def test_contexts_of_any_corpus_size(spark):
    """Counts ten thousand times as large give the same patterns: nothing depends on the number of documents."""
    df = spark.createDataFrame([(k, FR + DE + ES) for k in range(30)] + [(40, FR.replace("’", "'").encode("cp1252").decode("cp1251"))], "doc_id long, markdown string")
    known = mojibake.known_contexts(df)
    small, large = (mojibake.context_patterns({k: n * by for k, n in known.items()}) for by in (2, 20_000))
    assert set(small.automaton.keys()) == set(large.automaton.keys()) and small.ordinary == large.ordinary


# ---------------------------------------------------------------- p6


def test_composition_is_that_of_unicode():
    rng = random.Random(4)
    alphabet = "aeocnuAEO" + "̧̣́̈̀̂" + "éü ẹ̈́日가각"
    for _ in range(400):
        text = "x" + "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
        assert canon.canonical_text(text) == unicodedata.normalize("NFC", text), ascii(text)


def test_one_form():
    same = ["Het besluit fiets éénmalig zijn", "Ｈｅｔ besluit ﬁets éénmalig zĳn", "Hеt b​eѕluit fіetѕ éе́nmalig zijn", "Het beslu­it 𝖿iets éénmalig zijn"]
    assert len({canon.canonical_text(t) for t in same}) == 1
    for other in ("Het besluit fiets eénmalig zijn", "Het besluit fiets éénmalig zijn.", "Het  besluit fiets éénmalig zijn", "Het besluit\nfiets éénmalig zijn", "het besluit fiets éénmalig zijn", "Het besluit fiets éénmalig z1jn", "Het besluit fiets éénmalig zijn²"):
        assert canon.canonical_text(other) != canon.canonical_text(same[0])


def test_pairs(spark):
    a, b = "De commissie verwijst naar het besluit", "De commissie verwijst naar het besluit"
    rows = [(1, a), (2, b), (3, a), (4, "kort"), (5, "kоrt"), (6, None), (7, ""), (8, a.replace("besluit", "besIuit")), (2, b)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, markdown string, look string")
    assert sorted(tuple(r) for r in canon.same_looking(df).collect()) == [(1, 2), (2, 3)]
    assert canon.same_looking(empty(spark)).count() == 0
    assert [r.look for r in canon.canonicalize(df, into="look").where("doc_id = 6").collect()] == [None]


def test_a_hot_text_keeps_all_pairs(spark):
    a = "De commissie verwijst naar het besluit"
    df = spark.range(1500).selectExpr("id as doc_id", f"'{a}' as markdown").unionByName(spark.createDataFrame([(5000, a.replace(" ", " "))], "doc_id long, markdown string"))
    assert canon.same_looking(df).count() == 1500


def test_classes(spark):
    a, b = "De commissie verwijst naar het besluit", "De commissie\u00a0verwijst naar het besluit"
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (3, a), (4, "De commissie verwijst naar iets anders"), (None, b), (6, None)], "doc_id long, markdown string")
    assert sorted(tuple(r) for r in canon.classes(df).collect()) == [(1, 1, 3, 1), (2, 1, 3, 2), (3, 1, 3, 1)]
    assert canon.classes(empty(spark)).count() == 0


def test_copies_of_a_hot_text_do_not_meet(spark):
    """A million copies and one variant: a million pairs, and nothing near their square."""
    df = spark.range(1_000_000).selectExpr("id as doc_id", "'De commissie verwijst naar het besluit' as markdown").unionByName(spark.createDataFrame([(5_000_000, "De commissie verwijst naar het beѕluit")], "doc_id long, markdown string"))
    assert canon.same_looking(df).count() == 1_000_000


def test_korean_letters_become_syllables():
    for text in ("한국어 각 가", "값 x 뷁"):
        assert canon.canonical_text(unicodedata.normalize("NFD", text)) == text
    split_ = pa.array(["\u1100", "\u1161\u11a8", "\u1112\u1161", "\u11ab"])
    assert canon.canonical_strings(split_).to_pylist() == ["\u1100", "\u1161\u11a8", "하", "\u11ab"]


def test_readable_form_leaves_other_scripts_alone():
    for text in ("angle α with value ν", "Москва и сор", "ρυθμός", "Α. Β."):
        assert canon.canonical_text(text, readable=True) == text
    assert canon.canonical_text("het beѕluіt van Ｍоскоu é", readable=True) == "het besluit van Mocкou é"
    assert canon.canonical_text(None, readable=True) is None


# ---------------------------------------------------------------- p8


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40)))) for k in range(8)]
    docs = []
    for k in range(80):
        own = [rng.choice([*words, "other"]) for _ in range(60)]
        if k % 2:
            source = rng.choice(items)[1].split()
            at = rng.randrange(len(source))
            own[20:20] = source[at : at + rng.randrange(5, 30)]
        docs.append((k, rng.choice([" ", "\n% ", " \\emph{", "~"]).join(own).upper()))
    docs += [(90, None), (91, ""), (None, docs[0][1]), (1, docs[1][1])]
    least, want = 6, {}
    for d, t in docs:
        for i, text in items:
            w, own = leak.words_of(text), leak.words_of(t or "")
            best = max((n for a in range(len(w)) for b in range(len(own)) for n in [next((j for j in range(len(w) - a + 1) if a + j >= len(w) or b + j >= len(own) or w[a + j] != own[b + j]), 0)]), default=0)
            if best >= least and d is not None:
                want[d, i] = best
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    it = spark.createDataFrame([*items, (50, None), (51, "short")], "item_id long, text string")
    for block in (30, 10_000):
        assert {(r.doc_id, r.item_id): r.words for r in leak.matches(df, it, least, block_words=block).collect()} == want
    assert leak.matches(empty(spark), it).count() == 0 and leak.matches(df, it.limit(0)).count() == 0
    assert leak.without_leaks(df.where("doc_id is not null"), it, least).count() == len([d for d, _ in docs if d is not None and d not in {k for k, _ in want}])


def test_long_items_in_many_copies(spark):
    """An item of 1,500 words in 120 articles, each with another part of it: the longest match of each, and its place."""
    words = [f"w{k}" for k in range(1500)]
    spans = [(k * 7 % 900, 12 + k * 5) for k in range(120)]
    docs = [(k, "before " + " ".join(words[a : a + n]) + " behind") for k, (a, n) in enumerate(spans)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.words, r.item_begin) for r in leak.matches(df, it).collect()}
    assert got == {k: (min(n, 1500 - a), a) for k, (a, n) in enumerate(spans)}


def test_versions_share_a_shard():
    """Centroids of made-up topics: articles of one topic are next to each other in the order."""
    rng = np.random.default_rng(3)
    topics = [rng.choice(pack.BUCKETS, 60, replace=False) for _ in range(6)]
    terms = [np.sort(rng.choice(topics[k % 6], 40, replace=False)).astype(np.int64) for k in range(300)]
    flat, bounds = np.concatenate(terms), np.arange(301) * 40
    freqs, idf = np.ones(len(flat), np.int64), np.ones(pack.BUCKETS, np.float32)
    centroids = pack.fit_centroids(flat, freqs, bounds, idf, 24)
    place = pack._places(flat, freqs, bounds, np.zeros(300, np.int64), centroids, idf)
    order = np.argsort(place, kind="stable") % 6
    assert (np.diff(order) == 0).mean() > 0.9


# ---------------------------------------------------------------- p9

LEX = pii.Lexicon(frozenset({"dunmarrow", "zwaluwkamp", "o'tarrigan", "veldhoorn"}), frozenset({"odette", "imelda", "femke"}))


@pytest.mark.parametrize(
    "text,want",
    [
        ("mail a.b+c@mail.example.org.", [("email", "a.b+c@mail.example.org")]),
        ("x\\_y\\@kern.example, or j.k [at] kern [dot] example", [("email", "x\\_y\\@kern.example"), ("email", "j.k [at] kern [dot] example")]),
        ("precision@19 and tag v3.6@4432f86", []),
        ("reached at +44 (0)20 7946 0329 during", [("phone", "+44 (0)20 7946 0329")]),
        ("call (776) 555-0189 or 030/23125-971.", [("phone", "(776) 555-0189"), ("phone", "030/23125-971")]),
        ("SSN 666-37-5582 is visible", [("idnum", "666-37-5582")]),
        ("Supported by grant no.\\ 685-54-4374. See record 280335383280; ISBN 000-9-2331-58-0.", []),
        ("Passeport n° XX1853894, non masqué", [("idnum", "XX1853894")]),
        ("posted to Flat 33, 173 Ossen Lane, Pellworthy PQ33 9ZZ in", [("address", "Flat 33, 173 Ossen Lane, Pellworthy PQ33 9ZZ")]),
        ("an Am Krähenbühl 207b, 99177 Finkweiler.", [("address", "Am Krähenbühl 207b, 99177 Finkweiler")]),
        ("Tirés à part : 46 bis, avenue du Vieux-Lavoir, 99225 Clairombre.", [("address", "46 bis, avenue du Vieux-Lavoir, 99225 Clairombre")]),
        ("We thank Odette Imelda Dunmarrow and Femke van\n% der Zwaluwkamp, and O'Tarrigan, Imelda too", [("name", "Odette Imelda Dunmarrow"), ("name", "Femke van der Zwaluwkamp"), ("name", "O'Tarrigan, Imelda")]),
        ("The Veldhoorn constant, A. Dunmarrow, Odette alone, the Odette--Dunmarrow scheme", []),
        ("", []),
    ],
)
def test_mentions(text, want):
    assert [(m.kind, pii.value_of(text, m)) for m in pii.mentions(text, LEX)] == want


def test_redaction_keeps_the_rest():
    text = "Ask Odette Dunmarrow (a@b.example), SSN 666-37-5582."
    assert pii.redact(text, pii.mentions(text, LEX)) == "Ask [NAME] ([EMAIL]), SSN [IDNUM]."


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487") and pii.mod97("00000000097") and pii.eleven("111222333") and not pii.eleven("111222334")
    assert pii.check_letter("12345678", "Z") and pii.iban("GB82 WEST 1234 5698 7654 32") and pii.mod11_10("86095742719")


def test_names_are_learned(spark):
    rows = [(k, "\\author{A.~Dunmarrow \\and B.~Veldhoorn}\nWe thank Odette Dunmarrow and Odette Veldhoorn. The Veldhoorn constant.") for k in range(4)]
    df = spark.createDataFrame([*rows, (9, None), (10, ""), (3, rows[3][1])], "doc_id long, text string")
    assert pii.lexicon_of(pii.learn_names(df).collect()) == pii.Lexicon(frozenset({"dunmarrow", "veldhoorn"}), frozenset({"odette"}))
    got = {tuple(r) for r in pii.found(df).collect()}
    assert got == {(k, "name", n) for k in range(4) for n in ("Odette Dunmarrow", "Odette Veldhoorn")}
    assert {r.doc_id: r.redacted for r in pii.detect(df).where("doc_id > 8").collect()} == {9: None, 10: ""}
    assert pii.found(empty(spark)).count() == 0


def test_names_that_are_also_surnames(spark):
    rows = [(k, f"\\author{{A.~Becker \\and B.~Klein}}\nWe met Thomas {('Becker', 'Klein')[k % 2]} there. Cites C. Thomas Klein.") for k in range(6)]
    rows += [(10 + k, "J. Thomas, and K. Garcia, and L. Becker, wrote. Garcia Klein and Garcia Becker wrote.") for k in range(2)]
    rows += [(20 + k, "M. Garcia, and N. Klein, and B. van der Becker, and others") for k in range(5)]
    rows += [(30, "We thank Garcia Klein. Becker, Thomas too. Lists: Becker, Thomas, Klein. J. Thomas Klein is cited; Thomas alone."), (31, "Garcia Klein alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = pii.lexicon_of(pii.learn_names(df).collect())
    assert lexicon == pii.Lexicon(frozenset({"becker", "klein", "thomas", "garcia"}), frozenset({"thomas"}), frozenset({"garcia"}))
    want = {(k, "name", f"Thomas {('Becker', 'Klein')[k % 2]}") for k in range(6)} | {(30, "name", "Garcia Klein"), (30, "name", "Becker, Thomas")}
    assert {tuple(r) for r in pii.found(df).collect()} == want
    assert {tuple(r) for r in pii.found(df, most=0).collect()} == want  # a lexicon beyond the size that is sent to all tasks
    assert sorted(map(str, pii.detect(df, most=0).collect())) == sorted(map(str, pii.detect(df).collect()))


def test_cards_and_accounts_are_replaced_but_not_listed(spark):
    text = "Paid by card 4539 5787 6362 1486 (not 4539 5787 6362 1487) from GB82 WEST 1234 5698 7654 32, not GB83 WEST 1234 5698 7654 32."
    assert pii.redact(text, pii.mentions(text, LEX)) == "Paid by card [CARD] (not 4539 5787 6362 1487) from [IBAN], not GB83 WEST 1234 5698 7654 32."
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert pii.found(df).count() == 0 and pii.detect(df).count() == 3


def test_addresses_in_markup_and_at_sentence_ends():
    for text, want in (("\\address{12 Elm Street, Pellworthy}", "12 Elm Street, Pellworthy"), ("Er wohnt in der Lindenstrasse 12.", "Lindenstrasse 12")):
        assert [pii.value_of(text, m) for m in pii.mentions(text, LEX) if m.kind == "address"] == [want]


def test_searches_begin_with_a_class():
    """Patterns that are searched for skip other characters in one loop, and find what their plain forms find."""
    house = re.compile(r"(?<![\w.])\d{1,5}(?!\d|\.\d)")
    iban = re.compile(r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])")
    run = re.compile(r"[+(]?\d+(?:" + pii.SEP + r"\d+)*")
    chain = re.compile(rf"(?<![\w\\@.\-]){pii.CAP}(?:,?(?:{pii.GAP})(?:{pii.CAP}|[{pii.UP}]\.(?:-?[{pii.UP}]\.)*|{pii.PARTICLE}(?=[ ~\n])))+")
    parts = ["A", "AB", "X", "d'", "L’", "O'", "Van", "van", " ", "  ", "~", "\n", "\n% ", "-", ".", "/", "(0)", "(", "+", "1", "12", "12345", "1234567", "Élan", "ß", "_", "@", ",", "J.", "NL91", "ABNA0417", "GB82 WEST 1234 5698 7654 32", "٣", "AB123456C", "X1234567L", "12AB12345"]
    rng, found = random.Random(21), 0
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 20)))
        for plain, quick in ((house, pii.HOUSE), (iban, pii.IBAN), (run, pii.RUN), (chain, pii.CHAIN)):
            assert [m.span() for m in plain.finditer(text)] == [m.span() for m in quick.finditer(text)], text
        ids = [m.span() for m in pii.LETTER_IDS.finditer(text)]
        assert ids == [m.span() for m in pii.letter_ids(text)], text
        found += len(ids)
    assert found > 100
    assert all(p.pattern.startswith(("[", r"\d")) and not p.pattern.startswith("[+(]?") for p in (pii.HOUSE, pii.IBAN, pii.RUN, pii.CHAIN, pii.AUTHOR, pii.LETTER_ID_BEGIN))
