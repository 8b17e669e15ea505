"""Column functions on small tables of inputs and expected values."""

import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions import route as R
from leafmill.functions import text as T


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_route(spark):
    cases = {
        "ECLI:CE:ECHR:2031:0525JUD005817013": "hudoc", "https://hudoc.echr.coe.int/x": "hudoc", "BWBR0040940": "wetten", " 001-210077 ": "hudoc", "ECLI:NL:HVR:2031:AB12": "rechtspraak",
        "https://uitspraken.rechtspraak.nl/001-210077": "rechtspraak", "ecli:de:bgz:2031:1": "national", "ECLI:BE:CASX:2031:ARR.1": "national", "32016R0679": None, "ECLI:EU:C:2031:645": None, "": None,
    }
    assert apply(spark, R.route, list(cases)) == list(cases.values())


def test_celex(spark):
    cases = {"32016r0679": "32016R0679", "https://x/?uri=CELEX%3A32016R0679": "32016R0679", "https://x/?celex=62019CJ0311": "62019CJ0311", "see CELEX:32011L0083": "32011L0083", "https://x/doc/32011L0083/z": "32011L0083", "none": None, "": None}
    assert apply(spark, R.celex, list(cases)) == list(cases.values())
    eli = {"/eli/reg/2016/679/oj": "32016R0679", "/eli/dir/2011/83": "32011L0083", "/eli/treaty/2011/8": None, "/eli/dec/2020/12345": "32020D12345", None: None}
    assert apply(spark, R.eli_to_celex, list(eli)) == list(eli.values())


def test_kind_and_names(spark):
    assert apply(spark, R.kind_for_source, ["Rechtspraak.nl • x", "HUDOC (x)", "a • CELEX:62019CJ1", "b • ecli:fr:x", "file.pdf", None]) == ["caselaw"] * 4 + ["document"] * 2
    assert apply(spark, T.sanitize_filename, ["a/b c", "", None, "x.md", "../é"]) == ["a_b_c.md", "document.md", "document.md", "x.md", ".._" + "_.md"]
    assert apply(spark, T.basename, ["https://x/a/b.c.html?d#e", "https://x/", ""]) == ["b.c", "document", "document"]
    assert apply(spark, T.anchor, ["BWBR1#Hoofdstuk%201", "BWBR1", "BWBR1# ", "x#a+b"]) == ["Hoofdstuk 1", None, None, "a+b"]


def test_tidy_and_space(spark):
    cases = {
        "": "\n", " a \n\n\n\n\nb\t\n": "a\n\n\nb\n", "\xa0x\x0b\n \n \n \n \ny\u2028": "x\n\n\ny\n", "a": "a\n", "\n\n\n": "\n", "ééé  ": "ééé\n",
        "a\n\n\nb\n\nc": "a\n\n\nb\n\nc\n", "  a\n  b": "a\n  b\n",
    }
    assert apply(spark, T.tidy, list(cases)) == list(cases.values())
    assert apply(spark, T.tidy, list(cases.values())) == list(cases.values())  # tidy text stays
    assert apply(spark, T.collapse_ws, list(cases)) == [" ".join(v.split()) for v in cases]


def test_headings_and_markers(spark):
    text = "HOOFDSTUK I\n artikel 5 bis \nArtikel vijf\n# Title\nSection Introduction\nchapter 2 text"
    assert apply(spark, T.promote_headings, [text]) == ["## HOOFDSTUK I\n### artikel 5 bis\nArtikel vijf\n# Title\n## Section Introduction\nchapter 2 text"]
    marks = ["1", "1.", "(a)", "xii)", "–", "", "(1234).", "word", "•"]
    assert apply(spark, T.is_marker, marks) == [True, True, True, True, True, True, False, False, True]
    assert apply(spark, T.marker_prefix, ["1", "1.", "–", "", "a)"]) == ["1. ", "1. ", "- ", "", "a) "]
    assert apply(spark, T.roman_heading, ["I. RECHTSPLEGING", "i. rechtspleging", "I. AB"]) == ["## I. RECHTSPLEGING", "i. rechtspleging", "I. AB"]


def test_fences_and_glyphs(spark):
    assert apply(spark, T.strip_fence, ["```markdown\na\n```", " ```\na\n\n```\n", "x ```\na\n```", "```a```"]) == ["a", "a", "x ```\na\n```", "```a```"]
    assert apply(spark, T.strip_glyphs, ["a(cid:12)b", "(cid:x)"]) == ["ab", "(cid:x)"]


def test_files(spark):
    rows = spark.createDataFrame([("https://x/a%20b/c.pdf?x", "text/html"), ("https://x/", "application/pdf; q=1"), ("https://x/a+b", None)], "u string, c string")
    assert [r.o for r in rows.select(T.filename_from_url(F.col("u"), F.col("c")).alias("o")).collect()] == ["c.pdf", "document.pdf", "a+b"]
    assert apply(spark, R.looks_like_structured_xml, [b"<?xml?><act>", b"<html>", b" " * 300 + b"<ACT", b""], "binary") == [True, False, False, False]
    assert apply(spark, T.decode_bytes, ["é".encode(), b"\xe9", b"\xef\xbb\xbfa", "é".encode("utf-16")], "binary") == ["é", "é", "a", "é"]


@pytest.mark.parametrize("pattern", ["WS", "WS_IN_LINE"])
def test_white_space_is_what_python_takes_for_it(pattern):
    from leafmill.functions import patterns as P

    own = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), getattr(P, pattern))
    spaces = {chr(c) for c in range(0x3001) if chr(c).isspace()} - ({"\n"} if pattern == "WS_IN_LINE" else set())
    assert {s for s in spaces if not re.fullmatch(own, s)} == set()


def test_all_articles_are_sniffed(spark, tmp_path):
    from leafmill.plans import queries as core

    far = "é" * 3990  # 7,980 bytes: the mark behind stands across the end of the head or before it
    texts = ["café", "x", "é", "<p>é <consid", far, None, far + "<act", "<" + far + "<article>", "", "y", "<" + far + "1234567890<act>", "<" + far + "12345678901234567<act>", "ascii", "z", "é" * 100 + "<act>", "é" * 99 + "<act>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(k):
        if k % 4 == 1:
            made = "x" * 300 + "<ARTICLE>"
        elif texts[k] is None:
            return None
        else:
            made = {0: '<?xml version="1.0"?><act>', 2: "<html>", 3: ""}[k % 4] + texts[k]
        head = made.encode()[:8000]
        return b"<" in head[:200] and any(m.encode() in head.upper() for m in P.STRUCTURED_XML)

    got = {r.doc_id: r.structured for r in core.structured_xml_sniff(spark, str(tmp_path)).collect()}
    assert got == {k: brute(k) for k in range(len(texts))}
