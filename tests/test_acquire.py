"""Acquisition, file readers, sinks and the model client on small inputs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.operators import clean, estimate
from leafmill.sources import acquire, convert, office, sinks

CANDIDATES = "ecli string, ord int, itemid string, lang3 string"
RESPONSES = "url string, status int, content binary"
LONG = "long enough to be useful anywhere, " * 4


def got(spark, queries, landed, candidates=()):
    requests = spark.createDataFrame([(i, q, "nl") for i, q in enumerate(queries)], "req_id long, query string, lang string")
    responses = spark.createDataFrame([(u, s, c.encode() if isinstance(c, str) else c) for u, s, c in landed], RESPONSES)
    return {r.req_id: r for r in acquire.documents(requests, spark.createDataFrame(list(candidates), CANDIDATES), responses).collect()}


def test_archive_before_portal(spark):
    portal = "https://eur-lex.europa.eu/legal-content/NL/TXT/HTML/?uri=CELEX:"
    landed = [
        (acquire.ARCHIVE_CELEX + "32031R0001", 200, f"<p>{LONG}"), (acquire.ARCHIVE_CELEX + "32031R0002", 200, "<p>short"), (portal + "32031R0002", 200, "<p>from the portal"), (acquire.ARCHIVE_CELEX + "32031R0003", 300, "<p>no links"), (portal + "32031R0003", 200, f"<p>{LONG}"),
        (acquire.ARCHIVE_CELEX + "32031R0004", 300, '<a href="http://publications.europa.eu/resource/cellar/a/DOC_2"><a href="http://publications.europa.eu/resource/cellar/a/DOC_1">'), ("http://publications.europa.eu/resource/cellar/a/DOC_1", 200, f"<p>one {LONG}"), ("http://publications.europa.eu/resource/cellar/a/DOC_2", 200, "<p>two"),
        (acquire.ARCHIVE_ECLI + "ECLI%3AEU%3AC%3A2031%3A7", 200, "<p>short"), (portal + "32031R0005", 202, ""),
    ]
    r = got(spark, ["32031R0001", "32031R0002", "/eli/reg/2031/3", "32031R0004", "ECLI:EU:C:2031:7", "32031R0005", "nothing here", " "], landed)
    assert r[0].source == "EUR-Lex (Cellar) • CELEX:32031R0001 • NL" and r[0].rank == 1
    assert (r[1].source, r[1].markdown) == ("EUR-Lex portal • CELEX:32031R0002 • NL", "from the portal\n")
    assert r[2].markdown is None and r[2].error == "not_in_language"  # the ladder ends there
    assert r[3].markdown.startswith("two\n\n\n---\n\none") or r[3].markdown.startswith("two\n\n---\n\none") or "---" in r[3].markdown
    assert r[4].error == "too_short" and r[5].error == "status_202" and r[6].error == "no_identifier" and r[7].error == "missing_query"


def test_human_rights_take_the_first_useful_version(spark):
    ecli = "ECLI:CE:ECHR:2031:0101JUD000000131"
    versions = [(ecli, 0, "001-111", "ENG"), (ecli, 1, "001-222", "DUT"), (ecli.lower(), 2, "001-333", "FRE")]
    landed = [(acquire.HUMAN_RIGHTS + "001-222", 204, ""), (acquire.HUMAN_RIGHTS + "001-111", 200, "<p>x"), (acquire.HUMAN_RIGHTS + "001-333", 200, f"<p>{LONG}")]
    r = got(spark, [ecli, "001-333", "https://hudoc.echr.coe.int/x"], landed, versions)
    assert (r[0].rank, r[0].source, r[0].kind) == (3, f"HUDOC (EHRM) • 001-333 • {ecli}", "caselaw")
    assert r[1].source == "HUDOC (EHRM) • 001-333" and r[2].error == "no_identifier"


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_national_sources(spark):
    de, de2, be, cc, cass = "ECLI:DE:OGH:2031:1", "ECLI:DE:OGH:2031:2", "ECLI:BE:KADX:2031:ARR.1", "ECLI:FR:CC:2031:2031.7.DC", "ECLI:FR:CCASS:2031:C100001"
    enc = lambda e: e.replace(":", "%3A")
    landed = [
        (acquire.GERMAN_API + "?ecli=" + enc(de), 200, json.dumps({"results": [{"id": 55}]})), (acquire.GERMAN_API + "55/", 200, json.dumps({"court": {"name": "OGH"}, "content": f"<p>{LONG}</p>"})),
        (acquire.GERMAN_API + "?ecli=" + enc(de2), 200, json.dumps({"results": []})), (acquire.GERMAN_SEARCH + enc(de2), 200, "<a href='?doc.id=jb-K1&x'>"),
        (acquire.GERMAN_ZIP + "jb-K1.zip", 200, zipped({"a.txt": "x", "b.xml": f"<dokument><gertyp>OGH</gertyp><gruende><dl><dt>1</dt><dd><p>{LONG}</p></dd></dl></gruende></dokument>"})),
        ("https://juportal.be/content/" + be, 200, f"<table><tr><td><p>ECLI nr:</p></td><td><p>ECLI:BE:KADX:2031:ARR.2</p></td></tr></table><fieldset><legend>Tekst van de beslissing</legend><div><p>{LONG}</p></div></fieldset>"),
        ("https://www.conseil-constitutionnel.fr/decision/2031/20317DC.htm", 200, f"<div class='field--name-field-contenu-original'><p>{LONG}</p></div>"),
        (acquire.CASSATION_API + "search?query=" + enc(cass), 200, json.dumps({"results": [{"id": "a", "ecli": "other"}, {"id": "b", "ecli": cass.lower()}]})), (acquire.CASSATION_API + "decision?id=b", 200, json.dumps({"number": "7", "text": LONG})),
    ]
    r = got(spark, [de, de2, be, cc, cass, "ECLI:FR:CE:2031:1", "ECLI:DE:OGH:2031:9"], landed)
    assert [r[k].source for k in range(5)] == [f"OpenLegalData • {de}", f"rechtsprechung-im-internet.de • {de2}", f"Juportal • ECLI:BE:KADX:2031:ARR.2 (vervangt {be})", f"Conseil constitutionnel • {cc}", f"Judilibre • {cass}"]
    assert all(r[k].kind == "caselaw" for k in range(5)) and r[4].markdown.startswith("# Cour de cassation 7\n")
    assert r[5].error == "court_not_served" and r[6].error == "not_found"


def test_search_outcomes(spark):
    eclis = [f"ECLI:DE:OGH:2031:{k}" for k in range(3)]
    known = acquire.facts(spark.createDataFrame([(k, e, "NL") for k, e in enumerate(eclis)], "req_id long, query string, lang string"))
    pages = ("doc.id=K0", acquire.NO_HITS, "<form>")
    landed = spark.createDataFrame([(acquire.GERMAN_SEARCH + e.replace(":", "%3A"), 200, p.encode()) for e, p in zip(eclis, pages)], RESPONSES)
    rows = acquire.found_addresses(known, landed).where("step = 1").orderBy("req_id").collect()
    assert [r.outcome for r in rows] == ["found", "none", "retry"]


def test_statutes_and_rulings(spark):
    page = f"<div id='regeling'><p>{LONG}</p><div id='A1'><p>part {LONG}</p></div></div>"
    landed = [("https://wetten.overheid.nl/BWBR1/2031-01-01", 200, page), ("https://data.rechtspraak.nl/uitspraken/content?id=ECLI:NL:HVR:2031:1", 200, f"<x><uitspraak><para>{LONG}</para></uitspraak></x>")]
    r = got(spark, ["BWBR1/2031-01-01#A1", "BWBR1/2031-01-01#A9", "ecli:nl:hvr:2031:1"], landed)
    assert r[0].source == "wetten.overheid.nl • BWBR1/2031-01-01 #A1" and r[0].markdown.startswith("part") and r[0].kind == "document"
    assert r[1].error == "not_found" and r[2].source == "Rechtspraak.nl • ECLI:NL:HVR:2031:1" and r[2].kind == "caselaw"


def test_polling_and_retries(spark):
    polls = [("a", k, 202) for k in range(1, 9)] + [("b", 1, 202), ("b", 2, 200), ("c", 1, 500)]
    assert {tuple(r) for r in acquire.poll_outcome(spark.createDataFrame(polls, "url string, try_no int, status int")).collect()} == {("a", 202, 6), ("b", 200, 2), ("c", 500, 1)}

    def connector():
        calls = {}

        def get(url):
            calls[url] = calls.get(url, 0) + 1
            if url == "down":
                raise OSError
            return (503 if url == "busy" and calls[url] < 3 else 200), b"x"

        return get

    rows = convert.fetch(spark.createDataFrame([("ok",), ("busy",), ("down",)], "url string"), connector, 1, pause=0.0).collect()
    assert {(r.url, r.status, r.tries) for r in rows} == {("ok", 200, 1), ("busy", 200, 3), ("down", 0, 3)}


def test_headers_and_tokens(spark):
    urls = spark.createDataFrame([(acquire.ARCHIVE_CELEX + "3",), ("http://publications.europa.eu/resource/cellar/a/DOC_1",), ("https://x.example/",)], "u string")
    got_ = [r.h for r in urls.select(acquire.request_headers(F.col("u"), F.lit("NL")).alias("h")).collect()]
    assert got_ == [{"Accept": "application/xhtml+xml, text/html;q=0.9", "Accept-Language": "nl"}, {"Accept": "text/html", "Accept-Language": "nl"}, None]
    now, asked = [0.0], []
    token = convert.Token(lambda: (asked.append(1) or f"t{len(asked)}", 3600), clock=lambda: now[0])
    assert token.get() == token.get() == "t1"
    now[0] = 3479.0
    assert token.headers("k") == {"Authorization": "Bearer t1", "KeyId": "k"}
    now[0] = 3480.0
    assert token.get() == "t2" and len(asked) == 2


WORD = """<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>Quay</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p>
<w:p><w:r><w:t xml:space="preserve">It is </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>kept</w:t></w:r><w:r><w:t xml:space="preserve"> well.</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>two</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""


def test_office_files():
    assert office.word(zipped({"word/document.xml": WORD})) == "# Quay\n\n## Scope\n\nIt is **kept** well.\n\n- one\n  - two\n\n| a | b |\n| --- | --- |\n"
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Fees</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>per day</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'
    assert office.slides(zipped({"ppt/slides/slide10.xml": slide.replace("Fees", "Last"), "ppt/slides/slide2.xml": slide})) == "<!-- Slide number: 1 -->\n\n# Fees\n\nper day\n\n<!-- Slide number: 2 -->\n\n# Last\n\nper day\n"
    book = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Fees" r:id="rId1"/><sheet name="Empty" r:id="rId2"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>Quay</t></si><si><r><t>Day </t></r><r><t>fee</t></r></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>North</t></is></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>7.5</v></c></row><row/></worksheet>', "xl/worksheets/sheet2.xml": "<worksheet/>",
    }
    assert office.sheets(zipped(book)) == "## Fees\n\n| Quay |  | Day fee |\n| --- | --- | --- |\n| North | TRUE | 7.5 |\n"
    epub = {"META-INF/container.xml": '<c><rootfile full-path="O/c.opf"/></c>', "O/c.opf": '<package xmlns:dc="d"><dc:title>On quays</dc:title><item id="b" href="b.html"/><item id="a" href="t/a.html"/><itemref idref="a"/><itemref idref="b"/></package>', "O/t/a.html": "<body><h1>One</h1></body>", "O/b.html": "<body><p>two</p></body>"}
    assert office.book(zipped(epub)) == "**Title:** On quays\n\n# One\n\ntwo\n"
    assert office.delimited('a;b\n"x;1";y|z\n\n') == "| a | b |\n| --- | --- |\n| x;1 | y\\|z |\n" and office.delimited("") == "\n"
    assert office.json_data('[{"a": 1, "b": null}, {"c": "x"}]') == "| a | b | c |\n| --- | --- | --- |\n| 1 |  |  |\n|  |  | x |\n" and office.json_data('{"a": [1]}') == '{"a": [1]}\n'


def test_files_of_all_formats(spark, tmp_path):
    full = "a" * 60
    (tmp_path / "w.docx").write_bytes(zipped({"word/document.xml": WORD}))
    (tmp_path / "t.txt").write_text(f"{full}\nrest")
    (tmp_path / "m.md").write_text(f"{full}\nrest")
    (tmp_path / "s.xml").write_text("<ACT><P>short</P></ACT>")
    (tmp_path / "broken.xlsx").write_bytes(b"PK no")
    (tmp_path / "x.zzz").write_bytes(b"?")
    rows = {r.path.rsplit("/", 1)[1]: r for r in convert.file_documents(convert.read_files(spark, str(tmp_path))).collect()}
    assert rows["w.docx"].source == "Office • w.docx" and rows["t.txt"].markdown == f"{full} rest\n" and rows["m.md"].markdown == f"{full}\nrest\n"
    assert rows["s.xml"].markdown == "short\n" and rows["broken.xlsx"].error == "malformed" and rows["x.zzz"].error == "undeclared_format"


def test_remote_files(spark):
    landed = [("https://x.example/a?b", 200, "text/html; x", b"<p>page"), ("https://x.example/b.html", 404, None, b"x"), ("file:///etc/x.html", 200, None, b"x"), ("https://x.example/c.html", 200, None, b""), ("https://x.example/d.html", 200, None, b"x" * 50)]
    rows = {r.url: r for r in convert.remote_files(spark.createDataFrame(landed, "url string, status int, content_type string, content binary"), most=40).collect()}
    assert rows["https://x.example/a?b"].source == "HTML • https://x.example/a?b" and rows["https://x.example/a?b"].markdown == "page\n"
    assert [rows[u].error for u, *_ in landed[1:]] == ["status_404", "not_a_web_address", "no_content", "too_large"]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a\n", "x • y", "document", None, "../é b"), (None, None, None, "status_404", "k.md")], "markdown string, source string, kind string, error string, filename string")
    sinks.write_json(docs, str(tmp_path / "json"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "json")).collect())
    assert [json.loads(x) for x in lines] == [{"error": "status_404"}, {"markdown": "a\n", "source": "x • y", "kind": "document"}]
    for _ in range(2):  # a repeated task changes nothing
        assert {tuple(r) for r in sinks.write_files(sinks.downloads(docs), str(tmp_path / "out")).collect()} == {("..___b.md", 2), ("k.md", 0)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == ["..___b.md", "k.md"]
    pieces = spark.createDataFrame([(1, 0, "one", None), (1, 1, None, "truncated"), (1, 2, "lost", None), (2, 0, "x", None), (2, 1, "y", None)], "doc_id long, chunk_no int, cleaned string, error string")
    text = {}
    for r in sinks.streamed_text(pieces).orderBy("doc_id", "out_no").collect():
        text[r.doc_id] = text.get(r.doc_id, "") + r.text
    assert text == {1: "one" + sinks.STREAM_ERROR + "truncated", 2: "x\n\ny"}


def test_settings(tmp_path):
    state = sinks.Settings(str(tmp_path / "s" / "settings.json"))
    assert state.read() == {} and state.fingerprint() is None
    assert state.change(lambda v: v.update(model="m")) == {"model": "m"} == sinks.Settings(state.path).read()
    state.read()["model"] = "changed"
    assert state.read() == {"model": "m"}
    with open(state.path, "w") as f:
        f.write("[broken")
    assert state.read() == {}


def test_price_catalogue(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"id": "v/a", "pricing": {"prompt": "0.1", "completion": None}}, {"id": "v/b"}]}))
    assert [tuple(r) for r in estimate.catalogue(spark, str(tmp_path / "c.json")).orderBy("ord").collect()] == [(0, "v/a", "0.1", None), (1, "v/b", None, None)]
    row = spark.range(1).select(estimate.shown_number(F.lit(1234567)).alias("n"), estimate.profile_for(F.lit("caselaw")).alias("p")).first()
    assert (row.n, row.p) == ("1.234.567", "caselaw")


def answer(text, reason="stop"):
    return json.dumps({"choices": [{"message": {"content": text}, "finish_reason": reason}]})


@pytest.mark.parametrize("status,body,code", [(401, "", "rejected_key"), (500, "x", "status_500"), (200, "{}", "unexpected_answer"), (200, "no json", "unexpected_answer"), (200, answer("cut", "length"), "truncated")])
def test_failed_answers(status, body, code):
    with pytest.raises(clean.CleaningError) as e:
        clean.completion_text(status, body, "generic")
    assert e.value.code == code


def test_model_client(spark):
    assert clean.completion_text(200, answer(" ok "), "generic") == "ok" and clean.completion_text(200, answer("```markdown\n# T\n```"), "obsidian") == "# T" and clean.completion_text(200, answer(None), "generic") == ""
    body = clean.completion_request("a {b}", "caselaw", "v/m", stream=True)
    assert body["stream"] and body["messages"][1]["content"].endswith("a {b}") and "never turn" in body["messages"][0]["content"]
    lines = ["", "data: " + json.dumps({"choices": [{"delta": {"content": "```\n# long enough title\n"}}]}), "data: {broken", "data: " + json.dumps({"choices": [{"delta": {"content": "text\n```"}}]}), "data: [DONE]", "data: " + json.dumps({"choices": [{"delta": {"content": "late"}}]})]
    assert "".join(clean.streamed_document(["x", "y"], lambda c: lines, fenced=True)) == "# long enough title\ntext\n\n# long enough title\ntext"
    for wrong, code in ((["data: [DONE]"], "empty_answer"), (["data: " + json.dumps({"choices": [{"delta": {"content": "a"}, "finish_reason": "length"}]})], "truncated")):
        with pytest.raises(clean.CleaningError) as e:
            list(clean.streamed_pieces(wrong))
        assert e.value.code == code
    docs = spark.createDataFrame([(1, "good", "k"), (2, "bad", "k"), (3, " ", "k"), (4, "good", "k")], "doc_id long, markdown string, kind string")
    profiles = spark.createDataFrame([("generic", "k", False, 50)], "profile string, kind string, no_chunk boolean, chunk_chars int")

    def post(headers, body):
        text = body["messages"][1]["content"].split("\n")[-1].upper()
        return (200, '{"choices": [{"message": {"content": "' + text + '"}}]}') if "good" in str(body) else (429, "slow")

    got_ = {r.doc_id: (r.markdown, r.error) for r in clean.clean(docs, profiles, clean.model_cleaner(post, "v/m", "key")).collect()}
    assert got_ == {1: ("GOOD\n", None), 2: (None, "status_429"), 3: (None, "nothing_to_clean"), 4: ("GOOD\n", None)}
    sent = clean.clean_chunks(clean.chunk_table(docs, profiles), clean.model_cleaner(post, "v/m", "key"), once=True)
    assert {(r.doc_id, r.cleaned, r.error) for r in sent.collect()} == {(1, "GOOD", None), (2, None, "status_429"), (3, None, "nothing_to_clean"), (4, "GOOD", None)}
    assert {r.error for r in clean.clean(docs, profiles, clean.model_cleaner(post, "v/m", None)).where("doc_id < 3").collect()} == {"missing_key"}


def test_kept_results_are_not_asked_for_again(spark):
    docs = spark.createDataFrame([(1, "one", "k"), (2, "two", "k")], "doc_id long, markdown string, kind string")
    profiles = spark.createDataFrame([("p", "k", False, 50)], "profile string, kind string, no_chunk boolean, chunk_chars int")
    chunks = clean.chunk_table(docs, profiles)
    kept = chunks.where("chunk = 'one'").select("key", F.lit("kept").alias("cleaned"))

    def make():
        def one(chunk, profile):
            assert chunk != "one"
            return chunk.upper()

        return one

    assert {(r.doc_id, r.cleaned, r.error) for r in clean.clean_chunks(chunks, make, kept=kept).collect()} == {(1, "kept", None), (2, "TWO", None)}
