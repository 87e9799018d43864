"""Cells, spacing, stacks, settings, files and the service against plain versions."""

import http.client
import io
import json
import threading
import zipfile
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from blockwright import service, settings
from blockwright.functions import cells, scalars, segment, stacks, strings, words
from blockwright.functions.sentences import split_sentences
from blockwright.operators import blocks, geometry, matching, pages, spacing
from blockwright.plans import structure_queries
from blockwright.sources import binary, html, rows

CELL = "array<struct<top:double,left:double,right:double,height:double,text:string>>"
FULL = "array<struct<top:double,left:double,right:double,height:double,text:string,style:string,space:double>>"


def cell(top, left, right, text="x", height=10.0):
    return (float(top), float(left), float(right), height, text)


def full(top, left, right, text, height=10.0, style="s"):
    return (float(top), float(left), float(right), height, text, style, 3.0)


def one(spark, column, **arrays):
    frame = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} {FULL if v and len(v[0]) == 7 else CELL}" for k, v in arrays.items()))
    return frame.select(column.alias("x")).first()["x"]


def test_column_cells_are_those_that_meet_no_other(spark):
    row = [cell(10, 0, 20), cell(10, 50, 80), cell(22, 10, 30), cell(22, 100, 120), cell(34, 19, 25)]
    got = one(spark, geometry.column_cells(F.col("a")), a=row)
    assert [c.left for c in got] == [0, 50, 100]


def test_a_block_before_a_table_may_be_a_row(spark):
    before = [cell(10, 200, 230, "Year"), cell(10, 233, 260, "ended"), cell(10, 300, 330, "2020")]
    after = [cell(24, 100, 110, "Cash"), cell(24, 220, 240, "5"), cell(24, 305, 325, "6")]
    test = geometry.hidden_row(F.col("a"), F.col("b"))
    assert one(spark, test, a=before, b=after) == ["Year ended", "2020"]
    assert one(spark, test, a=before, b=[cell(24, 500, 540), cell(24, 600, 640)]) is None
    assert one(spark, test, a=before, b=[cell(24, 100, 110), cell(24, 220, 250), cell(24, 305, 325)]) is None
    assert one(spark, test, a=[cell(10, 200, 330)], b=after) is None


def test_alignment_counts_cells_with_a_partner(spark):
    long = [cell(10, 0, 50), cell(10, 100, 140), cell(10, 200, 240)]
    test = geometry.alignment(F.col("a"), F.col("b"))
    found = one(spark, test, a=long, b=[cell(24, 102, 150), cell(24, 201, 230)])
    assert (found.n, found.places) == (2, [1, 2])
    assert one(spark, test, a=long, b=[cell(24, 1000, 1500)]).n == 0
    assert one(spark, test, a=[cell(24, 5, 40)], b=long).places == [0]
    breaks = lambda n, k, at: spark.range(1).select(geometry.alignment_breaks(F.lit(n), F.lit(k), F.array(*map(F.lit, at)))).first()[0]
    assert breaks(1, 3, [0]) and not breaks(2, 3, [0, 2]) and breaks(2, 5, [0, 1]) and not breaks(1, 1, [0])


def test_paragraphs_beside_the_second_column(spark):
    before, page = [cell(10, 50, 90), cell(10, 300, 400)], F.lit(600.0)
    test = geometry.beside_second_column(F.col("a"), F.col("b"), page, F.lit(True))
    assert one(spark, test, a=before, b=[cell(24, 310, 500)]) and not one(spark, test, a=before, b=[cell(24, 50, 90)])
    wrapped = [cell(10, 50, 90), cell(22, 50, 80), cell(10, 300, 400)]
    assert one(spark, test, a=wrapped, b=[cell(40, 305, 500)]) and not one(spark, test, a=before[1:], b=[cell(24, 310, 500)])


def test_split_cells_come_together(spark):
    row = [full(10, 0, 30, "Net"), full(10, 33, 70, "income"), full(10, 150, 155, "$"), full(10, 160, 190, "1,200"), full(10, 195, 220, "300"), full(10, 300, 330, "5")]
    assert [c.text for c in one(spark, cells.merged_cells(F.col("a")), a=row)] == ["Net income", "$1,200", "300", "5"]
    assert [c.text for c in one(spark, cells.merged_cells(F.col("a")), a=[full(10, 0, 30, "Cost$"), full(10, 100, 120, "7")])] == ["Cost", "$7"]
    column = [full(10, 0, 60, "Deferred"), full(22, 8, 60, "taxes"), full(10, 200, 220, "9"), full(9, 221, 224, "a", 4.0)]
    assert [c.text for c in one(spark, cells.stacked_cells(F.col("a")), a=column)] == ["Deferred taxes", "9 a"]
    assert one(spark, cells.merged_cells(F.col("a")), a=[]) == []


@pytest.mark.parametrize("row,target,above,want", [(["", "", "x"], ["a", "b", "c"], True, ["a", "b", "c x"]), (["x", ""], ["a", "b", "c"], False, ["x a", "b", "c"]), (["", "x", ""], ["a", "b", "c"], True, None), (["", "x"], ["a", "b", "c"], True, None)])
def test_rows_of_one_cell_go_into_their_neighbour(spark, row, target, above, want):
    array = lambda words: F.array(*map(F.lit, words))
    assert spark.range(1).select(cells.row_into(array(row), array(target), above)).first()[0] == want


def test_stacks_keep_what_outranks():
    nodes = [{"key": k, "rank": r, "text": t} for k, r, t in (("h1", 1, "A"), (None, 0, None), ("h3", 3, "B"), ("p_b", 0, "C"), (None, 0, None), ("p_b", 0, "D"), ("h2", 2, "E"))]
    got = [(n["level"], n["header_text"], n["level_chain"]) for n in stacks.chained(nodes)]
    assert got == [(0, "A", ["A"]), (1, "A", ["A"]), (1, "B", ["B", "A"]), (2, "C", ["C", "B", "A"]), (3, "C", ["C", "B", "A"]), (2, "D", ["D", "B", "A"]), (1, "E", ["E", "A"])]
    look = lambda size, kind=1, mark="": {"size": size, "weight": 400.0, "caps": 0, "kind": kind, "list": mark}
    assert stacks.ranked([look(14.0), look(12.0), look(0.0, 0), look(0.0, 0, "dot"), look(12.0), look(14.0)]) == [0, 1, 2, 3, 1, 0]
    assert stacks.ranked([]) == [] and stacks.chained([]) == []


def test_paragraphs_of_headers_are_divided(spark):
    texts = ["Risk Factors", "Legal Proceedings", "Mine Safety Disclosures", "Market Risk"]
    data = [(1, 0, i, t) for i, t in enumerate(texts)] + [(1, 1, 0, "This is the text of a paragraph that"), (1, 1, 1, "Goes On")] + [(2, 0, 0, "Risk Factors")]
    got = {(r.doc_id, r.block_idx, r.row_idx): r.is_heading for r in spacing.headers_of_rows(spark.createDataFrame(data, "doc_id int, block_idx int, row_idx int, text string")).collect()}
    assert all(got[1, 0, i] for i in range(4)) and not got[1, 1, 0] and not got[1, 1, 1] and not got[2, 0, 0]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.spaced_capitals(F.lit("netIncome ABc éA")).alias("a"),
        scalars.index_prefixes(F.array(F.lit("x"), F.lit("y"))).alias("b"),
        scalars.chunk_of(F.lit(7), 3).alias("c"),
        spacing.same_mark(F.lit("• a"), F.lit("• b"), F.lit("•")).alias("d"),
        spacing.tabs(F.array(F.lit(0.0), F.lit(50.0), F.lit(60.0)), F.array(F.lit(10.0), F.lit(55.0), F.lit(80.0))).alias("e"),
        scalars.same_words(F.array(F.lit("a"), F.lit("b,")), F.array(F.lit("b"), F.lit("a"))).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("net Income ABc é A", [["x"], ["x", "y"]], 2, True, 1, True)


def test_filings_have_headers_by_their_style(spark):
    page = "<body><p style='font-weight: bold'>RISK FACTORS</p><p>Some text of the filing, which goes on.</p><p style='font-weight:bold'>Legal Proceedings</p><table><tr><td>a</td><td>b</td></tr></table></body>"
    got = html.html_blocks(spark.createDataFrame([(1, page)], "page_id int, html string"), filing=True).orderBy("block_idx").collect()
    assert [(b.block_type, b.block_text, b.level) for b in got] == [("header", "RISK FACTORS", 0), ("para", "Some text of the filing, which goes on.", 1), ("header", "Legal Proceedings", 1), ("table_row", "ab", 2)]


def workbook(names, body):
    sheet = "".join("<row>" + "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(r) if v) + "</row>" for n, r in enumerate([names, *body], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_and_dictionaries_are_read(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook(["name", "size"], [["x", "1"], ["", "2"]]))
    assert sorted(tuple(r) for r in rows.read_workbook(spark, str(tmp_path / "a.xlsx")).collect()) == [("N/A", "2"), ("x", "1")]
    phrases = spark.createDataFrame([(1, "São Paulo"), (2, "Ångström unit")], "phrase_id long, phrase string")
    matching.write_dictionary(phrases, str(tmp_path / "d"))
    assert sorted(map(tuple, matching.read_dictionary(spark, str(tmp_path / "d")).collect())) == [(1, "São Paulo"), (2, "Ångström unit")]
    docs = spark.createDataFrame([(7, "In Sao Paulo an Angstrom unit")], "doc_id long, text string")
    assert sorted(r.meta[0] for r in matching.dictionary_hits(docs, matching.read_dictionary(spark, str(tmp_path / "d"))).collect()) == [1, 2]


def test_files_as_bytes(spark):
    files = spark.createDataFrame([(1, "text/plain", bytearray("é".encode())), (2, "application/pdf", bytearray(b"%PDF")), (3, "text/html", None), (4, "text/plain", bytearray(b"\xff"))], "doc_id int, mime string, content binary")
    got = {r.doc_id: (r.mime, r.text) for r in binary.extracted(files, True, lambda content, mime, options: f"<p>{len(content)} {options['headers']['X-Tika-PDFOcrStrategy']}</p>").collect()}
    assert got == {1: ("text/plain", "é"), 2: ("text/html", "<p>4 ocr_only</p>"), 3: ("text/html", ""), 4: ("text/plain", "�")}
    head = spark.range(1).select(binary.was_extracted(F.lit("<html><head><meta content='org.apache.tika.parser.pdf'></head>"))).first()[0]
    assert head


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("SOME_LIST", "a,b")
    settings.put_setting(spark, "SOME_NUMBER", 5)
    settings.put_setting(spark, "SOME_SWITCH", "yes")
    assert settings.listed(spark, "SOME_LIST") == ["a", "b"] and settings.number(spark, "SOME_NUMBER") == 5 and settings.switch(spark, "SOME_SWITCH") and settings.setting(spark, "NOT_THERE", "x") == "x"
    settings.put_setting(spark, "SOME_SWITCH", "maybe")
    with pytest.raises(ValueError):
        settings.switch(spark, "SOME_SWITCH")


def test_the_service_parses_what_it_gets(spark):
    running = service.server(spark, 0)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    try:
        ask = http.client.HTTPConnection("127.0.0.1", running.server_address[1], timeout=120)
        ask.request("GET", "/")
        assert json.loads(ask.getresponse().read()) == {"status": "Service is running"}
        body = b'--b\r\nContent-Disposition: form-data; name="file"; filename="a.md"\r\n\r\n# Title\n\nSome text.\r\n--b--\r\n'
        ask.request("POST", "/api/parseDocument?renderFormat=json", body, {"Content-Type": "multipart/form-data; boundary=b"})
        said = json.loads(ask.getresponse().read())
        assert said["status"] == "ok" and "Some text." in json.dumps(said["return_dict"])
        ask.request("POST", "/api/parseDocument?renderFormat=odd", b"x")
        assert ask.getresponse().status == 500
    finally:
        running.shutdown()


def test_lines_without_styles_and_joinable_parts(spark):
    docs = spark.createDataFrame([(1, "ﬁrst  LINE heLLo\n\n12\nSecond"), (2, "1234"), (3, None)], "doc_id int, text string")
    assert sorted((r.doc_id, r.line_no, r.line) for r in pages.plain_lines(docs).collect()) == [(1, 0, "first LINE hello"), (1, 2, "12"), (1, 3, "Second")]
    parts = spark.createDataFrame([(1, ["and this goes on with a", "long text of words"]), (2, ["Title Of", "Great Things"]), (3, ["alone"])], "i int, texts array<string>")
    assert {r.i: r.joinable for r in pages.joinable(parts).collect()} == {1: True, 2: False, 3: False}


def test_lines_of_pages_become_leveled_blocks(spark, sf):
    lines = spark.createDataFrame(structure_queries._layout(spark, sf).filter("doc_id < 6").toPandas())
    got = pages.page_blocks(lines).collect()
    assert got and all(r.level is not None and r.level >= 0 for r in got) and len({(r.doc_id, r.block_idx) for r in got}) == len(got)


def test_footers_below_a_page_number(spark):
    footers = [(1, "", 700, 0, 9), (1, "Company", 710, 2, 5), (1, "Draft", 690, 2, 5), (2, "Company", 710, 2, 5)]
    frame = spark.createDataFrame(footers, "doc_id int, key_text string, top int, first_page int, last_page int")
    assert {(r.doc_id, r.key_text): r.below_number for r in pages.below_numbers(frame).collect()} == {(1, ""): True, (1, "Company"): True, (1, "Draft"): False, (2, "Company"): False}


def test_letters_apart_are_words_and_words_are_corrected(spark):
    docs = spark.createDataFrame([(1, "E x e c u t i v e s u m m a r y\nThe text that follows it, which is long"), (2, "Plain words here")], "doc_id int, text string")
    known = ["the", "executive", "summary", "text"]
    got = {(r.doc_id, r.block_idx): r.block_text for r in blocks.clean_lines(docs, words=known).collect()}
    assert got[1, 0].startswith("Executive Summary") and got[2, 0] == "Plain words here"
    dictionary = spark.createDataFrame([(w, 10 - i) for i, w in enumerate(known)], "word string, frequency long")
    wrong = spark.createDataFrame([(1, "Exectuive SUMARY of teh txt 12"), (2, None)], "doc_id int, text string")
    assert {r.doc_id: r.text for r in segment.corrected_texts(wrong, dictionary).collect()} == {1: "Executive SUMMARY of the text 12", 2: ""}


def test_levels_of_a_whole_table_are_those_of_a_plain_stack(spark, sf):
    made = structure_queries.layout_blocks(spark, sf).collect()
    got = {(r.doc_id, r.block_idx): r.level for r in structure_queries.indent_levels(spark, sf).collect()}
    by_doc = defaultdict(list)
    for r in made:
        by_doc[r.doc_id].append(r)
    assert len(got) == len(made)
    for rows_ in by_doc.values():
        stack = []
        for r in sorted(rows_, key=lambda r: r.block_idx):
            head, mark = r.block_type == "header", ""
            if r.block_type == "list_item":
                token = (r.block_text.strip().split() or [""])[0]
                _, integer, roman, letter, dot, _ = words.numbered(token)
                mark = "roman" if roman else "letter" if letter else "integer" if integer else "dot" if dot else "" if regex.match(r"[\p{L}\p{N}(\"“'‘$]", token) else "bullet"
            look = ((1, r.font_size, float(r.font_weight), int(bool(regex.search(strings.UPPER, r.block_text)))), "") if head else ((0, 0.0, 0.0, 0), mark)
            if look in stack:
                stack = stack[: stack.index(look)]
            else:
                stack = [e for e in stack if e[0] > look[0] or (e[0] == look[0] and e[1] != look[1])]
            assert got[r.doc_id, r.block_idx] == len(stack)
            stack.append(look)


def test_rendered_documents_hold_their_blocks(spark, sf):
    made = defaultdict(list)
    for r in blocks.with_headers(blocks.clean_lines(spark.read.parquet(f"{sf}/documents.parquet"))).collect():
        made[r.doc_id].append(r)
    kinds = {"header": "header", "list_item": "list_item"}
    rendered = {r.doc_id: json.loads(r.json) for r in structure_queries.render_json_docs(spark, sf).collect()}
    assert rendered.keys() == made.keys()
    for doc_id, said in rendered.items():
        want = [(kinds.get(b.block_type, "para"), b.block_idx, [b.block_text] if b.block_type in ("header", "table_row") else split_sentences(b.block_text)) for b in sorted(made[doc_id], key=lambda b: b.block_idx)]
        assert [(b["tag"], b["block_idx"], b["sentences"]) for b in said["return_dict"]["result"]["document"]["blocks"]] == [w for w in want if w[2]]
