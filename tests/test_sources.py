"""HTML, Markdown, XML and rows as sources; sentences."""

import pytest

from blockwright.functions.sentences import split_sentences
from blockwright.sources import html

# Example texts of one sentence.
WHOLE = [
    "Effective September 1, 2017, John Smith (“Advisor”) and XYZ, Inc. (“Company”) agree as follows:",
    "Fig. 2 shows a U.S.A. map.",
    "The item at issue is no. 3553.",
    "Computershare Trust Company, N.A. (“Computershare”) is the transfer agent and registrar for our common stock.",
    "valid any day after january 1. not valid on federal holidays, including february 14, or with other in-house events, specials, or happy hour.",
    "LSTM networks, which we preview in Sec. 2, have been successfully",
    "J. Smith went on...and on... Then stopped",
]


@pytest.mark.parametrize("text", WHOLE)
def test_stays_one_sentence(text):
    assert split_sentences(text) == [text]


def test_sentences():
    assert split_sentences("One two. Three four! Five? Six") == ["One two.", "Three four!", "Five?", "Six"]
    assert split_sentences('He said "Go." Then left (a. b). End.\nNext line') == ['He said "Go."', "Then left (a. b).", "End.", "Next line"]
    assert split_sentences("") == [] and split_sentences(None) == []
    assert split_sentences("1. Item two. Done") == ["1. Item two.", "Done"]
    assert split_sentences(". , Start here. End") == ["Start here.", "End"]


# Fixed value: an example page.
PAGE = """<html><head><title>T</title></head><body><h1>A</h1><p>Plain words are here, and end.</p><h2>B</h2><li>item <b>one</b></li><h2>C</h2><p><b>Bold Title</b><p>para text follows this.
<h1>D</h1><table><tr><th>H1</th><th></th><th colspan=2>H2</th></tr><tr><td>a</td><td> </td><td>b</td><td>c</td></tr><tr><td></td></tr></table><table><tr><td>only</td><td>one</td></tr></table><div>lost</div></body></html>"""


def test_html_blocks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p> </p>")], "page_id int, html string")
    got = html.html_blocks(pages).orderBy("page_id", "block_idx").collect()
    assert {r.page_id for r in got} == {1}
    assert [(r.block_type, r.block_text.strip(), r.level, r.level_chain) for r in got] == [
        ("header", "A", 0, ["A"]),
        ("para", "Plain words are here, and end.", 1, ["A"]),
        ("header", "B", 1, ["B", "A"]),
        ("list_item", "item one", 2, ["B", "A"]),
        ("header", "C", 1, ["C", "A"]),
        ("header", "Bold Title", 2, ["Bold Title", "C", "A"]),
        ("para", "para text follows this.", 3, ["Bold Title", "C", "A"]),
        ("header", "D", 0, ["D"]),
        ("table_row", "H1  H2", 1, ["D"]),
        ("table_row", "a  b c", 1, ["D"]),
        ("para", "only one", 1, ["D"]),
    ]
    head, row = got[8], got[9]
    assert head.is_header_group and head.is_header and head.is_table_start and not head.is_table_end and head.col_spans == [1, 1, 2]
    assert row.is_table_end and not row.is_header and row.cell_values == ["a", "", "b", "c"]


MARKDOWN = """# Title

Intro line one
line two

## Part *A*
- one
- two
  more
    - nested

> quoted
> text

```py
code here
```

| H1 | H2 |
|----|:--:|
| a  | b |
| c  |

Under
=====
last
***
"""


def test_markdown(spark):
    from blockwright.sources import markdown

    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "")], "doc_id int, text string")
    got = markdown.markdown_blocks(docs).orderBy("doc_id", "part").collect()
    assert {r.doc_id for r in got} == {1}
    assert [(r.block_type, r.block_text, r.level) for r in got] == [
        ("header", "Title", 0),
        ("para", "Intro line one\nline two", 1),
        ("header", "Part *A*", 1),
        ("list_item", "one", 2),
        ("list_item", "two\nmore", 2),
        ("para", "quoted\ntext", 2),
        ("para", "code here\n", 2),
        ("table_row", "H1 H2", 2),
        ("table_row", "a b", 2),
        ("table_row", "c ", 2),
        ("header", "Under", 0),
        ("para", "last", 1),
    ]
    rows = [r for r in got if r.block_type == "table_row"]
    assert rows[0].is_header_group and rows[0].is_table_start and rows[-1].is_table_end and rows[1].cell_values == ["a", "b"]


XML = """<root><official_title>A Study of Things</official_title><BriefSummary kind="short"><textblock>First line of text is here.
PROJECT OVERVIEW
This project started out really well.</textblock></BriefSummary><empty/><skip></skip><country>Sweden</country></root>"""


def test_xml(spark):
    from blockwright.sources import xml

    docs = spark.createDataFrame([(1, XML.replace("<BriefSummary", "<BriefSummary").replace('kind="short">', 'kind="short">\n')), (2, "no xml"), (3, None)], "doc_id int, text string")
    got = xml.xml_blocks(docs).orderBy("block_idx").collect()
    assert [(r.block_type, r.block_text, r.level, r.header_text) for r in got] == [
        ("header", "Official Title", 0, "Official Title"),
        ("para", "A Study of Things", 1, "Official Title"),
        ("header", "Brief Summary short", 0, "Brief Summary short"),
        ("para", "First line of text is here.", 1, "Brief Summary short"),
        ("header", "PROJECT OVERVIEW", 1, "Brief Summary short"),
        ("para", "This project started out really well.", 2, "PROJECT OVERVIEW"),
        ("header", "Country", 0, "Country"),
        ("para", "Sweden", 1, "Country"),
    ]


def test_rows(spark):
    from blockwright.sources import rows

    df = spark.createDataFrame([(7, "Alpha Corp", "OVERVIEW\nIt went really well today.", None)], "row_id int, full_name string, note string, x string")
    got = rows.row_documents(df, "row_id", title_range=(2, 2)).orderBy("block_idx").collect()
    assert [(r.block_type, r.block_text, r.level) for r in got] == [
        ("header", "Alpha Corp", 0),
        ("header", "row id", 1),
        ("para", "", 2),
        ("header", "full name", 1),
        ("para", "Alpha Corp", 2),
        ("header", "note", 1),
        ("header", "OVERVIEW", 2),
        ("para", "It went really well today.", 2),
        ("header", "x", 1),
        ("para", "N/A", 2),
    ]


def test_mixed_types_and_rendering(spark):
    import json

    from blockwright.operators import render
    from blockwright.sources import dispatch

    docs = spark.createDataFrame([("t", "text/plain", "PROJECT OVERVIEW\nThis project started out really well. It goes on."), ("h", "text/html", PAGE), ("m", "text/markdown", MARKDOWN), ("x", "application/xml", XML), ("o", "application/msword", "<p>From another format.</p>"), ("n", None, None)], "doc_id string, mime string, text string")
    got = {r.doc_id: r for r in dispatch.parse_document(docs).collect()}
    assert set(got) == {"t", "h", "m", "x", "o"}
    reply = json.loads(got["t"].json)
    blocks = reply["return_dict"]["result"]["document"]["blocks"]
    assert reply["status"] == 200 and [b["tag"] for b in blocks] == ["header", "para"] and blocks[1]["sentences"] == ["This project started out really well.", "It goes on."]
    tables = [b for b in json.loads(got["h"].json)["return_dict"]["result"]["document"]["blocks"] if b["tag"] == "table"]
    assert len(tables) == 1 and [r["type"] for r in tables[0]["table_rows"]] == ["table_header", "table_data_row"]
    assert tables[0]["table_rows"][0]["cells"][2] == {"cell_value": "H2", "col_span": 2} and tables[0]["name"] == "D"
    page = got["t"].html
    assert page.startswith("<!DOCTYPE html><html><head><style>") and "<h4 style='margin-left: 0px;' page_idx=0 class=\"" + f'{render.HEADER_CLASS} {render.SENTENCE_MARK}0"> PROJECT OVERVIEW </h4>' in page
    assert f'<span class="{render.SENTENCE_MARK}1">This project started out really well. </span><span class="{render.SENTENCE_MARK}2">It goes on. </span>' in page
    assert got["h"].html.count("<tr ") == 2 and got["h"].html.count("</tbody></table>") == 1 and "colspan=2>H2</th>" in got["h"].html


def test_sentences_keep_all_text():
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist():
        for line in (text or "").split("\n"):
            assert "".join("".join(split_sentences(line)).split()) == "".join(line.split())
