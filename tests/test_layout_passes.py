"""Positions, merging passes, rules and header levels."""

import random

from pyspark.sql import functions as F

from blockwright.operators import merging, pages
from blockwright.sources import positions

BLOCK = "doc_id int, page_idx int, block_idx int, block_type string, block_text string, box struct<top:double,left:double,width:double,height:double>, font_family string, font_size double, font_weight int, font_style string, page_width double"


def blocks(spark, rows):
    made = [(1, page, i, kind, text, (top, left, width, 10.0), "T", size, 400, "normal", 600.0) for i, (page, kind, text, top, left, width, size) in enumerate(rows)]
    return spark.createDataFrame(made, BLOCK)


def texts(df):
    return [(r.block_type, r.block_text) for r in df.orderBy("block_idx").collect()]


def test_style_attribute(spark):
    style = "font-size:10.0px;font-family:Arial,Bold;font-style:normal;font-weight:normal;top:121.119px;text-indent:72;word-start-positions:[(72.0,121.1), (100.5,121.1)];word-end-positions:[(98.0,121.1), (130.25,121.1)];word-fonts:[(Arial-Bold,normal,normal,10.0,10.0,2.5), (Arial,normal,italic,10.0,10.0,3.0)]"
    wrong = style.replace("(130.25,121.1)", "(60.0,121.1)")
    df = spark.createDataFrame([(1, "two words", style), (2, "two words", wrong)], "id int, text string, style string")
    a, b = positions.parse_style(df).orderBy("id").collect()
    assert (a.top, a.left, a.width, a.height, a.font_size, a.font_weight, a.space_width) == (121.12, 72.0, 58.25, 10.0, 12.0, 600, 2.5)
    assert a.word_styles[1].font_style == "italic" and a.word_styles[1].font_weight == 400 and a.word_styles[0].font_weight == 600
    assert b.width == 100.5 + 5 * 3.0 - 72.0


def test_leaders_and_scans(spark):
    df = spark.createDataFrame([("Intro ........ 12", 0.0, 170.0), ("plain", 0.0, 50.0)], "text string, left double, width double")
    got = [(r.text, r.left, r.changed) for r in positions.without_leaders(df).collect()]
    assert got == [("Intro", 0.0, True), ("12", 150.0, True), ("plain", 0.0, False)]
    words = spark.createDataFrame([(1, 0, 0, 0, "Hello", "bbox 10 20 50 30"), (1, 0, 0, 1, "there", "bbox 55 21 90 31; x_wconf 90")], "doc_id int, page_idx int, line_no int, word_no int, text string, title string")
    line = positions.hocr_lines(words, scale=0.5).first()
    assert (line.text, line.left, line.top, line.width, line.height) == ("Hello there", 5.0, 10.0, 40.0, 5.5)
    few = spark.createDataFrame([(1, p) for p in (0, 1, 1, 1, 1, 2)], "doc_id int, page_idx int")
    assert positions.sparse_pages(few).first().needs_ocr and positions.page_slice(few, 1, 2).count() == 5


def test_paragraphs_go_on(spark):
    df = blocks(spark, [(0, "para", "It begins here", 0.0, 72.0, 400.0, 10.0), (0, "para", "and goes on.", 12.0, 72.0, 400.0, 10.0), (0, "para", "New one with", 60.0, 72.0, 400.0, 10.0), (1, "para", "its end.", 20.0, 72.0, 400.0, 10.0), (1, "para", "Far", 50.0, 72.0, 400.0, 10.0), (1, "para", "apart", 300.0, 72.0, 400.0, 10.0)])
    got = merging.merge_paragraphs(df)
    assert texts(got) == [("para", "It begins here and goes on."), ("para", "New one with its end."), ("para", "Far"), ("para", "apart")]
    assert got.filter("block_idx = 0").first().box.height == 20.0 and got.columns == df.columns


def test_headers_but_no_names(spark):
    df = blocks(spark, [(0, "header", "Report of the", 0.0, 200.0, 200.0, 14.0), (0, "header", "board on this", 20.0, 200.0, 200.0, 14.0), (0, "header", "John Smith", 40.0, 200.0, 200.0, 14.0), (0, "header", "other style", 60.0, 200.0, 200.0, 12.0)])
    assert texts(merging.merge_headers(df)) == [("header", "Report of the board on this"), ("header", "John Smith"), ("header", "other style")]


def test_out_of_order_lists_and_centre(spark):
    df = blocks(spark, [(0, "para", "as set out in", 0.0, 72.0, 400.0, 10.0), (0, "list_item", "(ii) of the act", 12.0, 72.0, 400.0, 10.0), (0, "para", "as follows", 30.0, 72.0, 400.0, 10.0), (0, "list_item", "(a) first", 42.0, 72.0, 400.0, 10.0), (1, "para", "of the page.", 10.0, 72.0, 400.0, 10.0)])
    assert texts(merging.merge_out_of_order(df)) == [("para", "as set out in (ii) of the act"), ("para", "as follows"), ("list_item", "(a) first of the page.")]
    mid = blocks(spark, [(0, "header", "TITLE", 0.0, 250.0, 100.0, 14.0), (0, "para", "by them", 20.0, 275.0, 50.0, 10.0), (0, "para", "left text.", 40.0, 72.0, 400.0, 10.0)])
    assert texts(merging.merge_centered(mid)) == [("para", "TITLE by them"), ("para", "left text.")]
    assert merging.organise(mid).count() == 2


def test_rules(spark):
    rows = [("line", 0.0, 10.0, 50.0, 10.0), ("line", 50.5, 10.3, 100.0, 10.3), ("line", 0.0, 10.0, 50.0, 10.0), ("rect", 200.0, 10.0, 300.0, 10.5), ("line", 5.0, 0.0, 5.0, 40.0), ("line", 0.0, 0.0, 9.0, 9.0), ("rect", 0.0, 0.0, 600.0, 800.0), ("rect", 10.0, 10.0, 50.0, 60.0)]
    shapes = spark.createDataFrame([(1, 0, *r, 600.0, 800.0) for r in rows], "doc_id int, page_idx int, kind string, x1 double, y1 double, x2 double, y2 double, page_width double, page_height double")
    rules = merging.ruled_lines(shapes)
    assert sorted((r.vertical, r.at, r.begin, r.end) for r in rules.collect()) == [(False, 10.0, 0.0, 100.0), (False, 10.0, 200.0, 300.0), (True, 5.0, 0.0, 40.0)]
    assert merging.page_boxes(shapes).count() == 1
    df = blocks(spark, [(0, "para", "a", -5.0, 10.0, 50.0, 10.0), (0, "para", "b", 12.0, 10.0, 60.0, 10.0), (0, "para", "c", 40.0, 10.0, 60.0, 10.0)])
    assert [r.ruled_above for r in merging.ruled_above(df, rules).orderBy("block_idx").collect()] == [False, True, False]


def test_levels_by_prefix(spark):
    df = blocks(spark, [(0, "header", "PART I", 0.0, 250.0, 100.0, 14.0), (0, "header", "Item 1. Business", 20.0, 72.0, 100.0, 12.0), (0, "header", "Overview", 40.0, 72.0, 100.0, 10.0), (0, "header", "Item 2. Risks", 60.0, 72.0, 100.0, 12.0), (0, "header", "3. Loose", 80.0, 72.0, 100.0, 10.0)])
    got = {r.block_text: (r.prefix, r.number_part, r.level) for r in merging.numbered_levels(df).collect()}
    assert got == {"PART I": ("PART", "I", 0), "Item 1. Business": ("Item", "1", 1), "Item 2. Risks": ("Item", "2", 1), "Overview": ("no_prefix", None, 2)}


def test_joined_texts(spark):
    row = spark.range(1).select(merging.joined_texts(F.array(F.lit("see ("), F.lit("a"), F.lit(") and"), F.lit("more"), F.lit("."))).alias("t")).first()
    assert row.t == "see (a) and more."


def test_stack_of_looks(spark):
    from blockwright.operators import indent

    rows = [(0, "header", "TITLE", 16.0), (0, "header", "Part one", 14.0), (0, "para", "text of it.", 10.0), (0, "list_item", "a) first", 10.0), (0, "list_item", "i) deeper", 10.0), (0, "list_item", "b) second", 10.0), (0, "header", "Section", 12.0), (0, "para", "more.", 10.0), (0, "header", "Part two", 14.0), (0, "table_row", "x 1", 10.0), (0, "header", "NEXT", 16.0)]
    df = blocks(spark, [(p, k, t, 10.0 * i, 72.0, 100.0, size) for i, (p, k, t, size) in enumerate(rows)])
    got = [r.level for r in indent.indent_levels(df).orderBy("block_idx").collect()]
    assert got == [0, 1, 2, 3, 4, 3, 2, 3, 1, 2, 0]
    one = blocks(spark, [(0, "header", "Only", 0.0, 72.0, 100.0, 16.0), (0, "para", "a.", 10.0, 72.0, 100.0, 10.0), (0, "list_item", "a) b", 20.0, 72.0, 100.0, 10.0)])
    assert [r.level for r in indent.without_lonely_tops(indent.indent_levels(one)).orderBy("block_idx").collect()] == [0, 0, 1]


def test_positioned_table(spark):
    from blockwright.operators import tables

    cells = [(0, 0.0, 40.0, "Name"), (0, 100.0, 150.0, "Y1"), (0, 200.0, 250.0, "Y2"), (1, 0.0, 120.0, "Group of things"), (2, 0.0, 30.0, "Cash"), (2, 110.0, 140.0, "5"), (2, 210.0, 230.0, "6"), (3, 0.0, 30.0, "Debt"), (3, 205.0, 240.0, "7"), (3, 242.0, 249.0, "%")]
    df = spark.createDataFrame([(1, 0, *c) for c in cells], "doc_id int, table_idx int, row_idx int, left double, right double, text string")
    got = {r.row_idx: r for r in tables.positioned_table(df).collect()}
    assert got[0].cell_values == ["Name", "Y1", "Y2"] and got[0].is_header and not got[0].is_row_group
    assert got[1].cell_values[0] == "Group of things" and got[1].is_row_group
    assert got[2].cell_values == ["Cash", "5", "6"] and got[3].cell_values == ["Debt", "", "7 %"]


def test_sections_and_special_lists(spark):
    df = blocks(spark, [(0, "para", "Section 2.1 Use of Funds. The money is spent.", 0.0, 72.0, 400.0, 10.0), (0, "para", "Section 5 was read.", 20.0, 72.0, 400.0, 10.0), (0, "list_item", "3.2. Terms: these hold.", 40.0, 72.0, 400.0, 10.0)])
    got = merging.split_sections(df)
    assert texts(got) == [("header", "Section 2.1 Use of Funds."), ("para", "The money is spent."), ("para", "Section 5 was read."), ("header", "3.2. Terms:"), ("para", "these hold.")]
    assert got.columns == df.columns
    rows = [("table_row", "GOLD BANK SILVER BANK", ["GOLD BANK", "SILVER BANK"], 12.0, 600), ("table_row", "IRON BANK", ["IRON BANK"], 12.0, 600), ("para", "Text.", None, 10.0, 400), ("table_row", "Cash 5", ["Cash", "5"], 10.0, 400)]
    names = spark.createDataFrame([(1, 0, i, *r) for i, r in enumerate(rows)], "doc_id int, page_idx int, block_idx int, block_type string, block_text string, cell_values array<string>, font_size double, font_weight int")
    assert texts(merging.special_lists(names)) == [("list_item", "GOLD BANK"), ("list_item", "SILVER BANK"), ("list_item", "IRON BANK"), ("para", "Text."), ("table_row", "Cash 5")]


def test_wrapped_rows_and_font_headers(spark):
    from blockwright.operators import layout, tables

    rows = [(0, ["Term", "Meaning"], True), (1, ["Act", "the law"], False), (2, ["", "of 1934"], False), (3, ["Bank", "a bank"], False)]
    df = spark.createDataFrame([(1, 0, *r) for r in rows], "doc_id int, table_idx int, row_idx int, cell_values array<string>, is_header boolean")
    got = [(r.cell_values, r.has_merged_cells) for r in tables.merge_wrapped_rows(df).orderBy("row_idx").collect()]
    assert got == [(["Term", "Meaning"], False), (["Act", "the law of 1934"], True), (["Bank", "a bank"], False)]
    made = blocks(spark, [(0, "para", "what it is", 0.0, 72.0, 100.0, 14.0), (0, "para", "normal text here.", 20.0, 72.0, 400.0, 10.0), (0, "para", "big but said.", 40.0, 72.0, 400.0, 16.0)])
    stats = spark.createDataFrame([(1, "T", 14.0, 400, "normal", 1), (1, "T", 10.0, 400, "normal", 9), (1, "T", 16.0, 400, "normal", 1)], "doc_id int, font_family string, font_size double, font_weight int, font_style string, n_lines long")
    assert texts(layout.font_headers(made, stats)) == [("header", "what it is"), ("para", "normal text here."), ("para", "big but said.")]


def test_columns_side_by_side(spark):
    from blockwright.operators import layout

    rows = [(0, 0.0, 0.0), (1, 20.0, 0.0), (2, 40.0, 0.0), (3, 0.0, 300.0), (4, 20.0, 300.0), (5, 40.0, 300.0), (6, 10.0, 5.0)]
    df = spark.createDataFrame([(1, 0, i, top, left, 250.0) for i, top, left in rows], "doc_id int, page_idx int, block_idx int, top double, left double, width double")
    got = {r.block_idx: r.order for r in layout.reading_order(df).collect()}
    assert [got[i] for i in (0, 6, 1, 2, 3, 4, 5)] == [0, 1, 2, 3, 4, 5, 6]


def test_stray_blocks_are_placed_without_a_row_for_each_pair(spark):
    rng = random.Random(12)
    some = lambda n: rng.choice([None, float("nan"), *(float(rng.randrange(n)) for _ in range(20))])
    blocks = [(rng.choice([1, 2, None]), 0, i, some(30), some(9), some(40)) for i in range(300)]
    stray = [(rng.choice([1, 2, 3, None]), 0, i, some(40), some(9), some(12), some(60)) for i in range(200)]
    main = spark.createDataFrame(blocks, "doc_id long, page_idx int, block_idx long, top double, left double, bottom double")
    away = spark.createDataFrame(stray, "doc_id long, page_idx int, stray_idx long, top double, left double, right double, bottom double")
    main.createOrReplaceTempView("main_blocks")
    away.createOrReplaceTempView("stray_blocks")
    want = spark.sql(
        "WITH m AS (SELECT *, lag(top) OVER (PARTITION BY doc_id, page_idx ORDER BY block_idx) AS p FROM main_blocks) SELECT s.doc_id, s.stray_idx, min(m.block_idx) FILTER (WHERE (m.top >= s.top AND (m.p IS NULL OR s.top > m.p) AND NOT (abs(m.top - s.top) < 0.1 AND m.left < s.left))"
        " OR (m.top < s.top AND m.left > s.right AND s.bottom <= m.bottom) OR (abs(m.top - s.top) < 0.1 AND m.left >= s.left)) AS before FROM stray_blocks s LEFT JOIN m ON m.doc_id = s.doc_id AND m.page_idx = s.page_idx GROUP BY s.doc_id, s.stray_idx"
    )
    got = pages.placed(main, away)
    assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "stray_idx", "before").collect()), key=repr)
    assert rows(got) == rows(want)
