"""Tables, matching, layout, segmentation and streaming against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from blockwright.functions import scalars, segment
from blockwright.operators import layout, matching, tables
from blockwright.plans import structure_queries


@pytest.mark.parametrize(
    "row,cells",
    [
        ("Net income 1,200 (300) 5%", ["Net income", "1,200", "(300)", "5%"]),
        ("Paid yes - NA", ["Paid", "yes", "-", "NA"]),
        ("Total of 3 of items 4", ["Total of", "3 of items", "4"]),
        ("Rate: high 5", ["", "high", "5"]),
        ("The rate: 5", ["The rate:", "", "5"]),
        ("Cost $ 5 now", ["Cost", "$5", "now"]),
        ("", []),
    ],
)
def test_row_cells(spark, row, cells):
    assert spark.range(1).select(tables.row_cells(F.lit(row))).first()[0] == cells


def test_table_islands_leave_the_last_run_open(spark):
    kinds = ["table_row", "table_row", "para", "table_row", "para", "table_row", "table_row"]
    df = spark.createDataFrame([(1, i, k, "t") for i, k in enumerate(kinds)], "doc_id int, block_idx int, block_type string, block_text string")
    got = [(r.block_type, r.table_idx) for r in tables.table_islands(df).orderBy("block_idx").collect()]
    assert got == [("table_row", 0), ("table_row", 0), ("para", None), ("para", None), ("para", None), ("table_row", None), ("table_row", None)]
    kept = [r.table_idx for r in tables.table_islands(df, keep_last=True).orderBy("block_idx").collect()]
    assert kept == [0, 0, None, None, None, 1, 1]


def test_multi_level_headers_and_groups(spark):
    rows = [
        (1, 0, True, False, ["", "Year"], [1, 2]),
        (1, 1, True, False, ["", "2020", "2021"], None),
        (1, 2, False, True, ["Assets"], None),
        (1, 3, False, False, ["Cash:", "5", "6"], None),
        (1, 4, False, True, ["Debts"], None),
        (1, 5, False, False, ["Loans", "7", "8"], None),
        (2, 0, False, False, ["1", "x"], None),
        (2, 1, False, False, ["2", "y"], None),
        (3, 0, False, False, ["only"], None),
    ]
    df = spark.createDataFrame(rows, "table_id int, row_idx int, is_header boolean, is_row_group boolean, cell_values array<string>, col_spans array<int>")
    names = {(r.table_id, r.col_idx): r.name for r in tables.column_names(df).collect()}
    assert names == {(1, 0): "_UNKNOWN_COLUMN_0_", (1, 1): "Year 2020", (1, 2): "Year 2021", (2, 0): "_UNKNOWN_COLUMN_0_", (2, 1): "_UNKNOWN_COLUMN_1_", (3, 0): "_UNKNOWN_COLUMN_0_"}
    assert {r.table_id: r.index_col for r in tables.index_choice(df).collect()} == {1: 0, 2: -1, 3: None}
    got = sorted((r.type, r.idx, r.index_text, r.text) for r in tables.table_records(df).filter("table_id = 1").collect())
    assert got == [("col", 0, "Year 2020", "Year 2020 5 7"), ("col", 1, "Year 2021", "Year 2021 6 8"), ("row", 0, "Assets Cash", "Assets Cash 5 6"), ("row", 1, "Debts Loans", "Debts Loans 7 8")]


def test_grid(spark):
    boxes = [(1, 0, 0.0, 10.0, "a"), (1, 0, 20.0, 30.0, "b"), (1, 1, 2.0, 8.0, "c"), (1, 1, 21.0, 25.0, "d"), (1, 1, 26.0, 29.0, "e")]
    df = spark.createDataFrame(boxes, "t int, row_idx int, left double, right double, text string")
    assert {(r.row_idx, r.span_idx): r.cell for r in tables.grid(df, ["t"]).collect()} == {(0, 0): "a", (0, 1): "b", (1, 0): "c", (1, 1): "d e"}


def test_duplicates_by_level(spark):
    vectors = spark.createDataFrame([(1, "h", [1.0, 0.0]), (2, "h", [0.6, 0.8]), (3, "p", [1.0, 0.0]), (4, "h", [0.9, 0.1])], "vec_id int, level string, embedding array<float>")
    settings = spark.createDataFrame([(10, "h", [1.0, 0.0], True), (11, "h", [0.0, 1.0], False)], "setting_id int, level string, embedding array<float>, ignore_all_after boolean")
    got = {r.vec_id: r for r in matching.check_duplicates(vectors, settings).collect()}
    assert {k: r.is_duplicated for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False}  # 0.9 itself is not above
    assert got[1].ignore_all_after and got[2].setting_id == 11 and got[3].setting_id is None
    row_by_row = matching.check_duplicates(vectors, settings, most_bytes=0).collect()
    assert sorted(map(tuple, row_by_row), key=repr) == sorted(map(tuple, got.values()), key=repr)


def plain_hits(text, phrases):
    stop = set(matching.lexicon.STOP_WORDS)
    raw = [w for w in (text or "").split() if w[0].lower() + w[1:] not in stop]
    norm = [w.lower() if re.fullmatch("[A-Z][a-z]*", w) else w for w in raw]
    out, i = [], 0
    while i < len(norm):
        fit = max((p for p in phrases if norm[i : i + len(p)] == list(p)), key=len, default=None)
        if fit:
            out.append((i, " ".join(raw[i : i + len(fit)]), phrases[fit]))
            i += len(fit)
        else:
            i += 1
    return out


def test_dictionary_hits_are_the_longest_from_the_left(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "B-1", "the", "of"]
    phrases = [(1, "alpha beta"), (2, "alpha beta gamma"), (3, "gamma delta"), (4, "B-1"), (5, "alpha beta"), (6, "x")]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)] + [(100, None)]
    got = matching.dictionary_hits(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(phrases, "phrase_id int, phrase string"))
    known = {("alpha", "beta"): [1, 5], ("alpha", "beta", "gamma"): [2], ("gamma", "delta"): [3], ("B-1",): [4]}
    want = sorted((d, *h) for d, t in docs for h in plain_hits(t, known))
    assert sorted((r.doc_id, r.start, r.result, r.meta) for r in got.collect()) == want


def test_dictionary_hits_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi") for b in ("ra", "tu", "ve")] + ["the", "of"]
    passages = [" ".join(rng.choices(words, k=k)) for k in (30, 18, 9, 5, 3)] + [None, ""]
    whole = [w.split() for w in passages if w]
    docs = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)] + passages
    docs += [" ".join(["Zulu", *w[k:], "zulu", *w[:-1]]) for w in whole for k in (1, 4)] + [" ".join(["zulu", "zulu", *w[2:]]) for w in whole]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    known = {}
    for item, text in enumerate(passages):
        tokens = [w for w in (text or "").split() if w not in ("the", "of")]
        for phrase in {tuple(tokens), *(tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4))} - {()}:
            known.setdefault(phrase, []).append(item)
    want = sorted((d, *h) for d, t in enumerate(docs) for h in plain_hits(t, known))
    assert {len(h[2].split()) for h in want} > {5} and any(len(h[2].split()) > 5 for h in want)
    got = structure_queries.dictionary_hits(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.result, [int(i) for i in r.meta.split(",")]) for r in got) == want


def _page_lines():
    rows = []
    for page in range(4):
        rows.append((1, page, 0, "Annual Report", 20.0, 250.0, 100.0, 8.0, 8.0, 400))
        for i in range(5):
            rows.append((1, page, i + 1, f"Text of line {'abcde'[i]} on page which goes on", 200.0 + i * 14, 72.0, 400.0, 10.0, 10.0, 400))
        rows.append((1, page, 6, "New paragraph starts down here.", 300.0, 72.0, 300.0, 10.0, 10.0, 400))
        rows += [(1, page, 7 + c, t, 400.0, 72.0 + c * 150, 50.0, 10.0, 10.0, 400) for c, t in enumerate(["Cash", "5", "6"])]
        rows.append((1, page, 90, str(page + 1), 780.0, 290.0, 10.0, 8.0, 8.0, 400))
    return rows


@pytest.fixture
def page_lines(spark):
    df = spark.createDataFrame(_page_lines(), "doc_id int, page_idx int, line_no int, text string, top double, left double, width double, height double, font_size double, font_weight int")
    return df.withColumns({"font_family": F.lit("T"), "font_style": F.lit("normal"), "page_width": F.lit(600.0), "page_height": F.lit(800.0)})


def test_margins(page_lines):
    found = layout.headers_and_footers(page_lines).collect()
    assert {(r.zone, r.key_text, r.n_pages) for r in found} == {("header", "Annual Report", 4), ("footer", "", 4)}
    assert layout.without_margins(page_lines).filter("text = 'Annual Report' or top > 700").count() == 0


def test_layout_blocks(page_lines):
    got = layout.layout_blocks(page_lines).filter("page_idx = 0").orderBy("block_idx").collect()
    assert [r.block_type for r in got] == ["para", "para", "table_row"]
    assert got[0].block_text.startswith("Text of line a") and got[0].block_text.count("Text of") == 5
    assert got[2].cell_values == ["Cash", "5", "6"] and got[2].box.width == 350.0
    stats = {r.font_size: r for r in layout.style_stats(page_lines).collect()}
    assert stats[10.0].modal_space == 4.0 and stats[10.0].n_lines == 36
    roles = {r.font_size: r.role for r in layout.style_roles(layout.style_stats(page_lines)).collect()}
    assert roles == {10.0: "text", 8.0: "footnote"}


def test_levels_below_headers(spark):
    rows = [(1, 0, "header", "A", 0), (1, 1, "para", "has items:", None), (1, 2, "list_item", "x", None), (1, 3, "list_item", "y", None), (1, 4, "para", "t", None), (1, 5, "list_item", "z", None), (1, 6, "header", "B", 1), (1, 7, "table_row", "r", None)]
    df = spark.createDataFrame(rows, "doc_id int, block_idx int, block_type string, block_text string, level int")
    assert [r.level for r in layout.leaf_levels(df).orderBy("block_idx").collect()] == [0, 1, 2, 2, 1, 1, 1, 2]


def test_reading_order_merges_two_overlapping_columns_only(spark):
    one = [(1, 0, i, 100.0 * i, 0.0, 50.0) for i in range(4)]
    two = [(2, 0, i, t, left, 300.0) for i, (t, left) in enumerate([(0.0, 0.0), (200.0, 0.0), (100.0, 100.0), (300.0, 100.0)])]
    df = spark.createDataFrame(one + two, "doc_id int, page_idx int, block_idx int, top double, left double, width double")
    got = {(r.doc_id, r.block_idx): r.order for r in layout.reading_order(df).collect()}
    assert [got[1, i] for i in range(4)] == [0, 1, 2, 3] and [got[2, i] for i in range(4)] == [0, 2, 1, 3]


def test_titles_and_contents(spark, page_lines):
    big = page_lines.withColumn("font_size", F.when((F.col("page_idx") == 0) & (F.col("line_no") <= 2) & (F.col("line_no") > 0), 20.0).otherwise(F.col("font_size")))
    got = layout.titles(big).first()
    assert got.title.startswith("Text of line a") and got.title.count("Text of") == 2
    rows = [(1, 0, 0, "table_row", "Intro 1", ["Intro", "1"]), (1, 0, 1, "table_row", "Method 2", ["Method", "2"]), (1, 1, 2, "header", "Intro", None), (1, 2, 3, "header", "Method", None), (1, 3, 4, "table_row", "x 5", ["x", "5"])]
    df = spark.createDataFrame(rows, "doc_id int, page_idx int, block_idx int, block_type string, block_text string, cell_values array<string>")
    assert {r.block_idx: r.is_toc for r in layout.table_of_contents(df).collect()} == {0: True, 1: True, 2: False, 3: False, 4: False}


def test_segmentation(spark):
    words = ["executive", "summary", "the", "of", "exec"]
    df = spark.createDataFrame([("e x e c u t i v e s u m m a r y",), ("E X E C U T I V E S U M M A R Y",), (None,)], "t string")
    assert [r[0] for r in df.select(segment.fix_spaced_characters(F.col("t"), words)).collect()] == ["executive summary", "Executive Summary", ""]
    dictionary = spark.createDataFrame([("summary", 5), ("summery", 1), ("other", 9)], "word string, frequency int")
    asked = spark.createDataFrame([("sumary",), ("summry",), ("qqqqqq",), ("other",)], "word string")
    got = {r.word: (r.corrected, r.distance) for r in segment.nearest_words(asked, dictionary).collect()}
    assert got == {"sumary": ("summary", 1), "summry": ("summary", 1), "qqqqqq": ("qqqqqq", None), "other": ("other", 0)}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.style_map(F.lit("top:1px;font-family: A, B; bad;url:http://x")).alias("style"),
        scalars.pixels(F.lit("12.345px")).alias("px"),
        scalars.font_weight(F.lit("Arial-Bold"), F.lit(None).cast("string")).alias("bold"),
        scalars.tokens(F.lit("Tom's 12kg-box, 5% $3 of it")).alias("tokens"),
        scalars.number_type(F.lit("(5,000%")).alias("kind"),
        scalars.discrete_overlap(F.lit(0), F.lit(10), F.lit(5), F.lit(25)).alias("overlap"),
        scalars.spaced_numbers(F.lit("a 1 2 3")).alias("numbers"),
    ).first()
    assert row.style == {"top": "1px", "font-family": "A, B", "url": "http://x"} and row.px == 12.35 and row.bold == 600
    assert row.tokens == ["toms", "box", "of", "it"] and row.kind == "percent" and row.overlap == 0.5 and row.numbers


def test_streaming(spark, sf, tmp_path):
    from blockwright.operators.blocks import clean_lines
    from blockwright.streaming import blocks

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    blocks.write_blocks(blocks.read_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert got.count() == clean_lines(docs).count() and got.exceptAll(clean_lines(docs)).isEmpty()
