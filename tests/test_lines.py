"""Line rules and line joining on known cases."""

import pytest
from pyspark.sql import functions as F

from blockwright.functions.strings import fix_mixed_case
from blockwright.operators import blocks, features, lines

# Example lines and what they are.
TRUE = {
    "incomplete_line": [
        "This is a incomplete line,",
        "Upon the closing of the transactions contemplated by the Transaction Agreement, Leslie H.",
        "Cushman & Wakefield Equity, Debt & Structured Finance has been exclusively retained by affiliates of Amstar and Wildflower Ltd.",
        "Our executive offices are located at 601 N.w.",
        "Our executive name is XYZ Inc.",
    ],
    "ends_with_abbreviation": ["Our executive offices are located at 601 N.w.", "Our executive name is XYZ Inc."],
    "integer_numbered_line": ["10.12 Testing", "1.3.4 is a numbered line", "44.44 is a numbered line"],
    "roman_numbered_line": ["i. Testing", "iv) Testing", "(iv) Testing"],
    "numbered_line": ["i. Testing", "a. Testing", "10.b Testing"],
    "letter_numbered_line": ["S1", "(A) This is good", "A. Notwithstanding the foregoing"],
    "continuing_line": ["or completeness of this memorandum or any of its contents, and no legal commitments", "& Parson and Sons"],
    "has_spaced_characters": ["E x e c u t i v e Summary", "D n B"],
    "is_table_row": [
        "Net Debt (685,365,480)$ (685,145,818)$ (683,596,099)$",
        "Less: Sales Costs (4.14%) ($2,795,402) ($2,836,463)",
        "Construction Loan - Mezz 20% $20,000,000",
        "Net Site Area 2.08 Acres",
        "Executive Summary 1",
        "Elliott Bay Office PARK 1980 225,615 $390,000 $60,500,000 $38,333,333",
        "0.0 1.0 2.0 3.0 4.0 5.0 6.0 7.0",
        "Less: Credit Loss / Vacancy Allowance -$2.30 -$1,440,000",
        "GAV Developed (US only): $1.1bn",
        "NYC LPC Approval Feb-17",
        "NYC LPC Approval February-17-2019",
        "NYC LPC Approval 02/17/19",
        "Free Rent Concessions (665,908) - - - -",
        "30,000 square feet ................. 28 weeks",
    ],
    "is_header": [
        "This is a Header",
        "% PER KEY",
        "Sources Amount per GSF per ZFA per NSF % of Total",
        "Section 1: Executive Summary JLL",
        "VI. DEVELOPMENT TEAM",
        "4. 400 WESTLAKE PROJECT",
        "13. Audit Rights",
        "DEVELOPMENT O V E R V I E W",
        "Sales Report for February-2019",
        "Section 2.08. Cancellation of Notes Paid, Converted, Etc.",
        "Section 5.01 Lists of Holders.",
        "Securities Exchange Act of 1934",
    ],
    "is_zipcode_or_po": ["P.o. Box 81226", "Seattle, WA 98108-1226", "New York, New York 10166", "Green Bay, WI 54303"],
}
# Example lines and what they are not.
FALSE = {
    "incomplete_line": ["Apple Computers has reported the best quarter ever.", "Apple Revenue.", "Apple Revenue: 2,000 3,000"],
    "numbered_line": ["i do", "$0.7656 per share (the “Per Share Purchase Price”)."],
    "integer_numbered_line": ["Testing", "441.44 is NOT a numbered line", "1972 is NOT a numbered line"],
    "letter_numbered_line": ["a cow is eating grass", "(MM)", "I enjoy coding", "L Beam company is making a new device"],
    "ends_with_period": ["I am a disco dancer", "I am a disco dancer Mr."],
    "is_table_row": ["in October 2023", "Manhattan.", "Hey there you owe me $20.00", "line 3", "5. MARKET OVERVIEW", "November 2019", "Sales Report for February"],
    "is_header": [
        "A Header this is Not,",
        "Sunset from",
        "Stars: Don’t we know all there is to know?",
        "• CONCRETE CAST-IN-PLACE (SEE STRUC. DWGS)",
        "Estreich & Company Page 35",
        "Manhattan.",
        "10.1% Yield debt",
        "NYC LPC Approval 02/17",
        "Section 10.04, Section 13.02 and Section 14.03.",
        "Section 2.08. refers to the cancellation of notes paid.",
        "Seattle, Washington 98109-5210",
    ],
    "is_zipcode_or_po": ["of 101 North Phillips Avenue, Sioux Falls, SD 57104"],
}
# Example lines and their parts.
EQUAL = [
    ("10. MY TESTING", "title_word_count", 2),
    ("I am a Disco Dancer", "stop_word_count", 3),
    ("I am a Disco Dancer", "eff_word_count", 2),
    ("I am a disco dancer", "word_count", 5),
    ("Manhattan.", "number_count", 0),
    ("10.12 Testing", "start_number", "10.12"),
    ("iv) Testing", "start_number", "iv"),
    ("3.15 Vacancies", "line_type", "header"),
    ("½", "line_type", "table_row"),
    ("", "line_type", None),
    (None, "word_count", 0),
    ("Davis Polk & Wardwell LLP", "noun_chunks", ["Davis Polk & Wardwell LLP"]),
    ("I used to work for Morgan Stanley's New York office", "noun_chunks", ["Morgan Stanley", "New York"]),
    ('Stock symbol of Morgan Stanley is "MS"', "noun_chunks", ["MS", "Morgan Stanley", "Stock"]),
    ("Skadden, Arps, Slate, Meagher & Flom LLP", "noun_chunks", ["Skadden Arps Slate Meagher & Flom LLP"]),
    ("There are 25 florrs in 150 Broadway and they are all oversold", "noun_chunks", ["150 Broadway"]),
    ("Series Seed 1 Preferred Stock, par value $0.00001 per share", "noun_chunks", ["Series Seed 1 Preferred Stock"]),
    ('This company ("DataCo") is refered as DataCo', "quoted_words", ["DataCo"]),
    ("Delta Airline 'DAL' went up 7.5% today \"Nov.4\"", "quoted_words", ["DAL", "Nov.4"]),
]


@pytest.fixture(scope="module")
def found(spark):
    texts = {t for group in (*TRUE.values(), *FALSE.values()) for t in group} | {t for t, _, _ in EQUAL}
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    return {r.line: r for r in features.with_features(df, chunks=True).collect()}


def test_flags(found):
    assert [(k, t) for k, group in TRUE.items() for t in group if not found[t][k]] == []
    assert [(k, t) for k, group in FALSE.items() for t in group if found[t][k]] == []


def test_values(found):
    assert [(t, k, found[t][k]) for t, k, v in EQUAL if found[t][k] != v] == []


# Example lines and the blocks that they make.
JOINED = [
    (["Times Square Theater, located at 215 West 42nd Street", '(the "PROPERTY").'], 1),
    (["(a) a “person” or", "“group” within the meaning of Section 13(d) of the Exchange Act, other than the Company, its Subsidiaries"], 1),
    (["awards and citations for design excellence, including", "Royal Institute of British Architects (RIBA), Royal Fine", "Art Commission (RFAC) and American Institute of"], 1),
    (["Sources Amount per GSF per ZFA per NSF % of Total", "Construction Loan $43,387,000 $632 $886 $868 66.8%"], 2),
    (["line one ", "line 2"], 1),
    (["line one.", "line 2"], 1),
    (["Name Value", "Ambika 20"], 2),
    (["PROJECT OVERVIEW", "This project started out really well."], 2),
    (["NOI $690,922 $1,081,379 $1,334,083", "Detailed Breakdown is located on pages 13-17."], 2),
    (["TOTAL SOURCES $120,000,000 100.00% $370,370", "% PER KEY", "Hard Costs 60,750,000 50.63% $187,500", "Contingencies & Developer Fee 7,000,000 5.83% $21,605"], 4),
    (["continued demand for this type of con-", "dominium product in ", "Manhattan."], 1),
    (["Page 1 of the book", "Page 2 of the book", "ab", ""], 1),
]


def test_blocks(spark):
    docs = spark.createDataFrame([(i, "\n".join(ls)) for i, (ls, _) in enumerate(JOINED)] + [(900, None), (901, "")], "doc_id int, text string")
    got = blocks.clean_lines(docs).orderBy("doc_id", "block_idx").collect()
    by = {i: [r.block_text for r in got if r.doc_id == i] for i in range(len(JOINED))}
    assert {i: len(v) for i, v in by.items()} == {i: n for i, (_, n) in enumerate(JOINED)}
    assert by[4] == ["line one line 2"] and by[10] == ["continued demand for this type of condominium product in Manhattan."]
    assert by[11] == ["Page 1 of the book"]
    assert not [r for r in got if r.doc_id >= 900]


def test_join_windows_solve_the_recurrence(spark):
    import random

    rng = random.Random(1)
    rows, want = [], []
    for doc in range(60):
        joined, block, before = False, -1, None
        for n in range(rng.randint(1, 30)):
            row = (doc, n, "t", rng.choice(["para", "list_item", "header", "table_row"]), *(rng.random() < 0.4 for _ in range(4)))
            rows.append(row)
            incomplete, continuing, period, listed = row[4:]
            free = not (listed or row[3] == "list_item")
            joined = before is not None and (continuing or (((before[0]) or (joined and not before[1])) and free))
            block += not joined
            want.append((doc, block))
            before = (incomplete, period)
    df = spark.createDataFrame(rows, "doc_id int, line_no int, text string, line_type string, incomplete_line boolean, continuing_line boolean, ends_with_period boolean, is_list_or_row boolean")
    got = blocks.join_lines(df).collect()
    assert sorted((r.doc_id, r.block_idx) for r in got) == sorted(set(want))
    assert {(r.doc_id, r.block_idx): r.block_text.count("t") for r in got} == {k: want.count(k) for k in set(want)}


def test_both_ways_of_keeping_lines_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = lines.kept_lines(lines.split_lines(docs)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x")).select("doc_id", F.col("x.line").alias("x"))
    b = lines.kept_in_order(docs).filter(F.size("lines") > 0).withColumnRenamed("lines", "x")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("word,want", [("L.P.", "L.P."), ("GoAT", "Goat"), ("Hello", "Hello"), ("HEllo", "HELLO"), ("heLLo", "hello")])
def test_mixed_case(spark, word, want):
    assert spark.range(1).select(fix_mixed_case(F.lit(word))).first()[0] == want


def test_level_chain_is_that_of_a_stack(spark):
    import random

    rng = random.Random(2)
    rows, want = [], {}
    for doc in range(40):
        stack = []
        for i in range(rng.randint(1, 25)):
            kind, level = rng.choice(["header", "para"]), rng.randint(0, 3)
            rows.append((doc, i, kind, f"t{i}", level))
            if kind == "header":
                stack = [s for s in stack if s[1] < level]
                want[doc, i] = [s[0] for s in reversed(stack)]
                stack.append((i, level))
            else:
                want[doc, i] = [s[0] for s in reversed(stack)]
    df = spark.createDataFrame(rows, "doc_id int, block_idx int, block_type string, block_text string, level int")
    got = blocks.level_chain(df).collect()
    assert {(r.doc_id, r.block_idx): [c.block_idx for c in r.level_chain] for r in got} == want
