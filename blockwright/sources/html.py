"""HTML pages to blocks: a tokenizer gives the nodes that make blocks, columns give their kinds, a fold their levels."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stacks import chains
from ..functions.strings import UPPER
from ..operators.features import line_features

HEADERS = ("h1", "h2", "h3", "h4", "h5", "h6")
PARAGRAPHS = ("p", "span")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What the begin of an element closes, if nothing of BARRIER is open in between.
CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")} | {k: ("p",) for k in (*HEADERS, "ul", "ol", "div", "table", "article", "section", "footer", "header", "nav", "blockquote", "pre", "form")}
BARRIER = {"li": ("ul", "ol"), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
#: A cell: its text, span and whether it is a th or holds a b.
NODE = "ord int, tag string, depth int, first string, bold boolean, text string, rows array<array<struct<text:string,span:int,head:boolean,spanned:boolean>>>"


class _Cell:
    def __init__(self, head: bool, span: str | None):
        self.text, self.head, self.spanned = [], head, bool(span)
        self.span = int(span) if span and span.isdigit() else 1


class Nodes(HTMLParser):
    """The outermost headers, paragraphs, list items and tables of a page's body, in the order of their begin."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.node: dict | None = None
        self.found: list[dict] = []
        self.rows: list[tuple[int, list[_Cell]]] = []  # open rows and the depth at which they began
        self.cells: list[tuple[int, _Cell]] = []

    def _leave(self, depth: int) -> None:
        del self.open[depth:]
        self.rows = [r for r in self.rows if r[0] < depth]
        self.cells = [c for c in self.cells if c[0] < depth]
        if self.node and self.node["depth"] >= depth:
            self.found.append(self.node)
            self.node = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] in BARRIER.get(tag, ()):
                break
            if self.open[k] in CLOSES.get(tag, ()):
                self._leave(k)
                break
        depth = len(self.open)
        if self.node is None and tag in (*HEADERS, *PARAGRAPHS, "li", "table"):
            style = (dict(attrs).get("style") or "").replace(" ", "").lower()
            self.node = {"tag": tag, "depth": depth, "first": None, "text": [], "rows": [], "bold": "font-weight:bold" in style}
        elif self.node is not None:
            self.node["first"] = self.node["first"] or tag
            if self.node["tag"] == "table":
                if tag == "tr":
                    cells: list[_Cell] = []
                    self.node["rows"].append(cells)
                    self.rows.append((depth, cells))
                elif tag in ("td", "th"):
                    cell = _Cell(tag == "th", dict(attrs).get("colspan"))
                    for _, cells in self.rows:
                        cells.append(cell)
                    self.cells.append((depth, cell))
                elif tag == "b":
                    for _, cell in self.cells:
                        cell.head = True
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self._leave(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data: str) -> None:
        if self.node is not None and "head" not in self.open:
            self.node["text"].append(data)
            for _, cell in self.cells:
                cell.text.append(data)

    def nodes(self, page: str) -> list[dict]:
        self.feed(page)
        self.close()
        self._leave(0)
        out = []
        for node in self.found:
            text = "".join(node["text"])
            if text.strip():
                rows = [[{"text": "".join(c.text).replace("\xa0", "").strip(), "span": c.span, "head": c.head, "spanned": c.spanned} for c in row] for row in node["rows"]]
                out.append({"ord": len(out), "tag": node["tag"], "depth": node["depth"], "first": node["first"], "bold": node["bold"], "text": text, "rows": rows})
        return out


def html_nodes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key and ord, tag, depth, first (the first tag inside), bold (by its style), text and rows of each node with text; a page without any gives none."""
    kind = pages.schema[key].dataType.simpleString()
    fields = [f.split(" ", 1) for f in NODE.split(", ")]
    cell = pa.struct([("text", pa.string()), ("span", pa.int32()), ("head", pa.bool_()), ("spanned", pa.bool_())])
    types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.list_(cell))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, nodes = [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                for node in Nodes().nodes(page or ""):
                    owners.append(i)
                    nodes.append(node)
            columns = [pa.array([n[f] for n in nodes], t) for (f, _), t in zip(fields, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int32())), *columns], names=[key, *(f for f, _ in fields)])

    return pages.select(key, "html").mapInArrow(run, f"{key} {kind}, {NODE}")


def table_rows(rows: Column) -> Column:
    """The rows of a table that have text, without columns that are empty in every row: cell_values, col_spans, is_header_group, is_header."""
    texts = F.transform(rows, lambda r: F.transform(r, lambda c: c["text"]))
    blank = F.transform(texts, lambda r: F.transform(F.filter(F.transform(r, lambda x, i: F.when(x == "", i).otherwise(-1)), lambda i: i >= 0), lambda i: i.cast("int")))
    empty = F.aggregate(F.slice(blank, 2, F.greatest(F.size(blank) - 1, F.lit(0))), F.coalesce(F.get(blank, 0), F.array().cast("array<int>")), lambda a, b: F.array_intersect(a, b))
    keep = lambda cells, of: F.transform(F.filter(F.transform(cells, lambda c, i: F.struct(i.alias("i"), of(c).alias("v"))), lambda s: ~F.array_contains(empty, s["i"])), lambda s: s["v"])
    some = F.filter(rows, lambda r: F.exists(r, lambda c: c["text"] != ""))
    return F.transform(
        some,
        lambda r: F.struct(
            keep(r, lambda c: c["text"]).alias("cell_values"),
            keep(r, lambda c: c["span"]).alias("col_spans"),
            F.exists(r, lambda c: c["spanned"]).alias("is_header_group"),
            F.forall(r, lambda c: c["head"] | (c["text"] == "")).alias("is_header"),
            F.array_join(F.transform(r, lambda c: c["text"]), " ").alias("block_text"),
        ),
    )


def html_blocks(pages: DataFrame, key: str = "page_id", filing: bool = False) -> DataFrame:
    """key, block_idx, block_type, block_text, level, header_text, level_chain and the table columns of each block of each page.

    A table of several rows gives a table_row for each that has text, with is_table_start and is_table_end; one of a
    single row gives a paragraph or list item. A filing has no header tags: its bold paragraphs that read as headers are
    h3, in capitals h2; its tables are rows even if they have one, and cells' texts are joined without spaces.
    """
    nodes = html_nodes(pages, key).withColumn("n_rows", F.size("rows")).withColumn("rows", table_rows(F.col("rows")))
    judged = line_features(nodes.select(key, "ord", "tag", "first", "bold", F.col("text").alias("raw"), "rows", "n_rows"), "raw")
    if filing:
        heading = F.col("tag").isin(*PARAGRAPHS) & F.col("bold") & F.col("is_header")
        judged = judged.withColumn("tag", F.when(heading & F.col("raw").rlike(UPPER), "h2").when(heading, "h3").otherwise(F.col("tag")))
        judged = judged.withColumn("rows", F.transform("rows", lambda r: r.withField("block_text", F.array_join(r["cell_values"], ""))))
    rank = F.when(F.col("tag").isin(*HEADERS), F.substring("tag", 2, 1).cast("int")).otherwise(0)
    para_header = (F.col("tag") == "p") & F.col("first").isNotNull() & F.col("is_header")
    stack_key = F.when(rank > 0, F.col("tag")).when(para_header, F.concat(F.lit("p_"), "first"))
    flat = judged.select(key, "ord", "tag", "raw", "rows", "n_rows", "is_list_item", rank.alias("rank"), stack_key.alias("key"))
    by_page = flat.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "rank", "key", F.col("raw").alias("text"), "tag", "rows", "n_rows", "is_list_item"))).alias("nodes"))
    headed = F.transform("nodes", lambda n: F.struct(n["key"].alias("key"), n["rank"].alias("rank"), F.when(n["key"].isNotNull(), n["text"]).alias("text")))
    found = by_page.withColumn("at", chains(headed))
    leveled = found.select(key, F.explode(F.arrays_zip("nodes", "at")).alias("x"))
    c = F.col
    single = (c("x.nodes.tag") == "table") & (c("x.nodes.n_rows") <= (0 if filing else 1))
    kind = F.when(c("x.nodes.key").isNotNull(), "header").when((c("x.nodes.tag") == "li") | (single & c("x.nodes.is_list_item")), "list_item").when((c("x.nodes.tag") == "table") & ~single, "table_row").otherwise("para")
    none = F.struct(F.array().cast("array<string>").alias("cell_values"), F.array().cast("array<int>").alias("col_spans"), F.lit(False).alias("is_header_group"), F.lit(False).alias("is_header"), c("x.nodes.text").alias("block_text"))
    parts = F.when(c("x.nodes.tag") == "table", c("x.nodes.rows")).otherwise(F.array(none))
    rows = leveled.select(key, c("x.nodes.ord").alias("ord"), c("x.at.*"), kind.alias("block_type"), F.size(parts).alias("of"), F.posexplode(parts).alias("part", "p"))
    table = c("block_type") == "table_row"
    order = F.row_number().over(_page_order(key)) - 1
    return rows.select(
        key,
        order.cast("int").alias("block_idx"),
        "block_type",
        c("p.block_text").alias("block_text"),
        "level",
        "header_text",
        "level_chain",
        F.when(table, c("p.cell_values")).alias("cell_values"),
        F.when(table, c("p.col_spans")).alias("col_spans"),
        (table & c("p.is_header_group")).alias("is_header_group"),
        (table & c("p.is_header")).alias("is_header"),
        (table & (c("part") == 0)).alias("is_table_start"),
        (table & (c("part") == c("of") - 1)).alias("is_table_end"),
    )


def _page_order(key: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(key).orderBy("ord", "part")
