"""Secrets in texts, and weak candidates that only count together: multipart credential linking.

Spans of each kind come from two regular-expression functions: the lengths of the matches, and of the segments between
them. Both are exploded, and running sums over a text's matches give their places, so a text of a million matches costs
as many additions. Access identifiers, secrets and endpoints are then interval-joined within a document: a weak
candidate is reported only if parts that complement it begin within SCOPE code points of it. DataFrame functions only.
Spans of one kind never overlap, so a scope holds a bounded number of them and no join grows with a square.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, whole_text

#: Code points between a weak candidate and the parts that complete it.
SCOPE = 400

# The kinds of the contract, in its order, then the weak ones. Runs that must have a length are matched as
# such where that gives the same spans as matching all runs and dropping short ones.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
WEAK = {
    "account": r"""(?i:username|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+""",
    "opaque": r"[A-Za-z0-9/+]{32,}",
    "endpoint": r"""https?://[^\x09-\x0D\x20"'<>]+""",
}
KINDS = [*BASE, *WEAK]
#: What follows the separator of an assign match; six characters at least.
VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
#: Places of the kinds, in the order of the contract.
RANKS = {kind: rank for rank, kind in enumerate(KINDS)}


def steps(text: Column, matches: Column, kind: str) -> Column:
    """For each match: the length of what is between it and the one before (gap), its own (n), and whether it counts (ok)."""
    ok = (lambda m: F.length(F.regexp_replace(m, VALUE, "")) >= 6) if kind == "assign" else (lambda m: F.lit(True))
    gaps = F.transform(F.split(text, (BASE | WEAK)[kind], -1), F.length)
    lengths = F.transform(matches, lambda m: F.struct(F.length(m).alias("n"), ok(m).alias("ok")))
    paired = F.zip_with(lengths, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, gap: F.struct(gap.alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")))
    return F.when(F.size(matches) > 0, paired).otherwise(F.array().cast("array<struct<gap:int,n:int,ok:boolean>>"))


def find_steps(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id and the steps of each kind."""
    texts = docs.select("doc_id", whole_text().alias("text"))
    matched = texts.select("doc_id", "text", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in (BASE | WEAK).items()))
    return matched.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(steps(F.col("text"), F.col(k), k).alias(k) for k in KINDS))


def spans(found: DataFrame) -> DataFrame:
    """row, kind, start and end of each match that counts, in code points: running sums over the steps."""
    some = found.filter(reduce(lambda a, b: a | b, (F.size(k) > 0 for k in KINDS)))
    every = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("steps")) for k in KINDS)))
    each = some.select("row", every.alias("k")).select("row", "k.kind", F.posexplode("k.steps").alias("i", "x"))
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("x.gap") + F.col("x.n")).over(so_far)).filter("x.ok")
    return placed.select("row", "kind", (F.col("end") - F.col("x.n")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that complementary parts stand by: an interval join in blocks of scope code points."""
    parts = parts.withColumn("block", F.floor(F.col("start") / scope))
    weak = parts.filter(F.col("kind").isin(*WEAK)).select("row", "kind", "start", "end", F.explode(F.array(*(F.col("block") + i for i in (-1, 0, 1)))).alias("block"))
    other = parts.select("row", "block", F.col("kind").alias("of"), F.col("start").alias("at"), F.col("end").alias("to"))
    near = weak.join(other, ["row", "block"]).filter(F.abs(F.col("at") - F.col("start")) <= scope)
    apart = (F.col("at") >= F.col("end")) | (F.col("to") <= F.col("start"))
    by = near.groupBy("row", "kind", "start", "end").agg(
        F.max(F.col("of").isin("access", "account") & apart).alias("with_id"),
        F.max(F.col("of").isin("assign", "hex", "opaque") & apart).alias("with_secret"),
        F.max(F.col("of").isin(*BASE) & ~apart).alias("covered"),
    )
    needed = F.when(F.col("kind") == "account", F.col("with_secret")).when(F.col("kind") == "opaque", F.col("with_id")).otherwise(F.col("with_id") & F.col("with_secret"))
    return by.filter(needed & ~F.col("covered")).select("row", "kind", "start", "end")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """A row for each document (doc_id, text): doc_id, base (its spans of the three base kinds), all (those and linked weak ones).

    Spans are structs (start, rank, kind, end), sorted. Null and empty texts have none, null ids stay null; repeated rows
    give repeated rows, each linked within itself; a long text is one row's work; an empty table gives none; other
    columns are not read.
    """
    found = stored(find_steps(docs), "steps")
    parts = stored(spans(found), "spans")
    kept = parts.filter(F.col("kind").isin(*BASE)).unionByName(linked(parts, scope))
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair)), F.col("kind"))
    by_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("all"))
    rows = found.select("row", "doc_id").join(by_row, "row", "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))
    return rows.select("doc_id", every.alias("all")).select("doc_id", F.filter("all", lambda s: s["rank"] < len(BASE)).alias("base"), "all")


def written(found: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
