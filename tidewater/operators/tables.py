"""Number grids of text tables, and checks that their rows add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rows of a results table that its checks need, by what a line begins with after its number.
RESULT_ROWS = [
    ("revenue", r"(?:revenue\s+from\s+operations|income\s+from\s+operations|net\s+sales)"),
    ("other", r"other\s+income"),
    ("total_income", r"total\s+income"),
    ("pbt", r"profit\s*(?:/\s*\(?loss\)?)?\s*before\s+tax"),
    ("tax", r"(?:total\s+tax\s+expense|tax\s+expenses?\b(?!\s*[:/(]?\s*(?:\(?credit|:)))"),
    ("pat", r"(?:net\s+)?profit\s*(?:/\s*\(?loss\)?)?\s*(?:after\s+tax|for\s+the\s+(?:period|quarter|year))"),
]
NUMBERED = r"(?i)^\W*(?:[IVX\d]+\W+)?"
AMOUNT = r"\(\s*\d[\d,]*(?:\.\d+)?\s*\)|(?<![\w.])-?\d[\d,]*(?:\.\d+)?(?![\w])"
FORMULA = r"\([^()]*[+\-–−][^()]*\)"

#: Lines back that a check looks for its rows, and what a sum may be off by: an amount, or a share of the total.
INCOME_BACK, TAX_BACK, LEAST_OFF, SHARE_OFF = 8, 40, 0.015, 0.002


def amounts(text: Column) -> Column:
    """The amounts of a row after its label, in order; in brackets or after a minus they are negative, and a formula in brackets, as (1+2), is none."""
    found = F.regexp_extract_all(F.regexp_replace(text, FORMULA, " "), F.lit(f"({AMOUNT})"), F.lit(1))
    size = lambda x: F.regexp_replace(x, r"[^\d.]", "").try_cast("double")
    return F.transform(found, lambda x: F.when(x.startswith("(") | x.startswith("-"), -size(x)).otherwise(size(x)))


def table_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line, text) of the lines that are not blank, numbered from 0."""
    lines = F.filter(F.split(F.col(text), r"\r?\n"), lambda x: F.trim(x) != "")
    return docs.select(F.col(doc), F.posexplode(lines).alias("line", "text"))


def number_grid(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line, label, column, amount): the amounts of each line that has a label of letters before them, by column from 0."""
    lines = table_lines(docs, doc, text)
    label = F.regexp_extract("text", r"^(.*?[A-Za-z].*?)(?=\s*(?:" + AMOUNT + r"|$))", 1)
    rest = F.expr("substring(text, length(label) + 1)")
    return lines.withColumn("label", label).where("label <> ''").select(doc, "line", F.trim("label").alias("label"), F.posexplode(amounts(rest)).alias("column", "amount"))


def result_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line, kind, amount): the lines of ``RESULT_ROWS``, the first kind that a line fits and has an amount for, with its first amount after the label."""
    rows = table_lines(docs, doc, text)
    fits = [(kind, F.regexp_extract("text", f"({NUMBERED}{pattern})", 1)) for kind, pattern in RESULT_ROWS]
    options = F.array(*(F.struct(F.lit(kind).alias("kind"), F.when(head != "", F.get(amounts(F.substring("text", F.length(head) + 1, F.length("text"))), F.lit(0))).alias("amount")) for kind, head in fits))
    return rows.withColumn("hit", F.get(F.filter(options, lambda x: x["amount"].isNotNull()), F.lit(0))).where("hit is not null").select(doc, "line", "hit.kind", "hit.amount")


def table_arithmetic(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line, rule, total, parts, holds): each check of a results table that has all rows it needs.

    ``income``: revenue and other income, each the last of its kind within 8 lines, make the total income.
    ``profit``: profit before tax less the tax after it, within 40 lines, is the profit. A check holds up
    to 0.015 or 0.2 % of the total. Rows that lack a part are no check, and nothing is corrected. The last
    row of a kind comes from running windows of a document's own lines.
    """
    rows = result_rows(docs, doc, text)
    before = Window.partitionBy(doc).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("kind") == k, F.struct("line", "amount")), ignorenulls=True).over(before) for k in ("revenue", "other", "pbt", "tax")}
    seen = rows.withColumns({f"last_{k}": c for k, c in last.items()})
    near = lambda k, back: (F.col("line") - F.col(f"last_{k}.line")) <= back
    income = (F.col("kind") == "total_income") & near("revenue", INCOME_BACK) & near("other", INCOME_BACK)
    profit = (F.col("kind") == "pat") & near("pbt", TAX_BACK) & near("tax", TAX_BACK) & (F.col("last_tax.line") > F.col("last_pbt.line"))
    parts = F.when(income, F.col("last_revenue.amount") + F.col("last_other.amount")).when(profit, F.col("last_pbt.amount") - F.col("last_tax.amount"))
    checks = seen.withColumn("parts", parts).where("parts is not null")
    off = F.abs(F.col("parts") - F.col("amount"))
    return checks.select(doc, "line", F.when(F.col("kind") == "pat", "profit").otherwise("income").alias("rule"), F.col("amount").alias("total"), F.round("parts", 6).alias("parts"), (off <= F.greatest(F.lit(LEAST_OFF), SHARE_OFF * F.abs("amount"))).alias("holds"))


def adding_rows(grid: DataFrame, doc: str, least: int = 2, digits: int = 2) -> DataFrame:
    """(doc, column, line, first_line, rows): which runs of at least ``least`` rows right above a row add up to it.

    With prefix sums P over a column, the rows from j to the one above line i add up to v_i where P before j
    is P above i less v_i: rows meet their own earlier sums by equality (to ``digits`` decimals), so that no
    pairs of rows are tried. Of several runs the shortest counts. Zero is no total.
    """
    turn = Window.partitionBy(doc, "column").orderBy("line")
    summed = grid.withColumns({"place": F.row_number().over(turn), "upto": F.round(F.coalesce(F.sum("amount").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), digits)})
    cents = lambda c: F.round(c * 10**digits, 0).cast("long")
    wanted = summed.where("amount <> 0").select(doc, "column", "line", F.col("place").alias("at"), cents(F.col("upto") - F.col("amount")).alias("cents"))
    starts = summed.select(doc, "column", F.col("line").alias("first_line"), F.col("place").alias("from"), cents(F.col("upto")).alias("cents"))
    found = wanted.join(starts, [doc, "column", "cents"]).where(F.col("at") - F.col("from") >= least)
    return found.groupBy(doc, "column", "line").agg(F.max_by("first_line", "from").alias("first_line"), F.max_by(F.col("at") - F.col("from"), "from").alias("rows"))
