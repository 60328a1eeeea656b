"""Cleaning of filed trades: sides, roles, cut names, group membership, scheme holdings, and counts of what was flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Word stems that tell a side or a pledge, words that make another person of a name, and the words of units with what they multiply by.
BUY_STEMS = ["buy", "acqui", "purchase"]
SELL_STEMS = ["sell", "dispos", "sale"]
PLEDGE_STEMS = ["pledge", "revok", "invoc", "invok"]
TRADE_STEMS = ["buy", "sell", "purchase", "sale"]
OTHER_PERSON = ["huf", "trust", "family", "foundation", "estate", "minor"]
CORPORATE = ["private", "limited", "llp", "company", "corporation", "holding", "holdings", "investment", "investments", "ventures", "enterprises", "capital", "fund", "industries", "associates", "partners", "finance", "securities", "international", "inc"]
UNITS = {"thousand": 1e3, "lakh": 1e5, "lac": 1e5, "crore": 1e7, "cr": 1e7, "million": 1e6, "mn": 1e6, "billion": 1e9, "bn": 1e9}


def side_word(text: Column) -> Column:
    """BUY or SELL by the stems in the text, BUY where it has both; null where it has neither, or speaks of a pledge and of no trade."""
    plain = F.lower(text)
    buys, sells, pledges, trades = (plain.rlike("|".join(stems)) for stems in (BUY_STEMS, SELL_STEMS, PLEDGE_STEMS, TRADE_STEMS))
    return F.when(pledges & ~trades, F.lit(None)).when(buys, "BUY").when(sells, "SELL")


def side_of(kind: Column, mode: Column) -> Column:
    """The side of a trade: its type decides, and its mode only where the type says nothing."""
    return F.coalesce(side_word(kind), side_word(mode))


def filled_roles(df: DataFrame, keys: list[str], role: str, missing: str = "missing") -> DataFrame:
    """Every row with its role, a missing one taken from the most frequent known role of its keys, and ``role_source``.

    Of equally frequent roles the first in code-point order counts. Null keys are never filled.
    """
    known = df.where(F.col(role) != missing).groupBy(*keys, F.col(role).alias("known_role")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "known_role"))
    best = known.withColumn("place", place).where("place = 1").drop("n", "place")
    joined = df.join(best, keys, "left")
    lacks = F.coalesce(F.col(role), F.lit(missing)) == missing
    source = F.when(~lacks, "filing").when(F.col("known_role").isNotNull(), "other_filing").otherwise("missing")
    return joined.withColumns({"role_source": source, role: F.when(lacks, F.coalesce("known_role", F.lit(missing))).otherwise(F.col(role))}).drop("known_role")


def merged_cut_names(df: DataFrame, security: str, person: str, raw: str, least: int = 15, cut_at: tuple[int, int] = (26, 32)) -> DataFrame:
    """Every row with ``merged``: the one longer key of its security that its own key begins, if that is the same name cut short.

    A key cut inside a word is; at a word's end only where a raw spelling is about as long as names are cut
    (``cut_at``) and the words cut off make no other person. Each longer key's prefixes meet the shorter
    keys by equality. Chains end at the longest key that they reach in one step. The joins are merges at any
    size: names are packed so well in files that Spark takes very many for few, and would send them through
    the driver.
    """
    names = df.where(f"{security} is not null and {person} is not null").groupBy(security, person).agg(F.max(F.length(F.trim(raw))).alias("raw_len"))
    prefixes = names.select(security, F.col(person).alias("long"), F.explode(F.expr(f"transform(sequence({least}, greatest({least}, length({person}) - 1)), k -> substring({person}, 1, k))")).alias("short")).where(F.length("long") > F.length("short"))
    hits = names.withColumnRenamed(person, "short").hint("merge").join(prefixes, [security, "short"])
    one = hits.groupBy(security, "short", "raw_len").agg(F.count("*").alias("n"), F.min("long").alias("long")).where("n = 1")
    rest = F.expr("substring(long, length(short) + 1)")
    added = F.split(F.substring(rest, 2, 10_000), "-")
    words = lambda w: F.array(*[F.lit(x) for x in w])
    at_end = F.col("raw_len").between(*cut_at) & ~F.arrays_overlap(added, words(OTHER_PERSON)) & (~F.arrays_overlap(added, words(CORPORATE)) | F.arrays_overlap(F.split("short", "-"), words(CORPORATE)))
    same = one.where(~rest.startswith("-") | at_end).select(security, F.col("short").alias(person), F.col("long").alias("merged"))
    return df.join(same.hint("merge"), [security, person], "left").withColumn("merged", F.coalesce("merged", person))


def latest_lists(members: DataFrame, company: str, quarter: str) -> DataFrame:
    """The member rows of each company's latest quarter; rows without a company link nothing."""
    placed = members.where(F.col(company).isNotNull())
    return placed.withColumn("latest", F.max(quarter).over(Window.partitionBy(company))).where(F.col(quarter) == F.col("latest")).drop("latest")


def group_members(trades: DataFrame, lists: DataFrame, company: str, person: str, alternative: str | None = None) -> DataFrame:
    """Every trade with ``group_id`` and ``group_key`` where its person is on the company's list: by name, else by the alternative name.

    ``lists``: (company, member, member_alt). A person who stands there twice links once.
    """
    exact = lists.select(company, F.col("member").alias(person)).distinct().withColumn("by_name", F.lit(True))
    out = trades.join(exact, [company, person], "left")
    other = F.lit(None).cast("boolean")
    if alternative is not None:
        names = lists.select(company, F.explode(F.array_compact(F.array("member", "member_alt"))).alias("alt_name")).distinct().withColumn("by_alt", F.lit(True))
        out = out.join(names.withColumnsRenamed({company: "alt_company"}), (F.col(company) == F.col("alt_company")) & (F.col(alternative) == F.col("alt_name")), "left").drop("alt_company", "alt_name")
        other = F.col("by_alt")
    key = F.when(F.col("by_name"), "name").when(other, "alternative")
    return out.withColumns({"group_key": key, "group_id": F.when(key.isNotNull(), F.concat(F.lit("group:"), F.col(company).cast("string")))}).drop("by_name", "by_alt")


def scheme_changes(now: DataFrame, before: DataFrame, factors: DataFrame, keys: list[str], security: str, shares: str) -> DataFrame:
    """Full comparison of schemes' holdings, the earlier shares on today's basis, with status and where the scheme was seen.

    ``keys``: house and scheme, house first. Only houses of both months are compared. ``factors``: (security, factor).
    """
    house = keys[0]
    both = now.select(house).distinct().join(before.select(house).distinct(), house)
    a = before.join(both, house, "left_semi").groupBy(*keys, security).agg(F.sum(shares).alias("start"))
    b = now.join(both, house, "left_semi").groupBy(*keys, security).agg(F.sum(shares).alias("end"))
    one = factors.groupBy(security).agg(F.min("factor").alias("factor"))
    m = a.join(b, [*keys, security], "full").join(one, security, "left").withColumns({"start": F.coalesce("start", F.lit(0.0)) * F.coalesce("factor", F.lit(1.0)), "end": F.coalesce("end", F.lit(0.0))}).drop("factor")
    seen = b.select(*keys).distinct().withColumn("now_seen", F.lit(1)).join(a.select(*keys).distinct().withColumn("before_seen", F.lit(1)), keys, "full")
    status = F.when((F.col("start") == 0) & (F.col("end") > 0), "new").when((F.col("start") > 0) & (F.col("end") == 0), "exit").when((F.col("start") > 0) & (F.col("end") > F.col("start")), "added").when((F.col("end") > 0) & (F.col("end") < F.col("start")), "cut").otherwise("held")
    where = F.when(F.col("now_seen").isNull(), "start_only").when(F.col("before_seen").isNull(), "end_only").otherwise("both")
    return m.join(seen, keys).select(*keys, security, "start", "end", (F.col("end") - F.col("start")).alias("change"), status.alias("status"), where.alias("scheme_seen"))


def scheme_totals(changes: DataFrame, prices: DataFrame, keys: list[str], security: str) -> DataFrame:
    """Per scheme: net, bought and sold value at the month's price, and counts of lines; changes without a price count as ``unvalued``."""
    v = F.col("change") * F.col("price")
    out = changes.join(prices.select(security, "price"), security, "left")
    return out.groupBy(*keys).agg(
        F.round(F.sum(v), 2).alias("net"), F.round(F.sum(F.greatest(v, F.lit(0.0))), 2).alias("bought"), F.round(F.sum(F.least(v, F.lit(0.0))), 2).alias("sold"),
        F.count_if(F.col("change") > 0).alias("adding"), F.count_if(F.col("change") < 0).alias("cutting"), F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "exit").alias("exits"),
        F.count_if(F.col("end") > 0).alias("holdings"), F.count_if(v.isNull() & (F.col("change") != 0)).alias("unvalued"),
    )


def flag_counts(df: DataFrame, flags: str) -> DataFrame:
    """(flag, n) over lists of flags."""
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def unrecognised(df: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(field, value, n): values that a field's known words lack; nulls and empty ones do not count."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), (~F.col(c).cast("string").isin(known)).alias("odd")) for c, known in fields.items()])).alias("x")).select("x.*")
    return cells.where(F.col("odd") & (F.length("value") > 0)).groupBy("field", "value").agg(F.count("*").alias("n"))


def unit_word(text: Column) -> Column:
    """A unit's word in lower case, without a plural's s or a closing dot."""
    return F.regexp_replace(F.lower(F.trim(text)), r"s?\.?$", "")


def unit_multiplier(unit: Column) -> Column:
    """What a unit's word multiplies by; rupees, an unknown word or null: 1."""
    out = F.lit(1.0)
    for word, by in UNITS.items():
        out = F.when(unit_word(unit) == word, F.lit(by)).otherwise(out)
    return out


def unit_backed(value: Column, unit: Column, quote: Column, kind: Column | str = "exact") -> Column:
    """Whether a number's unit is backed by its quote.

    Without a unit to back: null, or false where a unit's word follows that number in the quote (the unit
    was left out). With one: false where the number is written in full (seven digits or more before the
    point); in a quote of ``kind`` other than exact, which keeps its unit in a heading, true; else that the
    unit's own word follows the number, or stands right before it as the only unit of the quote. A null
    value is not backed; a null quote has no words.
    """
    by = unit_multiplier(unit)
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = F.lower(F.coalesce(quote, F.lit("")))
    words = "|".join(sorted(UNITS, key=len, reverse=True))
    figure = r"[0-9][0-9,]*(?:\.[0-9]+)?"

    def near(pattern: str) -> Column:
        """Arrays (number, multiplier of the word beside it) of the places where both stand."""
        spots = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
        return F.transform(spots, lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, figure, 0), ",", "").try_cast("double").alias("number"), unit_multiplier(F.regexp_extract(x, rf"(?:{words})", 0)).alias("by")))

    follows = near(rf"{figure}\s*(?:{words})(?:s|\.)*(?![a-z])")
    leads = near(rf"(?<![a-z])(?:{words})(?:s|\.)*(?![a-z])[^\w]*{figure}")
    is_it = lambda x: F.abs(x["number"] - F.abs(value)) < 1e-6 * F.greatest(F.lit(1.0), F.abs(value))
    named = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?<![a-z])({words})s?\.?(?![a-z])"), F.lit(1)), unit_multiplier))
    only = (F.size(named) == 1) & (F.get(named, F.lit(0)) == by)
    backed = F.exists(follows, lambda x: is_it(x) & (x["by"] == by)) | (only & F.exists(leads, is_it))
    left_out = F.when(F.exists(follows, is_it), F.lit(False))
    return F.when(by == 1, left_out).when(value.isNull() | (F.abs(value) >= 1e6), F.lit(False)).when(kind != "exact", F.lit(True)).otherwise(F.coalesce(backed, F.lit(False)))
