"""Cleaning of filings and deals from end to end: every row keeps the reason why it was removed, and one pass counts them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidewater.functions.names import entity_key, first_pattern
from tidewater.operators.cleaning import filled_roles, merged_cut_names, side_of, side_word
from tidewater.operators.matching import matched_in_order
from tidewater.operators.prices import holding_state
from tidewater.session import settled, workshop
from tidewater.spec import LIMITS

# What a mode of acquisition, a person's category and a type of transaction say, the first that is found; and how an empty field is filed.
KINDS = [
    ("off_market", r"off[\s-]*market"),
    ("pledge_invoke", r"invo[ck]"),
    ("pledge_revoke", r"revo[ck]|release"),
    ("pledge_create", r"pledge|encumb"),
    ("esop", r"esop|esos|employee|stock option|sweat"),
    ("gift", r"gift"),
    ("inter_se", r"inter[\s-]*se"),
    ("scheme", r"scheme|amalgamat|merger|demerger|arrangement"),
    ("conversion", r"conver|warrant"),
    ("offer_for_sale", r"offer for sale|\bofs\b"),
    ("preferential", r"preferential"),
    ("rights", r"right"),
    ("bonus", r"bonus"),
    ("buyback", r"buy[\s-]*back"),
    ("transmission", r"transmission|inherit|succession"),
    ("allotment", r"allot"),
    ("market", r"block\s*deal|bulk\s*deal"),
    ("market", r"market\s*(purchase|sale|sell|buy)|open market|on[\s-]*market|market"),
    ("other", r"^others?$|^any other"),
]
ROLES = [
    ("promoter_group", r"promoters?\W*(immediate\s*)?relative"),
    ("immediate_relative", r"immediate\s*relative|relative"),
    ("promoter_group", r"promoter\s*group"),
    ("promoter", r"promoter"),
    ("director", r"director"),
    ("kmp", r"key\s*managerial|\bkmp\b"),
    ("designated_person", r"designated"),
    ("employee", r"employee"),
    ("other", r"other"),
]
PLEDGE_KINDS = [("pledge_invoke", r"invo[ck]"), ("pledge_revoke", r"revo[ck]|releas"), ("pledge_create", r"pledge|encumb")]
BLANKS = ["", "-", "--", "na", "n.a.", "nil", "none", "null"]

#: A pair of prices within GROUP_GAP is in the same block of this base or in one beside it.
GROUP_GAP, PRICE_BASE = 0.02, 1.03

HOLDINGS = ["held_before", "held_after"]
SAME_FILING = ["exchange", "security", "symbol", "person", "side", "quantity", "value_key", "day_from", "key_to", *HOLDINGS]


def _filled(text: str) -> Column:
    """A filed text in lower case; what filers write in an empty field is null."""
    plain = F.lower(F.trim(F.col(text)))
    return F.when(~plain.isin(BLANKS), plain)


def _live() -> Column:
    return F.col("reason").isNull()


def _because(df: DataFrame, gone: Column, reason: Column | str) -> DataFrame:
    """Rows that are not removed yet and for which ``gone`` holds are removed for ``reason``."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    return df.withColumn("reason", F.when(_live() & F.coalesce(gone, F.lit(False)), why).otherwise(F.col("reason")))


def _marked(df: DataFrame, ids: DataFrame, mark: str) -> DataFrame:
    """``df`` with boolean ``mark``: the row's ``row_no`` is in ``ids`` (row_no)."""
    return df.join(ids.select("row_no", F.lit(True).alias(mark)).distinct(), "row_no", "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def _gone(df: DataFrame, ids: DataFrame, reason: Column | str, settle: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Rows whose ``row_no`` is in ``ids`` (row_no, once each, and what ``reason`` reads) are removed for ``reason``; ``ids`` is settled (by ``settle``), and not the rows."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    found = (settle or settled)(ids.select("row_no", why.alias("gone_for")), "removed")
    return _because(df.join(found, "row_no", "left"), F.col("gone_for").isNotNull(), F.col("gone_for")).drop("gone_for")


def _beside(df: DataFrame, told: DataFrame, texts: list[str]) -> DataFrame:
    """``df`` with what ``told`` says of its ``texts``, which stand there once; null texts are equal."""
    of = told.withColumnsRenamed({c: f"of_{c}" for c in texts})
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in texts]
    return df.join(of, same, "left").drop(*(f"of_{c}" for c in texts))


def classified(filings: DataFrame) -> DataFrame:
    """Filings with kind, is_market, side, role and person, and no removal yet.

    A mode that is not filed takes the kind of pledge that the type of transaction names. A row without
    shares and value, whose holding is filed and unchanged, is ``holding_only``: no trade, and without a
    side; so is a pledge, which moves no shares between owners. Filers write the same few texts over and
    over: patterns read each distinct text once. These texts are settled, so that their true size is known
    and rows need not be dealt out by them.
    """
    plain = filings.select("mode_raw", "kind_raw").distinct().withColumns({"mode_plain": _filled("mode_raw"), "type_plain": _filled("kind_raw")})
    kinds = plain.select("mode_raw", "kind_raw", first_pattern(F.col("mode_plain"), KINDS, "unrecognised").alias("kind"), first_pattern(F.col("type_plain"), PLEDGE_KINDS, None).alias("by_type"), side_of(F.col("kind_raw"), F.col("mode_raw")).alias("told_side"))
    kinds = kinds.withColumn("kind", F.when((F.col("kind") == "missing") & (F.col("by_type") != "missing"), F.col("by_type")).otherwise(F.col("kind"))).drop("by_type")
    roles = filings.select("role_raw").distinct().withColumn("role_plain", _filled("role_raw")).select("role_raw", first_pattern(F.col("role_plain"), ROLES, "other").alias("role"))
    told = _beside(_beside(filings, settled(kinds, "kinds"), ["mode_raw", "kind_raw"]), settled(roles, "roles"), ["role_raw"])
    typed = told.withColumn("person", entity_key(F.col("person_raw")))
    before, after = F.col("held_before"), F.col("held_after")
    sized = F.coalesce(F.col("quantity") > 0, F.lit(False)) | F.coalesce(F.col("value") > 0, F.lit(False))
    unmoved = (before.isNotNull() | after.isNotNull()) & F.coalesce(before == after, F.lit(True))
    pledge = F.col("kind").startswith("pledge")
    only = typed.withColumn("kind", F.when(~sized & ~pledge & unmoved, "holding_only").otherwise(F.col("kind")))
    moves = ~F.col("kind").startswith("pledge") & (F.col("kind") != "holding_only")
    return only.withColumns({"is_market": F.col("kind") == "market", "side": F.when(moves, F.col("told_side")), "reason": F.lit(None).cast("string")}).drop("told_side")


def dates_agree() -> Column:
    """Whether a filing's days (``l_``) and those of its copy on the other exchange (``r_``) say the same trade.

    A copy that files one day only agrees where that day is within the filing's; one with a last day of its
    own agrees on that. A day that is missing is taken from the other end.
    """
    first, last = F.coalesce("l_day_from", "l_day_to"), F.coalesce("l_day_to", "l_day_from")
    single = ~F.col("r_from_csv") | F.col("r_day_to").isNull()
    return last.isNotNull() & F.when(single, F.coalesce("r_day_from", "r_day_to").between(first, last)).otherwise(F.col("r_day_to") == last)


def pair_copies(first: DataFrame, second: DataFrame) -> DataFrame:
    """(row_no, copy_no): each row of the second exchange that is a copy of one of the first: same security, person, side, kind and shares, and days that agree; one for one, in order."""
    sided = lambda df: df.withColumn("side_key", F.coalesce("side", F.lit("-")))
    days = ["day_from", "day_to"]
    return matched_in_order(sided(first), sided(second).withColumnRenamed("row_no", "copy_no"), ["security", "person", "side_key", "kind", "quantity"], "row_no", "copy_no", ["row_no"], ["day_from", "seen", "copy_no"], days, [*days, "from_csv"], dates_agree())


def pledge_quantities(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows with the shares of pledges that the first exchange files without, from the second's, one for one in row order.

    A row of the second of the same kind comes before one that files no kind, which then takes the kind of
    its pledge; such a row has no side and an unchanged holding.
    """
    pledge = F.col("kind").startswith("pledge")
    blank = (F.col("kind") == "missing") & F.col("side").isNull() & F.coalesce(F.col("held_before") == F.col("held_after"), F.lit(False))
    lacking = df.where(pledge & (F.col("exchange") == first) & F.col("quantity").isNull())
    giving = df.where((pledge | blank) & (F.col("exchange") == second) & F.col("quantity").isNotNull()).withColumn("no_kind", F.col("kind") == "missing").withColumnRenamed("row_no", "copy_no")
    fits = ((F.col("r_kind") == F.col("l_kind")) | (F.col("r_kind") == "missing")) & dates_agree()
    pairs = settled(matched_in_order(lacking, giving, ["security", "person"], "row_no", "copy_no", ["row_no"], ["no_kind", "copy_no"], ["kind", "day_from", "day_to"], ["kind", "day_from", "day_to", "from_csv"], fits), "pledge-pairs")
    shares = pairs.join(giving.select("copy_no", F.col("quantity").alias("given")), "copy_no").select("row_no", "given")
    kinds = pairs.join(lacking.select("row_no", F.col("kind").alias("taken")), "row_no").select(F.col("copy_no").alias("row_no"), "taken")
    given = settled(shares.unionByName(kinds, allowMissingColumns=True), "pledge-shares")
    both = df.join(given, "row_no", "left")
    return both.withColumns({"quantity": F.coalesce("quantity", "given"), "kind": F.when(F.col("kind") == "missing", F.coalesce("taken", "kind")).otherwise(F.col("kind")), "pledge_filled": F.col("given").isNotNull()}).drop("given", "taken")


def replaced_by_marker(df: DataFrame, exchange: str) -> DataFrame:
    """(row_no) of live filings that a later one, marked as a revision, replaces.

    Filings of one security, person, days, kind and side in order of time: a revision replaces the filing
    before it while all filings before it but the first are revisions; once two stand side by side, which
    of them a revision means is not known, and none goes.
    """
    key = ["security", "person", "first_day", "day_to", "kind", "side_key"]
    rows = df.where(_live() & (F.col("exchange") == exchange) & F.col("seen").isNotNull() & F.col("day_to").isNotNull() & F.col("security").isNotNull() & F.col("person").isNotNull())
    keyed = rows.withColumns({"first_day": F.coalesce("day_from", "day_to"), "side_key": F.coalesce("side", F.lit("-")), "app": F.coalesce("app_id", F.lit(""))})
    # only keys with a revision are looked at
    revised = keyed.where("is_revision").select(F.xxhash64(*key).alias("of")).distinct()
    keyed = keyed.join(revised, F.xxhash64(*key) == F.col("of"), "left_semi")
    apps = keyed.groupBy(*key, "app").agg(F.min("seen").alias("at"), F.bool_or("is_revision").alias("revises"))
    turn = Window.partitionBy(*key).orderBy("at", "app")
    # filings that stand beside the first one, up to the one before
    beside = F.sum(F.when(~F.col("revises") & (F.col("place") > 1), 1).otherwise(0)).over(turn.rowsBetween(Window.unboundedPreceding, -1))
    told = apps.withColumn("place", F.row_number().over(turn)).withColumns({"beside": F.coalesce(beside, F.lit(0)), "before": F.lag("app").over(turn), "before_at": F.lag("at").over(turn)})
    gone = told.where("revises and before is not null and beside = 0 and before_at < at").select(*key, F.col("before").alias("app"))
    return keyed.join(gone, [*key, "app"], "left_semi").select("row_no")


def repeats(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Live rows of ``df`` whose key stands there more than once, beside ``first``, the struct of the row of their key with the highest ``order``; null keys are equal.

    Rows are counted by a hash of their key first, so that only those that may be repeats are sorted. The
    first of a key comes from an aggregate that tasks begin, and the join back is split where a key has
    very many rows; a row whose hash another key shares is its own first. Rows that may be repeats are
    settled: ``df`` has the columns that are read, and no more.
    """
    live = df.where(_live())
    several = live.groupBy(F.xxhash64(*keys).alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("of")
    live = settled(live.join(settled(several, "keys-again"), F.xxhash64(*keys) == F.col("of"), "left_semi"), "rows-again").withColumn("key", F.struct(*keys))
    best = live.groupBy("key").agg(F.max(order).alias("first")).select(F.col("key").alias("of"), "first")
    return live.join(best, F.col("key") == F.col("of")).drop("key", "of")


def refiled(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """(row_no) of sized live rows of a person whose key has a later one, unless some row of the key ends with the holding that another begins with: those are parts of one trade."""
    sized = df.where(F.col("person").isNotNull() & (F.col("quantity") > 0) & (F.col("value") > 0))
    first = settled(repeats(sized, keys, order).select("row_no", F.struct(*keys).alias("key"), *HOLDINGS, "first"), "filed-again")
    ends = [first.where(F.col(c).isNotNull()).select("key", F.col(c).alias("held")).distinct() for c in HOLDINGS]
    chained = ends[0].join(ends[1], ["key", "held"]).select("key").distinct()
    return first.where(F.col("row_no") != -F.col("first.turn")).join(chained, "key", "left_anti").select("row_no")


def group_transfers(df: DataFrame, roles: tuple[str, ...] = ("promoter", "promoter_group"), gap: float = GROUP_GAP) -> DataFrame:
    """(row_no, other_no): market buys and sales inside a group, one for one in row order: other persons of these roles, same exchange, security, days and shares, prices within ``gap``.

    Prices meet in logarithmic blocks, own and beside, so that a key's rows are not all compared.
    """
    told = df.where(_live() & F.col("is_market") & F.col("role").isin(*roles) & (F.col("quantity") > 0) & F.col("security").isNotNull() & F.col("person").isNotNull() & F.col("day_to").isNotNull())
    priced = told.withColumns({"first_day": F.coalesce("day_from", "day_to"), "px": F.col("value") / F.col("quantity")}).where("px > 0")
    block = F.floor(F.log("px") / F.log(F.lit(PRICE_BASE)))
    placed = priced.withColumns({"block": block, "near": F.array(block - 1, block, block + 1)})
    close = (F.abs(F.col("l_px") - F.col("r_px")) <= gap * F.col("r_px")) & (F.col("l_person") != F.col("r_person"))
    keys, told = ["exchange", "security", "first_day", "day_to", "quantity"], ["px", "person"]
    return matched_in_order(placed.where("side = 'BUY'"), placed.where("side = 'SELL'").withColumnRenamed("row_no", "other_no"), keys, "row_no", "other_no", ["row_no"], ["other_no"], told, told, close, ("near", "block"))


def cleaned_filings(filings: DataFrame, first: str = "nse", second: str = "bse", start: Column | None = None) -> DataFrame:
    """All filings with what they are, ``reason`` (null: kept), ``flags``, and ``primary_no``: the filing of the first exchange that a kept row of the second repeats.

    Columns read: row_no (unique, the order of filing), exchange, app_id, prev_app_id, submission, symbol,
    security, person_raw, role_raw, mode_raw, kind_raw, quantity, value, held_before, held_after, day_from,
    day_to, seen, from_csv (the second exchange's fuller feed).

    In this order: a filing that a later one names goes (``superseded_by_revision``), or that a later one
    marked as a revision replaces (``superseded_by_revision_marker``); the second exchange's copy of such a
    filing (``copy_of_replaced_filing``); of filings with the same content the latest stays, the others are
    ``same_filing_two_feeds``, ``corrected_refiling`` (another mode) or ``repeat_filing``; a trade filed
    again with other holdings (``refiled_with_other_holdings``); and what lies before ``start`` or has no
    day (``before_product_start``, ``no_readable_transaction_date``). Trades inside a promoter group become
    ``inter_se``. Nothing is filtered: a removed row stays, with its reason, and takes no part in later
    steps. A step settles which rows it found, numbers only; whole rows are written where later steps read
    them often, and not once a step. Tables of a stretch of steps go when the next rows stand; those that
    the result is read from go with the caller's :func:`~tidewater.session.workshop`.
    """
    spark = filings.sparkSession
    with workshop(spark) as kept:
        with workshop(spark) as told:
            df = told(_described(filings, first), "filings")
        df = kept(_unreplaced(df, first, second), "filings")
    order = F.struct("seen", F.col("app_id").try_cast("double").alias("app_no"), F.col("mode_raw").isNotNull().alias("has_mode"), "from_csv", (-F.col("row_no")).alias("turn"), "mode_raw")
    read = ["row_no", "reason", *SAME_FILING, "seen", "app_id", "mode_raw", "from_csv", "value"]
    feeds = (F.col("exchange") == second) & (F.col("from_csv") != F.col("first.from_csv"))
    why = F.when(feeds, "same_filing_two_feeds").when(~F.col("mode_raw").eqNullSafe(F.col("first.mode_raw")), "corrected_refiling").otherwise("repeat_filing")
    with workshop(spark) as kept:
        again = repeats(df.select(*read), SAME_FILING, order).where(F.col("row_no") != -F.col("first.turn"))
        df = _gone(df, again.select("row_no", why.alias("why")), F.col("why"), kept)
    with workshop(spark) as kept:
        df = _gone(df, refiled(df.select(*read), [c for c in SAME_FILING if c not in HOLDINGS], order), "refiled_with_other_holdings", kept)
    day = F.col("day_to")
    df = _because(df, day.isNull(), "no_readable_transaction_date")
    df = df if start is None else _because(df, day < start, "before_product_start")

    with workshop(spark) as kept:
        inside = settled(group_transfers(df), "group-transfers")
        both = kept(inside.select("row_no").unionByName(inside.select(F.col("other_no").alias("row_no"))), "group-transfers")
    df = _marked(df, both, "group_transfer").withColumns({"kind": F.when(F.col("group_transfer"), "inter_se").otherwise(F.col("kind")), "is_market": F.col("is_market") & ~F.col("group_transfer")})
    df = df.drop("key_to", "value_key", "is_revision")
    with workshop(spark) as kept:
        found = pair_copies(df.where(_live() & (F.col("exchange") == first)), df.where(_live() & (F.col("exchange") == second)))
        copies = kept(found.select(F.col("row_no").alias("primary_no"), F.col("copy_no").alias("row_no")), "copies")
    linked = df.join(copies, "row_no", "left")
    return linked.withColumn("flags", F.when(_live(), filing_flags()).otherwise(F.array().cast("array<string>")))


def _described(filings: DataFrame, first: str) -> DataFrame:
    """Filings with what they are, whose they are, and whether a later one names or revises them.

    Names and roles are settled beside the row's number, so that whole rows are dealt out once, by that number.
    """
    with workshop(filings.sparkSession) as kept:
        known = kept(classified(settled(filings, "filings")), "filings")
    named = merged_cut_names(known.select("row_no", F.coalesce("security", "symbol").alias("listed"), "security", "person", "person_raw", "role"), "security", "person", "person_raw")
    who = filled_roles(named.select("row_no", "listed", F.col("merged").alias("person"), "role"), ["listed", "person"], "role").select("row_no", "person", "role", "role_source")
    df = known.drop("person", "role").join(settled(who, "who"), "row_no")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    df = df.withColumns({"app_id": blank("app_id"), "prev_app_id": blank("prev_app_id"), "from_csv": F.coalesce("from_csv", F.lit(False))})
    # few filings name another one: only these are looked up, so that those that name none do not meet in one task
    apps = known.select("row_no", blank("app_id").alias("app_id"), blank("prev_app_id").alias("prev_app_id"))
    namers = settled(apps.dropna(subset=["prev_app_id"]), "namers")
    named = settled(apps.dropna(subset=["app_id"]).join(namers.select(F.col("prev_app_id").alias("app_id")).distinct(), "app_id", "left_semi").select("row_no", "app_id"), "named")
    prev_known = namers.join(named.select(F.col("app_id").alias("prev_app_id")).distinct(), "prev_app_id", "left_semi")
    df = _marked(_marked(df, prev_known, "prev_known"), named, "named")
    df = df.withColumn("is_revision", (F.col("exchange") == first) & F.coalesce(F.lower(F.trim("submission")).startswith("revis"), F.lit(False)) & ~F.col("prev_known"))
    return _because(df, F.col("named"), "superseded_by_revision").drop("named", "prev_known")


def _unreplaced(df: DataFrame, first: str, second: str) -> DataFrame:
    """Described filings with the shares of their pledges, of which those that a marked revision replaces are removed, and the second exchange's copies of replaced ones."""
    df = pledge_quantities(df, first, second)
    df = _gone(df, replaced_by_marker(df, first).distinct(), "superseded_by_revision_marker")
    replaced, others = df.where(~_live() & (F.col("exchange") == first)), df.where(_live() & (F.col("exchange") == second))
    old = settled(pair_copies(replaced, others).select(F.col("copy_no").alias("row_no")), "old-copies")
    still = pair_copies(df.where(_live() & (F.col("exchange") == first)), others.join(old, "row_no", "left_semi")).select(F.col("copy_no").alias("row_no"))
    df = _gone(df, old.join(still, "row_no", "left_anti"), "copy_of_replaced_filing")
    return df.withColumns({"key_to": F.when(F.col("exchange") == second, F.col("day_from")).otherwise(F.col("day_to")), "value_key": F.round("value", -1)})


def filing_flags() -> Column:
    """What holds a filing back until it is looked at."""
    moved = holding_state(F.col("held_before"), F.col("held_after"), F.col("quantity"), F.col("side"))
    held = F.when(F.col("side").isNotNull() & ~F.col("kind").startswith("pledge"), moved)
    market, has_size = F.col("is_market"), F.coalesce(F.col("quantity") > 0, F.lit(False))
    flags = {
        "unmatched_security": F.col("security").isNull(),
        "unrecognised_mode": F.col("kind").isin("unrecognised", "missing"),
        "holding_jump_on_market_trade": market & (F.col("held_before") > 0) & (F.col("held_after") > 20 * F.col("held_before")),
        "holding_change_differs_from_quantity": held.isin("differs", "against_side_and_differs"),
        "holding_moves_against_side": held.startswith("against_side"),
        "missing_or_zero_value": market & has_size & ~F.coalesce(F.col("value") > 0, F.lit(False)),
        "missing_quantity": market & ~has_size,
        "mode_contradicts_side": market & (side_word(F.col("mode_raw")) != F.col("side")),
        "dates_out_of_order": F.col("day_from") > F.col("day_to"),
        "disclosed_before_trade": F.col("day_to") > F.col("seen").cast("date"),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in flags.items())))


REASONS = [
    "superseded_by_revision", "superseded_by_revision_marker", "copy_of_replaced_filing", "same_filing_two_feeds", "corrected_refiling", "repeat_filing",
    "refiled_with_other_holdings", "before_product_start", "no_readable_transaction_date",
]


def counted(df: DataFrame, reasons: list[str], label: str, settle: Callable[[DataFrame, str], DataFrame] = settled) -> tuple[DataFrame, dict[str, int]]:
    """``df`` settled (by ``settle``), and its counts: rows, kept, and each of ``reasons``, observed in the one pass that writes it.

    The observation sits in the writing stage, whose tasks count once however often one is lost and run
    again. Rows whose reason is not among ``reasons`` are counted as ``unknown``, so that rows are always
    kept + the reasons + unknown.
    """
    seen = Observation(label)
    known = F.col("reason").isin(reasons)
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in reasons]
    stands = settle(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(_live()).alias("kept"), F.count_if(~_live() & ~known).alias("unknown"), *counts), label)
    return stands, seen.get


def cleaning_report(df: DataFrame, counts: dict[str, int], table: str, row_id: str, examples: int = LIMITS.examples) -> DataFrame:
    """(table_name, measure, name, n, examples): rows in, kept, removed by reason, and flags of kept rows, with the smallest ids as examples of the reasons."""
    spark = df.sparkSession
    totals = spark.createDataFrame([(("rows" if name in ("rows", "kept") else "removed"), name, n) for name, n in counts.items() if n or name in ("rows", "kept")], "measure string, name string, n long")
    first = Window.partitionBy("reason").orderBy(row_id)
    some = df.where("reason is not null").select("reason", row_id).withColumn("place", F.row_number().over(first)).where(F.col("place") <= examples)
    listed = some.groupBy(F.col("reason").alias("name")).agg(F.array_sort(F.collect_list(row_id)).alias("examples"))
    flags = df.where("reason is null").select(F.explode("flags").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    removed = totals.join(listed, "name", "left").select("measure", "name", "n", "examples")
    held = flags.select(F.lit("flagged").alias("measure"), "name", "n", F.lit(None).cast(removed.schema["examples"].dataType).alias("examples"))
    return removed.unionByName(held).select(F.lit(table).alias("table_name"), "measure", "name", "n", "examples")
