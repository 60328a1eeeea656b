"""Record linkage: as-of, interval and one-to-one joins. A link is unique or not made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.graphs import components
from tidewater.operators.ranking import run_links
from tidewater.session import dealt, settled


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], direction: str = "backward", strict: bool = False, tolerance_days: int | None = None) -> DataFrame:
    """Every left row with ``columns`` and ``matched_time`` of the nearest right row of its key.

    ``direction``: ``backward`` (at or before), ``forward`` (at or after) or ``nearest`` (ties: before).
    Both sides meet in one window by key, so each is shuffled once and nothing is multiplied out; forward
    is backward with time turned round, so that each frame only grows. Where right rows tie in time, the
    largest by ``columns`` counts. Null keys or times match nothing.
    """
    row = "asof_row"
    if direction == "nearest":
        back = asof_join(left.withColumn("nearest_id", F.monotonically_increasing_id()), right, keys, left_time, right_time, columns, "backward", strict, tolerance_days)
        back = back.withColumnsRenamed({c: f"back_{c}" for c in [*columns, "matched_time"]})
        both = asof_join(back, right, keys, left_time, right_time, columns, "forward", strict, tolerance_days)
        gap_back, gap_next = F.abs(F.datediff(left_time, "back_matched_time")), F.abs(F.datediff("matched_time", left_time))
        use_back = F.col("back_matched_time").isNotNull() & (F.col("matched_time").isNull() | (gap_back <= gap_next))
        return both.select(*left.columns, *[F.when(use_back, F.col(f"back_{c}")).otherwise(F.col(c)).alias(c) for c in [*columns, "matched_time"]])
    sound = right.where(" and ".join(f"{c} is not null" for c in [*keys, right_time]))
    facts = sound.groupBy(*keys, F.col(right_time).alias("asof_time")).agg(F.max(F.struct(*columns)).alias("asof_fact"))
    facts = facts.withColumn("asof_side", F.lit(0))
    packed = left.select(*keys, F.col(left_time).alias("asof_time"), F.struct("*").alias(row)).withColumn("asof_side", F.lit(1))
    both = packed.unionByName(facts, allowMissingColumns=True)
    time = F.col("asof_time").desc() if direction == "forward" else F.col("asof_time").asc()
    side = F.col("asof_side").desc() if strict else F.col("asof_side").asc()
    frame = Window.partitionBy(*keys).orderBy(time, side).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.col("asof_side") == 0, F.struct("asof_time", "asof_fact"))
    found = both.withColumn("hit", F.last(hit, ignorenulls=True).over(frame)).where("asof_side = 1")
    ok = F.col(f"{row}.{left_time}").isNotNull()
    for k in keys:
        ok &= F.col(k).isNotNull()
    if tolerance_days is not None:
        ok &= F.abs(F.datediff(F.col("hit.asof_time"), F.col(f"{row}.{left_time}"))) <= tolerance_days
    return found.select(
        *[F.col(f"{row}.{c}").alias(c) for c in left.columns],
        *[F.when(ok, F.col(f"hit.asof_fact.{c}")).alias(c) for c in columns],
        F.when(ok, F.col("hit.asof_time")).alias("matched_time"),
    )


def unique_match(left: DataFrame, right: DataFrame, on: Column, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) pairs that ``on`` joins where each side has the other as its only candidate."""
    pairs = left.join(right, on).select(left_id, right_id)
    return pairs.withColumns({"nl": F.count("*").over(Window.partitionBy(left_id)), "nr": F.count("*").over(Window.partitionBy(right_id))}).where("nl = 1 and nr = 1").drop("nl", "nr")


def _known(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in ``columns``; an amount that is no number (NaN) is none."""
    return df.where(" and ".join(f"{c} is not null" for c in columns))


def few_of_amount(df: DataFrame, keys: list[str], amount: str, who: str, row_id: str) -> DataFrame:
    """Rows that stand for all of their keys and amount in a search for the only candidate: two each of three ``who``.

    Whoever asks is one ``who`` at most: of three, two others are left, and two rows of one other are two
    candidates. So who has one candidate among all rows has it here too, who has more has at least two
    here, and a row that is left out is nobody's only candidate.
    """
    of = Window.partitionBy(*keys, amount)
    two = _known(df, [*keys, amount, who, row_id]).withColumn("turn", F.row_number().over(Window.partitionBy(*keys, amount, who).orderBy(row_id))).where("turn <= 2")
    return two.withColumn("place", F.dense_rank().over(of.orderBy(who))).where("place <= 3").drop("turn", "place")


def only_near(left: DataFrame, right: DataFrame, keys: list[str], amount: str, who: str, row_id: str, left_id: str, right_id: str, relative: float) -> DataFrame:
    """(left_id, right_id): rows of equal keys and another ``who``, amounts no more than ``relative`` of the left's apart, where each side has the other as its only candidate.

    Both sides have these columns, and ids of one type. No pairs are made: along the sorted amounts of a
    key a row's two nearest candidates above it and the two below tell whether it has one, and whom it
    claims; a pair that both claim is linked. The nearest one of another ``who`` is the next row, or the
    first one of the run after it. Ids may repeat: all rows of an id have one candidate between them.
    An amount that is no number, or endless, is near to others out of the order: such lefts are offered
    to all rights of their key, and few of them.
    """
    sound = [_known(df, [*keys, amount, who]).select(*keys, F.col(amount).alias("amount"), F.col(who).alias("who"), F.col(row_id).alias("id")) for df in (left, right)]
    near = lambda a, b: F.abs(a - b) <= F.lit(relative) * a
    endless = F.isnan(F.col("amount").cast("double")) | F.abs(F.col("amount").cast("double")).isin(float("inf"))
    rows = dealt(sound[0].withColumn("side", F.lit(0)).unionByName(sound[1].withColumn("side", F.lit(1))), *keys).withColumns({"turn": F.monotonically_increasing_id(), "walked": (F.col("side") == 1) | ~endless})
    order = ["amount", "who", "id", "turn"]
    own = [*keys, "side", "walked"]
    up, down = Window.partitionBy(*own).orderBy(*order), Window.partitionBy(*own).orderBy(*(F.desc(c) for c in order))
    rows = rows.withColumns({f"{n}_{c}": f(c).over(up) for n, f in (("up", F.lead), ("down", F.lag)) for c in ("amount", "who")})
    # a row that opens a run on the way: looking up, its lower neighbour is another's; looking down, its upper one
    rows = rows.withColumns({"up_opens": F.col("who") != F.col("down_who"), "down_opens": F.col("who") != F.col("up_who")})
    for n, w in (("up", down), ("down", up)):
        past = w.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(f"{n}_open", F.last(F.when(F.col(f"{n}_opens"), F.col("amount")), ignorenulls=True).over(past))
        rows = rows.withColumn(f"{n}_fact", F.struct("id", "amount", "who", F.col(f"{n}_amount").alias("next"), F.col(f"{n}_who").alias("next_who"), F.lag(f"{n}_open").over(w).alias("after")))
        rows = rows.withColumn(f"{n}_fact", F.struct(F.col(f"{n}_fact").alias("one"), F.last(F.when(F.col(f"{n}_opens"), F.col(f"{n}_fact")), ignorenulls=True).over(past).alias("other")))
    rows = rows.select(*keys, *order, "side", "walked", "up_fact", "down_fact")
    n, only = F.lit(0), []
    for way, turned in (("up", F.desc), ("down", F.asc)):
        past = Window.partitionBy(*keys).orderBy(*(turned(c) for c in ("amount", "side", "who", "id", "turn"))).rowsBetween(Window.unboundedPreceding, -1)
        seen = [F.last(F.when((F.col("side") == s) & F.col("walked"), F.col(f"{way}_fact")), ignorenulls=True).over(past) for s in (1, 0)]
        rows = rows.withColumns({f"{way}_{s}": x for s, x in enumerate(seen)})
        rows = rows.withColumn("met", F.when(F.col("side") == 0, F.col(f"{way}_0")).otherwise(F.col(f"{way}_1"))).drop(f"{way}_0", f"{way}_1")
        rows = rows.withColumn(f"{way}_first", F.when(F.col("met.one.who") != F.col("who"), F.col("met.one")).otherwise(F.col("met.other"))).drop("met")
        first = F.col(f"{way}_first")
        second = F.when(first["next_who"] != F.col("who"), first["next"]).otherwise(first["after"])
        fits = [F.coalesce(F.when(F.col("side") == 0, near(F.col("amount"), x)).otherwise(near(x, F.col("amount"))), F.lit(False)) for x in (first["amount"], second)]
        n = n + fits[0].cast("int") + fits[1].cast("int")
        only.append((fits[0], first["id"]))
    claimed = rows.select("side", "id", n.alias("n"), F.when(only[0][0], only[0][1]).otherwise(only[1][1]).alias("only")).where("n > 0")
    odd = settled(few_of_amount(sound[0].where(endless), keys, "amount", "who", "id").select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("amount").alias("o_amount"), F.col("who").alias("o_who"), F.col("id").alias("only")), "endless-amounts")
    met = sound[1].join(odd, [F.col(k) == F.col(f"o_{k}") for k in keys]).where((F.col("who") != F.col("o_who")) & near(F.col("o_amount"), F.col("amount")))
    claims = claimed.unionByName(met.select(F.lit(1).alias("side"), "id", F.lit(1).alias("n"), "only"))
    single = claims.groupBy("side", "id").agg(F.sum("n").alias("n"), F.first("only").alias("only")).where("n = 1")
    pairs = single.select(F.when(F.col("side") == 0, F.col("id")).otherwise(F.col("only")).alias(left_id), F.when(F.col("side") == 0, F.col("only")).otherwise(F.col("id")).alias(right_id))
    return pairs.groupBy(left_id, right_id).agg(F.count("*").alias("n")).where("n = 2").drop("n")


def ranked_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """One-to-one pairs within a key by place: first with first, second with second; the longer side's rest stays single."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_order)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*right_order)))
    return a.join(b, [*keys, "place"])


def link_stages(later: DataFrame, earlier: DataFrame, key: str, later_id: str, later_day: str, earlier_id: str, earlier_day: str, days: int = 180) -> DataFrame:
    """(later_id, status, linked): the single earlier row of the key in the ``days`` before, else ambiguous or none.

    Each earlier row carries the day of the last one before it with another id, so that one as-of lookup
    tells one candidate from several: no pairs of a key are made. A later row that repeats an id is judged
    by all its candidates: several days of one id may agree.
    """
    w = Window.partitionBy("e_key").orderBy("e_day", "e_id")
    near = earlier.select(F.col(key).alias("e_key"), F.col(earlier_id).alias("e_id"), F.col(earlier_day).alias("e_day")).where("e_key is not null and e_day is not null and e_id is not null").distinct()
    turns = near.withColumn("turn_day", F.when(F.lead("e_id").over(w) != F.col("e_id"), F.col("e_day")))
    told = turns.withColumn("other_day", F.last("turn_day", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).select(F.col("e_key").alias(key), "e_day", "e_id", "other_day")
    found = asof_join(later.select(later_id, key, later_day), told, [key], later_day, "e_day", ["e_id", "other_day"], tolerance_days=days)
    several = F.coalesce(F.datediff(later_day, "other_day") <= days, F.lit(False))
    judged = found.groupBy(later_id).agg(F.min("e_id").alias("lo"), F.max("e_id").alias("hi"), F.coalesce(F.bool_or(several), F.lit(False)).alias("several"))
    one = (F.col("lo") == F.col("hi")) & ~F.col("several")
    return judged.select(later_id, F.when(F.col("lo").isNull(), "none").when(one, "linked").otherwise("ambiguous").alias("status"), F.when(one, F.col("lo")).alias("linked"))


def span_stats(spans: DataFrame, daily: DataFrame, key: str, row_id: str, first: str, last: str, day: str, low: str, high: str, most_days: int = 31) -> DataFrame:
    """(row_id, low, high, sessions, status) over the daily rows within each span of at most ``most_days``.

    A span of bounded length is exploded into its days, which turns the interval join into an equi join.
    Spans that are judged by their dates alone pass by it, and are not shuffled for it.
    """
    length = F.datediff(last, first)
    status = F.when(F.col(first).isNull() | F.col(last).isNull(), "no_dates").when(length < 0, "dates_out_of_order").when(length > most_days, "span_too_long")
    judged = spans.select(F.col(row_id).alias("s_id"), F.col(key).alias("s_key"), F.col(first).alias("s_first"), F.col(last).alias("s_last"), status.alias("status"))
    days = judged.where("status is null").select("s_id", "s_key", F.explode(F.sequence("s_first", "s_last")).alias("s_day"))
    bars = daily.select(F.col(key).alias("b_key"), F.col(day).alias("b_day"), F.col(low).alias("b_low"), F.col(high).alias("b_high"))
    # a left join: spans without a session stay, and both kinds of spans are read from one shuffle
    met = days.join(bars, (F.col("s_key") == F.col("b_key")) & (F.col("s_day") == F.col("b_day")), "left").groupBy("s_id").agg(F.min("b_low").alias("low"), F.max("b_high").alias("high"), F.count("b_day").alias("sessions"))
    found = met.select(F.col("s_id").alias(row_id), "low", "high", "sessions", F.when(F.col("sessions") == 0, "no_session").otherwise("ok").alias("status"))
    no = bars.schema["b_low"].dataType, bars.schema["b_high"].dataType
    return found.unionByName(judged.where("status is not null").select(F.col("s_id").alias(row_id), F.lit(None).cast(no[0]).alias("low"), F.lit(None).cast(no[1]).alias("high"), F.lit(0).cast("long").alias("sessions"), "status"))


def exists_in_span(days: DataFrame, spans: DataFrame, keys: list[str], day: str, first: str, last: str) -> DataFrame:
    """Every row of ``days`` with ``in_span``: a span of its keys holds its day.

    A key's spans are merged into disjoint ones, of which only the last that begins on or before a day
    can hold it: an as-of lookup, whatever the spans' lengths.
    """
    w = Window.partitionBy(*keys).orderBy(first, last)
    sound = spans.select(*keys, first, last).where(F.col(first) <= F.col(last))
    reached = sound.withColumn("span_upto", F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    opened = reached.withColumn("span_no", F.sum(F.when(F.col("span_upto") >= F.col(first), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = opened.groupBy(*keys, "span_no").agg(F.min(first).alias("span_first"), F.max(last).alias("span_last"))
    found = asof_join(days, merged, keys, day, "span_first", ["span_last"])
    return found.select(*days.columns, F.coalesce(F.col("span_last") >= F.col(day), F.lit(False)).alias("in_span"))


def unique_prefix(names: DataFrame, master: DataFrame, name: str, full: str, code: str, least: int = 4) -> DataFrame:
    """(name, code) where the name begins exactly one full name of the master, or is begun by it.

    Each prefix of ``least`` letters or more meets the whole names of the other side, in both directions:
    equi joins that make one row a hit. Shorter names are never resolved.
    """

    def prefixes(column: str):
        return F.explode(F.transform(F.sequence(F.lit(least), F.length(column)), lambda k: F.substring(column, F.lit(1), k))).alias("p")

    a = names.select(name).distinct().where(F.length(name) >= least)
    b = master.select(F.col(full).alias("m_full"), F.col(code).alias("m_code")).where(F.length("m_full") >= least)
    begun = a.select(name, prefixes(name)).join(b, F.col("p") == F.col("m_full")).select(name, "m_code")
    begins = a.join(b.select(prefixes("m_full"), "m_code"), F.col(name) == F.col("p")).select(name, "m_code")
    hits = begun.unionByName(begins)
    return hits.groupBy(name).agg(F.count_distinct("m_code").alias("n"), F.min("m_code").alias(code)).where("n = 1").drop("n")


def cascade(df: DataFrame, lookups: list[tuple[DataFrame, str, str, str]], out: str) -> DataFrame:
    """Every row with ``out`` from the first lookup that knows it, and ``out``_by, the name of that lookup.

    ``lookups``: (table, column of df, key column of the table, value column), keys unique in each table.
    """
    found, by = [], F.lit("unmatched")
    for i, (table, column, key, value) in enumerate(lookups):
        one = table.groupBy(F.col(key).alias(f"c{i}_key")).agg(F.min(value).alias(f"c{i}"), F.count_distinct(value).alias(f"c{i}_n")).where(f"c{i}_n = 1").drop(f"c{i}_n")
        df = df.join(one, F.col(column) == F.col(f"c{i}_key"), "left").drop(f"c{i}_key")
        found.append(F.col(f"c{i}"))
    for i in reversed(range(len(lookups))):
        by = F.when(F.col(f"c{i}").isNotNull(), F.lit(lookups[i][1])).otherwise(by)
    return df.withColumns({out: F.coalesce(*found), f"{out}_by": by}).drop(*[f"c{i}" for i in range(len(lookups))])


def same_deals(cards: DataFrame, card_id: str, keys: list[str], at: str, figures: str, shown: str, hours: int = 24, large: float = 100.0) -> DataFrame:
    """(card_id, deal, lead, is_lead, cards): cards on one deal, linked over gaps of ``hours`` at most.

    Two cards of one key link if they are no more than ``hours`` apart and share a figure of ``large`` or
    more, or two figures of any size; deals are the components. Figures count to two decimals, from 1 up.
    The lead is the card with the most shown values, of these the one without a time or else the earliest,
    of these the one with the smallest id; ``deal`` is the smallest id.

    Cards meet by a figure, or by a pair of a card's small figures, that they share, and each links only
    with the first one of its run in time: two cards within the gap that share a figure have all cards with
    it between them within the gap too, so that runs say the same as all pairs. A figure that very many
    cards share is no hot group: runs are read in a range sort. A card makes k^2 / 2 pairs of its k figures
    under ``large``. The cards are made once, and settled.

    Cards with a null key or time link with nothing.
    """
    listed = F.array_distinct(F.transform(F.filter(F.col(figures), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) >= 1)), lambda x: F.round(x, 2)))
    known = F.col(at).isNotNull() & ~F.exists(F.array(*(F.col(k).isNull() for k in keys)), lambda x: x)
    rows = settled(cards.select(*keys, F.col(card_id).alias("card"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.when(known, F.array_sort(listed)).alias("all"), F.col(shown).alias("shown")), "cards")
    single = F.transform(F.filter("all", lambda x: F.abs(x) >= large), lambda x: F.struct(x.alias("one"), F.lit(None).cast("double").alias("two")))
    small = rows.where("all is not null").withColumns({"large": single, "small": F.filter("all", lambda x: F.abs(x) < large)})
    pairs = F.flatten(F.transform("small", lambda x: F.transform(F.filter("small", lambda y: y > x), lambda y: F.struct(x.alias("one"), y.alias("two")))))
    marks = small.select(*keys, "card", "at", F.explode(F.concat("large", pairs)).alias("mark")).select(*keys, "mark.one", "mark.two", "at", "card")
    links = run_links(marks, [*keys, "one", "two"], "at", "card", hours * 3_600_000_000)
    found = components(links).withColumnsRenamed({"node": "of", "component": "deal"})
    placed = rows.join(found, F.col("card") == F.col("of"), "left").select("card", F.coalesce("deal", "card").alias("deal"), F.struct(F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce(-F.col("at"), F.lit(0)).alias("early"), (-F.col("card")).alias("id")).alias("weight"))
    leads = placed.groupBy("deal").agg(F.max_by("card", "weight").alias("lead"), F.count("*").alias("cards"))
    return placed.join(leads, "deal").select(F.col("card").alias(card_id), "deal", "lead", (F.col("card") == F.col("lead")).alias("is_lead"), "cards")


def staged_links(left: DataFrame, right: DataFrame, left_id: str, right_id: str, stages: list[str]) -> DataFrame:
    """(left_id, right_id, stage): links by shared identifiers, stage by stage over what is left, each only where it is the only one.

    ``stages``: array columns of identifiers that both sides have, the strictest first. In a stage a left
    and a right row link if they share an identifier and neither shares one with any other row that is
    left. No pairs are made: of each identifier only the smallest and the largest row of a side are kept,
    and a row has one candidate where these agree over all its identifiers. So an identifier that very
    many rows share costs one row in the index, and links nothing. Null identifiers do not count.
    """
    out = None
    for number, stage in enumerate(stages, 1):
        rows = [df.select(F.col(c).alias("id"), F.explode(F.array_distinct(stage)).alias("key")).where("id is not null and key is not null") for df, c in ((left, left_id), (right, right_id))]
        if out is not None:
            rows = [r.join(out.select(F.col(c).alias("id")), "id", "left_anti") for r, c in zip(rows, (left_id, right_id), strict=True)]
        rows = [settled(r, f"links-{number}") for r in rows]
        only = []
        for own, other in (rows, rows[::-1]):
            index = other.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
            seen = own.join(index, "key").groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            only.append(seen.where("lo = hi").select("id", F.col("lo").alias("partner")))
        both = only[0].join(only[1].select(F.col("partner").alias("id"), F.col("id").alias("partner")), ["id", "partner"])
        found = settled(both.select(F.col("id").alias(left_id), F.col("partner").alias(right_id), F.lit(number).alias("stage")), f"links-{number}")
        out = found if out is None else out.unionByName(found)
    return out


def linked_in_stages(rows: DataFrame, on_left: Column, row_id: str, left_id: str, right_id: str, stages: list[list[str]]) -> DataFrame:
    """(left_id, right_id, stage): what :func:`staged_links` links, for rows of both sides that have one identifier a stage, made of columns.

    ``on_left``: which side a row is on (null: neither). ``stages``: the columns of each identifier, the
    strictest first; a null in one of them links nothing. Ids are unique on their side. Rows are dealt out
    once, by the columns that all stages share (one at least): so in every stage the rows of an identifier
    are in one task, where the smallest and the largest free one of each side tell whether there is one
    each. Nothing is joined.
    """
    common = [c for c in stages[0] if all(c in stage for stage in stages)]
    if not common:
        raise ValueError("no column is part of every stage")
    read = list(dict.fromkeys(c for stage in stages for c in stage))
    sided = rows.select(*read, F.col(row_id).alias("link_id"), on_left.alias("on_left")).dropna(subset=["link_id", "on_left"])
    placed = dealt(sided, *common).withColumns({"link_stage": F.lit(None).cast("int"), "linked_to": F.lit(None).cast(sided.schema["link_id"].dataType)})
    for number, stage in enumerate(stages, 1):
        free = F.col("link_stage").isNull()
        for c in stage:
            free &= F.col(c).isNotNull()
        of = Window.partitionBy(*common, *(c for c in stage if c not in common))
        own = {"left": F.when(free & F.col("on_left"), F.col("link_id")), "right": F.when(free & ~F.col("on_left"), F.col("link_id"))}
        seen = placed.withColumns({f"{end}_{side}": f(own[side]).over(of) for side in own for end, f in (("min", F.min), ("max", F.max))})
        one = free & (F.col("min_left") == F.col("max_left")) & (F.col("min_right") == F.col("max_right"))
        placed = seen.withColumns({"link_stage": F.when(one, F.lit(number)).otherwise(F.col("link_stage")), "linked_to": F.when(one, F.col("min_right")).otherwise(F.col("linked_to"))}).drop("min_left", "max_left", "min_right", "max_right")
    return placed.where("on_left and link_stage is not null").select(F.col("link_id").alias(left_id), F.col("linked_to").alias(right_id), F.col("link_stage").alias("stage"))
