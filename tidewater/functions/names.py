"""Names as keys, and ordered rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Company suffixes that a key leaves out.
SUFFIXES = r"\b(limited|ltd|private|pvt|llp|inc|corp|company|co|the)\b"


def unescaped(text: Column) -> Column:
    """The five named entities of HTML as their characters."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def entity_key(name: Column) -> Column:
    """A key under which spellings of one entity meet: unescaped, lower case, no suffixes, words by a dash; null if nothing is left."""
    plain = F.regexp_replace(F.lower(unescaped(name)), "&", " and ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", " "), SUFFIXES, " ")
    return F.nullif(F.regexp_replace(F.trim(F.regexp_replace(plain, " +", " ")), " ", "-"), F.lit(""))


def key_before_bracket(name: Column) -> Column:
    """The key of the text before an opening bracket."""
    return entity_key(F.substring_index(name, "(", 1))


def display_name(name: Column) -> Column:
    """All-capital words of over three letters in title case; the others as they are."""
    words = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 3) & (w == F.upper(w)), F.initcap(w)).otherwise(w)), " ")


def first_rule(rules: list[tuple[str, Column]], otherwise: str | None) -> Column:
    """The label of the first condition that holds; a null condition does not hold."""
    out = F.lit(otherwise)
    for label, condition in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(label)).otherwise(out)
    return out


def first_pattern(text: Column, rules: list[tuple[str, str]], otherwise: str | None) -> Column:
    """The label of the first regular expression found in the text; null or blank text is ``missing``."""
    found = first_rule([(label, text.rlike(pattern)) for label, pattern in rules], otherwise)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("missing")).otherwise(found)


def most_frequent_spelling(df: DataFrame, name: str, key: str = "key", out: str = "spelling") -> DataFrame:
    """(key, spelling, n): per key its most frequent spelling, the smallest of equally frequent ones."""
    counted = df.where(F.col(name).isNotNull()).groupBy(entity_key(F.col(name)).alias(key), F.col(name).alias(out)).agg(F.count("*").alias("n")).where(F.col(key).isNotNull())
    best = Window.partitionBy(key).orderBy(F.desc("n"), out)
    return counted.withColumn("at", F.row_number().over(best)).where("at = 1").drop("at")


def rule_table_match(df: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """Distinct names with the label of the first pattern (by ``rule_no``) of a rule table found in them, else null.

    ``rules``: (rule_no, pattern, label), a table of a caller's own making; it is sent to all tasks, so its
    size is checked first.
    """
    if rules.count() > 10_000:
        raise ValueError("a rule table has at most 10,000 rows")
    names = df.select(name).distinct()
    hits = names.join(F.broadcast(rules), F.expr(f"lower({name}) rlike pattern"), "left")
    return hits.groupBy(name).agg(F.min_by("label", "rule_no").alias("label"))
