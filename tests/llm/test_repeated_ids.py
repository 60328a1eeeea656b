"""Ids that stand on several rows with different texts of one size."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from odd_texts import sentence

from tidewater.llm import content_sort, line_dedup, mixing, ngram_join, set_join

SCHEMA = "doc_id long, text string"


def family():
    """(doc_id, text): id 1 twice with texts of equally many shingles, and a near copy of each."""
    rng = random.Random(5)
    one, two = (" ".join(f"{w}{i}{k}" for i, w in enumerate(sentence(rng, 120).split())) for k in "ab")
    return [(1, one), (1, two), (2, one + " more"), (3, two + " more")]


def test_near_copies_of_both_texts_of_an_id(spark):
    got = ngram_join.near_groups(spark.createDataFrame(family(), SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_later_lines_of_both_texts_of_an_id(spark):
    got = line_dedup.later_matches(spark.createDataFrame(family(), SCHEMA)).collect()
    assert sorted((r.doc, r.line) for r in got) == [(2, 0), (3, 0)]


def test_an_id_joins_the_groups_of_its_texts(spark):
    """Both texts of id 5 stand first under other ids, alike to nothing else."""
    (_, one), (_, two), *_ = family()
    got = ngram_join.near_groups(spark.createDataFrame([(3, one), (4, two), (5, one), (5, two), (6, "x")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (4, 3), (5, 3), (5, 3), (6, 6)]


def test_lines_of_one_text_of_an_id_leave_the_other_alone(spark):
    rng = random.Random(6)
    line, other = sentence(rng, 20), " ".join(f"m{k}" for k in range(12))
    rows = [(1, line), (2, line), (2, other), (2, f"{other}\n{line}"), (2, None)]
    got = line_dedup.without_later_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text or "", r.n_lines, r.n_removed) for r in got) == sorted([(1, line, 1, 0), (2, "", 1, 1), (2, other, 1, 0), (2, other, 2, 1), (2, "", 0, 0)])


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_candidates_do_not_depend_on_how_cells_are_gathered(spark, odd, most):
    """Every set with enough columns that another set has, and no other, whatever falls into one gathering."""
    docs = odd.selectExpr("doc_id as doc", "coalesce(text, '') as text")
    reps = set_join.distinct_sets(docs, 5, 80, lines=True)
    rows = reps.collect()
    met = Counter(g for r in rows for g in r.grams)

    def least(n):
        m = -(-80 * n // 100)
        slack = m - -(-80 * m // 100) + 1
        return min(m, (3 * slack + 1) // 2) - slack + 1

    want = {(r.doc, r.line, r.n) for r in rows if sum(met[g] > 1 for g in r.grams) >= least(r.n)}
    got = [(r.doc, r.line, r.n) for r in set_join.may_have_links(reps, 80, most).collect()]
    assert len(got) == len(want) and set(got) == want and 0 < len(want) < len(rows)


def test_shingles_are_not_made_again_to_cut_lines_of_single_texts(spark, monkeypatch):
    """Only ids with several texts need the sets of their lines once more."""
    asked, real = [], line_dedup.gram_sets
    monkeypatch.setattr(line_dedup, "gram_sets", lambda docs, *args, **more: asked.append({r.doc for r in docs.collect()}) or real(docs, *args, **more))
    rng = random.Random(7)
    line, other = sentence(rng, 20), sentence(rng, 25)
    rows = [(1, f"{line}\n \x0b\t\n\n{line}"), (2, f"{other}\n{line}"), (3, line), (3, f"own words\n{other}"), (4, "")]
    got = line_dedup.without_later_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == [(1, f"{line}\n \x0b\t\n", 1), (2, other, 1), (3, "", 1), (3, "own words", 1), (4, "", 0)]
    line_dedup.without_later_lines(spark.createDataFrame(rows[:3], SCHEMA)).collect()
    assert asked == [{3}]


def test_many_lines_are_cut_in_linear_time(spark):
    line = "a line of six words here"
    rows = [(1, "\n".join([line] * 60_000)), (2, "\n".join(f"own words of line number {k} x{k}" for k in range(3000)) + "\n" + line)]
    got = {r.doc_id: r for r in line_dedup.without_later_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].text, got[1].n_lines, got[1].n_removed) == (line, 60_000, 59_999)
    assert got[2].n_removed == 1 and got[2].text == rows[1][1].removesuffix("\n" + line)


def test_mixed_rows_keep_columns_of_any_name(spark):
    rows = [(i, f"words of text {i}", "ab"[i % 2], 999, "s", 7, "t", "k") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, source_size string, target long, taken string, doc string")
    got = mixing.mixed_rows(df)
    assert got.columns == df.columns
    assert {tuple(r)[3:] for r in got.collect()} == {(999, "s", 7, "t", "k")}


def test_mixed_rows_of_one_id_do_not_follow_the_order_of_rows(spark):
    rows = [(7, " ".join(f"{k}{i}" for i in range(10)), "a", None) for k in "pqr"] + [(7, "p0 x", "b", "en"), (7, "p0 x", "b", "fr")]
    schema = "doc_id long, text string, source string, lang string"
    runs = [sorted(map(str, mixing.mixed_rows(spark.createDataFrame(r, schema).coalesce(1)).collect())) for r in (rows, rows[::-1], rows[2:] + rows[:2])]
    assert runs[0] == runs[1] == runs[2]


def test_exact_dedup_of_rows_that_differ_elsewhere(spark):
    rows = [(3, "same", "en"), (3, "same", "fr"), (1, "same", "de")]
    runs = [[tuple(r) for r in content_sort.drop_copies(spark.createDataFrame(r, "doc_id long, text string, lang string").coalesce(1)).collect()] for r in (rows, rows[::-1])]
    assert runs[0] == runs[1] and len(runs[0]) == 1
