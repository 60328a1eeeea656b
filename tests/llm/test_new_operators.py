"""Centroid clustering, document fingerprints and the source divergence audit against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_texts import sentence
from pyspark.sql import functions as F

from tidewater.llm import centroids, divergence, fingerprints


# --- op11


def brute_clusters(rows, size=64, k=16, rounds=3):
    """{row number: (vec_id, cluster, distance, cluster_inertia, inertia, digest)} by all distances in whole numbers."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    places = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(places))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        for n, vs in members.items():
            places[n] = [sum(column) // len(vs) for column in zip(*vs, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, n, d in found:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, places[n])).encode()).hexdigest()) for i, n, d in found), key=repr)


def vectors(rng, n, size=64):
    middles = rng.standard_normal((5, size))
    return [(i, [float(np.float32(x)) for x in middles[i % 5] + 0.3 * rng.standard_normal(size)]) for i in range(n)]


def clustered(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("mine"), "inertia": F.lit(1)})
    return sorted(map(tuple, centroids.cluster_vectors(df.repartition(3), **how).collect()), key=repr)


def test_clusters_equal_all_distances(spark):
    rng = np.random.default_rng(4)
    rows = vectors(rng, 300)
    odd = [(400, None), (401, []), (402, [1.0] * 63), (403, [float("nan")] * 64), (404, [float("inf")] + [0.0] * 63), (405, [None] + [0.0] * 63), (406, [0.0] * 64), (None, [0.5] * 64)]
    got = clustered(spark, rows + odd + rows[:20] + [(7, [1.5] * 64)])
    assert got == brute_clusters(rows + odd + rows[:20] + [(7, [1.5] * 64)])
    assert len(got) == 323


@pytest.mark.parametrize("lead", [1, 3, 64])
def test_clusters_do_not_depend_on_the_axes(spark, lead):
    rows = vectors(np.random.default_rng(9), 120)
    assert clustered(spark, rows, lead=lead) == brute_clusters(rows)


def test_clusters_of_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]  # first centroids stand in two places only
    assert clustered(spark, rows) == brute_clusters(rows)
    assert clustered(spark, rows[:3]) == brute_clusters(rows[:3])
    assert clustered(spark, []) == []


def test_large_components_are_exact_up_to_the_bound(spark):
    rows = [(i, [float(np.float32(2e6 * math.sin(i * 64 + k))) for k in range(64)]) for i in range(60)]
    got = clustered(spark, rows + [(99, [1e30] + [0.0] * 63)])
    want = brute_clusters(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[5] for r in got] == [r[5] for r in want]


def test_bounds_leave_few_centroids():
    """On clustered vectors most centroids are left out without their distances."""
    rng = np.random.default_rng(2)
    x = np.array([v for _, v in vectors(rng, 2000)]) * 64 // 1
    rotation = centroids.Rotation(x.mean(axis=0), np.cov(x.T), 8)
    middles = centroids.Centroids(x[:16].astype(np.int64), rotation)
    lead, rest = rotation.place(x)
    low = ((lead[:, None] - middles.lead[None]) ** 2).sum(axis=2) + (rest[:, None] - middles.rest[None]) ** 2
    exact = ((x[:, None] - middles.whole[None]) ** 2).sum(axis=2)
    assert (low <= exact * (1 + 1e-9) + 1e-6).all()
    assert (low <= exact.min(axis=1)[:, None]).mean() < 0.5


# --- op12


def brute_edits(rows):
    order = sorted(range(len(rows)), key=lambda k: -(2**63) if rows[k][0] is None else rows[k][0], reverse=True)
    out = {}
    for at, k in enumerate(order):
        text, after = rows[k][1] or "", rows[order[(at + 1) % len(order)]][1] or ""
        half = len(text) // 2
        out[rows[k][0]] = (len(text), text[: len(text) - half] + after[:half], after)
    return out


def printed(spark, text):
    return fingerprints.edited_fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().fingerprint


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_edits_of_odd_rows(spark, odd_rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = list({r[0]: r for r in odd_rows}.values()) + [(None, "no id.\nat all", "en", "a"), (-5, "😀é" * 7, "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.lit("mine"), "next": F.lit(1), "id": F.lit(2), "own": F.lit(3)})
    try:
        got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_edits(rows)
    assert got.keys() == want.keys()
    assert {"lang", "source", "next", "id", "own"} <= set(got[0].asDict())
    of_text = {r.text or "": r.fingerprint for r in got.values()}
    for i, (n, edited, after) in want.items():
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].near_next == 1) == (of_text[got[i].text or ""] == of_text[after])
    assert len({got[i].fingerprint for i in range(52, 60)}) == 1 and all(got[i].near_next == 1 for i in range(53, 60))
    assert got[70].fingerprint == got[71].fingerprint == "0" * 8 * fingerprints.LANES


def test_edited_fingerprint_is_that_of_the_edited_text(spark):
    rows = [(3, "one. two.\nthree four. five"), (2, "six. seven.\neight"), (1, "nine")]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert r.edited_fingerprint == printed(spark, brute_edits(rows)[r.doc_id][1])


def test_repeated_rows_follow_each_other(spark):
    rows = [(5, "a b c. d"), (5, "a b c. d"), (5, "x y z. w"), (4, "last one")]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sum(r.near_next == 1 for r in got) == 1
    one = fingerprints.edited_fingerprints(spark.createDataFrame(rows[:1], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a b a b ").hexdigest()
    assert fingerprints.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sums_of_paragraphs(spark):
    a, b, c = "first part. more", "second part", "third. and so on."
    df = spark.createDataFrame([(f"{a}\n{b}", f"{c}\n\n{b}", f"{b}\n{c}\n{a}\r\n{b}", a, f"{b}\n{a}")], "x string, y string, both string, a string, turned string")
    for name in df.columns:
        df = fingerprints.with_fingerprint(df, name, f"f_{name}")
    got = df.select(
        (fingerprints.inserted(F.col("f_x"), F.col("f_y")) == F.col("f_both")).alias("added"),
        (fingerprints.deleted(F.col("f_both"), F.col("f_y")) == F.col("f_x")).alias("taken"),
        (F.col("f_x") == F.col("f_turned")).alias("order"),
        (F.col("f_x") == F.col("f_a")).alias("other"),
        F.size("f_x").alias("lanes"),
        F.size(F.array_distinct(F.slice("f_a", 2, 8))).alias("even"),
    ).first()
    assert tuple(got) == (True, True, True, False, fingerprints.LANES, 8)
    whole = fingerprints.collection_fingerprint(spark.createDataFrame([("g", a), ("g", b), ("g", None)], "g string, text string"), "text", ["g"]).first().fingerprint
    assert whole == df.select("f_x").first()[0]


def test_likeness_follows_shared_sentences(spark):
    rng = random.Random(8)
    errors = []
    rows = []
    for i in range(40):
        own = [sentence(rng, 12) + f" {i}." for _ in range(40)]
        rows.append((i, "\n".join(own)))
    for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        edited = brute_edits(rows)[r.doc_id][1]
        a, b = (Counter(x for x in re.split(r"(?<=[.!?])\s+|\r?\n", t) if x) for t in (r.text, edited))
        errors.append(abs(r.near_edited - 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))))
        assert r.near_next < 0.4
    assert np.mean(errors) < 0.1 and max(errors) < 0.35


def test_next_rows_of_many_ranges(spark):
    """Runs of ids far apart, and one id that holds a third of the rows."""
    rng = random.Random(1)
    rows = [(rng.choice([5, rng.randint(-9, 9), rng.randint(-(10**15), 10**15)]), f"t{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(7)
    got = [(r.id, r.text, r.next.text) for r in fingerprints.with_next(df, "id", ["text"], "text").collect()]
    assert len(got) == 300
    after = {t: n for _, t, n in got}
    by_text = {t: i for i, t in rows}
    at, seen = got[0][1], []
    for _ in range(300):
        seen.append(at)
        at = after[at]
    assert len(set(seen)) == 300 and at == seen[0]  # one ring of all rows
    assert sum(by_text[a] < by_text[b] for a, b in zip(seen, [*seen[1:], seen[0]], strict=True)) == 1  # descending but for its end


# --- op13


def brute_divergence(rows, least=3, top=200):
    """Sorted rows of the audit by plain counting of every pair and term."""
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = pattern.findall((text or "").translate(fold))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= least}
        groups = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        share = lambda c, n: {t: 1 + 1000000000 * (c[t] + 1) // (n + len(kept)) for t in c}
        p = {s: share(c, sum(c.values())) for s, c in groups.items()}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        q = share(whole, sum(whole.values()))
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def audited(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"item": F.lit(1), "n": F.lit("x"), "term": F.lit(0)})
    return sorted(map(tuple, divergence.source_divergence(df.repartition(3), **how).collect()))


def test_divergence_of_odd_rows(spark, odd_rows):
    rows = [r[1:] for r in odd_rows] + [("Éa ÉA éa x1y __ 漢字 漢字", "fr", "b"), ("éa 漢字", "fr", None), ("\x00A\x7fb[c", "fr", "z"), (None, "xx", "only"), (None, "xx", "two"), ("Éa 漢字 A", "fr", "c")]
    got = audited(spark, rows)
    assert got == brute_divergence(rows)
    assert ("xx", "only", "pair", "two", 0, 1) in got


def test_divergence_over_small_blocks_and_tables(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = [(" ".join(rng.choices(words, [1 / (k + 1) for k in range(400)], k=60)), rng.choice(["en", "de"]), rng.choice("aaaaabcdef")) for _ in range(150)]
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "CELLS", 1)
    assert audited(spark, rows, top=7) == brute_divergence(rows, top=7)


def test_divergence_of_no_rows_and_one_group(spark):
    assert audited(spark, []) == []
    assert audited(spark, [("a b", "en", "x")] * 3) == brute_divergence([("a b", "en", "x")] * 3)
    assert audited(spark, [("a", "en", "x"), ("b", "en", "y")]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_scaled_share_is_exact():
    rng = random.Random(3)
    counts = [0, 1, 10**12, 2**50] + [rng.randrange(10**13) for _ in range(200)]
    for total in (1 + max(counts), 10**15 + 7):
        assert divergence.scaled_share(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def test_runs_of_a_column():
    starts, counts = divergence.runs(np.array([0, 0, 3, 3, 0]), np.array([5, 1, 1, 2, 1]))
    assert (starts.tolist(), counts.tolist()) == ([0, 2, 4], [0, 3, 0])
