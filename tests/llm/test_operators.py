"""The training-data operators against brute force, libraries and held-out labels."""

from __future__ import annotations

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from tidewater.llm import byte_bpe, components, content_sort, language_id, line_dedup, mixing, ngram_join, queries, substring_dedup, token_counts, url_reputation, vector_links

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def library() -> tiktoken.Encoding:
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def grams(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def alike(a, b, percent=80):
    shared = len(a & b)
    return bool(a and b) and 100 * shared >= percent * (len(a) + len(b) - shared)


def test_language_id_on_held_out_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.op1_language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_equals_a_plain_forward_pass():
    net = language_id.train(["the and of that with", "le la les des une"] * 20, ["en", "fr"] * 20, steps=5)
    texts = ["the", "é漢字 une " * 90, "x" * 255 + "les des" * 3, "\x00"]
    for text, language, score in zip(texts, *net.predict(texts), strict=True):
        data, step, total, size = text.encode(), language_id.WINDOW - max(language_id.WIDTHS) + 1, 0.0, 0
        for at in range(0, max(1, len(data) - max(language_id.WIDTHS) + 1), step):
            part = data[at : at + language_id.WINDOW]
            padded = list(part.ljust(language_id.WINDOW, b"\x00"))
            peaks = []
            for f in range(net.filters.shape[1]):
                sums = [sum(float(net.embedding[padded[i + o], e]) * float(net.filters[o * net.dim + e, f]) for o in range(max(language_id.WIDTHS)) for e in range(net.dim)) for i in range(0, language_id.WINDOW - max(language_id.WIDTHS) + 1, 1)] if f < 2 else None
                peaks.append(max(sums) if sums else None)
            fast = net.pooled(np.frombuffer(bytes(padded), np.uint8)[None])[0]
            assert [max(p + float(net.bias[f]), 0) for f, p in enumerate(peaks[:2])] == pytest.approx(fast[:2].tolist(), abs=1e-4)
            total, size = total + len(part) * (fast @ net.dense + net.dense_bias), size + len(part)
        odds = np.exp(total / size - (total / size).max())
        assert language == net.languages[int(odds.argmax())] and score == pytest.approx(float(odds.max() / odds.sum()), abs=1e-4)


def test_every_language_is_learned(spark):
    rows = [(k * 3 + i, chr(97 + k % 26) * (k // 26 + 2) + " word", f"l{k:03d}") for k in range(80) for i in range(3)]
    model = language_id.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), per_language=2)
    assert len(model.languages) == 80


def test_language_id_odd_rows(odd, none):
    model = language_id.train(["the and of that with", "le la les des une"] * 20, ["en", "fr"] * 20, steps=60)
    got = {r.doc_id: r for r in language_id.identify_languages(odd.withColumn("score", F.lit("mine")), model).collect()}
    assert {got[i].lang_pred for i in (70, 71, 72, 73)} == {"und"} - {None} and got[70].score == 0
    assert got[73].lang_pred == "und" and got[76].lang_pred in ("en", "fr")
    assert language_id.identify_languages(odd, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.fit_languages(none, F.lit(True)) is None
    assert language_id.identify_languages(none, model).count() == 0


def test_token_counts_equal_library(odd, none, odd_rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {(r.doc_id, r.text): (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd.withColumn("n_bytes", F.lit(-1)), PIECES).collect()}
    for doc_id, text, *_ in odd_rows:
        n = len(model.encode(text or "", num_threads=1))
        assert got[doc_id, text] == (len((text or "").encode()), n, n > 4096)
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_token_counts_random_texts():
    rng = random.Random(5)
    model, counts = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.ChunkCounts(token_counts.PieceVocabulary(PIECES), most=500)
    texts = ["".join(rng.choice("aabbtthe  ▁\n\x00é漢🙂<s>0x41'.") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [" " * 77, "a" * 2000, "<unk></s>"]
    for k in range(0, len(texts), 500):
        assert counts.count_batch(texts[k : k + 500]).tolist() == [len(x) for x in model.encode(texts[k : k + 500], num_threads=1)]


def test_mix_is_exact_and_repeats(odd, none, odd_rows):
    sized = odd.select("doc_id", "source", mixing.word_count("text").alias("size"), F.lit("x").alias("taken"))
    got = mixing.mix(sized).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(sized.repartition(3)).collect()))
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    order = sorted((s for s in by if s is not None)) + [None]
    sizes = {s: sum(r.size for r in by[s]) for s in order}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    for s in order:
        assert by[s][0].target == pytest.approx(target[s]) and by[s][0].source_size == sizes[s]
        assert sum(r.taken for r in by[s]) == math.floor(by[s][0].target)
        assert all(0 <= r.taken <= 2 * r.size for r in by[s])
    assert mixing.mix(none.select("doc_id", "source", F.lit(1).alias("size"))).count() == 0


def test_mixed_rows_hold_the_words_taken(odd):
    taken = mixing.mix(odd.select("doc_id", "source", mixing.word_count("text").alias("size"))).agg(F.sum("taken")).first()[0]
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns
    assert rows.agg(F.sum(mixing.word_count("text"))).first()[0] == taken


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_content_groups(odd, none, odd_rows, keep):
    got = Counter(map(tuple, content_sort.content_groups(odd, keep=keep).collect()))
    groups = defaultdict(list)
    for i, text, *_ in odd_rows:
        groups[text or ""].append(i)
    pick = max if keep == "largest" else min
    want = Counter((i, pick(groups[text or ""]), len(groups[text or ""]), i == pick(groups[text or ""]), digest((text or "").encode())) for i, text, *_ in odd_rows)
    assert got == want
    assert content_sort.content_groups(none).count() == 0
    assert content_sort.drop_copies(odd, keep=keep).count() == len(groups)


def test_content_groups_hot_copy_and_null_ids(spark):
    df = spark.range(3000).select(F.when(F.col("id") > 5, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text")).repartition(7)
    got = content_sort.content_groups(df).where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("group_size"), F.count_if("kept")).first()
    assert tuple(got) == (2000, 2998, 2000, 1)


def test_vector_groups_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.05 * rng.standard_normal((30, 16)), base[:1] + 0.1 * rng.standard_normal((150, 16)), base[:5]])
    rows = [(i, v.astype(np.float32).tolist(), "mine") for i, v in enumerate(x)]
    odd = [(900, None, ""), (901, [0.0] * 16, ""), (902, [float("nan")] + [1.0] * 15, ""), (903, [1.0, None] + [1.0] * 14, ""), (904, [], ""), (905, [1.0], ""), (906, [2.0], "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links string").repartition(4)
    got = {r.vec_id: r for r in vector_links.vector_groups(df).collect()}
    v = np.array([r[1] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.95) & ~np.eye(len(v), dtype=bool)
    found = sum(got[i].n_links for i in range(len(v)))
    assert found >= 0.99 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(len(v)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904))
    assert got[906].component_id == 905 and got[905].n_links == 1
    assert vector_links.vector_groups(df.limit(0)).count() == 0


def test_vector_groups_of_many_lengths_and_repeated_ids(spark):
    """A hundred lengths, each with a copy; an id on two rows of different vectors; equal vectors in number."""
    rows = [(2 * d + k, [1.0] * (d - 1) + [2.0]) for d in range(2, 102) for k in range(2)]
    rows += [(1000, [1.0, 0.0, 0.0]), (1000, [0.0, 0.0, 1.0]), (1001, [1.0, 0.01, 0.0]), (1002, [0.0, 0.01, 1.0]), (1003, [0.0, 1.0, 0.0]), (1003, [0.0, 1.0, 0.0])]
    rows += [(2000 + k, [1.0, -3.0, 1.0]) for k in range(50)]
    got = defaultdict(set)
    for r in vector_links.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect():
        got[r.vec_id].add((r.n_links, r.component_id, r.kept))
    assert all(got[2 * d + k] == {(1, 2 * d, k == 0)} for d in range(2, 102) for k in range(2))
    assert got[1000] == {(1, 1000, True)} and got[1001] == {(1, 1000, False)} and got[1002] == {(1, 1000, False)} and got[1003] == {(0, 1003, True)}
    assert all(got[2000 + k] == {(49, 2000, k == 0)} for k in range(50))


@pytest.mark.parametrize("side", [8, 1024])
def test_vector_recall_on_embeddings(spark, folder, side, monkeypatch):
    """All pairs of the sample table; small sides cut each list into many blocks."""
    monkeypatch.setattr(vector_links, "MEMBERS", side)
    monkeypatch.setattr(vector_links, "QUERIES", side)
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    rows = table.collect()
    v = np.array([r.embedding for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in vector_links.vector_groups(table).collect()}
    assert sum(got.values()) >= 0.99 * near.sum() and all(got[r.vec_id] <= k for r, k in zip(rows, near.tolist(), strict=True))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 150)} | {200: 200, 201: 200}


def test_url_rules_and_reputation(spark):
    urls = ["http://A.Example.org/es/1", "https://example.org/en/12?x", "http://x.org", "http://x.org/a#b", "http://y.com/fr/1", "http://y.com/de/", "http://bad.net/p", "http://good.net/p", None, "no scheme", "ftp://z.net?q=/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    outcomes = spark.createDataFrame([("bad.net", False)] * 40 + [("good.net", True)] * 40 + [("good.net", None)], "host string, good boolean")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(pages, outcomes).orderBy("page_id").collect()]
    assert got[:8] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("x.org", "", None, "allow"), ("x.org", "/a", "org/", "allow"),
        ("y.com", "/fr/1", "com/fr/", "allow"), ("y.com", "/de/", "com/de/", "block"), ("bad.net", "/p", None, "block"), ("good.net", "/p", None, "allow"),
    ]
    assert [g[:2] for g in got[8:]] == [("", ""), ("", ""), ("z.net", "")]
    assert url_reputation.judge_urls(pages.limit(0), outcomes.limit(0)).count() == 0


def test_reputation_equals_brute_force_on_graded_hosts(spark):
    """Hosts of 0 to 100 percent good pages under three domains, and a host, a domain and a suffix without any."""
    rng = random.Random(8)
    pages = [(f"h{k}.d{k % 3}.{'net' if k % 3 else 'info'}", rng.random() < k / 10) for k in range(11) for _ in range(4 + 12 * (k % 4))]
    asked = sorted({h for h, _ in pages}) + ["new.d1.net", "new.other.net", "new.other.biz", "", "localhost", None]
    n, good = Counter(h for h, _ in pages), Counter(h for h, g in pages if g)
    levels = {2: [{h: (n[h], good[h]) for h in n}]}
    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    up = lambda table, name: {k: (sum(v[0] for h, v in table.items() if name(h) == k), sum(v[1] for h, v in table.items() if name(h) == k)) for k in {name(h) for h in table}}
    hosts = levels[2][0]
    domains = up(hosts, domain)
    suffixes = up(domains, suffix)
    total = [sum(v[i] for v in suffixes.values()) for i in (0, 1)]
    mean = (total[1] + 1) / (total[0] + 2)

    def strength(units):
        within = mean * (1 - mean)
        if len(units) < 2:
            return 20.0
        ss = sum(k * (g / k - mean) ** 2 for k, g in units.values())
        all_ = sum(k for k, _ in units.values())
        between = max(ss - (len(units) - 1) * within, 0) / (all_ - sum(k * k for k, _ in units.values()) / all_)
        return 1 / min(max(between / within, 1 / 201), 1 / 3) - 1

    def posterior(units, prior):
        k = strength(units)
        means = {u: (g + prior(u) * k) / (m + k) for u, (m, g) in units.items()}
        return means, {u: means[u] + 1.645 * math.sqrt(means[u] * (1 - means[u]) / (units[u][0] + k + 1)) for u in units}

    suffix_mean, suffix_bound = posterior(suffixes, lambda _: mean)
    domain_mean, domain_bound = posterior(domains, lambda d: suffix_mean[suffix(d)])
    _, host_bound = posterior(hosts, lambda h: domain_mean[domain(h)])
    top = mean + 1.645 * math.sqrt(mean * (1 - mean) / 21)
    want = {}
    for h in asked:
        h = h or ""
        want[h] = host_bound.get(h, domain_bound.get(domain(h), suffix_bound.get(suffix(h), top)))
    frame = spark.createDataFrame([(i, None if h is None else f"http://{h}/x") for i, h in enumerate([*asked, asked[0]])], "page_id long, url string")
    got = url_reputation.judge_urls(frame, spark.createDataFrame([*pages, (asked[0], None)], "host string, good boolean"), rules=[]).collect()
    assert all(r.bound == pytest.approx(want[r.host]) and r.verdict == ("block" if want[r.host] < 0.8 * mean else "allow") for r in got)
    assert {r.verdict for r in got} == {"allow", "block"} and len(got) == len(asked) + 1


def test_outcomes_of_odd_labels(spark):
    pages = spark.createDataFrame([(i, f"http://h.net/en/{i}") for i in range(6)] + [(9, "http://h.net/about"), (10, None)], "page_id long, url string")
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, None), (2, None, 0), (3, 1, 1), (None, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    got = url_reputation.article_outcomes(pages, labels).collect()
    assert Counter((r.host, r.good) for r in got) == {("h.net", False): 2, ("h.net", None): 1, ("h.net", True): 2}


def covered(rows, width):
    first = {}
    for i, t in sorted((i, (t or "").encode()) for i, t, *_ in rows):
        for k in range(len(t) - width + 1):
            first.setdefault(t[k : k + width], i)
    for i, t, *_ in rows:
        t = (t or "").encode()
        mark = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if first[t[k : k + width]] < i:
                mark[k : k + width] = b"\1" * width
        yield i, t, mark


def test_substring_dedup_matches_brute_force(odd, none, odd_rows):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) for r in substring_dedup.without_repeats(odd.withColumn("kept", F.lit(1))).collect())
    want = Counter()
    for i, t, mark in covered(odd_rows, 50):
        kept = bytes(c for c, m in zip(t, mark, strict=True) if not m)
        want[i, len(t), sum(mark), sum(1 for k in range(len(t)) if mark[k] and (not k or not mark[k - 1])), kept, digest(kept)] += 1
    assert got == want
    assert substring_dedup.without_repeats(none).count() == 0


@pytest.mark.parametrize(("width", "gram"), [(20, None), (400, None), (400, 30), (7, 7), (3, 1)])
def test_substring_dedup_at_other_widths(odd, odd_rows, width, gram):
    got = Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in substring_dedup.without_repeats(odd, width=width, gram=gram, keep_bytes=False).collect())
    want = Counter((i, sum(mark), digest(bytes(c for c, m in zip(t, mark, strict=True) if not m))) for i, t, mark in covered(odd_rows, width))
    assert got == want


def test_substring_dedup_takes_sound_widths_only(none):
    for width, gram in ((0, None), (70_000, None), (20, 21)):
        with pytest.raises(ValueError, match="gram"):
            substring_dedup.without_repeats(none, width=width, gram=gram)


def groups_of(rows):
    sets = [(i, grams(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if alike(a, b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def test_ngram_join_matches_brute_force(odd, none, odd_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(odd).collect()}
    assert got == groups_of(odd_rows)
    kept = ngram_join.drop_near_copies(odd.withColumn("n", F.lit(1)))
    assert {r.doc_id for r in kept.collect()} == {c for _, c in got.values()} and kept.columns[-1] == "n"
    assert ngram_join.near_groups(none).count() == 0


def test_ngram_join_chain_of_near_copies(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(30):  # each a little further from the first
        rows.append((100 - i, " ".join(words)))
        words[(i * 37) % 150] = f"n{i}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups_of(rows)


def test_ngram_join_family_without_a_shared_link(spark):
    """Copies of one text with more edits the smaller their id: the smallest ids link with few, and some with none."""
    rng = random.Random(10)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), (119 - i) % 5 + (i < 60) * 2):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for turns in (True, False):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(frame, turns=turns).collect()}
        assert got == groups_of(rows)


def test_byte_bpe_equals_library_and_round_trips(odd, none, odd_rows):
    lib = library()
    got = {(r.doc_id, r.text): (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip_digests(odd, RANKS, public_tokenizers.PATTERN).collect()}
    for i, text, *_ in odd_rows:
        ids = lib.encode_ordinary(text or "")
        assert got[i, text] == (len(ids), digest(",".join(map(str, ids)).encode()), digest((text or "").encode()))
    coded = byte_bpe.encode_texts(odd.where("doc_id in (75, 77)"), RANKS, public_tokenizers.PATTERN).collect()
    assert all(list(r.ids) == lib.encode_ordinary(r.text) and bytes(r.decoded).decode() == r.text for r in coded)
    assert byte_bpe.round_trip_digests(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_random_texts():
    rng, lib = random.Random(6), library()
    encoder = byte_bpe.ByteEncoder(RANKS, public_tokenizers.PATTERN, most=300)
    texts = ["".join(rng.choice("aabtthe   \n\té漢🙂<s>'s'll12½ª×.—\x1c\x85 ") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 20_000, "ab" * 5000, " " * 999 + "x", "——" * 50]
    for k in range(0, len(texts), 400):
        part = texts[k : k + 400]
        assert encoder.encode(part) == [lib.encode_ordinary(x) for x in part]
        assert encoder.decode(encoder.encode(part)) == [x.encode() for x in part]


def test_line_dedup_matches_brute_force(odd, none, odd_rows):
    lines = sorted((i, k, line) for i, t in {(i, t) for i, t, *_ in odd_rows} for k, line in enumerate((t or "").split("\n")))
    sets = [(i, k, grams(line)) for i, k, line in lines]
    gone = {(i, k) for z, (i, k, s) in enumerate(sets) if any(alike(s, b) for _, _, b in sets[:z])}
    got = {(r.doc, r.line) for r in line_dedup.later_matches(odd).collect()}
    assert got == gone
    for r in line_dedup.without_later_lines(odd).collect():
        want = next(t for i, t, *_ in odd_rows if i == r.doc_id)
        kept = None if want is None else "\n".join(line for k, line in enumerate(want.split("\n")) if (r.doc_id, k) not in gone)
        assert r.text == kept and r.n_removed == sum(1 for i, _ in gone if i == r.doc_id)
    assert line_dedup.without_later_lines(none).count() == 0


def test_line_dedup_takes_hashed_ids_and_clashing_columns(spark):
    line = "one two three four five six"
    rows = [(2**62 + 5, f"{line}\nx", 1), (-(2**62), f"a\n\n{line}", 2), (None, line, 3), (2**62 + 6, None, 4)]
    got = line_dedup.without_later_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int")).collect()
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got} == {(2**62 + 5, "x", 2, 1), (-(2**62), f"a\n\n{line}", 3, 0), (None, line, 1, 0), (2**62 + 6, None, 0, 0)}


@pytest.mark.parametrize("leaders", [True, False])
def test_line_dedup_of_a_family_that_its_earliest_does_not_match(spark, leaders, monkeypatch):
    """Lines with more edits the earlier they stand; once with turns of leaders forced, once left to the join."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(80), 4 if i < 25 else 1):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    turns, real = [], line_dedup._ahead

    def ahead(*args):
        turns.append(real(*args))
        return (0, 1000 // len(turns) ** 2) if leaders and len(turns) < 4 else (10**9, 0)

    monkeypatch.setattr(line_dedup, "_ahead", ahead)
    got = {r.doc for r in line_dedup.later_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [grams(t) for _, t in rows]
    assert got == {i for i in range(90) if any(alike(sets[i], s) for s in sets[:i])}
    assert len(turns) == (4 if leaders else 1)
