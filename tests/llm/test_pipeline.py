"""The corpus pipeline stage by stage, and the registered queries against their SQL."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import language_id, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(name, spark, folder):
    base = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = base.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, folder).select(*want.columns)
    key = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert key(map(tuple, got.collect())) == key(want.fetchall())


def test_stages_keep_columns_and_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, docs, folder), f"test-{name}")
        assert after.columns == docs.columns
        left.append(after.select("doc_id").distinct().count())
        docs = after
    total = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert left[0] >= 0.95 * total and left == sorted(left, reverse=True)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count() and last.where(F.col("n_tokens") <= 0).count() == 0


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def brute_pipeline(rows, model, share=1.5, most=2.0):
    """Counter of (doc_id, n_tokens, ids digest, decoded digest) of the stages in plain Python."""
    kept = []
    for i, text, source in rows:
        if text is not None and regex.search(r"\p{L}", text):
            (language,), (score,) = model.predict([text])
            if score >= corpus_pipeline.LEAST_SCORE:
                kept.append((i, text, source))
    last = {}
    for i, text, _ in kept:
        last[text] = max(i, last.get(text, i))
    kept = [r for r in kept if last[r[1]] == r[0]]

    def grams(text):
        words = text.encode().lower().split()
        return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    sets = {i: grams(t) for i, t, _ in kept}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [r for r in kept if find(r[0]) == r[0]]

    word = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
    by = defaultdict(list)
    for i, text, source in kept:
        by[source].append((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, text, word.findall(text)))
    order = sorted(s for s in by if s is not None) + ([None] if None in by else [])
    size = {s: sum(len(w) for *_, w in by[s]) for s in order}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(size.values())
    while open_:
        parts = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if parts[s] > most * size[s]}
        if not full:
            target |= parts
            break
        target |= {s: most * size[s] for s in full}
        left -= sum(most * size[s] for s in full)
        open_ -= full
    mixed = []
    for s in order:
        passes, rest = divmod(math.floor(target[s] + 1e-9), size[s])
        for _, i, text, words in sorted(by[s]):
            now = max(0, min(len(words), rest))
            rest -= now
            mixed += [(i, text)] * (passes + (now == len(words))) + ([(i, "".join(words[:now]))] if 0 < now < len(words) else [])

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda x: hashlib.sha256(x).hexdigest()
    coded = ((i, library.encode_ordinary(t), t) for i, t in mixed)
    return Counter((i, len(ids), digest(",".join(map(str, ids)).encode()), digest(t.encode())) for i, ids, t in coded)


def test_pipeline_equals_brute_force(spark, odd, tmp_path):
    """Odd rows of unique ids: copies, near copies, nulls, blanks and long texts; a column of a clashing name."""
    docs = odd.dropDuplicates(["doc_id"]).withColumns({"n_chars": F.length("text"), "size": F.lit("mine")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.fit_languages(read, ~queries.held_out())
    want = brute_pipeline([(r.doc_id, r.text, r.source) for r in read.collect()], model)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def test_stages_take_null_ids_and_repeated_rows(spark):
    long = " ".join(f"word{k}" for k in range(40))
    rows = [(None, long, "en", "a"), (1, long + " more", "en", "a"), (1, long + " more", "en", "a"), (2, "another text of some words", "en", None), (3, "un texte de quelques mots", "fr", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), "test-null")
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == sorted([(0, long), (1, long + " more"), (2, rows[3][1]), (3, rows[4][1])])
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, "")
    assert corpus_pipeline.STAGES[4][1](spark, mixed, "").count() == mixed.count() > 0
