"""Links between near-equal vectors by collision counting on sorted one-dimensional projections."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.components import components
from tidewater.llm.shared import written

#: Projections on which collisions are counted, block sides, the recall that windows and counts are set for, and the pairs that set them.
COUNTED, MEMBERS, QUERIES, RECALL, PAIRS = 24, 1024, 2048, 0.999, 20_000


@dataclass
class Projections:
    """Random directions: ``lists`` to meet on, ``counted`` to count further collisions on."""

    least: float
    lists: np.ndarray
    counted: np.ndarray
    margin: float
    reach: float
    window: float
    count: int

    @classmethod
    def fit(cls, dim: int, least: float, directions: int, seed: int) -> Projections:
        """Sets margin, windows and the collision count on random pairs at exactly the least cosine.

        A pair's values on a random direction are two normal variables of that correlation, whatever the
        vectors are: the figures depend on the number of numbers and directions, and not on the data.
        """
        rng = np.random.default_rng([seed, dim])
        lists, counted = rng.standard_normal((directions, dim)), rng.standard_normal((COUNTED, dim))
        window = 2 * math.sqrt(max(1e-12, 2 - 2 * least))
        hits, gaps, apart = [], [], []
        step = max(1, min(PAIRS, (1 << 23) // directions))
        for at in range(0, PAIRS, step):
            x, y = (unit(rng.standard_normal((min(step, PAIRS - at), dim))) for _ in range(2))
            y -= (y * x).sum(axis=1, keepdims=True) * x
            y = least * x + math.sqrt(max(0.0, 1 - least * least)) * unit(y) if dim > 1 else x
            hits.append((np.abs((x - y) @ counted.T) <= window).sum(axis=1))
            a, b = signed(x @ lists.T), signed(y @ lists.T)
            rows, top_a, top_b = np.arange(len(x)), a.argmax(axis=1), b.argmax(axis=1)
            gap_a, gap_b = a[rows, top_a] - a[rows, top_b], b[rows, top_b] - b[rows, top_a]
            gaps.append(np.minimum(gap_a, gap_b))
            apart.append(np.where(gap_a <= gap_b, np.abs(a - b)[rows, top_b], np.abs(a - b)[rows, top_a]))
        count = int(np.floor(np.quantile(np.concatenate(hits), 1 - RECALL)))
        return cls(least, lists, counted, *(float(np.quantile(np.concatenate(v), RECALL)) + 1e-9 for v in (gaps, apart)), window, count)

    def values(self, vectors: np.ndarray, number: int) -> np.ndarray:
        """The vectors' values in list ``number``: a direction, or its opposite."""
        half = len(self.lists)
        return vectors @ self.lists[number % half] * (1 if number < half else -1)


@lru_cache(maxsize=8)
def fitted(dim: int, least: float, directions: int, seed: int) -> Projections:
    """The fit of one length of vectors, made once in each worker."""
    return Projections.fit(dim, least, directions, seed)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    scale = np.abs(x).max(axis=1, keepdims=True) if x.size else np.ones((len(x), 1))
    x = x / np.where(scale > 0, scale, 1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def signed(values: np.ndarray) -> np.ndarray:
    """Each direction and its opposite: two sorted lists a projection, one from either end."""
    return np.concatenate([values, -values], axis=1)


def _within(values: np.ndarray, centres: np.ndarray, width: float) -> np.ndarray:
    """centres x values: which sorted values the window centred on each query holds."""
    order = np.argsort(values)
    rank = np.empty(len(values), np.int32)
    rank[order] = np.arange(len(values))
    low, high = np.searchsorted(values[order], centres - width), np.searchsorted(values[order], centres + width, "right")
    return (rank >= low[:, None]) & (rank < high[:, None])


def _block(pdf: pd.DataFrame, least: float, directions: int, seed: int) -> pd.DataFrame:
    """Members of a list against vectors that look it up: links by node, and each node's smallest one within the block."""
    members, queries = pdf[pdf["member"]], pdf[~pdf["member"]]
    none = pd.DataFrame({"node": [], "links": [], "near": []}).astype("int64")
    if not len(members) or not len(queries):
        return none
    fit = fitted(int(pdf["dim"].iloc[0]), least, directions, seed)
    ip, iq = members["node"].to_numpy(), queries["node"].to_numpy()
    p, q = (unit(np.stack(x["vector"].to_numpy()).astype(np.float64)) for x in (members, queries))
    number = int(pdf["list"].iloc[0])
    met = _within(fit.values(p, number), fit.values(q, number), fit.reach) & (iq[:, None] != ip[None, :])
    collisions = np.zeros((len(q), len(p)), np.uint8)
    for direction in fit.counted:
        collisions += _within(p @ direction, q @ direction, fit.window)
    at_q, at_p = np.nonzero((collisions >= fit.count) & met)
    linked = np.zeros(len(at_q), bool)
    for k in range(0, len(at_q), 200_000):
        part = slice(k, k + 200_000)
        linked[part] = np.einsum("ij,ij->i", q[at_q[part]], p[at_p[part]]) >= least
    at_q, at_p = at_q[linked], at_p[linked]
    # a pair that the member, looking up the other's own list, meets as well counts on one side only
    homes, home_of = np.unique(queries["home"].to_numpy(), return_inverse=True)
    half = len(fit.lists)
    back_at, back_to = fit.lists[homes % half].T, np.where(homes < half, 1, -1)
    theirs, own = (p @ back_at) * back_to, (q @ back_at) * back_to
    back = (theirs[at_p, home_of[at_q]] >= members["top"].to_numpy()[at_p] - fit.margin) & (np.abs(theirs[at_p, home_of[at_q]] - own[at_q, home_of[at_q]]) <= fit.reach)
    once = ~back | (iq[at_q] > ip[at_p])
    at_q, at_p = at_q[once], at_p[once]
    if not len(at_q):
        return none
    ids, number = np.unique(np.concatenate([iq, ip]), return_inverse=True)
    a, b = number[: len(iq)][at_q], number[len(iq) :][at_p]
    weigh = lambda at, rows: np.bincount(at, rows["copies"].to_numpy().astype(float), minlength=len(ids)).astype(np.int64)
    links = weigh(a, members.iloc[at_p]) + weigh(b, queries.iloc[at_q])
    near = np.arange(len(ids))
    while True:
        low = np.minimum(near[a], near[b])
        after = near.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == near).all():
            break
        near = after
    some = links > 0
    return pd.DataFrame({"node": ids[some], "links": links[some], "near": ids[near[some]]})


def vector_groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, seed: int = 11) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Method: equal vectors become one that counts as many. Vectors are projected on 2 * sqrt(rows) random
    directions. Each direction has a sorted list from either end; a vector is a member of the list in
    which it stands furthest out, and looks up each list in which it stands within ``margin`` of its own
    furthest. Members and look-ups meet in blocks of bounded sides: a hot list is cut into many blocks of
    both. In a block the members are sorted on the list's direction, and those in the window centred on
    each query collide with it; so they are on each of 24 more projections, and collisions are counted by
    pair. Pairs that meet in the list and collide often enough are verified by cosine in double precision.
    The margin, the windows and the count are each set so that 99.9 % of pairs at exactly the least cosine
    stay within them (see :meth:`Projections.fit`); nearer pairs pass more often. Every vector is a member
    and a query. A block returns link counts and, for the components, one link to the smallest node
    reached within it.

    Work grows with rows^1.5: 10^9 rows of 64 numbers have 63,246 directions, 32 MB in each worker.

    Null, zero or non-finite vectors and null ids link with nothing (component: the own id). Vectors of
    different length never link. Rows that repeat an id are one node of the components; each row has the
    links of its own vector, and a repeated id with one vector counts once. An empty table gives no rows.
    """
    vector = F.col(vector_col).cast("array<double>")
    sound = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists(vector, lambda x: x != 0)
    named = df.select(F.col(id_col).cast("long").alias("vec_id"), *(F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(F.lit(k), F.size(vector_col), vector_col)).alias(f"k{k}") for k in (1, 2)), F.col(vector_col).alias("vector"))
    keys = ["k1", "k2"]
    found = named.where("k1 is not null")
    ids = found.groupBy("vec_id", *keys).agg(F.any_value("vector").alias("vector"))
    distinct = ids.groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    nodes = written(distinct.select(F.monotonically_increasing_id().alias("node"), *keys, "rep", "copies", "vector", F.size("vector").alias("dim")), "vector-nodes")
    directions = 2 * math.isqrt(nodes.count()) + 2
    links = written(_links(nodes, least, directions, seed), "vector-links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    reps = nodes.select("node", "rep")
    pairs = links.where("node <> near").select("node", "near").distinct().join(reps, "node").withColumnRenamed("rep", "a").join(reps.select(F.col("node").alias("near"), F.col("rep").alias("b")), "near").select("a", "b")
    rows = written(named.drop("vector").join(nodes.select(*keys, "node", "rep", "copies"), keys, "left"), "vector-rows")
    several = rows.where("rep is not null").groupBy("vec_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("vec_id")
    own = rows.where("rep is not null").join(several, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    joined = components(pairs.unionByName(own)).select(F.col("node").alias("of"), "component")
    out = rows.join(counts, "node", "left").join(joined, F.col("rep") == F.col("of"), "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(nodes: DataFrame, least: float, directions: int, seed: int) -> DataFrame:
    """(node, links, near) by block; lists belong to one length of vectors each."""
    result = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("top", T.DoubleType()), T.StructField("seek", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(result)
    def placed(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"home": np.zeros(len(vectors), np.int32), "top": np.zeros(len(vectors)), "seek": [None] * len(vectors)})
        lengths = vectors.map(len).to_numpy()
        step = max(1, (1 << 21) // directions)
        for dim in np.unique(lengths):
            fit = fitted(int(dim), least, directions, seed)
            same = np.flatnonzero(lengths == dim)
            for at in range(0, len(same), step):
                part = same[at : at + step]
                values = signed(unit(np.stack(vectors.iloc[part].to_numpy()).astype(np.float64)) @ fit.lists.T)
                top = values.max(axis=1)
                seek = pd.Series([np.flatnonzero(v >= t - fit.margin).astype(np.int32) for v, t in zip(values, top, strict=True)], index=part)
                out.loc[part, "home"], out.loc[part, "top"], out.loc[part, "seek"] = values.argmax(axis=1).astype(np.int32), top, seek
        return out

    keyed = written(nodes.select("node", "copies", "dim", "vector", placed("vector").alias("at")).select("node", "copies", "dim", "vector", "at.*"), "vector-places")
    spread = F.abs(F.xxhash64("node") % 1_000_003)
    keys = ["dim", "list"]
    sides = (
        keyed.groupBy("dim", F.col("home").alias("list")).agg(F.ceil(F.count("*") / MEMBERS).alias("member_parts"))
        .join(keyed.select("dim", F.explode("seek").alias("list")).groupBy("dim", "list").agg(F.ceil(F.count("*") / QUERIES).alias("query_parts")), keys)
    )
    members = keyed.withColumn("list", F.col("home")).join(sides, keys).select("dim", "list", (spread % F.col("member_parts")).alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_parts") - 1)).alias("q"), F.lit(True).alias("member"), "node", "copies", "vector", "home", "top")
    queries = keyed.withColumn("list", F.explode("seek")).join(sides, keys).select("dim", "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("member_parts") - 1)).alias("m"), (spread % F.col("query_parts")).alias("q"), F.lit(False).alias("member"), "node", "copies", "vector", "home", "top")
    return members.unionByName(queries).groupBy("dim", "list", "m", "q").applyInPandas(lambda pdf: _block(pdf, least, directions, seed), "node long, links long, near long")
