"""Stored inverted file of vectors, searched exactly or by the nearest lists alone.

Each vector, scaled to length 1, belongs to the list of its nearest centroid. A list knows its radius (the widest angle between
a member and the centroid), so by the triangle inequality of angles no member of it can be closer to a query than the angle to
the centroid less the radius. A search reads the nearest lists first; their k-th score tells which others can still matter.
Rows and queries of a list meet in blocks of bounded size, as one matrix product each: no list, query set or copy of a vector
that many rows hold is gathered, and nothing but the centroids (LISTS at most) is sent to all tasks.

Rows with a null id, a null or empty vector, nulls or values that are not finite in it, or length 0 have no direction: they are
neither indexed nor searched for, and the count of them is kept in `info`. Vectors of several dimensions are an error. Equal scores are ranked
by id; an empty table gives an empty index and no hits; other columns are not read. Ids are taken to be keys: rows that share
an id are all indexed, and all found.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.retrieval import ranked
from emberlog.session import cut

#: Lists at most, rows that centroids are fitted on (about), and rows and queries of one block.
LISTS, SAMPLE, BLOCK, QUERY_BLOCK = 4096, 100_000, 8192, 1024
#: Scores are rounded to 6 places, so a bound may lie this far under the k-th score and still matter.
SLACK = 2e-6
FORMAT = 1


def unit(df: DataFrame, key: str, v: str) -> DataFrame:
    """(key, v) with v as doubles of length 1, rows without a direction left out."""
    x = F.transform(F.col(v), lambda a: a.cast("double"))
    finite = ~F.exists("x", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    d = df.select(F.col(key).alias("key"), x.alias("x")).where(F.col("key").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
    # the largest value is divided out first, as squares of very large or small ones leave the range of doubles
    d = d.withColumn("top", F.array_max(F.transform("x", F.abs))).where(F.col("top") > 0).withColumn("x", F.transform("x", lambda a: a / F.col("top")))
    d = d.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, a: s + a * a)))
    return d.select(F.col("key").alias(key), F.transform("x", lambda a: a / F.col("norm")).alias(v))


def as_matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


@dataclass(frozen=True)
class VectorIndex:
    rows: DataFrame  # doc_id, v, list, angle
    lists: DataFrame  # list, n, radius
    centroids: np.ndarray
    info: dict
    reused: bool


def fingerprint(vectors: DataFrame, identity: dict) -> dict:
    """What an index is made of: who made the vectors, and an order-free digest of all ids and vectors."""
    h = F.xxhash64("doc_id", "v").cast("decimal(38,0)")
    own = unit(vectors, "doc_id", "v").agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("sum"), F.bit_xor(F.xxhash64("v", "doc_id")).alias("xor"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if own["low"] != own["high"]:
        raise ValueError(f"vectors of {own['low']} to {own['high']} dimensions in one table")
    return {"format": FORMAT, "identity": identity, "rows": own["n"], "dimension": own["low"] or 0, "sum": own["sum"], "xor": own["xor"] or 0, "without_direction": vectors.count() - own["n"]}


def stored(spark: SparkSession, path: str, info: str) -> bool:
    """Whether the index at path is whole: its description is written last."""
    try:
        return [r["info"] for r in spark.read.parquet(f"{path}/info").limit(2).collect()] == [info]
    except AnalysisException:
        return False


def fitted(rows: DataFrame, n: int) -> np.ndarray:
    """Directions of at most LISTS centroids, about the square root of the rows, from a sample of about SAMPLE rows by hash."""
    k = max(2, min(LISTS, round(n**0.5)))
    share = min(1.0, SAMPLE / n)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(FORMAT), "doc_id"), F.lit(1 << 32)) < int(share * (1 << 32))) if share < 1 else rows
    model = KMeans(k=k, seed=FORMAT, maxIter=10, initMode="random", distanceMeasure="cosine", featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    c = np.array(model.clusterCenters())
    length = np.linalg.norm(c, axis=1, keepdims=True)
    return np.unique((c / length)[length[:, 0] > 0], axis=0)


def build(vectors: DataFrame, root: str, identity: dict) -> VectorIndex:
    """The index of vectors (doc_id, v) below root, made only if the one of the same digest isn't there.

    identity says what else decides about the vectors (model, its version, catalog): another identity or any other row is another
    digest, thus another folder. A build that was cut off has no description and is made again.
    """
    spark = vectors.sparkSession
    info = fingerprint(vectors, identity)
    text = json.dumps(info, sort_keys=True)
    path = f"{root.rstrip('/')}/vectors-{hashlib.sha256(text.encode()).hexdigest()}"
    reused = stored(spark, path, text)
    if not reused:
        rows = unit(vectors, "doc_id", "v")
        centroids = fitted(rows, info["rows"]) if info["rows"] else np.zeros((0, info["dimension"]))
        key = vectors.schema["doc_id"].dataType.simpleString()

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                cosine = as_matrix(b["v"]) @ centroids.T if len(b) else np.zeros((0, 1))
                best = cosine.argmax(axis=1) if len(b) else np.zeros(0, int)
                yield b.assign(list=best.astype("int32"), angle=np.arccos(np.clip(cosine[np.arange(len(b)), best], -1, 1)))

        # a list that holds many rows spreads over many ranges; a search for few lists skips row groups by their bounds
        dealt = rows.mapInPandas(assign, f"doc_id {key}, v array<double>, list int, angle double").repartitionByRange("list", "doc_id").sortWithinPartitions("list", "doc_id")
        dealt.write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "list int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        spark.createDataFrame([(text,)], "info string").coalesce(1).write.mode("overwrite").parquet(f"{path}/info")
    rows = spark.read.parquet(f"{path}/rows")
    kept = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # LISTS at most
    lists = cut(rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")), "lists")
    return VectorIndex(rows, lists, np.array([r["c"] for r in kept]).reshape(len(kept), info["dimension"]), info, reused)


def best(scores: np.ndarray, ids: np.ndarray, own: object, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best of one query; ids ascend, so a stable sort ranks ties by id."""
    s = np.where(ids == own, -np.inf, scores)
    at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
    at = at[np.argsort(-s[at], kind="stable")][:k]
    at = at[np.isfinite(s[at])]
    return at, s[at]


def scored(index: VectorIndex, probes: DataFrame, k: int, key: str, qkey: str) -> DataFrame:
    """(query_id, doc_id, score): the k best of each block for probes (query_id, q, list)."""

    def parts(n: Column, size: int) -> Column:
        return F.ceil(n / size).cast("int")

    # one row a list, LISTS at most
    sizes = index.lists.join(probes.groupBy("list").agg(F.count("*").alias("asked")), "list").select("list", parts(F.col("n"), BLOCK).alias("parts"), parts(F.col("asked"), QUERY_BLOCK).alias("qparts"))
    sizes = F.broadcast(cut(sizes, "sizes"))

    def dealt(df: DataFrame, by: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        d = df.join(sizes, "list").withColumn(own, F.pmod(F.xxhash64(by), F.col(own_n)).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).drop("parts", "qparts")

    rows = dealt(index.rows.select("doc_id", "v", "list"), "doc_id", "part", "parts", "qpart", "qparts")
    asked = dealt(probes.select("query_id", "q", "list"), "query_id", "qpart", "qparts", "part", "parts")

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": b["query_id"][:0], "doc_id": a["doc_id"][:0], "score": np.zeros(0)})
        a = a.sort_values("doc_id", kind="stable")
        ids, s = a["doc_id"].to_numpy(), np.round(as_matrix(b["q"]) @ as_matrix(a["v"]).T, 6)
        found = [best(s[i], ids, q, k) for i, q in enumerate(b["query_id"])]
        return pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), [len(at) for at, _ in found]), "doc_id": ids[np.concatenate([at for at, _ in found])], "score": np.concatenate([x for _, x in found])})

    by = ["list", "part", "qpart"]
    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(block, f"query_id {qkey}, doc_id {key}, score double")


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine for queries (query_id, q); a row whose id is the query's own is no hit.

    exact: after the nearest `probes` lists, all lists whose bound reaches the k-th score so far are read too, so that the result is
    that of comparing everything. Else the nearest lists decide alone.
    """
    key, qkey = index.rows.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    asked = cut(unit(queries, "query_id", "q"), "asked")
    if (low := asked.agg(F.min(F.size("q")), F.max(F.size("q"))).first()) and low[0] is not None and len(index.centroids) and {*low} != {index.info["dimension"]}:
        raise ValueError(f"queries of {low[0]} to {low[1]} dimensions, vectors of {index.info['dimension']}")
    centroids = index.centroids
    n = min(probes, len(centroids))
    radius = np.full(len(centroids), -np.inf)  # lists without rows stay out
    for r in index.lists.select("list", "radius").collect():  # LISTS at most
        radius[r["list"]] = r["radius"]

    def nearest(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        cosine = np.clip(as_matrix(b["q"]) @ centroids.T, -1, 1)
        cosine[:, ~np.isfinite(radius)] = -2
        return cosine, np.argsort(-cosine, axis=1, kind="stable")[:, :n]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and n:
                _, near = nearest(b)
                yield b.iloc[np.repeat(np.arange(len(b)), n)].assign(list=near.ravel().astype("int32"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and n:
                cosine, near = nearest(b)
                bound = np.cos(np.maximum(0, np.arccos(np.maximum(cosine, -1)) - radius))
                open_ = (bound >= b["least"].to_numpy()[:, None] - SLACK) & np.isfinite(radius)
                np.put_along_axis(open_, near, False, axis=1)
                at, which = np.nonzero(open_)
                yield b[["query_id", "q"]].iloc[at].assign(list=which.astype("int32"))

    form = f"query_id {qkey}, q array<double>, list int"
    found = scored(index, cut(asked.mapInPandas(first, form), "probes"), k, key, qkey)
    if exact:
        found = cut(ranked(found, k), "nearest")
        least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = asked.join(least, "query_id", "left").fillna(-2.0, ["least"]).mapInPandas(others, form)
        found = found.drop("rank").unionByName(scored(index, cut(rest, "others"), k, key, qkey))
    return ranked(found, k)
