"""Ranked retrieval: BM25, vectors and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B, RRF_K = 1.5, 0.75, 20


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, doc_id, score, rank) from docs (doc_id, text) and queries (query_id, text); a query's words count once.

    Postings are built for the queries' words only; a query word that many documents hold is spread by the join on term
    and document, as counts are made by document before it.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    d = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("w"))
    stats = d.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("avg_len"))
    postings = d.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    hits = postings.join(df, "term").join(F.broadcast(stats)).select("term", "doc_id", weight.alias("part"))
    scores = hits.join(terms, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return ranked(scores, k)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Vectors of a block, and queries of a block and of a turn of it.
BLOCK, TURN = 4096, 256


def _plain(vectors: DataFrame, queries: DataFrame) -> bool:
    """Whether ids are whole numbers and all vectors of one length, without gaps, and not zero, so that matrices hold them."""
    whole = all(isinstance(d.schema[c].dataType, (T.LongType, T.IntegerType)) for d, c in ((vectors, "doc_id"), (queries, "query_id")))
    if not whole or not all(isinstance(d.schema[c].dataType, T.ArrayType) and isinstance(d.schema[c].dataType.elementType, (T.FloatType, T.DoubleType)) for d, c in ((vectors, "v"), (queries, "q"))):
        return False
    x = vectors.select(F.col("v").cast("array<double>").alias("x")).unionByName(queries.select(F.col("q").cast("array<double>").alias("x")))
    gaps = F.coalesce(F.exists("x", lambda y: y.isNull() | F.isnan(y)) | ~F.exists("x", lambda y: F.abs(y) > 1e-100), F.lit(True))
    n = x.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), F.count_if(gaps).alias("gaps")).first()
    return n["low"] == n["high"] and not n["gaps"]


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """(name_ids, name_data) of (id, vector) rows: blocks of rows as matrices."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                data = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").tobytes()
                yield pa.RecordBatch.from_pydict({f"{name}_ids": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), f"{name}_data": pa.array([data], pa.binary())})

    i, x = rows.columns
    return rows.where(F.col(i).isNotNull()).select(F.col(i).cast("long"), x).mapInArrow(pack, f"{name}_ids array<long>, {name}_data binary")


def _block_scores(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score) of the k best of each block of vectors, for every query, by products of matrices."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ids, data, of, asked = (batch.column(c)[n].as_py() for c in range(4))
                ids, of = np.array(ids, "int64"), np.array(of, "int64")
                v, q = np.frombuffer(data).reshape(len(ids), -1), np.frombuffer(asked).reshape(len(of), -1)
                size, want = (v * v).sum(1), (q * q).sum(1)
                for t in range(0, len(of), TURN):
                    score = np.floor(q[t : t + TURN] @ v.T / np.sqrt(want[t : t + TURN, None] * size) * 1e6 + 0.5) / 1e6
                    score[of[t : t + TURN, None] == ids] = -np.inf
                    least = np.partition(score, -k, 1)[:, -k] if k < len(ids) else np.full(len(score), -9.0)
                    row, col = np.nonzero((score >= least[:, None]) & (score > -9))
                    found = np.lexsort((ids[col], -score[row, col], row))
                    row, col = row[found], col[found]
                    near = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, col = row[near], col[near]
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(of[t + row], pa.int64()), "doc_id": pa.array(ids[col], pa.int64()), "score": pa.array(score[row, col], pa.float64())})

    spread = _packed(vectors.select("doc_id", "v"), "v").repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = spread.crossJoin(F.broadcast(_packed(queries.select("query_id", "q"), "q")))
    found = pairs.mapInArrow(best, "query_id long, doc_id long, score double")
    return found.select(F.col("query_id").cast(queries.schema["query_id"].dataType), F.col("doc_id").cast(vectors.schema["doc_id"].dataType), "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine from vectors (doc_id, v) and queries (query_id, q), a stated set that is broadcast.

    Every pair is scored, a block of vectors and one of queries at a time, and only the k best of a block leave it; vectors
    that no matrix holds (gaps, several lengths, zero) are compared pair by pair.
    """
    if _plain(vectors, queries):
        return ranked(_block_scores(vectors, queries, k), k)
    cosine = dot(F.col("v"), F.col("q")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("q"), F.col("q")))
    pairs = vectors.join(F.broadcast(queries), F.col("doc_id") != F.col("query_id"))
    return ranked(pairs.select("query_id", "doc_id", F.round(cosine, 6).alias("score")), k)


def fused(lists: list[DataFrame], k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, doc_id, rank) lists; of equal sums the best single rank, then the id comes first."""
    every = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "doc_id", "rank"))
    s = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "best", "doc_id")
    return s.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")
