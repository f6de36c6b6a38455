"""Stored inverted index with scores of blocks, and top-k searches that leave out what can't matter.

A term's documents are dealt by hash into blocks of about BLOCK postings, one row each, which knows its best score; a term knows
the best of all. A search first sums the rarest terms of a query, whose k-th sum is a lower bound of its k-th score. Terms whose
best scores together stay below that bound can't bring a document in by themselves: their blocks are opened only for documents
that other terms brought in, and of these only where the block's best score can still lift one over the bound. All scores
that are returned are whole, so the result is that of scoring every document.

Null texts are empty, documents and queries without terms have no hits, equal scores are ranked by id, null ids are left out,
other columns are not read; a long text is only more postings, as counts are made by (term, document) before anything meets.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.retrieval import K1, B, ranked, tokens
from emberlog.session import cut, cut_to, free, spread

#: Postings of a block, about; postings of a query's rarest terms that the first bound is made of, about, for each hit wanted.
BLOCK, FIRST = 512, 20
#: Terms at most whose statistics are sent to all tasks (some 60 MB).
TERMS = 500_000
#: Scores are rounded to 6 places.
SLACK = 2e-6
WORD = r"[\p{L}\p{N}_]"


def option_tokens(text: Column) -> Column:
    """Options of commands as written (`-T` and `-t` differ), paths, addresses and joined words as one, all else in lower case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"--?[A-Za-z](?:{WORD}|-)*+|{WORD}++(?:[./:@-]{WORD}++)*+"), F.lit(0))
    return F.transform(found, lambda t: F.when(t.startswith("-"), t).otherwise(F.lower(t)))


@cache
def expansions() -> tuple[tuple[str, str], ...]:
    rules = yaml.safe_load((Path(__file__).parents[1] / "plans" / "expansions.yml").read_text(encoding="utf-8"))
    return tuple((("(?U)" if r.get("case") else "(?iU)") + r["says"], r["adds"]) for r in rules)


def search_text(*parts: Column) -> Column:
    """The observed parts by lines, and each expansion that they call for on a line of its own, once and in the order of the rules."""
    observed = F.concat_ws("\n", *(F.coalesce(p, F.lit("")) for p in parts))
    added = [F.when(observed.rlike(says), F.lit(adds)) for says, adds in expansions()]
    return F.concat_ws("\n", observed, F.array_distinct(F.array_compact(F.array(*added))))


def share(tf: Column, length: Column, average: Column | float) -> Column:
    """What a term's count in a document gives, before the weight of the term."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


@dataclass(frozen=True)
class TextIndex:
    blocks: DataFrame  # term, block, top (without idf), postings: array of (doc_id, tf, len)
    terms: DataFrame  # term, df, parts (blocks), idf, top, average (length of all documents)
    words: Callable[[Column], Column]
    info: dict
    reused: bool


def build(docs: DataFrame, root: str, identity: dict, words: Callable[[Column], Column] = tokens) -> TextIndex:
    """The index of docs (doc_id, text) below root; made only if the one of the same texts, identity and tokenizer isn't there, whole."""
    spark = docs.sparkSession
    d = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.bit_xor(F.xxhash64("text", "doc_id")), F.lit(0)).alias("xor")).first()
    info = {"identity": identity, "words": words.__name__, "k1": K1, "b": B, "block": BLOCK, **own.asDict()}
    text = json.dumps(info, sort_keys=True)
    path = f"{root.rstrip('/')}/texts-{hashlib.sha256(text.encode()).hexdigest()}"
    try:
        reused = [r["info"] for r in spark.read.parquet(f"{path}/info").limit(2).collect()] == [text]
    except AnalysisException:
        reused = False
    if not reused:
        # texts are dealt by id and cut into words once (of explode() Spark makes a filter, so that they would be cut before they are dealt, too); a document's words are counted where it is, postings are not shuffled for it
        w = spread(d, "doc_id").select("doc_id", words(F.col("text")).alias("w"))
        counted = w.select("doc_id", F.size("w").alias("len"), F.explode_outer("w").alias("term")).where("term is not null").groupBy("term", "doc_id", "len").agg(F.count("*").cast("int").alias("tf"))
        counted = cut(counted, "counted")
        average = (counted.agg(F.sum("tf")).first()[0] or 0) / max(own["n"], 1) or 1.0
        stats = counted.groupBy("term").agg(F.count("*").alias("df")).withColumn("parts", F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("df") / BLOCK)))).cast("long"))
        stats = cut(stats, "stats")
        # few enough terms go to all tasks, else a join spreads postings by term, where adaptive execution splits frequent ones
        known = F.broadcast(stats) if stats.count() <= TERMS else stats
        dealt = counted.join(known, "term").select("term", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("block"), "doc_id", "tf", "len")
        packed = dealt.groupBy("term", "block").agg(F.max(share(F.col("tf"), F.col("len"), average)).alias("top"), F.collect_list(F.struct("doc_id", "tf", "len")).alias("postings"))
        cut_to(packed.sortWithinPartitions("term", "block"), f"{path}/blocks")
        free(counted)
        tops = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.max("top").alias("top"))
        idf = F.log(1 + (own["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        cut_to(stats.join(tops, "term").select("term", "df", "parts", idf.alias("idf"), (idf * F.col("top")).alias("top"), F.lit(average).alias("average")), f"{path}/terms")
        free(stats)
        spark.createDataFrame([(text,)], "info string").coalesce(1).write.mode("overwrite").parquet(f"{path}/info")
    return TextIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"), words, info, reused)


def part() -> Column:
    return (F.col("idf") * share(F.col("tf"), F.col("len"), F.col("average"))).alias("part")


def opened(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id, part) of all postings of wanted (query_id, term, idf, average)."""
    hit = index.blocks.select("term", "postings").join(wanted.select("query_id", "term", "idf", "average"), "term")
    return hit.select("query_id", "idf", "average", F.inline("postings")).select("query_id", "doc_id", part())


def kth(scores: DataFrame, k: int, name: str) -> DataFrame:
    """(query_id, name): the k-th largest sum of each query with so many."""
    return ranked(scores, k).where(F.col("rank") == k).select("query_id", F.col("score").alias(name))


def search(index: TextIndex, queries: DataFrame, k: int = 50, measured: dict | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) for queries (query_id, text); a query's words count once.

    measured, if given, takes the number of postings of all query terms (`all`) and of those that were opened (`opened`).
    """
    asked = queries.where("query_id is not null").select("query_id", F.explode(F.array_distinct(index.words(F.coalesce("text", F.lit(""))))).alias("term")).distinct()
    # terms of a query from the best score down; rest: what this one and all after it can add at most
    down = Window.partitionBy("query_id").orderBy(F.desc("top"), "term")
    t = asked.join(index.terms, "term").withColumns({
        "before": F.coalesce(F.sum("df").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "rest": F.sum("top").over(down.rowsBetween(0, Window.unboundedFollowing)),
    })
    t = cut(t, "query-terms")
    sums = lambda parts: parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    least = kth(sums(opened(index, t.where(F.col("before") < FIRST * k))), k, "least")
    # a query without a bound opens all of its terms
    t = cut(t.join(least, "query_id", "left").withColumn("leads", F.col("least").isNull() | (F.col("rest") >= F.col("least") - SLACK)), "led-terms")
    found = cut(sums(opened(index, t.where("leads"))), "led")
    follow = t.where("not leads").select("query_id", "term", "parts", "idf", "average", "top")
    most = follow.groupBy("query_id").agg(F.sum("top").alias("most"))
    # the bound from the sums of the leading terms is at least as high
    bound = found.join(kth(found, k, "bound"), "query_id", "left").join(most, "query_id", "left").fillna(0.0, ["most"])
    kept = cut(bound.where(F.col("bound").isNull() | (F.col("score") + F.col("most") >= F.col("bound") - SLACK)).select("query_id", "doc_id", "score", "bound"), "kept")
    # following terms: each document's own block of each, first by the block's best score, then opened
    place = kept.join(follow.drop("top", "average"), "query_id").select("query_id", "doc_id", "score", "bound", "term", "idf", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("block"))
    tops = place.join(index.blocks.select("term", "block", "top"), ["term", "block"])
    able = tops.groupBy("query_id", "doc_id", "score", "bound").agg(F.sum(F.col("idf") * F.col("top")).alias("most")).where(F.col("bound").isNull() | (F.col("score") + F.col("most") >= F.col("bound") - SLACK))
    able = cut(able.select("query_id", "doc_id"), "able")
    pairs = able.join(follow, "query_id").select("query_id", "doc_id", "term", "idf", "average", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("block"))
    pairs = cut(pairs, "pairs")
    needed = index.blocks.select("term", "block", "postings").join(pairs.select("term", "block").distinct(), ["term", "block"])
    more = pairs.join(needed.select("term", F.inline("postings")), ["term", "doc_id"]).select("query_id", "doc_id", part())
    if measured is not None:
        measured["all"] = t.agg(F.sum("df")).first()[0] or 0
        measured["opened"] = (t.where("leads").agg(F.sum("df")).first()[0] or 0) + (needed.agg(F.sum(F.size("postings"))).first()[0] or 0)
    whole = sums(kept.select("query_id", "doc_id", F.col("score").alias("part")).unionByName(more))
    return ranked(whole.withColumn("score", F.round("score", 6)), k)
