"""Exact dedup (1): tree-merge of sorted digest runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import ASCII_BLANKS, attach, fresh, own_columns
from emberlog.session import cut

#: Runs that one merge brings together: four binomial rounds at once.
FAN_IN_BITS = 4


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row for each document: the run (input partition) that it belongs to, SHA-256 of the text without ASCII
    white space, a second check value, and its rank among equals."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.translate(text, ASCII_BLANKS, "")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.sha2(bare, 256).alias("digest"),
        F.xxhash64(bare, F.octet_length(bare)).alias("proof"), F.char_length(text).alias("chars"),
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row_id"),
    )


def tree_merge(rows: DataFrame, runs: int) -> DataFrame:
    """Merge the partitions' digest runs, 2**FAN_IN_BITS at a time, until one run is left.

    Each level groups by (run, digest, proof): the struct minimum makes Spark aggregate over sorted rows, first inside
    each partition (so a run carries a digest once, whatever the number of its copies), then over the sorted runs that
    meet. Equal digests merge only if the proof values are equal too. A level's rows are dealt by digest, so the last
    run, too, is spread over all tasks and never lies in one of them.
    """
    best = F.struct((-F.col("chars")).alias("rank"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("order_id"), F.col("row_id"), F.col("doc_id"))
    level = rows.select("digest", "proof", best.alias("best"), F.lit(1).cast("long").alias("n"), "run")
    for _ in range(max(1, math.ceil(math.log2(max(2, runs)) / FAN_IN_BITS))):
        level = level.groupBy(F.shiftright("run", FAN_IN_BITS).alias("run"), "digest", "proof").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return level.select("digest", "proof", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """Decide for every document which of the equal ones stays.

    Texts are equal when identical without the characters space, tab, line feed, vertical tab, form feed and carriage
    return; null counts as empty, so all empty and null texts form one group. The one with most code points in its
    original text stays, then the smallest id (null ids last), then, among repeated rows, the first read. Returns
    (doc_id, keep_id, group_size, kept, text_sha256), a row for each input row; an empty table gives none. Other
    columns of docs are not read, whatever their names.
    """
    rows = cut(digests(docs, id_col, text_col), "digests")
    runs = rows.agg(F.max("run").alias("m")).first()["m"]
    groups = cut(tree_merge(rows, (runs or 0) + 1), "groups")
    total = rows.count()
    key = F.concat_ws(":", "digest", "proof")
    found = attach(rows.select("doc_id", "digest", "row_id", *more, key.alias("key")), groups.where("group_size > 1").select(key.alias("key"), "keep_id", "keep_row", "group_size"), "key", "group_size", total)
    single = F.col("group_size").isNull()
    return found.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row_id") == F.col("keep_row"))).alias("kept"), F.col("digest").alias("text_sha256"), *more,
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Rows are found again by id, digest and length; only where these repeat (rows read twice) one of them is picked.
    """
    sha, chars, nth, keep_id, keep_sha, keep_chars = (fresh(docs, x) for x in ("_sha", "_chars", "_nth", "_keep_id", "_keep_sha", "_keep_chars"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.withColumns({sha: F.sha2(F.translate(text, ASCII_BLANKS, ""), 256), chars: F.char_length(text)})
    found = exact_dedup(docs, id_col, text_col, more=("chars",))
    keep = cut(found.groupBy(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_sha), F.col("chars").alias(keep_chars)).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept"), "kept")

    def of(wanted: DataFrame) -> DataFrame:
        same = F.col(id_col).cast("long").eqNullSafe(F.col(keep_id)) & (F.col(sha) == F.col(keep_sha)) & (F.col(chars) == F.col(keep_chars))
        return named.join(wanted.select(keep_id, keep_sha, keep_chars), same, "left_semi")

    once = of(keep.where("n = 1"))
    if keep.where("n > 1").limit(1).count():
        again = of(keep.where("n > 1")).withColumn(nth, F.row_number().over(Window.partitionBy(id_col, sha).orderBy(chars)))
        once = once.unionByName(again.where(F.col(nth) == 1).drop(nth))
    return once.select(*own_columns(docs))
