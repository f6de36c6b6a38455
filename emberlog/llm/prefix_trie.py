"""Conversation prefix trie (12): heavy-path decomposition.

Nodes are the distinct prefixes of conversations. A node's largest child (most members) is heavy; paths of heavy
children start at the root and at every light child. As a light child has at most half of its parent's members, at most
log2(conversations) light children lie above any node. Sums over subtrees therefore take so many rounds at most: the
paths below most light children are summed from their ends upwards first, and the sums of their heads are added to the
heads' parents, which lie on paths of the next round.

No conversation, path or node is gathered in one row or task: sequences are scanned in chunks of CHUNK places whose
totals are scanned in turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import words
from emberlog.session import cut, free

CHUNK = 4096
#: Characters of a list of ids that are passed on in one row.
PIECE = 1 << 16
#: A conversation takes up to HEADS - 1 turns over from the first one of its SHARE neighbours.
SHARE, HEADS = 20, 4


def running(rows: DataFrame, key: list[str], place: str, specs: dict[str, tuple[Callable[[Column], Column], Column, Callable[[Column, Column], Column]]], backwards: bool = False) -> DataFrame:
    """rows with running aggregates along `place` within each key (from the last place if backwards).

    specs: name -> (aggregate function, column, function that joins two of its results). The windows hold CHUNK places
    each; where a key has more, the totals of the chunks before are joined. rows should be a table that is written.
    """
    chunked = rows.withColumn("_chunk", F.floor(F.col(place) / CHUNK))
    order = (lambda c: F.desc(c)) if backwards else (lambda c: F.asc(c))
    inside = Window.partitionBy(*key, "_chunk").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    out = chunked.withColumns({name: f(c).over(inside) for name, (f, c, _) in specs.items()})
    if not rows.where(F.col(place) >= CHUNK).limit(1).count():
        return out.drop("_chunk")
    before = Window.partitionBy(*key).orderBy(order("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy(*key, "_chunk").agg(*(f(c).alias(name) for name, (f, c, _) in specs.items()))
    totals = totals.select(*key, "_chunk", F.lit(True).alias("_later"), F.row_number().over(Window.partitionBy(*key).orderBy(order("_chunk"))).alias("_nth"), *(f(F.col(name)).over(before).alias(f"_{name}") for name, (f, _, _) in specs.items()))
    both = out.join(totals.where("_nth > 1").drop("_nth"), [*key, "_chunk"], "left")
    both = both.withColumns({name: F.when(F.col("_later"), join(F.col(f"_{name}"), F.col(name))).otherwise(F.col(name)) for name, (_, _, join) in specs.items()})
    return both.drop("_chunk", "_later", *(f"_{name}" for name in specs))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, sha, n_words) with places from 0 on in the order of (turn, role, text), and (conv_id, n_turns).

    Turns are sorted globally and counted within partitions, so that one conversation may fill many of these; only the
    first conversation of a partition can have begun earlier, so there is at most one correction for each partition.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    sha = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    dealt = dealt.select("conv_id", sha.alias("sha"), F.size(words(F.col("text"))).cast("long").alias("n_words"), F.spark_partition_id().alias("part"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            place = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == last:
                place[: first[1] if len(first) > 1 else None] += n
            last, n = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "inner"])

    found = cut(dealt.mapInArrow(counted, "conv_id long, sha string, n_words long, part int, inner long"), "turns")
    stats = cut(found.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "stats")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = stats.withColumn("before", before).where("before is not null").select("conv_id", "part", "before")
    placed = found.join(F.broadcast(later), ["conv_id", "part"], "left")  # a row for each partition at most
    return placed.select("conv_id", (F.col("inner") + F.coalesce("before", F.lit(0))).alias("place"), "sha", "n_words"), stats.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))


def heads(conv_id: Column) -> Column:
    """Turns that a conversation takes over: CRC-32 of the decimal id, modulo HEADS."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, sha, n_words) of all conversations with their first turns taken over, and all (conv_id)."""
    placed, convs = numbered(turns)
    placed, convs = cut(placed, "placed"), cut(convs, "convs")
    base = F.col("conv_id") - F.col("conv_id") % SHARE
    own = convs.select("conv_id", heads(F.col("conv_id")).alias("h"), base.alias("base"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    own = own.where("h > 0").join(sizes, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("taken"))
    own = cut(own, "own")
    first = own.join(placed.where(F.col("place") < HEADS - 1).withColumnRenamed("conv_id", "base"), "base").where("place < h").select("conv_id", "place", "sha", "n_words")
    # only where the base is shorter than h the own turns move
    moved = own.where("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("less"))
    rest = placed.where(F.col("place") >= heads(F.col("conv_id"))).join(moved, "conv_id", "left").select("conv_id", (F.col("place") - F.coalesce("less", F.lit(0))).alias("place"), "sha", "n_words")
    return first.unionByName(rest), convs.select("conv_id")


def keyed(rows: DataFrame) -> DataFrame:
    """rows with their node's key (k1, k2) and its parent's (p1, p2): sums without carry of hashes of all (place, turn) so far."""
    own = cut(rows.withColumns({"t1": F.xxhash64("sha", "place"), "t2": F.xxhash64("place", "sha", F.lit(12))}).drop("sha"), "rebuilt")
    xor = lambda a, b: a.bitwiseXOR(b)
    found = running(own, ["conv_id"], "place", {"k1": (F.bit_xor, F.col("t1"), xor), "k2": (F.bit_xor, F.col("t2"), xor)})
    return found.select("conv_id", "place", "n_words", "k1", "k2", xor(F.col("k1"), F.col("t1")).alias("p1"), xor(F.col("k2"), F.col("t2")).alias("p2"))


def id_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of each node's ids, ascending, joined by commas.

    Ids are sorted over all tasks and joined to strings there; a node's strings then pass through one hash in their
    order, a batch at a time, as SHA-256 can't be split.
    """

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rows = None, []
            for k1, k2, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (k1, k2) != key or rows[-1][4] > PIECE:
                    key = (k1, k2)
                    rows.append([k1, k2, c, [], 0])
                rows[-1][3].append(text := str(c))
                rows[-1][4] += len(text) + 1
            if rows:
                yield pa.RecordBatch.from_pydict({"k1": pa.array([r[0] for r in rows], pa.int64()), "k2": pa.array([r[1] for r in rows], pa.int64()), "first": pa.array([r[2] for r in rows], pa.int64()), "ids": pa.array([",".join(r[3]) for r in rows])})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k1, k2, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (k1, k2) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            yield _digest_rows(out)
        yield _digest_rows([(*key, state.hexdigest())] if key else [])

    parts = ends.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").select("k1", "k2", "conv_id").mapInArrow(strings, "k1 long, k2 long, first long, ids string")
    return parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k1": pa.array([r[0] for r in rows], pa.int64()), "k2": pa.array([r[1] for r in rows], pa.int64()), "ends_sha256": pa.array([r[2] for r in rows], pa.string())})


def decomposed(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes with n_children, the head (h1, h2) of their heavy path and the light nodes above and on them."""
    best = F.max(F.struct(F.col("n_convs"), (-F.col("conv_id")).alias("c"), F.col("k1"), F.col("k2"))).alias("best")
    families = cut(nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), best), "families")
    heavy = families.select(F.col("best.k1").alias("k1"), F.col("best.k2").alias("k2"), F.lit(False).alias("light"))
    light = nodes.where("depth > 0").join(heavy, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(True).alias("light"))
    # every node lies on the sequence of its smallest member, with all nodes above it
    shown = nodes.where("depth > 0").select("conv_id").distinct()
    seen = cut(turns.join(shown, "conv_id", "left_semi").join(light, ["k1", "k2"], "left").select("conv_id", "place", "k1", "k2", F.coalesce("light", F.lit(False)).alias("light")), "seen")
    head = (F.max, F.when(F.col("light"), F.struct("place", "k1", "k2")), lambda a, b: F.greatest(a, b))
    above = (F.sum, F.col("light").cast("long"), lambda a, b: a + b)
    along = running(seen, ["conv_id"], "place", {"head": head, "lights": above}).select("conv_id", (F.col("place") + 1).alias("depth"), "lights", F.coalesce(F.col("head.k1"), F.lit(0)).alias("h1"), F.coalesce(F.col("head.k2"), F.lit(0)).alias("h2"))
    children = families.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    zero = F.lit(0).cast("long")
    found = nodes.join(along, ["conv_id", "depth"], "left").join(children, ["k1", "k2"], "left")
    return found.select("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "n_words", F.coalesce("n_children", zero).alias("n_children"), *(F.coalesce(x, zero).alias(x) for x in ("h1", "h2", "lights")))


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(k1, k2, n_leaves, saved_tokens) over each node's subtree, in one round for each number of light nodes above."""
    own = nodes.select("k1", "k2", "p1", "p2", "h1", "h2", "depth", "lights", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"))
    most = own.agg(F.max("lights")).first()[0] or 0
    add = lambda a, b: a + b
    rounds, given = [], None
    for r in range(most, -1, -1):
        level = own.where(F.col("lights") == r)
        if given is not None:
            level = level.join(given, ["k1", "k2"], "left")
            level = level.withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}).drop("more_leaves", "more_saved")
            level = cut(level, "level")
        sums = running(level, ["h1", "h2"], "depth", {"n_leaves": (F.sum, F.col("leaves"), add), "saved_tokens": (F.sum, F.col("saved"), add)}, backwards=True)
        sums = cut(sums.select("k1", "k2", "p1", "p2", "n_leaves", "saved_tokens", ((F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))).alias("head")), "sums")
        given = sums.where("head").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        rounds.append(sums.select("k1", "k2", "n_leaves", "saved_tokens"))
    out = rounds[0]
    for x in rounds[1:]:
        out = out.unionByName(x)
    return out


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    Conversation c gets the first h turns of conversation c - c % 20 in place of its own first h, h being the CRC-32 of
    its decimal id modulo 4. Turns are ordered by (turn, role, text), nulls first; a null role or text is empty; rows
    without conv_id belong to none and are left out. Repeated rows and turns of one number are turns of their own. A
    conversation that has no turns left is a member of the root. Returns a row for each node: conv_id (its smallest
    member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256; an
    empty table gives none. Columns other than conv_id, turn, role and text are not read.
    """
    rows, convs = rebuilt(turns)
    along = cut(keyed(rows), "keyed")
    inner = along.groupBy("k1", "k2").agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("conv_id").alias("conv_id"), (F.first("place") + 1).alias("depth"), F.count("*").alias("n_convs"), F.first("n_words").alias("n_words"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("n_words"))
    nodes = cut(inner.unionByName(root), "nodes")
    full = cut(decomposed(nodes, along), "decomposed")
    last = along.groupBy("conv_id").agg(F.max(F.struct("place", "k1", "k2")).alias("last")).select("conv_id", "last.k1", "last.k2")
    turnless = convs.join(last.select("conv_id"), "conv_id", "left_anti").select("conv_id", zero.alias("k1"), zero.alias("k2"))
    ends = id_digests(last.unionByName(turnless))
    top = full.where("depth = 0").select(F.col("conv_id").alias("top"))
    parents = full.where("depth > 0 and n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    found = full.join(subtree_sums(full), ["k1", "k2"]).join(ends, ["k1", "k2"], "left").join(F.broadcast(top), F.lit(True))
    deep = found.where("depth > 1").join(parents, ["p1", "p2"])
    shallow = found.where("depth < 2").withColumn("parent", F.when(F.col("depth") == 1, F.col("top")))
    out = deep.unionByName(shallow.select(*deep.columns))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
