"""N-gram Jaccard join (7): adaptive multi-match prefixes.

Two sets with Jaccard similarity of at least 0.8 share at least a(n) = ceil(0.8 n) elements of either set of n. With all
elements in one global order, such sets share at least k elements among the first n - a(n) + k of each, for every k. The
join therefore looks at prefixes only; a document with costly prefix elements takes a longer prefix and asks for more
shared elements (its level k) before a pair is verified. A pair uses the smaller of its two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import attach, fresh, most_frequent, own_columns
from emberlog.llm.shingles import sets_of, signatures
from emberlog.operators.components import connected_components
from emberlog.session import cut, free

#: Jaccard similarity as a fraction.
NUM, DEN = 4, 5
LEVELS = 6
#: Cost of verifying a pair, in posting reads.
VERIFY_COST = 24
#: Frequent shingles that are broadcast (3 MB, at any corpus size), shingles a task holds at once, and shingles in a bucket.
FREQUENT, COUNTED, BUCKET = 200_000, 1_000_000, 500_000
#: The part of a shingle's hash that names its bucket, and a count above that of any other than a frequent shingle.
LOW_BITS, LOW, RARE = 24, (1 << 24) - 1, 1 << 40
#: Lists of more than LIST documents with one shingle are compared in square blocks of at most so many documents and
#: shingles (and one document more).
LIST, BLOCK, BLOCK_SHINGLES = 96, 256, 200_000
#: Bits of the broadcast filter for the documents whose sets are read again (4 MB); more documents only let more pass.
FILTER_BITS = 25


def _least_shared(n: np.ndarray | int):
    return (NUM * n + DEN - 1) // DEN


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64), pa.int64())


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its set's size and signature; and shingles that a few of the task's documents share."""
    held: list[np.ndarray] = []
    size = 0

    def shared() -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, int))
        u, n = u[n >= 3], n[n >= 3]
        none = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), _signed(u), none, pa.array(np.ones(len(u), bool))], ["doc_id", "n", "sig", "sig2", "counts"])

    for rows, batch, sets in sets_of(batches, 1):
        sigs = signatures(sets)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs[:, 0]), pa.array(sigs[:, 1]), pa.array(np.zeros(len(rows), bool))],
            ["doc_id", "n", "sig", "sig2", "counts"],
        )
        held += [s for s in sets if len(s)]
        size += sum(map(len, sets))
        if size >= COUNTED:
            yield shared()
            held, size = [], 0
    yield shared()


def _bytes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each number, one after the other."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _numbers(blobs: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1)


#: Rows between the steps of _postings. kind 0: the shingles of one lot of documents in one bucket (which, number of the
#: document in its lot; what, shingle; count, documents that hold it). kind 1: a lot's documents (what, signature; count,
#: set size), and kind 2: their frequent shingles.
PACKED = "bucket long, lot long, kind int, which binary, what binary, count binary"
_PACKED = ["bucket", "lot", "kind", "which", "what", "count"]


def _dealt(frequent, buckets: int):
    """Pack each task's sets in lots of documents, and each lot's shingles by bucket; a set that a task has seen goes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = frequent.value
        first_lot = TaskContext.get().partitionId() << 32
        seen: set[int] = set()
        held: list[np.ndarray] = []
        sigs: list[int] = []
        size = lots = 0

        def packed() -> pa.RecordBatch:
            lot = first_lot + lots
            n = np.array([len(x) for x in held], np.int64)
            what = np.concatenate(held)
            which = np.repeat(np.arange(len(held)), n)
            common = np.zeros(len(what), bool)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, what), len(tokens) - 1)
                common = tokens[at] == what
            bucket = (what & np.uint64(LOW)) % np.uint64(buckets)
            what = (what & ~np.uint64(LOW)) | bucket  # the shingle's name from here on: a bucket and 40 bits
            rows = [(lot % buckets, lot, 1, b"", np.array(sigs, np.int64).tobytes(), _bytes(n, 4))]
            rows.append((lot % buckets, lot, 2, _bytes(which[common], 2), _bytes(what[common], 8), _bytes(counts[at[common]] + RARE, 8) if len(tokens) else b""))
            rest = np.flatnonzero(~common)
            rest = rest[np.argsort(bucket[rest], kind="stable")]
            edges = np.flatnonzero(np.diff(bucket[rest])) + 1
            which, name = which[rest], what[rest] >> np.uint64(LOW_BITS)
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rest)], strict=True):
                if b > a:
                    rows.append((int(bucket[rest[a]]), lot, 0, _bytes(which[a:b], 2), _bytes(name[a:b], 5), b""))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], _PACKED)

        for _, _, sets in sets_of(batches, 1):
            for x, sig in zip(sets, signatures(sets)[:, 0].tolist(), strict=True):
                if not len(x) or sig in seen:
                    continue
                seen.add(sig)
                held.append(x)
                sigs.append(sig)
                size += len(x)
                if size >= COUNTED or len(held) == 1 << 16:
                    yield packed()
                    held, sigs, size, lots = [], [], 0, lots + 1
            if len(seen) > 1_000_000:
                seen.clear()
        if held:
            yield packed()

    return run


def _frequencies(t: pa.Table) -> pa.Table:
    """In one bucket: count each shingle's documents; shingles of one document only go, as no pair shares them."""
    kind = t.column("kind").to_numpy()
    mine = np.flatnonzero(kind == 0)
    out = t.filter(pa.array(kind != 0))
    if not len(mine):
        return out
    rows = t.take(pa.array(mine))
    which, what = rows.column("which").to_pylist(), rows.column("what").to_pylist()
    size = np.array([len(x) // 5 for x in what])
    _, inverse, count = np.unique(_numbers(what, 5), return_inverse=True, return_counts=True)
    ends = np.cumsum(size)
    bucket, lots = rows.column("bucket")[0].as_py(), rows.column("lot").to_pylist()
    docs, name, found = _numbers(which, 2), (_numbers(what, 5) << np.uint64(LOW_BITS)) | np.uint64(bucket), []
    many = count[inverse]
    for lot, a, b in zip(lots, (ends - size).tolist(), ends.tolist(), strict=True):
        keep = a + np.flatnonzero(many[a:b] > 1)
        if len(keep):
            found.append((bucket, lot, 0, _bytes(docs[keep], 2), _bytes(name[keep], 8), _bytes(many[keep], 8)))
    if not found:
        return out
    return pa.concat_tables([out, pa.table([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), t.schema, strict=True)], schema=t.schema)])


def _prefixes(t: pa.Table) -> pa.Table:
    """Of one lot of documents: each one's prefix for the highest level, in the order (documents with the shingle, shingle).

    Shingles of one document come first in that order; it is enough to know how many they are.
    """
    kind = t.column("kind").to_numpy()
    of = lambda name, which: t.filter(pa.array(which)).column(name).to_pylist()
    sig, n = np.frombuffer(b"".join(of("what", kind == 1)), np.int64), _numbers(of("count", kind == 1), 4).astype(np.int64)
    doc, token, count = (_numbers(of(name, kind != 1), width).astype(np.int64) for name, width in (("which", 2), ("what", 8), ("count", 8)))
    order = np.lexsort((token, count, doc))
    doc, token = doc[order], token[order]
    shared = np.bincount(doc, minlength=len(n))
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(shared) - shared, shared) + (n - shared)[doc]
    least = _least_shared(n)
    use = pos < (n - least + np.minimum(LEVELS, least))[doc]
    return pa.table({"token": token[use], "sig": sig[doc[use]], "place": (n[doc[use]] << 32) + pos[use]})


def _postings(texts: DataFrame, frequent, shingles: int) -> DataFrame:
    """(token, sig, place): the prefixes' shingles that at least two documents hold; place is set size and position.

    All shingles meet by value in buckets of about BUCKET shingles (packed, 7 bytes each), are counted there, and those
    of two or more documents go home to their lot, where they are put in order. Frequent shingles stay at home, so no
    bucket is hot.
    """
    dealt = texts.mapInArrow(_dealt(frequent, min(LOW, shingles // BUCKET + 1)), PACKED)
    counted = dealt.groupBy("bucket").applyInArrow(_frequencies, PACKED)
    return counted.groupBy("lot").applyInArrow(_prefixes, "token long, sig long, place long")


def _chosen_sets(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bits.value
        seen: set[int] = set()
        for _, _, sets in sets_of(batches, 1):
            out = []
            sigs = signatures(sets)[:, 0]
            bit = sigs & ((1 << FILTER_BITS) - 1)
            hit = (wanted[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
            for k in np.flatnonzero(hit).tolist():
                if len(sets[k]) and (sig := int(sigs[k])) not in seen:
                    seen.add(sig)
                    out.append((sig, sets[k]))
            if len(seen) > 1_000_000:
                seen.clear()
            lengths = np.cumsum([0, *(len(s) for _, s in out)])
            flat = np.concatenate([s for _, s in out]) if out else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), _signed(flat))], ["sig", "shingles"])

    return run


def _linked_in_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """The links between different components in one block, less those that others imply.

    Overlaps of all pairs come from products of 0/1 matrices over the shingles that two or more of the block hold.
    """
    pdf = pdf.drop_duplicates("sig").reset_index(drop=True)
    sets = [np.asarray(x) for x in pdf["shingles"]]
    n = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(sets)), n)
    u, which, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = many[which] > 1
    number = np.cumsum(many > 1) - 1
    who, col = who[use], number[which[use]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int((many > 1).sum()), 8192):
        a, b = np.searchsorted(col, [lo, lo + 8192])
        x = np.zeros((len(sets), 8192), np.float32)
        x[who[a:b], col[a:b] - lo] = 1
        both += x @ x.T
    comp = pdf["comp"].to_numpy()
    link = DEN * both >= NUM * (n[:, None] + n[None, :] - both)
    root = list(range(len(sets)))
    by_comp: dict[int, int] = {}
    for k, c in enumerate(comp):  # what is one component already needs no link
        root[k] = by_comp.setdefault(c, k)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(link, 1))):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((pdf["sig"][i], pdf["sig"][j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _sets_of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(sig, shingles) of the given sets, made from the texts again. A broadcast filter of fixed size thins out what is
    shuffled; the join decides."""
    spark = texts.sparkSession
    ids = cut(ids.toDF("sig").distinct(), "ids")
    word = F.shiftright(F.col("sig").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), 6)
    bits = ids.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(sig & 63 as int))")).alias("bits")).toArrow()
    wanted = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    wanted[bits.column(0).to_numpy()] = bits.column(1).to_numpy().astype(np.uint64)
    chosen = texts.mapInArrow(_chosen_sets(spark.sparkContext.broadcast(wanted)), "sig long, shingles array<long>")
    return chosen.groupBy("sig").agg(F.first("shingles").alias("shingles")).join(ids, "sig", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Each pair moves one set; the other one is met where it lies."""
    one, two = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(DEN * both >= NUM * (F.size("x") + F.size("y") - both)).select("a", "b")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group the documents whose sets of five-word shingles are linked by Jaccard similarity of at least 0.8.

    1. Sizes and signatures of all sets; documents with equal sets become one.
    2. Prefixes in the order (number of documents that hold the shingle, hash), which keeps common passages out of
       them. Shingles of one document only come first and are dropped, as they are in no pair.
    3. Each document is verified against up to two documents that many of its prefix elements name as their centre (the
       one with the element nearest the front). Large groups of near copies become one component here.
    4. All pairs of different components that share enough prefix elements for their level, and whose remaining
       elements can still reach the similarity, are verified; lists over LIST documents in blocks of bounded size.
    Nothing is capped: steps 3 and 4 differ only in the order of work.

    Words are runs without ASCII white space, A-Z lower-cased; fewer than five words form one shingle; null, empty and
    blank texts have no set and link with nothing. Null ids take part in links but are no component's id (unless all are
    null). Returns (doc_id, n_shingles, component_id), a row for each input row; an empty table gives none.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = cut(texts.mapInArrow(_first_pass, "doc_id long, n long, sig long, sig2 long, counts boolean"), "sets")
    rows = first.where("not counts").select("doc_id", "n", "sig", "sig2")
    counts = cut(first.where("counts").groupBy("sig").agg(F.sum("n").alias("n")), "counts")
    top = most_frequent(counts, "n", FREQUENT).toArrow()
    free(counts)
    token, count = (top.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(token.astype(np.uint64))
    frequent = spark.sparkContext.broadcast((token.astype(np.uint64)[order], count[order]))

    groups = cut(rows.where("n > 0").groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("doc"), F.count("*").alias("size")), "groups")
    shingles = groups.agg(F.sum("n")).first()[0] or 0
    # tasks that read equal sets give them once each; a token's rows meet in one place for all that follows
    posts = _postings(texts, frequent, shingles).repartition("token").groupBy("token", "sig").agg(F.min("place").alias("place"))
    by_token = Window.partitionBy("token")
    posts = posts.withColumns({"docs": F.count("*").over(by_token), "pos": F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)), "n": F.shiftright("place", 32)})
    posts = posts.withColumn("centre", F.min(F.struct("pos", "n", "sig")).over(by_token)).where("docs > 1")
    least = F.floor((NUM * F.col("n") + DEN - 1) / DEN)
    level = F.greatest(F.lit(1), F.col("pos") - (F.col("n") - least) + 1).cast("int")
    posts = cut(posts.select("token", "sig", "n", "pos", level.alias("level"), "docs", F.col("centre.sig").alias("centre"), F.col("centre.n").alias("centre_n")), "posts")

    # step 3: the two centres that most of a document's elements name. Only likely ones are tried: as many votes as the
    # highest level asks for, and sizes that allow the similarity. Whatever this leaves out is met in step 4.
    votes = posts.where("sig <> centre").where(DEN * F.least("n", "centre_n") >= NUM * F.greatest("n", "centre_n")).groupBy("sig", "centre").agg(F.count("*").alias("votes"), F.max("n").alias("n"))
    votes = votes.where(F.col("votes") >= F.least(F.lit(LEVELS), F.floor((NUM * F.col("n") + DEN - 1) / DEN)))
    best = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("votes"), "centre"))
    stars = cut(votes.withColumn("nth", best).where("nth <= 2").select(F.col("sig").alias("a"), F.col("centre").alias("b")), "stars")
    links = cut(_verified(stars, _sets_of_ids(texts, stars.select("a").union(stars.select("b")))), "links")
    free(stars)
    comps = connected_components(links)

    # step 4
    rest = posts.drop("centre", "centre_n", "docs").join(comps.withColumnRenamed("vertex", "sig"), "sig", "left").withColumn("comp", F.coalesce("component", "sig")).drop("component")
    rest = rest.withColumns({"low": F.min("comp").over(by_token), "high": F.max("comp").over(by_token), "docs": F.count("*").over(by_token)}).where("low <> high").drop("low", "high")
    rest = cut(rest, "rest")
    free(posts)
    reads = [F.sum(F.when(F.col("level") <= k, F.col("docs"))) for k in range(1, LEVELS + 1)]
    costs = F.array(*(r * (1 + VERIFY_COST / k) for k, r in enumerate(reads, 1)))
    least_n = F.floor((NUM * F.max("n") + DEN - 1) / DEN)
    own = rest.groupBy("sig").agg(costs.alias("costs"), least_n.alias("most")).select("sig", F.least(F.array_position("costs", F.array_min("costs")), "most").cast("int").alias("own"))
    use = rest.join(own, "sig").where("level <= own")
    use = cut(use, "use")
    free(rest)
    small, large = use.where(F.col("docs") <= LIST), use.where(F.col("docs") > LIST)

    l, r = (small.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("sig", "n", "pos", "level", "comp", "own"))) for x in "ab")
    pairs = l.join(r, "token").where("sig_a < sig_b and comp_a <> comp_b and greatest(level_a, level_b) <= least(own_a, own_b)").where(DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b"))
    # what two sets share lies before, at or after a shared element in both
    most = F.least("pos_a", "pos_b") + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    pairs = pairs.where((NUM + DEN) * most >= NUM * (F.col("n_a") + F.col("n_b")))
    pairs = pairs.groupBy(F.col("sig_a").alias("a"), F.col("sig_b").alias("b")).agg(F.count("*").alias("shared"), F.max(F.least("own_a", "own_b")).alias("own"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.min("pos_a").alias("pos_a"), F.min("pos_b").alias("pos_b"))
    reach = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    pairs = pairs.where(F.col("shared") >= F.col("own")).where((NUM + DEN) * reach >= NUM * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    pairs = cut(pairs, "pairs")

    # shingles of one passage have the same list; one of each such set of lists finds all its pairs
    lists = large.groupBy("token").agg(F.count("*").alias("n_docs"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("y"))
    large = large.join(lists.groupBy("n_docs", "x", "y").agg(F.min("token").alias("token")).select("token"), "token", "left_semi")
    upto = by_token.orderBy("comp", "sig").rowsBetween(Window.unboundedPreceding, -1)
    nth, held = F.count("*").over(upto), F.coalesce(F.sum("n").over(upto), F.lit(0))
    blocked = cut(large.withColumn("block", F.floor(nth / BLOCK) + F.floor(held / BLOCK_SHINGLES)).select("token", "block", "sig", "comp", "n"), "large")
    free(use)
    large = blocked
    blocks = large.groupBy("token", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("few"), F.max("n").alias("many"))
    other = blocks.select("token", *(F.col(c).alias(f"{c}2") for c in ("block", "low", "high", "few", "many")))
    near = (DEN * F.col("many") >= NUM * F.col("few2")) & (DEN * F.col("many2") >= NUM * F.col("few"))
    met = blocks.join(other, "token").where(near).where("block <= block2 and not (low = high and low2 = high2 and low = low2)").select("token", "block", "block2")
    sides = met.select("token", "block", F.col("block").alias("i"), F.col("block2").alias("j")).unionByName(met.where("block <> block2").select("token", F.col("block2").alias("block"), F.col("block").alias("i"), F.col("block2").alias("j")))
    sides = cut(large.join(sides, ["token", "block"]).select("token", "i", "j", "sig", "comp"), "sides")
    free(large)
    sets = cut(_sets_of_ids(texts, pairs.select("a").union(pairs.select("b")).union(sides.select("sig"))), "shingles")
    tasks = sides.join(sets, "sig").select("token", "i", "j", "sig", "comp", "shingles")
    more = _verified(pairs, sets).unionByName(tasks.groupBy("token", "i", "j").applyInPandas(_linked_in_block, "a long, b long"))
    links = links.unionByName(cut(more, "more"))
    free(pairs, sides, sets)

    comps = connected_components(links).withColumnRenamed("vertex", "sig")
    named = groups.join(comps, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least_doc = named.groupBy("component").agg(F.min("doc").alias("component_id"), F.sum("size").alias("members"))
    named = named.join(least_doc, "component").where("members > 1").select("sig", "component_id", "size")
    found = attach(rows, cut(named, "named"), "sig", "size", rows.count())
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are linked with one of a smaller id. Rows of one id share that decision: they go
    if one of them is linked so. Rows without an id stay."""
    gone_id = fresh(docs, "_gone_id")
    gone = cut(ngram_join(docs, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left_anti").select(*own_columns(docs))
