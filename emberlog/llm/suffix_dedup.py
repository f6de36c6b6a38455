"""Suffix-array dedup (13): bucket-pointer refinement over the texts' bytes.

A window is a string of LENGTH bytes. Its anchor is the q-gram of smallest hash among those that start in its first
LENGTH - Q + 1 bytes, so equal windows have equal anchors at equal offsets, and the windows of one anchor are
neighbours: a stretch. Refinement starts with the buckets of equal anchors and goes on in rounds. In each, a bucket's
members are told apart by their pointer, the identifier of all bytes around the anchor that their windows reach, and
what is left open is cut into the buckets of the next round, whose identifiers are made of this round's:

1. stretches (73 windows on average), bucket: the anchor;
2. their parts of at most PART neighbouring offsets, bucket: the anchor's, offsets, and the bytes all these windows share;
3. single windows.

A bucket with one member holds no repeated window. Members with equal pointers are repeated as a whole. Only members
that are alone with their pointer, in a bucket with others, stay open. Identifiers are hashes of content, so a task
makes the pointers of later offsets from its own texts, and only rows of open buckets are shuffled again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import fresh, own_columns
from emberlog.llm.shingles import mixed
from emberlog.session import cut, free

LENGTH, Q, PART = 200, 56, 16
#: Bytes that are hashed at once, and of a longer text's slices; their sum stays below 2**PLACE_BITS.
CHUNK, SLICE, PLACE_BITS = 1 << 19, 1 << 18, 20

_BASE = 0xD1B54A32D192ED03
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.Generator(np.random.PCG64(1913)).integers(1, 1 << 63, 256, dtype=np.uint64)


@cache
def _powers(base: int) -> np.ndarray:
    """Made where texts are hashed, not where the module is only read (8 MB)."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(1 << PLACE_BITS, base, np.uint64))), dtype=np.uint64)


#: What a row of any round carries: identifiers, the document, first window and number of windows, and its occurrences.
ROWS = "bucket long, pointer long, id long, mark int, at long, n_windows int, shift int, n int"


class Bytes:
    """Texts side by side, with the identifiers of their substrings."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(_VALUE[self.raw] * _powers(_BASE)[: len(self.raw)], out=self.sums[1:])

    def name(self, start: np.ndarray, stop: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        """64-bit identifiers of the bytes from start to stop."""
        return mixed((self.sums[stop] - self.sums[start]) * _powers(_INVERSE)[start] + (np.asarray(salt).astype(np.uint64) << np.uint64(1)) * np.uint64(_VALUE[0] | np.uint64(1)))


def stretches(b: Bytes) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, anchor's place, anchor's identifier) of all texts' stretches."""
    n, width = len(b.raw), LENGTH - Q + 1
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    grams = np.arange(n - Q + 1)
    gram = b.name(grams, grams + Q)
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = np.full(-(-len(gram) // width) * width, ~np.uint64(0))
    keys[: len(gram)] = (gram & ~low) | grams.astype(np.uint64)
    # the smallest key of each width: from the last multiple of width back, and from it on
    block = keys.reshape(-1, width)
    upto = np.minimum.accumulate(block, axis=1).ravel()
    onward = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    anchor = (np.minimum(onward[:windows], upto[width - 1 : width - 1 + windows]) & low).astype(np.int64)
    text = np.repeat(np.arange(len(b.size)), b.size)[:windows]
    new = np.ones(windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    after = np.append(first[1:], windows)
    text, anchor = text[first], anchor[first]
    after = np.minimum(after, b.end[text] - LENGTH + 1)  # a text's last bytes start no window
    inside = after > first
    first, after, text, anchor = first[inside], after[inside], text[inside], anchor[inside]
    return text, first, after - first, anchor, gram[anchor]


def parts_of(b: Bytes, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index of the stretch, first window, number of windows, bucket) of the stretches' parts, cut where the windows'
    offset to the anchor is a multiple of PART."""
    high, least = anchor - first, anchor - first - count + 1
    pieces = high // PART - least // PART + 1
    of = np.repeat(np.arange(len(first)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    j = high[of] // PART - nth
    top, low = np.minimum(high[of], j * PART + PART - 1), np.maximum(least[of], j * PART)
    a = anchor[of]
    shared = b.name(a - j * PART, a - j * PART - PART + 1 + LENGTH, j + 1)
    return of, a - top, top - low + 1, mixed(bucket[of] ^ shared)


def _chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Bytes]]:
    """(batch, its row of each slice, place of the slice in its text, the slices' bytes). Slices overlap by what a window
    needs, so that each window lies in one of them as a first one."""

    def given(rows: list, bases: list, texts: list) -> tuple:
        return batch, np.array(rows, np.int64), np.array(bases, np.int64), Bytes(texts)

    for batch in batches:
        rows, bases, texts, held = [], [], [], 0
        for k, value in enumerate(batch[text]):
            t = (value.as_py() or "").encode()
            for base in range(0, max(1, len(t) - LENGTH + 1), SLICE):
                rows.append(k)
                bases.append(base)
                texts.append(t[base : base + SLICE + LENGTH - 1])
                held += len(texts[-1])
                if held >= CHUNK:
                    yield given(rows, bases, texts)
                    rows, bases, texts, held = [], [], [], 0
        if rows:
            yield given(rows, bases, texts)


def _rows(batch: pa.RecordBatch, row: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    take = pa.array(row)
    signed = lambda x: x.view(np.int64) if x.dtype == np.uint64 else x
    kinds = {"n_windows": pa.int32(), "shift": pa.int32(), "n": pa.int32()}
    found = {k: pa.array(signed(v), kinds.get(k, pa.int64())) for k, v in columns.items()}
    return pa.RecordBatch.from_pydict({"bucket": found["bucket"], "pointer": found["pointer"], "id": batch["id"].take(take), "mark": batch["mark"].take(take), **{k: found[k] for k in ("at", "n_windows", "shift", "n")}})


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rows, bases, b in _chunks(batches):
        text, first, count, anchor, bucket = stretches(b)
        shift = anchor - first
        pointer = b.name(first, first + count - 1 + LENGTH, shift * LENGTH + count)
        yield _rows(batch, rows[text], bucket=bucket, pointer=pointer, at=first - b.start[text] + bases[text], n_windows=count, shift=shift, n=np.ones(len(text), np.int64))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Bytes, dict[str, np.ndarray]]]:
    """(batch, row of each listed item, bytes, the items with `start` counted in the bytes) for texts with `open` lists."""
    for batch, rows, bases, b in _chunks(batches):
        held: dict[str, list] = {k: [] for k in ("slice", "at", "n_windows", "shift", "bucket", "n")}
        for k in range(len(rows)):
            items = batch["open"][int(rows[k])].values
            at = items.field("at").to_numpy()
            own = np.flatnonzero((at >= bases[k]) & (at < bases[k] + SLICE))
            held["slice"].append(np.full(len(own), k))
            for name in ("at", "n_windows", "shift", "bucket", "n"):
                held[name].append(items.field(name).to_numpy()[own])
        found = {k: np.concatenate(v) for k, v in held.items()}
        found["start"] = found["at"] - bases[found["slice"]] + b.start[found["slice"]]
        found["bucket"] = found["bucket"].astype(np.int64).view(np.uint64)
        yield batch, rows[found["slice"]], b, found


def _second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, row, b, x in _listed(batches):
        count, anchor = x["n_windows"].astype(np.int64), x["start"] + x["shift"]
        of, first, some, bucket = parts_of(b, x["start"], count, anchor, x["bucket"])
        shift = anchor[of] - first
        pointer = b.name(first, first + some - 1 + LENGTH, shift * LENGTH + some)
        yield _rows(batch, row[of], bucket=bucket, pointer=pointer, at=x["at"][of] + first - x["start"][of], n_windows=some, shift=shift, n=x["n"][of])


def _last_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, row, b, x in _listed(batches):
        count = x["n_windows"].astype(np.int64)
        of = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        shift = x["shift"][of] - nth
        first = x["start"][of] + nth
        bucket = mixed(x["bucket"][of] + shift.astype(np.uint64))
        yield _rows(batch, row[of], bucket=bucket, pointer=b.name(first, first + LENGTH), at=x["at"][of] + nth, n_windows=np.ones(len(of), np.int64), shift=shift, n=x["n"][of])


def _judged(rows: DataFrame) -> DataFrame:
    """The rows of buckets with more than one occurrence, with `repeated` (its pointer is not alone) and `open`: still to
    be told apart, or the one of its pointer's members that stands for them where others of the bucket are open.

    Hot buckets and pointers are added up before they are shuffled. The sums are written, so that Spark can split the
    joins by them where one bucket has many members.
    """
    shared = cut(rows.groupBy("bucket").agg(F.sum("n").alias("in_bucket")).where("in_bucket > 1").select("bucket"), "buckets")
    left = cut(rows.join(shared, "bucket", "left_semi"), "shared")
    free(rows)
    first = F.min(F.struct("id", "mark", "at")).alias("first")
    members = cut(left.groupBy("bucket", "pointer").agg(F.sum("n").alias("total"), first), "members")
    alone = cut(members.where("total = 1").select("bucket").distinct().withColumn("some_alone", F.lit(True)), "alone")
    members = members.join(alone, "bucket", "left").select("bucket", "pointer", "total", F.coalesce("some_alone", F.lit(False)).alias("some_alone"), "first")
    found = left.join(members, ["bucket", "pointer"])
    stands = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")) & (F.col("at") == F.col("first.at"))
    return found.select(
        "bucket", "id", "mark", "at", "n_windows", "shift", (F.col("total") > 1).alias("repeated"), F.least("total", F.lit(2)).cast("int").alias("n"),
        (F.col("some_alone") & ((F.col("total") == 1) | stands)).alias("open"),
    )


def _with_lists(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """texts joined with one row of lists for each of them; the texts themselves are not sorted."""
    other = lists.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), *(c for c in lists.columns if c not in ("id", "mark"))).hint("shuffle_hash")
    return texts.join(other, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), how).drop("_id", "_mark")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, spans): for texts with repeated windows, the runs of bytes that these cover, as (start, stop).

    mark is a hash of the text; with the id it names a row. Rows that are repeated as a whole share their spans.
    """
    texts = _named(docs, id_col, text_col)
    fits = texts.where(F.octet_length("text") >= LENGTH)
    rounds: list[DataFrame] = []
    rows = cut(fits.mapInArrow(_first_round, ROWS), "stretches")
    for step in (_second_round, _last_round, None):
        judged = cut(_judged(rows), "judged")
        rounds.append(judged)
        if step is None:
            break
        item = F.struct("at", "n_windows", "shift", "bucket", "n")
        lists = judged.where("open").groupBy("id", "mark").agg(F.collect_set(item).alias("open"))
        rows = cut(_with_lists(fits, lists, "inner").select("id", "mark", "text", "open").mapInArrow(step, ROWS), "refined")
    spans = None
    for judged in rounds:
        own = judged.where("repeated").select("id", "mark", F.struct("at", (F.col("at") + F.col("n_windows") + (LENGTH - 1)).alias("stop")).alias("span"))
        spans = own if spans is None else spans.unionByName(own)
    found = cut(spans.groupBy("id", "mark").agg(F.collect_set("span").alias("spans")), "spans")
    free(*rounds)
    return found


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), _mark(text).alias("mark"), text.alias("text"))


def _mark(text: Column) -> Column:
    return F.shiftright(F.xxhash64(text), 32).cast("int")


def joined(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for at, stop in sorted((s["at"], s["stop"]) for s in spans or ()):
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((at, stop))
    return out


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))


def _applied(make: Callable[[bytes, list[tuple[int, int]]], tuple], schema: list[tuple[str, pa.DataType]]) -> Callable:
    """For mapInArrow: make(text, runs) for each row, after its first column."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [make((t or "").encode(), joined(s)) for t, s in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True)]
            columns = [pa.array([x[k] for x in found], kind) for k, (_, kind) in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [batch.schema.names[0], *(n for n, _ in schema)])

    return step


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What stays of each text without the bytes that a repeated string of 200 bytes covers.

    Texts are UTF-8 bytes, null counts as empty; a string is repeated if it also starts at another place of any row,
    the same row included, so both rows of a repeated row lose all their windows; matches never cross rows. All copies go, none is kept. Texts of
    fewer than 200 bytes lose nothing; very long ones are hashed in slices. Ids may be null or repeat: each row has its
    own result. Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256); an empty table gives none, and other columns
    are not read, whatever their names.
    """

    def digest(text: bytes, runs: list[tuple[int, int]]) -> tuple:
        return len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_without(text, runs)).hexdigest()

    spans = repeated_spans(docs, id_col, text_col)
    rows = _with_lists(_named(docs, id_col, text_col), spans, "left").select("id", "text", "spans")
    step = _applied(digest, [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    return rows.mapInArrow(step, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", "doc_id")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their texts as far as they are kept, all other columns as they are. A character of which only some bytes
    are left is dropped. Null texts stay null."""
    mark, key, kept = (fresh(docs, x) for x in ("_own_mark", "_own_id", "_kept"))
    spans = repeated_spans(docs, id_col, text_col).withColumnsRenamed({"id": key, "mark": mark, "spans": kept})
    text = F.col(text_col).cast("string")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (_mark(F.coalesce(text, F.lit(""))) == F.col(mark))

    @F.arrow_udf("string")
    def left(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array([t if r is None else _without(t.encode(), joined(r)).decode(errors="ignore") for t, r in zip(texts.to_pylist(), runs.to_pylist(), strict=True)], pa.string())

    found = docs.join(spans.hint("shuffle_hash"), same, "left").withColumn(text_col, left(text, F.col(kept)))
    return found.select(*own_columns(docs))
