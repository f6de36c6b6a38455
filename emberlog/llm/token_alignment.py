"""Cross-tokenizer alignment (11): two tokenizers' tokens of the same bytes, cut where both end.

Both tokenizers begin anew at a space after a character that is no white space, so a text is cut into segments there,
and each task encodes and aligns a segment once. The alignment is DuckDB's, over interval tables of an Arrow partition's
new segments: the links are a join of token ends, ASOF joins find the link at which a token's group closes and the
segment that a link lies in (segments don't overlap; a range join of the same took 45 s for 60,000 segments instead of
0.02), and window sums number the groups. DuckDB runs on one thread, so that aggregates see sorted rows in order. Tasks add up how often each id pair is linked; Spark
merges these partial counts and joins them back to the texts' pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import most_frequent
from emberlog.session import cut

#: At most so many frequent id pairs are broadcast (17 bytes each, at any corpus size); all others are joined.
COMMON = 200_000
#: Segments and characters that are aligned at once, segments that a task remembers, and characters of texts at once.
BLOCK, BLOCK_CHARS, HELD, TEXTS = 60_000, 1 << 20, 400_000, 1 << 21
#: A space, and all up to the next space that follows other than white space; white space at the end goes with the last.
SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*| \s*\Z)*")
B_IDS = 1 << 24

ALIGN = """
WITH link AS (SELECT a.e AS e, a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.e = b.e),
placed AS (SELECT seg.k AS k, link.e AS e, a_id, b_id FROM link ASOF JOIN seg ON link.e <= seg.stop),
numbered AS (SELECT *, sum(1) OVER (PARTITION BY k ORDER BY e) AS nth FROM placed),
ga AS (SELECT e, string_agg(id, ',') AS ids, count(*) AS n FROM (SELECT link.e AS e, a.id AS id FROM a ASOF JOIN link ON a.e <= link.e ORDER BY a.e) GROUP BY e),
gb AS (SELECT e, string_agg(id, ',') AS ids, count(*) AS n FROM (SELECT link.e AS e, b.id AS id FROM b ASOF JOIN link ON b.e <= link.e ORDER BY b.e) GROUP BY e),
lined AS (SELECT k, nth, ga.n AS n_a, gb.n AS n_b, ga.ids || '|' || gb.ids AS pair_ids, a_id::BIGINT * {b_ids} + b_id AS pair FROM numbered JOIN ga USING (e) JOIN gb USING (e) ORDER BY k, nth)
SELECT k, sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b, max(nth)::BIGINT AS n_groups, string_agg(pair_ids, ';') AS groups, list(pair) AS pairs FROM lined GROUP BY k ORDER BY k
"""


def byte_tokens(model_json: str) -> list[bytes]:
    """The bytes of each id of a byte-level model. Its files write bytes that can't be printed as characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = json.loads(model_json)["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        out[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


def piece_tokens(processor) -> list[bytes]:
    """The bytes of each id of a piece model."""
    return [bytes([int(processor.id_to_piece(k)[3:-1], 16)]) if processor.is_byte(k) else processor.id_to_piece(k).replace("▁", " ").encode() for k in range(processor.get_piece_size())]


class Aligner:
    """Aligned segments, each one made once: indexes, counts, group strings and id pairs."""

    def __init__(self, model_json: str, model_proto: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(model_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_proto)
        self.a_bytes, self.b_bytes = byte_tokens(model_json), piece_tokens(self.b)
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        known = json.loads(model_json).get("pre_tokenizer") or {}
        if known.get("type") != "ByteLevel" or not known.get("use_regex", True) or known.get("add_prefix_space") or any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("tokens of these models can span the space between two words")
        self.db = duckdb.connect(":memory:", config={"threads": 1})
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, whether the bytes are those of the text
        self.pairs, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encoded(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids that both tokenizers give the segments, one after the other. Segments that end in other than white space
        are one text to the first tokenizer."""
        b = np.fromiter(chain.from_iterable(self.b.encode([s[1:] for s in segments], num_threads=1)), np.int64)
        parts: list[list[int]] = []
        for firm, run in groupby(segments, key=lambda s: not s[-1].isspace()):
            for text in ["".join(run)] if firm else run:
                parts.append(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        return np.fromiter(chain.from_iterable(parts), np.int64), b

    def learn(self, segments: list[str]) -> None:
        """Encode and align segments that are new."""
        at, n = 0, len(segments)
        while at < n:
            stop, chars = at, 0
            while stop < n and stop - at < BLOCK and (stop == at or chars + len(segments[stop]) <= BLOCK_CHARS):
                chars += len(segments[stop])
                stop += 1
            self._learn(segments[at:stop])
            at = stop

    def _learn(self, segments: list[str]) -> None:
        raw = [s.encode() for s in segments]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        a, b = self.encoded(segments)
        stop = np.cumsum(size)
        ends = []
        for ids, of, lengths in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size)):
            e = np.cumsum(lengths[ids])
            whole = len(e) and e[-1] == stop[-1] and np.isin(stop, e, assume_unique=True).all() and b"".join(map(of.__getitem__, ids.tolist())) == b"".join(raw)
            ends.append(e if whole else None)
        good = np.arange(len(segments))
        if any(e is None for e in ends):  # some segment's bytes are not its tokens': each is looked at by itself
            if len(segments) > 1:
                half = len(segments) // 2
                self._learn(segments[:half])
                self._learn(segments[half:])
                return
            good = good[:0]
        sizes = np.zeros((len(segments), 4), np.int64)
        groups, pairs, counts = [""] * len(segments), [], np.zeros(len(segments), np.int64)
        if len(good):
            for name, ids, e in (("a", a, ends[0]), ("b", b, ends[1])):
                self.db.register(name, pa.table({"id": pa.array(ids.astype(np.int32)), "e": e}))
            self.db.register("seg", pa.table({"k": good, "stop": stop}))
            found = self.db.sql(ALIGN.format(b_ids=B_IDS)).to_arrow_table()
            for name in ("a", "b", "seg"):
                self.db.unregister(name)
            sizes = np.stack([found[c].to_numpy() for c in ("n_a", "n_b", "n_groups")] + [np.ones(len(good), np.int64)], axis=1)
            groups = found["groups"].to_pylist()
            listed = found["pairs"].combine_chunks()
            counts = listed.value_lengths().to_numpy().astype(np.int64)
            pairs.append(listed.flatten().to_numpy())
        base = len(self.groups)
        self.index.update((s, base + k) for k, s in enumerate(segments))
        self.groups += groups
        self.sizes = np.concatenate((self.sizes, sizes))
        self.pairs = np.concatenate((self.pairs, *pairs))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts)))

    def aligned(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, groups, distinct id pairs, their numbers) of each text."""
        cuts = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        if len(self.index) > HELD:
            self.clear()
        self.learn([s for s in dict.fromkeys(s for c in cuts for s in c) if s not in self.index])
        none = np.zeros(0, np.int64)
        for c in cuts:
            own = np.fromiter(map(self.index.__getitem__, c), np.int64, len(c))
            size = self.sizes[own]
            if not len(own) or not size[:, 3].all():
                yield 0, 0, 0, "", none, none
                continue
            first = self.ends[own]
            n = self.ends[own + 1] - first
            places = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs, times = np.unique(self.pairs[places], return_counts=True)
            yield *size[:, :3].sum(axis=0).tolist(), ";".join(map(self.groups.__getitem__, own.tolist())), pairs, times


def _chunked(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch's rows, about TEXTS bytes at a time."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXTS, side="right")))
        own = batch.slice(at, stop - at)
        yield own.column(0).to_pylist(), own.column(1).to_pylist()
        at = stop


DOCS = "doc_id long, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, a array<int>, b array<int>, n array<int>, pair long, links long"


def align(docs: DataFrame, model_json: str, model_proto: bytes, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs): a row for each text with its counts, groups and id pairs, and (pair, links) over the corpus.

    texts: doc_id, n_a, n_b, n_groups, groups (if asked for, else null), groups_sha256, and the distinct linked pairs as
    arrays a, b, n. Tokens are those of the space and the text by the first tokenizer, of the text by the second.
    """
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast((model_json, model_proto))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*models.value)
        pair, links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for ids, texts in _chunked(batch):
                found = list(aligner.aligned(texts))
                shas = [hashlib.sha256(x[3].encode()).hexdigest() if x[3] else "" for x in found]
                ends = pa.array(np.cumsum([0, *(len(x[4]) for x in found)]), pa.int32())
                flat, times = np.concatenate([x[4] for x in found]), np.concatenate([x[5] for x in found])
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (flat // B_IDS, flat % B_IDS, times)]
                n = len(found)
                counts = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
                shown = pa.array([x[3] for x in found], pa.string()) if groups else pa.nulls(n, pa.string())
                nothing = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *counts, shown, pa.array(shas), *lists, nothing, nothing], NAMES)
                pair, at = np.unique(np.concatenate((pair, flat)), return_inverse=True)
                links = np.bincount(at, np.concatenate((links, times)), len(pair)).astype(np.int64)
        n = len(pair)
        long, ints = pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([long] * 4 + [pa.nulls(n, pa.string())] * 2 + [ints] * 3 + [pa.array(pair), pa.array(links)], NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    both = cut(rows.mapInArrow(step, DOCS), "aligned")
    pairs = both.where("pair is not null").groupBy("pair").agg(F.sum("links").alias("links"))
    return both.where("pair is null").drop("pair", "links"), pairs


NAMES = [x.split()[0] for x in DOCS.split(", ")]


def token_alignment(docs: DataFrame, model_json: str, model_proto: bytes, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """Groups and links of every text, and how usual its links are.

    Texts that are null or empty have no tokens, nor have those of which one tokenizer's bytes are not the space and the
    text (a literal U+2581); their counts are 0 and groups_sha256 is ''. A link is best if no other id is linked more
    often, in the corpus, with its second id. Counts of the most frequent id pairs, `common` at most, are broadcast, the
    others are joined. Ids may be null or repeat: each row has its own result. Very long texts pass as one row, their segments in blocks. Returns (doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256), a row for each input row; an empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    texts, pairs = align(docs, model_json, model_proto, id_col, text_col)
    pairs = cut(pairs.withColumn("b_id", F.col("pair") % B_IDS), "pairs")
    most = F.broadcast(pairs.groupBy("b_id").agg(F.max("links").alias("most")))  # a row for each id of the vocabulary at most
    pairs = pairs.join(most, "b_id").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    top = most_frequent(pairs, "links", common).toArrow()
    known = [top.column(k).to_numpy() for k in range(3)]
    order = np.argsort(known[0])
    frequent = spark.sparkContext.broadcast(tuple(x[order] for x in known))
    schema = "row_id long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long, pair long, n long"
    names = [x.split()[0] for x in schema.split(", ")]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each text with the sums of its common pairs, and a row for each other pair."""
        pair, links, best = frequent.value
        for batch in batches:
            lists = batch["a"]
            n_rows = batch.num_rows
            row = np.repeat(np.arange(n_rows), lists.value_lengths().to_numpy())
            own = lists.flatten().to_numpy().astype(np.int64) * B_IDS + batch["b"].flatten().to_numpy()
            n = batch["n"].flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            hit = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            total = lambda v, of: np.bincount(of, v, n_rows).astype(np.int64)  # noqa: E731  below 2**53 each
            sums = [total(n, row), total((n * best[at])[hit], row[hit]), total((n * links[at])[hit], row[hit])]
            rest, ids = ~hit, batch["row_id"].to_numpy()
            m = int(rest.sum())
            none = pa.nulls(n_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:6]), *map(pa.array, sums), none, none], names)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[rest]]), none, none, none, none, pa.nulls(m, pa.string()), none, none, none, pa.array(own[rest]), pa.array(n[rest])], names)

    parts = cut(texts.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(summed, schema), "parts")
    zero = F.lit(0).cast("long")
    whole = parts.where("pair is null").select(*names[:9])
    rare = parts.where("pair is not null").join(pairs, "pair").groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(zero)).alias("more_best"), F.sum(F.col("n") * F.col("links")).alias("more_sum"))
    found = whole.join(rare, "row_id", "left")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups_sha256")
