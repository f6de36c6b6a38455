"""SentencePiece encoding and decoding (9): unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a character without a piece of its own costs besides the least score, as in SentencePiece.
UNKNOWN_PENALTY = 10.0
#: Bytes of text that are segmented at once.
CHUNK = 4 << 20
#: No piece goes on after a space that follows another character, nor holds a line feed; so texts are cut there.
UNITS = re.compile(" +[^ \n]*|[^ \n]+|\n")
#: Units of more characters are cut again between neighbours that no piece holds; what is longer than so many bytes then
#: is segmented by itself, place by place.
LONG = 64


@dataclass
class Pieces:
    """The vocabulary: each piece's bytes (the whitespace marker is a space), log score and kind, and the trie."""

    surface: list[bytes]
    score: np.ndarray
    byte_id: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    #: pairs of characters that lie next to each other in some piece, as numbers in order
    pairs: np.ndarray

    def lists(self) -> tuple[list, list, list, list]:
        """The trie and scores as plain lists, which single reads are faster from."""
        if not hasattr(self, "_lists"):
            self._lists = tuple(x.tolist() for x in (self.base, self.check, self.value, self.score))
        return self._lists


def _pair_numbers(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return (c[:-1] << 21) | c[1:]


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value: from state s byte c leads to t = base[s] + c if check[t] == s; value[t] is a key's place or -1."""
    root: dict = {}
    for k, key in enumerate(keys):
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = k
    size = 1 << 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    first_free, queue = 1, [(0, root)]
    tried: dict[int, int] = {}  # by number of children: where the search for so many places goes on
    while queue:
        state, node = queue.pop()
        value[state] = node.get(-1, -1)
        codes = np.array(sorted(c for c in node if c >= 0), np.int64)
        if not len(codes):
            continue
        while check[first_free] != -1:
            first_free += 1
        at = max(1, first_free - int(codes[0]), tried.get(len(codes), 0))
        while True:
            if at + 4096 + 256 >= len(check):
                base, check, value = (np.concatenate((x, np.full(len(x), fill, np.int32))) for x, fill in ((base, 0), (check, -1), (value, -1)))
            fits = np.flatnonzero((check[np.arange(at, at + 4096)[:, None] + codes] == -1).all(axis=1)) if len(codes) > 1 else np.flatnonzero(check[at + codes[0] : at + codes[0] + 4096] == -1)
            if len(fits):
                at += int(fits[0])
                break
            at += 4096
        if len(codes) > 1:
            tried[len(codes)] = at
        base[state] = at
        check[at + codes] = state
        queue += [(at + int(c), node[int(c)]) for c in codes]
    end = int(np.flatnonzero(check >= 0)[-1]) + 257
    return tuple(np.concatenate((x, np.full(max(0, end - len(x)), fill, np.int32)))[:end] for x, fill in ((base, 0), (check, -1), (value, -1)))


def load_pieces(model_file: str) -> Pieces:
    """Read a .model file.

    A unigram model's scores are log probabilities. A BPE model's are negated merge ranks, which add up to nothing
    sensible; its pieces get the log probabilities of Zipf's law at their ranks instead, -log(rank + 2).
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(sp.get_piece_size())
    normal = [k for k in ids if not (sp.is_unknown(k) or sp.is_control(k) or sp.is_byte(k) or sp.is_unused(k))]
    scores = np.array([sp.get_score(k) for k in ids], np.float64)
    if min(scores[normal]) < -1000:
        scores = -np.log(np.maximum(-scores, 0) + 2)
    surface = [sp.id_to_piece(k).replace("▁", " ").encode() for k in ids]
    byte_id = np.full(256, -1, np.int32)
    for k in ids:
        if sp.is_byte(k):
            value = int(sp.id_to_piece(k)[3:5], 16)
            byte_id[value] = k
            surface[k] = bytes([value])
        elif sp.is_control(k) or sp.is_unknown(k):
            surface[k] = b""
    if (byte_id < 0).any():
        raise ValueError("the model has no byte fallback")
    base, check, value = double_array([surface[k] for k in normal])
    value = np.where(value >= 0, np.array([*normal, -1], np.int32)[value], -1).astype(np.int32)
    pairs = [_pair_numbers(t) for k in normal if len(t := surface[k].decode()) > 1]
    return Pieces(surface, scores, byte_id, base, check, value, np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64))


def cut_long(unit: str, p: Pieces) -> list[str]:
    """A unit in parts that no piece crosses; the parts' best segmentations are the unit's, as every piece lies in one."""
    pairs = _pair_numbers(unit)
    if not len(p.pairs):
        return list(unit)
    at = np.minimum(np.searchsorted(p.pairs, pairs), len(p.pairs) - 1)
    edges = (np.flatnonzero(p.pairs[at] != pairs) + 1).tolist()
    return [unit[a:b] for a, b in zip([0, *edges], [*edges, len(unit)], strict=True)]


def segment_one(unit: bytes, p: Pieces) -> list[int]:
    """segment() for one long unit, in time proportional to its length."""
    base, check, value, score = p.lists()
    unknown = float(p.score[p.value[p.value >= 0]].min()) - UNKNOWN_PENALTY
    n = len(unit)
    best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        so_far = best[i]
        if so_far == -math.inf:
            continue
        first = unit[i]
        width = min(1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4, n - i)
        state, single = 0, False
        for j in range(i, n):
            nxt = base[state] + unit[j]
            if nxt <= 0 or check[nxt] != state:
                break
            state = nxt
            k = value[state]
            if k >= 0:
                single = single or j + 1 - i == width
                new = so_far + score[k]
                if new > best[j + 1]:
                    best[j + 1], back[j + 1], piece[j + 1] = new, i, k
        if not single and so_far + unknown > best[i + width]:
            best[i + width], back[i + width], piece[i + width] = so_far + unknown, i, -1
    out, end = [], n
    while end:
        start = back[end]
        out += [piece[end]] if piece[end] >= 0 else [int(p.byte_id[c]) for c in reversed(unit[start:end])]
        end = start
    return out[::-1]


def segment(units: list[bytes], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The best segmentation of every unit at once: ids of all units one after the other, and their numbers.

    Viterbi goes over start places; at each, all units still that long walk the trie together. Of equal scores the
    longer last piece stays.
    """
    n = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(-n, kind="stable")
    text = np.frombuffer(b"".join(units), np.uint8)
    offset = np.cumsum(n) - n  # of bytes; places have one more for each unit
    place = offset + np.arange(len(units))
    total = len(text) + len(units)
    best, back, piece = np.full(total, -np.inf), np.zeros(total, np.int32), np.full(total, -1, np.int32)
    best[place] = 0.0
    unknown = float(p.score[p.value[p.value >= 0]].min()) - UNKNOWN_PENALTY
    lead = np.ones(256, np.int64)
    lead[0xC0:0xE0], lead[0xE0:0xF0], lead[0xF0:] = 2, 3, 4
    by_length = n[order]
    live = len(units)
    for i in range(int(n.max()) if len(n) else 0):
        while live and by_length[live - 1] <= i:
            live -= 1
        u = order[:live]
        u = u[best[place[u] + i] > -np.inf]
        if not len(u):
            continue
        first = text[offset[u] + i]
        width = np.minimum(lead[first], n[u] - i)
        single = np.zeros(len(u), bool)
        state, who, score = np.zeros(len(u), np.int32), np.arange(len(u)), best[place[u] + i]
        depth = 0
        while len(who):
            uu = u[who]
            nxt = p.base[state] + text[offset[uu] + i + depth]
            ok = (p.check[nxt] == state) & (nxt > 0)
            state, who, depth = nxt[ok], who[ok], depth + 1
            uu = u[who]
            found = p.value[state]
            hit = found >= 0
            if hit.any():
                at, w, ids = place[uu[hit]] + i + depth, who[hit], found[hit]
                single[w[width[w] == depth]] = True
                new = score[w] + p.score[ids]
                better = new > best[at]
                at = at[better]
                best[at], back[at], piece[at] = new[better], i, ids[better]
            on = n[uu] > i + depth
            state, who = state[on], who[on]
        alone = ~single  # a character without its own piece becomes bytes
        if alone.any():
            at, new = place[u[alone]] + i + width[alone], score[alone] + unknown
            better = new > best[at]
            at = at[better]
            best[at], back[at], piece[at] = new[better], i, -1
    # from the ends backward, all units together
    where, end, active = [], [], np.flatnonzero(n > 0)
    pos = n[active]
    while len(active):
        at = place[active] + pos
        where.append(at)
        end.append(pos)
        pos = back[at].astype(np.int64)
        on = pos > 0
        active, pos = active[on], pos[on]
    at = np.sort(np.concatenate(where)) if where else np.empty(0, np.int64)
    owner = np.searchsorted(place, at, "right") - 1
    size = np.where(piece[at] >= 0, 1, at - place[owner] - back[at])
    ids = np.repeat(piece[at], size)
    raw = np.repeat(piece[at] < 0, size)
    if raw.any():
        start = np.repeat(offset[owner] + back[at], size) + np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        ids[raw] = p.byte_id[text[start[raw]]]
    return ids, np.bincount(np.repeat(owner, size), minlength=len(units))


def _ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of all rows, one after the other."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def encode(texts: list[str], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and their numbers. A space goes before each text but empty ones."""
    number: dict[str, int] = {}
    which, counts = [], []
    for t in texts:
        units = UNITS.findall(" " + t) if t else []
        if units and max(map(len, units)) > LONG:
            units = [y for x in units for y in (cut_long(x, p) if len(x) > LONG else (x,))]
        own = [number.setdefault(x, len(number)) for x in units]
        which += own
        counts.append(len(own))
    raw = [x.encode() for x in number]
    ids, sizes = segment([x if len(x) <= 4 * LONG else b"" for x in raw], p)
    if long := [k for k, x in enumerate(raw) if len(x) > 4 * LONG]:
        found = [segment_one(raw[k], p) for k in long]
        edge = np.cumsum(sizes)
        sizes[long] = [len(x) for x in found]
        ids = np.insert(ids, np.repeat(edge[long], sizes[long]), np.concatenate([np.array(x, ids.dtype) for x in found]))
    w = np.array(which, np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = _ragged(ids, starts[w], sizes[w])
    upto = np.concatenate(([0], np.cumsum(sizes[w])))
    edges = np.concatenate(([0], np.cumsum(counts)))
    return flat, np.diff(upto[edges])


def decode(ids: np.ndarray, sizes: np.ndarray, p: Pieces) -> list[bytes]:
    """The bytes of each text: pieces and raw bytes joined, markers as spaces, without the space put in front."""
    length = np.fromiter(map(len, p.surface), np.int64, len(p.surface))
    start = np.cumsum(length) - length
    flat = _ragged(np.frombuffer(b"".join(p.surface), np.uint8), start[ids], length[ids]).tobytes()
    upto = np.concatenate(([0], np.cumsum(length[ids])))
    edges = upto[np.concatenate(([0], np.cumsum(sizes)))]
    return [flat[a:b][1:] if flat[a : a + 1] == b" " else flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def viterbi_score(unit: bytes, ids: list[int], p: Pieces) -> float:
    """The score of a segmentation of one unit, for tests: its pieces', and the unknown score for each raw character."""
    unknown = float(p.score[p.value[p.value >= 0]].min()) - UNKNOWN_PENALTY
    raw = set(p.byte_id.tolist())
    return math.fsum(float(p.score[k]) if k not in raw else unknown * ((p.surface[k][0] & 0xC0) != 0x80) for k in ids)


def sentencepiece(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again.

    Null counts as empty; an empty text has no ids. Characters without a piece become their bytes, the literal
    whitespace marker too, so decoding gives every text back. Each row is encoded by itself; ids may be null or repeat.
    Returns (doc_id, n_pieces, n_bytes_fallback, ids, exact), where exact tells that decoding gave the text again.
    """
    p = docs.sparkSession.sparkContext.broadcast(load_pieces(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = p.value
        raw = np.zeros(len(pieces.surface), bool)
        raw[pieces.byte_id] = True
        for batch in batches:
            size = np.asarray(pa.compute.binary_length(batch.column(1).cast(pa.binary())))
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)], strict=True):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                ids, sizes = encode(texts, pieces)
                again = decode(ids, sizes, pieces)
                edges = np.concatenate(([0], np.cumsum(sizes)))
                fallback = np.diff(np.concatenate(([0], np.cumsum(raw[ids])))[edges])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(fallback, pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32())), pa.array([x.encode() == y for x, y in zip(texts, again, strict=True)])],
                    ["doc_id", "n_pieces", "n_bytes_fallback", "ids", "exact"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, n_bytes_fallback long, ids array<int>, exact boolean")
