"""Operators 11 to 13 against brute force: odd rows, nulls, repeats, long texts, ties, clashing names and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from emberlog.llm import prefix_trie, suffix_dedup, token_alignment
from emberlog.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id long, mark int, open string, spans string, groups string"


def table(spark, rows):
    """The rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, "o", "s", "g") for r in rows], SCHEMA).repartition(3)


def plain(rows):
    return sorted(map(tuple, rows), key=str)


# suffix dedup


def brute_suffix(rows):
    seen: Counter = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        seen.update(t[p : p + 200] for p in range(len(t) - 199))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def suffix_rows():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé ") for _ in range(3000))
    rows = [(None, None), (1, ""), (2, "x" * 1000), (3, "ab" * 300), (4, base), (4, base[:1500]), (5, base[100:700] + "Q" + base[701:1200]), (6, base[100:299]), (7, base[100:299] + "é"), (7, base[100:299] + "é"), (8, "y" * 199), (9, "y" * 200)]
    rows += [(10, base[:900] + base[:900]), (None, base[2000:]), (11, "".join(rng.choice("abcdefgh") for _ in range(300_000)) + base[5:800] + "ab" * 300)]
    return rows + [(100 + k, "".join(c if rng.random() > 0.01 else "#" for c in base)) for k in range(12)]


def test_suffix_dedup(spark):
    rows = suffix_rows()
    got = suffix_dedup.suffix_dedup(table(spark, rows)).collect()
    assert plain(got) == plain(brute_suffix(rows))


def test_drop_repeats(spark):
    rows = suffix_rows()
    df = table(spark, rows)
    left = suffix_dedup.drop_repeats(df)
    assert left.columns == df.columns and left.count() == len(rows)
    by = {r.doc_id: r.text for r in left.collect() if r.doc_id in (1, 2, 8)}
    assert by == {1: "", 2: "", 8: "y" * 199}


def test_stretches_cover_all_windows():
    """Every window lies in one stretch, whose anchor depends on the window alone, and in one part."""
    rng = random.Random(1)
    t = "".join(rng.choice("ab") for _ in range(700)) + "z" * 300
    texts = [t.encode(), b"short", (t[50:600]).encode()]
    b = suffix_dedup.Bytes(texts)
    text, first, count, anchor, bucket = suffix_dedup.stretches(b)
    at = {}
    for x, f, n, a, g in zip(text, first, count, anchor, bucket, strict=True):
        for p in range(f, f + n):
            assert p not in at
            at[p] = (a - p, g)
    assert set(at) == {p for s, z in zip(b.start, b.end, strict=True) for p in range(s, z - 199)}
    shift = b.start[2] - 50
    assert all(at[p] == at[p + shift] for p in range(50, 50 + 550 - 199))
    of, start, some, _ = suffix_dedup.parts_of(b, first, count, anchor, bucket)
    assert sorted(p for f, n in zip(start, some, strict=True) for p in range(f, f + n)) == sorted(at)
    assert np.all(some <= suffix_dedup.PART) and np.all(anchor[of] - start - some + 1 >= 0)


# conversation trie


def brute_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    by = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    full = {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + -c % 20
        full[c] = tuple(by.get(base, [])[:h] + by[c][h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) if kids[n] else 1
        saved[n] = (len(members[n]) - 1) * (len(WORD.findall(n[-1][1])) if n else 0) + sum(saved[k] for k in kids[n])
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in sorted(members[n]) if len(full[c]) == len(n)).encode()).hexdigest()
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], ends(n)) for n, m in members.items()]


def conversations():
    rng, rows = random.Random(2), []
    for c in [*range(70), -3, -21, 1000]:
        if c not in (20, 41):
            rows += [(c, rng.choice([t, t, t, None, 0]), rng.choice(["user", None, "a"]), rng.choice(["x", "x y", None, "", "é  z"])) for t in range(rng.randrange(1, 9))]
    rows += [rows[3], (None, 0, "a", "b"), (5, None, None, None), (6, 2, "u", "long " * 20_000)]
    for c in (60, 61, 79, 77):
        rows += [(c, t, "user", "same") for t in range(120)]
    return rows


@pytest.mark.parametrize("chunk", [4096, 7])
def test_prefix_trie(spark, monkeypatch, chunk):
    """Small chunks, so that paths and conversations fill several."""
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = conversations()
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], "conv_id long, turn long, role string, text string, place long, k1 string").repartition(3)
    assert plain(prefix_trie.prefix_trie(df).collect()) == plain(brute_trie(rows))


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(none).count() == 0


# alignment


@pytest.fixture(scope="module")
def models():
    return Path(tokenizer_path("byte_bpe_50k.json")).read_text(encoding="utf-8"), Path(tokenizer_path("piece_bpe_32k.model")).read_bytes()


def brute_alignment(rows, models):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_str(models[0]), sentencepiece.SentencePieceProcessor(model_proto=models[1])
    first.encode_special_tokens = True
    sizes, docs, counts = (token_alignment.byte_tokens(models[0]), token_alignment.piece_tokens(second)), [], Counter()
    for i, t in rows:
        ids = (first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)) if t else ([], [])
        if not t or any(b"".join(of[x] for x in own) != (" " + t).encode() for own, of in zip(ids, sizes, strict=True)):
            docs.append((i, 0, 0, [], []))
            continue
        ends = []
        for own, of in zip(ids, sizes, strict=True):
            at = 0
            ends.append([at := at + len(of[x]) for x in own])
        cuts = sorted(set(ends[0]) & set(ends[1]))
        at = [dict(zip(e, own, strict=True)) for e, own in zip(ends, ids, strict=True)]
        links = [(at[0][c], at[1][c]) for c in cuts]
        counts.update(links)
        groups = ["|".join(",".join(str(x) for e, x in zip(ends[s], ids[s], strict=True) if low < e <= c) for s in (0, 1)) for low, c in zip([0, *cuts], cuts, strict=False)]
        docs.append((i, len(ids[0]), len(ids[1]), groups, links))
    best: Counter = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, a, b, len(g), len(l), sum(counts[p] == best[p[1]] for p in l), sum(counts[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, l in docs]


SIGNS = [*"ab'sStTre dD!.,-<|>Éé日字👍🏽 　\x85\x1c\x1d\x00\r\n\t   12{};)▁́᠎​", "<|endoftext|>", "<s>", "</s>", "<0x41>", " 's"]


@pytest.mark.parametrize("common", [200_000, 40])
def test_token_alignment(spark, models, common):
    """Few common pairs, so that most go through the join."""
    rng = random.Random(5)
    rows = [(None, None), (1, ""), (2, " "), (3, "  "), (4, "x▁y"), (5, "\n"), (6, "<|endoftext|> <s>"), (7, "a" * 3000), (7, "日本" * 900), (8, "one two"), (8, "one two"), (9, "word, and more; " * 4000)]
    rows += [(10 + k, "".join(rng.choice(SIGNS) for _ in range(rng.randrange(40)))) for k in range(600)]
    got = token_alignment.token_alignment(table(spark, rows), *models, common=common).collect()
    assert plain(got) == plain(brute_alignment(rows, models))


def test_groups_as_text(spark, models):
    texts, pairs = token_alignment.align(table(spark, [(1, "Größe naïve"), (2, None)]), *models, groups=True)
    shown = {r.doc_id: r for r in texts.collect()}
    assert shown[2].groups == "" == shown[2].groups_sha256 and hashlib.sha256(shown[1].groups.encode()).hexdigest() == shown[1].groups_sha256
    assert pairs.groupBy().sum("links").first()[0] == shown[1].n_groups
    assert token_alignment.token_alignment(table(spark, [(1, "x")]).limit(0), *models).count() == 0
