"""The document operators against brute force on a small table with nulls, ties, repeats, long texts and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.llm import exact_dedup, ngram_join, quality_classifier, quality_rules, sentencepiece_codec, source_mix, token_counts
from emberlog.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]")


def make_rows():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["Größe", "naïve", "日本", "#x", "the"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 30, 80, 120, 200)]
    texts = [None, "", " \n\t", "one", "One two  three", "one two three", "a\nb\na\nb", "x " * 4000, "\x1c\x85 odd blanks here", "👍🏽 emojí \x00 nul", "<|endoftext|> it's 's"]
    for b in base:
        texts += [b, b.upper(), b.replace(" ", "  "), b + " "]
        w = b.split()
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(12)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(15000))]
    sources = ["s1", "s1", "s1", "s2", None, "s3", "S3"]
    rows = [(k, t, rng.choice(["en", None]), rng.choice(sources), len(t or ""), "k", "r", 7) for k, t in enumerate(texts)]
    return rows + [rows[20], rows[20], rows[1]]  # repeated rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[BLANK.sub("", r[1] or "")].append((-len(r[1] or ""), r[0]))
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: BLANK.sub("", r[1] or "") for r in rows}
    for g in got:
        own = groups[by_id[g.doc_id]]
        assert (g.keep_id, g.group_size) == (min(own)[1], len(own))
        assert g.text_sha256 == hashlib.sha256(by_id[g.doc_id].encode()).hexdigest()
    assert sum(g.kept for g in got) == len(groups)


def test_drop_copies_keeps_columns(docs, rows):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({BLANK.sub("", r[1] or "") for r in rows})


def test_ngram_join(docs, rows):
    want = brute_components(rows)
    got = ngram_join.ngram_join(docs).collect()
    assert len(got) == len(rows)
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == want


@pytest.mark.parametrize("levels,listed,block", [(1, 2, 3), (6, 4, 5)])
def test_ngram_join_in_blocks(spark, monkeypatch, levels, listed, block):
    """Short lists and small blocks, so that every path is taken."""
    monkeypatch.setattr(ngram_join, "LIST", listed)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LEVELS", levels)
    rng = random.Random(levels)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(60)] = f"x{rng.randrange(30)}"
        rows.append((k, " ".join(w[: rng.randrange(45, 61)])))
    want = brute_components(rows)
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == want


def test_drop_near_copies(docs, rows):
    want = brute_components(rows)
    left = ngram_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in rows if want[r[0]][1] == r[0])


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in rows)
    got = token_counts.token_counts(docs, open(path, encoding="utf-8").read())
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
    rare = token_counts.token_counts(docs, open(path, encoding="utf-8").read(), common=3)
    assert Counter(tuple(r) for r in rare.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want


def test_quality_rules(docs, rows):
    want = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        repeat = len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)})
        lines = [x for x in (r[1] or "").split("\n") if WORD.search(x)]
        want[r[0]] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r[1] or ""), len(lines) - len(set(lines)), repeat, len(w) < 20 or 100 * repeat > 30 * len(w))
    book = quality_rules.judged(quality_rules.ledger(docs)).cache()
    got = book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(got) == len(rows) and {g[0]: tuple(g)[1:] for g in got} == want
    assert book.where("base_failed and kept").count() == 0
    for a in quality_rules.ablation(book, "v2").collect():
        bit = {n: b for n, b, _ in quality_rules.RULES}[a.rule]
        assert a.n_failed == book.where(F.col("failed").bitwiseAND(F.lit(1 << bit)) != 0).count()
        assert a.n_only == book.where(F.col("failed") == (1 << bit)).count()


def test_source_mix(docs, rows):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    by = Counter()
    for r in rows:
        by[r[3]] += size[r[0]]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, dict(weights)
    left = 1.5 * sum(by.values())
    while open_:
        rate = left / sum(open_.values())
        over = [s for s in open_ if open_[s] * rate > 2 * by[s]]
        for s in over or list(open_):
            target[s] = 2.0 * by[s] if over else open_[s] * rate
            left -= target[s]
            del open_[s]
    got = source_mix.mix(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for g in got:
        assert g["size"] == size[g.doc_id] and g.source_size == by[g.source] and abs(g.target - target[g.source]) < 1e-6
        assert 0 <= g.taken <= 2 * g["size"]
        taken[g.source] += g.taken
    for s in by:
        assert abs(taken[s] - target[s]) <= max(size[r[0]] for r in rows if r[3] == s) + 1
    key = lambda xs: sorted((g.doc_id, g.taken) for g in xs)
    assert key(got) == key(source_mix.mix(docs).collect())
    assert source_mix.mixed_documents(docs).columns == docs.columns


def test_sentencepiece_round_trip(docs, rows):
    got = sentencepiece_codec.sentencepiece(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows) and all(g.exact and len(g.ids) == g.n_pieces for g in got)


def test_segmentation_is_best():
    p = sentencepiece_codec.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    score = {p.surface[k]: float(p.score[k]) for k in set(p.value[p.value >= 0].tolist())}
    unknown = min(score.values()) - sentencepiece_codec.UNKNOWN_PENALTY
    rng = random.Random(3)
    units = ["".join(rng.choice("abcdeéß日 👍") for _ in range(rng.randrange(1, 14))) for _ in range(150)] + [" hello", " naïve", "日本語"]
    ids, sizes = sentencepiece_codec.segment([u.encode() for u in units], p)
    at = 0
    for u, n in zip(units, sizes.tolist(), strict=True):
        best = [0.0] + [-1e18] * len(u)
        for j in range(1, len(u) + 1):
            for i in range(j):
                s = score.get(u[i:j].encode(), unknown if j == i + 1 else -1e18)
                best[j] = max(best[j], best[i] + s)
        assert abs(sentencepiece_codec.viterbi_score(u.encode(), ids[at : at + n].tolist(), p) - best[-1]) < 1e-6, u
        at += n


@pytest.fixture
def quick_fits(monkeypatch):
    """Fewer steps a fit, for tests that are not about the classifier's quality."""
    monkeypatch.setattr(quality_classifier, "STEPS", 4)


def test_quality_classifier_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(4)) == 0
    found = quality_classifier.classify(d, labels.where(~part)).join(labels.where(part), "doc_id")
    right, n = found.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert n > 50 and right >= 0.9


def test_quality_classifier_edges(docs, empty, rows, quick_fits):
    none = docs.sparkSession.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.classify(docs, none).where("kept").count() == len(rows)
    labels = docs.select("doc_id", (F.length("text") > 100).cast("int").alias("quality")).distinct()
    left = quality_classifier.drop_rejected(docs, labels)
    assert left.columns == docs.columns and 0 < left.count() <= len(rows)
    assert quality_classifier.classify(empty, none).count() == 0


@pytest.mark.parametrize("n", [2, 9])
def test_quality_classifier_with_few_labels(docs, n, quick_fits):
    labels = docs.sparkSession.createDataFrame([(20 + k, k % 2) for k in range(n)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or isnan(score)").count() == 0


def test_names_with_dots_stay(docs, quick_fits):
    named = docs.select("*", F.lit(1).alias("a.b"), F.lit(2).alias("x`y"))
    labels = docs.select("doc_id", (F.length("text") > 100).cast("int").alias("quality")).distinct()
    for left in (exact_dedup.drop_copies(named), ngram_join.drop_near_copies(named), source_mix.mixed_documents(named), quality_classifier.drop_rejected(named, labels)):
        assert left.columns == named.columns and left.where("`a.b` = 1").count() == left.count() > 0


def test_pre_tokens_add_up():
    """Sums over pre-tokens are the tokenizer's counts, for marks, capitals, contractions and special strings in any order."""
    from tokenizers import Tokenizer

    model = open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read()
    t, pre, rng = Tokenizer.from_str(model), token_counts.PreTokens(model), random.Random(1)
    assert pre.fine
    signs = "ab'sStTrevlLdmM !.,-<|>endoftextÉé\u0301\u030aA\u0327ßẞİΣσ漢字1²Ⅷ\t\n\u3000\x1d😀👍🏽"
    texts = ["it's 'Stuff' WE'LL <|endoftext|>\u0338x <|startoftext|>", "漢字かな交じり文" * 50, "=" * 500]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(2000)]
    for text in texts:
        got = sum(len(t.encode(x, add_special_tokens=False)) for w in pre.words(text) for x in pre.cut(w))
        assert got == len(t.encode(text, add_special_tokens=False)), text


def test_long_texts_without_spaces():
    """A megabyte of either kind, and the same pieces as from the steps over whole units."""
    import base64

    rng = random.Random(4)
    p = sentencepiece_codec.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    signs = "吾輩は猫である。名前はまだ無い。どこで生れたか"
    long = [signs * 15000, base64.b64encode(rng.randbytes(700_000)).decode(), " " * 50_000 + "x"]
    assert sentencepiece_codec.decode(*sentencepiece_codec.encode(long, p), p) == [x.encode() for x in long]
    mixed = ["".join(rng.choice(signs + "abcdefgh   é😀▁") for _ in range(rng.randrange(1500))) for _ in range(20)]
    ids, sizes = sentencepiece_codec.encode(mixed, p)
    units = [sentencepiece_codec.UNITS.findall(" " + x) if x else [] for x in mixed]
    whole, n = sentencepiece_codec.segment([u.encode() for us in units for u in us], p)
    assert ids.tolist() == whole.tolist() and sizes.sum() == n.sum()


def test_empty_tables(empty):
    model = open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read()
    for found in (exact_dedup.exact_dedup(empty), exact_dedup.drop_copies(empty), ngram_join.ngram_join(empty), token_counts.token_counts(empty, model), quality_rules.ledger(empty), source_mix.mix(empty), source_mix.mixed_documents(empty), sentencepiece_codec.sentencepiece(empty, tokenizer_path("piece_bpe_32k.model"))):
        assert found.count() == 0


def test_pipeline_run_on_odd_rows(spark, docs, rows, tmp_path, quick_fits):
    """run() over nulls, empty texts, ties and repeated rows: each stage's decision by plain Python, given the classifier's."""
    import corpus_pipeline

    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(0, 60, 3)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    good = [tuple(r) for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d).select("doc_id", "text").collect()]
    assert len(good) <= len(rows)
    best = {}
    for i, t in good:
        k = BLANK.sub("", t or "")
        best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
    once = [(i, next(t for j, t in good if j == i)) for _, i in best.values()]
    near = brute_components(once)
    left = [(i, t) for i, t in once if near[i][1] == i]
    taken = {r.doc_id: r.copies for r in source_mix.mix(docs.dropDuplicates(["doc_id"]).where(F.col("doc_id").isin([i for i, _ in left]))).collect()}
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, d).collect())
    assert got == Counter({i: n for i, n in taken.items() if n})
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/none/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").write.parquet(f"{d}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{d}/none").count() == 0
