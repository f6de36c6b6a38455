"""Token counts (3): pieces counted once for each distinct pre-token, joined to the documents' pre-token frequencies."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import most_frequent
from emberlog.session import cut

#: At most so many frequent pre-tokens are broadcast (about 5 MB, at any corpus size); all others are joined.
COMMON = 200_000
#: Distinct pre-tokens that a task holds before it passes their counts on.
HELD = 300_000

#: The split pattern of CLIP-like tokenizers, as their files state it (fixed value).
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Unicode white space as the tokenizer's pattern \s has it. str.split() also splits at U+001C to U+001F.
SPLIT = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
ODD = re.compile("[\\x1c-\\x1f]")


class PreTokens:
    """Cuts texts where the tokenizer cuts them, before any piece is made.

    words() gives the runs without white space, as no tokenizer of this kind joins, composes or lower-cases across
    white space, and cut() a run's pre-tokens, so that a run that repeats is cut once. With the WORDS pattern these are
    its letters, digits and signs, composed (NFC) and lower-cased as the tokenizer does it. Special strings stay whole.
    The runs of any other tokenizer are not cut, nor are those with a capital whose small letter depends on its
    neighbours or is two characters.
    """

    def __init__(self, model_json: str):
        model = json.loads(model_json)
        steps = (model.get("pre_tokenizer") or {}).get("pretokenizers") or [model.get("pre_tokenizer") or {}]
        norms = (model.get("normalizer") or {}).get("normalizers") or [model.get("normalizer") or {}]
        split = steps[0].get("pattern", {}).get("Regex") if steps[0].get("behavior") == "Removed" and steps[0].get("invert") else None
        known = split == WORDS and [x.get("type") for x in norms] == ["NFC", "Replace", "Lowercase"]
        self.fine = regex.compile(WORDS).findall if known else None
        self.special = {t["content"] for t in model.get("added_tokens", [])}
        self.any_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        if self.any_special and self.any_special.search(text):
            parts = self.any_special.split(text)
            return [x for k, part in enumerate(parts) for x in ([part] if k % 2 else SPLIT.findall(part))]
        return SPLIT.findall(text) if ODD.search(text) else text.split()

    def cut(self, word: str) -> list[str]:
        if self.fine is None or word in self.special:
            return [word]
        if word.isascii():
            return [word.lower()] if word.isalpha() else self.fine(word.lower())
        if "\u0130" in word or "\u03a3" in word:
            return [word]
        return self.fine(unicodedata.normalize("NFC", word).lower())


def pre_token_counts(docs: DataFrame, model_json: str, text_col: str = "text") -> DataFrame:
    """(pre_token, n) over all texts; each task adds up what it reads before anything is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, held = PreTokens(model_json), Counter()

        def passed() -> pa.RecordBatch:
            out: Counter = Counter()
            for word, n in held.items():
                for x in pre.cut(word):
                    out[x] += n
            return pa.RecordBatch.from_pydict({"pre_token": pa.array(out.keys(), pa.string()), "n": pa.array(out.values(), pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(pre.words(text))
                if len(held) > HELD:
                    yield passed()
                    held.clear()
        yield passed()

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(counted, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))


def piece_counts(pre: DataFrame, model_json: str) -> DataFrame:
    """(pre_token, n, pieces): each distinct pre-token goes through the tokenizer once."""
    model = pre.sparkSession.sparkContext.broadcast(model_json)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(model.value)
        t.no_truncation()
        t.no_padding()
        for batch in batches:
            found = t.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64())], ["pre_token", "n", "pieces"])

    return pre.mapInArrow(count, "pre_token string, n long, pieces long")


def token_counts(docs: DataFrame, model_json: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, common: int = COMMON) -> DataFrame:
    """Count every document's tokens without making token ids.

    Three steps: pre-token frequencies of the corpus; pieces of each distinct pre-token; sums by document. Counts of
    the most frequent pre-tokens, `common` at most, are broadcast, which also keeps very frequent words out of the join; for all
    others (document, pre-token, frequency) rows are joined and summed. Null texts count as empty and give 0; ids may
    be null or repeat, each row has its own result. Returns (doc_id, n_bytes, n_tokens, over_limit).
    """
    spark = docs.sparkSession
    pieces = cut(piece_counts(pre_token_counts(docs, model_json, text_col), model_json), "pieces")
    top = most_frequent(pieces, "n", common).select("pre_token", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each document with the sum of its common pre-tokens, and a row for each other pre-token."""
        of, pre = known.value, PreTokens(model_json)
        told: dict[str, tuple[int, list[str]]] = {}  # of a word: the sum of its common pre-tokens, and the others
        for batch in batches:
            row, token, count, size = [], [], [], []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = 0
                rare: dict[str, int] = {}
                for w in pre.words(text):
                    if (t := told.get(w)) is None:
                        cuts = pre.cut(w)
                        t = told[w] = (sum(of.get(x, 0) for x in cuts), [x for x in cuts if x not in of])
                    total += t[0]
                    for x in t[1]:
                        rare[x] = rare.get(x, 0) + 1
                row += [at] * (len(rare) + 1)
                token.append(None)
                token += rare
                count.append(total)
                count += rare.values()
                size.append(len(text.encode()))
                size += [0] * len(rare)
                if len(told) > HELD:
                    told.clear()
            yield pa.RecordBatch.from_pydict({"row_id": pa.array(row, pa.string()), "pre_token": pa.array(token, pa.string()), "n": pa.array(count, pa.int64()), "n_bytes": pa.array(size, pa.int64())})

    # the row id is the place in the input, which a task that is run again finds again; the id column follows it
    rows = docs.select(
        F.concat_ws(":", F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.monotonically_increasing_id()).alias("row_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    parts = cut(rows.mapInArrow(summed, "row_id string, pre_token string, n long, n_bytes long"), "parts")
    rest = parts.where("pre_token is not null").join(pieces.select("pre_token", "pieces"), "pre_token").select("row_id", (F.col("n") * F.col("pieces")).alias("n"), F.lit(0).cast("long").alias("n_bytes"))
    both = parts.where("pre_token is null").select("row_id", "n", "n_bytes").unionByName(rest)
    sums = both.groupBy("row_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    doc_id = F.expr("try_cast(split_part(row_id, ':', 1) AS BIGINT)")
    return sums.select(doc_id.alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
