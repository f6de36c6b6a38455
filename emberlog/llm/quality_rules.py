"""Quality rules (8): a ledger of failure bits and measurements, and versioned policies over it. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ASCII_BLANKS, BLANKS, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Rule name, bit, and the failure condition over the ledger's measurements. Bits keep their meaning for ever.
RULES: tuple[tuple[str, int, str], ...] = (
    ("too_few_words", 0, "n_words < 20"),
    ("repeated_words", 1, "100 * n_repeat_words > 30 * n_words"),
    ("duplicate_lines", 2, "2 * n_dup_lines > n_lines AND n_lines >= 4"),
    ("symbol_heavy", 3, "10 * n_symbols > n_words AND n_symbols >= 10"),
    ("short_words", 4, "word_chars < 2 * n_words"),
    ("long_words", 5, "word_chars > 20 * n_words AND n_words > 0"),
    ("shouting", 6, "2 * n_upper > word_chars AND word_chars >= 40"),
    ("few_letters", 7, "2 * n_letters < word_chars AND word_chars >= 40"),
)
BASE_BITS = ("too_few_words", "repeated_words")

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE_BITS,
    "v1": (*BASE_BITS, "duplicate_lines", "symbol_heavy", "short_words", "long_words"),
    "v2": tuple(name for name, _, _ in RULES),
}


def bits(names: tuple[str, ...]) -> int:
    return sum(1 << bit for name, bit, _ in RULES if name in names)


def _pairs(h: Column, step: int) -> Column:
    """Hashes of elements that lie `step` apart: from hashes of runs of `step` words those of runs of twice as many."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, step + 1, n), lambda a, b: F.xxhash64(a, b))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_letters).

    Words are runs without ASCII white space. n_repeat_words counts the words that lie in an 8-word window that the
    same text holds twice or more. Windows are compared by 64-bit hashes, made by doubling (1, 2, 4, 8 words), so each
    word costs three hashes. Only texts in which a hash repeats sort their windows. All of a text stays in its row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    d = d.withColumn("w", words(F.col("t"))).withColumn("bare", F.translate("t", ASCII_BLANKS, ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]")))
    chars = F.char_length("bare")
    d = d.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
        (chars - F.char_length(F.translate("bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("bare", r"\P{Lu}+", "")).cast("long").alias("n_upper"), (chars - F.length(F.regexp_replace("bare", r"\p{L}+", ""))).cast("long").alias("n_letters"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    for step in (1, 2, 4):
        d = d.withColumn("h", _pairs(F.col("h"), step))
    d = d.withColumn("h", F.when(F.size("h") > F.size(F.array_distinct("h")), F.col("h")))
    d = d.withColumn("at", F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    n = F.size("at")
    same = F.zip_with(F.slice("at", 1, F.greatest(n - 1, F.lit(0))), F.slice("at", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    d = d.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    gaps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0), lambda s, x: s + x)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_upper", "n_letters")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and `failed`, a bit for each rule that a document fails; every rule is evaluated once.

    Null and empty texts measure 0 and fail too_few_words. Each input row has its own ledger row; ids may be null or
    repeat; other columns of docs are not read. An empty table gives an empty ledger.
    """
    failed = F.lit(0).cast("long")
    for _, bit, rule in RULES:
        failed = failed + F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0))
    return measured(docs, id_col, text_col).withColumn("failed", failed)


def judged(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Add base_failed and kept under a policy, from the bits alone."""
    return book.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(bits(BASE_BITS))) != 0).withColumn("kept", F.col("failed").bitwiseAND(F.lit(bits(POLICIES[policy]) | bits(BASE_BITS))) == 0)


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy keeps without it."""
    mask = bits(POLICIES[policy])
    own = F.col("failed").bitwiseAND(F.lit(mask))
    names = [(name, bit) for name, bit, _ in RULES if mask >> bit & 1]
    sums = [F.count_if(own.bitwiseAND(F.lit(1 << bit)) != 0).alias(f"f{bit}") for _, bit in names]
    sums += [F.count_if(own == (1 << bit)).alias(f"o{bit}") for _, bit in names]
    one = book.agg(F.count_if(own == 0).alias("kept"), *sums)
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"f{bit}").alias("n_failed"), F.col(f"o{bit}").alias("n_only"), (F.col("kept") + F.col(f"o{bit}")).alias("n_kept_without")) for name, bit in names)))
    return one.select(rows.alias("r")).select("r.*")
