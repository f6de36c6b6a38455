"""Small pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the contracts: the six ASCII characters, in a regular expression's brackets.
BLANKS = r"\x20\x09-\x0D"
ASCII_BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key with at least one part in so many of all rows counts as hot; there are at most so many hot keys.
HOT_KEYS = 1000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: Column) -> Column:
    """The runs of other than ASCII white space; null gives an empty array."""
    trimmed = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " +"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left-join groups to rows by key, when one key may hold a third of all rows.

    Keys of at least total / HOT_KEYS rows are at most HOT_KEYS many, so those groups are broadcast; in the shuffled
    join of the rest no key has more than that part of the rows.
    """
    least = max(2, total // HOT_KEYS)
    hot = F.broadcast(groups.where(F.col(size) >= least).withColumn("_hot", F.lit(True)))
    first = rows.join(hot, key, "left")
    names = [c for c in groups.columns if c != key]
    done = first.where("_hot").select(*rows.columns, *names)
    rest = first.where("_hot is null").select(*rows.columns).join(groups.where(F.col(size) < least), key, "left").select(*rows.columns, *names)
    return done.unionByName(rest)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of counts with the largest n, `most` at most: those of at least 2**k, with the least k that fits."""
    power, held, least = F.floor(F.log2(n)).cast("int"), 0, 64
    for row in counts.groupBy(power.alias("k")).agg(F.count("*").alias("rows")).orderBy(F.desc("k")).collect():  # 63 rows at most
        held += row["rows"]
        if held > most:
            break
        least = row["k"]
    return counts.where(power >= least)


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of df by their quoted names, as a name may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
