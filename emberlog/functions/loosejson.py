"""JSON out of texts that a model wrote: objects with fences and small faults (X18), arrays that are cut off."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: A block in fences, a comma before a closing bracket, a key as an item of a list.
FENCED = r"(?s)```(?:json)?\s*\n(.*?)\n?```"
COMMA = r",\s*([\]}])"
BULLET = r'(?m)^(\s*)-\s*"?([A-Za-z_][A-Za-z0-9_]*)"?\s*:'


def json_object(text: Column) -> Column:
    """The first JSON object (as a variant) that the text holds, else null.

    Tried in this order: the text without fences around it, each fenced block, and all from the first opening to the last closing
    brace; each as it stands, then without commas before closing brackets and with list items as keys. Null, empty and other
    texts, and values that are no object, give null. An object with a key twice is not read, other than by parsers that
    take the last one.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(t, "^`+|`+$", ""), r"^json", "")
    whole = F.when(t.startswith("```"), bare).otherwise(t)
    first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    braces = F.when((first > 0) & (F.instr(t, "}") > 0) & (last > first), F.substring(t, first, last - first + 1))
    found = F.array_distinct(F.array_compact(F.concat(F.array(whole), F.regexp_extract_all(t, F.lit(FENCED), F.lit(1)), F.array(braces))))
    mended = lambda c: F.regexp_replace(F.regexp_replace(c, COMMA, "$1"), BULLET, '$1"$2":')
    both = F.flatten(F.transform(found, lambda c: F.array(c, mended(c))))
    objects = F.filter(F.transform(both, F.try_parse_json), lambda v: v.isNotNull() & F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    return F.get(objects, F.lit(0))


TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|"|[\[\]{}]', re.DOTALL)


def spans(text: str) -> tuple[int, list[tuple[int, int]]]:
    """Where the array that opens at the first bracket ends (-1: it doesn't), and the spans of the objects right inside it.

    One pass over strings and brackets, with a stack of what is open; a bracket of the wrong kind or an open string ends it.
    """
    open_, at, found = [], 0, []
    start = text.find("[")
    for m in TOKEN.finditer(text, start) if start >= 0 else ():
        c = m.group()
        if c in "[{":
            if len(open_) == 1 and c == "{":
                at = m.start()
            open_.append(c)
        elif c in "]}":
            if open_.pop() + c not in ("[]", "{}"):
                break
            if not open_:
                return m.end(), found
            if len(open_) == 1 and c == "}":
                found.append((at, m.end()))
        elif c == '"':
            break
    return -1, found


def salvaged(text: str | None) -> list[str]:
    """Items of the first array as JSON; of one that can't be read as a whole the complete objects before the first broken one."""
    text = text or ""
    end, found = spans(text)
    if end > 0:
        try:
            return [json.dumps(x, ensure_ascii=False) for x in json.loads(text[text.find("[") : end])]
        except ValueError:
            pass
    good = []
    for a, b in found:
        try:
            good.append(json.dumps(json.loads(text[a:b]), ensure_ascii=False))
        except ValueError:
            break
    return good


@F.pandas_udf(ArrayType(StringType()))
def json_items(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """salvaged() of each text, by Arrow batches; null and empty texts give an empty array, long ones take one pass."""
    for batch in texts:
        yield batch.map(salvaged, na_action=None)
