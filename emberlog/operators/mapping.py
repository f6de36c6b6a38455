"""Which evidence may be mapped, and which chosen techniques stand (R13, R14, A27), and folds over a case's evidence and actions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import cut, free

#: Reasons and what they make of a piece of evidence; the worst counts (fixed values).
CONTEXT, EXCLUDED = ("CONTRADICTING", "EMPTY_RESULT"), ("NO_RAW_REFS", "PROVENANCE_ISSUE", "AMBIGUOUS_RAW_REF", "UNOBSERVED_RAW_REF")
FATAL = ("UNIT_NOT_TARGET", "INVALID_TECHNIQUE_ID", "REVOKED_OR_DEPRECATED", "NOT_IN_CANDIDATES", "UNIT_EVIDENCE_NOT_CITED", "EMPTY_REASON")
TECHNIQUE_ID = r"^T[0-9]{4}([.][0-9]{3})?$"


def eligibility(evidence: DataFrame, observed: DataFrame) -> DataFrame:
    """(incident_id, evidence_id, status, reasons): target, context or excluded.

    evidence: (incident_id, evidence_id, refs, contradicting, empty_result, issue); observed: (incident_id, ref, location).
    """
    places = observed.groupBy("incident_id", "ref").agg(F.count_distinct("location").alias("_places"))
    each = evidence.select("*", F.explode_outer(F.array_distinct("refs")).alias("ref")).join(places, ["incident_id", "ref"], "left")
    g = each.groupBy("incident_id", "evidence_id").agg(
        *(F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("contradicting", "empty_result", "issue")), F.count("ref").alias("n"),
        F.count_if(F.col("_places") > 1).alias("ambiguous"), F.count_if(F.col("ref").isNotNull() & F.col("_places").isNull()).alias("unobserved"),
    )
    tests = (
        ("CONTRADICTING", F.col("contradicting")), ("EMPTY_RESULT", F.col("empty_result")), ("NO_RAW_REFS", ~F.col("empty_result") & (F.col("n") == 0)), ("PROVENANCE_ISSUE", F.col("issue")),
        ("AMBIGUOUS_RAW_REF", F.col("ambiguous") > 0), ("UNOBSERVED_RAW_REF", F.col("unobserved") > 0),
    )
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in tests)))
    is_in = lambda codes: F.arrays_overlap("reasons", F.array(*map(F.lit, codes)))
    g = g.withColumn("reasons", reasons)
    return g.select("incident_id", "evidence_id", F.when(is_in(EXCLUDED), "excluded").when(is_in(CONTEXT), "context").otherwise("target").alias("status"), "reasons")


def checked_selections(selections: DataFrame, candidates: DataFrame, catalog: DataFrame, eligible: DataFrame) -> DataFrame:
    """selections with technique (upper case, trimmed), errors and accepted.

    selections: (incident_id, unit_id, nth, technique_id, evidence_id (the unit's), cited, reason), a row for each choice;
    candidates: (unit_id, technique_id); catalog: (technique_id, parent, revoked, deprecated); eligible: of eligibility().
    A choice with a fatal error goes; other errors only name cited evidence that does not count. Of a technique that a
    unit chose twice the later choice is DUPLICATE_SELECTION.
    """
    chosen = cut(selections, "chosen")
    n = chosen.count()
    s = chosen.withColumn("technique", F.upper(F.trim(F.coalesce("technique_id", F.lit("")))))
    known = catalog.select(F.col("technique_id").alias("_t"), (F.coalesce("revoked", F.lit(False)) | F.coalesce("deprecated", F.lit(False))).alias("_gone"))
    # what a unit was offered, and what is wrong with its other citations, is one row a unit: all meet by unit, in one shuffle
    offered = candidates.groupBy(F.col("unit_id").alias("_u")).agg(F.collect_set(F.upper(F.trim("technique_id"))).alias("_may"))
    own = eligible.select(F.col("incident_id").alias("_i"), F.col("evidence_id").alias("_e"), F.col("status").alias("_status"))
    other = chosen.select("unit_id", "nth", "incident_id", "evidence_id", F.explode(F.array_distinct("cited")).alias("_cited")).where("_cited <> evidence_id").drop("evidence_id")
    other = other.join(eligible.select("incident_id", F.col("evidence_id").alias("_cited"), "status"), ["incident_id", "_cited"], "left")
    code = F.when(F.col("status").isNull(), "UNKNOWN_EVIDENCE_ID").when(F.col("status") != "target", "EVIDENCE_NOT_MAPPABLE").otherwise("EVIDENCE_OUTSIDE_UNIT")
    other = other.where("nth is not null").groupBy(F.col("unit_id").alias("_u2"), "nth").agg(F.array_sort(F.collect_set(code)).alias("codes")).groupBy("_u2").agg(F.map_from_entries(F.collect_list(F.struct("nth", "codes"))).alias("_all"))
    # a catalog has some hundreds of techniques
    s = s.join(F.broadcast(known), F.col("technique") == F.col("_t"), "left").join(own, (F.col("incident_id") == F.col("_i")) & (F.col("evidence_id") == F.col("_e")), "left")
    s = s.join(offered, F.col("unit_id") == F.col("_u"), "left").join(other, F.col("unit_id") == F.col("_u2"), "left")
    s = s.withColumns({"_offered": F.coalesce(F.array_contains("_may", F.col("technique")), F.lit(False)), "_others": F.col("_all")[F.col("nth")]})
    valid = F.col("technique").rlike(TECHNIQUE_ID) & F.col("_t").isNotNull()
    tests = (
        ("UNIT_NOT_TARGET", F.coalesce(F.col("_status") != "target", F.lit(True))), ("INVALID_TECHNIQUE_ID", ~valid), ("REVOKED_OR_DEPRECATED", valid & F.coalesce("_gone", F.lit(False))), ("NOT_IN_CANDIDATES", ~F.col("_offered")),
        ("UNIT_EVIDENCE_NOT_CITED", ~F.coalesce(F.array_contains("cited", F.col("evidence_id")), F.lit(False))), ("EMPTY_REASON", F.trim(F.coalesce("reason", F.lit(""))) == ""),
    )
    assert tuple(c for c, _ in tests) == FATAL
    s = s.withColumn("_ok", ~reduce(Column.__or__, (test for _, test in tests)))
    errors = F.concat(F.array_remove(F.array(*(F.when(test, c).otherwise("") for c, test in tests)), ""), F.coalesce("_others", F.array().cast("array<string>")))
    nth = F.row_number().over(Window.partitionBy("unit_id", "technique", "_ok").orderBy("nth"))
    s = s.withColumn("_again", F.col("_ok") & (nth > 1))
    out = s.select(*selections.columns, "technique", F.when(F.col("_again"), F.array_append(errors, F.lit("DUPLICATE_SELECTION"))).otherwise(errors).alias("errors"), (F.col("_ok") & ~F.col("_again")).alias("accepted"))
    out = cut(out, "checked", 4 * n)
    free(chosen)
    return out


def merged_selections(accepted: DataFrame, catalog: DataFrame) -> DataFrame:
    """(incident_id, technique, evidence_ids, n_units): a technique goes from a unit that chose a sub-technique of it."""
    parents = accepted.join(F.broadcast(catalog.where("parent is not null").select(F.col("technique_id").alias("technique"), "parent")), "technique").select("unit_id", F.col("parent").alias("technique")).distinct()
    left = accepted.select("incident_id", "unit_id", "technique", "evidence_id").join(parents, ["unit_id", "technique"], "left_anti")
    return left.groupBy("incident_id", "technique").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.count_distinct("unit_id").alias("n_units"))


def without_repeats(evidence: DataFrame) -> DataFrame:
    """evidence (incident_id, seq, refs, contribution) with repeated and contribution: it counts nothing if all its refs
    were cited before. A ref's first citation is found once, so no list of earlier refs grows along a case."""
    each = evidence.select("incident_id", "seq", F.explode(F.array_distinct("refs")).alias("_ref"))
    first = each.withColumn("_first", F.min("seq").over(Window.partitionBy("incident_id", "_ref")))
    old = first.groupBy("incident_id", "seq").agg((F.max("_first") < F.col("seq")).alias("repeated"))
    j = evidence.join(old, ["incident_id", "seq"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    return j.withColumn("contribution", F.when(F.col("repeated"), 0.0).otherwise(F.col("contribution")))


def confidence(evidence: DataFrame, start: float = 0.0) -> DataFrame:
    """(incident_id, confidence): contributions added in order, kept within 0 and 1 and rounded to six places at each step."""
    step = lambda total, x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total + x["contribution"])), 6)
    told = evidence.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("contribution", F.lit(0.0)).alias("contribution")))).alias("all"))
    return told.select("incident_id", F.aggregate("all", F.lit(float(start)), step).alias("confidence"))


def renumbered(actions: DataFrame, *tie: str) -> DataFrame:
    """actions (incident_id, category, priority) with number: immediate ones first, then what needs a check, each by priority; others go."""
    own = actions.where(F.col("category").isin("immediate", "verify_needed"))
    return own.withColumn("number", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.col("category") != "immediate", "priority", *tie)).cast("long"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once: an optimizer copies a named column to where a lambda uses it, a lambda's variable never."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Actions of a case whose open needs fit the bits of a whole number.
BITS = 63


def in_order(actions: DataFrame, after: DataFrame | None = None, priority: str = "priority", needs: str | None = None) -> DataFrame:
    """actions (incident_id, action_id, priority) with place: each after those it depends on, smallest (priority, id) first.

    after: (incident_id, action_id, needs); instead of it, or beside it, a column of actions (named by `needs`, not returned) may hold
    an array of what the action needs, so that nothing else is shuffled. Needs that are no actions of the case are ignored. What a
    cycle leaves over follows by priority and id. One shuffle brings a case together (a case has at most a few dozen actions, one a
    template). Where priority and id are such an order already, that is it; else a fold over the case's array takes one action a step,
    with needs and what is done as bits, or as arrays in a case of more than BITS actions. Rows of one id share a place, that of their
    smallest priority; a null id has no place; actions of a null case are a case of their own.
    """
    names = [c for c in actions.columns if c != needs]
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    kind = actions.schema["action_id"].dataType.simpleString()
    told = F.struct("action_id", F.col(f"`{needs}`").alias("needs")) if needs else F.lit(None).cast(f"struct<action_id:{kind},needs:array<{kind}>>")
    a = actions.select("incident_id", row.alias("_row"), told.alias("_after"))
    if after is not None:
        n = after.select("incident_id", F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct("action_id", F.array("needs").alias("needs")).alias("_after"))
        a = a.unionByName(n)
    case = a.groupBy("incident_id").agg(F.collect_list("_row").alias("_rows"), F.collect_list("_after").alias("_after"))
    # the ids of a case by priority; what needs what, by their places there
    ids = F.transform(F.array_sort(F.transform(F.filter("_rows", lambda r: r["action_id"].isNotNull()), lambda r: F.struct(r[priority].alias("p"), r["action_id"].alias("id")))), lambda r: r["id"])
    case = case.withColumn("_ids", F.array_distinct(ids))
    at = lambda x: F.array_position("_ids", x).cast("int")
    pairs = F.flatten(F.transform("_after", lambda x: F.transform(F.coalesce(x["needs"], F.array().cast(f"array<{kind}>")), lambda y: F.struct(at(x["action_id"]).alias("i"), at(y).alias("j")))))
    case = case.withColumn("_pairs", F.filter(pairs, lambda x: (x["i"] > 0) & (x["j"] > 0) & (x["i"] != x["j"])))
    places = F.sequence(F.lit(1), F.size("_ids"))

    def by_bits() -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)
        needed = F.transform(places, lambda i: F.aggregate(F.filter("_pairs", lambda x: x["i"] == i), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(x["j"]))))
        state = lambda done, order, needed: F.named_struct(F.lit("done"), done, F.lit("order"), order, F.lit("needed"), needed)

        def step(s: Column, _: Column) -> Column:
            open_ = lambda i: s["done"].bitwiseAND(bit(i)) == 0
            free = F.array_position(F.transform(s["needed"], lambda m, k: open_(k + 1) & (m.bitwiseAND(F.bitwise_not(s["done"])) == 0)), True).cast("int")
            rest = F.concat(s["order"], F.filter(places, open_))
            return _let(free, lambda f: F.when(f > 0, state(s["done"].bitwiseOR(bit(f)), F.array_append(s["order"], f), s["needed"])).otherwise(state(F.lit(-1).cast("long"), rest, s["needed"])))

        return F.aggregate("_ids", state(F.lit(0).cast("long"), F.array().cast("array<int>"), needed), step, lambda s: s["order"])

    def by_arrays() -> Column:
        needed = F.transform(places, lambda i: F.transform(F.filter("_pairs", lambda x: x["i"] == i), lambda x: x["j"]))

        def step(done: Column, _: Column) -> Column:
            left = F.filter("_each", lambda x: ~F.array_contains(done, x["i"]))
            free = F.get(F.filter(left, lambda x: F.size(F.array_except(x["needs"], done)) == 0), F.lit(0))
            return F.when(free.isNotNull(), F.array_append(done, free["i"])).otherwise(F.concat(done, F.transform(left, lambda x: x["i"])))

        return F.aggregate("_ids", F.array().cast("array<int>"), step), F.zip_with(places, needed, lambda i, x: F.struct(i.alias("i"), x.alias("needs")))

    long, each = by_arrays()
    few = F.size("_ids") <= BITS
    case = case.withColumn("_each", F.when(~few, each))
    order = F.when(~F.exists("_pairs", lambda x: x["j"] > x["i"]), places).when(few, by_bits()).otherwise(long)
    # the order is made for a case, not for each of its rows: what is exploded holds the places
    place = lambda order, r: F.nullif(F.array_position(order, F.nullif(at(r["action_id"]), F.lit(0))), F.lit(0))
    placed = _let(order, lambda o: F.transform("_rows", lambda r: F.struct(r.alias("_row"), place(o, r).alias("place"))))
    return case.select(F.inline(placed)).select("_row.*", "place")
