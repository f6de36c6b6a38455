"""Technique catalogue from a STIX bundle (S19): one JSON file, read and joined by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OBJECT = (
    "struct<id:string,type:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,x_mitre_shortname:string,"
    "x_mitre_is_subtechnique:boolean,x_mitre_platforms:array<string>,tactic_refs:array<string>,relationship_type:string,source_ref:string,target_ref:string,"
    "external_references:array<struct<source_name:string,external_id:string,url:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>"
)


def plain_description(text: Column) -> Column:
    """The words of a description: without code tags, citations and the targets of links, each line with single blanks, and
    no two empty lines together or at an end."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<code>")), F.lit("</code>"))
    cited = F.split(t, r"\(Citation:")  # what follows a citation begins behind its bracket
    t = F.array_join(F.transform(cited, lambda x, k: F.when(k == 0, x).when(F.instr(x, ")") == 0, F.concat(F.lit("(Citation:"), x)).otherwise(F.substr(x, F.instr(x, ")") + 1))), "")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\((?:https?:/)?/[^)]*\)", "$1")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    lines = F.filter(lines, lambda x, k: (x != "") | F.coalesce(F.get(lines, k - 1) != "", F.lit(False)))
    return F.trim(F.array_join(lines, "\n"), F.lit("\n"))


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tactics, techniques) of a bundle.

    tactics: tactic_id, name, shortname, place in the active matrix's order. techniques: technique_id, name, description,
    tactics (shortnames in that order), parent (of a sub-technique: its relation's, else the id's part before the
    dot), platforms, url, revoked, deprecated, revoked_by. Objects without an id of the catalogue are left out, and so
    are relations and tactics that are revoked or deprecated.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    ref = F.try_element_at(F.filter("external_references", lambda r: r.source_name == "mitre-attack"), F.lit(1))
    objects = spark.read.schema(f"objects array<{OBJECT}>").json(path, multiLine=True).select(F.inline("objects"))
    objects = objects.withColumns({"ref": ref, "gone": flag("revoked") | flag("x_mitre_deprecated")})
    ids = objects.select(F.col("id").alias("_id"), F.col("ref.external_id").alias("_external"))
    order = objects.where("type = 'x-mitre-matrix' and not gone").select(F.posexplode("tactic_refs").alias("place", "id"))
    tactics = objects.where("type = 'x-mitre-tactic' and not gone").join(order, "id")
    tactics = tactics.select(F.col("ref.external_id").alias("tactic_id"), "name", F.col("x_mitre_shortname").alias("shortname"), F.col("place").cast("long").alias("place")).where("tactic_id is not null")

    last = F.row_number().over(Window.partitionBy("source_ref", "relationship_type").orderBy("target_ref"))
    related = objects.where("type = 'relationship' and not gone").withColumn("_nth", last).where("_nth = 1").join(ids, F.col("target_ref") == F.col("_id"))
    named = lambda kind, name: related.where(F.col("relationship_type") == kind).select(F.col("source_ref").alias("id"), F.col("_external").alias(name))
    t = objects.where("type = 'attack-pattern' and ref.external_id is not null").withColumn("technique_id", F.col("ref.external_id"))
    phases = t.select("id", F.explode(F.filter("kill_chain_phases", lambda p: p.kill_chain_name == "mitre-attack")).alias("p")).join(tactics, F.col("p.phase_name") == F.col("shortname"))
    phases = phases.groupBy("id").agg(F.transform(F.array_sort(F.collect_set(F.struct("place", "shortname"))), lambda x: x.shortname).alias("tactics"))
    t = t.join(phases, "id", "left").join(named("subtechnique-of", "_parent"), "id", "left").join(named("revoked-by", "revoked_by"), "id", "left")
    parent = F.when(flag("x_mitre_is_subtechnique"), F.coalesce("_parent", F.substring_index("technique_id", ".", 1)))
    return tactics, t.select(
        "technique_id", F.coalesce("name", F.lit("")).alias("name"), plain_description(F.col("description")).alias("description"), F.coalesce("tactics", F.array().cast("array<string>")).alias("tactics"),
        parent.alias("parent"), F.coalesce("x_mitre_platforms", F.array().cast("array<string>")).alias("platforms"), F.col("ref.url").alias("url"), flag("revoked").alias("revoked"), flag("x_mitre_deprecated").alias("deprecated"), "revoked_by",
    )
