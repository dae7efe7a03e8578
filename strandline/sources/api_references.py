"""Schema references of OpenAPI documents: which schemas a request or a response needs, however far they refer to each other.

A document becomes a table of its places: every object and array has a JSON pointer, found level by level with variants, and an object with
`$ref` has the pointer that it names. References meet as pointers then, by equality: a reference stands below each of its ancestors, so "all
references inside this schema" is a join on the schema's pointer, and following one is the same join again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.functions.tables import cut

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def places(docs: DataFrame, key: str = "application_id", document: str = "document") -> DataFrame:
    """(key, pointer, ref): every object and array of each document, from `#` on, with the text of its `$ref` (null: none). Documents that are no
    JSON have no place; of two documents with one key both are taken as one."""
    v = docs.select(F.col(key).alias("key"), F.lit("#").alias("pointer"), F.try_parse_json(F.col(document)).alias("v")).where("v is not null")
    level, out = cut(v.select("key", "pointer", F.to_json("v").alias("j")), "places"), None
    while not level.isEmpty():
        held = F.col("j").startswith("{")  # to_json writes no space, so the first character tells what it is
        ref = F.when(held, F.try_variant_get(F.parse_json("j"), "$['$ref']", "string"))
        found = level.select("key", "pointer", ref.alias("ref"))
        out = found if out is None else out.union(found)
        fields = F.map_entries(F.parse_json("j").cast("map<string,variant>"))
        items = F.transform(F.parse_json("j").cast("array<variant>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
        below = level.select("key", "pointer", F.explode(F.when(held, fields).otherwise(items)).alias("c"))
        step = F.replace(F.replace("c.key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        below = below.select("key", F.concat("pointer", F.lit("/"), step).alias("pointer"), F.to_json("c.value").alias("j"))
        level = cut(below.where(F.substring("j", 1, 1).isin("{", "[")), "places")
    return out if out is not None else v.select("key", "pointer", F.lit(None).cast("string").alias("ref"))


def _ancestors(pointer):
    parts = F.split(pointer, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def _resolved(at: DataFrame, refs: DataFrame, known: DataFrame) -> DataFrame:
    """at(..., key, pointer) with each pointer that is a reference itself replaced by what it names, again and again; those that go round in
    circles or name nothing end."""
    done, left = None, at
    seen = F.array("pointer")
    left = cut(left.withColumn("_seen", seen), "resolving")
    cols = at.columns
    while not left.isEmpty():
        d = left.join(refs.select("key", "pointer", F.col("ref").alias("_to")), ["key", "pointer"], "left")
        found = d.where("_to is null").select(*cols).join(known, ["key", "pointer"], "left_semi").select(*cols)
        done = found if done is None else done.union(found)
        again = d.where("_to is not null and not array_contains(_seen, _to)")
        left = cut(again.select(*[F.col("_to").alias("pointer") if c == "pointer" else c for c in cols], F.concat("_seen", F.array("_to")).alias("_seen")), "resolving")
    return at.limit(0) if done is None else cut(done.distinct(), "resolved")


def references(docs: DataFrame, key: str = "application_id", document: str = "document") -> DataFrame:
    """(key, method, path, side, refs, missing, external, cyclic): for each operation the references that the schemas of its request and of its
    responses need, in order: all, those that name nothing in the document, those to other documents (not followed), and those on a way
    that comes back to itself. A reference is followed once, so circles end. Operations without a reference have empty arrays.
    """
    p = cut(places(docs, key, document), "all-places")
    known = p.select("key", "pointer").distinct()
    refs = cut(p.where("ref is not null").select("key", "pointer", "ref"), "refs")
    parts = F.split("pointer", "/")
    ops = p.where((F.size(parts) == 4) & (F.get(parts, F.lit(1)) == "paths") & F.get(parts, F.lit(3)).isin(*METHODS))
    ops = cut(ops.select("key", F.col("pointer").alias("op")).distinct(), "operations")

    child = lambda d, name: d.select(*[c for c in d.columns if c != "pointer"], F.concat("pointer", F.lit(f"/{name}")).alias("pointer")).join(known, ["key", "pointer"], "left_semi")

    def children(d: DataFrame) -> DataFrame:
        up = known.select("key", F.regexp_replace("pointer", "/[^/]*$", "").alias("_up"), F.col("pointer").alias("_down"))
        return d.join(up, (d["key"] == up["key"]) & (d["pointer"] == up["_up"])).select(*[F.col("_down").alias("pointer") if c == "pointer" else d[c] for c in d.columns])

    at = ops.select("key", "op", F.col("op").alias("pointer"))
    answers = children(child(at, "responses")).where(~F.regexp_extract("pointer", "([^/]*)$", 1).startswith("x-"))
    bodies = child(at, "requestBody").withColumn("side", F.lit("request")).unionByName(answers.withColumn("side", F.lit("response"))).select("key", "op", "side", "pointer")
    media = _resolved(children(child(_resolved(bodies, refs, known), "content")), refs, known)
    frontier = cut(child(media, "schema").select("key", "op", "side", "pointer").distinct(), "schemas")

    inside = cut(refs.select("key", F.explode(_ancestors(F.col("pointer"))).alias("pointer"), "ref").distinct(), "inside")
    reached = cut(frontier.join(inside, ["key", "pointer"]).select("key", "op", "side", "ref").distinct(), "needed")
    frontier = reached
    while not frontier.isEmpty():
        new = frontier.withColumnRenamed("ref", "pointer").join(inside, ["key", "pointer"]).select("key", "op", "side", "ref").distinct()
        frontier = cut(new.join(reached, ["key", "op", "side", "ref"], "left_anti"), "needed")
        reached = reached.union(frontier)

    steps = cut(inside.join(refs.select("key", F.col("ref").alias("pointer")).distinct(), ["key", "pointer"], "left_semi").select("key", F.col("pointer").alias("a"), F.col("ref").alias("b")).distinct(), "ref-steps")
    left = -1
    while left != (now := steps.count()):  # what leads nowhere goes, and what nothing leads to: circles, and the ways between them, stay
        left = now
        ahead, behind = steps.select("key", F.col("a").alias("b")).distinct(), steps.select("key", F.col("b").alias("a")).distinct()
        steps = cut(steps.join(ahead, ["key", "b"], "left_semi").join(behind, ["key", "a"], "left_semi"), "ref-steps")
    circles = steps.select("key", F.col("a").alias("ref")).distinct().withColumn("_round", F.lit(True))

    local = F.col("ref") == "#"
    local = local | F.col("ref").startswith("#/")
    judged = reached.join(known.select("key", F.col("pointer").alias("ref"), F.lit(True).alias("_there")), ["key", "ref"], "left").join(circles, ["key", "ref"], "left")
    listed = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("ref"))))
    g = judged.groupBy("key", "op", "side").agg(F.array_sort(F.collect_set("ref")).alias("refs"), listed(local & F.col("_there").isNull()).alias("missing"), listed(~local).alias("external"), listed(F.col("_round")).alias("cyclic"))
    sides = ops.withColumn("side", F.explode(F.array(F.lit("request"), F.lit("response"))))
    d = sides.join(g, ["key", "op", "side"], "left")
    parts = F.split("op", "/")
    path = F.replace(F.replace(F.get(parts, F.lit(2)), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    none = F.array().cast("array<string>")
    return d.select(F.col("key").alias(key), F.upper(F.get(parts, F.lit(3))).alias("method"), tx.endpoint_path(path).alias("path"), "side", *[F.coalesce(c, none).alias(c) for c in ("refs", "missing", "external", "cyclic")])
