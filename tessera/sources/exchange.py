"""Exchange of projects and sessions as JSON lines: exports of named fields alone, strict imports, and a list of what is
stored that bears with broken payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tessera.functions import text as T
from tessera.sources.shared import checkpointed

#: Reasons of refusal, in the order in which they are looked for.
REASONS = ("not JSON", "not an object", "another version", "another envelope", "another payload", "known id")


def allowed(value: Column, kind: DataType) -> Column:
    """``value`` with the fields of ``kind`` alone, at every depth and in their order."""
    if isinstance(kind, StructType):
        fields = F.struct(*(allowed(value[f.name], f.dataType).alias(f.name) for f in kind))
        return F.when(value.isNotNull(), fields)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: allowed(x, kind.elementType))
    return value.cast(kind)


def envelopes(rows: DataFrame, kind: StructType, payload: str = "session", version: int = 1, name: str | None = None) -> DataFrame:
    """(value): a line of JSON for each row, with its version, its kind if it has a ``name``, and of the row the fields of
    ``kind`` alone."""
    held = F.struct(*(allowed(F.col(f.name), f.dataType).alias(f.name) for f in kind)).alias(payload)
    named = [F.lit(name).alias("kind")] if name else []
    return rows.select(F.to_json(F.struct(F.lit(version).alias("version"), *named, held), {"ignoreNullFields": "false"}).alias("value"))


def admit(lines: DataFrame, kind: StructType, existing: DataFrame, id_: str, payload: str = "session", version: int = 1, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of ``lines`` (ord, value): rows have ord and the fields of ``kind``; rejects ord, value and the first
    of ``REASONS`` that holds.

    A payload is of the kind if it is what the kind's fields can hold: read and written again it is the same JSON. So a key
    too many, a key that is missing (null is a value) and a value of another type are refused at any depth. Of lines with one id the
    first is admitted, unless ``existing`` has that id."""
    keys = sorted(["version", payload, *(["kind"] if name else [])])
    whole = lines.select("ord", "value", T.canonical_json("value").alias("_whole"))  # null unless all of the line is JSON
    held = F.get_json_object("_whole", f"$.{payload}")
    x = whole.select("ord", "value", "_whole", F.try_parse_json("_whole").alias("_v"), T.canonical_json(held).alias("_told"), F.from_json(held, kind).alias("_row"))
    x = x.withColumn("_shown", T.canonical_json(F.to_json("_row", {"ignoreNullFields": "false"})))
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    envelope = F.array_sort(F.json_object_keys("_whole")) == F.array(*(F.lit(k) for k in keys))
    if name:
        envelope &= F.coalesce(F.try_variant_get("_v", "$.kind", "string") == name, F.lit(False))
    same = F.coalesce(F.col("_told") == F.col("_shown"), F.lit(False)) & F.col(f"_row.{id_}").isNotNull()
    why = (
        F.when(F.col("_v").isNull(), REASONS[0])
        .when(~is_object, REASONS[1])
        .when(~F.coalesce(F.try_variant_get("_v", "$.version", "double") == version, F.lit(False)), REASONS[2])
        .when(~F.coalesce(envelope, F.lit(False)), REASONS[3])
        .when(~same, REASONS[4])
    )
    judged = checkpointed(x.select("ord", "value", "_row", why.alias("why")))
    sound = judged.where("why is null").select("ord", "value", "_row", F.col(f"_row.{id_}").alias("_id"))
    known = existing.select(F.col(id_).alias("_id")).distinct().withColumn("_known", F.lit(True))
    first = sound.groupBy("_id").agg(F.min("ord").alias("_first"))
    y = sound.join(first, "_id").join(known, "_id", "left").withColumn("_fresh", F.col("_known").isNull() & (F.col("ord") == F.col("_first")))
    rejects = judged.where("why is not null").select("ord", "value", "why")
    return y.where("_fresh").select("ord", "_row.*"), rejects.unionByName(y.where("not _fresh").select("ord", "value", F.lit(REASONS[5]).alias("why")))


def listed(sessions: DataFrame) -> DataFrame:
    """(project_id, project_name, step, revision, updated_at, n_findings) of each project's latest revision, the last
    updated first. ``sessions`` has project_id, revision, updated_at and payload (JSON). A payload without a project is not
    listed; a name, a step or findings that are missing or of another type are the id, ``unknown`` and none."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("revision"), F.desc("updated_at")))
    last = sessions.withColumn("_n", rank).where("_n = 1").withColumn("_v", F.try_parse_json("payload"))
    project = F.try_variant_get("_v", "$.project", "variant")
    there = F.schema_of_variant(project).startswith("OBJECT")
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("_v", path, "variant")) == "STRING", F.try_variant_get("_v", path, "string"))
    return last.where(F.coalesce(there, F.lit(False))).select(
        "project_id",
        F.coalesce(text("$.project.projectName"), F.col("project_id").cast("string")).alias("project_name"),
        F.coalesce(text("$.project.workflowStep"), F.lit("unknown")).alias("step"),
        "revision",
        "updated_at",
        F.greatest(F.coalesce(F.size(F.try_variant_get("_v", "$.project.findings", "array<variant>")), F.lit(0)), F.lit(0)).alias("n_findings"),
    ).orderBy(F.desc("updated_at"), "project_id")
