"""Query results on disk: JSON with metadata, or raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "array<struct<name:string,ID:string,datatype:string,unit:string,description:string>>"
ENVELOPE = f"metadata struct<fields:{FIELDS}>, data array<map<string,string>>, rows array<map<string,string>>"


def parse(text: Column) -> dict[str, Column]:
    """columns and rows of JSON answers: what is missing is empty, `rows` stands in for `data`, a column's ID for its name."""
    doc = F.from_json(text, ENVELOPE)
    fields = F.coalesce(doc["metadata"]["fields"], F.from_json(F.lit("[]"), FIELDS))
    columns = F.transform(fields, lambda f: F.struct(F.coalesce(f["name"], f["ID"], F.lit("unknown")).alias("name"), F.coalesce(f["datatype"], F.lit("string")).alias("datatype"), f["unit"].alias("unit"), f["description"].alias("description")))
    rows = F.coalesce(doc["data"], doc["rows"], F.from_json(F.lit("[]"), "array<map<string,string>>"))
    return {"columns": columns, "rows": rows, "row_count": F.size(rows)}


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, columns, rows, row_count), one row a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", *(c.alias(k) for k, c in parse(F.col("value")).items()))


#: Spark types of the datatypes that field lists name; all others are texts.
KINDS = {"double": "double", "float": "float", "int": "int", "long": "long", "short": "short", "boolean": "boolean", "timestamp": "timestamp"}
#: From narrow to wide: what two files call a field by different numeric types gets the wider one.
NUMBERS = ["short", "int", "long", "float", "double"]


def merged(kinds: Column) -> Column:
    """One type for what files say of a field: the widest number (double if a float meets a long), or else text."""
    place = F.transform(kinds, lambda k: F.array_position(F.array(*map(F.lit, NUMBERS)), k))
    widest, whole = F.array_max(place), F.array_max(F.filter(place, lambda p: p <= 3))
    number = F.when((widest == 4) & (whole == 3), "double").otherwise(F.element_at(F.array(*map(F.lit, NUMBERS)), F.greatest(widest, F.lit(1)).cast("int")))
    return F.when(F.size(kinds) == 1, kinds[0]).when(F.array_min(place) > 0, number).otherwise("string")


def read_answers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, columns, rows): the answers as variants, one row a file, or one a line of it; what is no JSON object has neither columns nor rows."""
    files = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    get = lambda place, kind: F.try_variant_get("v", place, kind)
    fields = F.coalesce(get("$.metadata.fields", FIELDS), F.array().cast(FIELDS))
    columns = F.transform(fields, lambda f: F.struct(F.coalesce(f["name"], f["ID"], F.lit("unknown")).alias("name"), F.coalesce(f["datatype"], F.lit("string")).alias("datatype"), f["unit"].alias("unit"), f["description"].alias("description")))
    listed = "array<map<string,variant>>"
    return files.select("file", columns.alias("columns"), F.coalesce(get("$.data", listed), get("$.rows", listed), F.array().cast(listed)).alias("rows"))


def answer_fields(answers: DataFrame) -> DataFrame:
    """(name, kind, unit, description, first) of all fields of all files: those of field lists first, then what only rows have, with the type that all its values fit."""
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("c.datatype")), F.lit("string"))
    said = answers.select("file", F.posexplode("columns").alias("place", "c")).groupBy(F.col("c.name").alias("name")).agg(
        merged(F.array_sort(F.collect_set(kind))).alias("kind"),
        *(F.min_by(f"c.{x}", F.when(F.length(f"c.{x}") > 0, F.struct("file", "place", f"c.{x}"))).alias(x) for x in ("unit", "description")), F.min(F.struct(F.lit(0).alias("later"), F.col("file").alias("at"), F.col("place").cast("string").alias("name"))).alias("first"),
    )
    values = answers.select(F.explode("rows").alias("r")).select(F.explode("r").alias("name", "value"))
    held = values.groupBy("name").agg(F.schema_of_variant_agg("value").alias("kind")).join(said, "name", "left_anti")
    none = F.lit(None).cast("string")
    return said.unionByName(held.select("name", F.when(F.col("kind") == "VOID", "string").otherwise(F.col("kind")).alias("kind"), none.alias("unit"), none.alias("description"), F.struct(F.lit(1).alias("later"), F.lit("").alias("at"), F.col("name")).alias("first")))


def read_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The rows of all files as one typed frame, whatever fields each file (or each line, where a file holds many answers) has; units and descriptions go to the columns' metadata. A value that does not fit its column is null.

    The fields of all files are gathered by Spark; only their list, a row for each, comes to the driver.
    """
    answers = read_answers(spark, path, lines)
    fields = answer_fields(answers).orderBy("first").collect()
    rows = answers.select(F.explode("rows").alias("r"))
    out = rows.select(*(F.try_variant_get(F.try_element_at("r", F.lit(f["name"])), "$", f["kind"].replace("OBJECT<", "STRUCT<")).alias(f["name"]) for f in fields))
    for f in fields:
        out = out.withMetadata(f["name"], {k: f[k] for k in ("unit", "description") if f[k]})
    return out


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """CSV or VOTable answers as they are: one row a file, column raw, row_count 0."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.lit(0).alias("row_count"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Extension: the same, typed."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_votable(spark: SparkSession, path: str) -> DataFrame:
    """Extension: table cells of VOTable files as arrays of text."""
    return spark.read.option("rowTag", "TR").schema("TD array<string>").xml(path).select(F.col("TD").alias("cells"))
