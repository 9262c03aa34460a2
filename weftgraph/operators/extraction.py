"""Records and triples from the text that an extraction model gives back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_FIELD = r"<\|#\|>"


def split_records(df: DataFrame, column: str) -> DataFrame:
    """One row a record: lines, without the end mark and blanks, marks repaired."""
    parts = F.split(F.replace(F.col(column), F.lit(T.END_MARK), F.lit("\n")), "\n")
    rows = df.select("*", F.explode(F.filter(F.transform(parts, T.strip), lambda r: r != "")).alias("record"))
    return rows.withColumn("record", T.repair_marks(F.col("record"))).drop(column)


def entity_records(df: DataFrame) -> DataFrame:
    """Valid entity records of ``record``: four fields, a name, a plain type, a description."""
    rows = df.withColumn("f", F.transform(F.split("record", _FIELD), T.strip))
    rows = rows.where((F.size("f") == 4) & F.get("f", F.lit(0)).contains("entity"))
    # of several types the first that is not blank counts
    kind = F.get(F.filter(F.transform(F.split(F.get("f", F.lit(2)), ","), T.strip), lambda t: t != ""), F.lit(0))
    rows = rows.withColumn("entity_name", T.cut_identifier(F.get("f", F.lit(1)))).withColumn("raw", kind).withColumn("description", F.get("f", F.lit(3)))
    rows = rows.where((F.col("entity_name") != "") & (F.col("description") != "") & F.col("raw").isNotNull() & ~F.col("raw").rlike(r"['()<>|/\\]"))
    return rows.withColumn("entity_type", F.lower(F.replace("raw", F.lit(" "), F.lit("")))).drop("f", "raw")


def relation_records(df: DataFrame) -> DataFrame:
    """Valid relation records: five fields, two different ends, a description; the last field is the weight if it is a number."""
    rows = df.withColumn("f", F.transform(F.split("record", _FIELD), T.strip))
    rows = rows.where((F.size("f") == 5) & F.get("f", F.lit(0)).contains("relation"))
    at = lambda i: F.get("f", F.lit(i))
    rows = rows.withColumn("src_id", T.cut_identifier(at(1))).withColumn("tgt_id", T.cut_identifier(at(2))).withColumn("keywords", F.translate(at(3), "，", ",")).withColumn("description", at(4))
    rows = rows.where("src_id <> '' AND tgt_id <> '' AND src_id <> tgt_id AND description <> ''")
    return rows.withColumn("weight", T.float_or(F.col("description"))).drop("f")


def valid_triples(triples: Column) -> Column:
    """Arrays of exactly three, as strings, each once in first-seen order."""
    return F.array_distinct(F.filter(triples, lambda t: F.size(t) == 3))


def is_candidate(entity: Column) -> Column:
    """No blank, number or single character."""
    name = T.phrase(entity)
    return entity.isNotNull() & (F.length(name) > 1) & ~name.rlike("^[0-9]+$")
