"""Source documents: a listing, lookups by name and scope, and details with their fragments in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REFERENCE = "struct<raw:string,target_name:string,target_numbering:string,scope:string,target_doc_id:string,target_version:string,target_node_id:string,resolved:boolean>"
FRAGMENT = f"struct<id:string,order:int,kind:string,type:string,numbering:string,depth:int,breadcrumb:string,parent_id:string,prev_id:string,next_id:string,child_ids:array<string>,char_start:int,char_end:int,page_start:int,page_end:int,span_id:string,tags:array<string>,metadata:map<string,string>,references:array<{REFERENCE}>,text:string,table_html:string>"
DETAIL = f"doc_id string, name string, title string, version string, version_id string, other_versions array<string>, doc_type string, corpus string, lang string, status string, external_ids map<string,string>, source_uri string, content_hash string, node_count int, uploaded_at string, user_id string, scenario_id string, text string, fragments array<{FRAGMENT}>"


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """Document details from JSON lines; fields that the schema does not name are ignored."""
    return spark.read.schema(DETAIL).json(path)


def fragment_type() -> StructType:
    """The fields of a fragment, for building one."""
    return StructType.fromDDL(f"f {FRAGMENT}")["f"].dataType


def as_details(rows: DataFrame) -> DataFrame:
    """rows with all columns of a detail; absent ones are null, others go."""
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(DETAIL)))


def listing(details: DataFrame) -> DataFrame:
    return details.select("doc_id", "name", "version", "content_hash", "user_id", "scenario_id")


def lookup(listed: DataFrame, name: str) -> DataFrame:
    """Library documents of a name; names are not unique."""
    return listed.where((F.col("name") == name) & F.col("user_id").isNull())


def resolve_doc_ids(listed: DataFrame, name: str, user_id: str | None = None, scenario_id: str | None = None) -> DataFrame:
    """(doc_id) of a name: within a scope its own documents only, else the library's; nothing found is an empty table."""
    if user_id is not None and scenario_id is not None:
        rows = listed.where((F.col("user_id") == user_id) & (F.col("scenario_id") == scenario_id) & (F.col("name") == name))
    else:
        rows = lookup(listed, name)
    return rows.select("doc_id").distinct()


def list_scope(listed: DataFrame, user_id: str, scenario_id: str) -> DataFrame:
    return listed.where((F.col("user_id") == user_id) & (F.col("scenario_id") == scenario_id)).select("doc_id")


def get_document(details: DataFrame, doc_id: str) -> DataFrame:
    """A document's detail, its fragments in order; an unknown id gives no row."""
    ordered = F.array_sort("fragments", lambda a, b: a["order"] - b["order"])
    return details.where(F.col("doc_id") == doc_id).withColumn("fragments", ordered)


def fragments(details: DataFrame) -> DataFrame:
    """A row for each fragment, with its document's columns."""
    return details.select("*", F.explode("fragments").alias("fragment")).drop("fragments")


def references(details: DataFrame) -> DataFrame:
    """(src, reference) for each reference of each fragment."""
    return fragments(details).select(F.col("fragment.id").alias("src"), F.explode("fragment.references").alias("reference"))
