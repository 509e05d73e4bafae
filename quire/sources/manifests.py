"""Manifests of benchmark cases and training samples as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "schema_version string, seed int, extraction map<string,string>, cases array<struct<id:string,original_layout:string,reviewed_markdown:string,evidence:array<string>,extraction:map<string,string>,tags:map<string,string>,metadata:map<string,string>>>"
SAMPLES = "seed int, samples array<struct<id:string,document_id:string,source:string,ground_truth:string,split:string,usage_lane:string,license_id:string,commercial_use:boolean,consent_scope:string,pii_status:string,languages:array<string>,group_ids:map<string,string>,source_sha256:string>>"


def cases(spark: SparkSession, path: str) -> DataFrame:
    """A row a case, in order; its extraction options lie over the manifest's. A tag may be a text or an array of texts:
    ``tags`` maps dimensions to arrays."""
    whole = spark.read.schema(CASES).json(path, multiLine=True)
    rows = whole.select("seed", "extraction", F.posexplode("cases").alias("case_index", "c"))
    over = F.map_concat(F.map_filter(F.coalesce("extraction", F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key("c.extraction", k), F.lit(False))), F.coalesce("c.extraction", F.create_map().cast("map<string,string>")))
    tags = F.transform_values("c.tags", lambda k, v: F.coalesce(F.from_json(v, "array<string>"), F.array(v)))
    return rows.select("seed", "case_index", F.col("c.id").alias("case_id"), "c.original_layout", "c.reviewed_markdown", "c.evidence", over.alias("extraction"), tags.alias("tags"), "c.metadata")


def case_faults(rows: DataFrame) -> DataFrame:
    """Cases that name no id, one that is taken, or no source."""
    n = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    fault = F.when(F.coalesce("case_id", F.lit("")) == "", "no id").when(F.col("n") > 1, "id is taken").when(F.col("original_layout").isNull() & F.col("reviewed_markdown").isNull(), "no source")
    return rows.join(n, "case_id", "left").select("case_index", "case_id", fault.alias("fault")).where("fault is not null")


def training_samples(spark: SparkSession, path: str) -> DataFrame:
    """A row a sample; relative paths are resolved against the manifest's folder."""
    rows = spark.read.schema(SAMPLES).json(path, multiLine=True).select("seed", F.explode("samples").alias("s"), F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")).select("seed", "folder", "s.*")
    whole = lambda c: F.when(F.col(c).rlike("^(/|[a-z0-9]+:)"), F.col(c)).otherwise(F.concat_ws("/", "folder", c))
    return rows.withColumns({"source": whole("source"), "ground_truth": whole("ground_truth")}).drop("folder")


def annotated_pages(spark: SparkSession, path: str, subset: str = "all") -> DataFrame:
    """Pages of an annotation array: ordinal, image, subset and their regions (category, polygon's box, text, order); ``hard``
    takes the subsets whose names end in _hard."""
    shape = "layout_dets array<struct<category_type:string,poly:array<double>,text:string,order:int,ignore:boolean>>, page_info struct<page_no:int,image_path:string,page_attribute:struct<subset:string>>"
    pages = spark.read.schema(shape).json(path, multiLine=True).withColumn("ordinal", F.col("page_info.page_no"))
    name = F.col("page_info.page_attribute.subset")
    pages = pages if subset == "all" else pages.where(name.endswith("_hard") if subset == "hard" else name == subset)
    at = lambda odd: F.filter("d.poly", lambda x, i: i % 2 == odd)
    rows = pages.select("ordinal", F.col("page_info.image_path").alias("image"), name.alias("subset"), F.posexplode("layout_dets").alias("n", "d"))
    return rows.where("not coalesce(d.ignore, false)").select("ordinal", "image", "subset", F.concat(F.lit("r"), F.col("n")).alias("element_id"), F.col("d.category_type").alias("category"), F.array_min(at(0)).alias("x0"), F.array_min(at(1)).alias("y0"), F.array_max(at(0)).alias("x1"), F.array_max(at(1)).alias("y1"), F.col("d.text").alias("text"), F.col("d.order").alias("reading_order"))
