"""Readers and writers for articles, trees, chunks, catalogues and audit logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from galley import fixed
from galley.functions import text as T
from galley.operators.corpus import NODE
from galley.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster."""
    return f"{shared_folder(spark)}/galley-{name}-{uuid.uuid4().hex}"


# ---- articles -------------------------------------------------------------


def articles_of(rows: DataFrame, path: Column, text: Column, corpus: Column | None = None) -> DataFrame:
    """Articles from ``<lang>/<slug>.md`` paths and their texts; the corpus is that of the language by default."""
    lang = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return rows.select(
        (F.concat(F.lit("corpus_"), lang) if corpus is None else corpus).alias("corpus"),
        lang.alias("lang"),
        F.regexp_extract(path, r"([^/]+)\.md$", 1).alias("slug"),
        text.alias("raw"),
    )


def read_articles(spark: SparkSession, path: str, corpus_prefix: str = "corpus_") -> DataFrame:
    """``<path>/<lang>/<slug>.md``, one row per file; dot-files are skipped by Spark."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(
        path, wholetext=True
    )
    # the file path comes percent-encoded; "+" is a plain character in it
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lang = F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)
    return articles_of(read, file, F.col("value"), F.concat(F.lit(corpus_prefix), lang))


def write_article_archive(articles: DataFrame, path: str) -> None:
    """Articles as (path, raw) rows, ``<corpus>/<lang>/<slug>.md``: many in a file, so the files stay few."""
    file = F.concat(F.concat_ws("/", "corpus", "lang", "slug"), F.lit(".md"))
    articles.select(file.alias("path"), "raw").write.parquet(path)


def read_article_archive(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_article_archive`` wrote, by the same rules as article files."""
    corpus = F.regexp_extract("path", r"^([^/]+)/", 1)
    return articles_of(spark.read.parquet(path), F.col("path"), F.col("raw"), corpus)


# ---- trees ----------------------------------------------------------------

TREE_SCHEMA = (
    "root_ord bigint, root_id string, lang string, slug string, title string, "
    "tags array<string>, published string, source_url string, text string, summary string, "
    f"prefix_summary string, nodes {NODE}, corpus string"
)


def write_trees(trees: DataFrame, path: str) -> None:
    trees.write.partitionBy("corpus").json(path)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREE_SCHEMA).json(path)


NESTED_CHILD = (
    "struct<title:string,node_id:string,line_num:int,page_index:int,text:string,summary:string,"
    "prefix_summary:string,source:string>"
)
NESTED_ROOT = (
    "struct<title:string,node_id:string,line_num:int,text:string,summary:string,"
    "prefix_summary:string,tags:array<string>,published:string,source:string,slug:string,"
    f"lang:string,nodes:array<{NESTED_CHILD}>>"
)


def read_tree_assets(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """Tree files: an object with ``structure`` or a plain list of roots."""
    as_object = (
        spark.read.text(path, wholetext=True)
        .select(
            F.coalesce(
                F.from_json("value", f"struct<structure:array<{NESTED_ROOT}>>")["structure"],
                F.from_json("value", f"array<{NESTED_ROOT}>"),
            ).alias("roots")
        )
    )
    child = lambda n, i, root: F.struct(
        (i + 1).alias("node_ord"), n["node_id"].alias("node_id"), root.alias("parent_id"),
        n["title"].alias("title"), n["text"].alias("text"), n["summary"].alias("summary"),
        n["prefix_summary"].alias("prefix_summary"), n["source"].alias("source_url"),
        n["line_num"].alias("line_num"), n["page_index"].alias("page_index"),
    )
    return as_object.select(F.posexplode("roots").alias("root_ord", "r")).select(
        F.lit(corpus).alias("corpus"),
        F.col("root_ord").cast("bigint").alias("root_ord"),
        F.col("r.node_id").alias("root_id"),
        *[F.col(f"r.{c}").alias(c) for c in ("lang", "slug", "title")],
        F.coalesce("r.tags", T.strings([])).alias("tags"),
        F.col("r.published").alias("published"),
        F.col("r.source").alias("source_url"),
        *[F.col(f"r.{c}").alias(c) for c in ("text", "summary", "prefix_summary")],
        F.transform("r.nodes", lambda n, i: child(n, i, F.col("r.node_id"))).cast(NODE).alias("nodes"),
    )


# ---- chunks ---------------------------------------------------------------

CHUNK_SCHEMA = (
    "root_ord bigint, node_ord int, node_id string, title string, article_title string, "
    "language string, line_num int, own_url string, source_url string, tags array<string>, "
    "published string, chunk_index int, content string, id string, terms map<string,double>, "
    "corpus string"
)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines by corpus; the term vector is an object of term to weight."""
    as_map = F.map_from_entries(F.transform("terms", lambda t: F.struct(t["term"], t["weight"])))
    chunks.withColumn("terms", as_map).write.partitionBy("corpus").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    terms = F.transform(
        F.map_entries("terms"), lambda e: F.struct(e["key"].alias("term"), e["value"].alias("weight"))
    )
    return spark.read.schema(CHUNK_SCHEMA).json(path).withColumn("terms", terms)


# ---- catalogues -----------------------------------------------------------

KPI_ROW = (
    "struct<id:string,name:string,category:string,cluster_short:string,monitoring:string,"
    "weight:string,norm:string,norm_chat:string,norm_messages:string,indicator:string,"
    "relevance:map<string,string>>"
)


def read_kpis(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue file with a ``kpis`` list; missing fields take their defaults."""
    read = spark.read.schema(f"kpis array<{KPI_ROW}>").option("multiLine", True).json(path)
    rows = read.select(F.posexplode("kpis").alias("ord", "k")).select("ord", "k.*")
    return rows.withColumns(
        {
            "monitoring": F.coalesce("monitoring", F.lit("Optional")),
            "weight": F.coalesce("weight", F.lit("Medium")),
            "relevance": F.coalesce("relevance", F.create_map().cast("map<string,string>")),
        }
    )


PROFILE_SCHEMA = S.StructType(
    [S.StructField(n, S.StringType()) for n in ("id", "name", "description", "category")]
    + [
        S.StructField("activates_on", S.StringType()),
        S.StructField("capabilities", S.StringType()),
    ]
    + [
        S.StructField(n, S.StringType())
        for n in ("knowledge", "tools", "guardrails", "outputs", "style_signature", "co_activates_with")
    ]
)


def string_list(c):
    """A JSON text that is a list, one value or missing, as a list."""
    as_list = F.from_json(c, "array<string>")
    return (
        F.when(c.isNull() | (c == "null"), T.strings([]))
        .when(F.startswith(F.ltrim(c), F.lit("[")), as_list)
        .otherwise(F.array(c))
    )


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Profiles from JSON lines, and the rows whose category is unknown."""
    raw = spark.read.schema(PROFILE_SCHEMA).json(path)
    item = lambda col, key: string_list(F.get_json_object(col, f"$.{key}"))
    workflow = F.col("category") == "workflow"
    none = T.strings([])
    rows = raw.select(
        "id", "name", "description", "category",
        F.when(workflow, item("activates_on", "intent_codes")).otherwise(none).alias("codes"),
        F.when(~workflow, F.coalesce(F.get_json_object("activates_on", "$.sector"), F.lit(""))).alias("sector"),
        F.when(~workflow, item("activates_on", "topic_keywords")).otherwise(none).alias("keywords"),
        string_list(F.col("knowledge")).alias("knowledge"),
        F.when(workflow, item("capabilities", "skills")).otherwise(none).alias("skills"),
        *[
            F.when(workflow, string_list(F.col(c))).otherwise(none).alias(c)
            for c in ("tools", "guardrails", "outputs")
        ],
        F.when(~workflow, item("capabilities", "expertise_areas")).otherwise(none).alias("expertise_areas"),
        F.when(~workflow, string_list(F.col("style_signature"))).otherwise(none).alias("style_signature"),
        string_list(F.col("co_activates_with")).alias("co_activates_with"),
    )
    known = F.coalesce(F.col("category").isin(*fixed.PROFILE_CATEGORIES), F.lit(False))
    return rows.where(known), rows.where(~known)


# ---- audit log ------------------------------------------------------------

AUDIT_SCHEMA = (
    "ts timestamp, kind string, run_id string, stage string, source string, "
    "input_summary string, output_summary string, error string"
)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)
