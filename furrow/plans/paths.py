"""Path and inventory queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import paths
from furrow.operators import inventory
from furrow.operators.order import global_row_number
from furrow.operators.payload import render_record
from furrow.operators.prefix import rewrite_by_rule_table
from furrow.plans.registry import query
from furrow.sources.tables import table

_HOST = "^(https?://[^/?#]+)"

_REWRITE_SQL = """
WITH host AS (
  SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS old, count(*) AS n FROM pages GROUP BY 1),
rules AS (
  SELECT old, '/mirror/' || regexp_replace(old, '^https?://', '') AS new FROM host WHERE n >= 2 AND old <> ''
  UNION ALL SELECT 'https:', '/secure' UNION ALL SELECT 'http:', '/plain'),
texts AS (SELECT page_id, url, replace(url, '\\', '/') AS norm FROM pages),
matched AS (
  SELECT t.*, r.old, r.new,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.old) DESC NULLS LAST) AS rn
  FROM texts t LEFT JOIN rules r ON t.norm = r.old OR starts_with(t.norm, r.old || '/'))
SELECT page_id, url,
       CASE WHEN old IS NULL THEN url WHEN norm = old THEN new
            ELSE new || substr(norm, length(old) + 1) END AS rewritten,
       coalesce(old, '') AS matched_rule
FROM matched WHERE rn = 1
"""


@query("path_prefix_rewrite", _REWRITE_SQL)
def path_prefix_rewrite(spark: SparkSession, base: str) -> DataFrame:
    pages = table(spark, base, "pages").select("page_id", "url")
    hosts = (
        pages.groupBy(F.regexp_extract("url", _HOST, 1).alias("old"))
        .count()
        .filter((F.col("count") >= 2) & (F.col("old") != ""))
        .select(
            "old",
            F.concat(F.lit("/mirror/"), F.regexp_replace("old", "^https?://", "")).alias("new"),
            F.lit(0).alias("ord"),
        )
    )
    schemes = spark.createDataFrame(
        [("https://", "/secure/", 1), ("http://", "/plain/", 2)], "old string, new string, ord int"
    )
    out = rewrite_by_rule_table(pages, "url", hosts.union(schemes))
    return out.withColumn("matched_rule", F.coalesce("matched_rule", F.lit("")))


@query(
    "path_normalize",
    """
SELECT page_id, replace(raw, '\\', '/') AS normalized, rtrim(replace(raw, '\\', '/'), '/') AS stripped
FROM (SELECT page_id, replace(url, '/', '\\') || repeat('/', length(url) % 3) AS raw FROM pages)
""",
)
def path_normalize(spark: SparkSession, base: str) -> DataFrame:
    raw = F.concat(F.translate("url", "/", "\\"), F.expr("repeat('/', length(url) % 3)"))
    return table(spark, base, "pages").select(
        "page_id",
        paths.normalize_separators(raw).alias("normalized"),
        paths.normalize_prefix(raw).alias("stripped"),
    )


_DOC_PATH_SQL = """CASE WHEN lang = 'en' THEN source || '/' || CAST(doc_id AS VARCHAR) || '.txt'
       ELSE source || '-' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' END"""


def _doc_path():
    number = F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return F.when(F.col("lang") == "en", F.concat("source", number)).otherwise(
        F.concat("source", F.lit("-"), "lang", number)
    )


@query(
    "path_component_sort",
    f"""
WITH p AS (SELECT doc_id, {_DOC_PATH_SQL} AS path FROM documents)
SELECT doc_id, path, row_number() OVER (ORDER BY string_split(path, '/'), doc_id) AS rank FROM p
""",
)
def path_component_sort(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", _doc_path().alias("path"))
    ranked = global_row_number(
        docs.withColumn("parts", paths.components(F.col("path"))), [F.col("parts"), F.col("doc_id")]
    )
    return ranked.select("doc_id", "path", "rank")


_EXTRA_SQL = """CASE WHEN role = 'user' THEN 'lib/__pycache__/c' || CAST(conv_id AS VARCHAR) || '.txt'
         WHEN turn = 1 THEN 'lib/c' || CAST(conv_id AS VARCHAR) || '.pyc'
         ELSE 'lib/c' || CAST(conv_id AS VARCHAR) || '.txt' END"""


@query(
    "inventory_union",
    f"""
WITH tracked AS (
  SELECT source || '/' || lang || '/' || CAST(length(text) AS VARCHAR) || '.txt' AS path FROM documents
  UNION ALL SELECT source || '/__pycache__/' || lang || '.pyc' FROM documents
  UNION ALL SELECT 'README.md' FROM documents),
extra AS (
  SELECT {_EXTRA_SQL} AS path FROM conversations
  UNION ALL SELECT source || '/' || lang || '/' || CAST(n_chars AS VARCHAR) || '.txt' FROM documents)
SELECT path, path <> 'README.md' AS staged FROM (
  SELECT path FROM tracked WHERE path <> ''
  UNION
  SELECT path FROM extra WHERE path <> '' AND NOT list_contains(string_split(path, '/'), '__pycache__')
    AND NOT ends_with(path, '.pyc'))
""",
)
def inventory_union(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("source", "lang", "n_chars", F.length("text").alias("size"))
    in_source = lambda size: F.concat(F.concat_ws("/", "source", "lang", F.col(size).cast("string")), F.lit(".txt"))
    tracked = docs.select(
        F.explode(
            F.array(
                in_source("size"),
                F.concat("source", F.lit("/__pycache__/"), "lang", F.lit(".pyc")),
                F.lit("README.md"),
            )
        ).alias("path")
    )
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    spoken = table(spark, base, "conversations").select(
        F.when(F.col("role") == "user", F.concat(F.lit("lib/__pycache__/"), name, F.lit(".txt")))
        .when(F.col("turn") == 1, F.concat(F.lit("lib/"), name, F.lit(".pyc")))
        .otherwise(F.concat(F.lit("lib/"), name, F.lit(".txt")))
        .alias("path")
    )
    full = inventory.build_inventory(tracked, spoken.union(docs.select(in_source("n_chars").alias("path"))))
    return full.withColumn("staged", F.col("path") != inventory.ROOT_README)


@query(
    "template_render",
    """
WITH r AS (
  SELECT doc_id,
         replace(replace('---' || chr(10) || 'datasets: __ARTIFACT_REPO_ID__ (__LANG__)' || chr(10) || text
                         || chr(10) || '__ARTIFACT_REPO_ID__', '__ARTIFACT_REPO_ID__',
                         source || '/' || 'artifacts-__LANG__'), '__LANG__', lang) AS rendered
  FROM documents)
SELECT doc_id, length(rendered) AS n_chars, md5(rendered) AS digest FROM r
""",
)
def template_render(spark: SparkSession, base: str) -> DataFrame:
    template = F.concat(
        F.lit("---\ndatasets: __ARTIFACT_REPO_ID__ (__LANG__)\n"), F.col("text"), F.lit("\n__ARTIFACT_REPO_ID__")
    )
    docs = table(spark, base, "documents").select("doc_id", "source", "lang", template.alias("template"))
    repo = F.concat("source", F.lit("/artifacts-__LANG__"))
    out = inventory.render(docs, "template", {inventory.TEMPLATE_KEY: repo, "__LANG__": F.col("lang")})
    return out.select("doc_id", F.length("rendered").cast("bigint").alias("n_chars"), F.md5("rendered").alias("digest"))


_LISTINGS_SQL = f"""
WITH source AS (SELECT {_DOC_PATH_SQL} AS path, md5(text) AS h FROM documents),
target AS (
  SELECT {_DOC_PATH_SQL} AS path, CASE WHEN toxic = 1 THEN md5(text || '~') ELSE md5(text) END AS h
  FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'pages/' || CAST(page_id AS VARCHAR) || '.html', md5(html) FROM pages)"""


def _listings(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, base, "documents").select("doc_id", "text", _doc_path().alias("path"))
    labels = table(spark, base, "labels").select("doc_id", "toxic")
    pages = table(spark, base, "pages")
    source = docs.select("path", F.md5("text").alias("content_hash"))
    changed = F.when(F.col("toxic") == 1, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    target = docs.join(labels, "doc_id").select("path", F.md5(changed).alias("content_hash"))
    extra = pages.select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.md5("html").alias("content_hash"),
    )
    return source, target.union(extra)


@query(
    "mirror_plan",
    _LISTINGS_SQL
    + """
SELECT coalesce(s.path, t.path) AS path,
       CASE WHEN s.path IS NULL THEN 'delete' WHEN t.path IS NULL THEN 'upload'
            WHEN s.h <> t.h THEN 'update' ELSE 'keep' END AS action
FROM source s FULL OUTER JOIN target t ON s.path = t.path
""",
)
def mirror_plan(spark: SparkSession, base: str) -> DataFrame:
    return inventory.mirror_plan(*_listings(spark, base))


@query(
    "upsert_plan",
    _LISTINGS_SQL
    + """
SELECT s.path, CASE WHEN t.path IS NULL THEN 'upload' ELSE 'update' END AS action
FROM source s LEFT JOIN target t ON s.path = t.path WHERE t.path IS NULL OR s.h <> t.h
""",
)
def upsert_plan(spark: SparkSession, base: str) -> DataFrame:
    return inventory.upsert_plan(*_listings(spark, base))


@query(
    "publish_record",
    """
SELECT doc_id,
       '{"owner":"' || source || '","artifacts_repo_id":"' || source || '/data-' || lang
       || '","space_repo_id":"' || source || '/app-' || lang
       || '","artifacts_url":"https://hub.example.org/datasets/' || source || '/data-' || lang
       || '","space_url":"https://hub.example.org/spaces/' || source || '/app-' || lang
       || '","note":null}' AS record
FROM documents
""",
)
def publish_record(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "source", "lang")
    record = inventory.publish_record(
        F.col("source"), F.concat(F.lit("data-"), "lang"), F.concat(F.lit("app-"), "lang"), "https://hub.example.org"
    )
    fields = ("owner", "artifacts_repo_id", "space_repo_id", "artifacts_url", "space_url")
    return docs.withColumn("r", record).select(
        "doc_id",
        render_record(**{f: F.col(f"r.{f}") for f in fields}, note=F.lit(None).cast("string")).alias("record"),
    )


_BULK_SQL = """
WITH texts AS (
  SELECT 'C:\\store\\s' || CAST(l_suppkey AS VARCHAR) || '\\p' || CAST(l_partkey AS VARCHAR) || '\\' || l_returnflag AS text
  FROM lineitem),
rules AS (
  SELECT 'C:/store/s' || CAST(s_suppkey AS VARCHAR) AS old,
         '/data/n' || CAST(s_nationkey AS VARCHAR) || '/s' || CAST(s_suppkey AS VARCHAR) AS new
  FROM supplier WHERE s_acctbal > 2000
  UNION ALL SELECT 'C:/store', '/data/rest'),
distinct_texts AS (SELECT text, replace(text, '\\', '/') AS norm, count(*) AS n FROM texts GROUP BY 1, 2),
matched AS (
  SELECT t.*, r.old, r.new, row_number() OVER (PARTITION BY text ORDER BY length(r.old) DESC) AS rn
  FROM distinct_texts t LEFT JOIN rules r ON norm = r.old OR starts_with(norm, r.old || '/'))
SELECT new || substr(norm, length(old) + 1) AS rewritten, CAST(sum(n) AS BIGINT) AS n FROM matched WHERE rn = 1 GROUP BY 1
"""


def bulk_inputs(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """One path per line item, and one rule for most suppliers above a general one."""
    piece = lambda prefix, column: F.concat(F.lit("\\" + prefix), F.col(column).cast("string"))
    texts = table(spark, base, "lineitem").select(
        F.concat(F.lit("C:\\store"), piece("s", "l_suppkey"), piece("p", "l_partkey"), F.lit("\\"), "l_returnflag").alias(
            "text"
        )
    )
    number = F.col("s_suppkey").cast("string")
    own = table(spark, base, "supplier").filter(F.col("s_acctbal") > 2000).select(
        F.concat(F.lit("C:\\store\\s"), number).alias("old"),
        F.concat(F.lit("/data/n"), F.col("s_nationkey").cast("string"), F.lit("/s"), number).alias("new"),
        F.lit(0).alias("ord"),
    )
    general = spark.createDataFrame([("C:/store/", "/data/rest", 1)], "old string, new string, ord int")
    return texts, own.union(general)


@query("path_rewrite_bulk", _BULK_SQL)
def path_rewrite_bulk(spark: SparkSession, base: str) -> DataFrame:
    texts, rules = bulk_inputs(spark, base)
    return rewrite_by_rule_table(texts, "text", rules).groupBy("rewritten").agg(F.count(F.lit(1)).alias("n"))
