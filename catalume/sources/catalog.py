"""Reading and writing catalogs, and a catalog made from order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.sources.shared import publish

VOLUME = "struct<amount:double,unit:string>"
NODES = f"node_id string, parent_id string, name string, kind string, ord long, abv_stated double, unit_cost double, unit_volume {VOLUME}, unit_count long, volume_per_count {VOLUME}, brand string"
RECIPES = f"recipe_id string, ord long, name string, color string, source string, ingredients array<struct<node:string,amount_unit:{VOLUME}>>"


BAD = "_bad"


def _load(spark: SparkSession, path: str, schema: str, key: str, bad_to: str | None) -> DataFrame:
    json = path.rstrip("/").endswith(("json", "jsonl"))
    if bad_to is None:
        return spark.read.schema(schema).json(path, mode="FAILFAST") if json else spark.read.schema(schema).parquet(path)
    rows = spark.read.schema(f"{schema}, {BAD} string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD) if json else spark.read.schema(schema).parquet(path).withColumn(BAD, F.lit(None).cast("string"))
    reason = F.when(F.col(BAD).isNotNull(), "malformed").when(F.col(key).isNull(), f"no {key}")
    told = rows.select(F.input_file_name().alias("file"), reason.alias("reason"), F.coalesce(BAD, F.to_json(F.struct(*[c for c in rows.columns if c != BAD]))).alias("record"))
    publish(told.where("reason IS NOT NULL"), bad_to, [])
    return rows.where(reason.isNull()).drop(BAD)


def load_nodes(spark: SparkSession, path: str, *, bad_to: str | None = None) -> DataFrame:
    """Taxonomy nodes, from JSON lines or Parquet.

    A record that can't be read as a node makes the job fail. With ``bad_to`` such
    records, and those without node_id, go to a table there (file, reason, record), and
    the others are loaded.
    """
    return _load(spark, path, NODES, "node_id", bad_to)


def load_recipes(spark: SparkSession, path: str, *, bad_to: str | None = None) -> DataFrame:
    """Nested recipe documents, from JSON lines or Parquet; bad records as with ``load_nodes``."""
    return _load(spark, path, RECIPES, "recipe_id", bad_to)


def explode_lines(recipes: DataFrame) -> DataFrame:
    """S3: one row per recipe line, with its place from 1."""
    rows = recipes.select("recipe_id", F.posexplode("ingredients").alias("pos", "x"))
    return rows.select("recipe_id", (F.col("pos") + 1).alias("pos"), F.col("x.node").alias("node_id"), F.col("x.amount_unit.amount").alias("amount"), F.col("x.amount_unit.unit").alias("unit"))


def write_result(df: DataFrame, path: str, partition_cols: list[str] | None = None, *, partitions_only: bool = False) -> None:
    """Write a result table in the place of what is there, or of the partitions that ``df`` has.

    The table appears whole: a write that fails leaves the old one (``shared.publish``).
    """
    if partitions_only and not partition_cols:
        raise ValueError("name the partition columns")
    publish(df, path, partition_cols or [], partitions_only=partitions_only)


#: Parts as a five-level taxonomy and line items as recipe lines. The same text runs on Spark and on other SQL engines.
LEAVES_SQL = """
SELECT 'P:' || CAST(p_partkey AS STRING) AS node_id, 'N:' || p_type || '/' || p_brand || '/' || p_name AS parent_id, p_name AS name,
  CASE p_partkey % 10 WHEN 0 THEN 'Garnish' WHEN 1 THEN 'Bitters' WHEN 2 THEN 'Fruit' WHEN 3 THEN 'Juice' WHEN 4 THEN 'Liquor' WHEN 5 THEN 'Liquor'
    WHEN 6 THEN 'Liqueur' WHEN 7 THEN 'Liqueur' WHEN 8 THEN 'Syrup' ELSE 'AperitifDigestif' END AS kind,
  p_partkey AS ord, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) / 100 END AS abv_stated, p_retailprice AS unit_cost,
  CAST(p_size AS DOUBLE) * 10 AS volume_ml, CAST(p_size AS BIGINT) AS unit_count, p_brand AS brand FROM {part}
"""
INNER_SQL = """
SELECT DISTINCT 'N:' || p_type || '/' || p_brand || '/' || p_name AS node_id, 'B:' || p_type || '/' || p_brand AS parent_id FROM {part}
UNION ALL SELECT DISTINCT 'B:' || p_type || '/' || p_brand, 'T:' || p_type FROM {part}
UNION ALL SELECT DISTINCT 'T:' || p_type, 'root' FROM {part} UNION ALL SELECT 'root', CAST(NULL AS STRING)
"""
NODES_SQL = f"""
SELECT node_id, parent_id, name, kind, ord, abv_stated, unit_cost, volume_ml, unit_count, brand FROM ({LEAVES_SQL}) AS leaves
UNION ALL SELECT node_id, parent_id, node_id, 'Ingredient', CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS STRING) FROM ({INNER_SQL}) AS inner_nodes
"""
LINES_SQL = """
SELECT CAST(l_orderkey AS STRING) AS recipe_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INT) AS pos,
  CASE WHEN l_suppkey % 5 = 0 THEN 'N:' || p_type || '/' || p_brand || '/' || p_name ELSE 'P:' || CAST(l_partkey AS STRING) END AS node_id,
  CAST(l_quantity AS DOUBLE) AS amount,
  CASE WHEN l_suppkey % 5 <> 0 AND l_partkey % 10 IN (0, 2) THEN 'count' WHEN l_linenumber <= 2 THEN 'oz' WHEN l_linenumber = 3 THEN 'dash' WHEN l_linenumber = 4 THEN 'drop'
    WHEN l_linenumber = 5 THEN 'splash' WHEN l_linenumber = 6 THEN 'mL' ELSE 'barspoon' END AS unit,
  l_suppkey AS supplier FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""


class OrderCatalog:
    """The order tables under ``sf_dir`` as a catalog: parts are nodes, orders are recipes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        part, orders = read("part"), read("orders")
        volume = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("amount"), F.lit("mL").alias("unit")))
        self.nodes = spark.sql(NODES_SQL, part=part).select(
            "node_id", "parent_id", "name", "kind", "ord", "abv_stated", "unit_cost", volume("volume_ml").alias("unit_volume"), "unit_count", volume("volume_ml").alias("volume_per_count"), "brand"
        )
        lines = spark.sql(LINES_SQL, part=part, lineitem=read("lineitem"))
        self.lines = lines.drop("supplier")
        #: The same lines with suppliers as the recipes: few, and long.
        self.supplier_lines = lines.select(F.concat(F.lit("S"), F.col("supplier").cast("string")).alias("recipe_id"), F.concat_ws("/", "recipe_id", "pos").alias("pos"), "node_id", "amount", "unit")
        self.suppliers = read("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("recipe_id"), F.col("s_suppkey").alias("ord"))
        self.recipes = orders.select(F.col("o_orderkey").cast("string").alias("recipe_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("source"), "o_custkey")
