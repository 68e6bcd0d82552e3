"""The given tables read as a code repository: symbols, files, edges, calls. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.storage import table

ENDINGS = ("ts", "py", "rs", "go", "md")
KINDS = ("function", "class", "variable", "method", "constant", "component")
_pick = lambda values, place: F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: id, file_path, name, kind, start_line, end_line."""
    start = (F.col("p_partkey") % 40 * 5 + 1).cast("int")
    path = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"))), F.lit("/"), F.lower("p_type"), F.lit("."), _pick(ENDINGS, F.col("p_size") % 5))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), path.alias("file_path"), F.col("p_name").alias("name"), _pick(KINDS, F.col("p_size") % 6).alias("kind"), start.alias("start_line"), (start + F.col("p_size")).cast("int").alias("end_line")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive parts of an order as symbol edges: from_id, to_id, kind."""
    return edge_rows(spark, sf_dir).distinct()


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges with repeats, for queries that make later rows distinct."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "references").otherwise("extends")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_id"), F.lead("l_partkey").over(order).alias("to_id"), kind.alias("kind"))
    return rows.where("to_id is not null and from_id <> to_id")


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol edges between different files: from_path, to_path, kind."""
    own = symbols(spark, sf_dir)
    a = own.select(F.col("id").alias("from_id"), F.col("file_path").alias("from_path"))
    b = own.select(F.col("id").alias("to_id"), F.col("file_path").alias("to_path"))
    kind = F.when(F.col("kind") == "calls", "imports").when(F.col("kind") == "references", "references").otherwise("contains")
    return edges(spark, sf_dir).join(a, "from_id").join(b, "to_id").where("from_path <> to_path").select("from_path", "to_path", kind.alias("kind")).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and n_symbols, and no routes."""
    return symbols(spark, sf_dir).groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n_symbols")).withColumn("n_routes", F.lit(0))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part depends on the one of half its number: source, target."""
    return table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 2).alias("target"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: id, user_id, ms, tool, raw_tokens, output_tokens, execution_ms."""
    raw = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.expr("unix_millis(cast(ts as timestamp))").alias("ms"), F.col("event_type").alias("tool"), (raw * 100).alias("raw_tokens"), F.floor(F.col("value") * 10).alias("output_tokens"), raw.alias("execution_ms")
    )


SYMBOLS_SQL = f"""symbols AS (SELECT p_partkey AS id, 'src/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '.' || ({list(ENDINGS)})[p_size % 5 + 1] AS file_path, p_name AS name,
  ({list(KINDS)})[p_size % 6 + 1] AS kind, CAST(p_partkey % 40 * 5 + 1 AS INT) AS start_line, CAST(p_partkey % 40 * 5 + 1 + p_size AS INT) AS end_line FROM part)"""
EDGES_SQL = """edges AS (SELECT DISTINCT from_id, to_id, kind FROM (SELECT l_partkey AS from_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS to_id,
  CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'references' ELSE 'extends' END AS kind FROM lineitem) WHERE to_id IS NOT NULL AND from_id <> to_id)"""
FILE_EDGES_SQL = """file_edges AS (SELECT DISTINCT a.file_path AS from_path, b.file_path AS to_path, CASE e.kind WHEN 'calls' THEN 'imports' WHEN 'references' THEN 'references' ELSE 'contains' END AS kind
  FROM edges e JOIN symbols a ON e.from_id = a.id JOIN symbols b ON e.to_id = b.id WHERE a.file_path <> b.file_path)"""
FILES_SQL = "files AS (SELECT file_path AS path, count(*) AS n_symbols FROM symbols GROUP BY 1)"
CODE_SQL = ", ".join((SYMBOLS_SQL, EDGES_SQL, FILE_EDGES_SQL, FILES_SQL))
CALLS_SQL = """calls AS (SELECT event_id AS id, user_id, epoch_us(ts) // 1000 AS ms, event_type AS tool, CAST(json_extract(props, '$.k') AS BIGINT) * 100 AS raw_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
  CAST(json_extract(props, '$.k') AS BIGINT) AS execution_ms FROM events)"""
