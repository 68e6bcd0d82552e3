"""Queries over symbols, edges and file graphs, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.functions import text as texts
from graphloom.operators import community, graph, lookup, manifest, ordering, rank, resolve, search
from graphloom.plans import bindings as b
from graphloom.storage import Scratch, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def code(sql: str) -> str:
    return f"WITH RECURSIVE {b.CODE_SQL}, {sql}" if sql.lstrip()[:1] != "S" else f"WITH {b.CODE_SQL} {sql}"


@query("sql1_symbol_lookup", code("SELECT file_path, name, min(id) AS id, max(id) AS last_id FROM symbols GROUP BY file_path, name"))
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last symbol of each (file, name)."""
    return b.symbols(spark, sf_dir).groupBy("file_path", "name").agg(F.min("id").alias("id"), F.max("id").alias("last_id"))


@query("sql4_callers", code("SELECT e.to_id AS id, s.file_path, s.name, s.kind, e.kind AS edge_kind, count(*) AS n FROM edges e JOIN symbols s ON e.from_id = s.id GROUP BY ALL"))
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.edge_counts(b.symbols(spark, sf_dir), b.edges(spark, sf_dir), Scratch(spark, "callers"))


@query("sql5_callees", code("SELECT e.from_id AS id, s.file_path, s.name, s.kind, e.kind AS edge_kind, count(*) AS n FROM edges e JOIN symbols s ON e.to_id = s.id GROUP BY ALL"))
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.edge_counts(b.symbols(spark, sf_dir), b.edges(spark, sf_dir), Scratch(spark, "callees"), inbound=False)


@query("sql6_symbol_edges", code("SELECT a.file_path || '#' || a.name AS from_symbol, c.file_path || '#' || c.name AS to_symbol, e.kind, count(*) AS n FROM edges e JOIN symbols a ON e.from_id = a.id JOIN symbols c ON e.to_id = c.id GROUP BY ALL"))
def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.symbol_edge_counts(b.symbols(spark, sf_dir), b.edges(spark, sf_dir), Scratch(spark, "symbol-edges"))


@query("sql7_symbols_by_file", code("SELECT file_path, string_agg(name || ':' || kind, ',' ORDER BY id) AS symbols, count(*) AS n FROM symbols WHERE kind <> 'variable' GROUP BY file_path"))
def symbols_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.symbols(spark, sf_dir).where("kind <> 'variable'").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("id", "name", "kind"))).alias("s"))
    return rows.select("file_path", F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["name"], s["kind"])), ",").alias("symbols"), F.size("s").cast("long").alias("n"))


@query(
    "sql8_dispatch",
    code("""faces AS (SELECT id, 'src/' || split_part(file_path, '/', 2) || '/' || (id % 200) AS file_path, name, CASE WHEN id % 3 = 0 THEN 'interface' ELSE 'method' END AS kind FROM symbols),
links AS (SELECT from_id, to_id, CASE kind WHEN 'extends' THEN 'implements' ELSE kind END AS kind FROM edges)
SELECT DISTINCT e.from_id, t.id AS to_id FROM links e JOIN faces m ON e.to_id = m.id JOIN faces i ON i.file_path = m.file_path AND i.kind = 'interface' JOIN links p ON p.kind = 'implements' AND p.to_id = i.id
JOIN faces c ON p.from_id = c.id JOIN faces t ON t.file_path = c.file_path AND t.name = m.name WHERE e.kind = 'calls' AND e.from_id <> t.id"""),
)
def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of what interface files declare, led on to what implements them: every third part is an interface."""
    path = F.concat(F.lit("src/"), F.split("file_path", "/")[1], F.lit("/"), (F.col("id") % 200).cast("string"))
    own = b.symbols(spark, sf_dir).select("id", path.alias("file_path"), "name", F.when(F.col("id") % 3 == 0, "interface").otherwise("method").alias("kind"))
    edges = b.edge_rows(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "extends", "implements").otherwise(F.col("kind")))
    return resolve.dispatch_edges(own, edges, Scratch(spark, "dispatch"))


@query("sql2_by_name", code("n AS (SELECT name, id, file_path, kind, row_number() OVER (PARTITION BY name ORDER BY id) AS place FROM symbols) SELECT name AS asked, id, name, file_path, kind FROM n WHERE place <= 3"))
def symbols_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three symbols of every name."""
    own = b.symbols(spark, sf_dir)
    return lookup.by_name(own, own.select(F.col("name").alias("asked")), most=3)


@query("sql3_by_path", code("SELECT id, file_path, name, start_line, end_line FROM symbols"))
def symbols_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols looked up by paths of which every other one has a leading slash."""
    own = b.symbols(spark, sf_dir)
    asked = own.select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("/"), "file_path")).otherwise(F.col("file_path")).alias("path"), "name")
    return lookup.by_path(own, asked).select("id", "file_path", "name", "start_line", "end_line")


@query("sql10_wide_anchors", code("asked AS (SELECT DISTINCT upper(split_part(name, ' ', 1)) AS asked FROM symbols UNION SELECT min(name) FROM symbols), equal AS (SELECT asked, id FROM asked JOIN symbols ON name = asked) SELECT asked, id FROM equal UNION ALL SELECT a.asked, s.id FROM asked a JOIN symbols s ON contains(lower(s.name), lower(a.asked)) WHERE a.asked NOT IN (SELECT asked FROM equal)"))
def wide_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in capitals find no equal one, so what holds them is taken."""
    own = b.symbols(spark, sf_dir)
    asked = own.select(F.upper(F.split("name", " ")[0]).alias("asked")).distinct().unionByName(own.agg(F.min("name").alias("asked")))
    return lookup.anchors(own, asked)


@query("sql15_distinct_files", code("SELECT DISTINCT file_path FROM symbols WHERE contains(lower(name), 'red') ORDER BY file_path LIMIT 5"))
def distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.distinct_files(b.symbols(spark, sf_dir).where(F.lower("name").contains("red")))


@query("agg5_dependents_per_row", code("SELECT to_path AS path, count(*) AS n FROM file_edges GROUP BY 1"))
def dependents_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.dependents_per_row(b.file_edges(spark, sf_dir))


@query("agg11_summary", code("SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(DISTINCT regexp_extract(path, '[a-z]+$')) FROM files) AS n_languages, CAST(0 AS BIGINT) AS n_routes, (SELECT count(*) FROM file_edges) AS n_edges, (SELECT count(*) FROM symbols) AS n_symbols"))
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = b.files(spark, sf_dir).withColumn("language", paths.language(F.col("path")))
    return lookup.index_summary(nodes, b.file_edges(spark, sf_dir), b.symbols(spark, sf_dir))


@query("agg7_manifest_chars", code("d AS (SELECT from_path, string_agg('/' || to_path, ', ') AS t FROM file_edges GROUP BY 1), e AS (SELECT file_path, string_agg(name, ', ') AS t FROM (SELECT DISTINCT file_path, name FROM symbols) GROUP BY 1) SELECT f.path, CAST(length(f.path) + 4 + 12 + length(e.t) + coalesce(14 + length(d.t), 0) AS BIGINT) AS chars FROM files f JOIN e ON f.path = e.file_path LEFT JOIN d ON f.path = d.from_path"))
def manifest_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each file's manifest entry; its distinct symbol names are its exports."""
    exports = b.symbols(spark, sf_dir).groupBy(F.col("file_path").alias("path")).agg(F.collect_set("name").alias("exports")).withColumn("routes", F.array().cast("array<string>"))
    return manifest.manifest_chars(exports, b.file_edges(spark, sf_dir))


@query("agg8_savings", code("f2 AS (SELECT path, n_symbols * 2200 AS size_bytes FROM files), m AS (SELECT sum(length(f.path) + 4 + coalesce(d.n, 0)) AS chars FROM files f LEFT JOIN (SELECT from_path, sum(length(to_path) + 3) + 12 AS n FROM file_edges GROUP BY 1) d ON f.path = d.from_path), x AS (SELECT CAST(round(sum(size_bytes) / 3.7) AS BIGINT) AS b, CAST(round(coalesce(sum(size_bytes) FILTER (path LIKE 'src/brand1%'), 0) / 3.7) AS BIGINT) AS r FROM f2) SELECT b AS baseline_tokens, CAST(round(chars / 3.7) AS BIGINT) + r AS active_tokens, round(greatest(0.0, least(100.0, (1 - (CAST(round(chars / 3.7) AS BIGINT) + r) / b) * 100)), 1) AS savings_percent FROM x, m"))
def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    nodes = b.files(spark, sf_dir).select("path", (F.col("n_symbols") * 2200).alias("size_bytes"), none.alias("exports"), none.alias("routes"))
    return manifest.savings(nodes, b.file_edges(spark, sf_dir), nodes.where("path like 'src/brand1%'"))


@query("jn18_activity_targets", code("""calls AS (SELECT id AS call, CASE id % 3 WHEN 0 THEN '/root/' || file_path WHEN 1 THEN regexp_extract(file_path, '[^/]*$') ELSE file_path || '#' || name END AS path, name AS symbol FROM symbols),
own AS (SELECT call, regexp_replace(split_part(path, '#', 1), '^\\.?/', '') AS p, symbol AS s FROM calls),
hit AS (SELECT call, p AS file, s FROM own UNION SELECT call, f.path, s FROM own JOIN files f ON f.path = p OR ends_with(f.path, '/' || p) OR ends_with(p, '/' || f.path) UNION SELECT call, y.file_path, s FROM own JOIN symbols y ON y.name = s)
SELECT DISTINCT call, unnest([file, file || '#' || s]) AS target FROM hit"""))
def activity_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on paths below another root, on bare file names and on file#symbol."""
    own = b.symbols(spark, sf_dir)
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("/root/"), "file_path")).when(F.col("id") % 3 == 1, F.substring_index("file_path", "/", -1)).otherwise(F.concat_ws("#", "file_path", "name"))
    calls = own.select(F.col("id").alias("call"), path.alias("path"), F.col("name").alias("symbol"))
    return lookup.activity_targets(calls, b.files(spark, sf_dir), own)


@query(
    "sql9_gr15_trace",
    f"""WITH RECURSIVE {b.SYMBOLS_SQL}, edges AS (SELECT p_partkey AS from_id, CAST(floor(p_partkey / 2) AS BIGINT) AS to_id FROM part WHERE p_partkey > 0),
walk AS (SELECT id AS anchor, id, name, file_path, 0 AS hops, [id] AS trail, name AS path FROM symbols
UNION ALL SELECT w.anchor, s.id, s.name, s.file_path, w.hops + 1, list_append(w.trail, s.id), w.path || ' > ' || s.name FROM walk w JOIN edges e ON w.id = e.from_id JOIN symbols s ON e.to_id = s.id
WHERE w.hops < 4 AND NOT list_contains(w.trail, s.id))
SELECT anchor, id, name, file_path, hops, path FROM walk""",
)
def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls followed four deep from every symbol over the half-number tree."""
    own = b.symbols(spark, sf_dir)
    edges = b.tree(spark, sf_dir).select(F.col("source").alias("from_id"), F.col("target").alias("to_id"), F.lit("calls").alias("kind"))
    return graph.trace(own, edges, own.select(F.col("id").alias("anchor")), depth=4)


@query("sql11_inbound_dependents", code("SELECT DISTINCT b.file_path AS path, a.file_path AS dependent FROM edges e JOIN symbols a ON e.from_id = a.id JOIN symbols b ON e.to_id = b.id WHERE a.file_path <> b.file_path UNION SELECT DISTINCT to_path, from_path FROM file_edges"))
def inbound_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = b.symbols(spark, sf_dir).select("id", "file_path")
    e = b.edges(spark, sf_dir).join(own.select(F.col("id").alias("from_id"), F.col("file_path").alias("dependent")), "from_id").join(own.select(F.col("id").alias("to_id"), F.col("file_path").alias("path")), "to_id")
    direct = e.where("path <> dependent").select("path", "dependent")
    return direct.union(b.file_edges(spark, sf_dir).select("to_path", "from_path")).distinct()


@query("sql14_exact_search", code("SELECT id, name, file_path FROM symbols WHERE name = 'red' OR contains(lower(name), 'red') ORDER BY (name = 'red') DESC, length(name), id LIMIT 10"))
def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact(b.symbols(spark, sf_dir).select("id", "name", "file_path"), "red")


@query("sql16_agg1_degrees", code("SELECT f.path, f.n_symbols, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM files f LEFT JOIN (SELECT to_path, count(*) AS n FROM file_edges GROUP BY 1) i ON f.path = i.to_path LEFT JOIN (SELECT from_path, count(*) AS n FROM file_edges GROUP BY 1) o ON f.path = o.from_path"))
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_nodes(b.files(spark, sf_dir).drop("n_routes"), b.file_edges(spark, sf_dir))


@query("sql21_first_wins", code("SELECT from_id, kind, arg_min(to_id, to_id) AS first_to, max(to_id) AS last_to FROM edges GROUP BY from_id, kind"))
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each (from, kind) the first and the last target, in one aggregation."""
    return b.edges(spark, sf_dir).groupBy("from_id", "kind").agg(F.min("to_id").alias("first_to"), F.max("to_id").alias("last_to"))


@query("sql20_cascade_delete", code("SELECT e.kind, count(*) AS n FROM edges e JOIN symbols a ON e.from_id = a.id JOIN symbols c ON e.to_id = c.id WHERE a.file_path NOT LIKE 'src/brand1/%' AND c.file_path NOT LIKE 'src/brand1/%' GROUP BY e.kind"))
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left after the files of one directory go, and with them their symbols and edges."""
    own = b.symbols(spark, sf_dir)
    gone = own.where(paths.in_scope(F.col("file_path"), "src/brand1")).select("id")
    e = b.edges(spark, sf_dir).join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return e.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "jn1_jn3_import_resolution",
    code("""imports AS (SELECT from_path, to_path AS target, row_number() OVER (PARTITION BY from_path ORDER BY to_path) AS ordinal, regexp_replace(to_path, '\\.[a-z]+$', '') AS stem, regexp_extract(to_path, '\\.([a-z]+)$', 1) AS ext FROM (SELECT DISTINCT from_path, to_path FROM file_edges)),
tried AS (SELECT from_path, ordinal, unnest(CASE ext WHEN 'ts' THEN [stem, stem || '.ts', stem || '.tsx', stem || '.js', stem || '.jsx', stem || '.mjs', stem || '.cjs', stem || '/index.ts', stem || '/index.tsx', stem || '/index.js', stem || '/index.jsx']
 WHEN 'py' THEN [stem, stem || '.py', stem || '/__init__.py'] WHEN 'rs' THEN [stem, stem || '.rs', stem || '/mod.rs', regexp_replace(stem, '/[^/]*$', '') || '.rs', regexp_replace(stem, '/[^/]*$', '') || '/mod.rs']
 WHEN 'go' THEN [stem, stem || '.go', stem || '/' || regexp_extract(stem, '[^/]*$') || '.go'] ELSE [stem, stem || '.md', stem || '.markdown'] END) AS to_path,
 unnest(range(11)) AS place FROM imports)
SELECT from_path, CAST(ordinal AS INT) AS ordinal, arg_min(t.to_path, place) AS to_path FROM tried t JOIN files f ON t.to_path = f.path GROUP BY from_path, ordinal"""),
)
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions stripped from file edges, then found again through the candidates of each language."""
    pairs = b.file_edges(spark, sf_dir).select("from_path", "to_path").distinct()
    rows = pairs.withColumn("ordinal", F.row_number().over(Window.partitionBy("from_path").orderBy("to_path")))
    imports = rows.select("from_path", "ordinal", paths.language(F.col("to_path")).alias("language"), F.regexp_replace("to_path", r"\.[a-z]+$", "").alias("raw"), F.lit(None).cast("string").alias("resolved"))
    return resolve.resolve_imports(imports, b.files(spark, sf_dir).select("path"))


@query(
    "jn7_enclosing",
    """WITH spans AS (SELECT o_orderkey AS span_id, o_custkey % 50 AS k, epoch_ms(o_orderdate) // 86400000 % 30 AS low, epoch_ms(o_orderdate) // 86400000 % 30 + o_orderkey % 7 AS high FROM orders),
points AS (SELECT event_id, user_id % 50 AS k, epoch_ms(ts) // 86400000 % 30 AS day FROM events),
hits AS (SELECT event_id, span_id, row_number() OVER (PARTITION BY event_id ORDER BY high - low, span_id) AS n FROM points p LEFT JOIN spans s ON p.k = s.k AND p.day BETWEEN s.low AND s.high)
SELECT event_id, span_id FROM hits WHERE n = 1""",
)
def enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's narrowest order interval of the same key."""
    day = lambda c: (F.floor(F.unix_millis(F.col(c).cast("timestamp")) / 86_400_000) % 30)
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("span_id"), (F.col("o_custkey") % 50).alias("k"), day("o_orderdate").alias("low"), (day("o_orderdate") + F.col("o_orderkey") % 7).alias("high"))
    points = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("k"), day("ts").alias("day"))
    return resolve.enclosing(points, spans, "k", "day", "low", "high", "span_id").select("event_id", "span_id")


@query(
    "jn8_jn9_references",
    code("""refs AS (SELECT l.l_orderkey AS ref, a.file_path, a.id AS from_id, c.name, row_number() OVER (PARTITION BY a.file_path ORDER BY l.l_orderkey, l.l_linenumber, a.id, c.id) AS ordinal FROM lineitem l JOIN symbols a ON l.l_partkey = a.id JOIN symbols c ON l.l_suppkey = c.id),
last AS (SELECT file_path, name, max(id) AS id, arg_max(kind, id) AS kind FROM symbols GROUP BY file_path, name),
imports AS (SELECT from_path, to_path, row_number() OVER (PARTITION BY from_path ORDER BY to_path) AS ordinal FROM (SELECT DISTINCT from_path, to_path FROM file_edges)),
same AS (SELECT r.file_path, r.ordinal, r.from_id, l.id AS to_id, 'references' AS kind, CASE l.kind WHEN 'component' THEN 'heuristic' ELSE 'ast' END AS provenance FROM refs r JOIN last l ON r.file_path = l.file_path AND r.name = l.name WHERE r.from_id <> l.id),
far AS (SELECT r.file_path, r.ordinal, r.from_id, l.id AS to_id, CASE l.kind WHEN 'component' THEN 'references' ELSE 'calls' END AS kind, CASE l.kind WHEN 'component' THEN 'heuristic' ELSE 'ast' END AS provenance, row_number() OVER (PARTITION BY r.file_path, r.ordinal ORDER BY i.ordinal) AS n
 FROM refs r JOIN imports i ON r.file_path = i.from_path JOIN last l ON i.to_path = l.file_path AND r.name = l.name WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.file_path = r.file_path AND s.ordinal = r.ordinal)),
every AS (SELECT file_path, ordinal, from_id, to_id, kind, provenance FROM same UNION ALL SELECT file_path, ordinal, from_id, to_id, kind, provenance FROM far WHERE n = 1),
picked AS (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, kind ORDER BY file_path, ordinal) AS n FROM every)
SELECT from_id, to_id, kind, provenance FROM picked WHERE n = 1"""),
)
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as references: the part's file mentions the name of the part with the supplier's number."""
    own = b.symbols(spark, sf_dir)
    a = own.select(F.col("id").alias("from_id"), "file_path")
    c = own.select(F.col("id").alias("c_id"), "name")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("c_id"))  # noqa: E741
    refs = resolve.numbered_rows(l.join(a, "from_id").join(c, "c_id"), "file_path", ["l_orderkey", "l_linenumber", "from_id", "c_id"])
    imports = resolve.numbered_rows(b.file_edges(spark, sf_dir).select("from_path", "to_path").distinct(), "from_path", ["to_path"])
    return resolve.reference_edges(refs, own, imports).select("from_id", "to_id", "kind", "provenance")


@query("gr6_adamic_adar", "WITH p AS (SELECT DISTINCT l_suppkey AS node, l_partkey AS neighbour FROM lineitem), d AS (SELECT neighbour, count(*) AS degree FROM p GROUP BY 1) SELECT a.node AS a, c.node AS b, round(sum(CASE WHEN degree > 1 THEN 1 / ln(degree) ELSE 1 END), 6) AS score FROM p a JOIN p c ON a.neighbour = c.neighbour AND a.node < c.node JOIN d ON a.neighbour = d.neighbour GROUP BY 1, 2")
def adamic_adar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share parts."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("neighbour"))
    # Dealt out by ranges of parts, pairs of a part lie together when they are made a list.
    pairs = rows.repartitionByRange(max(1, math.ceil(rows.count() / graph.TASK_ROWS)), "neighbour", "node").distinct()
    return graph.adamic_adar(pairs, scratch=Scratch(spark, "adamic")).withColumn("score", F.round("score", 6))


def _rank_sql(rounds: int) -> str:
    weights = "CASE kind WHEN 'contains' THEN 1.5 WHEN 'imports' THEN 1.0 WHEN 'references' THEN 0.5 END"
    ctes = [
        f"w AS (SELECT from_path AS source, to_path AS target, sum({weights}) AS weight FROM file_edges GROUP BY 1, 2)",
        "shares AS (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS share FROM w)",
        "prior AS (SELECT path, CAST(1 AS DOUBLE) / count(*) OVER () AS prior FROM files)",
        "s0 AS (SELECT path, prior AS score FROM prior)",
    ]
    for k in range(rounds):
        ctes.append(
            f"""s{k + 1} AS (SELECT p.path, ({1 - rank.DAMPING!r} + {rank.DAMPING} * (SELECT coalesce(sum(score), 0) FROM s{k} WHERE path NOT IN (SELECT source FROM shares))) * p.prior + {rank.DAMPING} * coalesce(f.flow, 0) AS score
        FROM prior p LEFT JOIN (SELECT target, sum(score * share) AS flow FROM s{k} JOIN shares ON path = source GROUP BY 1) f ON p.path = f.target)"""
        )
    ctes.append(f"scaled AS (SELECT path, round(score / (SELECT max(score) FROM s{rounds}), 6) AS rank_score FROM s{rounds})")
    return code(", ".join(ctes) + " SELECT path, rank_score, row_number() OVER (ORDER BY rank_score DESC, path) AS rank_order FROM scaled")


@query("gr4_page_rank", _rank_sql(3))
def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three power iterations over the file graph, and their order."""
    return rank.page_rank(b.files(spark, sf_dir), b.file_edges(spark, sf_dir), Scratch(spark, "rank"), iterations=3).select("path", "rank_score", "rank_order")


@query("gr5_rank_order")
def rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The converged ranking."""
    return rank.page_rank(b.files(spark, sf_dir), b.file_edges(spark, sf_dir), Scratch(spark, "rank")).select("path", "rank_score", "rank_order")


@query("gr7_gr8_domains")
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the file graph with hub, by the converged ranking, cohesion and name."""
    scratch = Scratch(spark, "domains")
    # Each round and each iteration reads files and edges again, so both are stored.
    files, edges = scratch.keep(b.files(spark, sf_dir), "files"), scratch.keep(b.file_edges(spark, sf_dir), "edges")
    nodes = scratch.keep(graph.build_nodes(files, edges), "nodes")
    found = scratch.keep(community.communities(nodes, edges, scratch), "found")
    ranks = rank.page_rank(files, edges, scratch)
    return community.summaries(found, ranks, edges)


def _sweep_sql(strict: bool = False, passes: int = 2, levels: int = 24) -> str:
    """Labels of the half-number tree after some passes in the order of its numbers: a node of level k has k digits in base 2, and its parent is the only earlier neighbour.

    Strict: without weights and links of every fifth number; a node stays unless a label has more votes than its own, and takes the one of its first link.
    """
    votes = "SELECT n.node, o.label, sum(n.weight) AS weight, min(n.place) AS place, any_value(l.label) AS own"
    best = "arg_min(label, (-weight, place))" if strict else "arg_min(label, (-weight, label))"
    moves = "CASE WHEN max(weight) > coalesce(max(weight) FILTER (label = own), 0) THEN " + best + " ELSE any_value(own) END" if strict else best
    steps, last = [], "start"
    for turn in range(passes):
        for level in range(levels):
            name = f"s{turn}_{level}"
            steps.append(f"""{name} AS MATERIALIZED (SELECT l.node, l.level, coalesce(b.label, l.label) AS label FROM {last} l LEFT JOIN (
              SELECT node, {moves} AS label FROM ({votes} FROM near n JOIN {last} l USING (node) JOIN {last} o ON n.other = o.node WHERE l.level = {level} GROUP BY 1, 2) GROUP BY 1) b USING (node))""")
            last = name
    return f"""WITH t AS (SELECT p_partkey AS a, p_partkey // 2 AS b, {1 if strict else "1 + p_partkey * 7919 % 13"} AS weight FROM part WHERE p_partkey > 0{" AND p_partkey % 5 <> 0" if strict else ""}), near AS MATERIALIZED (SELECT a AS node, b AS other, weight, a AS place FROM t UNION ALL SELECT b, a, weight, a FROM t),
start AS MATERIALIZED (SELECT DISTINCT node, CASE WHEN node = 0 THEN 0 ELSE CAST(floor(log2(node)) AS INT) + 1 END AS level, node AS label FROM near), {", ".join(steps)} SELECT node, label FROM {last}"""


@query("gr7_sweep", _sweep_sql())
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a weighted tree after two passes, node by node."""
    weight = 1 + F.col("source") * 7919 % 13
    links = b.tree(spark, sf_dir).select(F.col("source").alias("a"), F.col("target").alias("b"), weight.alias("weight"))
    near = links.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    return community.sweep(near, Scratch(spark, "sweep"), passes=2)


@query("gr10_sweep", _sweep_sql(strict=True))
def strict_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a forest after two strict passes, ties to the first link."""
    links = b.tree(spark, sf_dir).where("source % 5 <> 0")
    near = links.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(1).alias("weight"), F.col("source").alias("place"))
    back = links.select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(1).alias("weight"), F.col("source").alias("place"))
    return community.sweep(near.unionByName(back), Scratch(spark, "sweep"), passes=2, strict=True)


@query(
    "gr7_label_round",
    code("""near AS (SELECT node, other, count(*) * 1.0 AS weight FROM (SELECT from_path AS node, to_path AS other FROM file_edges UNION ALL SELECT to_path, from_path FROM file_edges) GROUP BY 1, 2),
votes AS (SELECT node, other AS label, weight FROM near UNION ALL SELECT path, path, 0.5 FROM files), sums AS (SELECT node, label, round(sum(weight), 6) AS weight FROM votes GROUP BY 1, 2)
SELECT node, min(label) AS label FROM sums s WHERE weight = (SELECT max(weight) FROM sums t WHERE t.node = s.node) GROUP BY node"""),
)
def label_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round of label propagation with unit weights."""
    e = b.file_edges(spark, sf_dir)
    both = e.select(F.col("from_path").alias("node"), F.col("to_path").alias("other")).unionByName(e.select(F.col("to_path").alias("node"), F.col("from_path").alias("other")))
    near = both.groupBy("node", "other").agg(F.count("*").cast("double").alias("weight"))
    return community.label_round(b.files(spark, sf_dir).select(F.col("path").alias("node"), F.col("path").alias("label")), near)


@query("gr12_closure", "WITH RECURSIVE edges AS (SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS source, p_partkey AS target FROM part WHERE p_partkey > 0), reach AS (SELECT DISTINCT source AS anchor, source AS node, 0 AS hops FROM edges UNION ALL SELECT r.anchor, e.target, r.hops + 1 FROM reach r JOIN edges e ON r.node = e.source) SELECT anchor, node, hops FROM reach WHERE hops > 0")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below each part in the half-number tree."""
    e = b.tree(spark, sf_dir).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return graph.closure(e, e.select(F.col("source").alias("anchor")).distinct(), Scratch(spark, "closure"))


@query("gr16_coupling", code("m AS (SELECT path, split_part(path, '/', 2) AS community FROM files), c AS (SELECT a.community AS source, d.community AS target, count(*) AS n_edges FROM file_edges e JOIN m a ON e.from_path = a.path JOIN m d ON e.to_path = d.path WHERE a.community <> d.community GROUP BY 1, 2) SELECT c.source, c.target, c.n_edges, EXISTS (SELECT 1 FROM c r WHERE r.source = c.target AND r.target = c.source) AS circular FROM c"))
def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between top directories."""
    membership = b.files(spark, sf_dir).select("path", F.split("path", "/")[1].alias("community"))
    return graph.coupling(b.file_edges(spark, sf_dir), membership)


_MARK = "CAST(conv(substr(md5(concat_ws(' ', from_path, to_path)), 1, 8), 16, 10) AS BIGINT)"


@query(
    "gr17_neighbourhood",
    code("""n AS (SELECT path, row_number() OVER (ORDER BY path) AS k FROM files), e AS (SELECT a.k AS f, c.k AS t, kind, CAST('0x' || substr(md5(concat_ws(' ', from_path, to_path)), 1, 8) AS BIGINT) AS mark FROM file_edges JOIN n a ON from_path = a.path JOIN n c ON to_path = c.path),
near AS (SELECT f AS anchor, t AS node FROM e UNION SELECT t, f FROM e UNION SELECT k, k FROM n)
SELECT n.path AS anchor, e.kind, count(*) AS n_edges, CAST(sum(e.mark) AS BIGINT) AS edges_sum FROM e JOIN near x ON e.f = x.node JOIN near y ON e.t = y.node AND x.anchor = y.anchor JOIN n ON n.k = x.anchor GROUP BY 1, 2"""),
)
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges around each file, counted and summed up by hashes of their ends; files go by number until then."""
    scratch = Scratch(spark, "neighbourhood")
    files = scratch.keep(ordering.with_position(b.files(spark, sf_dir).select("path"), [F.col("path")], scratch, "k"), "files")
    ends = [files.select(F.col("path").alias(f"{end}_path"), F.col("k").alias(end)) for end in ("from", "to")]
    marked = b.file_edges(spark, sf_dir).withColumn("mark", F.expr(_MARK)).join(ends[0], "from_path").join(ends[1], "to_path")
    edges = scratch.keep(marked.select(F.col("from").alias("from_path"), F.col("to").alias("to_path"), "kind", "mark"), "edges")
    sums = graph.neighbourhood_sums(edges, files.select(F.col("k").alias("anchor")), scratch)
    return sums.join(files.select("path", F.col("k").alias("anchor")), "anchor").select(F.col("path").alias("anchor"), "kind", "n_edges", F.col("total").alias("edges_sum"))


@query(
    "gr17_drawing",
    code("""near AS (SELECT from_path AS anchor, to_path AS node FROM file_edges UNION SELECT to_path, from_path FROM file_edges), kept AS (SELECT anchor, node FROM near QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY node) < 25 UNION ALL SELECT path, path FROM files)
SELECT x.anchor, e.from_path, e.to_path, e.kind FROM file_edges e JOIN kept x ON e.from_path = x.node JOIN kept y ON e.to_path = y.node AND x.anchor = y.anchor QUALIFY row_number() OVER (PARTITION BY x.anchor ORDER BY e.from_path, e.to_path, e.kind) <= 35"""),
)
def drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a drawing around each file shows: 25 files and 35 edges at most."""
    edges = Scratch(spark, "drawing").keep(b.file_edges(spark, sf_dir), "edges")
    return graph.neighbourhood(edges, b.files(spark, sf_dir).select(F.col("path").alias("anchor")), nodes=25, most=35)


@query("gr19_layout", code("SELECT path, split_part(path, '/', 2) AS col, CAST(coalesce(sum(40 + n_symbols * 10 + 24) OVER (PARTITION BY split_part(path, '/', 2) ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM files"))
def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = b.files(spark, sf_dir).withColumn("col", F.split("path", "/")[1])
    return graph.columns_layout(nodes, "col", 40 + F.col("n_symbols") * 10).select("path", "col", "y")


@query("gr19_folded_edges", code("d AS (SELECT path, 'src' AS shown FROM files WHERE path LIKE 'src/%') SELECT DISTINCT split_part(e.from_path, '/', 1) || '/' || split_part(e.from_path, '/', 2) AS source, split_part(e.to_path, '/', 1) || '/' || split_part(e.to_path, '/', 2) AS target, e.kind FROM file_edges e WHERE split_part(e.from_path, '/', 2) <> split_part(e.to_path, '/', 2)"))
def folded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File edges after each brand's directory is folded into one node."""
    files = b.files(spark, sf_dir).select("path")
    dirs = files.select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).where("dir <> 'src'").distinct()
    return graph.folded_edges(files, b.file_edges(spark, sf_dir), dirs)


@query(
    "gr13_on_cycles",
    """WITH RECURSIVE n AS (SELECT DISTINCT p_partkey % 97 AS k FROM part), e AS (SELECT DISTINCT k AS a, (k * k + 1) % 97 AS b FROM n UNION SELECT k, (k * 5 + 2) % 97 FROM n WHERE k % 3 = 0), reach AS (SELECT b AS anchor, a AS node FROM e UNION SELECT r.anchor, e.a FROM reach r JOIN e ON e.b = r.node)
SELECT 'f' || anchor AS anchor, 'f' || node AS node FROM reach""",
)
def impact_on_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that depends on each file of a graph with cycles; a file that depends on itself that way is part of its own result."""
    keys = table(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("k")).distinct()
    spoken = lambda k: F.concat(F.lit("f"), k.cast("string"))
    one = keys.select(spoken(F.col("k")).alias("from_path"), spoken((F.col("k") * F.col("k") + 1) % 97).alias("to_path"))
    two = keys.where("k % 3 = 0").select(spoken(F.col("k")).alias("from_path"), spoken((F.col("k") * 5 + 2) % 97).alias("to_path"))
    edges = one.unionByName(two).distinct().withColumn("kind", F.lit("imports"))
    anchors = edges.select(F.explode(F.array("from_path", "to_path")).alias("anchor")).distinct()
    return graph.transitive_dependents(edges, anchors, Scratch(spark, "cycles"), keep_anchor=True).select("anchor", "node")


@query("gr20_directories", code("SELECT DISTINCT unnest(['src', 'src/' || split_part(path, '/', 2)]) AS dir FROM files"))
def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.collapsed_dirs(b.files(spark, sf_dir), above=0)


@query("src8_tree", code("SELECT DISTINCT dir AS path, d AS depth, true AS is_dir FROM (SELECT unnest(['src', 'src/' || split_part(path, '/', 2)]) AS dir, unnest([0, 1]) AS d FROM files) UNION SELECT path, 2, false FROM files"))
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory tree of all indexed paths."""
    from graphloom.sources.scan import tree

    return tree(b.files(spark, sf_dir).select("path")).select("path", "depth", "is_dir")


@query("search1_tokens", code("SELECT id, unnest(list_distinct([lower(name)] || list_filter(string_split(lower(name), ' '), lambda x: strlen(x) > 1))) AS token FROM symbols"))
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.token_table(b.symbols(spark, sf_dir))


_BM25_SQL = f"""q AS (SELECT unnest(['red', 'widget']) AS term), rows AS (SELECT id, unnest(list_distinct([lower(name)] || list_filter(string_split(lower(name), ' '), lambda x: strlen(x) > 1))) AS token FROM symbols),
len AS (SELECT id, count(*) AS length FROM rows GROUP BY id), st AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM len),
hits AS (SELECT id, term, count(*) AS tf FROM rows JOIN q ON starts_with(token, term) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM hits GROUP BY 1)
SELECT h.id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * {search.K1 + 1} / (tf + {search.K1} * ({1 - search.B} + {search.B} * length / avg_length))), 6) AS score FROM hits h JOIN df USING (term) JOIN len USING (id) CROSS JOIN st GROUP BY h.id"""


@query("search3_bm25", code(_BM25_SQL))
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all symbols that match a query."""
    return search.bm25(search.token_table(b.symbols(spark, sf_dir)), "id", ["red", "widget"])


@query("search3_stored_index", code(_BM25_SQL.replace("FROM symbols)", "FROM (SELECT id, CASE WHEN id % 5 = 1 THEN replace(name, 'red', 'widgetred') ELSE name END AS name FROM symbols WHERE id % 7 <> 3))")))
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from a stored index, after some symbols were renamed and others went."""
    from graphloom.sources.postings import Index

    scratch = Scratch(spark, "postings")
    own = b.symbols(spark, sf_dir)
    root = f"{scratch.root}/index"
    Index(spark, root).add(search.token_table(own))
    renamed = own.where("id % 5 = 1 and id % 7 <> 3").withColumn("name", F.replace("name", F.lit("red"), F.lit("widgetred")))
    Index(spark, root).add(search.token_table(renamed), own.where("id % 7 = 3").select("id"))
    return Index(spark, root).search(["red", "widget"])


@query("top1_manifest", code("""d AS (SELECT to_path AS path, count(DISTINCT from_path) AS in_degree FROM file_edges GROUP BY 1), r AS (SELECT f.path, coalesce(d.in_degree, 0) AS in_degree, row_number() OVER (ORDER BY coalesce(d.in_degree, 0) DESC, f.path) AS rank_order FROM files f LEFT JOIN d USING (path))
SELECT path, rank_order, in_degree, '- /' || path || CASE WHEN in_degree >= 2 THEN ' (In: ' || in_degree || ')' ELSE '' END AS line FROM r WHERE rank_order <= 20"""))
def top_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most depended-on files as manifest lines."""
    ins = graph.dependents(b.file_edges(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("in_degree"))
    ranked = b.files(spark, sf_dir).select("path").join(ins, "path", "left").fillna(0, ["in_degree"])
    ranked = ordering.with_position(ranked, [F.col("in_degree").desc(), F.col("path").asc()], Scratch(spark, "manifest"), "rank_order")
    rows = manifest.select_files(ranked, manifest.Options(top_k=20)).withColumns({"exports": F.array().cast("array<string>"), "route": F.lit(None).cast("string"), "depends_on": F.array().cast("array<string>")})
    return rows.select("path", "rank_order", "in_degree", manifest.line(F.col("rank_order")).alias("line"))


@query("top4_collapsed", code("r AS (SELECT path, row_number() OVER (ORDER BY n_symbols DESC, path) AS rank_order FROM files) SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS n_files FROM r WHERE rank_order > 50 GROUP BY 1"))
def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ordering.with_position(b.files(spark, sf_dir), [F.col("n_symbols").desc(), F.col("path").asc()], Scratch(spark, "collapsed"), "rank_order")
    return manifest.collapsed(ranked, budget=50)


@query("agg2_languages", code("SELECT CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'ts' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' ELSE 'markdown' END AS language, count(*) AS n_files, CAST(sum(n_symbols) AS BIGINT) AS n_symbols FROM files GROUP BY 1"))
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).groupBy(paths.language(F.col("path")).alias("language")).agg(F.count("*").alias("n_files"), F.sum("n_symbols").alias("n_symbols"))


@query("agg6_workspace_tokens", code("SELECT round(sum(n_symbols * 2200) / 3.7, 6) AS raw_tokens, CAST(count(*) * 65 + sum(n_symbols) * 25 AS BIGINT) AS map_tokens FROM files"))
def workspace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).agg(F.round(F.sum(F.col("n_symbols") * 2200) / texts.CHARS_PER_TOKEN, 6).alias("raw_tokens"), (F.count("*") * 65 + F.sum("n_symbols") * 25).alias("map_tokens"))


@query(
    "agg8_context_budget",
    code("""n AS (SELECT path, n_symbols * 90 AS size FROM files), ch AS (SELECT split_part(path, '/', 2) AS context, path, NULL AS name FROM files WHERE n_symbols >= 3 UNION SELECT split_part(file_path, '/', 2), file_path, name FROM symbols WHERE id % 3 = 0 UNION SELECT 'none', 'none', NULL),
whole AS (SELECT context, path FROM ch WHERE name IS NULL), first AS (SELECT file_path AS path, name, arg_min(end_line - start_line + 1, id) AS lines FROM symbols GROUP BY 1, 2),
bytes AS (SELECT context, size AS b FROM whole JOIN n USING (path) UNION ALL SELECT c.context, least(n.size, f.lines * 40) FROM ch c JOIN first f USING (path, name) JOIN n USING (path) WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.context = c.context AND w.path = c.path)),
f AS (SELECT context, CAST(round(sum(b) / 3.7::DOUBLE) AS BIGINT) AS f FROM bytes GROUP BY 1), own AS (SELECT DISTINCT context, path FROM ch),
listed AS (SELECT context, path FROM own UNION SELECT context, to_path FROM own JOIN file_edges ON path = from_path UNION SELECT context, from_path FROM own JOIN file_edges ON path = to_path),
chars AS (SELECT n.path, length(n.path) + 4 + coalesce((SELECT sum(length(to_path) + 3) + 12 FROM file_edges e WHERE e.from_path = n.path), 0) AS chars FROM n),
m AS (SELECT context, CAST(round(sum(chars) / 3.7::DOUBLE) AS BIGINT) AS m FROM listed JOIN chars USING (path) GROUP BY 1)
SELECT context, coalesce(f, 0) AS file_tokens, coalesce(m, 0) AS manifest_tokens, coalesce(f, 0) + coalesce(m, 0) AS total_tokens, round(least((coalesce(f, 0) + coalesce(m, 0)) / 16000 * 100, 100.0::DOUBLE), 1) AS percent FROM (SELECT DISTINCT context FROM ch) LEFT JOIN f USING (context) LEFT JOIN m USING (context)"""),
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each directory's larger files, and a third of its symbols, take of a context."""
    scratch, own = Scratch(spark, "budget"), b.symbols(spark, sf_dir)
    edges = scratch.keep(b.file_edges(spark, sf_dir), "edges")
    files = b.files(spark, sf_dir)
    none = F.array().cast("array<string>")
    nodes = files.select("path", (F.col("n_symbols") * 90).alias("size_bytes"), none.alias("exports"), none.alias("routes"))
    place = lambda path: F.split_part(path, F.lit("/"), F.lit(2)).alias("context")
    no_name = F.lit(None).cast("string").alias("name")
    chosen = files.where("n_symbols >= 3").select(place(F.col("path")), "path", no_name).unionByName(own.where("id % 3 = 0").select(place(F.col("file_path")), F.col("file_path").alias("path"), "name"))
    return manifest.context_budget(nodes, edges, own, chosen.unionByName(spark.range(1).select(F.lit("none").alias("context"), F.lit("none").alias("path"), no_name)))


@query("sl6_collapse_endpoints", code("""raw AS (SELECT e.to_id AS anchor, t.file_path AS anchor_file, s.file_path, s.name, s.kind FROM edges e JOIN symbols s ON e.from_id = s.id JOIN symbols t ON e.to_id = t.id),
named AS (SELECT DISTINCT anchor, file_path, file_path || '#' || name AS endpoint, 'calls' AS kind FROM raw WHERE kind NOT IN ('variable', 'file', 'constant', 'field', 'property') AND name <> file_path)
SELECT anchor, endpoint, kind FROM named UNION ALL SELECT DISTINCT anchor, file_path, 'references' FROM raw r WHERE file_path <> anchor_file AND NOT EXISTS (SELECT 1 FROM named n WHERE n.anchor = r.anchor AND n.file_path = r.file_path)"""))
def collapse_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of every symbol, each file's local names folded into the file."""
    from graphloom.operators.slicing import collapse

    own = b.symbols(spark, sf_dir)
    raw = b.edges(spark, sf_dir).drop("kind").join(own.withColumnRenamed("id", "from_id"), "from_id").join(own.select(F.col("id").alias("to_id"), F.col("file_path").alias("anchor_file")), "to_id")
    return collapse(raw.select(F.col("to_id").alias("anchor"), "anchor_file", "file_path", "name", "kind"))
