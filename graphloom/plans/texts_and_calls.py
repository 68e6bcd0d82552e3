"""Queries over pages, documents, conversations and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.functions import text as texts
from graphloom.operators import ordering, search, telemetry
from graphloom.plans import bindings as b
from graphloom.sources import declared, extract
from graphloom.storage import Scratch, table
from graphloom.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_HTML = r"""facts AS (SELECT page_id, unnest(regexp_extract_all(html, '\b(src|href|id)="([^"]*)"', 1)) AS attribute, unnest(regexp_extract_all(html, '\b(src|href|id)="([^"]*)"', 2)) AS value FROM pages),
named AS (SELECT page_id, CASE WHEN attribute = 'id' THEN 'export' WHEN starts_with(value, 'http') THEN 'external' ELSE 'import' END AS fact, CASE WHEN attribute = 'id' THEN 'id:' || value ELSE value END AS name FROM facts WHERE value <> '')"""


@query("ex12_link_targets", f"WITH {_HTML} SELECT fact, name, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM named GROUP BY 1, 2")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each target is linked, and from how many pages."""
    facts = extract.html_facts(table(spark, sf_dir, "pages"), "page_id", F.col("html"))
    return facts.groupBy("fact", "name").agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


@query("ex12_top_targets", f"WITH {_HTML}, t AS (SELECT name, count(DISTINCT page_id) AS in_degree FROM named WHERE fact = 'import' GROUP BY 1) SELECT name, in_degree, '- ' || name || CASE WHEN in_degree >= 2 THEN ' (In: ' || in_degree || ')' ELSE '' END AS line FROM t ORDER BY in_degree DESC, name LIMIT 50")
def top_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most linked targets as manifest lines."""
    facts = extract.html_facts(table(spark, sf_dir, "pages"), "page_id", F.col("html")).where("fact = 'import'")
    counted = facts.groupBy("name").agg(F.countDistinct("page_id").alias("in_degree"))
    shown = F.when(F.col("in_degree") >= 2, F.concat(F.lit(" (In: "), F.col("in_degree").cast("string"), F.lit(")"))).otherwise("")
    return counted.withColumn("line", F.concat(F.lit("- "), "name", shown)).orderBy(F.col("in_degree").desc(), "name").limit(50)


@query("ex16_markdown_links", r"""WITH m AS (SELECT page_id, regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[\2](\1#top)', 'g') AS text FROM pages), l AS (SELECT page_id, unnest(regexp_extract_all(text, '\[[^\]]*\]\(([^)\s]*)[^)]*\)', 1)) AS t FROM m) SELECT page_id, regexp_replace(t, '#.*$', '') AS target, count(*) AS n FROM l WHERE t <> '' AND NOT regexp_matches(t, '^(https?:|mailto:|#)') GROUP BY 1, 2""")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page, written as Markdown first."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', "[$2]($1#top)").alias("text"))
    return extract.markdown_links(pages, "page_id", F.col("text")).groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query(
    "src6_classify_paths",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS path FROM pages), q AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM p), r AS (SELECT *, lower(regexp_extract(name, '^.+\.([^.]*)$', 1)) AS ext FROM q)
SELECT page_id, path, CASE WHEN ext IN ('html', 'htm') THEN 'html' WHEN ext = 'py' THEN 'python' WHEN ext IN ('js', 'ts') THEN 'javascript' WHEN ext = 'md' THEN 'markdown' ELSE 'other' END AS language,
NOT (ext IN ('png', 'jpg', 'pdf', 'zip', 'gz') OR name IN ('.npmrc', 'credentials', 'id_rsa')) AS indexed, path LIKE 'tests/%' OR path LIKE '%/tests/%' OR contains(name, '.test.') AS test, CAST(length(path) - length(replace(path, '/', '')) AS INT) AS depth FROM r""",
)
def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, index and test flags of every page's path."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*/([^?#]*)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    p = F.col("path")
    return rows.select("page_id", "path", paths.language(p).alias("language"), paths.is_indexed(p).alias("indexed"), paths.is_test(p).alias("test"), paths.depth(p).alias("depth"))


@query("flt1_scope", r"WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS path FROM pages) SELECT page_id, path FROM p WHERE path = 'en' OR starts_with(path, 'en/')")
def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]*/([^?#]*)", 1).alias("path"))
    return rows.where(paths.in_scope(F.col("path"), "./en/**"))


_LINES = r"string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10))"


@query("sl3_signatures", rf"""WITH d AS (SELECT doc_id, {_LINES} AS own FROM documents), h AS (SELECT doc_id, own[1:6] AS head FROM d),
k AS (SELECT doc_id, head, list_position(list_transform(head, lambda x: regexp_matches(rtrim(x), '(\{{|:|=>|;)$')), true) AS hit FROM h)
SELECT doc_id, regexp_replace(array_to_string(CASE WHEN coalesce(hit, 0) > 0 THEN head[1:hit] ELSE head END, chr(10)), '[{{\s]+$', '') AS signature FROM k""")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declaration head of each document, read as one symbol."""
    return table(spark, sf_dir, "documents").select("doc_id", texts.signature(F.col("text"), F.lit(1), F.lit(1_000_000)).alias("signature"))


@query("sl1_numbered_lines", rf"""WITH d AS (SELECT doc_id, {_LINES} AS own FROM documents) SELECT doc_id, CASE WHEN len(own) >= 2 THEN array_to_string(list_transform(range(2, least(4, len(own)) + 1), lambda k: lpad(CAST(k AS VARCHAR), 4, ' ') || ': ' || own[k]), chr(10)) ELSE '' END AS code, len(own) AS n_lines FROM d""")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4 of each document with their numbers."""
    return table(spark, sf_dir, "documents").select("doc_id", texts.numbered(F.col("text"), F.lit(2), F.lit(4)).alias("code"), F.size(texts.lines(F.col("text"))).cast("long").alias("n_lines"))


@query("sl5_snippets", rf"""WITH d AS (SELECT doc_id, {_LINES} AS own FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, own, greatest(coalesce(list_position(list_transform(own, lambda x: contains(lower(x), 'token')), true), 0), 1) AS hit FROM d)
SELECT doc_id, array_to_string(own[greatest(hit - 1, 1):least(hit + 1, len(own))], chr(10)) AS snippet FROM k""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", texts.snippet(F.col("text"), "token").alias("snippet"))


@query("tel2_token_estimates", "SELECT source, CAST(sum(round(length(text) / 3.7)) AS BIGINT) AS tokens, round(sum(round(length(text) / 3.7)) * 3 / 1000000, 6) AS usd FROM documents GROUP BY source")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(texts.token_estimate(F.col("text"))).alias("tokens"))
    return own.withColumn("usd", F.round(texts.cost_usd(F.col("tokens")), 6))


_ROUTE_NAMES = ("getUser", "POST /items", "deleteItem", "putThing", "patch_it", "options", "head")


@query("agg3_http_methods", f"WITH n AS (SELECT upper(({list(_ROUTE_NAMES)})[event_id % 7 + 1] || event_type) AS u FROM events) SELECT CASE WHEN contains(u, 'GET') THEN 'GET' WHEN contains(u, 'POST') THEN 'POST' WHEN contains(u, 'PUT') THEN 'PUT' WHEN contains(u, 'PATCH') THEN 'PATCH' WHEN contains(u, 'DELETE') THEN 'DELETE' WHEN contains(u, 'OPTIONS') THEN 'OPTIONS' WHEN contains(u, 'HEAD') THEN 'HEAD' ELSE 'GET' END AS method, count(*) AS n FROM n GROUP BY 1")
def http_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of events whose names say one each."""
    name = F.concat(F.element_at(F.array(*map(F.lit, _ROUTE_NAMES)), (F.col("event_id") % 7 + 1).cast("int")), "event_type")
    return table(spark, sf_dir, "events").groupBy(texts.http_method(name).alias("method")).agg(F.count("*").alias("n"))


@query("strm6_staleness", "WITH p AS (SELECT event_type || '/' || user_id AS path, max(epoch_us(ts) // 1000) AS marked FROM events GROUP BY 1) SELECT path, greatest(1704200000000 - marked, 0) AS elapsed_ms, path LIKE 'click/%' AS inside FROM p")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as marks of files; an answer refers to those that were clicked."""
    marks = b.calls(spark, sf_dir).select(F.concat_ws("/", "tool", F.col("user_id").cast("string")).alias("path"), F.col("ms").alias("marked_at"))
    return live.staleness(marks, marks.where("path like 'click/%'"), 1_704_200_000_000)


@query("strm8_active_targets", "WITH t AS (SELECT user_id AS target, max(event_id * 40) + 2000 AS until_ms FROM events WHERE event_id * 40 <= 20000 GROUP BY 1) SELECT target, until_ms FROM t WHERE until_ms > 20000")
def active_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last call is two seconds old at most after twenty seconds of a call every 40 ms."""
    return live.active_targets(table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), (F.col("event_id") * 40).alias("ms")), 20_000)


@query("tel6_raw_cost", "WITH r AS (SELECT event_id AS call, user_id * 7 AS doc FROM events UNION ALL SELECT event_id, event_id % 50 FROM events), c AS (SELECT doc_id, CAST(round(length(text) / 3.7) AS BIGINT) AS tokens FROM documents), u AS (SELECT call, sum(tokens) AS tokens FROM (SELECT DISTINCT call, doc FROM r) x JOIN c ON doc = doc_id GROUP BY 1), n AS (SELECT call, count(*) AS asked FROM r GROUP BY 1) SELECT n.call, CAST(CASE WHEN coalesce(tokens, 0) = 0 THEN asked * 1500 ELSE tokens END AS BIGINT) AS raw_tokens FROM n LEFT JOIN u ON n.call = u.call")
def raw_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event refers to two documents; what they would have cost whole."""
    events = table(spark, sf_dir, "events")
    name = lambda c: F.concat(F.lit("/doc/"), c.cast("string")).alias("path")
    asked = events.select(F.col("event_id").alias("call"), name(F.col("user_id") * 7)).unionByName(events.select(F.col("event_id").alias("call"), name(F.col("event_id") % 50)))
    contents = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), texts.token_estimate(F.col("text")).alias("tokens"))
    return telemetry.raw_cost(asked, contents)


_SOURCES = """f AS (SELECT p_partkey AS id, p_size % 3 AS r, 'use' || regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') || p_partkey AS n FROM part)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file of each part: path, language, content, id and name, in one of three languages."""
    name = F.concat(F.lit("use"), F.regexp_replace("p_name", "[^A-Za-z0-9]", ""), F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("r"), name.alias("n"))
    script = F.concat(F.lit("import x from 'zustand'\n// export const useOld = create<S>()\nexport const "), "n", F.lit(": Store = create<S>()\nconst bus = new EventEmitter()\nbus.emit('"), "n", F.lit("', 1)"))
    python = F.concat(F.lit("from pydantic import BaseModel\n\nclass "), "n", F.lit("(BaseModel):\n    x: int\n\n@app.task\ndef run_"), "n", F.lit("():\n    pass"))
    go = F.concat(F.lit('package a\nimport "gorm"\ntype '), "n", F.lit(" struct {\n  gorm.Model\n}\ntype Plain struct {\n  X int\n}\nfunc main() {\n  api := e.Group(\"/v1\")\n  api.GET(\"/"), "n", F.lit('", handle)\n}\n// @router /go/'), "n", F.lit(" [get]\nfunc (c *C) Serve() {}"))
    pick = lambda *x: F.when(F.col("r") == 0, x[0]).when(F.col("r") == 1, x[1]).otherwise(x[2])
    return rows.select("id", "n", F.concat(F.lit("p/"), F.col("id").cast("string")).alias("path"), pick(F.lit("javascript"), F.lit("python"), F.lit("go")).alias("language"), pick(script, python, go).alias("content"))


@query("st_sc_declarations", f"WITH {_SOURCES} SELECT 'p/' || id AS path, 'state_store' AS kind, n AS name, CAST(3 AS INT) AS line FROM f WHERE r = 0 UNION ALL SELECT 'p/' || id, 'database_schema', n, 3 FROM f WHERE r <> 0 UNION ALL SELECT 'p/' || id, 'state_store', 'run_' || n, 6 FROM f WHERE r = 1")
def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State stores and schemas of source files made from all parts."""
    return declared.declarations(_sources(spark, sf_dir))


@query("rt6_go_routes", f"WITH {_SOURCES} SELECT 'p/' || id AS path, '/v1/' || n AS route, 'handle' AS handler, CAST(11 AS INT) AS line FROM f WHERE r = 2 UNION ALL SELECT 'p/' || id, '/go/' || n, 'Serve', 13 FROM f WHERE r = 2")
def go_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.go_routes(_sources(spark, sf_dir).where("language = 'go'"))


def _turns_sql(gap_ms: int) -> str:
    return f"""{b.CALLS_SQL}, g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, id) > {gap_ms} THEN 1 ELSE 0 END AS fresh FROM calls),
turns AS (SELECT *, 1 + sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS turn_id FROM g)"""


GAP = 30 * 60_000


@query("tel1_turns", f"WITH {_turns_sql(GAP)} SELECT user_id, CAST(turn_id AS BIGINT) AS turn_id, count(*) AS n_calls, min(ms) AS first_ms, max(ms) AS last_ms FROM turns GROUP BY 1, 2")
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user in turns parted by half an hour of silence."""
    own = telemetry.with_turns(b.calls(spark, sf_dir), "user_id", F.col("ms"), ["ms", "id"], GAP)
    return own.groupBy("user_id", "turn_id").agg(F.count("*").alias("n_calls"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


@query(
    "tel3_running_totals",
    f"""WITH {_turns_sql(GAP)} SELECT id, CAST(greatest(raw_tokens - output_tokens, 0) AS BIGINT) AS saved_tokens, round(CASE WHEN output_tokens > 0 AND raw_tokens > 0 THEN greatest(raw_tokens / output_tokens, 1.0) ELSE 1.0 END, 6) AS compression_ratio,
CAST(sum(output_tokens) OVER (PARTITION BY user_id, turn_id ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_total_output, CAST(sum(output_tokens) OVER (PARTITION BY user_id ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_total_output, output_tokens > 4000 AS large FROM turns""",
)
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = telemetry.with_turns(b.calls(spark, sf_dir), "user_id", F.col("ms"), ["ms", "id"], GAP)
    return telemetry.with_totals(own, "user_id", ["ms", "id"]).select("id", "saved_tokens", "compression_ratio", "turn_total_output", "session_total_output", "large")


@query("tel5_overall_ratio", f"WITH {b.CALLS_SQL} SELECT user_id, CAST(sum(greatest(raw_tokens - output_tokens, 0)) AS BIGINT) AS saved, CAST(sum(output_tokens) AS BIGINT) AS output, CASE WHEN sum(output_tokens) > 0 THEN round((sum(greatest(raw_tokens - output_tokens, 0)) + sum(output_tokens)) / sum(output_tokens), 6) ELSE 1.0 END AS ratio FROM calls GROUP BY 1")
def overall_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = b.calls(spark, sf_dir).withColumn("saved_tokens", F.greatest(F.col("raw_tokens") - F.col("output_tokens"), F.lit(0)))
    return telemetry.overall(own, "user_id")


@query("top7_recent_calls", f"WITH {b.CALLS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, id DESC) AS n FROM calls) SELECT id, user_id, tool FROM n WHERE n <= 20")
def recent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty calls of each user."""
    return telemetry.recent(b.calls(spark, sf_dir), "user_id", [F.col("ms").desc(), F.col("id").desc()], 20).select("id", "user_id", "tool")


@query("sql18_retention", "SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 2000")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.last_rows(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 2000)


@query("sql19_pending", "SELECT event_type || '/' || user_id AS path, max(epoch_us(ts) // 1000) AS marked_at FROM events GROUP BY 1")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change marks: the latest of each path."""
    marks = b.calls(spark, sf_dir).select(F.concat_ws("/", "tool", F.col("user_id").cast("string")).alias("path"), F.col("ms").alias("marked_at"))
    return live.pending(marks)


@query("strm2_bursts", f"WITH {_turns_sql(GAP - 1)} SELECT user_id, CAST(turn_id AS BIGINT) AS burst, count(*) AS n_marks, min(ms) AS first_ms, max(ms) + {GAP} AS due_ms FROM turns GROUP BY 1, 2")
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debounced bursts of marks by session windows; a burst is due half an hour after its last mark."""
    from pyspark.sql import Window

    rows = b.calls(spark, sf_dir).withColumn("at", F.timestamp_millis("ms"))
    found = live.bursts(rows, "user_id", "at", "30 minutes")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("first_at")).cast("long")
    return found.select("user_id", number.alias("burst"), "n_marks", F.unix_millis("first_at").alias("first_ms"), F.unix_millis("due_at").alias("due_ms"))


@query("strm2_bursts_streamed", f"WITH {_turns_sql(GAP - 1)} SELECT user_id, count(*) AS n_marks, min(ms) AS first_ms, max(ms) + {GAP} AS due_ms FROM turns GROUP BY user_id, turn_id HAVING max(ms) + {GAP} <= (SELECT max(ms) - 600000 FROM calls)")
def bursts_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bursts from a stream of the events; those that the watermark, ten minutes behind the last event, hasn't passed stay open."""
    scratch = Scratch(spark, "bursts")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    scratch.keep(table(spark, sf_dir, "events"), "events")
    rows = spark.readStream.schema(schema).parquet(f"{scratch.root}/events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    live.run_to(live.bursts(rows, "user_id", "at", "30 minutes"), f"{scratch.root}/out", f"{scratch.root}/progress").awaitTermination()
    found = spark.read.schema("user_id long, first_at timestamp, due_at timestamp, n_marks long").parquet(f"{scratch.root}/out")
    return found.select("user_id", "n_marks", F.unix_millis("first_at").alias("first_ms"), F.unix_millis("due_at").alias("due_ms"))


@query("strm1_marks_streamed", f"WITH {_turns_sql(GAP - 1)} SELECT CAST(user_id AS VARCHAR) AS path, count(*) AS n_marks, min(ms) AS first_ms, max(ms) AS last_ms, max(ms) + {GAP} AS due_ms FROM turns GROUP BY user_id, turn_id")
def marks_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of all events of each user, from a stateful stream of three batches; two marks in a far future close the last bursts."""
    from graphloom.streaming import marks

    scratch = Scratch(spark, "marks")
    own = b.calls(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), "ms", F.lit(False).alias("synced"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("k"))
    for k in range(3):
        scratch.keep(own.where(F.col("k") == k).drop("k").coalesce(1), f"given/k={k}")
    for k in (3, 4):
        scratch.keep(spark.range(1).select(F.lit("end").alias("path"), F.lit(k * 10**12 * 2).alias("ms"), F.lit(False).alias("synced")), f"given/k={k}")
    marks.stateful(spark)
    stream = spark.readStream.schema("path string, ms long, synced boolean").option("maxFilesPerTrigger", 1).parquet(f"{scratch.root}/given")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:  # a state store a partition
        spark.conf.set("spark.sql.shuffle.partitions", min(int(partitions), 8))
        live.run_to(marks.due_marks(stream, GAP, "5000 days"), f"{scratch.root}/out", f"{scratch.root}/progress").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return spark.read.schema(marks.DUE).parquet(f"{scratch.root}/out").where("path <> 'end'")


@query(
    "strm4_reconcile",
    """WITH known AS (SELECT 'f' || p_partkey AS path, p_size AS size_bytes, p_partkey % 3 AS mtime FROM part WHERE p_partkey % 5 <> 0), found AS (SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS size_bytes, p_partkey % 3 AS mtime FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(k.path, f.path) AS path, CASE WHEN k.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM known k FULL JOIN found f ON k.path = f.path WHERE k.path IS NULL OR f.path IS NULL OR k.size_bytes <> f.size_bytes OR k.mtime <> f.mtime""",
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots that differ: parts missing from either, and parts of another size."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), "p_partkey", F.col("p_size").alias("size_bytes"), (F.col("p_partkey") % 3).alias("mtime"))
    found = part.where("p_partkey % 7 <> 0").withColumn("size_bytes", F.when(F.col("p_partkey") % 11 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return live.reconcile(part.where("p_partkey % 5 <> 0"), found)


@query("strm5_smoothed_rate", "WITH r AS (SELECT user_id || '/' || CAST(ts AS DATE) AS run, list(value ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT run, round(list_reduce(v, lambda a, x: CAST(0.3 AS DOUBLE) * x + CAST(0.7 AS DOUBLE) * a), 9) AS ema FROM r")
def smoothed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed value of each user's day of events, folded in order."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("run"), "event_id", "value")
    return telemetry.smoothed(rows, "run", "event_id", "value", decimals=9)


@query("agg10_percentile", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS mean FROM events) SELECT event_type, round(min(mean), 6) AS mean, max(CASE WHEN place = least(floor(n * 0.95), n - 1) THEN value END) AS at_place FROM r GROUP BY 1")
def percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.percentile_rank(table(spark, sf_dir, "events"), "event_type", "value")


@query("tel8_conversation_costs", "SELECT role, count(*) AS n_turns, CAST(sum(round(length(coalesce(text, '')) / 3.7)) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def conversation_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations")
    return own.groupBy("role").agg(F.count("*").alias("n_turns"), F.sum(texts.token_estimate(F.coalesce("text", F.lit("")))).alias("tokens"))


_PLAIN = r"string_split_regex(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '[\x20\x09-\x0D]+')"


@query(
    "search7_spelt_alike",
    f"""WITH a AS (SELECT DISTINCT unnest({_PLAIN}) AS name FROM documents), b AS (SELECT DISTINCT unnest({_PLAIN}) AS asked FROM benchmark)
SELECT asked, name, CAST(levenshtein(asked, name) AS INT) AS distance FROM b JOIN a ON abs(length(asked) - length(name)) <= 1 AND levenshtein(asked, name) <= 1""",
)
def spelt_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents that one changed character makes of a word of the benchmark; characters that aren't ASCII as question marks."""
    plain = F.split(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), r"[\x20\x09-\x0D]+")
    words = lambda name, column: table(spark, sf_dir, name).select(F.explode(plain).alias(column))
    return search.spelt_alike(words("documents", "name"), words("benchmark", "asked"), 1)


@query("strm7_telemetry_tail", f"WITH {b.CALLS_SQL} SELECT id, tool, round(CASE WHEN output_tokens > 0 THEN raw_tokens / output_tokens WHEN raw_tokens > 0 THEN 18.5 ELSE 1.0 END, 6) AS ratio FROM calls")
def telemetry_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls as a stream of appended files, with their ratios."""
    scratch = Scratch(spark, "tail")
    scratch.keep(b.calls(spark, sf_dir), "calls")
    tail = live.telemetry_tail(spark, f"{scratch.root}/calls", "id long, tool string, raw_tokens long, output_tokens long")
    live.run_to(tail.select("id", "tool", F.round("ratio", 6).alias("ratio")), f"{scratch.root}/out", f"{scratch.root}/progress").awaitTermination()
    return spark.read.schema("id long, tool string, ratio double").parquet(f"{scratch.root}/out")


_TOOLS = ("explore", "search", "impact", "callers", "node", "write", "delete", "domains")


@query(
    "tel6_tool_cost",
    f"""WITH c AS (SELECT event_id AS call, ({list(_TOOLS)})[CAST(event_id % 8 + 1 AS INT)] AS tool, CASE WHEN user_id % 2 = 0 THEN user_id % 5 + 1 END AS n_asked, CASE WHEN user_id % 3 = 0 THEN props END AS content FROM events),
d AS (SELECT doc_id, CAST(round(length(text) / 3.7) AS BIGINT) AS tokens FROM documents), f AS (SELECT event_id AS call, coalesce(nullif(coalesce(tokens, 0), 0), 1500) AS of_files FROM events LEFT JOIN d ON user_id * 7 = doc_id WHERE event_id % 3 <> 0)
SELECT call, CAST(CASE tool WHEN 'callers' THEN 3500 WHEN 'delete' THEN 500 WHEN 'domains' THEN 1000 WHEN 'write' THEN coalesce(round(length(content) / 3.7) + 500, 1500)
ELSE coalesce(of_files, CASE tool WHEN 'explore' THEN 3500 * coalesce(n_asked, 1) WHEN 'search' THEN 3500 WHEN 'impact' THEN 4000 ELSE 1500 END) END AS BIGINT) AS raw_tokens FROM c LEFT JOIN f USING (call)""",
)
def tool_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of eight tools; two of three refer to a document."""
    events = table(spark, sf_dir, "events")
    tool = F.element_at(F.array(*map(F.lit, _TOOLS)), (F.col("event_id") % 8 + 1).cast("int"))
    own = events.select(F.col("event_id").alias("call"), tool.alias("tool"), F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 5 + 1).alias("n_asked"), F.when(F.col("user_id") % 3 == 0, F.col("props")).alias("content"))
    asked = events.where("event_id % 3 <> 0").select(F.col("event_id").alias("call"), F.concat(F.lit("/doc/"), (F.col("user_id") * 7).cast("string")).alias("path"))
    contents = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), texts.token_estimate(F.col("text")).alias("tokens"))
    return telemetry.tool_cost(own, asked, contents)
