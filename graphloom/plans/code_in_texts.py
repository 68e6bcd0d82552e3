"""Queries over source files made of every word of the documents: comments, strings and declarations in any order. SQL parses the same texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.lexical import code_text
from graphloom.sources import declared, extract
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


# Syllables and letters that become signs, so that texts turn into comments and strings that begin and end anywhere.
SYLLABLES = (("an", "/*"), ("en", "*/"), ("er", "//"), ("in", '"""'), ("on", "'''"), ("ar", "--"))
LETTERS, SIGNS = "gbfqjd", "\"'`#\\\n"
SOUP = ("go", "python", "sql", "graphql")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _soup_sql() -> str:
    text = "text"
    for old, new in SYLLABLES:
        text = f"replace({text}, {_quoted(old)}, {_quoted(new)})"
    return f"translate({text}, {_quoted(LETTERS)}, {_quoted(SIGNS)})"


_BLOCK, _LINE, _DOUBLE, _SINGLE = r"/\*[\s\S]*?(?:\*/|\z)", r"//[^\n]*", r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"?', r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'?"
_TOKENS = {
    "go": (_BLOCK, _LINE, "`[^`]*`?", _DOUBLE, r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,9})'", r"[^/`\"']+", r"[\s\S]"),
    "python": (r"#[^\n]*", r'"""(?:"{0,2}(?:[^"\\]|\\[\s\S]))*"{0,3}', r"'''(?:'{0,2}(?:[^'\\]|\\[\s\S]))*'{0,3}", _DOUBLE, _SINGLE, r"""[^#"']+""", r"[\s\S]"),
    "sql": (_BLOCK, r"--[^\n]*", "'[^']*'?", r'"[^"\n]*"?', r"""[^-/"']+""", r"[\s\S]"),
    "graphql": (r"#[^\n]*", r'"""[\s\S]*?(?:"""|\z)', _DOUBLE, '[^#"]+', r"[\s\S]"),
    "rust": (_BLOCK, _LINE, '"[^"]*"?', '[^/"]+', r"[\s\S]"),
    "java": (_BLOCK, _LINE, r'"[^"\n]*"?', '[^/"]+', r"[\s\S]"),
    "javascript": (_BLOCK, _LINE, "`[^`]*`?", _DOUBLE, _SINGLE, "[^/`\"']+", r"[\s\S]"),
}
_STARTS = {"go": ("^/[*/]", "[/`\"']"), "python": ("^#", "[#\"']"), "sql": (r"^(/\*|--)", "[-/\"']"), "graphql": ("^#", '[#"]'), "rust": ("^/[*/]", '[/"]'), "java": ("^/[*/]", '[/"]'), "javascript": ("^/[*/]", "[/`\"']")}


def _code_sql(text: str, language: str, comments: bool = False) -> str:
    comment, first = _STARTS[language]
    blank = f"regexp_matches(x, {_quoted(f'^{first}')}) AND contains(x, chr(10))" + ("" if comments else f" OR regexp_matches(x, {_quoted(comment)})")
    return f"array_to_string(list_transform(regexp_extract_all({text}, {_quoted('|'.join(_TOKENS[language]))}), lambda x: CASE WHEN {blank} THEN regexp_replace(x, '[^\\n]', ' ', 'g') ELSE x END), '')"


@query(
    "lx1_code_of_texts",
    f"WITH s AS (SELECT doc_id, ({list(SOUP)})[CAST(doc_id % {len(SOUP)} + 1 AS INT)] AS language, {_soup_sql()} AS text FROM documents WHERE text IS NOT NULL), "
    f"c AS (SELECT doc_id, language, CASE language {' '.join(f'WHEN {_quoted(x)} THEN {_code_sql("text", x)}' for x in SOUP)} END AS code FROM s) "
    "SELECT doc_id, language, CAST(length(code) AS BIGINT) AS n_chars, CAST(length(regexp_replace(code, '[ \\n]', '', 'g')) AS BIGINT) AS n_signs, sha256(code) AS code_sha256 FROM c",
)
def code_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each document after syllables and letters become signs, read as one of four languages."""
    text = F.col("text")
    for old, new in SYLLABLES:
        text = F.replace(text, F.lit(old), F.lit(new))
    language = F.element_at(F.array(*map(F.lit, SOUP)), (F.col("doc_id") % len(SOUP) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", language.alias("language"), F.translate(text, LETTERS, SIGNS).alias("text"))
    code = rows.select("doc_id", "language", code_text(F.col("text"), F.col("language")).alias("code"))
    return code.select("doc_id", "language", F.length("code").cast("long").alias("n_chars"), F.length(F.regexp_replace("code", r"[ \n]", "")).cast("long").alias("n_signs"), F.sha2("code", 256).alias("code_sha256"))


LANGUAGES = ("rust", "go", "java", "php", "csharp")
HEAD = "use diesel sea_orm sqlx jakarta.persistence Illuminate\\Database EntityFrameworkCore"
#: Lines of a file, one a word; <w> is the word.
SHAPES = (
    "pub static <W>: u8 = 1;", "/* <w>", "*/ let <w> = 1;", "// static OLD: u8 = 1;", "let (tx, mut <w>) = mpsc::channel(8);", "  var <w> = make(chan int)", "x := `<w>", "@Entity", "#[derive(Clone, FromRow)]",
    "class <w> extends Model {", "pub struct <w> { }", "  DbSet<<w>> All; // DbSet<No>", 'x = "<w>', "", "*/", "`; }", 'y"; public class <w> { }', "public class <w> { }",
)
_DECLARING = dict.fromkeys(LANGUAGES, SHAPES)


def _shape_sql(shapes: tuple[str, ...]) -> str:
    own = lambda s: " || ".join({"<W>": "upper(w)", "<w>": "w"}.get(x, _quoted(x)) for x in re.split("(<W>|<w>)", s) if x) or "''"
    return f"CASE (i * 7 + length(w) * 3 + i * length(w) + doc_id * 5) % {len(shapes)} " + " ".join(f"WHEN {k} THEN {own(s)}" for k, s in enumerate(shapes)) + " END"


def _files(spark: SparkSession, sf_dir: str, shapes: dict[str, tuple[str, ...]], head: str = "") -> DataFrame:
    """A file of each document in one of the languages: path, language, content, a line a word. The shape comes from place, length and document."""
    words, number = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.col("doc_id") % len(shapes)

    def lines(own: tuple[str, ...]):
        def line(w, i):
            k = (i * 7 + F.length(w) * 3 + i * F.length(w) + F.col("doc_id") * 5) % len(own)
            return F.replace(F.replace(F.element_at(F.array(*map(F.lit, own)), (k + 1).cast("int")), F.lit("<W>"), F.upper(w)), F.lit("<w>"), w)

        return F.transform(words, line)

    body = F.lit(None)
    for n, own in enumerate(shapes.values()):
        body = F.when(number == n, lines(own)).otherwise(body)
    rows = table(spark, sf_dir, "documents").where("text is not null")
    made = rows.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.element_at(F.array(*map(F.lit, shapes)), (number + 1).cast("int")).alias("language"), F.array_join(F.concat(F.array(F.lit(head)), body), "\n").alias("content"))
    return Scratch(spark, "texts").keep(made, "files")


def _lines_sql(shapes: dict[str, tuple[str, ...]], lexis: dict[str, str], head: str = "") -> str:
    """n: doc_id, language, line, t (its code) and raw (with comments of one line) of those files."""
    body = "CASE language " + " ".join(f"WHEN {_quoted(x)} THEN {_shape_sql(own)}" for x, own in shapes.items()) + " END"
    code = lambda comments: "CASE language " + " ".join(f"WHEN {_quoted(x)} THEN {_code_sql('content', lexis.get(x, x), comments)}" for x in shapes) + " END"
    return f"""l AS (SELECT doc_id, language, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, ({list(shapes)})[CAST(doc_id % {len(shapes)} + 1 AS INT)] AS language, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents WHERE text IS NOT NULL)),
f AS (SELECT doc_id, language, {_quoted(head)} || chr(10) || string_agg({body}, chr(10) ORDER BY i) AS content FROM l GROUP BY ALL),
c AS (SELECT doc_id, language, string_split({code(False)}, chr(10)) AS ls, string_split({code(True)}, chr(10)) AS rs FROM f),
n AS (SELECT doc_id, language, generate_subscripts(ls, 1) AS line, unnest(ls) AS t, unnest(rs) AS raw FROM c)"""


@query(
    "st_sc_in_texts",
    f"""WITH {_lines_sql(_DECLARING, {"php": "rust", "csharp": "java"}, HEAD)},
m AS (SELECT *, CASE WHEN language = 'java' AND regexp_matches(t, '^\\s*@Entity\\b') OR language = 'rust' AND regexp_matches(t, '^\\s*#\\[derive\\(.*FromRow') THEN line END AS mark, CASE WHEN NOT regexp_matches(t, '^\\s*[@#]') AND trim(t) <> '' THEN line END AS bare FROM n),
b AS (SELECT *, max(mark) OVER w AS last_mark, coalesce(max(bare) OVER w, 0) AS last_bare FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT doc_id, 'state_store' AS kind, regexp_extract(t, '^\\s*(?:pub\\s+)?static\\s+([A-Z]\\w*)', 1) AS name, line FROM n WHERE language = 'rust'
UNION ALL SELECT doc_id, 'state_store', unnest(['tx', regexp_extract(t, 'mut (\\w+)', 1)]), line FROM n WHERE language = 'rust' AND regexp_matches(t, '^\\s*let \\(tx, mut \\w+\\) = mpsc::channel\\(')
UNION ALL SELECT doc_id, 'state_store', regexp_extract(t, '^\\s*var (\\w+) = make\\(chan ', 1), line FROM n WHERE language = 'go'
UNION ALL SELECT doc_id, 'database_schema', regexp_extract(t, 'DbSet<(\\w+)>', 1), line FROM n WHERE language = 'csharp'
UNION ALL SELECT doc_id, 'database_schema', regexp_extract(t, '^\\s*class (\\w+) extends Model\\b', 1), line FROM n WHERE language = 'php'
UNION ALL SELECT doc_id, 'database_schema', regexp_extract(t, '^\\s*(?:(?:public|pub)\\s+)*(?:class|struct)\\s+(\\w+)', 1), last_mark FROM b WHERE last_mark > last_bare)
SELECT 'd/' || doc_id AS path, name, CAST(min(line) AS INT) AS line, arg_min(kind, (line, kind)) AS kind FROM u WHERE name <> '' GROUP BY doc_id, name""",
)
def declarations_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State stores and schemas of Rust, Go, Java, PHP and C# files, a line a word of the documents."""
    return declared.declarations(_files(spark, sf_dir, _DECLARING, HEAD))


ROUTING = {
    "javascript": ("app.get('/<w>', h.<w>)", 'router.POST("/x/<w>")', "app.get('view engine')", "/* <w>", "*/ app.put('/p/<w>', <w>)", "const s = `<w>", "`;", "// app.get('/no', x)", "  e.delete(`/<w>`, run_<w>) // app.get('/no')", "'/*'", "*/", "`"),
    "python": ("@app.route('/<w>')", "@get('/b/<w>')", "def run_<w>():", "    async def <w>(x):", '"""<w>', "'''", "# @app.get('/no')", "    (r'/t/<w>', <W>Handler),", "app.add_route(<W>.as_view(), '/s/<w>') # def no():", "x = 'a # b'", "pass", '"""', "'''"),
    "go": ('api := e.Group("/<w>")', 'api.GET("/<w>", ctl.<w>)', 'e.Post("/<w>", <w>)', "// @router /r/<w> [get]", "func (c *C) <W>() {}", "x := `<w>", "`", "/*", "*/", '// api.GET("/no", x)', "var y = 1", "", '*/ api.Put("/p/<w>")'),
    "rust": ('.route("/<w>", get(a::<w>)).route("/y/<w>", put(put_<w>))', '.at("/z/<w>", get(<w>)) // .route("/no", get(x))', 'let s = "<w>', '";', "/* <w>", '*/ .route("/k/<w>", any(k))', "let c = x;", "*/", ""),
}


@query(
    "rt_in_texts",
    rf"""WITH {_lines_sql(ROUTING, {})},
js AS (SELECT *, '(?:app|router|e)\.(?:get|POST|put|delete)\([''"`](/[^''"`]*)[''"`](?:, ([\w.]+))?' AS p FROM n WHERE language = 'javascript'),
py AS (SELECT *, first_value(nullif(regexp_extract(t, '^\s*(?:async )?def (\w+)', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_def FROM n WHERE language = 'python'),
g AS (SELECT *, regexp_extract(t, '(\w+)\.(?:GET|Post|Put)\("', 1) AS called, regexp_extract(t, '^\s*(\w+) := .*\.Group\("', 1) AS made FROM n WHERE language = 'go'),
gg AS (SELECT *, last_value(CASE WHEN made <> '' THEN regexp_extract(t, 'Group\("([^"]*)"', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id, coalesce(nullif(called, ''), made) ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prefix,
 last_value(CASE WHEN raw LIKE '// @router %' THEN line END IGNORE NULLS) OVER w AS mark, last_value(CASE WHEN raw LIKE '// @router %' THEN regexp_extract(raw, '@router (\S+)', 1) END IGNORE NULLS) OVER w AS said, coalesce(max(CASE WHEN trim(t) <> '' THEN line END) OVER w, 0) AS code FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rs AS (SELECT doc_id, line, unnest(regexp_extract_all(t, '\.(?:route|at)\("(/[^"]*)"(?:, \w+\(([\w:]+))?', 1)) AS route, unnest(regexp_extract_all(t, '\.(?:route|at)\("(/[^"]*)"(?:, \w+\(([\w:]+))?', 2)) AS handler FROM n WHERE language = 'rust'),
a AS (SELECT doc_id, line, regexp_extract(t, p, 1) AS route, regexp_extract(t, p, 2) AS handler FROM js
UNION ALL SELECT doc_id, line, regexp_extract(t, '^\s*@(?:app\.route|get)\(''([^'']+)''', 1), next_def FROM py
UNION ALL SELECT doc_id, line, regexp_extract(t, 'add_route\(\w+\.as_view\(\), ''(/[^'']*)''', 1), regexp_extract(t, 'add_route\((\w+)', 1) FROM py
UNION ALL SELECT doc_id, line, regexp_extract(t, '^[^(]*\(r''(/[^'']*)'', [A-Z]', 1), regexp_extract(t, '^[^(]*\(r''/[^'']*'', ([A-Z]\w*)', 1) FROM py
UNION ALL SELECT doc_id, line, CASE WHEN called <> '' THEN coalesce(prefix, '') || regexp_extract(t, '\w\.(?:GET|Post|Put)\("([^"]*)"', 1) ELSE '' END, regexp_extract(t, '\w\.(?:GET|Post|Put)\("[^"]*", ([\w.]+)', 1) FROM gg
UNION ALL SELECT doc_id, mark, said, regexp_extract(t, '^\s*func \([^)]*\) (\w+)', 1) FROM gg WHERE mark > code AND regexp_matches(t, '^\s*func \([^)]*\) \w')
UNION ALL SELECT doc_id, line, route, handler FROM rs)
SELECT 'd/' || doc_id AS path, CAST(line AS INT) AS line, route, nullif(handler, '') AS handler FROM a WHERE route <> ''""",
)
def routes_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of JavaScript, Python, Go and Rust files, a line a word of the documents, among comments and strings that hold others."""
    files = _files(spark, sf_dir, ROUTING)
    scanners = {"javascript": extract.router_calls, "python": extract.decorated_routes, "go": declared.go_routes, "rust": extract.rust_routes}
    found = None
    for language, scanner in scanners.items():
        rows = scanner(files.where(F.col("language") == language)).select("path", F.col("line").cast("int").alias("line"), "route", F.nullif("handler", F.lit("")).alias("handler"))
        found = rows if found is None else found.unionByName(rows)
    return found
