"""Symbols, imports, exports and routes from source texts.

Line-based languages are column expressions over exploded lines. Python uses
its own parser and brace languages one small lexer, in batches of files.
"""

from __future__ import annotations

import ast
import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.lexical import code_text
from graphloom.functions.text import lines

ROW = "path string, fact string, name string, detail string, start_line int, end_line int"


def html_facts(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """(key, fact, name): import for each src and href that isn't http, external for the others, export for ids."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(r'\b(src|href|id)="([^"]*)"'), F.lit(1)).alias("a"), F.regexp_extract_all(html, F.lit(r'\b(src|href|id)="([^"]*)"'), F.lit(2)).alias("v"))
    each = pages.select(key, F.explode(pairs).alias("p")).select(key, F.col("p.a").alias("attribute"), F.col("p.v").alias("value"))
    fact = F.when(F.col("attribute") == "id", "export").when(F.col("value").startswith("http"), "external").otherwise("import")
    return each.where("value <> ''").select(key, fact.alias("fact"), F.when(F.col("attribute") == "id", F.concat(F.lit("id:"), "value")).otherwise(F.col("value")).alias("name"))


def markdown_links(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, target) of links that stay in the repository."""
    each = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)\s]*)[^)]*\)"), F.lit(1))).alias("target"))
    return each.where(~F.col("target").rlike("^(https?:|mailto:|#)") & (F.col("target") != "")).select(key, F.regexp_replace("target", "#.*$", "").alias("target"))


def each_line(files: DataFrame, language: str = "") -> DataFrame:
    """path, line (from 1), text of all lines; of a known language only the code."""
    return files.select("path", F.posexplode(lines(code_text(F.col("content"), language))).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def sql_facts(files: DataFrame) -> DataFrame:
    """Tables that are created (export) and referenced (import)."""
    rows = each_line(files, "sql")
    made = rows.select("path", "line", F.lit("export").alias("fact"), F.regexp_extract("text", r'(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?["`]?([\w.]+)', 1).alias("name"))
    used = rows.select("path", "line", F.lit("import").alias("fact"), F.regexp_extract("text", r'(?i)references\s+["`]?([\w.]+)', 1).alias("name"))
    return made.unionByName(used).where("name <> ''")


def prisma_facts(files: DataFrame) -> DataFrame:
    rows = each_line(files, "prisma")
    made = rows.select("path", "line", F.lit("export").alias("fact"), F.regexp_extract("text", r"^\s*model\s+(\w+)", 1).alias("name"))
    used = rows.where(F.col("text").contains("@relation")).select("path", "line", F.lit("import").alias("fact"), F.regexp_extract("text", r"^\s*\w+\s+(\w+)", 1).alias("name"))
    return made.unionByName(used).where("name <> ''")


def dockerfile_facts(files: DataFrame) -> DataFrame:
    """Base images (external) and the first source of each COPY (import)."""
    rows = each_line(files, "dockerfile")
    base = rows.select("path", "line", F.lit("external").alias("fact"), F.regexp_extract("text", r"(?i)^\s*from\s+(?:--\S+\s+)*(\S+)", 1).alias("name"))
    words = F.filter(F.split(F.regexp_replace("text", r"(?i)^\s*copy\s+", ""), r"\s+"), lambda x: ~x.startswith("--"))
    copied = rows.where(F.col("text").rlike(r"(?i)^\s*copy\s")).select("path", "line", F.lit("import").alias("fact"), F.element_at(words, 1).alias("name"))
    return base.unionByName(copied).where("name <> ''")


def graphql_routes(files: DataFrame) -> DataFrame:
    """(path, line, route): fields of Query, Mutation and Subscription as Operation.field."""
    rows = each_line(files, "graphql")
    by_file = Window.partitionBy("path").orderBy("line")
    opened = F.regexp_extract("text", r"^\s*(?:extend\s+)?type\s+(\w+)", 1)
    kind = F.last(F.when(opened != "", opened).when(F.col("text").rlike(r"^\s*\}"), ""), ignorenulls=True).over(by_file)
    field = F.regexp_extract("text", r"^\s*(\w+)\s*(?:\([^)]*\))?\s*:", 1)
    return rows.withColumns({"kind": kind, "field": field}).where("kind in ('Query', 'Mutation', 'Subscription') and field <> ''").select("path", "line", F.concat_ws(".", "kind", "field").alias("route"))


def router_calls(files: DataFrame) -> DataFrame:
    """(path, line, method, route, handler) of router calls such as app.get("/x", handler)."""
    rows = each_line(files, "javascript")
    call = r"""(?:app|router|Route|server|e|r)\.(?i:(get|post|put|patch|delete|options|head))\(\s*["'`]([^"'`]*)["'`]\s*(?:,\s*([\w.]+))?"""
    return rows.select("path", "line", F.upper(F.regexp_extract("text", call, 1)).alias("method"), F.regexp_extract("text", call, 2).alias("route"), F.regexp_extract("text", call, 3).alias("handler")).where("method <> '' and route like '/%'")


# Decorators that name a route, after a dot or alone.
DECORATORS = "get|post|put|delete|patch|head|options|route|websocket"


def decorated_routes(files: DataFrame) -> DataFrame:
    """(path, line, route, handler): Python route decorators, each bound to the next def of its file, and rows of route tables.

    Tables are calls such as app.add_route(View.as_view(), "/x") and pairs such as (r"/x", Handler).
    """
    rows = each_line(files, "python")
    first = r"""\(\s*[rbf]?["']([^"']+)["']"""
    part = lambda pattern, k: F.regexp_extract("text", pattern, k)
    route = F.coalesce(F.nullif(part(rf"^\s*@\w+(?:\.\w+)*\.(?:{DECORATORS}){first}", 1), F.lit("")), part(rf"^\s*@(?:{DECORATORS}){first}", 1))
    name = part(r"^\s*(?:async\s+)?def\s+(\w+)", 1)
    after = Window.partitionBy("path").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    added, listed = r"""\.add_route\(\s*(\w+)[^,]*,[^"']*["'](/[^"']*)["']""", r"""^[^(]*\(\s*r?["'](/[^"']*)["']\s*,\s*([A-Z][\w.]*)"""
    kinds = F.array(F.struct(part(added, 2).alias("route"), part(added, 1).alias("handler")), F.struct(part(listed, 1).alias("route"), part(listed, 2).alias("handler")))
    # A line's text is read once, and only lines that tell something are dealt out.
    told = rows.select("path", "line", route.alias("route"), F.nullif(name, F.lit("")).alias("name"), F.filter(kinds, lambda x: x["route"] != "").alias("tabled")).where("route <> '' or name is not null or size(tabled) > 0")
    bound = told.withColumn("handler", F.first("name", ignorenulls=True).over(after))
    every = F.concat(F.when(F.col("route") != "", F.array(F.struct("route", "handler"))).otherwise(F.array().cast("array<struct<route:string,handler:string>>")), F.col("tabled"))
    return bound.select("path", "line", F.explode(every).alias("x")).select("path", "line", "x.*")


# Files of an app router's folder that serve or wrap its URL.
APP_FILES = ("page", "route", "layout", "loading", "error", "template", "not-found", "default")


def route_of_path(path: Column) -> Column:
    """The URL that a file of an app or pages router serves; null for private parts and other files."""
    parts = F.split(F.regexp_replace(path, r"^(src/)?(app|pages)/", ""), "/")
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "")
    app = path.rlike(r"^(src/)?app/") & stem.isin(*APP_FILES)
    pages = path.rlike(r"^(src/)?pages/") & path.rlike(r"\.(tsx?|jsx?)$") & ~stem.startswith("_")
    spoken = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\[\[\.\.\.(.+)\]\]$", ":$1*?"), r"^\[\.\.\.(.+)\]$", ":$1*"), r"^\[(.+)\]$", ":$1")
    shown = F.transform(F.filter(inner, lambda x: ~x.rlike(r"^(\(.*\)|@.*)$")), spoken)
    leaf = F.when(stem == "index", F.array().cast("array<string>")).otherwise(F.array(spoken(stem)))
    whole = F.when(app, shown).when(pages, F.concat(shown, leaf))
    private = F.exists(inner, lambda x: x.startswith("_"))
    return F.when(whole.isNotNull() & ~private, F.concat(F.lit("/"), F.array_join(whole, "/")))


def remix_route(path: Column) -> Column:
    """The URL that a module below a routes folder serves, flat or nested; null for other files."""
    inner = F.regexp_extract(path, r"^(?:.*?/)?(?:(?:app|src)/|(?<=^))routes/(.+)\.(?:tsx?|jsx?)$", 1)
    parts = F.concat(F.split(F.regexp_extract(inner, r"^(.*/)?[^/]*$", 1), "/"), F.split(F.regexp_extract(inner, r"([^/]*)$", 1), r"\."))
    shown = F.filter(parts, lambda x: ~x.isin("", "index", "route") & ~x.startswith("_"))
    spoken = F.transform(shown, lambda x: F.when(x == "$", "*").otherwise(F.regexp_replace(x, r"^\$", ":")))
    return F.when(inner != "", F.concat(F.lit("/"), F.array_join(spoken, "/")))


def joined_route(base: Column, sub: Column) -> Column:
    """Base and sub route with one slash between them."""
    left, right = F.regexp_replace(F.trim(base), "^/+|/+$", ""), F.regexp_replace(F.trim(sub), "^/+", "")
    return F.concat(F.lit("/"), F.array_join(F.filter(F.array(left, right), lambda x: x != ""), "/"))


def _code_lines(files: DataFrame, language: str) -> DataFrame:
    """Lines of code without outer white space; empty ones are left out."""
    rows = each_line(files, language).withColumn("text", F.trim(F.regexp_replace("text", r"[\t\r]", " ")))
    return rows.where("text <> ''")


_QUOTED = r"""^[^)"'`]*["'`]([^"'`]*)["'`]"""


def annotated_routes(files: DataFrame) -> DataFrame:
    """(path, line, route, handler): Java and Kotlin annotations, the class's base before the method's path.

    The annotations above a declaration are one group; the last base set holds.
    """
    rows = _code_lines(files, "java")
    by_file = Window.partitionBy("path").orderBy("line")
    noted = F.col("text").startswith("@")
    name = F.regexp_extract("text", r"^@(\w+)(?=$|[(\s])", 1)
    rows = rows.withColumns({"noted": noted, "name": name, "value": F.regexp_extract("text", _QUOTED, 1)})
    rows = rows.withColumn("g", F.coalesce(F.sum(F.when(F.col("noted"), 0).otherwise(1)).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    verb = F.col("noted") & F.col("name").rlike("^(Get|Post|Put|Delete|Patch|Head|Options|Route|GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$")
    placed = F.col("noted") & (F.col("name") == "Path")
    own = rows.groupBy("path", "g").agg(
        F.min(F.when(verb | placed, F.col("line"))).alias("line"),
        F.max(verb).alias("verb"),
        F.min_by("value", F.when((verb | placed) & (F.col("value") != ""), F.col("line"))).alias("sub"),
        F.min_by("value", F.when(placed, F.col("line"))).alias("place"),
        F.max_by("value", F.when(F.col("noted") & F.col("name").isin("Controller", "RequestMapping"), F.col("line"))).alias("base"),
        F.max(F.when(~F.col("noted"), F.col("text"))).alias("text"),
    )
    is_class = F.col("text").rlike(r"(^|\s)class(\s|$)")
    own = own.withColumn("base", F.last(F.coalesce("base", F.when(is_class, F.col("place"))), ignorenulls=True).over(Window.partitionBy("path").orderBy("g")))
    before = F.substring_index("text", "(", 1)
    handler = F.coalesce(F.nullif(F.regexp_extract(before, r"\bfun\s+(\w+)", 1), F.lit("")), F.regexp_extract(before, r"(\w+)\W*$", 1))
    found = own.where(F.col("verb") & ~is_class & F.col("text").contains("(")).withColumn("handler", handler)
    return found.where("handler not in ('', 'if', 'for', 'while', 'switch', 'return', 'catch', 'new')").select("path", "line", joined_route(F.coalesce("base", F.lit("")), F.coalesce("sub", F.lit(""))).alias("route"), "handler")


def _calls(files: DataFrame, call: str, language: str) -> DataFrame:
    """(path, line, route, handler) of each match of ``call`` (1: route, 2: handler, none for inline functions)."""
    every = lambda k: F.regexp_extract_all("text", F.lit(call), F.lit(k))
    rows = _code_lines(files, language).select("path", "line", F.explode(F.arrays_zip(every(1).alias("route"), every(2).alias("handler"))).alias("m"))
    handler = F.regexp_replace("m.handler", "^[.:]+|[.:]+$", "")
    return rows.select("path", "line", "m.route", F.when(~handler.isin("", "async", "function", "func", "fn", "static", "delegate", "new"), handler).alias("handler"))


def minimal_api_routes(files: DataFrame) -> DataFrame:
    """ASP.NET calls such as app.MapGet("/x", Handler)."""
    return _calls(files, r"""\.Map(?:Get|Post|Put|Delete|Patch|Methods)?\(\s*["'](/[^"']*|)["'](?:\s*,\s*([A-Za-z_$][\w.:$]*)(?![\w.:$])(?!\s*=>))?""", "csharp")


def rust_routes(files: DataFrame) -> DataFrame:
    """Axum's .route("/x", get(handler)) and Poem's .at("/x", get(handler)), all of each line."""
    return _calls(files, r"""\.(?:route|at)\(\s*r?#*"(/[^"]*)"#*(?:\s*,\s*[\w:.]+\(\s*([\w:.]+))?""", "rust")


def php_routes(files: DataFrame) -> DataFrame:
    """Slim's $app->get("/x", Handler) and Symfony's #[Route("/x")], bound to the declaration below it."""
    slim = _calls(files, r"""\$(?:app|group|router)(?:->|\.)(?:get|post|put|delete|patch|options|any|map)\(\s*["'](/[^"']*|)["'](?:\s*,\s*([A-Za-z_][\w.:$]*)(?![\w.:$(])(?!\s*(?:=>|\()))?""", "php")
    by_file = Window.partitionBy("path").orderBy("line")
    rows = _code_lines(files, "php")
    rows = rows.withColumn("route", F.when(F.col("text").rlike(r"^#\[Route ?\("), F.nullif(F.regexp_extract("text", _QUOTED, 1), F.lit(""))))
    rows = rows.withColumn("next", F.first(F.when(~F.col("text").startswith("#["), F.col("text")), ignorenulls=True).over(by_file.rowsBetween(1, Window.unboundedFollowing)))
    bound = rows.where("route is not null").select("path", "line", "route", F.regexp_extract("next", r"\b(?:function|class)\s+(\w+)", 1).alias("handler"))
    return slim.unionByName(bound.where("handler <> ''"))


def handler_symbols(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbols`` (ROW facts) and a one-line function for the first route of each handler that its file doesn't declare."""
    named = routes.withColumn("name", F.regexp_extract("handler", r"(\w+)$", 1)).where("name <> ''")
    lacking = named.join(symbols.where("fact = 'symbol'").select("path", "name"), ["path", "name"], "left_anti").groupBy("path", "name").agg(F.greatest(F.min("line"), F.lit(1)).cast("int").alias("start_line"))
    return symbols.unionByName(lacking.select("path", F.lit("symbol").alias("fact"), "name", F.lit("function").alias("detail"), "start_line", F.col("start_line").alias("end_line")))


_BRACE = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_DECLARED = re.compile(
    r"^[ \t]*(?:(?:export|default|pub(?:\([^)]*\))?|public|private|protected|internal|static|abstract|final|async|override|open|data|sealed|partial|unsafe|const|inline|virtual)\s+)*"
    r"(class|interface|enum|struct|trait|object|protocol|namespace|module|fn|func|fun|function|type)\s+(?:\([^)]*\)\s*)?(\w+)",
    re.M,
)
_KIND = {"trait": "interface", "protocol": "interface", "fn": "function", "func": "function", "fun": "function", "type": "type_alias"}
_IMPORT = re.compile(r"""^[ \t]*(?:import\s[^'"\n]*?from\s*["']([^"']+)["']|import\s*["']([^"']+)["']|(?:.*?\brequire\()["']([^"']+)["']|import\s+(?:static\s+)?([\w.]+)\s*;?|use\s+([\w:\\]+)|using\s+([\w.]+)\s*;|#include\s*"([^"]+)"|(?:export\s[^'"\n]*?from\s*)["']([^"']+)["'])""", re.M)


#: Rust has lifetimes, which are no open quotes, and raw strings.
_RUST = re.compile(r"""//[^\n]*|/\*.*?\*/|r(#+)".*?"\1|"(?:\\.|[^"\\])*"|'(?:\\[^\n]*?|[^'\\\n])'""", re.S)
_INSIDE = {"javascript": r"\$\{([^{}]*)\}", "kotlin": r"\$\{([^{}]*)\}|\$([^\W\d]\w*)", "swift": r"\\\(([^()]*)\)", "csharp": r"\{([^{}:]*)[^{}]*\}"}
_WORD = re.compile(r"(?<![\w$])[^\W\d][\w$]*")
#: Reserved in all brace languages; the others' keywords may be names elsewhere.
_RESERVED = frozenset(("if", "else", "for", "return", "break", "continue"))
#: A body, the end of a statement, an empty line, the next declaration or the end of the text.
_HEAD_END = re.compile(r"[{};]|\n(?=\s*\n)|\n(?=[ \t]*(?:(?:public|private|protected|internal|static|abstract|final|open|data|sealed|override|export)\s+)*(?:class|interface|struct|enum|object|protocol|fun|func|function|val|var|let|const|import)\b)|\Z")
_TYPE = r"[\w$.:\\]+"


def _blank(text: str, language: str = "javascript") -> str:
    """The text with comments and strings blanked, line breaks kept, so that braces and words in them don't count."""
    return (_RUST if language == "rust" else _BRACE).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _types(text: str) -> list[tuple[str, bool]]:
    """(last name, is called) of each type of a comma-separated list; type arguments, call arguments and modifiers don't count."""
    while (less := re.sub(r"<[^<>]*>", "", text)) != text:
        text = less
    parts, level = [""], 0
    for c in text:
        level -= c in ")]}"
        if c == "," and level == 0:
            parts.append("")
        elif level == 0:
            parts[-1] += c
        level += c in "([{"
    out = []
    for part in parts:
        if words := re.findall(_TYPE, re.split(r"\b(?:where|by)\b", part)[0]):
            out.append((re.split(r"[.:\\]+", words[-1])[-1], "(" in part))
    return out


def _parents(kind: str, head: str, language: str) -> Iterator[tuple[str, str]]:
    """(fact, parent) of a declaration's head, the text between its name and its body.

    Where a language has one list for both, a class's called (Kotlin), first
    (Swift, C++ all) or not I-named (C#) parent is extended.
    """
    head = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", head)
    if language in ("javascript", "java", "php"):
        for fact, names in re.findall(r"\b(extends|implements)\s+(.*?)(?=\b(?:extends|implements|permits)\b|$)", head, re.S):
            for name, _ in _types(names):
                yield fact, name
        return
    if language not in ("kotlin", "csharp", "swift", "cpp") or (kind == "enum" and language in ("csharp", "cpp")):
        return
    lead = re.match(r"\s*(?:(?:private|protected|internal|public)?\s*constructor\s*)?(?=\()", head)
    if lead:
        level = 0
        for i in range(lead.end(), len(head)):
            level += {"(": 1, ")": -1}.get(head[i], 0)
            if level == 0:
                head = head[i + 1 :]
                break
    if ":" not in head:
        return
    for i, (name, called) in enumerate(_types(head.split(":", 1)[1])):
        faces = {"kotlin": not called, "csharp": re.match(r"I[A-Z]", name) is not None, "swift": i > 0, "cpp": False}[language]
        yield ("extends" if kind in ("interface", "protocol") or (kind not in ("struct", "enum") and not faces) or language == "cpp" else "implements"), name


def _variables(clean: str, at: int) -> Iterator[str]:
    """Names that the declarators from ``at`` on bind, patterns included, up to the end of the statement."""
    depth, angle, start, value, last = 0, 0, at, False, ""

    def bound(part: str) -> list[str]:
        part = part.strip()
        if part[:1] not in ("{", "["):
            return re.findall(r"^[\w$]+", part)
        return re.findall(r"(?<![\w$])([^\W\d][\w$]*)(?!\w|\s*:)", re.sub(r"=[^,}\]]*", "", part))

    for i in range(at, len(clean) + 1):
        c = clean[i] if i < len(clean) else ";"
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "<" and re.match(r"[\w\[{]", clean[i + 1 : i + 2]):
            angle += 1
        elif c == ">" and clean[i - 1] not in "=-" and angle:
            angle -= 1
        over = c == ";" or depth < 0 or (c == "\n" and last not in ",=+-*/&|>?:" and re.compile(r"\s*(?![\s,=.?:])").match(clean, i) is not None)
        last = c if c.strip() else last
        if depth <= 0 and (over or (not angle and (c == "," or (c == "=" and not value)))):
            if not value:
                yield from bound(clean[start:i])
            value, start = c == "=", i + 1
            if over:
                return


_EXPORTED = re.compile(r"^[ \t]*export\s+(?:(default)\b|(?:declare\s+)?(?:abstract\s+|async\s+|const\s+(?=enum))*(?:function\s*\*?|class|interface|type|enum|namespace)\s+(?!\{)([\w$]+)|(?:declare\s+)?(?:const|let|var)\s+(?=\S)|(?:type\s+)?\{([^}]*)\}|\*\s*as\s+([\w$]+))", re.M)


def _exports(clean: str, language: str, symbols: list[tuple]) -> Iterator[tuple[str, int]]:
    """(name, offset) of what a file offers to others.

    JavaScript: export statements. Rust: top-level pub items. Go: the package
    and top-level names in capitals. Others: the package and all declared symbols.
    """
    if language == "javascript":
        for m in _EXPORTED.finditer(clean):
            if m[3] is not None:
                names = [re.sub(r"^type\s+(?=\w)(?!as\b)", "", x.strip()) for x in m[3].split(",")]
                yield from ((re.split(r"\s+as\s+", x)[-1], m.start()) for x in names if x)
            elif name := m[1] or m[2] or m[4]:
                yield name, m.start()
            else:
                yield from ((x, m.start()) for x in _variables(clean, m.end()))
        return
    if language == "rust":
        yield from ((m[1], m.start()) for m in re.finditer(r"^pub\s+(?:(?:async|const|unsafe)\s+)*(?:fn|struct|enum|trait|type|const|static)\s+(?:mut\s+)?(\w+)", clean, re.M))
        return
    if m := re.search(r"^[ \t]*package\s+([\w.]+)", clean, re.M) if language in ("go", "java", "kotlin") else None:
        yield f"package:{m[1]}", m.start()
    if language == "go":
        yield from ((m[1], m.start()) for m in re.finditer(r"^(?:func|type|const|var)\s+([^\W\d_]\w*)", clean, re.M) if m[1][0].isupper())
    else:
        yield from symbols


def brace_facts(path: str, text: str, language: str = "javascript") -> list[tuple]:
    """Facts of one file of a brace language: declared symbols with their line spans, imports, exports, parents and references.

    A reference is any word outside comments and strings, or inside an
    interpolation, that isn't reserved everywhere; readers join it with the symbols.
    """
    clean, out, declared = _blank(text, language), [], []
    breaks = [m.start() for m in re.finditer("\n", text)]
    at_line = lambda at: bisect_right(breaks, at - 1) + 1
    for m in _DECLARED.finditer(clean):
        start = clean.count("\n", 0, m.start(1)) + 1
        at, level, end = clean.find("{", m.end()), 0, m.end()
        stop = clean.find(";", m.end())
        if at >= 0 and (stop < 0 or at < stop):
            for k in re.finditer(r"[{}]", clean[at:]):
                level += 1 if k[0] == "{" else -1
                if level == 0:
                    end = at + k.end()
                    break
            else:
                out.append((path, "warning", "partial_parse", None, start, start))
        out.append((path, "symbol", m[2], _KIND.get(m[1], m[1]), start, clean.count("\n", 0, end) + 1))
        declared.append((m[2], m.start(1)))
        if m[1] in ("class", "interface", "struct", "enum", "protocol", "object"):
            body = _HEAD_END.search(clean, m.end())
            out += [(path, fact, m[2], name, start, start) for fact, name in _parents(m[1], clean[m.end() : body.start()], language)]
    if language == "rust":
        for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl\b\s*(?:<(?:[^<>]|<[^<>]*>)*>)?\s*!?([\w:]+)(?:<[^{;]*?>)?\s+for\s+&?(?:'\w+\s+)?(?:mut\s+)?([\w:]+)", clean, re.M):
            out.append((path, "implements", m[2].split("::")[-1], m[1].split("::")[-1], at_line(m.start(2)), at_line(m.start(2))))
    for m in _IMPORT.finditer(text):
        if clean[m.start() : m.end()].strip():
            line = text.count("\n", 0, m.start()) + 1
            out.append((path, "import", next(x for x in m.groups() if x), None, line, line))
    offered = {(name, at_line(at)) for name, at in _exports(clean, language, declared)}
    out += [(path, "export", name, None, line, line) for name, line in sorted(offered, key=lambda x: (x[1], x[0]))]
    used = {(m[0], at_line(m.start())) for m in _WORD.finditer(clean)}
    if inside := _INSIDE.get(language):
        for m in _BRACE.finditer(text):
            if m[0][0] == "`" if language == "javascript" else m[0][0] == '"' and (language != "csharp" or "$" in text[max(0, m.start() - 2) : m.start()]):
                for k in re.finditer(inside, m[0]):
                    used |= {(w, at_line(m.start() + k.start())) for w in _WORD.findall(_blank(k[k.lastindex or 0]))}
    out += [(path, "reference", name, None, line, line) for name, line in sorted(used, key=lambda x: (x[1], x[0])) if name not in _RESERVED]
    return out


def python_facts(path: str, text: str) -> list[tuple]:
    """Facts of one Python file; a line scan of its imports where it doesn't parse."""
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError):
        found = re.finditer(r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", text, re.M)
        rows = [(path, "import", m[1] or m[2], None, text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.start()) + 1) for m in found]
        return [*rows, (path, "warning", "parse_error", None, 1, 1)]
    out = []
    for node in ast.walk(module):
        if isinstance(node, ast.ClassDef):
            out.append((path, "symbol", node.name, "class", node.lineno, node.end_lineno))
            out += [(path, "extends", node.name, ast.unparse(b), node.lineno, node.lineno) for b in node.bases]
            out += [(path, "symbol", f.name, "method", f.lineno, f.end_lineno) for f in node.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)]
        elif isinstance(node, ast.Import):
            out += [(path, "import", a.name, None, node.lineno, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append((path, "import", "." * node.level + (node.module or ""), None, node.lineno, node.lineno))
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            out.append((path, "reference", node.id, None, node.lineno, node.lineno))
    out += [(path, "symbol", f.name, "function", f.lineno, f.end_lineno) for f in module.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)]
    own = [f for f in module.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    out += [(path, "export", f.name, None, f.lineno, f.lineno) for f in own if not f.name.startswith("_")]
    return sorted(set(out), key=lambda r: (r[4], r[1], r[2], str(r[3])))


_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script>", re.S | re.I)


def component_facts(path: str, text: str) -> list[tuple]:
    """Facts of the script blocks of a single-file component, with lines of the whole file."""
    out = []
    for m in _SCRIPT.finditer(text):
        shift = text.count("\n", 0, m.start(1))
        out += [(*r[:4], r[4] + shift, r[5] + shift) for r in brace_facts(path, m[1])]
    return out


EXTRACTORS = {"python": python_facts, "sfc": component_facts} | {x: functools.partial(brace_facts, language=x) for x in ("javascript", "rust", "go", "java", "kotlin", "csharp", "php", "swift", "c", "cpp")}


def code_facts(files: DataFrame) -> DataFrame:
    """ROW facts of files (path, language, content); other languages and null contents give none."""
    names = [x.split()[0] for x in ROW.split(", ")]
    types = [pa.int32() if x.endswith("int") else pa.string() for x in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lang, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content is not None and lang in EXTRACTORS:
                    rows += EXTRACTORS[lang](path, content)
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.select("path", "language", "content").mapInArrow(run, ROW)


def channels(files: DataFrame) -> DataFrame:
    """(path, line, fact, channel, callback): the first emit and the first on of each line, in files of any language."""
    rows = each_line(files)
    sent = rows.select("path", "line", F.lit("emit").alias("fact"), F.regexp_extract("text", r"""\.emit\(\s*['"]([^'"]+)['"]""", 1).alias("channel"), F.lit("").alias("callback"))
    heard = r"""\.on\(\s*['"]([^'"]+)['"]\s*,\s*([\w.]*)"""
    got = rows.select("path", "line", F.lit("on").alias("fact"), F.regexp_extract("text", heard, 1).alias("channel"), F.regexp_extract("text", heard, 2).alias("callback"))
    return sent.unionByName(got).where("channel <> ''")
