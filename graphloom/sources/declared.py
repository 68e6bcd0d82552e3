"""State stores, schemas, event channels and Go routes that source lines declare, as column expressions.

A file's lines are exploded once, with the libraries that the file mentions;
every rule is a pattern over one line, and what spans lines (an annotation and
the class after it, a struct and its tags) is a window over the file's lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.lexical import code_text, net_braces
from graphloom.functions.text import lines
from graphloom.storage import Scratch

STATE, SCHEMA, CHANNEL, ROUTE = "state_store", "database_schema", "event_channel", "route"


@dataclass(frozen=True)
class Rule:
    """The name that ``pattern`` finds in a line of a language, in files that mention one of ``mentions``."""

    language: str
    kind: str
    pattern: str
    mentions: tuple[str, ...] = ()


def _bound(*calls: str) -> str:
    """NAME = call( or call<, with or without a type after the name."""
    return r"([\w$]+)\s*(?::[^=]*)?=\s*(?:" + "|".join(c.replace(".", r"\.") for c in calls) + r")\s*[(<]"


def _argument(*calls: str) -> str:
    """The string that a call gets first."""
    return r"(?:" + "|".join(c.replace(".", r"\.") for c in calls) + r""")\s*\(\s*["'`]([^"'`]+)["'`]"""


# Factories and libraries that tell state, schemas and channels.
RULES = (
    Rule("javascript", STATE, _bound("create"), ("zustand",)),
    Rule("javascript", STATE, _bound("createStore"), ("zustand", "vuex", "redux")),
    Rule("javascript", STATE, _bound("createSlice", "configureStore"), ("redux",)),
    Rule("javascript", STATE, _bound("createContext"), ("react",)),
    Rule("javascript", STATE, _bound("defineStore"), ("pinia",)),
    Rule("javascript", STATE, _bound("makeAutoObservable", "observable"), ("mobx",)),
    Rule("javascript", STATE, _bound("atom"), ("recoil", "jotai")),
    Rule("javascript", STATE, _bound("selector"), ("recoil",)),
    Rule("javascript", SCHEMA, _bound("pgTable", "mysqlTable", "sqliteTable"), ("drizzle-orm",)),
    Rule("javascript", SCHEMA, _bound("z.object", "z.discriminatedUnion", "z.record", "z.enum"), ("zod", "z.object", "z.record")),
    Rule("javascript", SCHEMA, _argument(".define"), ("sequelize",)),
    Rule("javascript", SCHEMA, _argument(r"\bmodel"), ("mongoose",)),
    Rule("javascript", SCHEMA, _bound("Schema"), ("mongoose",)),
    Rule("javascript", ROUTE, r"^\s*([\w$]+)\s*:.*Procedure\.(?:query|mutation|subscription)", ("trpc",)),
    Rule("javascript", CHANNEL, _bound("Subject", "BehaviorSubject", "ReplaySubject"), ("rxjs",)),
    Rule("javascript", CHANNEL, _argument(".emit", ".on", ".once", ".addListener"), ("EventEmitter", "events", "socket.io")),
    Rule("javascript", CHANNEL, _argument(".publish", ".subscribe", ".psubscribe"), ("redis",)),
    Rule("javascript", CHANNEL, r"""[tT]opic[^"'`]*["'`]([^"'`]+)["'`]""", ("kafka",)),
    Rule("python", STATE, _bound("Celery", "Redis", "StrictRedis")),
    Rule("python", SCHEMA, r"^\s*class\s+(\w+)\s*\([^)]*(?:Base|models\.Model|SQLModel)", ("sqlalchemy", "SQLModel", "django", "models.Model", "pydantic", "BaseModel")),
    Rule("python", CHANNEL, _argument(".publish", ".subscribe", ".psubscribe"), ("redis",)),
    Rule("python", CHANNEL, r"""[tT]opic[^"']*["']([^"']+)["']""", ("kafka",)),
    Rule("rust", STATE, r"^\s*(?:pub\s+)?static\s+(?:ref\s+)?([A-Z][\w]*)"),
    Rule("rust", STATE, r"^\s*let\s+\(?\s*(?:mut\s+)?(\w+)\s*[^=]*=\s*[^\"'\s].*(?:mpsc|broadcast|watch)::(?:unbounded_)?channel"),
    Rule("rust", STATE, r"^\s*let\s+\(\s*(?:mut\s+)?\w+\s*,\s*(?:mut\s+)?(\w+)\s*\)[^=]*=\s*[^\"'\s].*(?:mpsc|broadcast|watch)::(?:unbounded_)?channel"),
    Rule("rust", STATE, r"^\s*let\s+\(?\s*(?:mut\s+)?(\w+)\s*[^=]*=\s*(?:mpsc|broadcast|watch)::(?:unbounded_)?channel"),
    Rule("rust", STATE, r"^\s*let\s+\(\s*(?:mut\s+)?\w+\s*,\s*(?:mut\s+)?(\w+)\s*\)[^=]*=\s*(?:mpsc|broadcast|watch)::(?:unbounded_)?channel"),
    Rule("rust", SCHEMA, r"^\s*table!\s*\{\s*(\w+)", ("diesel",)),
    Rule("go", STATE, r"^\s*(?:var\s+)?(\w+)[^=]*:?=\s*make\(chan\s"),
    Rule("csharp", SCHEMA, r"DbSet<\s*(\w+)", ("EntityFrameworkCore", "DbContext")),
    Rule("php", SCHEMA, r"^\s*(?:final\s+)?class\s+(\w+)\s+extends\s+Model\b", ("Illuminate\\Database", "Eloquent")),
)
# Annotations that tell a schema, and the declaration that must follow.
ANNOTATED = (
    Rule("javascript", SCHEMA, r"^\s*@(?:View)?Entity\b", ("typeorm",)),
    Rule("java", SCHEMA, r"^\s*@Entity\b", ("javax.persistence", "jakarta.persistence")),
    Rule("kotlin", SCHEMA, r"^\s*@Entity\b", ("javax.persistence", "jakarta.persistence")),
    Rule("php", SCHEMA, r"^\s*@ORM\\Entity\b", ("Doctrine",)),
    Rule("rust", SCHEMA, r"^\s*#\[derive\(.*(?:Queryable|Insertable)", ("diesel",)),
    Rule("rust", SCHEMA, r"^\s*#\[derive\(.*DeriveEntityModel", ("sea_orm",)),
    Rule("rust", SCHEMA, r"^\s*#\[derive\(.*FromRow", ("sqlx",)),
    Rule("python", STATE, r"^\s*@(?:shared_task\b|.*\.task\b)"),
)
DECLARED = r"^\s*(?:export\s+|public\s+|final\s+|pub\s+|abstract\s+|data\s+|async\s+)*(?:class|struct|def)\s+(\w+)"


def _mentioned(rule: Rule) -> Column:
    own = F.col("language") == rule.language
    return own & F.arrays_overlap("mentions", F.array(*map(F.lit, rule.mentions))) if rule.mentions else own


def _lines(files: DataFrame) -> DataFrame:
    """path, language, mentions, line (from 1) and code of files (path, language, content)."""
    words = F.array(*(F.lit(w) for w in sorted({w for r in (*RULES, *ANNOTATED) for w in r.mentions} | {"gorm"})))
    said = files.where("content is not null").select("path", "language", "content", F.filter(words, lambda w: F.col("content").contains(w)).alias("mentions"))
    each = said.select("path", "language", "mentions", F.posexplode(lines(code_text(F.col("content"), F.col("language")))).alias("at", "text"))
    return each.select("path", "language", "mentions", (F.col("at") + 1).cast("int").alias("line"), "text")


def declarations(files: DataFrame) -> DataFrame:
    """(path, kind, name, line): what files (path, language, content) declare, each name once, at its first line.

    Comments and strings over several lines declare nothing. A null content has no lines.
    """
    rows = _lines(files)
    # A line meets the rules of its language only.
    found = F.lit(None)
    for language in dict.fromkeys(r.language for r in RULES):
        own = [F.struct(F.lit(r.kind).alias("kind"), F.when(_mentioned(r), F.regexp_extract("text", r.pattern, 1)).alias("name")) for r in RULES if r.language == language]
        found = F.when(F.col("language") == language, F.array(*own)).otherwise(found)
    spoken = F.trim("text") != ""
    kind = F.lit(None).cast("string")
    for r in ANNOTATED:
        kind = F.when(_mentioned(r) & F.col("text").rlike(r.pattern), r.kind).otherwise(kind)
    annotated = F.col("language").isin(*{r.language for r in ANNOTATED})
    gorm = (F.col("language") == "go") & F.array_contains("mentions", "gorm")
    told = {
        "found": F.when(spoken, F.filter(found, lambda x: x["name"] != "")),
        "mark": F.when(annotated, kind),
        "bare": annotated & ~F.col("text").rlike(r"^\s*[@#]") & spoken,
        "declared": F.when(annotated, F.nullif(F.regexp_extract("text", DECLARED, 1), F.lit(""))),
        "tag": gorm & (F.col("text").contains("gorm.Model") | F.col("text").contains('gorm:"')),
        "close": gorm & F.col("text").rlike(r"^\s*\}"),
        "struct": F.when(gorm, F.nullif(F.regexp_extract("text", r"^\s*type\s+(\w+)\s+struct", 1), F.lit(""))),
    }
    # Texts are cut once; what rules and windows need of a line is stored, and lines that tell nothing are left out.
    rows = rows.select("path", "line", *(c.alias(name) for name, c in told.items())).where("size(found) > 0 or mark is not null or bare or declared is not null or tag or close or struct is not null")
    rows = Scratch(files.sparkSession, "declared").keep(rows, "lines")
    plain = rows.select("path", "line", F.explode("found").alias("x")).select("path", "line", "x.*")

    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("path").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    # An annotation counts for the next declaration if only annotations stand between.
    marked = rows.where("mark is not null or bare or declared is not null").select("path", "line", "mark", "bare", "declared")
    marked = marked.withColumns({"last_mark": F.last(F.when(F.col("mark").isNotNull(), F.struct("line", "mark")), True).over(before), "last_bare": F.coalesce(F.last(F.when(F.col("bare"), F.col("line")), True).over(before), F.lit(0))})
    named = marked.where(F.col("last_mark.line") > F.col("last_bare")).select("path", F.col("last_mark.line").alias("line"), F.col("last_mark.mark").alias("kind"), F.col("declared").alias("name"))

    structs = rows.where("tag or close or struct is not null").select("path", "line", "tag", "close", "struct")
    structs = structs.withColumns({"next_tag": F.min(F.when(F.col("tag"), F.col("line"))).over(after), "next_close": F.min(F.when(F.col("close"), F.col("line"))).over(after)})
    structs = structs.where("next_tag is not null and (next_close is null or next_tag < next_close)").select("path", "line", F.lit(SCHEMA).alias("kind"), F.col("struct").alias("name"))

    every = plain.unionByName(named).unionByName(structs).where("name <> ''")
    return every.groupBy("path", "name").agg(F.min(F.struct("line", "kind")).alias("x")).select("path", "x.kind", "name", "x.line")


def apply_declarations(symbols: DataFrame, found: DataFrame) -> DataFrame:
    """Symbols (path, name, kind, start_line, end_line) with the kinds that declarations give; names without a symbol get one of one line.

    Of symbols with the same name in a file, the first by line is told.
    """
    first = symbols.groupBy("path", "name").agg(F.min(F.struct("start_line", "end_line", "kind")).alias("f")).select("path", "name", "f.*", F.lit(True).alias("told"))
    told = first.join(found.select("path", "name", F.col("kind").alias("new_kind"), "line"), ["path", "name"])
    kept = symbols.join(told, ["path", "name", "start_line", "end_line", "kind"], "left")
    kept = kept.select("path", "name", F.coalesce("new_kind", "kind").alias("kind"), "start_line", "end_line")
    fresh = found.join(symbols.select("path", "name"), ["path", "name"], "left_anti")
    return kept.unionByName(fresh.select("path", "name", "kind", F.col("line").alias("start_line"), F.col("line").alias("end_line")))


def missing_handlers(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols (path, name, kind, start_line, end_line) of one line for handlers of routes (path, handler, line) that no symbol of their file has."""
    named = routes.where("handler <> ''").groupBy("path", F.col("handler").alias("name")).agg(F.min("line").alias("start_line"))
    fresh = named.join(symbols.select("path", "name"), ["path", "name"], "left_anti")
    return fresh.select("path", "name", F.lit("function").alias("kind"), "start_line", F.col("start_line").alias("end_line"))


# Registration methods of Go routers.
GO_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "Any", "Get", "Post", "Put", "Delete", "Patch", "Head", "Options", "All")


def go_routes(files: DataFrame) -> DataFrame:
    """(path, route, handler, line): router calls with the prefix of their group, and @router comments with the next func.

    A group is known from its line on; the last one of a name counts. A comment
    counts if only comments and blank lines stand before the func.
    """
    both = F.arrays_zip(lines(code_text(F.col("content"), "go")).alias("text"), lines(code_text(F.col("content"), "go", comments=True)).alias("raw"))
    rows = files.where("content is not null").select("path", F.posexplode(both).alias("at", "x")).select("path", (F.col("at") + 1).cast("int").alias("line"), "x.text", "x.raw")
    group = r'^\s*(\w+)\s*:=\s*.*\.Group\(\s*"([^"]*)"'
    call = r'(\w+)\.(?:' + "|".join(GO_METHODS) + r')\(\s*"([^"]*)"(?:\s*,\s*([\w.]+))?'
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    part = lambda pattern, k: F.regexp_extract("text", pattern, k)
    told = {
        "call": F.when(F.col("text").rlike(call), F.struct(part(call, 1).alias("receiver"), part(call, 2).alias("route"), part(call, 3).alias("handler"))),
        "made": F.when(F.col("text").rlike(group), F.struct(part(group, 1).alias("receiver"), F.struct(F.col("line").alias("group_line"), part(group, 2).alias("prefix")).alias("g"))),
        "said": F.regexp_extract("raw", r"^\s*//\s*@router\s+(/\S*)", 1),
        "code": F.trim("text") != "",
        "func": part(r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)", 1),
    }
    # Texts are cut once; what is asked of a line is stored, and lines that tell nothing are left out.
    rows = Scratch(files.sparkSession, "go").keep(rows.select("path", "line", *(c.alias(name) for name, c in told.items())).where("said <> '' or code"), "lines")
    calls = rows.where("call is not null").select("path", "line", "call.*")
    groups = rows.where("made is not null").select("path", "made.*")
    known = calls.join(groups, ["path", "receiver"], "left").where("g is null or g.group_line < line")
    known = known.groupBy("path", "line", "receiver", "route", "handler").agg(F.max("g").alias("g"))
    # A receiver whose groups all stand below the call has none yet.
    alone = calls.join(known, ["path", "line", "receiver", "route", "handler"], "left_anti").withColumn("g", F.lit(None).cast("struct<group_line: int, prefix: string>"))
    direct = known.unionByName(alone).select("path", F.concat(F.coalesce("g.prefix", F.lit("")), "route").alias("route"), "handler", "line")
    marked = rows.select("path", "line", "said", "code", "func").withColumns({"mark": F.last(F.when(F.col("said") != "", F.struct("line", F.col("said").alias("route"))), True).over(before), "last_code": F.coalesce(F.last(F.when(F.col("code"), F.col("line")), True).over(before), F.lit(0))})
    noted = marked.where(F.col("mark.line") > F.col("last_code")).select("path", F.col("mark.route").alias("route"), F.col("func").alias("handler"), F.col("mark.line").alias("line")).where("handler <> ''")
    return direct.unionByName(noted)


#: Lines of a file that are met at once; each step copies what is found among them.
PAGE = 256


def nested_routes(files: DataFrame) -> DataFrame:
    """(path, route, line): Kotlin calls such as get("/x") inside a ``routing {`` block, after the prefixes of the route("/y") { blocks around them.

    A file's lines are met in order inside its row, so nothing is shuffled or
    sorted. At each depth stands the block that was opened there last: whether
    it is inside of a routing block, and the prefixes around it. Braces are
    taken to be balanced.
    """

    def told(text: Column, at: Column) -> Column:
        text = F.trim(text)
        prefix = F.when(text.endswith("{"), F.regexp_extract(text, r"""(?<![A-Za-z0-9])route\(\s*["']([^"']*)["']""", 1)).otherwise("")
        route = F.regexp_extract(text, r"""(?<![A-Za-z0-9])(?:get|post|put|delete|patch|head|options)\(\s*["'](/[^"']*)["']""", 1)
        return F.struct((at + 1).cast("int").alias("line"), net_braces(text).alias("net"), text.rlike(r"(^|\s)routing \{").alias("routing"), prefix.alias("prefix"), route.alias("route"))

    def met(seen: Column, x: Column) -> Column:
        around = F.get(seen["around"], seen["depth"] - 1)
        inside = F.coalesce(around["inside"], F.lit(False))
        # What a line opens after its first block has neither a prefix nor routing of its own; below depth 0 nothing counts.
        own = seen["depth"] >= 0
        block = F.struct((inside | (own & x["routing"])).alias("inside"), F.when(inside, F.concat(around["prefix"], x["prefix"])).otherwise("").alias("prefix"))
        level = F.greatest(seen["depth"], F.lit(0))
        opened = F.concat(F.slice(seen["around"], F.lit(1), level), F.array_repeat(block, seen["depth"] + x["net"] - level))
        found = F.struct(F.concat(around["prefix"], x["route"]).alias("route"), x["line"].alias("line"))
        return F.struct(
            (seen["depth"] + x["net"]).alias("depth"),
            F.when(x["net"] > 0, opened).otherwise(seen["around"]).alias("around"),
            F.when(inside & (x["route"] != ""), F.array_append(seen["found"], found)).otherwise(seen["found"]).alias("found"),
        )

    def page_met(seen: Column, page: Column) -> Column:
        began = F.struct(seen["depth"], seen["around"], empty.alias("found"))
        return F.aggregate(page, began, met, lambda x: F.struct(x["depth"], x["around"], F.array_append(seen["pages"], x["found"]).alias("pages")))

    def paged(each: Column) -> Column:
        last = F.floor(F.greatest(F.size(each) - 1, F.lit(0)) / PAGE).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(each, k * PAGE + 1, F.lit(PAGE)))

    each = F.filter(F.transform(lines(code_text(F.col("content"), "kotlin")), told), lambda x: (x["net"] != 0) | (x["route"] != ""))
    empty = F.array().cast("array<struct<route: string, line: int>>")
    none = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<inside: boolean, prefix: string>>").alias("around"), F.array().cast("array<array<struct<route: string, line: int>>>").alias("pages"))
    every = F.aggregate(F.flatten(F.transform(F.array(each), paged)), none, page_met, lambda seen: F.flatten(seen["pages"]))
    return files.where("content is not null").select("path", F.explode(every).alias("x")).select("path", "x.*")


# Exports of a route module that answer requests, and those of a module below a routes folder.
VERBS, MODULE_HANDLERS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"), ("loader", "action")


def file_route_handlers(routes: DataFrame, exports: DataFrame, handlers: tuple[str, ...] = VERBS, fallback: str | None = None) -> DataFrame:
    """(path, route, handler) of routes that files serve (path, route), a row for each export (path, name) among ``handlers``.

    Without one, ``fallback`` is the handler if the file exports it, else null.
    Routers of pages and apps bind VERBS; route modules MODULE_HANDLERS with "default".
    Routes and exports are one table of distinct rows, in which an export is a
    bit, so that a task holds or sorts short rows once and joins nothing.
    """
    names = list(dict.fromkeys([*handlers, *([fallback] if fallback else [])]))
    bit = F.lit(0)
    for k, name in enumerate(names):
        bit = F.when(F.col("name") == name, 1 << k).otherwise(bit)
    served = routes.select("path", "route", F.lit(True).alias("served"), F.lit(0).alias("bits"))
    asked = exports.where(F.col("path").isNotNull() & F.col("name").isin(*names)).select("path", F.lit(None).cast("string").alias("route"), F.lit(False).alias("served"), bit.alias("bits"))
    each = served.unionByName(asked).groupBy("path", "route", "served").agg(F.bit_or("bits").alias("bits"))
    each = each.withColumn("bits", F.bit_or("bits").over(Window.partitionBy("path"))).where("served")
    bound = F.filter(F.array(*(F.when(F.col("bits").bitwiseAND(1 << k) != 0, name) for k, name in enumerate(names) if name in handlers)), lambda x: x.isNotNull())
    # A file without handlers has at most the fallback.
    return each.select("path", "route", F.explode(F.when(F.size(bound) > 0, bound).otherwise(F.array(F.when(F.col("bits") != 0, F.lit(fallback).cast("string"))))).alias("handler"))
