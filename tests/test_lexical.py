"""Code by patterns against a scanner that reads one character after the other."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.lexical import code_text, net_braces
from graphloom.sources import declared, extract


def scanned(text: str, language: str) -> str:
    """Code of JavaScript (without pattern literals), Python or SQL, read by characters."""
    python, out, at = language == "python", [], 0
    quotes = {"javascript": "\"'`", "python": "\"'", "sql": ""}[language]
    while at < len(text):
        start, sign, comment = at, text[at], False
        if python and sign == "#" or language == "javascript" and text[at : at + 2] == "//" or language == "sql" and text[at : at + 2] == "--":
            comment = True
            while at < len(text) and text[at] != "\n":
                at += 1
        elif not python and text[at : at + 2] == "/*":
            comment, end = True, text.find("*/", at + 2)
            at = len(text) if end < 0 else end + 2
        elif language == "sql" and sign == "'":
            end = text.find("'", at + 1)
            at = len(text) if end < 0 else end + 1
        elif sign in quotes:
            close = sign * 3 if python and text[at : at + 3] == sign * 3 else sign
            at += len(close)
            while at < len(text):
                if text[at] == "\\" and at + 1 < len(text):
                    at += 2
                elif text[at] == "\\":
                    break
                elif text[at : at + len(close)] == close:
                    at += len(close)
                    break
                elif text[at] == "\n" and len(close) == 1 and sign != "`":
                    break
                else:
                    at += 1
        else:
            at += 1
        token = text[start:at]
        out.append("".join(c if c == "\n" else " " for c in token) if comment or len(token) > 1 and "\n" in token else token)
    return "".join(out)


@pytest.mark.parametrize("language, parts", [("javascript", ["//", "/*", "*/", '"', "'", "`", "\\", "\n", "a", " ", "\U0001f600"]), ("python", ["#", '"""', "'''", '"', "'", "\\", "\n", "a", " ", "é"]), ("sql", ["--", "/*", "*/", "'", "\n", "a", "-", "/"])])
def test_code_equals_a_scan_by_characters(spark, language, parts):
    rng = random.Random(7)
    texts = ["", "\n", *("".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(1500))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", code_text(F.col("text"), language).alias("code"))
    got = {r.id: r.code for r in rows.collect()}
    wrong = [(t, got[k], scanned(t, language)) for k, t in enumerate(texts) if got[k] != scanned(t, language)]
    assert not wrong, wrong[:3]


def test_very_long_tokens_nulls_and_unknown_languages(spark):
    long = '"' + "\\n" * 300_000 + '" + `' + "${a}x\n" * 100_000 + "` // " + "y" * 100_000
    rows = spark.createDataFrame([(0, "javascript", long), (1, "python", None), (2, "other", "# x")], "id int, language string, text string")
    got = {r.id: r.code for r in rows.select("id", code_text(F.col("text"), F.col("language")).alias("code")).collect()}
    assert len(got[0]) == len(long) and got[0].strip().endswith("+") and got[1] is None and got[2] == "# x"


CASES = [
    ("javascript", "a = /[\"'/]/; // x\nb", "a = /[\"'/]/;     \nb"),
    ("javascript", "a = b / c / d // e", "a = b / c / d     "),
    ("javascript", "`a${`b//`}\n` + c", "          \n  + c"),
    ("rust", "fn f<'a>(x: &'a str) { r#\"a\" //\n\"#; '\"' } // z", "fn f<'a>(x: &'a str) { r       \n  ; '\"' }     "),
    ("csharp", '@"a""\n//" + x // y', '@    \n    + x     '),
    ("java", 'x = """\n@Get("/no")\n"""; y', "x =    \n           \n   ; y"),
    ("php", "#[Route('/a')]\n# c\n$x = 'a\nb';", "#[Route('/a')]\n   \n$x =   \n  ;"),
    ("go", "a := `//\n` // b", "a :=    \n      "),
    ("dockerfile", "FROM a#b\n  # COPY x y", "FROM a#b\n            "),
]


@pytest.mark.parametrize("language, text, code", CASES)
def test_tokens_of_languages(spark, language, text, code):
    row = spark.createDataFrame([(text,)], "text string")
    assert row.select(code_text(F.col("text"), language).alias("code")).first().code == code


def test_braces_of_code(spark):
    rows = spark.createDataFrame([(0, 'a { "{" }} {{'), (1, "'}' {"), (2, "")], "id int, text string")
    assert [r.n for r in rows.orderBy("id").select(net_braces(F.col("text")).alias("n")).collect()] == [1, 1, 0]


def test_scanners_read_code_only(spark):
    files = [
        ("a.ts", "javascript", "import { create } from 'zustand'\n/*\nexport const old = create()\n*/\nconst help = `\nexport const told = create()\n`\nexport const real = create<S>() // const x = create()"),
        ("b.py", "python", 'from pydantic import BaseModel\n"""\nclass Doc(BaseModel):\n"""\nclass Real(BaseModel):\n    pass\n@app.task\n# said\ndef work():\n    pass'),
        ("c.rs", "rust", 'let s = "\nstatic FAKE: u8 = 1;\n";\n/* static GONE: u8 = 1;\n*/ pub static LIVE: u8 = 1;'),
        ("d.go", "go", "var t = `\nvar no = make(chan int)\n`\nyes := make(chan int)"),
        ("E.java", "java", "import jakarta.persistence.Entity;\n/*\n@Entity\n*/\nclass No {}\n@Entity\n// a note\nclass Yes {}"),
    ]
    found = declared.declarations(spark.createDataFrame(files, "path string, language string, content string"))
    assert sorted((r.path, r.name, r.line) for r in found.collect()) == [("E.java", "Yes", 6), ("a.ts", "real", 8), ("b.py", "Real", 5), ("b.py", "work", 7), ("c.rs", "LIVE", 5), ("d.go", "yes", 4)]
    own = lambda text: spark.createDataFrame([("f", text)], "path string, content string")
    assert [r.route for r in extract.router_calls(own("/*\napp.get('/no', x)\n*/\napp.get('/a', x) // app.get('/b', y)\nconst s = `\napp.get('/c')\n`")).collect()] == ["/a"]
    assert [r.route for r in extract.decorated_routes(own('"""\n@app.get("/no")\n"""\n@app.get("/a")\n# def gone(): \ndef f(): pass')).collect()] == ["/a"]
    assert [(r.route, r.handler) for r in declared.go_routes(own('/*\ne.GET("/no", x)\n*/\n// @router /r [get]\nfunc F() {}\nvar s = `\n// @router /s [get]\n`\nfunc G() {}')).collect()] == [("/r", "F")]
    assert [r.route for r in declared.nested_routes(own('routing {\n  log("}")\n  /* }\n */\n  get("/a") { }\n}')).collect()] == ["/a"]
    assert [(r.fact, r.name) for r in extract.sql_facts(own("-- create table a\n/* create table b\n*/\ncreate table c (x int)")).collect()] == [("export", "c")]
