"""Code told from comments and from strings over several lines, as column expressions.

A text is cut into tokens by one pattern a language, leftmost first, so that a
quote in a comment opens nothing and a comment sign in a string neither. All
groups are possessive: a token costs time in proportion to its length, and no
stack, however long it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, LINE, HASH, DASH = r"/\*[\s\S]*?(?:\*/|\z)", r"//[^\n]*+", r"#[^\n]*+", r"--[^\n]*+"
DOUBLE, SINGLE = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?', r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
LONG_DOUBLE, LONG_SINGLE = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?', r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'?"
TRIPLE_DOUBLE, TRIPLE_SINGLE = r'"""(?:[^"\\]|\\[\s\S]|""?(?!"))*+(?:""")?', r"'''(?:[^'\\]|\\[\s\S]|''?(?!'))*+(?:''')?"
RAW_TRIPLE = r'"""[\s\S]*?(?:"""|\z)'
# Expressions in a template hold plain text and templates without expressions.
TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$\{[^{}`]*+(?:`[^`]*+`[^{}`]*+)*+\}|\$)*+`?"
BACKTICK = r"`[^`]*+`?"
CHARACTER = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,9})'"
# A slash after one of these can't divide.
REGEX = r"(?<=[(,=:\[!&|?{};][ \t]{0,4})/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/"
VERBATIM = r'(?<=@|@\$)"(?:[^"]|"")*+"?'
RAW_HASHES = r'(?<=\br)(#*+)"[\s\S]*?(?:"\1|\z)'


@dataclass(frozen=True)
class Lexis:
    """Tokens of a language in the order in which they are tried, what comments start with, and all first characters."""

    tokens: tuple[str, ...]
    comments: str
    first: str

    @property
    def pattern(self) -> str:
        return "|".join((*self.tokens, f"[^{self.first}]++", r"[\s\S]"))


LEXES = {
    "javascript": Lexis((BLOCK, LINE, TEMPLATE, DOUBLE, SINGLE, REGEX), "/[*/]", "/`\"'"),
    "python": Lexis((HASH, TRIPLE_DOUBLE, TRIPLE_SINGLE, DOUBLE, SINGLE), "#", "#\"'"),
    "java": Lexis((BLOCK, LINE, RAW_TRIPLE, DOUBLE, CHARACTER), "/[*/]", "/\"'"),
    "csharp": Lexis((BLOCK, LINE, RAW_TRIPLE, VERBATIM, DOUBLE, CHARACTER), "/[*/]", "/\"'"),
    "go": Lexis((BLOCK, LINE, BACKTICK, DOUBLE, CHARACTER), "/[*/]", "/`\"'"),
    "rust": Lexis((BLOCK, LINE, RAW_HASHES, LONG_DOUBLE, CHARACTER), "/[*/]", "/\"'#"),
    "php": Lexis((BLOCK, LINE, r"#\[", HASH, LONG_DOUBLE, LONG_SINGLE), r"/[*/]|#(?!\[)", "/\"'#"),
    "sql": Lexis((BLOCK, DASH, r"'[^']*+'?", r'"[^"\n]*+"?'), r"/\*|--", "-/\"'"),
    "graphql": Lexis((HASH, RAW_TRIPLE, DOUBLE), "#", "#\""),
    "prisma": Lexis((LINE, DOUBLE), "//", '/"'),
    "dockerfile": Lexis((r"(?m:^)[ \t]*+#[^\n]*+", r"[^\n#][^\n]*+"), r"[ \t]*#", r"#\n"),
}
LEXES |= {"kotlin": LEXES["java"], "swift": LEXES["java"], "c": LEXES["java"], "cpp": LEXES["java"], "typescript": LEXES["javascript"]}


def _code(text: Column, lexis: Lexis, comments: bool) -> Column:
    long = rf"^[{lexis.first}][^\n]*\n"
    blank = F.lit(long if comments else rf"^(?:{lexis.comments})|{long}")

    def shown(token: Column) -> Column:
        return F.when(F.regexp_like(token, blank), F.regexp_replace(token, r"[^\n]", " ")).otherwise(token)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(lexis.pattern), F.lit(0)), shown), "")


def code_text(text: Column, language: str | Column, comments: bool = False) -> Column:
    """``text`` with blanks for comments and for strings over several lines; all lines and columns stay where they are.

    Strings that end on their line stay, as routes and names stand in them, and
    with ``comments`` so do comments of one line. Texts of unknown languages
    stay as they are, null stays null. Comments within comments end at the
    first end.
    """
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    if isinstance(language, str):
        return _code(text, LEXES[language], comments) if language in LEXES else text
    out = text
    for lexis in dict.fromkeys(LEXES.values()):
        out = F.when(language.isin(*(name for name, x in LEXES.items() if x == lexis)), _code(text, lexis, comments)).otherwise(out)
    return out


def net_braces(text: Column) -> Column:
    """Braces that a line of code opens, less those it closes; those in strings don't count."""
    bare = F.regexp_replace(text, f"{DOUBLE}|{SINGLE}|{BACKTICK}", "")
    return F.length(F.regexp_replace(bare, r"[^{]", "")) - F.length(F.regexp_replace(bare, "[^}]", ""))
