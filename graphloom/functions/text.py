"""Lines, signatures, snippets, identifier tokens and token costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token where no tokenizer is at hand.
CHARS_PER_TOKEN = 3.7
#: Dollars of a million input tokens.
USD_PER_MILLION = 3.0


def lines(text: Column) -> Column:
    """Lines without breaks; a break at the end opens no line, and \\r\\n counts as \\n."""
    text = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n\z", "")
    return F.split(text, "\n")


def numbered(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (1-based), each after its right-aligned number."""
    own = lines(text)
    low, high = F.greatest(first, F.lit(1)), F.least(last, F.size(own))
    row = lambda k: F.concat(F.lpad(k.cast("string"), 4, " "), F.lit(": "), F.element_at(own, k))
    return F.when(low <= high, F.array_join(F.transform(F.sequence(low, high), row), "\n")).otherwise("")


def signature(text: Column, first: Column, last: Column, most: int = 6) -> Column:
    """The lines of a declaration up to the one that opens its body, brace stripped; at most ``most`` lines.

    Only the text up to the last of these lines is split.
    """
    head = F.call_function("substring_index", text, F.lit("\n"), F.greatest(first + most - 1, F.lit(1)).cast("int"))
    own = lines(F.when(F.length(head) < F.length(text), F.concat(head, F.lit("\n"))).otherwise(head))
    span = F.least(F.least(last, F.size(own)) - first + 1, F.lit(most))
    span = F.greatest(span, F.lit(1))
    head = F.slice(own, F.greatest(first, F.lit(1)), span)
    opens = F.transform(head, lambda x: F.rtrim(x).rlike(r"(\{|:|=>|;)$"))
    at = F.array_position(opens, F.lit(True)).cast("int")
    kept = F.slice(head, F.lit(1), F.when(at > 0, at).otherwise(F.size(head)))
    return F.when((first >= 1) & (first <= F.size(own)), F.regexp_replace(F.array_join(kept, "\n"), r"[{\s]+\z", "")).otherwise("")


def snippet(text: Column, query: str) -> Column:
    """The first line that holds the query, in any case, with its neighbours; else the first lines."""
    own = lines(text)
    hits = F.transform(own, lambda x: F.lower(x).contains(query.lower()))
    at = F.greatest(F.array_position(hits, F.lit(True)).cast("int"), F.lit(1))
    low, high = F.greatest(at - 1, F.lit(1)), F.least(at + 1, F.size(own))
    return F.array_join(F.slice(own, low, high - low + 1), "\n")


def identifier_tokens(name: Column) -> Column:
    """The name, then its words by separators, case changes and acronym ends, without one-byte words or repeats."""
    spaced = F.regexp_replace(name, r"[_\-.$ ]+", " ")
    spaced = F.regexp_replace(spaced, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", " ")
    spaced = F.regexp_replace(spaced, r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    parts = F.filter(F.split(spaced, " "), lambda x: F.octet_length(x) > 1)
    every = F.concat(F.array(name), parts)

    def step(done: Column, x: Column) -> Column:
        known = F.exists(done, lambda y: F.lower(y) == F.lower(x))
        return F.when(known, done).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(every, F.array().cast("array<string>"), step)


def query_prefixes(query: str) -> list[str]:
    """The lower-case prefixes that a search for the query looks for."""
    import re

    out: list[str] = []
    for word in re.sub(r"[^\w]", " ", query).split():
        spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", re.sub(r"[_\-.$ ]+", " ", word))
        for token in [word, *spaced.split()]:
            token = token.strip("_").lower()
            if len(token) > 1 and token not in out:
                out.append(token)
    return out


def token_estimate(text: Column) -> Column:
    return F.round(F.char_length(text) / CHARS_PER_TOKEN).cast("long")


def cost_usd(tokens: Column) -> Column:
    return tokens * USD_PER_MILLION / 1_000_000


def http_method(name: Column) -> Column:
    """The first method, in fixed order, that the route's name contains; GET if none."""
    upper, out = F.upper(name), F.lit("GET")
    for method in ("HEAD", "OPTIONS", "DELETE", "PATCH", "PUT", "POST", "GET"):
        out = F.when(upper.contains(method), method).otherwise(out)
    return out
