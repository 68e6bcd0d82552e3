"""Prefix and BM25 search over identifier tokens and texts, and names that hold others or are spelt alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import identifier_tokens, query_prefixes
from graphloom.storage import Scratch

#: Published BM25 constants.
K1, B = 1.2, 0.75


def token_table(symbols: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """(key, token): lower-case tokens of each name."""
    return symbols.select(key, F.explode(F.transform(identifier_tokens(F.col(name)), F.lower)).alias("token"))


def term_counts(rows: DataFrame, key: str, token: str = "token") -> DataFrame:
    """(key, token, tf, length) from one row per occurrence."""
    counts = rows.groupBy(key, token).agg(F.count("*").alias("tf"))
    lengths = counts.groupBy(key).agg(F.sum("tf").alias("length"))
    return counts.join(lengths, key)


def bm25(rows: DataFrame, key: str, prefixes: list[str]) -> DataFrame:
    """(key, score): BM25 of the documents that hold a token with any of the prefixes.

    rows is one row per token occurrence; each prefix counts as one term. The
    corpus statistics come from all rows, the candidates from matching ones.
    """
    totals = rows.groupBy(key).agg(F.count("*").alias("length"))
    stats = totals.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
    terms = F.array(*[F.struct(F.lit(p).alias("term")) for p in prefixes])
    hits = rows.select(key, F.explode(F.filter(terms, lambda t: F.col("token").startswith(t["term"]))).alias("t")).groupBy(key, F.col("t.term").alias("term")).agg(F.count("*").alias("tf"))
    return bm25_scores(hits.join(totals, key).crossJoin(F.broadcast(stats)), key, F.col("n_docs"), F.col("avg_length"))


def bm25_scores(hits: DataFrame, key: str, n_docs: Column, avg_length: Column) -> DataFrame:
    """(key, score) from a row (key, term, tf, length) per document and term; a term's document frequency is the number of its rows."""
    joined = hits.join(hits.groupBy("term").agg(F.count("*").alias("df")), "term")
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / avg_length))
    return joined.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def search(symbols: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best symbols (id, name, file_path, score) for a query, best first; none for a query without words."""
    prefixes = query_prefixes(query)
    if not prefixes:
        return symbols.select("id", "name", "file_path", F.lit(0.0).alias("score")).limit(0)
    scored = bm25(token_table(symbols), "id", prefixes)
    return symbols.select("id", "name", "file_path").join(scored, "id").orderBy(F.col("score").desc(), "name", "file_path", "id").limit(limit)


def exact(symbols: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Symbols whose name is or contains the query, in any case: equal names first, then short ones."""
    hit = (F.col("name") == query) | F.lower("name").contains(query.lower())
    return symbols.where(hit).orderBy((F.col("name") == query).desc(), F.length("name"), "id").limit(limit)


#: Characters of the grams by which names are found, and of those by which spellings are.
GRAM, SPELT = 3, 2


def grams(text: Column, n: int) -> Column:
    """The n-character substrings in their order; none of a shorter text."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda k: text.substr(k, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def holding(names: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id) of names (id, name) that hold an asked string, in any case of A-Z; an empty string is held by none.

    Each asked string looks among the names with its rarest gram of GRAM
    characters, or as many as it has; candidates meet by that gram alone.
    """
    own = asked.select("asked", F.lower("asked").alias("low")).where("low <> ''").distinct()
    size = F.least(F.length("low"), F.lit(GRAM))
    of_size = lambda column: F.coalesce(*(F.when(size == n, grams(column, n)) for n in range(1, GRAM + 1)))
    wanted = own.select("asked", "low", F.explode(F.array_distinct(of_size(F.col("low")))).alias("gram"))
    low = F.lower("name")
    every = names.select("id", low.alias("text"), F.explode(F.array_distinct(F.concat(*(grams(low, n) for n in range(1, GRAM + 1))))).alias("gram"))
    met = every.join(wanted.select("gram").distinct(), "gram", "left_semi")
    counts = met.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("asked", "low").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return met.join(rarest, "gram").where(F.col("text").contains(F.col("low"))).select("asked", "id")


def _rare_grams(words: DataFrame, frequency: DataFrame, most: int) -> DataFrame:
    """(word, gram): the first ``most`` numbered grams of each word, rare ones first."""
    by_word = Window.partitionBy("word").orderBy("n", "gram")
    return words.join(frequency, "gram").withColumn("place", F.row_number().over(by_word)).where(F.col("place") <= most).select("word", "gram")


def _numbered_grams(words: DataFrame) -> DataFrame:
    """(word, gram): each gram with the number of times it stood in the word before, so that repeats count."""
    each = words.select("word", F.posexplode(grams(F.col("word"), SPELT)).alias("at", "gram"))
    number = F.row_number().over(Window.partitionBy("word", "gram").orderBy("at"))
    return each.select("word", F.concat_ws("#", "gram", number.cast("string")).alias("gram"))


def _shortened(word: Column, most: int) -> Column:
    """The word, and what is left of it without up to ``most`` characters."""
    done = last = F.array(word)
    for _ in range(most):
        without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(w.substr(F.lit(1), k - 1), w.substr(k + 1, F.length(w))))
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda w: F.length(w) > 0), without)))
        done = F.concat(done, last)
    return F.array_distinct(done)


def spelt_alike(names: DataFrame, asked: DataFrame, distance: int = 2) -> DataFrame:
    """(asked, name, distance) of distinct names (name) that at most ``distance`` changed, added or left out characters make of an asked one; case counts.

    Exact: of two words with over SPELT * distance grams each, one that is among
    the SPELT * distance + 1 rarest of both must be shared, as a change touches
    SPELT of them; of shorter ones, a rest without ``distance`` characters must.
    What meets there is measured.
    """
    scratch = Scratch(names.sparkSession, "spelt")
    a = scratch.keep(names.select(F.col("name").alias("word")).where("word is not null").distinct(), "names")
    b = scratch.keep(asked.select(F.col("asked").alias("word")).where("word is not null").distinct(), "asked")
    most = SPELT * distance + 1
    long_ = most + SPELT - 1
    of_names = scratch.keep(_numbered_grams(a.where(F.length("word") >= long_)), "grams")
    of_asked = _numbered_grams(b.where(F.length("word") >= long_))
    frequency = of_names.groupBy("gram").agg(F.count("*").alias("n"))
    # Grams of asked words that no name has can't be shared, but take their places among the rarest.
    all_of_asked = of_asked.select("gram").distinct().join(frequency, "gram", "left").select("gram", F.coalesce("n", F.lit(0)).alias("n"))
    by_gram = _rare_grams(of_names, frequency, most).withColumnRenamed("word", "name").join(_rare_grams(of_asked, all_of_asked, most).withColumnRenamed("word", "asked"), "gram").select("asked", "name")
    short = lambda words: words.where(F.length("word") < long_ + distance).select("word", F.explode(_shortened(F.col("word"), distance)).alias("rest"))
    by_rest = short(a).withColumnRenamed("word", "name").join(short(b).withColumnRenamed("word", "asked"), "rest").select("asked", "name")
    near = by_gram.unionByName(by_rest).where(F.abs(F.length("asked") - F.length("name")) <= distance).distinct()
    return near.withColumn("distance", F.levenshtein("asked", "name", distance)).where("distance >= 0")
