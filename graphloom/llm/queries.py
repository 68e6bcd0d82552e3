"""Thin queries over the given tables, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import chat, decontaminate, lm, media, minhash, pieces, pii, quality, resample, runs, secrets, token_counts, urls
from graphloom.storage import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def _op1_sql() -> str:
    """The rules, the counts of each order, the interpolation and the threshold, in SQL."""
    rules = sorted(urls.RULES, key=lambda r: -len(r.text))
    fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in rules]
    allowed = ", ".join(f"'{r.text}'" for r in rules if r.allow)
    ctes = [
        rf"""base AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)""",
        rf"""parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM base)""",
        f"""ruled AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM parts)""",
        f"""judged AS (SELECT *, CASE WHEN rule IS NOT NULL THEN rule IN ({allowed}) END AS allow, CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % {urls.CALIBRATION} = 0 AS held FROM ruled)""",
        "links AS (SELECT url, count(*) AS n, any_value(allow) AS allow, any_value(held) AS held FROM judged GROUP BY url)",
        rf"""texts AS (SELECT *, regexp_replace(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9\-._~:/?#\[\]@!$&''()*+,;=%]', '{urls.OTHER}', 'g') AS t FROM links)""",
        f"""items AS (SELECT url, n, allow, held, unnest(list_transform(range(1, length(t) + 1), lambda k: substr('{urls.START * (urls.ORDER - 1)}' || t, k, {urls.ORDER}))) AS gram FROM texts)""",
        "wanted AS (SELECT DISTINCT gram FROM items)",
        "counted AS (SELECT gram, allow, sum(n) AS n FROM items WHERE allow IS NOT NULL AND NOT held GROUP BY gram, allow)",
    ]
    for side, allow in (("good", "allow"), ("bad", "NOT allow")):
        before = f"SELECT gram, CAST({1 / (len(urls.ALPHABET) + 1)!r} AS DOUBLE) AS p FROM wanted"
        for order in range(1, urls.ORDER + 1):
            ctes += [
                f"c_{side}_{order} AS (SELECT right(gram, {order}) AS tail, CAST(sum(n) AS DOUBLE) AS c FROM counted WHERE {allow} GROUP BY 1)",
                f"k_{side}_{order} AS (SELECT left(tail, {order - 1}) AS context, sum(c) AS total, CAST(count(*) AS DOUBLE) AS kinds FROM c_{side}_{order} GROUP BY 1)",
                f"""p_{side}_{order} AS (SELECT b.gram, CASE WHEN k.total IS NULL THEN b.p ELSE (coalesce(c.c, 0) + k.kinds * b.p) / (k.total + k.kinds) END AS p
                FROM ({before}) b LEFT JOIN c_{side}_{order} c ON right(b.gram, {order}) = c.tail LEFT JOIN k_{side}_{order} k ON left(right(b.gram, {order}), {order - 1}) = k.context)""",
            ]
            before = f"SELECT gram, p FROM p_{side}_{order}"
    ctes += [
        f"ratios AS (SELECT g.gram, ln(g.p) - ln(b.p) AS ratio FROM p_good_{urls.ORDER} g JOIN p_bad_{urls.ORDER} b USING (gram))",
        f"scores AS (SELECT l.url, l.allow, l.held, s.score FROM links l LEFT JOIN (SELECT url, round(avg(ratio), {urls.DECIMALS}) AS score FROM items JOIN ratios USING (gram) GROUP BY url) s ON l.url IS NOT DISTINCT FROM s.url)",
        f"steps AS (SELECT CAST(floor(score * {urls.STEPS}) AS BIGINT) AS step, count(*) FILTER (allow) AS good, count(*) FILTER (NOT allow) AS bad FROM scores WHERE held AND allow IS NOT NULL AND score IS NOT NULL GROUP BY 1)",
        """gains AS (SELECT step, coalesce(CAST(floor((lag(step) OVER (ORDER BY step) + step + 1) / 2.0) AS BIGINT), step) AS middle, (sum(good) OVER () - coalesce(sum(good) OVER w, 0)) * sum(bad) OVER () + coalesce(sum(bad) OVER w, 0) * sum(good) OVER () AS gain FROM steps
        WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        "cut AS (SELECT middle AS step FROM gains ORDER BY gain DESC, gains.step LIMIT 1)",
    ]
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
SELECT j.page_id, j.host, j.path, j.rule, CASE WHEN coalesce(j.allow, CAST(floor(s.score * {urls.STEPS}) AS BIGINT) >= (SELECT step FROM cut), false) THEN 'allow' ELSE 'block' END AS verdict, s.score
FROM judged j LEFT JOIN scores s ON j.url IS NOT DISTINCT FROM s.url"""
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), per=85, cent=100)


OP2_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM split
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN low USING (doc_id)
"""

PROBE = "</s>[INST] ok [/INST]"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(probe)))


def _op3_sql() -> str:
    marks = lambda x: f"length({x}) - length(replace({x}, chr(92), ''))" + "".join(f" + (length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in chat.CONTROL)
    frame = len("<|turn|>") + 1 + len("<|end|>") + 1
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum({frame} + length(r) + length(t) + ({marks('r')}) + ({marks('t')}) + (length(r) - length(replace(r, chr(10), '')))) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(sum(len(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS BIGINT) AS n_tokens
FROM turns GROUP BY conv_id
"""


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def media_page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.page_sequences(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digest(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOKENS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: Every stretch of every diagonal of equal tokens, judged by the rule itself.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), i AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d), it AS (SELECT item_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS q FROM i),
diagonals AS (SELECT doc_id, item_id, p - q AS shift, least({decontaminate.MIN_EQUAL}, any_value(n)) AS least_equal, list(q ORDER BY q) AS places FROM dt JOIN it USING (x) GROUP BY 1, 2, 3 HAVING count(*) >= least({decontaminate.MIN_EQUAL}, any_value(n))),
ends AS (SELECT *, unnest(range(1, len(places) + 1)) AS b FROM diagonals),
stretches AS (SELECT *, unnest(range(1, b + 1)) AS a FROM ends),
accepted AS (SELECT doc_id, item_id, places[a] + shift AS doc_start, places[a] AS item_start, places[b] - places[a] + 1 AS n_tokens, b - a + 1 AS n_equal FROM stretches
  WHERE b - a + 1 >= least_equal AND b - a + 1 >= CAST({decontaminate.MIN_SHARE} AS DECIMAL(4, 3)) * (places[b] - places[a] + 1))
SELECT doc_id, item_id, doc_start, item_start, n_tokens, n_equal FROM accepted QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, doc_start, item_start) = 1
"""


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.extract(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(runs.periodic_tails(table(spark, sf_dir, "documents")))


def _crc32_sql(data: str) -> str:
    """The CRC32 of a blob: bit by bit over its bytes, -1 standing for a shift."""
    items = f"flatten(list_transform(range(1, length(hex({data})), 2), lambda k: [CAST('0x' || substr(hex({data}), k, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {items}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"


#: Equal windows of half a shortest run, at each distance in a text, in stretches; of stretches as long as their distance, the smallest distance.
OP12_SQL = rf"""
WITH base AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w0, {_crc32_sql("encode(CAST(doc_id AS VARCHAR))")} AS h FROM documents
), sized AS (SELECT doc_id, w0, len(w0) AS n, h, h // 10 AS g FROM base), tails AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM sized),
texts AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w0[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE w0 END AS w FROM tails),
grams AS (SELECT doc_id, unnest(range(n - {runs.MIN_LENGTH // 2 - 1})) AS i, unnest(list_transform(range(1, n - {runs.MIN_LENGTH // 2 - 2}), lambda k: array_to_string(w[k:k + {runs.MIN_LENGTH // 2 - 1}], ' '))) AS x FROM texts WHERE n >= {runs.MIN_LENGTH}),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
parts AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pairs),
equal AS (SELECT doc_id, q, min(i) AS s, max(i) + {runs.MIN_LENGTH // 2} - min(i) AS m FROM parts GROUP BY doc_id, q, part),
found AS (SELECT doc_id, s AS start, m + q AS length, min(q) AS period FROM equal WHERE m >= q AND m + q >= {runs.MIN_LENGTH} GROUP BY 1, 2, 3),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text, max({{'l': length, 's': -start, 'p': -period}}) AS best,
  list_distinct(flatten(list(range(start + period, start + length)))) AS gone FROM found GROUP BY doc_id),
gone AS (SELECT doc_id, unnest(gone) AS i FROM lines), words AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS x FROM texts),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(-best.p AS BIGINT) AS period,
  CAST(1000 * best.l // -best.p AS BIGINT) AS exponent_milli, sha256(coalesce(l.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN lines l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_RESAMPLED = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_RESAMPLED} AS w FROM documents), words AS (SELECT doc_id, unnest(w) AS x FROM d), aims AS (SELECT unnest({_RESAMPLED}) AS x FROM benchmark),
kinds AS (SELECT x, {_crc32_sql("encode(x)")} % {resample.BUCKETS} AS bucket FROM (SELECT x FROM words UNION SELECT x FROM aims)),
source AS (SELECT bucket, count(*) AS s FROM words JOIN kinds USING (x) GROUP BY bucket), target AS (SELECT bucket, count(*) AS t FROM aims JOIN kinds USING (x) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM words) + {resample.BUCKETS}) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM aims) + {resample.BUCKETS})))) AS BIGINT) AS gain FROM source LEFT JOIN target USING (bucket)),
sums AS (SELECT doc_id, sum(gain) AS total FROM words JOIN kinds USING (x) JOIN gains USING (bucket) GROUP BY doc_id),
weights AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(floor(total / CAST(len(w) AS DOUBLE)), 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN sums USING (doc_id)),
scores AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, n_features >= {resample.MIN_WORDS} AS able FROM weights),
ranks AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {resample.PERCENT} * n // 100 THEN place END AS rank FROM ranks
"""

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_media_columns": op4_media_columns,
    "op5_sentencepiece": op5_sentencepiece,
    "media_page_sequences": media_page_sequences,
    "op6_secret_scans": op6_secret_scans,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_counts": op10_token_counts,
    "op11_pii": op11_pii,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES = {
    "op1_url_filters": _op1_sql(),
    "op2_minhash_near_dedup": OP2_SQL,
    "op3_chat_formatting": _op3_sql(),
    "op7_decontamination": OP7_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
