"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, langid, linededup, packing, quality, secretscan, simhash, substring, trees, urlfilter, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h FROM p),
f AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h) AS first FROM h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (((
    (strpos('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 + (5 * i) // 4, 1)) - 1)
    >> (3 - (5 * i) % 4)) & 31))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NULL AND first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    verdict = docs.select("doc_id", quality.apply_rules(docs).alias("q"))
    return verdict.select("doc_id", *[f"q.{m}" for m in quality.MEASURES], "q.base_failed", "q.kept")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tok AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT rid, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g FROM tok WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
rw AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT x) AS dups
       FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(ln.dups, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(ln.n, 0) AS n_lines,
        len(list_filter(ws, lambda x: NOT regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_letterless,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
      FROM w LEFT JOIN ln USING (rid) LEFT JOIN rw USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
       OR 5 * n_letterless > n_words OR n_upper > n_lower) AS kept
FROM b
"""


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.fit(docs.where(remainder != 2), key=F.col("doc_id"))
    found = docs.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), langid.predicted(docs, model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secretscan.fit(secretscan.example_frame(spark))
    found = secretscan.redacted(secretscan.scan(_table(spark, sf_dir, "documents"), model))
    return found.select("doc_id", "nth", "length", "score", "is_secret", "finding_sha256")


URL_RULES = [
    urlfilter.Rule("org", "/", allow=True),
    urlfilter.Rule("example.org", "/es/", allow=False),
    urlfilter.Rule("example.org", "/en/1", allow=False),
    urlfilter.Rule("com", "/fr/", allow=True),
    urlfilter.Rule("com", "/de/", allow=False),
]


@cache
def _url_model() -> urlfilter.UrlModel:
    return urlfilter.train(urlfilter.example_labels())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES, _url_model())
    return found.select("page_id", "host", "path", "rule", "verdict")


def _op7_sql() -> str:
    model = _url_model()
    shares = " ".join(f"WHEN '{k}' THEN {v:.6f}e0" for k, v in model.shares.items())
    longest_first = sorted(URL_RULES, key=lambda r: -len(r.text))
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in longest_first]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.text}'" for f, r in fits) + " END"
    verdict = " ".join(f"WHEN {f} THEN '{'allow' if r.allow else 'block'}'" for f, r in fits)
    features = [*urlfilter.FEATURES[:-1], "suffix_share"]
    return rf"""
WITH r AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT page_id, host, path, length(url)::DOUBLE AS length, (length(path) - length(replace(path, '/', '')))::DOUBLE AS depth,
        CASE WHEN url = '' THEN 0e0 ELSE round(length(regexp_replace(url, '[^0-9]', '', 'g')) / length(url)::DOUBLE, 6) END AS digit_ratio,
        CASE WHEN host = '' THEN 0e0 ELSE round(-list_sum(list_transform(list_distinct(string_split(host, '')), lambda c:
          (length(host) - length(replace(host, c, ''))) / length(host)::DOUBLE * log2((length(host) - length(replace(host, c, ''))) / length(host)::DOUBLE))), 6) END AS entropy,
        (length(regexp_extract(url, '\?([^#]*)', 1)) - length(replace(regexp_extract(url, '\?([^#]*)', 1), '=', '')))::DOUBLE AS params,
        (length(host) - length(replace(host, '-', '')))::DOUBLE AS hyphens, (length(host) - length(replace(host, '.', '')) + 1)::DOUBLE AS labels,
        list_max(list_transform(string_split(host, '.'), lambda x: length(x)))::DOUBLE AS longest_label,
        CASE string_split(host, '.')[-1] {shares} ELSE {model.prior:.6f}e0 END AS suffix_share FROM h)
SELECT page_id, host, path, {rule} AS rule,
  CASE {verdict} WHEN {trees.total_sql(model.trees, features)} > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH f AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, f),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, f),
win AS (SELECT item_id, 10 AS n, array_to_string(ws[k:k + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 8)) AS k FROM b WHERE len(ws) >= 10)
        UNION SELECT item_id, len(ws), array_to_string(ws, ' ') FROM b WHERE len(ws) BETWEEN 1 AND 9),
tok AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
nxt AS (SELECT rid, i, list(x) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM tok),
occ AS (SELECT rid, i, n, item_id FROM (SELECT rid, i, n, array_to_string(g[1:n], ' ') AS g FROM nxt, (SELECT DISTINCT n FROM win) WHERE len(g) >= n) JOIN win USING (n, g)),
hit AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id)::BIGINT AS n, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM occ GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.deduplicated(_table(spark, sf_dir, "documents"), counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
x AS (SELECT *, string_split(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM l),
y AS (SELECT *, len(w) AS n, row_number() OVER (ORDER BY doc_id, pos) AS o FROM x WHERE w != ['']),
u AS (SELECT w, n, min(o) AS o FROM y WHERE n >= 3 GROUP BY w, n),
c AS (SELECT a.w AS a, b.w AS b FROM u a JOIN u b ON a.w[1:4] = b.w[1:4] AND abs(a.n - b.n) <= 1 AND b.o < a.o WHERE a.n >= 8 AND b.n >= 8
      UNION SELECT a.w, b.w FROM u a JOIN u b ON a.w[-4:] = b.w[-4:] AND abs(a.n - b.n) <= 1 AND b.o < a.o WHERE a.n >= 8 AND b.n >= 8),
p AS (SELECT a, b, least(len(a), len(b)) AS m,
        list_max(list_filter(range(0, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS p,
        list_max(list_filter(range(0, least(len(a), len(b)) + 1), lambda i: list_reverse(a)[1:i] = list_reverse(b)[1:i])) AS s FROM c),
near AS (SELECT DISTINCT a AS w FROM p WHERE greatest(len(a), len(b)) - p - least(s, m - p) <= 1),
gone AS (SELECT y.doc_id, y.pos FROM y JOIN u USING (w) LEFT JOIN near USING (w) WHERE y.o > u.o OR near.w IS NOT NULL),
r AS (SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(gone.pos)::BIGINT AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS t
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(t) END AS text_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_substring": op3_substring,
    "op4_quality": op4_quality,
    "op5_langid": op5_langid,
    "op6_secret_scan": op6_secret_scan,
    "op7_url_filter": op7_url_filter,
    "op8_decontaminate": op8_decontaminate,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
}

def sql() -> dict[str, str]:
    """DuckDB SQL by query; learned languages, fingerprints and token ids have none."""
    return {"op2_warc": OP2_SQL, "op4_quality": OP4_SQL, "op7_url_filter": _op7_sql(), "op8_decontaminate": OP8_SQL, "op10_line_dedup": OP10_SQL}
