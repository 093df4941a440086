"""The registered queries of the corpus operators: thin applications to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, html_text, jaccard, line_dedup, nearest, phrases, pii, quality, spelling, token_counts, token_files, url_filter
from .common import fresh_path, small_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.edits")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode_and_decode(docs, ranks, offsets=False)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    is_kind = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    out = quality.classify(docs, table(spark, sf_dir, "labels"), with_text=False)
    return out.select("doc_id", "evidence", "host_posterior", "path_posterior", "p_good", "keep")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_documents(spark, path, with_ids=False)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    named = (op1_decontamination, op2_token_counts, op3_byte_bpe, op4_nearest, op5_url_filter, op6_personal_data, op7_jaccard_join, op8_html_text, op9_line_dedup, op10_quality, op11_token_files, op12_collocations, op13_spelling_variants)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op9_line_dedup": OP9_SQL, "op12_collocations": OP12_SQL, "op13_spelling_variants": OP13_SQL}


_LOW_URL = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _alternatives(value) -> str:
    """``value(weight)`` of each term that stands between boundaries, as an SQL sum; terms are letters, digits and hyphens."""
    return " + ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {value(w)} ELSE 0 END" for t, w in url_filter.default_vocabulary().items())


OP5_SQL = f"""
WITH parts AS (
 SELECT page_id, url,
  CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
  CAST({_alternatives(lambda w: int(w >= 1))} AS BIGINT) AS n_strict, CAST({_alternatives(lambda w: int(w < 1))} AS BIGINT) AS n_soft, round(CAST({_alternatives(lambda w: w)} AS DOUBLE), 6) AS weight
 FROM (SELECT *, {_LOW_URL} AS low FROM pages)),
ruled AS (
 SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
 FROM parts)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
 CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN n_strict >= 1 OR weight >= {url_filter.LIMIT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft, weight
FROM ruled"""

_TRIMMED = "trim(line, chr(32) || chr(9) || chr(13))"

OP9_SQL = f"""
WITH parts AS (
 SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
spread AS (
 SELECT {_TRIMMED} AS key, min(struct_pack(d := doc_id, p := pos)) AS head FROM parts WHERE {_TRIMMED} <> ''
 GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.SITES}),
marked AS (
 SELECT doc_id, line, pos, head IS NOT NULL AND head <> struct_pack(d := doc_id, p := pos) AS gone
 FROM parts LEFT JOIN spread ON {_TRIMMED} = key)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM documents d LEFT JOIN (
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept
 FROM marked GROUP BY doc_id) m ON d.doc_id = m.doc_id"""


#: DuckDB measures edits in bytes, so the 64 letters of two bytes become ASCII signs that no word holds.
_OF_TWO_BYTES = "".join(map(chr, range(0xC0, 0x100)))
_AS_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and chr(c) != "'")[:64]

#: The CRC of a text by its published table, whose entries follow from the polynomial; words with a variant of one deletion in common are candidates.
OP13_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (
 SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (
 SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
said AS (
 SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
 FROM runs WHERE length(run) >= {spelling.LEAST_LETTERS} GROUP BY doc_id, run),
summed AS (
 SELECT run, k, xor(list_reduce(list_concat([4294967295], list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda j: CAST('0x' || substr(x, CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) AS h FROM said, crc),
words AS MATERIALIZED (
 SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % {spelling.LOSES_ONE_IN} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, k FROM summed)
 WHERE length(word) >= {spelling.LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {spelling.LEAST_COUNT}),
shorter AS (
 SELECT DISTINCT word, n, v FROM (
  SELECT word, n, word AS v FROM words UNION ALL
  SELECT word, n, substr(word, 1, CAST(i AS BIGINT)) || substr(word, CAST(i + 2 AS BIGINT)) FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words))),
near AS (
 SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b USING (v) WHERE a.word <> b.word AND levenshtein(translate(a.word, '{_OF_TWO_BYTES}', '{_AS_SIGNS}'), translate(b.word, '{_OF_TWO_BYTES}', '{_AS_SIGNS}')) = 1),
best AS MATERIALIZED (
 SELECT word, count(*) AS n_near, min(struct_pack(less := -other_n, form := other)) AS b, any_value(n) AS n FROM near GROUP BY word),
forms AS MATERIALIZED (
 SELECT word, b.form AS form, -b.less AS form_n FROM best WHERE -b.less >= {spelling.TIMES} * n),
walk AS (
 SELECT word, form AS reached, 1 AS k FROM forms UNION ALL SELECT w.word, f.form, k + 1 FROM walk w JOIN forms f ON w.reached = f.word)
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN (SELECT word, arg_max(reached, k) AS root FROM walk GROUP BY word) r USING (word)"""

#: Counts of all phrases by lists of words; every candidate is held against all longer candidates that hold its words in a row.
OP12_SQL = f"""
WITH pieces AS (
 SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (
 SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
counts AS MATERIALIZED (
 SELECT lang, size, phrase, count(*) AS f FROM (
  SELECT lang, size, unnest(list_transform(range(CAST(len(w) - size + 1 AS BIGINT)), lambda i: array_to_string(w[CAST(i + 1 AS BIGINT):CAST(i + size AS BIGINT)], ' '))) AS phrase
  FROM worded, (SELECT unnest(range(1, {phrases.MAX_WORDS + 1})) AS size) WHERE len(w) >= size)
 GROUP BY ALL),
totals AS (
 SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
frequent AS MATERIALIZED (
 SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= {phrases.LEAST_COUNT}),
inner_parts AS MATERIALIZED (
 SELECT lang, f, array_to_string(w[i:CAST(i + part - 1 AS BIGINT)], ' ') AS phrase FROM frequent, (SELECT unnest(range(2, {phrases.MAX_WORDS})) AS part), (SELECT unnest(range(1, {phrases.MAX_WORDS})) AS i) WHERE part < size AND i + part - 1 <= size),
absorbed AS MATERIALIZED (
 SELECT DISTINCT c.lang, c.phrase FROM frequent c JOIN inner_parts p ON c.lang = p.lang AND c.phrase = p.phrase WHERE {phrases.ABSORBS[1]} * CAST(p.f AS HUGEINT) >= {phrases.ABSORBS[0]} * CAST(c.f AS HUGEINT)),
parted AS MATERIALIZED (
 SELECT lang, phrase, f, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[CAST(k + 1 AS BIGINT):], ' ') AS tail FROM frequent, (SELECT unnest(range(1, {phrases.MAX_WORDS})) AS k) WHERE k < size),
cuts AS MATERIALIZED (
 SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, ({phrases.SCALE} * CAST(c.f AS HUGEINT)) // (l.f + r.f) AS score
 FROM parted c JOIN frequent l ON l.lang = c.lang AND l.phrase = c.head JOIN frequent r ON r.lang = c.lang AND r.phrase = c.tail),
lowest AS (
 SELECT lang, phrase, any_value(a) AS a, min(struct_pack(score := score, k := k, l := l, r := r)) AS cut FROM cuts ANTI JOIN absorbed USING (lang, phrase) GROUP BY lang, phrase),
ranked AS (
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank, phrase, a, cut.l AS l, cut.r AS r, CAST(cut.score AS BIGINT) AS score FROM lowest)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {phrases.LIMIT}"""
