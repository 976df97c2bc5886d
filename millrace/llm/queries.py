"""The registered queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, html_text, language, licenses, mixing, near_dups, odd_sketch, personal_data, prefix_trie, quality, resampling, sharding, token_counts
from millrace.session import cut_lineage

QUERIES = {}
ORACLES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dups.grouped(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return language.predict(docs, language.train(docs))


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contained(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", F.round("containment", 6).alias("containment"))


_PLAIN = f"""list_filter(regexp_split_to_array(regexp_replace(translate(text, '{decontamination.UPPER_TEXT}',
    '{decontamination.LOWER_TEXT}'), '[\\x00-\\x08\\x0E-\\x1F!-/:-@\\[-`{{-\\x7F]', '', 'g'), '[ \\t-\\r]+'), lambda x: x <> '')"""
_RUNS = "list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))"
ORACLES["op7_decontamination"] = f"""
WITH q AS (SELECT item_id, w, least(len(w), {decontamination.SHINGLE}) AS k FROM (SELECT item_id, {_PLAIN} AS w FROM benchmark) WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest({_RUNS}) AS g FROM q),
d AS (SELECT DISTINCT doc_id, unnest({_RUNS}) AS g FROM (SELECT doc_id, {_PLAIN} AS w FROM documents), (SELECT DISTINCT k FROM q) WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment
FROM s JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
"""


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.with_copies(_table(spark, folder, "documents"))
    return plan.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


ORACLES["op6_mixing"] = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source) AS k,
  (sum(source_size) OVER ())::BIGINT AS t, (sum(w) OVER ())::BIGINT AS tw FROM w),
p AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_size,
  coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_w FROM o),
f AS (SELECT t - full_size AS free, tw - full_w AS free_w FROM p WHERE (t - full_size)::DOUBLE * w / (tw - full_w) <= 3 * source_size ORDER BY k LIMIT 1),
r AS (SELECT source, source_size, least(free::DOUBLE * w / free_w, (3 * source_size)::DOUBLE) AS target FROM p, f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM r)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN
  ('0x' || substr(md5(doc_id || ':{mixing.SEED}'), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""


#: Shards of 1 MB, so that small tables are split too; the operator's own limit is 64 MB.
SMALL_SHARDS = 1 << 20


@query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.sharded(_table(spark, folder, "documents"), shard_bytes=SMALL_SHARDS)
    return placed.select("doc_id", F.col("shard.name").alias("shard"), "shard.depth", F.col("shard.bytes").alias("n_bytes"))


ORACLES["op3_sharding"] = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
n AS (SELECT depth, h >> (60 - depth) AS node FROM d, range(0, 61) AS r(depth) GROUP BY ALL HAVING sum(n_bytes) <= {SMALL_SHARDS}),
b AS (SELECT doc_id, n_bytes, h, min(depth)::INTEGER AS depth FROM d JOIN n ON n.node = d.h >> (60 - depth) GROUP BY ALL)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard, depth, n_bytes FROM b
"""


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut_lineage(quality.measured(_table(spark, folder, "documents")), "measures")
    return quality.judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scanned(_table(spark, folder, "documents"))
    return found.select("doc_id", "digest", "license_id", F.concat_ws(",", "notices").alias("notices"))


def _canonical(text: str) -> str:
    plain = f"regexp_replace(lower(coalesce({text}, '')), '{licenses.COPYRIGHT_LINE}', ' ', 'g')"
    plain = f"' ' || regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for one, other in licenses.SPELLINGS:
        plain = f"replace({plain}, ' {one.replace(' ', '  ')} ', ' {other.replace(' ', '  ')} ')"
    return f"sha256(trim(replace({plain}, '  ', ' ')))"


def _values(texts: dict[str, list[str]]) -> str:
    rows = [(k, t.replace("'", "''")) for k, many in texts.items() for t in many]
    return "VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in rows)


ORACLES["op9_licenses"] = f"""
WITH l AS (SELECT license_id, {_canonical("t")} AS digest FROM ({_values(licenses.KNOWN)}) AS v(license_id, t)),
n AS (SELECT license_id, {_canonical("t")} AS digest FROM ({_values(licenses.NOTICES)}) AS v(license_id, t)),
d AS (SELECT doc_id, {_canonical("text")} AS digest FROM documents),
m AS (SELECT doc_id, {_canonical("line")} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
f AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM m JOIN n USING (digest) GROUP BY doc_id)
SELECT doc_id, d.digest, l.license_id, coalesce(notices, '') AS notices
FROM d LEFT JOIN (SELECT DISTINCT * FROM l) AS l ON l.digest = d.digest LEFT JOIN f USING (doc_id)
"""


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"))


@query
def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return html_text.main_text(pages, html_text.train(pages))


@query
def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    rows = personal_data.scanned(_table(spark, folder, "documents"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(personal_data.KINDS)]
    digest = F.sha2(personal_data.written(F.col("base")), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, digest, personal_data.written(F.concat("base", "found")).alias("spans"))


@query
def op11_odd_sketch(spark: SparkSession, folder: str) -> DataFrame:
    found = odd_sketch.grouped(_table(spark, folder, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


# every two documents of which neither has more shingles than the other allows, by the shingles they share
ORACLES["op11_odd_sketch"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
  ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, coalesce(len(g), 0)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
h AS (SELECT g, list(doc_id) AS ids FROM e GROUP BY g HAVING count(*) > 1),
p AS (SELECT a, b, count(*) AS shared FROM (SELECT a, unnest(ids) AS b FROM (SELECT unnest(ids) AS a, ids FROM h)) WHERE a < b GROUP BY a, b),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (WITH RECURSIVE t AS (SELECT doc_id AS node, doc_id AS low FROM n
  UNION SELECT l.b, t.low FROM t JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) AS l ON l.a = t.node WHERE t.low < l.b)
  SELECT node, min(low) AS component_id FROM t GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN r ON r.node = n.doc_id
"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB: eight steps of the polynomial for each byte."""
    byte = "list_reduce([xor(c, x) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    each = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, x: xor(c >> 8, {byte})))"


@query
def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


_RUNS = """SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM {table}"""
_PARTS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
ORACLES["op12_resampling"] = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_PARTS} AS w FROM documents),
i AS (SELECT 0 AS k, {_PARTS} AS w FROM benchmark),
fd AS ({_RUNS.format(key="k", table="d")}), fi AS ({_RUNS.format(key="k", table="i")}),
u AS (SELECT g, {_crc32("g")} % 10000 AS b FROM (SELECT g FROM fd UNION SELECT g FROM fi)),
s AS (SELECT b, count(*) AS s FROM fd JOIN u USING (g) GROUP BY b), t AS (SELECT b, count(*) AS t FROM fi JOIN u USING (g) GROUP BY b),
a AS (SELECT (SELECT count(*) FROM fd) AS s_all, (SELECT count(*) FROM fi) AS t_all),
gains AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (b), a),
w AS (SELECT k, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM fd JOIN u USING (g) JOIN gains USING (b) GROUP BY k),
c AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (k)),
r AS (SELECT *, words >= 20 AS able, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND n <= (SELECT 5 * count(*) // 100 FROM c WHERE words >= 20) THEN n END AS rank FROM r
"""


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, folder, "conversations"))


ORACLES["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, list(md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST) AS s,
  list(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT ORDER BY turn NULLS FIRST) AS w FROM conversations GROUP BY conv_id),
c AS (SELECT *, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM t),
b AS (SELECT c.conv_id, list_concat(coalesce(f.s[1:c.h], []), c.s[c.h + 1:]) AS s, list_concat(coalesce(f.w[1:c.h], []), c.w[c.h + 1:]) AS w
  FROM c LEFT JOIN c AS f ON f.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, unnest(range(0, len(s) + 1)) AS depth, s, w FROM b),
n AS (SELECT s[1:depth] AS node, any_value(depth) AS depth, any_value(CASE WHEN depth = 0 THEN 0 ELSE w[depth] END) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE depth = len(s)), '')) AS ends_sha256 FROM m GROUP BY s[1:depth]),
k AS (SELECT node[1:len(node) - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY node[1:len(node) - 1]),
x AS (SELECT n.*, coalesce(n_children, 0)::BIGINT AS n_children FROM n LEFT JOIN k USING (node)),
a AS (SELECT node[1:d] AS node, sum((n_children = 0)::INTEGER)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM x) GROUP BY node[1:d])
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM x JOIN a ON a.node = x.node LEFT JOIN n AS p ON x.depth > 0 AND p.node = x.node[1:x.depth - 1]
"""
