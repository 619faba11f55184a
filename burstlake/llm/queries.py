"""The registered queries of this subpackage: each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, importance, language, line_dedup, merkle, near_dup, packing, secrets, simhash, substring_dedup, topk, toxicity, warc
from .shared import prepare, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.without_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "lines_dropped", F.length("text").cast("long").alias("chars_left"), F.md5("text").alias("text_md5"))


ORACLES["op3_line_dedup"] = """
WITH pages AS (SELECT DISTINCT source, text FROM documents),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
held AS (
  SELECT source, line, count(*) AS held
  FROM (SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM pages)
  WHERE trim(line, ' ') <> '' GROUP BY source, line),
found AS (
  SELECT h.source, list(h.line) AS lines
  FROM held h JOIN totals t ON h.source IS NOT DISTINCT FROM t.source
  WHERE h.held >= 3 AND h.held > 0.1 * t.pages GROUP BY h.source),
cleaned AS (
  SELECT d.doc_id, string_split(d.text, chr(10)) AS parts,
    list_filter(string_split(d.text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(f.lines, []), x)) AS kept
  FROM documents d LEFT JOIN found f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, CAST(coalesce(len(parts) - len(kept), 0) AS BIGINT) AS lines_dropped,
  CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS chars_left, md5(array_to_string(kept, chr(10))) AS text_md5
FROM cleaned
"""


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


ORACLES["op5_minhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM shingles),
flat AS (SELECT doc_id, unnest(s) AS s FROM shingles),
both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM flat x JOIN flat y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM both_have JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM sizes UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.v),
least AS (SELECT v AS doc_id, min(r) AS component_id FROM reach GROUP BY v)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.languages(docs, language.learned(docs))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def _sql_secrets() -> str:
    """Matches and what lies between them are unnested side by side, and places are running sums of their lengths."""
    patterns = {"assign": secrets.ASSIGN.replace("'", "''"), "access": r"AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "mixed": secrets.MIXED}
    keep = {"assign": "length(value) >= 12", "access": "length(value) >= 18", "hex": "length(value) >= 16", "mixed": "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')"}
    every = " UNION ALL ".join(
        f"""(SELECT row, {ord} AS ord, '{kind}' AS kind, value, CAST(upto - length(m) AS BIGINT) AS start, CAST(upto AS BIGINT) AS "end" FROM (
  SELECT row, m, value, sum(length(gap) + length(m)) OVER (PARTITION BY row ORDER BY i) AS upto FROM (
    SELECT row, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(vals) AS value FROM (
      SELECT row, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', {2 if kind == "assign" else 0}) AS vals FROM texts))) WHERE {keep[kind]})"""
        for ord, (kind, p) in enumerate(patterns.items())
    )
    joined = "coalesce(string_agg(kind || ':' || start || ':' || \"end\", ',' ORDER BY start, ord)"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
every AS ({every}),
apart AS (SELECT * FROM every e WHERE kind <> 'mixed' OR NOT EXISTS (SELECT 1 FROM every b WHERE b.row = e.row AND b.kind <> 'mixed' AND b.start < e."end" AND e.start < b."end")),
ownership AS (SELECT value, count(DISTINCT coalesce('s' || source, '-')) AS owners, count(DISTINCT (coalesce('s' || source, '-'), coalesce(CAST(doc_id AS VARCHAR), '-'))) AS repositories FROM apart JOIN texts USING (row) GROUP BY value),
judged AS (SELECT a.*, owners <= {secrets.OWNERS} AND repositories <= {secrets.REPOSITORIES} AS live FROM apart a JOIN ownership USING (value)),
summed AS (SELECT row, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
  {joined} FILTER (WHERE kind <> 'mixed'), '') AS base, {joined} FILTER (WHERE kind <> 'mixed' OR live), '') AS spans, count_if(live) AS n_live, count_if(NOT live AND kind <> 'mixed') AS n_copied
  FROM judged GROUP BY row)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied
FROM texts LEFT JOIN summed USING (row)
"""


ORACLES["op7_secrets"] = _sql_secrets()


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


ORACLES["op4_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to,
  CAST(NULL AS VARCHAR) AS damage
FROM g
"""


#: CRC-32 in SQL, for what DuckDB has no function: the table of a byte (by its rule), bytes of a string in UTF-8, and the sum over them.
_CRC = """
crc_table AS MATERIALIZED (SELECT list(list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS ct FROM range(256) r(n))"""


def _crc(x: str) -> str:
    """SQL for the unsigned CRC-32 of the string ``x``, beside ``crc_table``."""
    points = f"list_transform(string_split({x}, ''), lambda ch: unicode(ch))"
    rest = lambda n: ", ".join(f"128 | ((p >> {6 * k}) & 63)" for k in range(n - 1, -1, -1))
    utf8 = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] WHEN p < 2048 THEN [192 | (p >> 6), {rest(1)}] WHEN p < 65536 THEN [224 | (p >> 12), {rest(2)}] ELSE [240 | (p >> 18), {rest(3)}] END))"
    return f"xor(list_reduce(list_concat([4294967295], CAST({utf8} AS BIGINT[])), lambda c, b: xor(ct[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_importance"] = rf"""
WITH {_CRC},
texts AS (SELECT row_number() OVER () AS row, doc_id, text, true AS doc FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
words AS (SELECT row, doc_id, doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT row, doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM words),
counted AS (SELECT row, doc, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS MATERIALIZED (SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crc_table),
posted AS (SELECT row, doc, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
both_have AS (SELECT bucket, coalesce(sum(n) FILTER (doc), 0) AS s, coalesce(sum(n) FILTER (NOT doc), 0) AS t FROM posted GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM both_have) + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM both_have) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM both_have),
sums AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM posted JOIN gains USING (bucket) WHERE doc GROUP BY row),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN sums USING (row) WHERE doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank FROM ranked
"""


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_digest(text=F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return merkle.verified(merkle.manifest(docs, {"tampered": tampered}), F.coalesce("tampered", "leaf"))


def _sql_merkle() -> str:
    framed = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(framed(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    levels = lambda name, start: f"""{name} AS (
  SELECT 0 AS level, g, pos, digest, size FROM {start}
  UNION ALL
  SELECT level + 1, g, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(size) + 7) // 8 FROM {name} WHERE size > 1 GROUP BY level, g, pos // 8)"""  # noqa: E731
    folds = lambda name, start, tree, others: f"""{name} AS (
  SELECT 0 AS level, id, g, pos, size, digest, '' AS proof FROM {start}
  UNION ALL
  SELECT x.level + 1, id, x.g, x.pos // 8, (x.size + 7) // 8, sha256(coalesce(b, '') || x.digest || coalesce(a, '')), proof || coalesce(b, '') || coalesce(a, '')
  FROM {name} x, LATERAL (SELECT string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < x.pos) AS b, string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > x.pos) AS a FROM {tree} t WHERE t.level = x.level AND t.g = x.g AND t.pos // 8 = x.pos // 8) WHERE x.size > 1)"""  # noqa: E731
    return f"""
WITH RECURSIVE {_CRC},
marked AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '-') AS g, {leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS changed
  FROM documents, crc_table),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size FROM marked),
{levels("built", "(SELECT g, pos, leaf AS digest, size FROM leaves)")},
nodes AS MATERIALIZED (SELECT * FROM built),
tops AS MATERIALIZED (SELECT '' AS all_g, g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
{levels("upper_built", "(SELECT all_g AS g, pos, subroot AS digest, size FROM tops)")},
upper_nodes AS MATERIALIZED (SELECT * FROM upper_built),
{folds("folding", "(SELECT id, g, pos, size, changed AS digest FROM leaves)", "nodes", "g")},
folded AS MATERIALIZED (SELECT id, f.g, f.proof, f.digest FROM folding f WHERE size = 1),
{folds("upper_folding", "(SELECT id, '' AS g, tops.pos, tops.size, digest FROM folded JOIN tops USING (g))", "upper_nodes", "g")}
SELECT doc_id, leaf, subroot, root, sha256(folded.proof || u.proof) AS proof_sha256, u.digest AS folded_root, u.digest = root AS verified
FROM leaves JOIN folded USING (id) JOIN (SELECT * FROM upper_folding WHERE size = 1) u USING (id) JOIN tops ON tops.g = leaves.g,
  (SELECT digest AS root FROM upper_nodes WHERE size = 1)
"""


ORACLES["op13_merkle"] = _sql_merkle()
