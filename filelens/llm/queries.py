"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from filelens.llm import (
    collocations, decontaminate, extraction, host_rules, jaccard, language, packing, pii, quality, secrets, toxicity,
    variants, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = build
        if sql is not None:
            ORACLE[key] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _matches(rule: secrets.Rule, rank: int) -> str:
    """Spans of one kind: cumulative lengths of the texts between matches and of the
    matches themselves."""
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    checked = f"regexp_extract_all(t, {pattern}, {rule.group})"
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, "end" - long AS start, "end" FROM (
  SELECT doc_id, i, long, held, sum(gap + long) OVER (PARTITION BY doc_id ORDER BY i) AS "end" FROM (
    SELECT doc_id, i, length(gaps[i]) AS gap, length(found[i]) AS long, length(held[i]) AS held FROM (
      SELECT doc_id, gaps, found, held, unnest(range(1, len(found) + 1)) AS i FROM (
        SELECT doc_id, regexp_split_to_array(t, {pattern}) AS gaps,
          regexp_extract_all(t, {pattern}, 0) AS found, {checked} AS held
        FROM d WHERE regexp_matches(t, {pattern}))))) WHERE held >= {rule.least}"""


_LISTED = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(\"end\" AS BIGINT), ',' ORDER BY start, rank)"


@query(
    "op3_secrets",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_matches(r, i) for i, r in enumerate(secrets.RULES))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, {_LISTED} FILTER (rank < 3) AS base, {_LISTED} AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
)
def _(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query(
    "op10_host_rules",
    r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
e AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i+1], words[i+2], words[i+3], words[i+4]) AS n FROM e),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h CROSS JOIN range(5) AS r(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
f AS (SELECT w.doc_id, source, len(words) AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
o AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM o),
r AS (SELECT source FROM (SELECT source, k, n, m,
  CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM o, p)
  WHERE (k + m * s) / (n + s) > 0.5)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM r)) AS kept FROM b""",
)
def _(spark, sf_dir):
    return host_rules.judge(table(spark, sf_dir, "documents")).drop("host")


@query(
    "op1_warc_index",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, payload_bytes, max(page_id) AS response FROM q WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, CAST(q.payload_bytes AS BIGINT) AS payload_bytes, q.payload_digest,
  CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response <> page_id THEN response END AS refers_to
FROM q LEFT JOIN m ON q.payload_digest = m.payload_digest AND q.payload_bytes = m.payload_bytes""",
)
def _(spark, sf_dir):
    return warc.archive_and_read(table(spark, sf_dir, "pages")).drop("url")


@query("op2_linear_grouping")
def _(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_noisy_channel")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op5_byte_network")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op6_feistel_pseudonyms")
def _(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query("op7_family_machines")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


@query(
    "op8_group_matrix",
    r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[i : i + 2], 'string_agg', ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.shingle = y.shingle
  WHERE x.doc_id <> y.doc_id GROUP BY ALL) AS p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b
  WHERE 100 * c >= 90 * (na.n + nb.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id
  JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) AS c ON c.a = d.doc_id""",
)
def _(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), 3, 90)


@query("op9_templates")
def _(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op11_suffix_collocations",
    r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
s AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM s GROUP BY lang),
g AS (SELECT lang, m, w[i : i + m - 1] AS g FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i
  FROM s CROSS JOIN (SELECT unnest(range(1, 6)) AS m))),
f AS MATERIALIZED (SELECT lang, m, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
b AS (SELECT lang, g, max(f) AS longest FROM (SELECT lang, f, unnest([g[i : i + k - 1] for i in range(1, m - k + 2)]) AS g
  FROM f CROSS JOIN (SELECT unnest(range(2, 5)) AS k) WHERE k < m) GROUP BY ALL),
c AS (SELECT f.lang, m, f.g, f AS a FROM f LEFT JOIN b ON b.lang = f.lang AND b.g = f.g WHERE m > 1 AND 100 * coalesce(longest, 0) < 100 * f),
k AS (SELECT lang, g, a, k, g[: k] AS one, g[k + 1 :] AS two FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
q AS (SELECT k.lang, k.g, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM k
  JOIN f AS x ON x.lang = k.lang AND x.g = one JOIN f AS y ON y.lang = k.lang AND y.g = two JOIN n ON n.lang = k.lang),
o AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
  array_to_string(g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o QUALIFY rank <= 2000""",
)
def _(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query(
    # Stated over the given pages, where the main text is what the one article element holds.
    "op12_minimum_cut",
    r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|h1|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d""",
)
def _(spark, sf_dir):
    return extraction.extract(table(spark, sf_dir, "pages"))


@query(
    "op13_bit_sliced_variants",
    r"""WITH RECURSIVE t AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS BIGINT)] || CAST(range(8) AS BIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
g AS (SELECT run, id || ':' || run AS s, count(*) AS n FROM d WHERE length(run) >= 7 GROUP BY ALL),
x AS (SELECT s, hex(encode(s)) AS x FROM g),
b AS (SELECT s, [4294967295] || [CAST(('0x' || x[2 * i + 1 : 2 * i + 2]) AS BIGINT) for i in range(length(x) // 2)] AS b FROM x),
h AS (SELECT s, xor(list_reduce(b, lambda c, k: xor(t[(xor(c, k) & 255) + 1], c >> 8)), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM g JOIN h USING (s)),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
c AS (SELECT word, n, i, word[: i] AS a, word[i + 2 :] AS z FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT x.word, y.word AS other, y.n FROM c AS x JOIN c AS y ON x.i = y.i AND x.a = y.a AND x.z = y.z WHERE x.word <> y.word
  UNION SELECT v.word, c.word, c.n FROM c JOIN v ON v.word = c.a || c.z
  UNION SELECT c.word, v.word, v.n FROM c JOIN v ON v.word = c.a || c.z),
o AS (SELECT word, count(*) AS n_near, max(n) AS m, min(struct_pack(k := -n, w := other)).w AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN best END AS form,
  CASE WHEN m >= 10 * n THEN m END AS form_n FROM v LEFT JOIN o USING (word)),
r(word, root, step) AS (SELECT word, form, 1 FROM f WHERE form IS NOT NULL UNION ALL
  SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, coalesce(e.root, f.word) AS root, n, n_near, form_n
FROM f LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word) AS e ON e.word = f.word""",
)
def _(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
