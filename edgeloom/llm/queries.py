"""The registered ``opN_<name>`` queries, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import decontaminate, embedding_dedup, language_id, minhash_dedup, mixing, suffix_dedup, token_counts, toxicity, url_filter, warc
from edgeloom.llm.shared import table

PIECES = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_token_counts(spark: SparkSession, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.read_ranks(pieces))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.parse_rules(list(RULES)))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=3, threshold=0.85)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_token_counts, op3_warc, op4_url_filter, op5_suffix_dedup, op6_minhash_dedup, op7_mixing, op8_language_id, op9_decontamination, op10_toxicity)}

ORACLES: dict[str, str] = {}

ORACLES["op7_mixing"] = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), own AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sizes GROUP BY source
), levels AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)::DOUBLE AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open
  FROM own WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max(rest) AS rest, max(open) AS open FROM levels WHERE NOT cap * levels.open <= levels.rest * w
), targets AS (
  SELECT source, source_size, CASE WHEN cap * l.open <= l.rest * w THEN cap ELSE level.rest * w / level.open END AS target
  FROM levels l CROSS JOIN level
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets
), ranked AS (
  SELECT d.*, t.source_size, t.target, floor(rate) AS whole, rate - floor(rate) AS p, target - floor(rate) * t.source_size AS need,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM sizes d JOIN rates t ON d.source IS NOT DISTINCT FROM t.source
), summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u / (1 - u) / (p / (1 - p)), doc_id NULLS FIRST, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before
  FROM ranked
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN p > 0 AND before + size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""

ORACLES["op1_embedding_dedup"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), near AS (
  SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, n.b FROM reach r JOIN near n ON n.a = r.other
), least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM near n WHERE n.a = e.vec_id)::BIGINT AS n_links, l.component_id, l.component_id = e.vec_id AS kept
FROM embeddings e JOIN least l ON l.id = e.vec_id
"""

ORACLES["op3_warc"] = """
WITH body AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages
), lead AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM body)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM lead
"""

ORACLES["op5_suffix_dedup"] = r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), windows AS (
  SELECT doc_id, unnest(range(n - 49)) AS i, h FROM bytes WHERE n >= 50
), keyed AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS w FROM windows
), least AS (SELECT w, min(doc_id) AS first FROM keyed GROUP BY w HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT k.doc_id, k.i FROM keyed k JOIN least l USING (w) WHERE l.first < k.doc_id),
edges AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hits),
runs AS (SELECT *, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edges),
spans AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, r),
kept AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte FROM spans
), joined AS (
  SELECT k.doc_id, string_agg(substr(d.h, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a) || substr(any_value(d.h), 2 * max(b) + 1) AS h, sum(b - a) AS removed, count(*) AS n_spans
  FROM kept k JOIN bytes d USING (doc_id) GROUP BY k.doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(j.removed, 0)::BIGINT AS n_removed, coalesce(j.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(j.h, d.h))) AS kept_sha256
FROM bytes d LEFT JOIN joined j USING (doc_id)
"""

ORACLES["op6_minhash_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), parts AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), shingles AS (SELECT DISTINCT doc_id, md5_number(s) AS s FROM parts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
near AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, n.b FROM reach r JOIN near n ON n.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, l.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l ON l.id = d.doc_id
"""
