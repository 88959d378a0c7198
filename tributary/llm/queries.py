"""The queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import decontaminate, fixity, lm_score, mixing, near_dedup, packing, token_counts, top_k, toxicity, url_rules
from tributary.llm.common import discard_path, settle, table

CATEGORIES = ("quality", "toxic")
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    found = toxicity.score(docs, chain, CATEGORIES, keep=["doc_id"])
    return found.select("row.doc_id", F.col("p.quality").alias("p_quality"), F.col("p.toxic").alias("p_toxic"), (F.col("p.toxic") >= F.lit(chain.threshold)).alias("toxic"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark, RULES))


EXTRA = fixity.write_warc([("urn:extra", b"a record that the first copy doesn't have")], compress=False)


def number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def damaged(archive: str, data: bytes) -> bytes:
    """What has happened to a replica's archive: bits flipped within some records and in the first line of others, and a cut end or one more record."""
    out, before = bytearray(data), -1
    for offset, *_ in fixity.parse_warc(data):
        k = number(f"{archive}|{offset}") % 97
        if k == 3:
            out[offset + 21] ^= 0x20  # in the type's name
        elif k == 5 and before != 5:
            out[offset] ^= 0x20
        before = k
    end = number(archive) % 3
    return bytes(out[:-6]) if end == 0 else bytes(out) + EXTRA if end == 1 else bytes(out)


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files, read back as they were written and as a damaged replica, by offsets."""
    pages = table(spark, sf_dir, "pages")
    path = fixity.write_archives(pages.select(fixity.record_text(F.col("url"), F.col("html")).alias("record")))
    own = settle(fixity.fixity_manifest(fixity.read_warc(spark, path, payloads=False)), "manifest")
    replica = settle(fixity.fixity_manifest(fixity.read_warc(spark, path, payloads=False, change=damaged)), "manifest")
    discard_path(spark, path)
    return fixity.audit(own, replica)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_ids", "doc_starts", "cu_seqlens", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return hits.select(
        "row.doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_lm_score, op2_top_k, op3_toxicity, op4_near_duplicates, op5_mixing, op6_token_counts, op7_url_rules, op8_warc_fixity,
        op9_packing, op10_decontamination,
    )
    return {f.__name__: f for f in found}


UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP5_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix|' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
z AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w
  FROM d GROUP BY source),
o AS (SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / w, encode(source) NULLS LAST) AS k FROM z),
l AS (
  SELECT *, ((SELECT CAST(sum(source_size) AS BIGINT) FROM o) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT max(level) FROM l WHERE cap > w * level), cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
c AS (
  SELECT d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (passes + CASE WHEN budget > 0 AND 2 * upto - own <= 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""

OP7_SQL = f"""
WITH x AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UP}', '{LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM x),
r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT u.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC) AS k
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.k = 1
"""

RECORD_SQL = "E'WARC/1.1\\r\\nWARC-Type: resource\\r\\nWARC-Target-URI: ' || coalesce(url, '') || E'\\r\\nContent-Length: ' || strlen(coalesce(html, '')) || E'\\r\\n\\r\\n' || coalesce(html, '') || E'\\r\\n\\r\\n'"
HASH_SQL = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"

OP8_SQL = f"""
WITH p AS (SELECT {RECORD_SQL} AS r FROM pages),
d AS (SELECT r, CAST(strlen(r) AS BIGINT) AS len, sha256(left(r, length(r) - 4)) AS digest FROM p),
b AS (SELECT min(b) AS bits FROM range(21) x(b), (SELECT sum(len) AS total FROM d) t WHERE CAST({fixity.ARCHIVE_BYTES} AS BIGINT) << b >= total OR b = 20),
k AS (SELECT r, len, digest, CAST('0x' || substr(digest, 1, 5) AS BIGINT) >> CAST(20 - bits AS BIGINT) AS bucket FROM d, b),
a AS (
  SELECT lpad(CAST(bucket AS VARCHAR), 7, '0') AS archive, len, r,
    CAST(coalesce(sum(len) OVER (PARTITION BY bucket ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM k),
h AS (
  SELECT *, {HASH_SQL.format("archive || '|' || position")} % 97 AS k, {HASH_SQL.format('archive')} % 3 AS ends,
    row_number() OVER (PARTITION BY archive ORDER BY position DESC) = 1 AS last FROM a),
g AS (SELECT *, k = 5 AND coalesce(lag(k) OVER (PARTITION BY archive ORDER BY position), -1) <> 5 AS broken FROM h),
c AS (SELECT *, CASE WHEN k = 3 THEN substr(r, 1, 21) || 'R' || substr(r, 23) WHEN broken THEN 'w' || substr(r, 2) ELSE r END AS other FROM g),
e AS (SELECT *, CASE WHEN last AND ends = 0 THEN left(other, length(other) - 6) ELSE other END AS replica, broken OR (last AND ends = 0) AS bad FROM c)
SELECT archive, position, CASE WHEN bad THEN 'damaged' ELSE 'changed' END AS status, len AS length, sha256(r) AS digest, CAST(1 AS BIGINT) AS copies,
  CAST(strlen(replica) AS BIGINT) AS replica_length, sha256(replica) AS replica_digest, CAST(1 AS BIGINT) AS replica_copies FROM e WHERE r <> replica
UNION ALL
SELECT archive, position + len, 'extra', NULL, NULL, 0, CAST({len(EXTRA)} AS BIGINT), '{hashlib.sha256(EXTRA).hexdigest()}', 1 FROM e WHERE last AND ends = 1
"""

OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i+least(len(w), 10)-1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i+m-1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM d JOIN sizes ON len(w) >= m)),
hit AS (SELECT doc_id, item, m, i FROM dw JOIN bw USING (m, g)),
word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
own AS (SELECT doc_id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(own.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(own.items, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN own USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": OP2_SQL, "op4_near_duplicates": OP4_SQL, "op5_mixing": OP5_SQL, "op7_url_rules": OP7_SQL, "op8_warc_fixity": OP8_SQL, "op10_decontamination": OP10_SQL}
