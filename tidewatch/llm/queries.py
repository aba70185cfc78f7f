"""The operators as queries over the sample tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import attention_lm, decontaminate, html_text, merkle, mixing, packing, quotations, simhash, token_files, toxicity, vectors, warc, whitening
from .common import read_table, shared_path
from .tokens import public_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op3_simhash(spark, folder):
    return simhash.simhash_groups(read_table(spark, folder, "documents"))


@query
def op5_decontaminate(spark, folder):
    found = decontaminate.contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated",
    )


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL["op5_decontaminate"] = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""


@query
def op4_token_files(spark, folder):
    path = shared_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, folder, "documents"), path, public_path("byte_bpe_50k.json"), 2)
    rows = token_files.with_global_start(token_files.read_token_files(spark, path, ids=False))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_packing(spark, folder):
    return packing.pack_documents(read_table(spark, folder, "documents"), public_path("word_bpe_49k.json"), 0)


@query
def op2_warc(spark, folder):
    path = shared_path(spark, "warc")
    warc.write_archives(read_table(spark, folder, "pages"), path)
    records, _ = warc.read_archives(spark, path, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# SHA-1 as hex digits, then as 160 bits, then as 32 letters.
SQL["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY sha1(b)) AS first FROM p),
t AS (SELECT *, array_to_string([['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010',
  '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)] for c in string_split(hex, '')], '') AS bits FROM s)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, 5 * i + 1, 5))::INT, 1)
  for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM t"""


@query
def op6_vectors(spark, folder):
    return vectors.link_vectors(read_table(spark, folder, "embeddings"))


SQL["op6_vectors"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM low LEFT JOIN n USING (vec_id)"""


@query
def op8_html_text(spark, folder):
    return html_text.extract_text(read_table(spark, folder, "pages"))


@query
def op10_quotations(spark, folder):
    return quotations.link_conversations(read_table(spark, folder, "conversations"))


# The sample tables quote nothing; for other messages the operator is tested against a plain reading of its rules.
SQL["op10_quotations"] = """
SELECT conv_id, turn, role, row_number() OVER w AS position, lag(turn) OVER w AS reply_to, 0::BIGINT AS n_quoted,
  0::BIGINT AS n_linked, text, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS formatted
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)"""


@query
def op1_toxicity(spark, folder):
    return toxicity.toxicity(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op7_attention_lm(spark, folder):
    return attention_lm.score_documents(read_table(spark, folder, "documents"), public_path("byte_bpe_50k.json"), 50257)


@query
def op11_merkle(spark, folder):
    proven = merkle.verify_manifest(read_table(spark, folder, "documents"), merkle.deleted_newlines())
    return proven.drop("source")


_FIELDS = " || ".join(
    f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")
)


def _leaf_sql(text: str) -> str:
    return f"sha256({_FIELDS} || coalesce(strlen({text})::VARCHAR || ':' || {text}, '-'))"


# crc32 bit by bit: each byte enters with its first bit.
_CRC_SQL = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))"""
SQL["op11_merkle"] = f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS r, CASE WHEN xor({_CRC_SQL}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '')
    ELSE text END AS cut FROM documents),
h AS (SELECT r, doc_id, source, {_leaf_sql('text')} AS leaf, {_leaf_sql('cut')} AS checked FROM d),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, count(*) OVER (PARTITION BY source) AS n,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS x FROM h),
tree AS (SELECT src, 0 AS level, n, x, leaf AS d FROM leaves
  UNION ALL SELECT src, level + 1, (n + 2) // 3, x // 3, sha256(string_agg(d, '' ORDER BY x)) FROM tree WHERE n > 1
  GROUP BY src, level, n, x // 3),
subroots AS (SELECT src, d, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, n, src AS x, d FROM subroots
  UNION ALL SELECT level + 1, (n + 2) // 3, x // 3, sha256(string_agg(d, '' ORDER BY x)) FROM top WHERE n > 1
  GROUP BY level, n, x // 3),
pairs AS (
  SELECT r, t.level, t.x, t.d, l.x // (3 ** t.level)::BIGINT AS own FROM leaves l JOIN tree t ON t.src = l.src AND t.n > 1
    AND t.x // 3 = (l.x // (3 ** t.level)::BIGINT) // 3
  UNION ALL SELECT r, 1000 + t.level, t.x, t.d, l.src // (3 ** t.level)::BIGINT FROM leaves l JOIN top t ON t.n > 1
    AND t.x // 3 = (l.src // (3 ** t.level)::BIGINT) // 3),
sides AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY level) AS step,
  coalesce(string_agg(d, '' ORDER BY x) FILTER (x < own), '') AS before,
  coalesce(string_agg(d, '' ORDER BY x) FILTER (x > own), '') AS after FROM pairs GROUP BY r, level),
proofs AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM sides GROUP BY r),
fold AS (SELECT r, 1 AS step, checked AS d FROM leaves
  UNION ALL SELECT f.r, f.step + 1, sha256(before || f.d || after) FROM fold f JOIN sides s ON s.r = f.r AND s.step = f.step),
folded AS (SELECT r, arg_max(d, step) AS d FROM fold GROUP BY r),
root AS (SELECT d FROM top WHERE n = 1)
SELECT doc_id, leaf, s.d AS subroot, root.d AS root, coalesce(proof, sha256('')) AS proof_sha256, f.d AS folded_root,
  f.d = root.d AS verified
FROM leaves l JOIN subroots s USING (src) JOIN folded f USING (r) LEFT JOIN proofs USING (r) CROSS JOIN root"""


@query
def op12_mixing(spark, folder):
    return mixing.mix_plan(read_table(spark, folder, "documents")).drop("source", "rounds", "cut")


SQL["op12_mixing"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  md5('mix:' || coalesce(doc_id::VARCHAR, '-')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
  coalesce(sum(2 * source_size) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS caps_before,
  (sum(w) OVER () - coalesce(sum(w) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS w_left FROM s
  WINDOW b AS (ORDER BY source_size / w::DOUBLE, source NULLS LAST)),
f AS (SELECT *, 2.0::DOUBLE * source_size * w_left <= w * (total - caps_before) AS is_full FROM o),
r AS (SELECT coalesce(sum(2 * source_size) FILTER (is_full), 0)::DOUBLE AS caps, coalesce(sum(w) FILTER (NOT is_full), 0)::DOUBLE AS rest FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN 2.0::DOUBLE * source_size ELSE w * (total - caps) / rest END AS target FROM f, r),
p AS (SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget,
  sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size * size + least(greatest(budget % source_size - before, 0), size) ELSE 0 END)::BIGINT
  AS taken FROM p"""


@query
def op13_whitening(spark, folder):
    return whitening.whiten(read_table(spark, folder, "embeddings"))
