"""Preparation of the training set."""

from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators import prep as P
from . import sql as S
from .registry import query
from .text_queries import RAW_LABELS, raw_labels

L = f"WITH {S.LABELLED}, kept AS (SELECT * FROM labelled WHERE text <> '')"

TWO = f"""WITH both_sources AS (
  SELECT 'documents' AS source, text AS raw_text FROM documents UNION ALL SELECT 'conversations', text FROM conversations)"""


@query(f"{TWO} SELECT source, raw_text, {S.clean('raw_text')} AS text FROM both_sources")
def union_labelled(t):
    part = lambda name: t.read(name).select(
        F.lit(name).alias("source"), F.col("text").alias("raw_text"), clean_text("text").alias("text")
    )
    return P.union_labelled(part("documents"), part("conversations"))


@query(f"{L} SELECT DISTINCT raw_text, label FROM kept")
def drop_exact(t):
    return P.drop_exact(t.training).select("raw_text", "label")


@query(
    f"{L} SELECT doc_id, text, label FROM kept WHERE text NOT IN "
    "(SELECT text FROM kept GROUP BY text HAVING count(DISTINCT label) > 1)"
)
def drop_label_conflicts(t):
    return P.drop_label_conflicts(t.training).select("doc_id", "text", "label")


@query(f"{L} SELECT text, min(label) AS label FROM kept GROUP BY text HAVING count(DISTINCT label) = 1")
def dedupe_labelled(t):
    return P.dedupe_labelled(t.training)


@query(
    f"""{L}, exact AS (SELECT DISTINCT raw_text, text, label FROM kept),
conflicts AS (SELECT text FROM exact GROUP BY text HAVING count(DISTINCT label) > 1),
agreed AS (SELECT * FROM exact WHERE text NOT IN (SELECT text FROM conflicts)),
final AS (SELECT DISTINCT text, label FROM agreed),
n AS (SELECT (SELECT count(*) FROM kept) AS a, (SELECT count(*) FROM exact) AS b, (SELECT count(*) FROM conflicts) AS c,
  (SELECT count(*) FROM agreed) AS d, (SELECT count(*) FROM final) AS e)
SELECT a - b AS exact_duplicates, c AS conflict_groups, b - d AS conflict_rows, d - e AS clean_duplicates,
  a - e AS total_removed, e AS final_rows FROM n"""
)
def dedupe_report(t):
    return P.dedupe_report(t.training)


@query(
    f"""WITH {RAW_LABELS} SELECT trim(raw_label) AS variant, count(*) AS n,
  CASE lower(trim(raw_label)) WHEN 'related and informative' THEN '1' WHEN 'related - but not informative' THEN '1'
    WHEN 'not related' THEN '0' WHEN 'not applicable' THEN '0' ELSE 'unknown' END AS mapped
FROM raw_labels WHERE raw_label IS NOT NULL GROUP BY ALL"""
)
def label_audit(t):
    return P.label_audit(raw_labels(t), "raw_label")


@query(
    f"""{L}, c AS (SELECT count(*) AS n_total, count(*) FILTER (label = 0) AS n_negative,
  count(*) FILTER (label = 1) AS n_positive FROM kept)
SELECT n_total, n_negative, n_positive, round(n_positive * 100.0 / n_total, 6) AS positive_pct,
  n_positive * 100.0 / n_total > 60 AS imbalanced FROM c"""
)
def class_balance(t):
    return P.class_balance(t.training).withColumn("positive_pct", F.round("positive_pct", 6))


@query("SELECT source, count(*) AS n_rows, count(DISTINCT lang) AS n_files FROM documents GROUP BY source")
def source_counts(t):
    return P.source_counts(t.documents, "source", "lang")


@query(
    "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS position FROM documents"
)
def seeded_order(t):
    return P.seeded_order(t.read("documents").select("doc_id"), "doc_id", position="position")


@query(
    "SELECT d.doc_id, d.text, l.quality::INT AS label FROM documents d LEFT JOIN labels l USING (doc_id) "
    "WHERE d.text IS NOT NULL AND l.quality IS NOT NULL AND length(d.text) > 0"
)
def drop_missing(t):
    rows = t.documents.join(t.read("labels"), "doc_id", "left")
    return P.drop_missing(rows.select("doc_id", "text", F.col("quality").alias("label")))


HASHED = "(('0x' || md5(doc_id || '|42')[1:8])::BIGINT / 4294967296.0)"


@query(
    f"{L} SELECT doc_id, label, CASE WHEN {HASHED} < 0.2 THEN 'test' "
    "ELSE 'train' END AS split FROM kept"
)
def stratified_split(t):
    return P.stratified_split(t.training, "label", "doc_id", exact=False).select("doc_id", "label", "split")


RANKED = "row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '|42'), doc_id)"


@query(
    f"{L} SELECT doc_id, label, CASE WHEN {RANKED} <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) "
    "THEN 'test' ELSE 'train' END AS split FROM kept"
)
def stratified_split_exact(t):
    return P.stratified_split(t.training, "label", "doc_id").select("doc_id", "label", "split")


@query(
    f"{L} SELECT doc_id, label, floor({HASHED} * 5)::INT AS fold "
    "FROM kept"
)
def assign_folds(t):
    return P.assign_folds(t.training, "label", "doc_id", exact=False).select("doc_id", "label", "fold")


@query(f"{L} SELECT doc_id, label, (({RANKED} - 1) % 5)::INT AS fold FROM kept")
def assign_folds_exact(t):
    return P.assign_folds(t.training, "label", "doc_id").select("doc_id", "label", "fold")


@query(f"{L} SELECT count(*) AS n_rows, CASE WHEN count(*) <= 120 THEN 'all' ELSE 'held_out' END AS scope FROM kept")
def eval_scope(t):
    return P.eval_scope(t.training)
