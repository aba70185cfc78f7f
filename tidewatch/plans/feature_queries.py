"""Features, weights, scores and the gate."""

from pyspark.sql import functions as F

from ..functions.text import term_counts, terms
from ..operators import features as Q
from . import sql as S
from .registry import query

V = f"WITH {S.FEATURES}"
M = f"WITH {S.MODEL}"


@query(f"{V} SELECT term, df, cf FROM vocabulary")
def build_vocabulary(t):
    return Q.build_vocabulary(Q.document_terms(t.training, "doc_id"))  # one pass, nothing written first


@query(f"{V} SELECT term, round(idf, 6) AS idf FROM idf")
def idf(t):
    return t.vocabulary.select("term", F.round("idf", 6).alias("idf"))


@query(f"{V} SELECT doc_id, term, round(ln(tf) + 1.0, 6) AS w FROM doc_terms")
def sublinear_tf(t):
    return t.doc_terms.select("doc_id", "term", F.round(Q.sublinear_tf(F.col("tf").cast("double")), 6).alias("w"))


@query(
    f"""{V}, c AS (SELECT doc_id, term, tf::DOUBLE AS w FROM doc_terms),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM c GROUP BY doc_id)
SELECT doc_id, term, round(w / norm, 6) AS w FROM c JOIN n USING (doc_id)"""
)
def l2_normalise(t):
    counts = t.doc_terms.select("doc_id", "term", F.col("tf").cast("double").alias("w"))
    return Q.l2_normalise(counts, "doc_id", "w").withColumn("w", F.round("w", 6))


@query(
    f"""{V}, c AS (SELECT doc_id, term, tf::DOUBLE AS w FROM doc_terms),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM c GROUP BY doc_id)
SELECT doc_id, term, round(w / norm, 6) AS w FROM c JOIN n USING (doc_id)"""
)
def unit_terms(t):
    counts = F.transform(term_counts(terms("text")), lambda x: F.struct(x["term"].alias("term"), x["tf"].cast("double").alias("w")))
    rows = t.training.select("doc_id", counts.alias("counts")).select("doc_id", F.inline(Q.unit_terms("counts")))
    return rows.withColumn("w", F.round("w", 6))


@query(f"{V}, {S.TFIDF} SELECT doc_id, term, round(w, 6) AS w FROM tfidf")
def tfidf(t):
    return Q.tfidf(t.corpus, t.vocabulary, "doc_id").withColumn("w", F.round("w", 6))


@query(
    f"""WITH {S.LABELLED}, c AS (SELECT label, count(*) AS n FROM labelled WHERE text <> '' GROUP BY label)
SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE, 6) AS weight FROM c"""
)
def balanced_weights(t):
    return Q.balanced_weights(t.training).withColumn("weight", F.round("weight", 6))


S_ = f"WITH {S.SCORES}"


@query(f"{S_} SELECT doc_id, score FROM scored")
def decision_score(t):
    return t.scored.select("doc_id", "score")


@query(f"WITH {S.PREDICTED} SELECT doc_id, score, predicted FROM predicted")
def hard_label(t):
    return t.predicted.select("doc_id", "score", "predicted")


@query(f"{S_} SELECT doc_id, raw_text, score FROM scored WHERE score >= 0.3")
def noise_gate(t):
    return Q.noise_gate(t.scored_texts).select("doc_id", "raw_text", "score")


@query(
    f"{S_} SELECT count(*) AS submitted, count(*) FILTER (score >= 0.3) AS passed, "
    "count(*) FILTER (score < 0.3) AS filtered FROM scored"
)
def gate_stats(t):
    return Q.gate_stats(t.scored)


@query(
    f"""{M}, p AS (SELECT 'positive' AS side, row_number() OVER (ORDER BY coef DESC, term) AS rank, term, coef FROM weights),
n AS (SELECT 'negative' AS side, row_number() OVER (ORDER BY coef, term) AS rank, term, coef FROM weights)
SELECT side, rank, term, round(coef, 6) AS coef FROM (SELECT * FROM p UNION ALL SELECT * FROM n) WHERE rank <= 20"""
)
def top_terms(t):
    return Q.top_terms(t.weights).withColumn("coef", F.round("coef", 6))


@query(
    f"""{V}, c AS (SELECT count(*) AS n, count(*) FILTER (contains(term, ' ')) AS two FROM vocabulary)
SELECT n AS vocabulary_size, n - two AS unigram_count, two AS bigram_count, round(two * 100.0 / n, 2) AS bigram_pct FROM c"""
)
def vocabulary_stats(t):
    return Q.vocabulary_stats(t.vocabulary)
