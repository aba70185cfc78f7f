"""Evaluation of the scored corpus."""

from pyspark.sql import functions as F

from ..operators import curves as C, metrics as M, summary as D, training as T
from ..operators.prep import dedupe_labelled, stratified_split
from ..session import stored
from . import sql as S
from .registry import query

P = f"WITH {S.PREDICTED}"
X = f"WITH {S.SCORES}"

CELLS = """cells AS (SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 0)
  AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn
  FROM predicted)"""


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    f"""{P}, {CELLS} SELECT tp, tn, fp, fn, round({S.ratio('tp', 'tp + fn')}, 4) AS tpr,
  round({S.ratio('fp', 'fp + tn')}, 4) AS fpr, round({S.ratio('tn', 'tn + fp')}, 4) AS tnr,
  round({S.ratio('fn', 'fn + tp')}, 4) AS fnr FROM cells"""
)
def confusion(t):
    return M.confusion(t.predicted)


@query(f"{P} SELECT round(avg((label = predicted)::INT), 6) AS accuracy FROM predicted")
def accuracy(t):
    return rounded(M.accuracy(t.predicted), "accuracy")


REPORT = f"""{CELLS},
pr AS (
  SELECT 0 AS class, {S.ratio('tn', 'tn + fn')} AS precision, {S.ratio('tn', 'tn + fp')} AS recall, tn + fp AS support FROM cells
  UNION ALL
  SELECT 1, {S.ratio('tp', 'tp + fp')}, {S.ratio('tp', 'tp + fn')}, tp + fn FROM cells),
report AS (SELECT *, {S.ratio('2.0 * precision * recall', 'precision + recall')} AS f1 FROM pr)"""


@query(
    f"{P}, {REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support "
    "FROM report"
)
def class_report(t):
    return rounded(M.class_report(t.predicted), "precision", "recall", "f1")


AVERAGES = f"""{REPORT},
averages AS (SELECT avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro,
  sum(precision * support) / sum(support) AS precision_weighted, sum(recall * support) / sum(support) AS recall_weighted,
  sum(f1 * support) / sum(support) AS f1_weighted, sum(recall * support) / sum(support) AS accuracy FROM report)"""
NAMES = (
    "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted", "accuracy",
)


@query(f"{P}, {AVERAGES} SELECT {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)} FROM averages")
def averaged_metrics(t):
    return rounded(M.averaged_metrics(t.predicted), *NAMES)


@query(f"{P}, {AVERAGES} SELECT round(f1_weighted, 6) AS f1_weighted, f1_weighted >= 0.85 AS meets_target FROM averages")
def meets_target(t):
    return rounded(M.meets_target(M.averaged_metrics(t.predicted)), "f1_weighted")


STEPS = """tied AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM scored GROUP BY score),
total AS (SELECT sum(pos) AS p, sum(neg) AS n FROM tied),
steps AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM tied, total WINDOW w AS (ORDER BY threshold DESC))"""


@query(
    f"""{X}, {STEPS} SELECT threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM steps
UNION ALL SELECT NULL, 0.0, 0.0"""
)
def roc_curve(t):
    return rounded(C.roc_curve(t.scored), "fpr", "tpr")


@query(f"{X}, {STEPS} SELECT round(sum(neg * (tp - pos / 2.0)) / any_value(p * n)::DOUBLE, 6) AS auc FROM steps")
def auc(t):
    return rounded(C.auc(t.scored), "auc")


@query(
    f"""{X}, {STEPS} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM steps
UNION ALL SELECT NULL, 1.0, 0.0"""
)
def pr_curve(t):
    return rounded(C.pr_curve(t.scored), "precision", "recall")


@query(
    f"""{X}, {STEPS} SELECT round(sum(pos / p * tp / (tp + fp)), 6) AS average_precision,
  round(any_value(p / (p + n)), 6) AS baseline FROM steps"""
)
def average_precision(t):
    return rounded(C.average_precision(t.scored), "average_precision", "baseline")


SWEEP = f"""ends AS (SELECT min(score) AS lo, max(score) AS hi FROM scored),
grid AS (SELECT i, CASE WHEN i = 199 THEN hi ELSE i * ((hi - lo) / 199.0) + lo END AS threshold FROM range(200) r(i), ends),
counted AS (SELECT i, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp,
  count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (label = 1) AS p,
  count(*) FILTER (label = 0) AS n FROM grid, scored GROUP BY i, threshold),
sweep AS (SELECT i AS step, threshold,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE {S.ratio('2.0 * tp', '2 * tp + fp + (p - tp)')} END AS f1,
  CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE {S.ratio('tp', 'p')} END AS recall,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE (tp + n - fp) / (p + n)::DOUBLE END AS accuracy FROM counted)"""
QUALITY = ("threshold", "f1", "precision", "recall", "accuracy")
ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in QUALITY)


@query(f"{X}, {SWEEP} SELECT step, {ROUNDED} FROM sweep")
def threshold_sweep(t):
    return rounded(C.threshold_sweep(t.scored), *QUALITY)


@query(
    f"""{X}, {SWEEP}, ranked AS (SELECT *, row_number() OVER (ORDER BY round(f1, 12) DESC, step) AS a,
  row_number() OVER (ORDER BY abs(threshold - 0.3), step) AS b FROM sweep)
SELECT 'best' AS which, {ROUNDED} FROM ranked WHERE a = 1 UNION ALL SELECT 'deployed', {ROUNDED} FROM ranked WHERE b = 1"""
)
def best_threshold(t):
    sweep = C.threshold_sweep(t.scored).withColumn("f1", F.round("f1", 12))
    return rounded(C.best_threshold(sweep), *QUALITY)


def histogram(bins: int, shared: bool) -> str:
    ends = "min(lo) OVER () AS lo, max(hi) OVER () AS hi" if shared else "lo, hi"
    return f"""raw_ends AS (SELECT label, min(score) AS lo, max(score) AS hi, count(*) AS n FROM scored GROUP BY label),
ends AS (SELECT label, {ends}, n FROM raw_ends),
edges AS (SELECT label, i AS bin, lo, hi, n, i * ((hi - lo) / {bins}.0) + lo AS left_edge,
  CASE WHEN i = {bins - 1} THEN hi ELSE (i + 1) * ((hi - lo) / {bins}.0) + lo END AS right_edge FROM ends, range({bins}) r(i)),
histogram AS (SELECT e.label, bin, left_edge, (hi - lo) / {bins} AS width, count(s.score) AS n_rows,
  count(s.score) / (n * ((hi - lo) / {bins})) AS density
  FROM edges e LEFT JOIN scored s ON s.label = e.label AND s.score >= left_edge
    AND (s.score < right_edge OR bin = {bins - 1}) GROUP BY e.label, bin, left_edge, lo, hi, n)"""


# Edges are multiples of a fortieth of a range with six places: whole numbers of 1e-9, so no rounding tie can occur.
@query(
    f"""{X}, {histogram(40, False)} SELECT label, bin, round(left_edge * 1e9)::BIGINT AS left_edge_e9,
  round(width * 1e9)::BIGINT AS width_e9, n_rows, round(density, 6) AS density FROM histogram"""
)
def score_histogram(t):
    exact = lambda c: F.round(F.col(c) * 1e9).cast("long").alias(f"{c}_e9")
    found = C.score_histogram(t.scored)
    return found.select("label", "bin", exact("left_edge"), exact("width"), "n_rows", F.round("density", 6).alias("density"))


BY_BIN = "by_bin AS (SELECT bin, min(density) AS low, max(width) AS width FROM histogram GROUP BY bin HAVING count(*) = 2)"


@query(f"{X}, {histogram(100, False)}, {BY_BIN} SELECT round(sum(low) / 100, 6) AS overlap FROM by_bin")
def class_overlap(t):
    return rounded(C.class_overlap(t.scored), "overlap")


@query(f"{X}, {histogram(100, True)}, {BY_BIN} SELECT round(sum(low * width), 6) AS overlap FROM by_bin")
def class_overlap_shared(t):
    return rounded(C.class_overlap(t.scored, shared_edges=True), "overlap")


FOLD_METRICS = ("accuracy", "f1_macro")


@query(
    f"""{P}, folds AS (SELECT doc_id % 5 AS fold, avg((label = predicted)::INT) AS accuracy,
  avg(predicted) AS f1_macro FROM predicted GROUP BY 1)
SELECT 'accuracy' AS metric, round(avg(accuracy), 4) AS mean, round(stddev_pop(accuracy), 4) AS std FROM folds UNION ALL
SELECT 'f1_macro', round(avg(f1_macro), 4), round(stddev_pop(f1_macro), 4) FROM folds"""
)
def fold_summary(t):
    folds = t.predicted.groupBy((F.col("doc_id") % 5).alias("fold")).agg(
        F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"), F.avg("predicted").alias("f1_macro")
    )
    return M.fold_summary(folds, FOLD_METRICS)


@query(
    f"""WITH {S.LABELLED}, x AS (SELECT label, len({S.ws_tokens('raw_text')}) AS n FROM labelled WHERE text <> '')
SELECT count(*) AS n_total, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative,
  round(count(*) FILTER (label = 1) / (count(*) FILTER (label = 0))::DOUBLE, 3) AS class_ratio, round(avg(n), 2) AS avg_tokens,
  round(avg(n) FILTER (label = 1), 2) AS avg_tokens_positive, round(avg(n) FILTER (label = 0), 2) AS avg_tokens_negative,
  max(n) AS max_tokens, min(n) AS min_tokens FROM x"""
)
def dataset_stats(t):
    return M.dataset_stats(t.training)


@query(
    f"""{P}, {AVERAGES}, {STEPS}, a AS (SELECT sum(neg * (tp - pos / 2.0)) / any_value(p * n)::DOUBLE AS auc FROM steps)
SELECT 'confusion' AS metric, key, value FROM (SELECT tp::DOUBLE AS tp, tn::DOUBLE AS tn, fp::DOUBLE AS fp, fn::DOUBLE AS fn
  FROM cells) UNPIVOT (value FOR key IN (tp, tn, fp, fn))
UNION ALL SELECT 'averages', key, round(value, 6) FROM averages UNPIVOT (value FOR key IN ({', '.join(NAMES)}))
UNION ALL SELECT 'roc', 'auc', round(auc, 6) FROM a"""
)
def metrics_table(t):
    table = M.metrics_table(
        confusion=M.confusion(t.predicted).select("tp", "tn", "fp", "fn"),
        averages=M.averaged_metrics(t.predicted),
        roc=C.auc(t.scored),
    )
    return rounded(table, "value")


FOLDED = ("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro")


def unpivot(part: str, table: str, columns, places: int = 4) -> str:
    named = ", ".join(f"{c}::DOUBLE AS {c}" for c in columns)
    return (f"SELECT '{part}' AS part, key, round(value, {places}) AS value, NULL::VARCHAR AS text "
            f"FROM (SELECT {named} FROM {table}) UNPIVOT (value FOR key IN ({', '.join(columns)}))")  # fmt: skip


RATES = f"""rates AS (SELECT tp, tn, fp, fn, {S.ratio('tp', 'tp + fn')} AS tpr, {S.ratio('fp', 'fp + tn')} AS fpr,
  {S.ratio('tn', 'tn + fp')} AS tnr, {S.ratio('fn', 'fn + tp')} AS fnr FROM cells)"""
QUALITIES = """quality AS (SELECT accuracy, accuracy * 100 AS accuracy_pct, f1_macro AS macro_f1, f1_weighted AS weighted_f1,
  precision_weighted AS weighted_precision, recall_weighted AS weighted_recall,
  (SELECT f1 FROM report WHERE class = 1) AS positive_f1, (SELECT f1 FROM report WHERE class = 0) AS negative_f1 FROM averages)"""
AREAS = """areas AS (SELECT sum(neg * (tp - pos / 2.0)) / any_value(p * n)::DOUBLE AS roc_auc,
  sum(pos / p * tp / (tp + fp)) AS average_precision, any_value(p / (p + n)) AS baseline FROM steps)"""
NAMED = """ranked AS (SELECT *, row_number() OVER (ORDER BY round(f1, 12) DESC, step) AS a,
  row_number() OVER (ORDER BY abs(threshold - 0.3), step) AS b FROM sweep),
best AS (SELECT threshold AS best_threshold, f1 AS best_f1, precision AS best_precision, recall AS best_recall,
  accuracy AS best_accuracy FROM ranked WHERE a = 1),
deployed AS (SELECT threshold AS deployed_threshold, f1 AS deployed_f1, precision AS deployed_precision,
  recall AS deployed_recall, accuracy AS deployed_accuracy FROM ranked WHERE b = 1)"""
CORPUS = f"""lengths AS (SELECT label, len({S.ws_tokens('raw_text')}) AS n FROM labelled WHERE text <> ''),
dataset AS (SELECT count(*) AS n_total, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative,
  round(count(*) FILTER (label = 1) / (count(*) FILTER (label = 0))::DOUBLE, 3) AS class_ratio, round(avg(n), 2) AS avg_tokens,
  round(avg(n) FILTER (label = 1), 2) AS avg_tokens_positive, round(avg(n) FILTER (label = 0), 2) AS avg_tokens_negative,
  max(n) AS max_tokens, min(n) AS min_tokens FROM lengths)"""
TERMS = """words AS (SELECT count(*) AS n, count(*) FILTER (contains(term, ' ')) AS two,
  sum(strlen(term) + 16) / 1048576.0 AS size_mb FROM weights),
sizes_of AS (SELECT n AS vocabulary_size, n - two AS unigram_count, two AS bigram_count, round(two * 100.0 / n, 2) AS bigram_pct
  FROM words),
sides AS (SELECT 'positive' AS side, row_number() OVER (ORDER BY coef DESC, term) AS rank, term, coef FROM weights
  UNION ALL SELECT 'negative', row_number() OVER (ORDER BY coef, term), term, coef FROM weights)"""
# The sweep names its ends too.
OVERLAP = histogram(100, False).replace("\nends AS", "\nclass_ends AS").replace("FROM ends,", "FROM class_ends,")
BY_FOLD = f"""fold_cells AS (SELECT doc_id % 5 + 1 AS fold, count(*) FILTER (label = 1 AND predicted = 1) AS tp,
  count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
  count(*) FILTER (label = 1 AND predicted = 0) AS fn FROM predicted GROUP BY 1),
fold_pr AS (
  SELECT fold, {S.ratio('tn', 'tn + fn')} AS precision, {S.ratio('tn', 'tn + fp')} AS recall, tn + fp AS support FROM fold_cells
  UNION ALL
  SELECT fold, {S.ratio('tp', 'tp + fp')}, {S.ratio('tp', 'tp + fn')}, tp + fn FROM fold_cells),
fold_report AS (SELECT *, {S.ratio('2.0 * precision * recall', 'precision + recall')} AS f1 FROM fold_pr),
fold_values AS (SELECT fold, sum(recall * support) / sum(support) AS accuracy, avg(f1) AS f1_macro,
  sum(f1 * support) / sum(support) AS f1_weighted, avg(precision) AS precision_macro, avg(recall) AS recall_macro
  FROM fold_report GROUP BY fold),
fold_long AS (SELECT fold, metric, value FROM fold_values UNPIVOT (value FOR metric IN ({', '.join(FOLDED)})))"""


@query(
    f"""{P}, {AVERAGES}, {STEPS}, {SWEEP}, {OVERLAP}, {BY_BIN}, {RATES}, {QUALITIES}, {AREAS}, {NAMED}, {CORPUS},
{TERMS}, {BY_FOLD}, spread AS (SELECT sum(low) / 100 AS score_overlap FROM by_bin)
{unpivot('classification', 'quality', ('accuracy', 'accuracy_pct', 'macro_f1', 'weighted_f1', 'weighted_precision',
                                       'weighted_recall', 'positive_f1', 'negative_f1')).replace('round(value, 4)', "CASE WHEN key = 'accuracy_pct' THEN round(value, 2) ELSE round(value, 4) END")}
UNION ALL {unpivot('confusion_matrix', 'rates', ('tp', 'tn', 'fp', 'fn', 'tpr', 'fpr', 'tnr', 'fnr'))}
UNION ALL {unpivot('ranking', 'areas', ('roc_auc', 'average_precision', 'baseline'))}
UNION ALL {unpivot('ranking', 'spread', ('score_overlap',))}
UNION ALL {unpivot('threshold', 'best', [f'best_{c}' for c in QUALITY])}
UNION ALL {unpivot('threshold', 'deployed', [f'deployed_{c}' for c in QUALITY])}
UNION ALL {unpivot('dataset', 'dataset', ('n_total', 'n_positive', 'n_negative', 'class_ratio', 'avg_tokens',
                                          'avg_tokens_positive', 'avg_tokens_negative', 'max_tokens', 'min_tokens'))}
UNION ALL {unpivot('vocabulary', 'sizes_of', ('vocabulary_size', 'unigram_count', 'bigram_count', 'bigram_pct'))}
UNION ALL {unpivot('model', 'words', ('size_mb',), 2)}
UNION ALL SELECT 'features', side || '_' || lpad(rank::VARCHAR, 2, '0'), round(coef, 4), term FROM sides WHERE rank <= 10
UNION ALL SELECT 'cross_validation', metric || '.fold_' || fold, round(value, 4), NULL FROM fold_long
UNION ALL SELECT 'cross_validation', metric || '.mean', round(avg(value), 4), NULL FROM fold_long GROUP BY metric
UNION ALL SELECT 'cross_validation', metric || '.std', round(stddev_pop(value), 4), NULL FROM fold_long GROUP BY metric
UNION ALL SELECT 'model_config', 'C', 1.0, NULL
UNION ALL SELECT 'model_config', 'class_weight', NULL, 'balanced'"""
)
def metrics_document(t):
    """All parts but the latency, which is another number each time. The folds judge one given model; see ``cross_validate``
    for those that train."""
    folds = M.averaged_metrics(t.predicted.withColumn("fold", F.col("doc_id") % 5 + 1), by=["fold"]).select("fold", *FOLDED)
    return D.metrics_document(t.scored, t.training, t.weights, folds, settings={"C": 1.0, "class_weight": "balanced"})


def deduped(t):
    """Cleaned and compared once: every later pass reads what was written."""
    return stored(dedupe_labelled(t.training).withColumn("doc", F.md5("text")))


@query()
def train_linear(t):
    """Quality of a trained classifier on its held-out part."""
    parts = stratified_split(deduped(t), "label", "doc")
    weights, intercept = T.fit_classifier(parts.filter("split = 'train'"), "doc")
    return M.averaged_metrics(T.predict(parts.filter("split = 'test'"), weights, intercept))


@query()
def cross_validate(t):
    return T.cross_validate(deduped(t), "doc")


@query(
    f"""WITH {S.LABELLED}, deduped AS (SELECT text, min(label) AS label, md5(text) AS doc FROM labelled WHERE text <> ''
  GROUP BY text HAVING count(DISTINCT label) = 1),
folded AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(doc || '|42'), doc) - 1) % 5 + 1 AS own FROM deduped),
toks AS (SELECT doc, own, {S.word_tokens('strip_accents(text)')} AS t FROM folded),
counted AS (SELECT doc, own, term, count(*) AS tf FROM (SELECT doc, own, unnest({S.ngrams('t')}) AS term FROM toks) GROUP BY ALL),
by_term AS (SELECT own, term, count(*) AS df, sum(tf) AS cf FROM counted GROUP BY ALL),
folds AS (SELECT unnest(range(1, 6)) AS fold),
sums AS (SELECT fold, term, sum(df)::BIGINT AS df, sum(cf)::BIGINT AS cf FROM by_term JOIN folds ON own <> fold GROUP BY ALL)
SELECT fold::INT AS fold, term, df, cf FROM sums WHERE df >= 2
QUALIFY row_number() OVER (PARTITION BY fold ORDER BY cf DESC, term) <= 10000"""
)
def fold_vocabularies(t):
    return T.fold_vocabularies(deduped(t), "doc")


@query()
def learning_curve(t):
    return T.learning_curve(deduped(t), "doc")
