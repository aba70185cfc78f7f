"""Pieces of SQL shared by the counterparts of the queries."""

WORD = r"[\p{L}\p{N}_]"
BLANK = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def clean(c: str) -> str:
    text = f"regexp_replace(lower({c}), 'http[^{BLANK}]+|www[^{BLANK}]+', '', 'g')"
    text = f"regexp_replace({text}, '@{WORD}+', '', 'g')"
    for seen, put in (("#", ""), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{seen}', '{put}')"
    return rf"coalesce(trim(regexp_replace({text}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), '')"


def ws_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[{BLANK}]+'), lambda t: t <> '')"


def word_tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '{WORD}{{2,}}')"


def ngrams(tokens: str) -> str:
    """One- and two-word phrases of a list column."""
    pairs = f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1])"
    return f"list_concat({tokens}, {pairs})"


def has_keyword(c: str, words) -> str:
    wanted = ", ".join(f"'{w}'" for w in words)
    return f"list_has_any(regexp_split_to_array(lower({c}), '[{BLANK}]+'), [{wanted}])"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END)"


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"


ALIKE, DIM = 5, 64

POSTS = f"""posts AS (
  SELECT e.event_id::VARCHAR AS post_id, e.event_id AS seq, coalesce(d.text, '') AS text, e.ts,
    coalesce(v.embedding::DOUBLE[], list_transform(range({DIM}), lambda i: 0.0::DOUBLE)) AS embedding, v.label
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
  LEFT JOIN embeddings v ON v.vec_id = (e.event_id // {ALIKE}) % (SELECT count(*) FROM embeddings))"""

LABELLED = f"""labelled AS (
  SELECT doc_id, source, raw_text, label, {clean('raw_text')} AS text FROM (
    SELECT d.doc_id, d.source, d.text AS raw_text, coalesce(l.quality, 0) AS label
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))"""

DOC_TERMS = f"""toks AS (SELECT doc_id, label, {word_tokens('strip_accents(text)')} AS t FROM labelled WHERE text <> ''),
doc_terms AS (
  SELECT doc_id, label, term, count(*) AS tf
  FROM (SELECT doc_id, label, unnest({ngrams('t')}) AS term FROM toks) GROUP BY ALL)"""

VOCABULARY = """vocabulary AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM doc_terms
  GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 10000),
n_docs AS (SELECT count(*) AS n FROM toks),
idf AS (SELECT *, ln((n + 1.0) / (df + 1.0)) + 1.0 AS idf FROM vocabulary, n_docs)"""

# Weights any engine can compute: how much more often a term occurs in positive texts.
WEIGHTS = """sizes AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM toks),
contrast AS (
  SELECT term, 10.0 * (count(*) FILTER (label = 1) / n1::DOUBLE - count(*) FILTER (label = 0) / n0::DOUBLE) AS coef
  FROM doc_terms, sizes GROUP BY term, n1, n0),
weights AS (SELECT i.term, i.idf, c.coef FROM idf i JOIN contrast c USING (term))"""

TFIDF = """raw_w AS (
  SELECT doc_id, term, (ln(tf) + 1.0) * idf AS w FROM doc_terms JOIN idf USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw_w GROUP BY doc_id),
tfidf AS (SELECT doc_id, term, w / norm AS w FROM raw_w JOIN norms USING (doc_id))"""

INTERCEPT = 0.05

SCORED = f"""scored AS (
  SELECT l.doc_id, l.label, l.raw_text, round(coalesce(s.s, 0.0) + {INTERCEPT}, 6) AS score
  FROM labelled l LEFT JOIN (
    SELECT doc_id, sum(w * coef) AS s FROM tfidf JOIN weights USING (term) GROUP BY doc_id) s USING (doc_id)
  WHERE l.text <> '')"""

FEATURES = ",\n".join([LABELLED, DOC_TERMS, VOCABULARY])
MODEL = ",\n".join([FEATURES, WEIGHTS])
SCORES = ",\n".join([MODEL, TFIDF, SCORED])
PREDICTED = SCORES + ",\npredicted AS (SELECT *, (score > 0)::INT AS predicted FROM scored)"

WORDS = ("thing", "thble", "attion")
EPS = 0.6
MINUTES = 360

ACTIVE = f"""{POSTS},
clock AS (SELECT max(ts) AS as_of FROM posts),
active AS (SELECT posts.*, as_of FROM posts, clock WHERE ts >= as_of - INTERVAL {MINUTES} MINUTE)"""


def unit(table: str, out: str) -> str:
    return f"""{out} AS (
  SELECT *, list_transform(embedding, lambda e: e / CASE WHEN norm = 0 THEN 1 ELSE norm END) AS u
  FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda e: e * e))) AS norm FROM {table}))"""


# Density clustering by definition: all pairs, core points, reachability between cores.
def clusters(table: str, eps: float = EPS, min_samples: int = 2) -> str:
    return f"""{unit(table, 'unit_posts')},
near AS (
  SELECT a.seq AS i, b.seq AS j FROM unit_posts a JOIN unit_posts b ON a.seq <> b.seq
  WHERE 1.0 - list_dot_product(a.u, b.u) <= {eps}),
degree AS (SELECT p.seq, count(n.j) AS neighbours FROM {table} p LEFT JOIN near n ON n.i = p.seq GROUP BY p.seq),
core AS (SELECT seq FROM degree WHERE neighbours + 1 >= {min_samples}),
core_edges AS (SELECT i, j FROM near WHERE i IN (SELECT seq FROM core) AND j IN (SELECT seq FROM core)),
reach AS (
  SELECT seq AS i, seq AS j FROM core
  UNION SELECT r.i, e.j FROM reach r JOIN core_edges e ON e.i = r.j),
core_cluster AS (SELECT i AS seq, min(j) AS cluster FROM reach GROUP BY i),
border AS (
  SELECT n.i AS seq, min(c.cluster) AS cluster FROM near n JOIN core_cluster c ON c.seq = n.j
  WHERE n.i NOT IN (SELECT seq FROM core) GROUP BY n.i),
clustered AS (
  SELECT p.*, coalesce(c.cluster, b.cluster) AS cluster, c.seq IS NOT NULL AS is_core
  FROM {table} p LEFT JOIN core_cluster c USING (seq) LEFT JOIN border b USING (seq))"""


# From members(incident, lone, seq, post_id, text, ts, embedding) to scored incidents.
def summary(members: str = "members", minutes: float = MINUTES, words=WORDS) -> str:
    return f"""{unit(members, 'unit_members')},
sums AS (
  SELECT incident, sum(s * s) AS square FROM (
    SELECT incident, dim, sum(x) AS s FROM (
      SELECT incident, unnest(u) AS x, generate_subscripts(u, 1) AS dim FROM unit_members) GROUP BY incident, dim)
  GROUP BY incident),
facts AS (
  SELECT incident, any_value(lone) AS lone, count(*) AS post_count, min(ts) AS first_seen, max(ts) AS last_seen,
    arg_min(post_id, seq) AS first_post,
    arg_min(text, (-length(text), seq)) AS representative_text,
    avg(({has_keyword('text', words)})::INT) AS keyword_weight,
    sum(list_sum(list_transform(u, lambda e: e * e))) AS own
  FROM unit_members GROUP BY incident),
weighed AS (
  SELECT facts.*,
    CASE WHEN post_count = 1 THEN 0.5 ELSE (square - own) / (post_count * (post_count - 1)) END AS density,
    greatest(0.0, 1.0 - date_diff('microsecond', last_seen, as_of) / 1e6 / ({minutes} * 60.0)) AS recency_weight
  FROM facts JOIN sums USING (incident), clock),
scored_incidents AS (
  SELECT *, least(greatest(0.4 * keyword_weight + 0.4 * density + 0.2 * recency_weight, 0.0), 1.0) AS urgency_score
  FROM weighed),
incidents AS (
  SELECT *, CASE WHEN urgency_score >= 0.7 THEN 'CRITICAL' WHEN urgency_score >= 0.4 THEN 'HIGH' ELSE 'MODERATE' END
      AS urgency_label,
    md5(first_post) AS incident_key,
    CASE WHEN lone THEN 'singleton_' || md5(first_post)[1:8]
      ELSE 'c_' || CASE WHEN length((no)::VARCHAR) < 3 THEN lpad((no)::VARCHAR, 3, '0') ELSE (no)::VARCHAR END END
      AS cluster_id
  FROM (SELECT *, row_number() OVER (PARTITION BY lone ORDER BY incident) - 1 AS no FROM scored_incidents))"""


INCIDENTS = f"""{ACTIVE},
{clusters('active')},
members AS (SELECT *, coalesce(cluster, seq) AS incident, cluster IS NULL AS lone FROM clustered),
{summary()}"""

# The minimum slice: the given label is the incident.
GIVEN = f"""{ACTIVE},
members AS (SELECT *, label AS incident, false AS lone FROM active),
{summary()}"""

# A gazetteer from the nations, and place names per order: exact, misspelt, unknown, repeated.
GAZETTEER = """gazetteer AS (
  SELECT lower(n_name) AS key, 8 + 0.25 * n_nationkey AS lat, 77 + 0.25 * n_nationkey AS lng,
    n_name || ', region ' || n_regionkey AS full_name FROM nation)"""

PLACE_REFS = """place_refs AS (
  SELECT c_custkey AS incident, [
      CASE WHEN c_custkey % 3 = 0 THEN 'Nowhere at all' ELSE 'Natoin_' || (c_custkey % 40)::VARCHAR END,
      ' Nation_' || c_nationkey::VARCHAR || ' ',
      'NATION_' || c_nationkey::VARCHAR] AS locations
  FROM customer)"""

TIERS = "CASE urgency_label WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, post_count DESC, urgency_score DESC, lone, incident"
