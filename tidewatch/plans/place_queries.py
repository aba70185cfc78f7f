"""Places, geocoding and the gazetteer."""

from pyspark.sql import functions as F

from ..functions.text import distinct_keep_order as distinct_words, keep_entity_types as keep_types
from ..functions.hooks import sequence_ratio as ratio_of
from ..operators import gazetteer as B, places as P
from . import sql as S
from .registry import query

G = f"WITH {S.GAZETTEER}, {S.PLACE_REFS}"

# Nation names and one-word colours as places, mentioned in part names and comments.
PHRASES = """keys AS (SELECT DISTINCT lower(p_name) AS key FROM part WHERE p_partkey % 2 = 0
  UNION SELECT DISTINCT split_part(lower(p_name), ' ', 1) FROM part WHERE p_size > 40),
notes AS (SELECT p_partkey AS id, p_name || ', ' || p_type || ' ' || p_name || ' and ' || p_brand AS note FROM part)"""


def phrase_keys(t):
    part = t.read("part")
    whole = part.filter("p_partkey % 2 = 0").select(F.lower("p_name").alias("key"))
    first = part.filter("p_size > 40").select(F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)).alias("key"))
    return whole.union(first).distinct()


def notes(t):
    text = F.concat("p_name", F.lit(", "), "p_type", F.lit(" "), "p_name", F.lit(" and "), "p_brand")
    return t.read("part").select(F.col("p_partkey").alias("id"), text.alias("note"))


@query(
    f"""WITH RECURSIVE {PHRASES},
words AS (SELECT id, string_split({S.clean('note')}, ' ') AS w FROM notes),
hits AS (
  SELECT id, i, n, key FROM (
    SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (
      SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM words), range(1, 4) r(n) WHERE i + n - 1 <= len(w))
  JOIN keys ON key = phrase),
best AS (SELECT id, i, max(n) AS n, arg_max(key, n) AS key FROM hits GROUP BY id, i),
walk AS (
  SELECT id, 1 AS free, 0 AS step, NULL::VARCHAR AS key, 0 AS spot FROM notes
  UNION ALL
  SELECT w.id, (b.i + b.n)::INT, w.step + 1, b.key, b.i::INT FROM walk w JOIN best b ON b.id = w.id
  WHERE b.i = (SELECT min(i) FROM best x WHERE x.id = w.id AND x.i >= w.free)),
firsts AS (SELECT id, key, min(spot) AS spot FROM walk WHERE key IS NOT NULL GROUP BY id, key)
SELECT n.id, coalesce(string_agg(key, '|' ORDER BY spot), '') AS places FROM notes n LEFT JOIN firsts f USING (id)
GROUP BY n.id"""
)
def extract_places(t):
    found = P.extract_places(notes(t), "id", "note", phrase_keys(t))
    return found.select("id", F.array_join("locations", "|").alias("places"))


@query(
    """WITH e AS (SELECT event_id, event_type || '##' AS word, CASE user_id % 4 WHEN 0 THEN 'loc' WHEN 1 THEN 'PER'
  WHEN 2 THEN 'b-gpe' ELSE 'ORG' END AS g FROM events)
SELECT event_id, CASE WHEN upper(g) IN ('LOC', 'B-GPE') THEN replace(word, '##', '') ELSE '' END AS words FROM e"""
)
def keep_entity_types(t):
    kind = (
        F.when(F.col("user_id") % 4 == 0, "loc").when(F.col("user_id") % 4 == 1, "PER")
        .when(F.col("user_id") % 4 == 2, "b-gpe").otherwise("ORG")
    )
    entity = F.struct(
        kind.alias("entity_group"), F.concat("event_type", F.lit("##")).alias("word"), F.lit(0.9).alias("score")
    )
    tagged = t.read("events").select("event_id", F.array(entity).alias("entities"))
    return tagged.select("event_id", F.array_join(keep_types("entities"), "|").alias("words"))


@query(
    f"""WITH {S.GAZETTEER}, {S.PLACE_REFS}, x AS (
  SELECT incident, unnest(list_concat(locations, [upper(locations[1])])) AS loc,
    generate_subscripts(list_concat(locations, [upper(locations[1])]), 1) AS pos FROM place_refs),
f AS (SELECT incident, arg_min(loc, pos) AS loc, min(pos) AS pos FROM x GROUP BY incident, lower(loc))
SELECT incident, string_agg(loc, '|' ORDER BY pos) AS names FROM f GROUP BY incident"""
)
def distinct_keep_order(t):
    doubled = F.concat("locations", F.array(F.upper(F.element_at("locations", 1))))
    return t.place_refs.select("incident", F.array_join(distinct_words(doubled), "|").alias("names"))


REFS = "refs AS (SELECT incident, unnest(locations) AS loc, generate_subscripts(locations, 1) - 1 AS pos FROM place_refs)"


@query(
    f"""{G}, {REFS} SELECT incident, pos, loc, lat, lng, full_name FROM refs
LEFT JOIN gazetteer ON key = lower(trim(loc))"""
)
def lookup_exact(t):
    refs = t.place_refs.select("incident", F.posexplode("locations").alias("pos", "loc"))
    return P.lookup_exact(refs, "loc", t.gazetteer)


EDITS = f"""names AS (SELECT DISTINCT lower(trim(loc)) AS name FROM refs WHERE trim(loc) <> ''),
pairs AS (SELECT name, key, 1.0 - levenshtein(name, key)::DOUBLE / greatest(length(name), length(key)) AS s
  FROM names, gazetteer),
close AS (SELECT name, max((s, key)) AS b FROM pairs WHERE s >= 0.6 GROUP BY name)"""


@query(f"{G}, {REFS}, {EDITS} SELECT name AS loc, b[2] AS match, round(b[1], 6) AS similarity FROM close")
def lookup_fuzzy(t):
    refs = t.place_refs.select(F.explode("locations").alias("loc"))
    best = P.lookup_fuzzy(refs, "loc", t.gazetteer, metric="levenshtein")
    return best.withColumn("similarity", F.round("similarity", 6))


# The matching-blocks ratio by definition: the longest common block, the first one in the key, then in the name; the same
# again to its left and right; twice the matched letters over all letters.
RATIOS = f"""names AS (SELECT DISTINCT lower(trim(loc)) AS name FROM refs WHERE trim(loc) <> ''),
blocks(name, key, matched, ka, kb, na, nb) AS (
  SELECT name, key, 0, 1, length(key) + 1, 1, length(name) + 1 FROM names, gazetteer
  UNION ALL SELECT name, key, CASE side WHEN 0 THEN b.n ELSE 0 END, CASE side WHEN 0 THEN ka ELSE b.n - b.i END,
    CASE side WHEN 0 THEN -b.i ELSE kb END, CASE side WHEN 0 THEN na ELSE b.n - b.j END, CASE side WHEN 0 THEN -b.j ELSE nb END
  FROM (SELECT name, key, ka, kb, na, nb, max({{'n': n, 'i': -i, 'j': -j}}) AS b
    FROM (SELECT *, unnest(range(1, least(kb - i, nb - j) + 1)) AS n FROM (
      SELECT *, unnest(range(na, nb)) AS j FROM (SELECT *, unnest(range(ka, kb)) AS i FROM blocks)))
    WHERE substr(key, i::BIGINT, n::BIGINT) = substr(name, j::BIGINT, n::BIGINT) GROUP BY name, key, ka, kb, na, nb), (VALUES (0), (1)) AS x(side)),
pairs AS (SELECT name, key, 2.0::DOUBLE * sum(matched) / (length(name) + length(key)) AS s FROM blocks GROUP BY name, key),
close AS (SELECT name, max((s, key)) AS b FROM pairs WHERE s >= 0.6 GROUP BY name)"""
GR = G.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{GR}, {REFS}, {RATIOS} SELECT name AS loc, b[2] AS match, round(b[1], 6) AS similarity FROM close")
def lookup_fuzzy_ratio(t):
    refs = t.place_refs.select(F.explode("locations").alias("loc"))
    return P.lookup_fuzzy(refs, "loc", t.gazetteer).withColumn("similarity", F.round("similarity", 6))


@query()
def sequence_ratio(t):
    pairs = t.read("part").select("p_partkey", "p_name", "p_type")
    return pairs.withColumn("ratio", F.round(ratio_of("p_type", "p_name"), 6))


RESOLVED = """known AS (
  SELECT incident, pos, coalesce(e.lat, f.lat) AS lat, coalesce(e.lng, f.lng) AS lng,
    CASE WHEN e.key IS NOT NULL THEN e.full_name ELSE f.full_name END AS full_name
  FROM refs LEFT JOIN gazetteer e ON e.key = lower(trim(loc))
  LEFT JOIN close ON name = lower(trim(loc)) LEFT JOIN gazetteer f ON f.key = close.b[2]),
firsts AS (SELECT incident, arg_min((lat, lng, full_name), pos) AS h FROM known WHERE lat IS NOT NULL GROUP BY incident),
located AS (SELECT p.incident, h[1] AS lat, h[2] AS lng, h[3] AS resolved_location FROM place_refs p LEFT JOIN firsts USING (incident))"""


def located(t):
    return P.geocode(t.place_refs, "incident", "locations", t.gazetteer, metric="levenshtein")


@query(f"{GR}, {REFS}, {RATIOS}, {RESOLVED} SELECT * FROM located")
def geocode_by_ratio(t):
    """With the default metric."""
    placed = P.geocode(t.place_refs, "incident", "locations", t.gazetteer)
    return placed.select("incident", "lat", "lng", "resolved_location")


@query(f"{G}, {REFS}, {EDITS}, {RESOLVED} SELECT * FROM located")
def geocode(t):
    return located(t).select("incident", "lat", "lng", "resolved_location")


@query(
    f"""{G}, {REFS} SELECT incident, arg_min(lat, pos) AS lat, arg_min(lng, pos) AS lng,
  arg_min(full_name, pos) AS resolved_location FROM refs JOIN gazetteer ON key = lower(trim(loc)) GROUP BY incident"""
)
def first_resolved(t):
    refs = t.place_refs.select("incident", F.posexplode("locations").alias("pos", "loc"))
    return P.first_resolved(P.lookup_exact(refs, "loc", t.gazetteer), "incident")


@query(
    f"""{G}, {REFS}, {EDITS}, {RESOLVED} SELECT count(lat) AS geocoded, count(*) AS incidents,
  (SELECT count(*) FROM gazetteer) AS coverage FROM located"""
)
def geocode_coverage(t):
    return P.geocode_coverage(located(t), t.gazetteer)


# Aliases: supplier names ask for a nation; the key repeats, and later rows win.
ALIASES = """aliases AS (
  SELECT 'Area_' || (s_suppkey % 60) AS key, 'nation_' || (s_nationkey + s_suppkey % 3) AS query, s_suppkey AS seq
  FROM supplier),
coords AS (
  SELECT lower(n_name) AS query, 8.123456789 + n_nationkey / 7.0 AS lat, 77.98765432 - n_nationkey / 7.0 AS lng,
    n_name AS full_name FROM nation),
canonical AS (SELECT lower(key) AS key, arg_max(query, seq) AS query FROM aliases GROUP BY lower(key)),
built AS (SELECT key, query, round(lat, 6) AS lat, round(lng, 6) AS lng, full_name FROM canonical JOIN coords USING (query)),
before_run AS (SELECT * FROM built WHERE length(key) < 7)"""


def aliases(t):
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    return t.read("supplier").select(
        F.concat(F.lit("Area_"), (k % 60).cast("string")).alias("key"),
        F.concat(F.lit("nation_"), (n + k % 3).cast("string")).alias("query"),
        k.alias("seq"),
    )


def coords(t):
    n = F.col("n_nationkey")
    return t.read("nation").select(
        F.lower("n_name").alias("query"),
        (F.lit(8.123456789) + n / 7.0).alias("lat"),
        (F.lit(77.98765432) - n / 7.0).alias("lng"),
        F.col("n_name").alias("full_name"),
    )


def before_run(t):
    return B.build_gazetteer(aliases(t), coords(t)).filter("length(key) < 7")


@query(f"WITH {ALIASES} SELECT key, lat, lng, full_name FROM built")
def build_gazetteer(t):
    return B.build_gazetteer(aliases(t), coords(t))


@query(f"WITH {ALIASES} SELECT key, query FROM canonical WHERE key NOT IN (SELECT key FROM before_run)")
def resume_gazetteer(t):
    return B.resume_gazetteer(before_run(t), B.canonical_aliases(aliases(t)))


@query(
    f"""WITH {ALIASES} SELECT count(*) FILTER (b.key IS NULL AND a.key IS NOT NULL) AS resolved, count(b.key) AS skipped,
  count(*) FILTER (a.key IS NULL) AS failed, count(*) AS wanted
FROM canonical c LEFT JOIN before_run b ON b.key = c.key LEFT JOIN built a ON a.key = c.key"""
)
def gazetteer_report(t):
    wanted, before = B.canonical_aliases(aliases(t)), before_run(t)
    return B.gazetteer_report(wanted, before, B.build_gazetteer(aliases(t), coords(t)))


@query(f"WITH {ALIASES} SELECT key, query FROM canonical WHERE key NOT IN (SELECT key FROM built)")
def failed_aliases(t):
    wanted = B.canonical_aliases(aliases(t))
    return B.failed_aliases(wanted, before_run(t), B.build_gazetteer(aliases(t), coords(t)))
