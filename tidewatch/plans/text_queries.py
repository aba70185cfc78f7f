"""Text functions over whole tables."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.files import first_field, resolve_columns
from . import sql as S
from .registry import query
from .tables import Tables

ALL_TEXTS = """texts AS (
  SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages)"""


def all_texts(t: Tables):
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = t.read("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages)


@query(f"WITH {ALL_TEXTS} SELECT id, {S.clean('text')} AS cleaned FROM texts")
def clean_text(t):
    return all_texts(t).select("id", X.clean_text("text").alias("cleaned"))


@query(
    f"WITH x AS (SELECT conv_id, turn, text, {S.clean('text')} AS cleaned FROM conversations) "
    "SELECT * FROM x WHERE cleaned <> ''"
)
def keep_nonempty(t):
    return X.keep_nonempty(t.read("conversations").select("conv_id", "turn", "text"), "text", "cleaned")


@query(f"SELECT doc_id, array_to_string({S.ws_tokens('text')}, '|') AS tokens FROM documents")
def ws_tokens(t):
    return t.documents.select("doc_id", F.array_join(X.ws_tokens("text"), "|").alias("tokens"))


@query(f"WITH {S.LABELLED} SELECT doc_id, array_to_string({S.word_tokens('text')}, '|') AS tokens FROM labelled")
def word_tokens(t):
    return t.labelled.select("doc_id", F.array_join(X.word_tokens("text"), "|").alias("tokens"))


@query(f"WITH {S.LABELLED} SELECT doc_id, strip_accents(text) AS plain FROM labelled")
def strip_accents(t):
    return t.labelled.select("doc_id", X.strip_accents("text").alias("plain"))


@query(
    f"WITH {S.LABELLED}, toks AS (SELECT doc_id, {S.word_tokens('strip_accents(text)')} AS t FROM labelled) "
    f"SELECT doc_id, len({S.ngrams('t')}) AS n_terms, array_to_string({S.ngrams('t')}, '|') AS terms FROM toks"
)
def ngrams(t):
    rows = t.labelled.select("doc_id", X.terms("text").alias("g"))
    return rows.select("doc_id", F.size("g").alias("n_terms"), F.array_join("g", "|").alias("terms"))


RAW_LABELS = """raw_labels AS (
  SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN ' Related and informative ' WHEN quality = 1 THEN
    'Related - but not informative' WHEN toxic = 1 THEN 'NOT RELATED' WHEN doc_id % 2 = 0 THEN 'Not applicable'
    WHEN doc_id % 3 = 0 THEN NULL ELSE 'Unsure' END AS raw_label FROM labels)"""

MAPPED = """CASE lower(trim({c})) WHEN 'related and informative' THEN 1 WHEN 'related - but not informative' THEN 1
  ELSE 0 END"""


def raw_labels(t: Tables):
    """Textual labels as the event files spell them."""
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    label = (
        F.when(good & ~bad, " Related and informative ")
        .when(good, "Related - but not informative")
        .when(bad, "NOT RELATED")
        .when(F.col("doc_id") % 2 == 0, "Not applicable")
        .when(F.col("doc_id") % 3 == 0, F.lit(None))
        .otherwise("Unsure")
    )
    return t.read("labels").select("doc_id", label.alias("raw_label"))


@query(f"WITH {RAW_LABELS} SELECT doc_id, raw_label, {MAPPED.format(c='raw_label')} AS label FROM raw_labels")
def map_label(t):
    return raw_labels(t).withColumn("label", X.map_label("raw_label"))


@query(
    "WITH x AS (SELECT p_partkey, trim(replace(trim(' ' || p_name || '## ' || left(p_brand, p_size % 2)), '##', '')) "
    "AS w FROM part) SELECT p_partkey, CASE WHEN length(w) > 1 THEN w END AS word FROM x"
)
def clean_entity(t):
    marked = F.concat(F.lit(" "), "p_name", F.lit("## "), F.substring("p_brand", F.lit(1), F.col("p_size") % 2))
    return t.read("part").select("p_partkey", X.clean_entity(marked).alias("word"))


@query(
    "SELECT doc_id, left(text, 512) AS tagger_input, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' "
    "ELSE text END AS popup FROM documents"
)
def char_prefix(t):
    return t.documents.select(
        "doc_id", X.char_prefix("text", 512).alias("tagger_input"), X.char_prefix("text", 100, "...").alias("popup")
    )


@query(
    f"SELECT doc_id, {S.has_keyword('text', S.WORDS)} AS hit, {S.has_keyword(S.clean('text'), S.WORDS)} AS hit_clean "
    "FROM documents"
)
def has_keyword(t):
    return t.documents.select(
        "doc_id",
        X.has_keyword("text", S.WORDS).alias("hit"),
        X.has_keyword("text", S.WORDS, normalise=True).alias("hit_clean"),
    )


@query(
    "SELECT p_partkey, 'INCIDENT ' || p_partkey || ' [' || p_brand || '] at ' || coalesce(CASE WHEN p_size > 25 THEN "
    "p_type END, 'Unknown location') || ': ' || p_name || ' (' || p_size || ' reports)' AS line FROM part"
)
def incident_line(t):
    place = F.when(F.col("p_size") > 25, F.col("p_type"))
    return t.read("part").select(
        "p_partkey", X.incident_line("p_partkey", F.col("p_brand"), place, "p_name", "p_size").alias("line")
    )


@query(
    "SELECT vec_id, 'c_' || CASE WHEN vec_id < 1000 THEN lpad(vec_id::VARCHAR, 3, '0') ELSE vec_id::VARCHAR END "
    "AS cluster, 'singleton_' || md5(vec_id::VARCHAR)[1:8] AS singleton FROM embeddings"
)
def identifiers(t):
    return t.read("embeddings").select(
        "vec_id", X.cluster_name("vec_id").alias("cluster"), X.singleton_name("vec_id").alias("singleton")
    )


@query(f"SELECT event_id, {S.iso('ts')} AS ts_iso FROM events")
def iso_time(t):
    return t.read("events").select("event_id", X.iso_time("ts").alias("ts_iso"))


@query(f"SELECT doc_id, length(text) AS n_char, len({S.ws_tokens('text')}) AS n_token FROM documents")
def text_lengths(t):
    return X.text_lengths(t.documents.select("doc_id", "text"), "text").drop("text")


@query(
    "SELECT text AS raw_text, item_id AS label FROM benchmark",
    name="resolve_columns",
)
def resolve_names(t):
    renamed = t.read("benchmark").select(F.col("item_id").alias("Target"), F.col("text").alias("TWEET"))
    return resolve_columns(renamed, "generic")


@query(
    rf"""WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
cut AS (
  SELECT doc_id, regexp_replace(split_part(regexp_replace(line, '^[{S.BLANK}]+|[{S.BLANK}]+$', '', 'g'), ',', 1),
    '^"|"$', '', 'g') AS head FROM lines),
posts AS (SELECT doc_id, regexp_replace(head, '^[{S.BLANK}]+|[{S.BLANK}]+$', '', 'g') AS post FROM cut)
SELECT doc_id, post FROM posts WHERE length(post) > 5""",
    name="read_posts_legacy",
)
def legacy_lines(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", first_field("line").alias("post")).filter(F.length("post") > 5)
