"""File sources and sinks."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.errors import AnalysisException

from ..functions.text import BLANKS, clean_text, map_label
from ..schemas import PLACE, require_columns
from ..session import settle

EVENT_FILES = "*-tweets_labeled.csv"
MIN_POST_CHARS = 5
HEADER_READERS = 16  # headers of files read at the same time
SHARED_BLOCKS = 1_000_000  # blocks of files whose starts are sent to every task


def _csv(spark: SparkSession):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")


def trim_blanks(c) -> Column:
    """Trim every kind of blank, not only the space."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", "")


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """``raw_text, text, label`` of a labelled CSV with a header; emptied texts are dropped. Its columns ``text`` and
    ``target`` are found by name, wherever they stand and whatever else is there."""
    rows = require_columns(_csv(spark).csv(path), ["text", "target"])
    return (
        rows.select(F.col("text").alias("raw_text"), F.col("target").cast("int").alias("label"))
        .withColumn("text", clean_text("raw_text"))
        .filter(F.length("text") > 0)
    )


def first_name(columns, accepts) -> str | None:
    return next((c for c in columns if accepts(c.lower())), None)


# Which column holds the text and which the label, per kind of table.
COLUMN_RULES = {
    "events": (lambda c: "tweet" in c and "text" in c, lambda c: "informative" in c),
    "generic": (lambda c: c in ("text", "tweet", "content"), lambda c: c in ("target", "label", "class")),
}


def find_columns(columns, rules: str = "generic") -> tuple[str, str] | None:
    """Names of the text and the label column, or None if the table lacks one of them. Names
    are compared without case; the first fitting one counts."""
    text_rule, label_rule = COLUMN_RULES[rules]
    text, label = first_name(columns, text_rule), first_name(columns, label_rule)
    return None if text is None or label is None else (text, label)


def resolve_columns(df: DataFrame, rules: str = "generic") -> DataFrame | None:
    """``raw_text, label`` under whatever names the table uses, or None."""
    found = find_columns(df.columns, rules)
    if found is None:
        return None
    return df.select(F.col(f"`{found[0]}`").alias("raw_text"), F.col(f"`{found[1]}`").alias("label"))


def read_event_label_csvs(spark: SparkSession, root: str) -> DataFrame:
    """All label files below ``root`` with their event name.

    Files are grouped by their header line, and each group is one scan. A header costs the first lines of its file, not
    a pass over it. Groups without the needed columns are skipped; no usable file at all is an error.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", EVENT_FILES).text(root)
    groups: dict[str, list[str]] = {}
    files = sorted(found.inputFiles())
    with ThreadPool(HEADER_READERS) as pool:
        heads = pool.map(inheritable_thread_target(spark)(lambda file: spark.read.text(file).first()), files)
    for file, head in zip(files, heads):
        if head is not None:
            groups.setdefault(head.value, []).append(file)
    tables = []
    for paths in groups.values():
        table = _csv(spark).csv(paths)
        found = find_columns(table.columns, "events")
        if found is None:
            continue
        tables.append(
            table.select(
                F.col(f"`{found[0]}`").alias("raw_text"),
                F.col(f"`{found[1]}`").alias("raw_label"),
                F.regexp_replace(F.col("_metadata.file_name"), "-tweets_labeled\\.csv$", "").alias("event"),
            )
        )
    if not tables:
        raise ValueError(f"no usable {EVENT_FILES} below {root}")
    rows = reduce(lambda a, b: a.unionByName(b), tables)
    return (
        rows.withColumn("text", clean_text("raw_text"))
        .withColumn("label", map_label("raw_label"))
        .filter(F.length("text") > 0)
    )


def first_field(line) -> Column:
    """The published cut of an uploaded line: up to the first comma, even inside quotes, then
    one outer quote off each end."""
    head = F.split_part(trim_blanks(line), F.lit(","), F.lit(1))
    return trim_blanks(F.regexp_replace(head, '^"|"$', ""))


def with_positions(rows: DataFrame, wanted: Column) -> tuple[DataFrame, bool]:
    """The ``wanted`` rows of a plain scan of files with ``seq``, their place among all rows of all files in the order of
    the paths, and whether there are any.

    Files are cut into blocks, and tasks read blocks as Spark packs them. A first pass counts the rows of each block; the
    place is the rows of earlier blocks plus the place inside the block, so it does not depend on the cuts.
    """
    blocks = rows.withColumns({
        "_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id(),
    })
    counts = blocks.groupBy("_file", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count_if(wanted).alias("_wanted")
    )
    # One row for each block of a file: no window over the rows themselves.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    n, some = counts.agg(F.count(F.lit(1)), F.sum("_wanted")).first()
    starts = counts.select("_file", "_block", "_first", "_before")
    placed = blocks.join(F.broadcast(starts) if n <= SHARED_BLOCKS else starts, ["_file", "_block"])
    placed = placed.withColumn("seq", F.col("_before") + F.col("_id") - F.col("_first"))
    return placed.filter(wanted).select("seq", *rows.columns), bool(some)


def read_posts(
    spark: SparkSession, path: str, legacy_first_field: bool = False, min_chars: int = MIN_POST_CHARS
) -> DataFrame:
    """``seq, text`` of a ``.txt`` or ``.csv`` file (or a folder of them).

    CSV is parsed as CSV and its first field is the post; ``legacy_first_field`` cuts every
    line at the first comma instead. Texts of ``min_chars`` characters or fewer (headings) are dropped.
    ``seq`` is the order of arrival: the place in its file, files in the order of their paths.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if "." in name and not name.endswith((".txt", ".csv")):
        raise ValueError(f"{path} is neither .txt nor .csv")
    if legacy_first_field:
        rows, text = spark.read.option("pathGlobFilter", "*.{txt,csv}").text(path), first_field("value")
    elif name.endswith(".txt"):
        rows, text = spark.read.text(path), trim_blanks("value")
    else:
        reader = spark.read.option("multiLine", True).option("escape", '"').option("pathGlobFilter", "*.{txt,csv}")
        rows = reader.csv(path)
        text = trim_blanks(F.col(rows.columns[0]))
    posts, some = with_positions(rows, F.coalesce(F.length(text) > min_chars, F.lit(False)))
    if not some:
        raise ValueError(f"no usable posts in {path}")
    return posts.select("seq", text.alias("text"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """``key, lat, lng, full_name`` of a JSON object from place name to coordinates. Of names that differ in case
    alone the last one counts; a malformed or empty file is an error."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    parsed = F.from_json("value", f"map<string,{PLACE.simpleString()}>", {"mode": "FAILFAST"})
    entries = whole.select("path", F.posexplode(parsed).alias("pos", "k", "v"))
    last = entries.groupBy(F.lower("k").alias("key")).agg(F.max_by("v", F.struct("path", "pos")).alias("v"))
    if last.isEmpty():
        raise ValueError(f"no places in {path}")
    return last.select("key", "v.*")


def write_gazetteer(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_training(df: DataFrame, path: str, format: str = "parquet") -> None:
    """``text, label`` without an index; CSV gets a header."""
    writer = require_columns(df, ["text", "label"]).select("text", "label").write.mode("overwrite")
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def write_metrics(df: DataFrame, path: str, format: str = "json") -> None:
    """The long metrics table as JSON lines, or a fold table as CSV."""
    writer = df.write.mode("overwrite")
    writer.json(path) if format == "json" else writer.option("header", True).csv(path)


def save_model(weights: DataFrame, intercept: float, path: str, version: int = 1) -> None:
    """Vocabulary and weights as two tables of one version."""
    stamped = weights.withColumn("model_version", F.lit(version))
    bias = weights.sparkSession.range(1).select(
        F.lit("").alias("term"), F.lit(float(intercept)).alias("coef"), F.lit(version).alias("model_version")
    )
    tables = (
        ("vocabulary", stamped.select("term", "idf", "model_version")),
        ("weights", stamped.select("term", "coef", "model_version").unionByName(bias)),
    )
    for name, table in tables:
        table.write.mode("overwrite").parquet(f"{path}/{name}/version={version}")


def load_model(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, float]:
    """Weights ``(term, idf, coef)`` and intercept; fails unless both tables are there and
    hold the same terms."""
    tables = {}
    for name in ("vocabulary", "weights"):
        try:
            tables[name] = spark.read.parquet(f"{path}/{name}/version={version}")
        except AnalysisException as missing:
            raise FileNotFoundError(f"model {name} version {version} not found in {path}") from missing
    bias = tables["weights"].filter("term = ''").select("coef").first()
    terms = tables["vocabulary"].join(tables["weights"].filter("term <> ''"), "term", "full").select(
        "term", "idf", "coef"
    )
    broken = terms.filter(F.col("idf").isNull() | F.col("coef").isNull())
    if bias is None or not broken.isEmpty():
        raise ValueError(f"vocabulary and weights in {path} do not belong together")
    return terms, float(bias[0])
