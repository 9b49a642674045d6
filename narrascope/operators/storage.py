"""Tables at rest and their update rules.

The reference keeps six PostgreSQL tables; here they are parquet tables and
every update is a relational rewrite that produces the new table (written to
a new path, never over the one being read).
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from typing import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.operators.util import cut_lineage, sized_broadcast

#: incoming urls whose hashes are broadcast, at most
HASHED_URLS = 2_000_000
ARTICLE_COLS = ["id", "title", "url", "source", "summary", "published_at", "run_id", "run_date"]

class DuplicateKeyError(ValueError):
    pass


class NullKeyError(ValueError):
    pass


def global_rank(df: DataFrame, *order: str, up: int = 0) -> DataFrame:
    """Add ``rank`` = 1..n by ``order`` (unique) without a single-partition window.

    Rows are range-partitioned by the order, as many partitions as the session shuffles into, and
    written with their partition number; each partition is numbered by itself and offset by the
    counts of the partitions before it (a table of one row per partition). ``up`` as in ``cut_lineage``.
    """
    d = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), up=up)
    counts = d.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))
    ranked = d.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return (ranked.join(F.broadcast(offsets), "_part")  # one row per partition
            .withColumn("rank", F.col("_off") + F.col("_rn")).drop("_part", "_rn", "_off"))


def assert_unique(df: DataFrame, key: str, what: str = "incoming") -> None:
    dup = df.groupBy(key).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise DuplicateKeyError(f"{what} holds {key} {dup[0][0]!r} more than once")


def met_by_url(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored articles that an incoming url may name: by url hash, without a shuffle of the history.

    The hashes of up to ``HASHED_URLS`` incoming urls (8 bytes each) are broadcast to the scan of the history; a
    larger batch is left to the join on the url. Other urls with the same hash are told apart by that join.
    """
    if incoming.limit(HASHED_URLS + 1).count() > HASHED_URLS:
        return existing
    hashes = incoming.select(F.xxhash64("url").alias("_hash")).distinct()
    return existing.join(F.broadcast(hashes), F.xxhash64(existing["url"]) == F.col("_hash"), "left_semi")


def upsert_rows(existing: DataFrame, incoming: DataFrame, run_id: str, run_date, max_id: int, order: str = "ord") -> DataFrame:
    """W1, the rows it writes: inserts by url; on conflict only title and summary change.

    Source, published_at, run_id, run_date and id keep their first values. New rows get ids after
    ``max_id``, in ``order`` of the incoming rows. A url repeated inside ``incoming``, or a null one, is an
    error, as in PostgreSQL.
    """
    assert_unique(incoming, "url")
    bad = incoming.where(F.col("url").isNull()).count()
    if bad:
        raise NullKeyError(f"{bad} incoming articles have no url")
    run_date = _dt.date.fromisoformat(run_date) if isinstance(run_date, str) else run_date
    e = met_by_url(existing, incoming).select(F.col("url").alias("_url"), "id", *[F.col(c).alias(f"_{c}") for c in ("source", "published_at", "run_id", "run_date")])
    i = incoming.select("url", "source", "published_at", F.col(order).alias("_ord"))
    # keys and short columns only; the texts join what is written, once
    j = cut_lineage(i.join(e, F.col("url") == F.col("_url"), "left"))
    updated = j.where(F.col("id").isNotNull()).select(
        "id", "url", F.col("_source").alias("source"), F.col("_published_at").alias("published_at"),
        F.col("_run_id").alias("run_id"), F.col("_run_date").alias("run_date"))
    new = global_rank(j.where(F.col("id").isNull()).select("url", "source", "published_at", "_ord"), "_ord")
    inserted = new.select((F.lit(max_id) + F.col("rank")).cast("long").alias("id"), "url", "source",
                          "published_at", F.lit(run_id).alias("run_id"), F.lit(run_date).alias("run_date"))
    rows = updated.unionByName(inserted).join(incoming.select("url", "title", "summary"), "url")
    return rows.select(*ARTICLE_COLS)


def upsert_articles(existing: DataFrame, incoming: DataFrame, run_id: str, run_date,
                    order: str = "ord") -> DataFrame:
    """W1 over a whole table: the rows not touched, and those ``upsert_rows`` writes."""
    max_id = existing.agg(F.max("id")).first()[0] or 0  # one number
    e = existing.select(*ARTICLE_COLS)
    untouched = e.join(incoming.select(F.col("url").alias("_u")), F.col("url") == F.col("_u"), "left_anti")
    return untouched.unionByName(upsert_rows(e, incoming, run_id, run_date, max_id, order))


def upserted_ids(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """W1 return value: url -> id of the inserted and updated rows."""
    return table.join(incoming.select("url"), "url", "left_semi").select("url", "id")


def replace_by_key(existing: DataFrame, incoming: DataFrame, keys: DataFrame, key: str = "article_id") -> DataFrame:
    """Drop the rows of the attempted keys, add the new rows (idempotent rerun).

    ``keys`` lists every attempted key, also those whose new result is empty.
    """
    k = keys.select(F.col(key).alias("_key")).distinct()
    kept = existing.join(sized_broadcast(k), existing[key] == k["_key"], "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


RUN_FLAGS = ["collect_completed", "parse_completed", "clean_completed", "signal_completed"]
RUN_TOTALS = ["total_sources", "total_fetched", "total_parsed", "total_cleaned", "total_analyzed"]
RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("run_date", T.DateType()),
    T.StructField("started_at", T.TimestampNTZType()), T.StructField("completed_at", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    *[T.StructField(f, T.BooleanType()) for f in RUN_FLAGS],
    *[T.StructField(t, T.LongType()) for t in RUN_TOTALS],
    T.StructField("errors", T.StringType()),
])
UPDATE_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("event_time", T.TimestampNTZType()),
    T.StructField("stage", T.StringType()), T.StructField("stats", T.MapType(T.StringType(), T.LongType())),
    T.StructField("status", T.StringType()), T.StructField("errors", T.StringType()),
])


def update_runs(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Fold append-only update events into the run ledger.

    Per run: a stage sets its flag; stats set known totals (unknown keys
    ignored), the latest event wins; status is the latest one given;
    completed_at is the time of the latest ``completed`` status; errors the
    latest non-empty text. Updates of unknown runs are dropped (no-op).
    """
    u = updates.join(runs.select("run_id"), "run_id", "left_semi")
    t = F.col("event_time")
    aggs = [F.max(F.col("stage") == f.replace("_completed", "")).alias(f) for f in RUN_FLAGS]
    aggs += [F.max_by(F.col("stats")[k], F.when(F.col("stats")[k].isNotNull(), t)).alias(k) for k in RUN_TOTALS]
    aggs += [F.max_by("status", F.when(F.col("status").isNotNull(), t)).alias("status"),
             F.max(F.when(F.col("status") == "completed", t)).alias("completed_at"),
             F.max_by("errors", F.when(F.coalesce(F.col("errors"), F.lit("")) != "", t)).alias("errors")]
    folded = u.groupBy("run_id").agg(*aggs)
    r, f = runs.alias("r"), folded.alias("f")
    j = r.join(f, "run_id", "left")
    cols = [F.col("run_id"), F.col("r.run_date").alias("run_date"), F.col("r.started_at").alias("started_at"),
            F.coalesce("f.completed_at", "r.completed_at").alias("completed_at"),
            F.coalesce("f.status", "r.status").alias("status")]
    cols += [(F.coalesce(F.col(f"r.{x}"), F.lit(False)) | F.coalesce(F.col(f"f.{x}"), F.lit(False))).alias(x)
             for x in RUN_FLAGS]
    cols += [F.coalesce(F.col(f"f.{x}"), F.col(f"r.{x}")).alias(x) for x in RUN_TOTALS]
    cols += [F.coalesce("f.errors", "r.errors").alias("errors")]
    return j.select(*cols)


def melt_stats(stats: DataFrame, run_id: str, stage: str) -> DataFrame:
    """One row per metric; numbers and booleans to metric_value, the rest to details JSON."""
    rows = []
    for f in stats.schema.fields:
        c = F.col(f"`{f.name}`")
        numeric = isinstance(f.dataType, (T.NumericType, T.BooleanType))
        if numeric:
            value, details = c.cast("double"), F.lit(None).cast("string")
        elif isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
            value, details = F.lit(None).cast("double"), F.to_json(c)
        else:
            # a JSON string: encode as a one-element array, drop the brackets
            js = F.to_json(F.array(c.cast("string")))
            value, details = F.lit(None).cast("double"), F.regexp_extract(js, r"^\[(.*)\]$", 1)
        rows.append(F.struct(F.lit(f.name).alias("metric_name"), value.alias("metric_value"), details.alias("details")))
    out = stats.select(F.explode(F.array(*rows)).alias("m"))
    return out.select(F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), "m.*")


def format_duration(seconds) -> F.Column:
    """``H:MM:SS``, with ``N day(s), `` in front past a day (Python's timedelta text)."""
    s = seconds
    days, rem = F.floor(s / 86400), s % 86400
    hms = F.format_string("%d:%02d:%02d", F.floor(rem / 3600).cast("int"), F.floor((rem % 3600) / 60).cast("int"),
                          (rem % 60).cast("int"))
    day_txt = F.concat(days.cast("string"), F.when(days == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")))
    return F.when(days != 0, F.concat(day_txt, hms)).otherwise(hms)


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """Latest n runs by started_at desc (nulls first, as PostgreSQL), run_id breaking ties."""
    top = runs.orderBy(F.desc_nulls_first("started_at"), F.asc("run_id")).limit(n)
    secs = F.expr("timestampdiff(SECOND, started_at, completed_at)")
    return top.select(
        "run_id", "run_date", "status",
        F.coalesce(F.date_format("started_at", "yyyy-MM-dd HH:mm"), F.lit("-")).alias("started"),
        F.when(F.col("started_at").isNotNull() & F.col("completed_at").isNotNull(), format_duration(secs))
        .otherwise(F.lit("-")).alias("duration"),
        F.when(F.length("errors") > 45, F.concat(F.substring("errors", 1, 45), F.lit("...")))
        .otherwise(F.coalesce(F.when(F.col("errors") != "", F.col("errors")), F.lit("-"))).alias("errors"))


# Declared rules, by table: columns that are not null, and longest text by column (fixed values).
NOT_NULL = {"articles": ["title", "url", "source", "run_id", "run_date"],
            "sentiment_analysis": ["article_id", "method_name", "polarity", "label", "score"],
            "named_entity_recognition": ["article_id", "method_name", "entity_group", "word", "score"],
            "entity_framing": ["article_id", "entity_word", "framing_phrase"],
            "pipeline_runs": ["run_id", "run_date", "status"], "run_statistics": ["run_id", "stage", "metric_name"]}
MAX_LENGTH = {"articles": {"url": 512, "source": 100, "run_id": 50}, "sentiment_analysis": {"method_name": 50, "label": 20},
              "named_entity_recognition": {"entity_group": 50, "word": 255},
              "entity_framing": {"entity_word": 255, "framing_phrase": 255},
              "pipeline_runs": {"run_id": 50, "status": 20}, "run_statistics": {"run_id": 50, "stage": 20, "metric_name": 50}}
UNIQUE = {"articles": "url", "pipeline_runs": "run_id"}
REFERENCES = {"sentiment_analysis": ("article_id", "articles", "id"), "named_entity_recognition": ("article_id", "articles", "id"),
              "entity_framing": ("article_id", "articles", "id"), "run_statistics": ("run_id", "pipeline_runs", "run_id")}


def check_integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """Declared constraints as data checks, (rule, violations) per rule of the tables given.

    Null and length rules of a table are one aggregation over it; a unique rule is one more, a reference
    one anti join.
    """
    parts = []
    for name, df in tables.items():
        rules = {f"{name}.{c} not null": F.count_if(F.col(c).isNull()) for c in NOT_NULL[name]}
        rules |= {f"{name}.{c} length <= {n}": F.count_if(F.length(c) > n) for c, n in MAX_LENGTH[name].items()}
        row = df.agg(*[v.alias(f"r{i}") for i, v in enumerate(rules.values())])
        parts.append(row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("violations"))
                                                    for i, r in enumerate(rules)])).alias("x")).select("x.*"))
        if name in UNIQUE:
            twice = df.groupBy(UNIQUE[name]).agg(F.count("*").alias("n")).where("n > 1")
            parts.append(twice.agg(F.count("*").alias("violations")).select(F.lit(f"{name}.{UNIQUE[name]} unique").alias("rule"), "violations"))
        if name in REFERENCES and REFERENCES[name][1] in tables:
            col, other, key = REFERENCES[name]
            known = tables[other].select(F.col(key).alias("_key"))
            lost = df.select(F.col(col).alias("_ref")).where("_ref is not null").join(known, F.col("_ref") == F.col("_key"), "left_anti")
            parts.append(lost.agg(F.count("*").alias("violations")).select(F.lit(f"{name}.{col} references {other}").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def write_table(df: DataFrame, name: str, root: str, partition_by: Iterable[str] = ("run_date",),
                mode: str = "overwrite") -> str:
    """Write a table at rest as parquet, partitioned by run_date where it has one."""
    path = f"{root.rstrip('/')}/{name}"
    parts = [c for c in partition_by if c in df.columns]
    w = df.write.mode(mode)
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)
    return path
