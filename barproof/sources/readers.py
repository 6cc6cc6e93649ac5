"""Readers, merges and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barproof.operators import features as ft

BAR_SCHEMA = T.StructType([T.StructField("t", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in "ohlcv")])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (a temporary one only where none is set and everything runs in one process, as in tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barproof-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, however many steps read them, and kept if executors go."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_path(df: DataFrame) -> DataFrame:
    """Symbol and timeframe come from the path."""
    at = F.input_file_name()
    return df.select(F.regexp_extract(at, r"sym=([^/]+)", 1).alias("sym"), F.regexp_extract(at, r"tf=([^/]+)", 1).alias("tf"), *"tohlcv")


def write_bars_json(bars: DataFrame, path: str, tf: str) -> None:
    """One folder of JSON lines per symbol and timeframe."""
    bars.withColumn("tf", F.lit(tf)).write.partitionBy("sym", "tf").json(path)


def read_bars_json(spark: SparkSession, path: str) -> DataFrame:
    """Bars of all symbols and timeframes, from JSON lines."""
    return _with_path(spark.read.schema(BAR_SCHEMA).option("recursiveFileLookup", "true").json(path))


def write_bars_array(bars: DataFrame, path: str, tf: str, span_ms: int = 366 * 86_400_000) -> None:
    """Files that hold one JSON array of a symbol's bars each, in order of time; a file spans a year, so none grows without bound."""
    one = bars.groupBy("sym", F.floor(F.col("t") / span_ms).alias("_y")).agg(F.array_sort(F.collect_list(F.struct(*"tohlcv"))).alias("_a"))
    one.select("sym", F.lit(tf).alias("tf"), "_y", F.to_json("_a").alias("value")).write.partitionBy("sym", "tf", "_y").text(path)


def read_bars_array(spark: SparkSession, path: str) -> DataFrame:
    """Bars from files of one JSON array each."""
    return _with_path(spark.read.schema(BAR_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(path))


def write_bars_csv(bars: DataFrame, path: str, tf: str) -> None:
    """One folder of CSV files with a header per symbol and timeframe."""
    bars.select("sym", F.lit(tf).alias("tf"), *"tohlcv").write.partitionBy("sym", "tf").option("header", "true").csv(path)


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV files with a header."""
    return _with_path(spark.read.schema(BAR_SCHEMA).option("header", "true").option("recursiveFileLookup", "true").csv(path))


BAR_FORMATS = {"lines": (write_bars_json, read_bars_json), "array": (write_bars_array, read_bars_array), "csv": (write_bars_csv, read_bars_csv)}


def latest(pages: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Of rows with one key, the one ingested last (a re-read last bar replaces the unclosed one).

    An aggregate with partial maxima, not a window: versions of a key meet only as one row a task.
    """
    rest = [c for c in pages.columns if c not in (*keys, seq)]
    return pages.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_v")).select(*keys, "_v.*")


def newest(bars: DataFrame, n: int) -> DataFrame:
    """The newest n bars of each symbol, by their numbers."""
    return ft.with_index(bars, size="_size").where(F.col("i") >= F.col("_size") - n).drop("i", "_size")


def gaps(bars: DataFrame, step_ms: int) -> DataFrame:
    """Missing grid steps per symbol; nothing is filled."""
    b = ft.unframed(ft.framed(bars, 1, step_ms=step_ms).withColumn("_d", F.col("t") - F.lag("t").over(ft.by_block())))
    return b.groupBy("sym").agg(F.sum(F.greatest(F.floor(F.col("_d") / step_ms) - 1, F.lit(0))).cast("long").alias("missing"), F.count(F.lit(1)).alias("bars"))


def iso_millis(c: Column) -> Column:
    """ISO date or date and time (UTC), or milliseconds."""
    stamp = F.coalesce(F.try_to_timestamp(F.regexp_replace(c, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.regexp_replace(c, "T", " "), F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    # parsed in the session's zone; its wall clock is what was written
    return F.coalesce(F.when(c.rlike(r"^\d+$"), c.try_cast("long")), F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), stamp.cast("timestamp_ntz")))


def calendar(raw: DataFrame, step_ms: int) -> DataFrame:
    """Event rows as strings -> with ``t`` and the opening time of the bar they fall in; blanks become ''."""
    d = raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("tarih", "saat_utc", "tur", "note")])
    d = d.withColumn("t", iso_millis(F.concat_ws(" ", "tarih", "saat_utc")))
    return d.withColumn("bar", (F.floor(F.col("t") / step_ms) * step_ms).cast("long"))


def read_plans_csv(spark: SparkSession, path: str) -> DataFrame:
    """An external plan list, header in any order; missing optional columns are null."""
    raw = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    for c in ("t0", "sym", "side"):
        if c not in raw.columns:
            raise ValueError(f"column missing: {c}")
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in ("t0", "sym", "side", "hz", "rm", "sl", "tp")])


def messages_from_html(pages: DataFrame) -> DataFrame:
    """(channel, html) of saved channel pages -> one row per message id: channel, id, t, text."""
    # fixed values: the markup of saved channel pages
    block = F.explode(F.filter(F.split("html", "tgme_widget_message_wrap"), lambda x, i: i > 0))
    b = pages.select("channel", block.alias("b"))
    grab = lambda p: F.regexp_extract("b", p, 1)
    text = grab(r'(?s)tgme_widget_message_text[^>]*>(.*?)</div>')
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", "")
    for old, new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, "&#39;|&quot;", "'")
    t = iso_millis(F.regexp_replace(grab(r'<time[^>]*datetime="([^"]+)"'), r"\+00:00$", ""))
    rows = b.select("channel", grab(r'data-post="[^"/]+/(\d+)"').try_cast("long").alias("id"), t.alias("t"), text.alias("text")).where("id IS NOT NULL")
    return rows.dropDuplicates(["channel", "id"])


# fixed values: the line that begins a pasted message
DATE_LINE = r"(?m)^[ \t]*\[?(\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})[ T,]+(\d{1,2}:\d{2})"


def messages_from_text(pastes: DataFrame) -> DataFrame:
    """(channel, text) of pasted histories -> one row per block that begins with a date line: channel, k, t, text."""
    parts = F.split(F.regexp_replace("text", DATE_LINE, "\u0001$0"), "\u0001")
    b = pastes.select("channel", F.posexplode(parts).alias("k", "body")).where(F.col("k") > 0)
    d, h = F.regexp_extract("body", DATE_LINE, 1), F.regexp_extract("body", DATE_LINE, 2)
    iso = F.when(d.rlike(r"^\d{2}[./]"), F.concat_ws("-", F.substring(d, 7, 4), F.substring(d, 4, 2), F.substring(d, 1, 2))).otherwise(d)
    return b.select("channel", "k", iso_millis(F.concat(iso, F.lit(" "), F.lpad(h, 5, "0"))).alias("t"), F.col("body").alias("text"))


def append_once(ledger: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key the ledger doesn't have yet, each key once."""
    return rows.dropDuplicates([key]).join(ledger.select(key).distinct(), key, "left_anti")


def ledger_view(versions: DataFrame) -> DataFrame:
    """Latest state of each signal from appended versions (insert, half, close)."""
    return versions.groupBy("id").agg(
        F.max_by("state", F.struct("seq")).alias("state"), F.max_by("closed_at", F.struct("seq")).alias("closed_at"), F.max_by("close_px", F.struct("seq")).alias("close_px"),
        F.max_by("r_realized", F.struct("seq")).alias("r_realized"), F.max("half").alias("half"))
