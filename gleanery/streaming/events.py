"""Event streams: ticks, sessions, totals, baselines, snapshots, mailboxes. Each operator takes a batch or streaming frame of
(event_id, ts, user_id, event_type, value, props); `run` drives a streaming one to the end of what is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.cluster import shared_folder, ship

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str, streaming: bool = True) -> DataFrame:
    """The events, with event time of a type that watermarks accept."""
    reader = spark.readStream if streaming else spark.read
    path = f"{sf_dir}/events.parquet"
    df = reader.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(path if not streaming else f"{sf_dir}/event[s].parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def run(df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Everything available once through the stream, into a memory-free sink: a table in the shared folder, one folder a batch.
    In update mode, the last row of each key counts; in complete mode the last batch does."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/b{number:09d}")

    query = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(sink).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out")
    if mode == "complete":
        last = out.agg(F.max("_batch")).first()[0]
        return out.where(F.col("_batch") == last).drop("_batch")
    if mode == "update" and keys:
        rest = [c for c in out.columns if c not in (*keys, "_batch")]
        return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
    return out.drop("_batch")


def ticks(df: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their values, in cents, by tumbling window and type."""
    w = F.window("ts", width)
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return df.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), cents.alias("cents")).select(F.col("window.start").alias("tick"), "event_type", "n", "cents")


def sliding(df: DataFrame, width: str, step: str) -> DataFrame:
    return df.withWatermark("ts", "1 day").groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Play sessions of each user."""
    w = F.session_window("ts", gap)
    out = df.withWatermark("ts", late).groupBy("user_id", w).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def totals(df: DataFrame) -> DataFrame:
    """Loot totals: what each (user, key) brings counts at its first sight only."""
    key = F.get_json_object("props", "$.k").cast("int")
    return df.withColumn("k", key).dropDuplicates(["user_id", "k"]).groupBy("k").agg(F.count("*").alias("n"))


def snapshot(df: DataFrame) -> DataFrame:
    """Latest event of each user."""
    return df.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("last")).select("user_id", "last.event_id", "last.event_type")


def baselines(df: DataFrame) -> DataFrame:
    """Gain of each user since the first event seen, in cents: (user_id, gain) after each batch. State is two numbers."""
    schema = "user_id long, gain long"

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        cents = (rows["value"] * 100).round().astype("int64")
        base = state.get[0] if state.exists else int(cents.iloc[0])
        state.update((base,))
        yield pd.DataFrame({"user_id": [key[0]], "gain": [int(cents.iloc[-1]) - base]})

    ship(df.sparkSession)
    return df.groupBy("user_id").applyInPandasWithState(step, schema, "base long", "update", "NoTimeout")


def timers(df: DataFrame, seconds: int) -> DataFrame:
    """Named timers in a batch of (name, ts, action start or cancel): each start with when it ends, unless a cancel or another
    start of the name comes before."""
    nxt = F.lead("ts").over(Window.partitionBy("name").orderBy("ts", "action"))
    ends = F.col("ts") + F.make_interval(secs=F.lit(seconds))
    return df.withColumn("ends", ends).withColumn("_next", nxt).where("action = 'start' and (_next is null or _next >= ends)").select("name", "ts", "ends")


def dispatch(df: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every event to every subscriber of its type."""
    return df.join(subscriptions, "event_type")


def mailboxes(mail: DataFrame, live: DataFrame) -> DataFrame:
    """Mail to actors that live; to others it's dropped."""
    return mail.join(live.withColumnRenamed("actor", "to"), "to", "left_semi")


def drain(mail: DataFrame, limit: int, keep: Callable | None = None) -> DataFrame:
    """The first messages of each mailbox in order of arrival that a filter lets through; a limit of 0 or less means all."""
    picked = mail.where(keep(F.col("from"))) if keep else mail
    if limit <= 0:
        return picked
    return picked.withColumn("_n", F.row_number().over(Window.partitionBy("to").orderBy("seq"))).where(F.col("_n") <= limit).drop("_n")


def actor_limits(actors: DataFrame, deepest: int, most: int) -> DataFrame:
    """Actors that break a rule: too deep (slashes in the name), or one of too many children."""
    depth = F.length("name") - F.length(F.replace(F.col("name"), F.lit("/")))
    parent = F.regexp_extract("name", r"^(.*)/[^/]*$", 1)
    w = Window.partitionBy("parent").orderBy("name")
    placed = actors.withColumn("depth", depth).withColumn("parent", parent).withColumn("place", F.row_number().over(w))
    return placed.where((F.col("depth") > deepest) | ((F.col("parent") != "") & (F.col("place") > most))).select("name")


def marker_sets(marks: DataFrame, key: str, mark: str, order: str, add: str) -> DataFrame:
    """Each key's set of marks after all additions and removals (add: true or false), in order; keys with none are left out."""
    last = marks.groupBy(key, mark).agg(F.max_by(add, order).alias("_on")).where("_on")
    return last.groupBy(key).agg(F.array_sort(F.collect_list(mark)).alias("marks"))


def batched(texts: DataFrame, key: str, text: str, order: str, size: int = 50, least: int = 4) -> DataFrame:
    """Each key's distinct texts of a least length with the number of the batch that sends them: in order of first sight, `size` to a batch."""
    first = texts.where(F.char_length(text) >= least).groupBy(key, text).agg(F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_first", text)) - 1
    return first.select(key, text, F.floor(place / size).cast("int").alias("batch"))


def watchdog(events: DataFrame, cooldown: int = 10, most: int = 5, reset: int = 100) -> DataFrame:
    """actor, tick, respawn number of every respawn: a crash (actor, tick) is followed by one after the cooldown, `most` in a row at most; an actor
    that was up for `reset` ticks begins anew. Crashes while it's down don't count."""

    def fold(key, frame: pd.DataFrame) -> pd.DataFrame:
        out, up_since, count = [], 0, 0
        for tick in sorted(int(t) for t in frame["tick"]):
            if up_since is None or tick < up_since:
                continue
            if tick - up_since >= reset:
                count = 0
            if count >= most:
                up_since = None
                continue
            count, up_since = count + 1, tick + cooldown
            out.append((int(key[0]), up_since, count))
        return pd.DataFrame(out, columns=["actor", "tick", "respawn"])

    ship(events.sparkSession)
    return events.select("actor", "tick").groupBy("actor").applyInPandas(fold, "actor long, tick long, respawn int")
