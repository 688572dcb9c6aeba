"""Events and traces: funnels, flows, retention, pages, replay and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.engine.shared import durable

TRACE_COLUMNS = (
    "event_id", "trace_id", "span_id", "parent_span_id", "session_id", "user_id", "event_type", "event_name", "service_name", "page_path", "page_url", "page_title", "status_code", "created_at", "properties", "duration_ms", "timestamp_ms",
)


def funnel(df: DataFrame, steps: list[str], user: str = "user_id", event: str = "event_name", at: str | None = None, start: str | None = None, end: str | None = None, *, ordered: bool = False) -> DataFrame:
    """(step, event, users, rate_from_first, rate_from_previous): users who have an event and all before it.

    One aggregate row per user, with a map-side maximum per step; with ``ordered`` each first event must not come before
    the step before's. start and end are inclusive days of ``at``. Null users don't count.
    """
    rows = df.filter(F.col(user).isNotNull() & F.col(event).isin(steps))
    if at and start:
        rows = rows.filter(F.to_date(at) >= F.lit(start).cast("date"))
    if at and end:
        rows = rows.filter(F.to_date(at) <= F.lit(end).cast("date"))
    has = [F.min(F.when(F.col(event) == s, F.col(at) if ordered else F.lit(1))).alias(f"t{k}") for k, s in enumerate(steps)]
    users = rows.groupBy(user).agg(*has)
    reached, cells = F.lit(True), []
    for k in range(len(steps)):
        reached = reached & F.col(f"t{k}").isNotNull()
        if ordered and k:
            reached = reached & (F.col(f"t{k}") >= F.col(f"t{k - 1}"))
        cells.append(F.count_if(reached).alias(f"n{k}"))
    counts = users.agg(*cells)
    rows_ = [F.struct(F.lit(k + 1).alias("step"), F.lit(s).alias("event"), F.col(f"n{k}").alias("users"), F.coalesce(F.round(F.try_divide(f"n{k}", "n0"), 4), F.lit(0.0)).alias("rate_from_first"), F.coalesce(F.round(F.try_divide(f"n{k}", f"n{max(0, k - 1)}"), 4), F.lit(0.0)).alias("rate_from_previous")) for k, s in enumerate(steps)]
    return counts.select(F.inline(F.array(*rows_)))


def flow(df: DataFrame, session: str, page: str, at: str, k: int = 20) -> DataFrame:
    """(source, target, n): the k most frequent steps from page to page within sessions; staying isn't a step.

    Rows are ordered in ranges of session and time, so that a session that holds a third of all rows is no single task;
    the step from one range to the next comes from the ranges' first rows, of which there are as many as ranges. Rows of
    one time are ordered by page; null sessions don't count.
    """
    rows = df.select(F.col(session).alias("s"), F.col(at).alias("t"), F.col(page).alias("source")).filter("s is not null and source is not null")
    ranged = durable(rows.repartitionByRange("s", "t", "source").withColumn("part", F.spark_partition_id()))
    heads = sorted(ranged.groupBy("part").agg(F.min(F.struct("s", "t", "source")).alias("h")).select("part", "h.s", "h.source").collect())
    pairs = [x for a, b in zip(heads, heads[1:], strict=False) for x in (F.lit(a.part), F.struct(F.lit(b.s).alias("s"), F.lit(b.source).alias("source")))]
    after = F.element_at(F.create_map(*pairs), F.col("part")) if pairs else F.lit(None).cast(f"struct<s:{ranged.schema['s'].dataType.simpleString()},source:{ranged.schema['source'].dataType.simpleString()}>")
    w = Window.partitionBy("part").orderBy("s", F.col("t").asc_nulls_first(), "source")
    steps = ranged.select("s", "source", F.coalesce(F.lead(F.struct("s", "source")).over(w), after).alias("next")).filter(F.col("next.s") == F.col("s"))
    return steps.select("source", F.col("next.source").alias("target")).filter("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source", "target").limit(k)


def retention(df: DataFrame, user: str, at: str, days: int = 7) -> DataFrame:
    """(cohort, day, users, cohort_size, rate): users of each first day who are active 0 to ``days`` days later."""
    active = df.filter(F.col(user).isNotNull() & F.col(at).isNotNull()).select(F.col(user).alias("u"), F.to_date(at).alias("d")).distinct()
    first = active.groupBy("u").agg(F.min("d").alias("cohort"))
    seen = active.join(first, "u").withColumn("day", F.datediff("d", "cohort")).filter(F.col("day").between(0, days))
    n = seen.groupBy("cohort", "day").agg(F.count(F.lit(1)).alias("users"))
    size = first.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size"))
    return n.join(size, "cohort").withColumn("rate", F.round(F.col("users") / F.col("cohort_size"), 4))


def page_metrics(df: DataFrame, page: str = "page_path", user: str = "user_id", session: str = "session_id", event: str = "event_type", properties: str = "properties", view: str = "pageview", leave: str = "$page_leave", dwell: str = "$.duration") -> DataFrame:
    """(page, views, users, sessions, mean_dwell): visits of each page and how long they last, read from the properties."""
    seen = F.col(event) == view
    time = F.when(F.col(event) == leave, F.get_json_object(properties, dwell).try_cast("double"))
    return df.filter(F.col(page).isNotNull()).groupBy(F.col(page).alias("page")).agg(F.count_if(seen).alias("views"), F.count_distinct(F.when(seen, F.col(user))).alias("users"), F.count_distinct(F.when(seen, F.col(session))).alias("sessions"), F.avg(time).alias("mean_dwell"))


def waterfall(df: DataFrame, trace: str) -> DataFrame:
    """The spans of one trace in order, with their start after the first."""
    rows = df.filter(F.col("trace_id") == trace)
    w = Window.partitionBy("trace_id")
    return rows.withColumn("offset_ms", F.col("timestamp_ms") - F.min("timestamp_ms").over(w)).orderBy(F.col("timestamp_ms").asc_nulls_last(), "span_id")


def replay(df: DataFrame, session: str) -> DataFrame:
    """The events of one session in order, with their properties as a map."""
    return df.filter(F.col("session_id") == session).withColumn("property_map", F.from_json("properties", "map<string,string>")).orderBy(F.col("timestamp_ms").asc_nulls_last(), "event_id")


def sessions(df: DataFrame, at: str = "timestamp_ms", page: str = "page_path") -> DataFrame:
    """(session_id, user_id, started, ended, events, errors, entry_page, exit_page): entry and exit by time."""
    known = F.col(page).isNotNull()
    return df.groupBy("session_id", "user_id").agg(
        F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("events"), F.count_if((F.col("event_type") == "error") | (F.col("status_code") == "ERROR")).alias("errors"),
        F.min(F.when(known, F.struct(at, page)))[page].alias("entry_page"), F.max(F.when(known, F.struct(at, page)))[page].alias("exit_page"),
    )
