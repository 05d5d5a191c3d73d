"""Queries over streams whose batches bring rows out of order, and the same over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import scratch
from ..operators import members
from ..streaming import ordered, tables
from . import views as v
from .registered import query

#: Batches that events arrive in, hours of one, and hours by which an event is delayed at most.
BATCHES, BATCH_HOURS, DELAY = 4, 240, 24
#: Seconds of silence, of suspicion, and until a host is forgotten; seconds behind which rows are late.
SILENCE, LATE = 6 * 3600, 6 * 3600


def arriving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of four batches: each arrives up to a day late, by its id."""
    events = v.table(spark, sf_dir, "events")
    hour = (F.dayofmonth("ts") - 1) * 24 + F.hour("ts")
    part = F.least(F.floor((hour + F.col("event_id") % DELAY) / BATCH_HOURS), F.lit(BATCHES - 1))
    path = scratch(spark, "arriving-events")
    tables.written_in_turn(events, path, part, BATCHES)
    return tables.in_batches(spark, path, ", ".join(f"{c} {t}" for c, t in events.dtypes))


ARRIVING = f"select *, least(((day(ts) - 1) * 24 + hour(ts) + event_id % {DELAY}) // {BATCH_HOURS}, {BATCHES - 1}) as part from events"


@query("q34_stream_running_count", "select event_type as grp, event_id, row_number() over (partition by event_type order by epoch_us(ts) // 1000, event_id) as n from events where epoch_us(ts) // 1000 <= (select max(epoch_us(ts) // 1000) from events) - 86400000")
def q34(spark, sf_dir):
    # The last day is still held back: rows of it could come.
    stream = arriving_events(spark, sf_dir).withColumn("grp", F.col("event_type"))
    counted = ordered.run_ordered(ordered.ordered_counts(stream, "1 day", cell="1 day"))
    return ordered.running_totals(counted).select("grp", F.col("id").alias("event_id"), "n")


def sign_kind() -> F.Column:
    return F.when(F.col("event_type") == "signup", "JOIN").when(F.col("event_type") == "purchase", "LEAVE").otherwise("ALIVE")


#: Signs that count, with what stood before and comes after; then changes by signs and by the clock.
MEMBER_STATES = f"""
with s as (select user_id as host, epoch_us(ts) // 1000 as ms, case event_type when 'signup' then 0 when 'purchase' then 2 else 1 end as kind from events),
n as (select *, last_value(case when kind <> 1 then kind end ignore nulls) over w as nk, last_value(case when kind <> 1 then ms end ignore nulls) over w as nm from s window w as (partition by host order by ms, kind rows between unbounded preceding and current row)),
e as (select host, ms, kind, lead(ms) over w as nxt, lag(kind) over w as pk, ms - lag(ms) over w as d from n where not (kind = 1 and coalesce(nk, 0) = 2 and ms <= nm + {SILENCE * 1000}) window w as (partition by host order by ms, kind)),
own as (select host, ms, ['JOINING', 'ACTIVE', 'LEFT'][kind + 1] as status, case when pk = 0 then 'JOINING' when pk = 2 and d <= {SILENCE * 1000} then 'LEFT' when pk = 1 and d <= {SILENCE * 1000} then 'ACTIVE' when pk = 1 and d <= {SILENCE * 2000} then 'SUSPECTED' when pk = 1 and d <= {SILENCE * 3000} then 'FAILED' end as was from e),
clock as (select host, ms + k * {SILENCE * 1000} as ms, case when kind = 2 then 'REMOVED' else ['SUSPECTED', 'FAILED', 'REMOVED'][k] end as status, nxt from e, generate_series(1, 3) g(k) where kind = 1 or (kind = 2 and k = 1))
select host, ms, status from own where status is distinct from was
union all select host, ms, status from clock where (nxt is null or ms < nxt) and ms <= (select max(ms) from s)
"""


@query("q56_member_states", MEMBER_STATES)
def q56(spark, sf_dir):
    signs = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.floor(v.micros("ts") / 1000).alias("ms"), sign_kind().alias("kind"))
    return members.status_changes(signs, SILENCE, SILENCE, SILENCE).select("host", "ms", "status")


@query("q57_stream_member_states", MEMBER_STATES)
def q57(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    path = scratch(spark, "signs")
    # By time of arrival, in three batches; the last closes all that is due.
    tables.written_in_turn(events, path, F.floor((F.dayofmonth("ts") - 1) / 11), 3)
    stream = tables.in_batches(spark, path, ", ".join(f"{c} {t}" for c, t in events.dtypes))
    signs = stream.select(F.col("user_id").alias("host"), "ts", sign_kind().alias("kind"))
    states = ordered.run_ordered(ordered.member_states(signs, SILENCE, SILENCE, SILENCE))
    return states.select(F.col("host").cast("long").alias("host"), "ms", "status")


@query("q58_stream_member_upsert", v.MEMBER_LATEST)
def q58(spark, sf_dir):
    updates, path = v.member_updates(spark, sf_dir), scratch(spark, "updates")
    tables.written_in_turn(updates, path, F.col("arrival") % 3, 3)
    stream = tables.in_batches(spark, path, ", ".join(f"{c} {t}" for c, t in updates.dtypes))
    held = tables.KeyedTable(spark, scratch(spark, "members"), {"status": "string", "ts_us": "long"})
    return held.run(stream, scratch(spark, "members-state"))


def streamed_rates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table = tables.WindowedRates(spark, scratch(spark, "rates"), LATE)
    return table.run(arriving_events(spark, sf_dir), scratch(spark, "rates-state"), key="event_type", id_col="event_id")


MARKED = f"select *, (select max(ts) from ({ARRIVING}) b where b.part < a.part) - interval {LATE} seconds as watermark from ({ARRIVING}) a"
LATE_ROW = "coalesce(date_trunc('hour', ts) + interval 1 hour <= watermark, false)"


@query("q59_stream_rates", f'select date_trunc(\'hour\', ts) as "window", event_type as key, count(*) as n from ({MARKED}) where not {LATE_ROW} group by 1, 2')
def q59(spark, sf_dir):
    return streamed_rates(spark, sf_dir)[0]


@query("q60_stream_late_rows", f"select event_id as id, ts, event_type as key, watermark from ({MARKED}) where {LATE_ROW}")
def q60(spark, sf_dir):
    return streamed_rates(spark, sf_dir)[1]
