"""The frames that queries share, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import in_order
from ..functions.text import numbered  # noqa: F401  q39 numbers nodes by cells
from ..operators.blocks import allocate_sequence
from ..sources.files import lines_of_texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> F.Column:
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col(ts))


def csv_value() -> F.Column:
    return F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props")


def event_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as CSV tuples, keyed by their line in time order."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", csv_value().alias("value"))
    lined = in_order(events, "ts", "event_id")
    return lined.select("line_num", F.concat(F.lit("events:"), F.col("line_num").cast("string")).alias("key"), "value")


EVENT_TUPLES = "select row_number() over (order by ts, event_id) - 1 as line_num, 'events:' || cast(row_number() over (order by ts, event_id) - 1 as varchar) as key, concat_ws(',', event_id, user_id, event_type, props) as value from events"


def plain_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as CSV values without line numbers, for operators that need none."""
    return table(spark, sf_dir, "events").select("event_id", csv_value().alias("value"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), "text")
    return lines_of_texts(docs)


DOCUMENT_LINES = "select doc_id, source as file, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents"


def block_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicas of event blocks: some lost, some doubled, later replicas with later times."""
    events = table(spark, sf_dir, "events")
    blocks = events.select(F.col("event_type").alias("file"), F.col("event_id").alias("block_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client"), micros("ts").alias("ts"), F.col("props").alias("data"), "event_id")
    placed = allocate_sequence(blocks, "ts", "event_id").withColumn("replica", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    # One pass: how many copies of each block a replica holds.
    copies = F.when(F.col("block_id") % 7 == F.col("replica"), 0).otherwise(1) + F.when(F.col("block_id") % 11 == F.col("replica"), 1).otherwise(0)
    held = placed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return held.select("file", "replica", "block_id", "client", "seq", (F.col("ts") + F.col("replica")).alias("ts"), "data")


BLOCKS = "select event_type as file, event_id as block_id, 'c' || cast(user_id as varchar) as client, epoch_us(ts) as ts, props as data, row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events"
BLOCK_COPIES = f"select file, r as replica, block_id, client, seq, ts + r as ts, data from ({BLOCKS}) b, (values (0), (1), (2)) v(r), generate_series(1, (case when block_id % 7 = r then 0 else 1 end) + (case when block_id % 11 = r then 1 else 0 end)) g(i)"
MERGED = f"select file, block_id, client, seq, ts, data, row_number() over (partition by file order by client, seq, ts, block_id) as pos from (select *, row_number() over (partition by block_id order by ts, replica) as rn from ({BLOCK_COPIES})) where rn = 1"


def ring_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("file"))


def ring_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("node"))


def placement_sql(where: str = "true") -> str:
    return f"select file, node, rn::int as replica from (select c_name as file, s_name as node, row_number() over (partition by c_name order by sha1(s_name) < sha1(c_name), sha1(s_name)) as rn from customer, (select * from supplier where {where})) where rn <= 3"


def member_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as updates of hosts (user), versions (event id) and states (event type)."""
    events = table(spark, sf_dir, "events")
    statuses = {"click": "ACTIVE", "view": "ACTIVE", "purchase": "LEFT", "error": "FAILED"}
    status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in statuses.items()], F.lit("SUSPECTED"))
    updates = allocate_sequence(events.withColumn("client", F.col("user_id")), "ts", "event_id")
    return updates.select(F.col("user_id").alias("host"), (F.col("event_id") % 5).alias("incarnation"), F.floor(F.col("seq") / 2).alias("heartbeat"), status.alias("status"), micros("ts").alias("ts_us"), F.col("seq").alias("arrival"))


MEMBER_UPDATES = "select user_id as host, event_id % 5 as incarnation, (row_number() over (partition by user_id order by ts, event_id) - 1) // 2 as heartbeat, case event_type when 'click' then 'ACTIVE' when 'view' then 'ACTIVE' when 'purchase' then 'LEFT' when 'error' then 'FAILED' else 'SUSPECTED' end as status, epoch_us(ts) as ts_us, row_number() over (partition by user_id order by ts, event_id) - 1 as arrival from events"
MEMBER_LATEST = f"select host, incarnation, heartbeat, arrival, status, ts_us from (select *, row_number() over (partition by host order by incarnation desc, heartbeat desc, arrival) as rn from ({MEMBER_UPDATES})) where rn = 1"
