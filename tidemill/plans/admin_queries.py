"""Queries over configurations, files as wholes, appends and deletions, positions and traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import in_order
from ..functions.scratch import scratch
from ..functions.text import parse_kv
from ..operators import blocks, catalog, grep, members, ring, tuples
from ..sources import files
from ..streaming import runs
from . import views as v
from .registered import query

#: Hosts of events by user; every third one is known by its address only.
HOSTS = "select distinct case when user_id % 3 = 0 then 'x' else 'n' end || cast(user_id % 25 as varchar) as host, '10.0.0.' || cast(user_id % 25 as varchar) as ip from events"


@query("q71_config_hosts", f"select host, ip, n_nationkey + 100 as vm from ({HOSTS}) left join nation on ip = '10.0.0.' || cast(n_nationkey as varchar)")
def q71(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    path = scratch(spark, "config")
    known = v.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("vm"), F.concat(F.lit("n"), key).alias("hostname"), F.concat(F.lit("10.0.0."), key).alias("ip"), F.concat(F.lit("machine."), key, F.lit(".log")).alias("log_file"))
    files.write_machines(known, path)
    number = (F.col("user_id") % 25).cast("string")
    hosts = v.table(spark, sf_dir, "events").select(F.concat(F.when(F.col("user_id") % 3 == 0, "x").otherwise("n"), number).alias("host"), F.concat(F.lit("10.0.0."), number).alias("ip")).distinct()
    return catalog.own_machine(hosts, files.machines(spark, path)).select("host", "ip", "vm")


@query("q72_whole_files", "select kind as file, strlen(content)::bigint as length, sha1(content) as sha1 from (select 'kind=' || event_type as kind, string_agg(props || chr(10), '' order by ts, event_id) as content from events group by 1)")
def q72(spark, sf_dir):
    path = scratch(spark, "whole-files")
    own = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "ts", "event_id", F.col("props").alias("value"))
    own.repartition("kind").sortWithinPartitions("kind", "ts", "event_id").select("kind", "value").write.partitionBy("kind").text(path)
    there = files.file_bytes(spark, f"{path}/kind=*").select(F.regexp_extract("path", r"(kind=[^/]*)/[^/]*$", 1).alias("file"), "length", F.sha1("content").alias("sha1"))
    # All kinds are asked for, and one that isn't there.
    asked = own.select(F.concat(F.lit("kind="), "kind").alias("file")).distinct().unionByName(spark.createDataFrame([("kind=none",)], "file string"))
    return there.join(catalog.existing(asked, there), "file", "left_semi")


@query("q73_appended_blocks", "select event_type as file, 'c' || cast(user_id as varchar) as client, count(*) as n from events where event_type <> 'error' group by 1, 2")
def q73(spark, sf_dir):
    path = scratch(spark, "appended")
    # Each block once, of whichever replica holds it; one client in four creates the files, the others append in two writes.
    own = blocks.deduplicated(v.block_copies(spark, sf_dir)).withColumn("turn", F.substring("client", 2, 20).cast("long") % 4)
    part = lambda n: own.where(F.col("turn") == n).drop("turn")
    blocks.create_file(part(0), path)
    blocks.append_blocks(part(1), path)
    blocks.append_blocks(catalog.appended(part(2), part(3)), path)
    kept = catalog.without_files(spark.read.parquet(path), spark.createDataFrame([("error",)], "file string"))
    return kept.groupBy("file", "client").agg(F.count(F.lit(1)).alias("n"))


@query("q74_output_records", "select case when user_id % 2 = 0 then cast(event_id as varchar) else '' end as key, case when user_id % 2 = 0 then props else event_type end as value from events where user_id % 3 <> 0")
def q74(spark, sf_dir):
    # Records of a program: some without a tab, some blank.
    line = F.when(F.col("user_id") % 3 == 0, " \t ").when(F.col("user_id") % 2 == 0, F.concat_ws("\t", F.col("event_id").cast("string"), "props")).otherwise(F.col("event_type"))
    held = tuples.skip_blank(v.table(spark, sf_dir, "events").select(line.alias("value")))
    key, value = parse_kv("value")
    return held.select(key.alias("key"), value.alias("value"))


@query("q75_reachable_peers", f"select host, status from ({v.MEMBER_LATEST}) where host <> 7 and status <> 'LEFT'")
def q75(spark, sf_dir):
    latest = members.merge_versions(v.member_updates(spark, sf_dir), "status")
    return members.reachable(latest.withColumn("host", F.col("host").cast("string")), "7").select(F.col("host").cast("long").alias("host"), "status")


@query("q76_surplus_copies", f"select file, node from ({v.placement_sql()}) except select file, node from ({v.placement_sql('s_suppkey % 4 <> 1')})")
def q76(spark, sf_dir):
    placed, nodes = v.ring_files(spark, sf_dir), v.ring_nodes(spark, sf_dir)
    return ring.surplus_copies(ring.placement(placed, nodes.where("s_suppkey % 4 <> 1")), ring.placement(placed, nodes))


@query("q77_positional_zip", "select s_name, c_name from (select s_name, row_number() over (order by s_suppkey) as rn from supplier) join (select c_name, row_number() over (order by c_custkey desc) as rn from customer) using (rn)")
def q77(spark, sf_dir):
    suppliers = in_order(v.table(spark, sf_dir, "supplier").select("s_name", "s_suppkey"), "s_suppkey", name="at")
    customers = in_order(v.table(spark, sf_dir, "customer").select("c_name", "c_custkey"), -F.col("c_custkey"), name="at")
    # As many customers as there are suppliers; the count is one row.
    first = customers.join(F.broadcast(suppliers.agg(F.count(F.lit(1)).alias("most"))), F.col("at") < F.col("most"))
    return catalog.zipped(suppliers.select("s_name", "at"), first.select("c_name", "at"), "at", "at").select("left.s_name", "right.c_name")


@query("q78_stored_pipeline", "select event_id, array_to_string(string_split(concat_ws(',', event_id, user_id, event_type, props), ',')[1:3], ',') as value from events where contains(concat_ws(',', event_id, user_id, event_type, props), 'view')")
def q78(spark, sf_dir):
    # A throttled source, named state and a declared destination; a second run finds nothing new.
    source = lambda: runs.table_stream(spark, sf_dir, "events", files_per_batch=1).select("event_id", v.csv_value().alias("value"))
    dest, state = scratch(spark, "pipeline-out"), scratch(spark, "pipeline-state")
    pipeline = runs.Pipeline.parse("filter:view", "transform")
    pipeline.stream(source(), dest, state, "event_id")
    return pipeline.stream(source(), dest, state, "event_id")


@query("q79_ordered_responses", f"select row_number() over (order by file, doc_id, line_no) - 1 as place, file, doc_id, line_no, line from (select *, row_number() over (partition by file order by doc_id, line_no) as rn from ({v.DOCUMENT_LINES}) where contains(line, 'the')) where rn <= 20")
def q79(spark, sf_dir):
    found = grep.response(v.document_lines(spark, sf_dir), "the", 20, ("doc_id", "line_no")).where("line is not null")
    return in_order(found.select("file", "doc_id", "line_no", "line"), "file", "doc_id", "line_no", name="place").select("place", "file", "doc_id", "line_no", "line")


@query("q80_traffic", "with m as (select user_id as sender, (user_id * 7 + event_id) % 150 as receiver, strlen(props) as bytes from events), s as (select sender as host, count(*) as sent, sum(bytes)::bigint as bytes_sent, 0 as received, 0 as bytes_received from m group by 1 union all select receiver, 0, 0, count(*), sum(bytes)::bigint from m group by 1) select host, sum(sent)::bigint as sent, sum(bytes_sent)::bigint as bytes_sent, sum(received)::bigint as received, sum(bytes_received)::bigint as bytes_received from s group by 1")
def q80(spark, sf_dir):
    return members.traffic(v.table(spark, sf_dir, "events").select(F.col("user_id").alias("sender"), ((F.col("user_id") * 7 + F.col("event_id")) % 150).alias("receiver"), F.octet_length("props").alias("bytes")))


@query("q81_replica_content", f"select file, segment, (sum(length) over (partition by file order by segment) - length)::bigint as start, length, sha1(data) as sha1 from (select file, (pos - 1) // 256 as segment, string_agg(data, '' order by pos) as data, strlen(string_agg(data, '' order by pos)) as length from (select file, data, row_number() over (partition by file order by client, seq, ts, block_id) as pos from (select distinct file, block_id, client, seq, ts, data from ({v.BLOCK_COPIES}) where replica = 1)) group by 1, 2)")
def q81(spark, sf_dir):
    copies = v.block_copies(spark, sf_dir).withColumn("data", F.col("data").cast("binary"))
    return blocks.content(blocks.of_replica(copies, 1)).select("file", "segment", "start", "length", F.sha1("data").alias("sha1"))


@query("q82_state_maps", "select user_id, count(distinct event_type) as kinds, arg_max(props, ts) filter (event_type = 'click') as clicked, count(distinct event_type) + case when bool_or(event_type = 'click') then 0 else 1 end as after, 'seen' as now from events group by 1")
def q82(spark, sf_dir):
    latest = v.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("props", "ts").alias("props"))
    state = F.map_from_entries(F.collect_list(F.struct("event_type", "props")))
    held = latest.groupBy("user_id").agg(state.alias("state")).withColumn("updated", tuples.upserted("state", F.lit("click"), F.lit("seen")))
    get = lambda m: F.try_element_at(m, F.lit("click"))
    return held.select("user_id", F.size("state").cast("long").alias("kinds"), get("state").alias("clicked"), F.size("updated").cast("long").alias("after"), get("updated").alias("now"))
