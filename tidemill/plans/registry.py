"""All queries of the library outside the training-data subpackage, with SQL for their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import scratch
from ..functions.text import csv_field, parse_kv
from ..operators import blocks, catalog, grep, members, rates, ring, tuples
from ..sources import files
from ..streaming import runs
from . import admin_queries, file_queries, stream_queries  # noqa: F401  they register their queries
from . import views as v
from .registered import QUERIES, SQL, Query, query

#: Patterns, thresholds and sizes of the queries.
WORD, LITERAL, GAP, LOW, HIGH, PARTITIONS = "the", "error", 6 * 3600, 2, 5, 16
FIELD = "trim(coalesce(string_split(value, ',')[{}], ''))"


PLAIN = "select event_id, concat_ws(',', event_id, user_id, event_type, props) as value from events"


@query("q01_identity", f"select key, value from ({v.EVENT_TUPLES})")
def q01(spark, sf_dir):
    return tuples.identity(v.event_tuples(spark, sf_dir))


@query("q02_filter_literal", f"select key, value from ({v.EVENT_TUPLES}) where contains(value, '{LITERAL}')")
def q02(spark, sf_dir):
    return tuples.identity(tuples.filter_literal(v.event_tuples(spark, sf_dir), LITERAL))


@query("q03_transform_first3", f"select key, array_to_string(string_split(value, ',')[1:3], ',') as value from ({v.EVENT_TUPLES})")
def q03(spark, sf_dir):
    return tuples.identity(tuples.transform_fields(v.event_tuples(spark, sf_dir)))


@query("q04_filter_count", f"select {FIELD.format(3)} as grp, count(*) as n from ({PLAIN}) where contains(value, 'e') group by 1")
def q04(spark, sf_dir):
    return tuples.final_count(tuples.filter_literal(v.plain_tuples(spark, sf_dir), "e"), 2)


@query("q05_filter_transform", f"select key, array_to_string(string_split(value, ',')[1:3], ',') as value from ({v.EVENT_TUPLES}) where contains(value, '{LITERAL}')")
def q05(spark, sf_dir):
    return tuples.identity(tuples.transform_fields(tuples.filter_literal(v.event_tuples(spark, sf_dir), LITERAL)))


@query("q06_running_count", f"select line_num, grp, row_number() over (partition by grp order by line_num) as n from (select line_num, {FIELD.format(2)} as grp from ({v.EVENT_TUPLES}))")
def q06(spark, sf_dir):
    return tuples.running_count(v.event_tuples(spark, sf_dir), 1)


@query("q07_count_missing_column", f"select grp, count(*) as n, sum(case when last_grp = grp then 1 else 0 end)::bigint as same from (select {FIELD.format(100)} as grp, {FIELD.format(-1)} as last_grp from ({PLAIN})) group by 1")
def q07(spark, sf_dir):
    held = tuples.grouped_by_field(v.plain_tuples(spark, sf_dir), 99).withColumn("last_grp", csv_field("value", -1))
    return held.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("last_grp") == F.col("grp")).cast("long")).alias("same"))


@query("q08_grep_lines_numbered", f"select doc_id, concat_ws(':', file, line_no, line) as out from ({v.DOCUMENT_LINES}) where regexp_matches(line, 'than?t') and line <> ''")
def q08(spark, sf_dir):
    return grep.numbered_output(grep.grep(v.document_lines(spark, sf_dir), r"than\?t")).select("doc_id", "out")


@query("q09_grep_ignorecase_count", f"select file, count(*) as n from ({v.DOCUMENT_LINES}) where regexp_matches(line, '(?i){WORD}') and line <> '' group by 1")
def q09(spark, sf_dir):
    return grep.grep(v.document_lines(spark, sf_dir), WORD, ignore_case=True).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("q10_grep_extended", f"select doc_id, line_no, line from ({v.DOCUMENT_LINES}) where regexp_matches(line, '[0-9]{{3}}[^0-9]|(the|un) ') and line <> ''")
def q10(spark, sf_dir):
    return grep.grep(v.document_lines(spark, sf_dir), "[0-9]{3}[^0-9]|(the|un) ", extended=True).select("doc_id", "line_no", "line")


@query("q11_grep_counts_total", f"select file, count(*) as n from ({v.DOCUMENT_LINES}) where contains(line, '{WORD}') group by rollup(file)")
def q11(spark, sf_dir):
    return grep.counts_and_total(grep.grep(v.document_lines(spark, sf_dir), WORD))


@query("q12_grep_invert_fixed", f"select doc_id, line_no, line from ({v.DOCUMENT_LINES}) where not contains(line, '{WORD}') and line <> ''")
def q12(spark, sf_dir):
    return grep.grep(v.document_lines(spark, sf_dir), WORD, fixed=True, invert=True).select("doc_id", "line_no", "line")


@query("q13_grep_word_first", f"select file, doc_id, line_no, line from (select *, row_number() over (partition by file order by doc_id, line_no) as rn from ({v.DOCUMENT_LINES}) where regexp_matches(line, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){WORD}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') and line <> '') where rn <= 5")
def q13(spark, sf_dir):
    return grep.grep(v.document_lines(spark, sf_dir), WORD, word=True, first=5, order=("doc_id", "line_no")).select("file", "doc_id", "line_no", "line")


@query("q14_grep_context", f"select doc_id, line_no, line from (select *, max(case when contains(line, '{WORD}') then 1 else 0 end) over (partition by doc_id order by line_no rows between 2 preceding and 1 following) as near from ({v.DOCUMENT_LINES})) where near = 1")
def q14(spark, sf_dir):
    return grep.grep_context(v.document_lines(spark, sf_dir), WORD, 1, 2, ("doc_id",), fixed=True).select("doc_id", "line_no", "line")


@query("q15_ring_placement", v.placement_sql())
def q15(spark, sf_dir):
    return ring.placement(v.ring_files(spark, sf_dir), v.ring_nodes(spark, sf_dir))


@query("q16_files_per_node", f"select node, count(*) as n from ({v.placement_sql()}) group by 1")
def q16(spark, sf_dir):
    return ring.placement(v.ring_files(spark, sf_dir), v.ring_nodes(spark, sf_dir)).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query("q17_rebalance_after_node_loss", f"select coalesce(a.file, b.file) as file, coalesce(a.node, b.node) as node, case when a.file is null then 'fetch' else 'delete' end as change from ({v.placement_sql()}) a full join ({v.placement_sql('s_suppkey <> 7')}) b on a.file = b.file and a.node = b.node where a.file is null or b.file is null")
def q17(spark, sf_dir):
    files, nodes = v.ring_files(spark, sf_dir), v.ring_nodes(spark, sf_dir)
    return ring.moves(files, nodes, nodes.where("s_suppkey <> 7"))


@query("q18_block_merge", f"select file, block_id, client, seq, ts, pos from ({v.MERGED})")
def q18(spark, sf_dir):
    return blocks.merged(v.block_copies(spark, sf_dir)).select("file", "block_id", "client", "seq", "ts", "pos")


@query("q19_block_order_violations", f"select file, client, block_id, seq, last_seq from (select *, lag(seq) over (partition by file, client order by sha1(cast(block_id as varchar))) as last_seq from ({v.BLOCKS})) where seq <= last_seq")
def q19(spark, sf_dir):
    arrived = v.block_copies(spark, sf_dir).select("file", "client", "block_id", "seq").distinct()
    found = blocks.order_violations(arrived.withColumn("pos", F.sha1(F.col("block_id").cast("string"))))
    return found.select("file", "client", "block_id", "seq", "last_seq")


@query("q20_block_seq_gaps", f"select client, seq, seq - last_seq - 1 as missing from (select client, seq, lag(seq) over (partition by client order by seq) as last_seq from (select distinct client, seq from ({v.BLOCK_COPIES}) where replica = 0)) where seq - last_seq > 1")
def q20(spark, sf_dir):
    return blocks.sequence_gaps(v.block_copies(spark, sf_dir).where("replica = 0"))


@query("q21_file_concat", f"select file, segment, (sum(length) over (partition by file order by segment) - length)::bigint as start, length, sha1(data) as sha1 from (select file, (pos - 1) // 256 as segment, string_agg(data, '' order by pos) as data, strlen(string_agg(data, '' order by pos)) as length from ({v.MERGED}) group by 1, 2)")
def q21(spark, sf_dir):
    return blocks.content(blocks.merged(v.block_copies(spark, sf_dir))).select("file", "segment", "start", "length", F.sha1("data").alias("sha1"))


@query("q22_replica_divergence", f"with a as (select file, replica, block_id, count(*) as copies from ({v.BLOCK_COPIES}) group by all), e as (select distinct file, block_id, r as replica from ({v.BLOCK_COPIES}), (values (0), (1), (2)) w(r)) select file, replica, count(*) as expected, count(copies) as present, coalesce(sum(copies - 1), 0)::bigint as surplus from e left join a using (file, replica, block_id) group by 1, 2 having count(copies) < count(*) or coalesce(sum(copies - 1), 0) > 0")
def q22(spark, sf_dir):
    actual = v.block_copies(spark, sf_dir)
    expected = actual.select("file", "block_id").distinct().withColumn("replica", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return blocks.divergence(expected, actual)


@query("q23_sequence_allocation", "select client, event_id, row_number() over (partition by client order by ts, event_id) - 1 as seq from (select *, 'c' || cast(user_id as varchar) as client from events)")
def q23(spark, sf_dir):
    appends = v.table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client"))
    return blocks.allocate_sequence(appends, "ts", "event_id").select("client", "event_id", "seq")


@query("q24_member_latest", v.MEMBER_LATEST)
def q24(spark, sf_dir):
    return members.merge_versions(v.member_updates(spark, sf_dir), "status", "ts_us")


@query("q25_failure_gaps", f"select host, silent_from, ts as silent_to from (select user_id as host, ts, lag(ts) over (partition by user_id order by ts) as silent_from from events) where ts - silent_from >= interval '{GAP + 1} seconds'")
def q25(spark, sf_dir):
    return members.silence_gaps(v.table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), "ts"), GAP)


@query("q26_member_diff", "with c as (select distinct user_id as host from events where event_type = 'error' and day(ts) >= 20), k as (select distinct user_id as host from events where event_type = 'error' and day(ts) <= 10) select host, 'joined' as change from (select host from c except select host from k) union all select host, 'departed' from (select host from k except select host from c)")
def q26(spark, sf_dir):
    errors = v.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("host"), F.dayofmonth("ts").alias("day"))
    current, known = errors.where("day >= 20").select("host").distinct(), errors.where("day <= 10").select("host").distinct()
    return members.joined(current, known).withColumn("change", F.lit("joined")).unionByName(members.departed(current, known).withColumn("change", F.lit("departed")))


@query("q27_expired_and_suspects", f"select host, status, ts_us from ({v.MEMBER_LATEST}) where not (status in ('FAILED', 'LEFT') and (select max(epoch_us(ts)) from events) - ts_us > 864000000000) and status <> 'ACTIVE'")
def q27(spark, sf_dir):
    # One row, whatever the table.
    now = v.table(spark, sf_dir, "events").agg(F.max(v.micros("ts")).alias("now"))
    latest = members.merge_versions(v.member_updates(spark, sf_dir), "status", "ts_us")
    seen = latest.withColumn("ts", F.col("ts_us")).crossJoin(F.broadcast(now))
    return members.unexpired(seen, cleanup=10 * 86400 * 1_000_000).where("status <> 'ACTIVE'").select("host", "status", "ts_us")


@query("q28_rate_per_hour", 'select date_trunc(\'hour\', ts) as "window", event_type, count(*) as n from events group by 1, 2')
def q28(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return rates.rates(v.table(spark, sf_dir, "events"), hour, "event_type")



@query(
    "q29_autoscale_decisions",
    f"select w as hour, event_type, tasks, rate, case when event_type = 'signup' then 'HOLD' when rate > {HIGH} * tasks and tasks < 10 then 'UP' when rate < {LOW} * tasks and tasks > 1 then 'DOWN' else 'HOLD' end as decision from (select w, event_type, count(*) as tasks, sum(n)::bigint as rate from (select date_trunc('hour', ts) as w, event_type, user_id % 3 as task, count(*) as n from events group by 1, 2, 3) group by 1, 2)",
)
def q29(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    events = v.table(spark, sf_dir, "events").withColumn("task", F.col("user_id") % 3)
    counted = rates.rates(events, hour, "event_type", "task")
    tasks = counted.select(F.struct("window", "event_type").alias("stage"), (F.col("event_type") == "signup").alias("stateful"), F.col("n").alias("rate"))
    return rates.decisions(tasks, LOW, HIGH).select(F.col("stage.window").alias("hour"), "stage.event_type", "tasks", "rate", "decision")


TWICE = "select event_id as tuple_id, concat_ws(',', event_id, user_id, event_type, props) as value from events union all select event_id, concat_ws(',', event_id, user_id, event_type, props) from events where event_id % 11 = 0"


@query("q30_dedup_tuples", f"select distinct tuple_id, value from ({TWICE})")
def q30(spark, sf_dir):
    held = v.plain_tuples(spark, sf_dir).withColumnRenamed("event_id", "tuple_id")
    return tuples.dedup_tuples(held.unionAll(held.where("tuple_id % 11 = 0"))).select("tuple_id", "value")


@query("q31_partition_histogram", f"select concat('0x', substr(sha1(cast(event_id as varchar)), 1, 8))::bigint % {PARTITIONS} as part, count(*) as n from events group by 1")
def q31(spark, sf_dir):
    part = tuples.partition_of(F.col("event_id").cast("string"), PARTITIONS)
    return v.table(spark, sf_dir, "events").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.table_stream(spark, sf_dir, "events").select("event_id", v.csv_value().alias("value"))


@query("q32_stream_filter_count", SQL["q04_filter_count"])
def q32(spark, sf_dir):
    held = tuples.filter_literal(event_stream(spark, sf_dir), "e")
    return runs.run_to_end(tuples.final_count(held, 2), "complete")


@query("q33_stream_exactly_once", SQL["q30_dedup_tuples"])
def q33(spark, sf_dir):
    # A repeat comes within an hour of its event, so ids are kept no longer.
    held = runs.table_stream(spark, sf_dir, "events").select(F.col("event_id").alias("tuple_id"), v.csv_value().alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    both = held.unionAll(held.where("tuple_id % 11 = 0"))
    return runs.run_to_end(runs.exactly_once(both, time_col="ts")).select("tuple_id", "value")


@query("q35_round_robin_placement", "select event_type as stage, event_id, (row_number() over (partition by event_type order by ts, event_id) - 1) % 5 as worker from events")
def q35(spark, sf_dir):
    tasks = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), "event_id", "ts")
    return rates.round_robin(tasks, 5, "ts", "event_id", by="stage").select("stage", "event_id", F.col("worker").cast("long").alias("worker"))


@query("q36_under_replicated", f"select file, count(*) as copies from ({v.placement_sql()}) where node not in (select s_name from supplier where s_suppkey % 5 = 0) group by 1 having count(*) < 3 union all select file, 0 from ({v.placement_sql()}) group by 1 having bool_and(node in (select s_name from supplier where s_suppkey % 5 = 0))")
def q36(spark, sf_dir):
    nodes = v.ring_nodes(spark, sf_dir)
    expected = ring.placement(v.ring_files(spark, sf_dir), nodes)
    actual = ring.missing_copies(expected, expected.join(nodes.where("s_suppkey % 5 = 0").select("node"), "node", "left_semi"))
    return ring.under_replicated(expected, actual)


@query("q37_grep_only_matching", f"select doc_id, line_no, unnest(regexp_extract_all(line, '[0-9]+')) as line from ({v.DOCUMENT_LINES}) where regexp_matches(line, '[0-9]+')")
def q37(spark, sf_dir):
    return grep.grep_only(v.document_lines(spark, sf_dir), "[0-9]+", extended=True).select("doc_id", "line_no", "line")


@query("q38_false_positives", f"select host, count(*) as n from (select host, status, lag(status) over (partition by host order by arrival) as last from ({v.MEMBER_UPDATES})) where last = 'SUSPECTED' and status = 'ACTIVE' group by 1")
def q38(spark, sf_dir):
    return members.false_positives(v.member_updates(spark, sf_dir), "arrival")


@query("q39_ring_catalog", "select s_name as node, sha1(s_name) as node_pos, row_number() over (order by sha1(s_name)) - 1 as rank from supplier")
def q39(spark, sf_dir):
    nodes = v.ring_nodes(spark, sf_dir).select("node", F.sha1("node").alias("node_pos"))
    return v.numbered(nodes, ring.cell("node_pos"), "node_pos", name="rank").select("node", "node_pos", "rank")


@query("q40_block_duplicates", f"select block_id, count(*) as copies from ({v.BLOCK_COPIES}) where replica = 1 group by 1 having count(*) > 1")
def q40(spark, sf_dir):
    return blocks.duplicate_ids(v.block_copies(spark, sf_dir).where("replica = 1"))


@query("q41_rate_changes", "select event_type, ts, n - coalesce(lag(n) over (partition by event_type order by ts), 0) as gained from (select event_type, date_trunc('hour', ts) as ts, sum(count(*)) over (partition by event_type order by date_trunc('hour', ts))::bigint as n from events group by 1, 2)")
def q41(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    counted = rates.rates(v.table(spark, sf_dir, "events"), hour, "event_type").withColumnRenamed("window", "ts")
    w = Window.partitionBy("event_type").orderBy("ts")
    summed = counted.withColumn("count", F.sum("n").over(w))
    return summed.select("event_type", "ts", (F.col("count") - F.lag("count", 1, 0).over(w)).alias("gained"))


@query("q42_files_on_node", f"select file, substr(sha1(file), 1, 16) as file_id from ({v.placement_sql()}) where node = (select min(s_name) from supplier)")
def q42(spark, sf_dir):
    nodes = v.ring_nodes(spark, sf_dir)
    return catalog.files_on(ring.placement(v.ring_files(spark, sf_dir), nodes), nodes.agg(F.min("node").alias("node")))


@query("q43_replicas_of_file", f"select file, substr(sha1(file), 1, 16) as file_id, node, sha1(node) as node_pos, replica from ({v.placement_sql()}) where file = (select min(c_name) from customer)")
def q43(spark, sf_dir):
    files = v.ring_files(spark, sf_dir)
    return catalog.replicas_of(ring.placement(files, v.ring_nodes(spark, sf_dir)), files.agg(F.min("file").alias("file")))


@query("q44_members_by_position", f"select host, sha1(cast(host as varchar)) as node_pos, row_number() over (order by sha1(cast(host as varchar))) - 1 as rank from ({v.MEMBER_LATEST}) where status in ('ACTIVE', 'JOINING')")
def q44(spark, sf_dir):
    latest = members.merge_versions(v.member_updates(spark, sf_dir), "status")
    return catalog.members_by_position(latest).select("host", "node_pos", "rank")


@query("q45_client_sequences", f"select client, min(seq) as first, max(seq) as last, count(distinct seq) as n from ({v.BLOCK_COPIES}) where replica = 0 group by 1")
def q45(spark, sf_dir):
    return catalog.sequences(v.block_copies(spark, sf_dir).where("replica = 0"))


@query("q46_response_tally", "select count(*) filter (n % 3 <> 0) as answered, count(*) filter (n % 3 = 0) as failed, coalesce(sum(n) filter (n % 3 <> 0), 0)::bigint as count from (select source, count(*) as n from documents group by 1)")
def q46(spark, sf_dir):
    hosts = v.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("vm")).count()
    answers = hosts.withColumn("error", F.when(F.col("count") % 3 == 0, "no answer"))
    return catalog.tally(answers).select("answered", "failed", "count")


@query("q47_read_my_writes", "select distinct event_type as file from events where event_type not in (select event_type from events where user_id = 3 and day(ts) = 1)")
def q47(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    files = events.select(F.col("event_type").alias("file")).distinct()
    pending = events.where((F.dayofmonth("ts") == 1)).select(F.col("event_type").alias("file"), F.col("user_id").cast("string").alias("client"))
    return catalog.readable(files, pending, "3")


@query("q48_sampled_peers", "select event_type, host from (select event_type, user_id as host, row_number() over (partition by event_type order by sha1('7:' || cast(user_id as varchar)), user_id) as rn from (select distinct event_type, user_id from events)) where rn <= 3")
def q48(spark, sf_dir):
    peers = v.table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("host")).distinct()
    return catalog.sampled(peers, 3, "event_type").select("event_type", "host")


@query("q49_grep_response", f"with m as (select *, row_number() over (partition by file order by doc_id, line_no) as rn, count(*) over (partition by file) as n from ({v.DOCUMENT_LINES}) where contains(line, '{WORD}')) select f.file, coalesce(m.n, 0) as count, doc_id, line_no, line from (select distinct file from ({v.DOCUMENT_LINES})) f left join m on f.file is not distinct from m.file and rn <= 20")
def q49(spark, sf_dir):
    return grep.response(v.document_lines(spark, sf_dir), WORD, 20, ("doc_id", "line_no")).select("file", "count", "doc_id", "line_no", "line")


@query("q50_tuple_files", "select cast(event_id as varchar) as key, concat_ws(',', user_id, event_type, props) as value from events")
def q50(spark, sf_dir):
    path = scratch(spark, "tuple-files")
    value = F.concat_ws(",", F.col("user_id").cast("string"), "event_type", "props")
    files.write_tuples(v.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), value.alias("value")), path)
    key, value = parse_kv("value", "key")
    return files.tuple_source(spark, path).select(key.alias("key"), value.alias("value"))


@query("q51_log_files", "select date_trunc('milliseconds', ts) as ts, event_type as tag, props as message from events")
def q51(spark, sf_dir):
    path = scratch(spark, "log-files")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    v.table(spark, sf_dir, "events").select(F.format_string("[%s] [%s] %s", stamp, "event_type", "props")).write.text(path)
    return files.log_lines(files.lines_with_numbers(spark, path)).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "tag", "message")


@query("q52_rate_by_time", "select event_type, ts, (n - lag(n) over w) / date_diff('second', lag(ts) over w, ts) as rate from (select event_type, date_trunc('hour', ts) as ts, sum(count(*)) over (partition by event_type order by date_trunc('hour', ts))::bigint as n from events group by 1, 2) window w as (partition by event_type order by ts)")
def q52(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    counted = rates.rates(v.table(spark, sf_dir, "events"), hour, "event_type").withColumnRenamed("window", "ts")
    summed = counted.withColumn("count", F.sum("n").over(Window.partitionBy("event_type").orderBy("ts")))
    return rates.rate_changes(summed, "event_type").select("event_type", "ts", "rate")


@query("q53_hosts_by_prefix", "select host, coalesce(min(vm), 1) as vm from (select distinct 'u' || cast(user_id as varchar) || '.y' as host from events) left join (select 'u' || cast(n_nationkey as varchar) as short, n_nationkey + 100 as vm from nation) on starts_with(host, short) group by 1")
def q53(spark, sf_dir):
    name = lambda key, end: F.concat(F.lit("u"), F.col(key).cast("string"), F.lit(end))
    hosts = v.table(spark, sf_dir, "events").select(name("user_id", ".y").alias("host")).distinct()
    machines = v.table(spark, sf_dir, "nation").select(name("n_nationkey", ".x").alias("hostname"), (F.col("n_nationkey") + 100).alias("vm"))
    return members.hosts_of(hosts, machines)


@query("q54_pipeline_from_texts", SQL["q05_filter_transform"])
def q54(spark, sf_dir):
    return runs.Pipeline.parse(f"filter:{LITERAL}", "transform", "identity", stages=3).apply(v.event_tuples(spark, sf_dir))


@query("q55_merge_job", SQL["q18_block_merge"])
def q55(spark, sf_dir):
    done = catalog.merge_files(v.block_copies(spark, sf_dir), scratch(spark, "merge-staging"), scratch(spark, "merged-files"))
    return done.select("file", "block_id", "client", "seq", "ts", "pos")


def queries() -> dict[str, Query]:
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
