"""Queries over programs, table functions, block files and log search beyond the first ones."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from ..functions.scratch import scratch
from ..functions.text import csv_field
from ..operators import blocks, catalog, grep, programs, table_functions
from ..sources import block_store
from . import views as v
from .registered import query

PLAIN = "select event_id, concat_ws(',', event_id, user_id, event_type, props) as value from events"
#: Counts lines by their third comma field and answers each with the count so far.
COUNTING = "import sys\nseen = {}\nfor line in sys.stdin:\n    field = line.split('\\t')[1].split(',')[2]\n    seen[field] = seen.get(field, 0) + 1\n    print(field, seen[field], sep='\\t')\n"


@query("q61_external_program", f"select string_split(value, ',')[3] as key, row_number() over (partition by string_split(value, ',')[3] order by event_id)::varchar as value from ({PLAIN})")
def q61(spark, sf_dir):
    tuples = v.plain_tuples(spark, sf_dir).withColumn("grp", csv_field("value", 2)).repartition("grp")
    return programs.external(tuples.select(F.col("event_id").cast("string").alias("key"), "value"), [sys.executable, "-c", COUNTING])


@query("q62_lateral_fields", f"select event_id, (pos - 1)::int as pos, field from (select event_id, unnest(string_split(value, ',')) as field, generate_subscripts(string_split(value, ','), 1) as pos from ({PLAIN})) where contains(field, '7')")
def q62(spark, sf_dir):
    table_functions.register(spark)
    return spark.sql("select event_id, pos, field from {tuples} t, lateral fields_with(t.value, '7')", tuples=v.plain_tuples(spark, sf_dir))


@query("q63_partitioned_counts", "select event_type as grp, event_id as id, row_number() over (partition by event_type order by ts, event_id) as n from events")
def q63(spark, sf_dir):
    table_functions.register(spark)
    events = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), F.col("event_id").alias("id"), "ts")
    return spark.sql("select grp, id, n from count_in_order(table(select grp, id, ts from {events}) partition by grp order by (ts, id))", events=events)


#: Ranges by user: some across blocks, some past the end of their file, some empty.
RANGES = "select distinct event_type as file, user_id * 997 as \"offset\", (user_id % 50) * 40 as length from events"
CONTENT = f"select file, string_agg(data, '' order by pos) as data from ({v.MERGED}) group by 1"


@query("q64_byte_ranges", f"select file, \"offset\", length, substr(data, \"offset\" + 1, length) as bytes from ({RANGES}) join ({CONTENT}) using (file)")
def q64(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    wanted = events.select(F.col("event_type").alias("file"), (F.col("user_id") * 997).alias("offset"), (F.col("user_id") % 50 * 40).alias("length")).distinct()
    index = blocks.block_index(blocks.merged(v.block_copies(spark, sf_dir)))
    return blocks.byte_ranges(index, wanted, cell=4096).withColumn("bytes", F.col("bytes").cast("string"))


@query("q65_sequence_ranges", f"select client, min(seq) as first, max(seq) as last, count(*) as n from (select client, seq, seq - row_number() over (partition by client order by seq) as island from (select distinct client, seq from ({v.BLOCK_COPIES}) where replica = 0)) group by client, island")
def q65(spark, sf_dir):
    return blocks.sequence_ranges(v.block_copies(spark, sf_dir).where("replica = 0"))


#: The longest of the alternatives first, as RE2 takes the first; braces that repeat nothing stand for themselves.
LONGEST = "(?:tion|ent|en|er|e|é)"


@query("q66_grep_longest", f"select doc_id, line_no, unnest(regexp_extract_all(line, '{LONGEST}')) as line from ({v.DOCUMENT_LINES})")
def q66(spark, sf_dir):
    found = grep.grep_only(v.document_lines(spark, sf_dir), "e|é|en|ent|er|tion|x{2", extended=True)
    return found.select("doc_id", "line_no", "line")


@query("q67_grep_files_with", f"select doc_id::varchar as file from ({v.DOCUMENT_LINES}) group by 1 having bool_or(regexp_matches(line, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(the|une)($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])'))")
def q67(spark, sf_dir):
    lines = v.document_lines(spark, sf_dir).withColumn("file", F.col("doc_id").cast("string"))
    return grep.files_with(lines, ["the", "une"], fixed=True, word=True, ignore_case=True)


@query("q68_task_rates", "select c_custkey as task, coalesce(rate, 0) as rate from customer left join (select user_id as task, arg_max(value, ts) as rate from events where event_type = 'view' group by 1) on task = c_custkey")
def q68(spark, sf_dir):
    reported = v.table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("task"), F.col("value").alias("rate"), "ts")
    return catalog.with_rates(v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task")), reported)


@query("q69_write_tally", f"with r as (select file, replica, count(distinct block_id) as n from ({v.BLOCK_COPIES}) where client <> 'c1' or replica <> 2 group by 1, 2), t as (select file || '/' || replica as vm, n, n = max(n) over (partition by file) as whole from r) select count(*) filter (whole) as answered, count(*) filter (not whole) as failed, coalesce(sum(n) filter (whole), 0)::bigint as count, array_to_string(list_sort(list(vm) filter (not whole)), ',') as failures from t")
def q69(spark, sf_dir):
    # Replicas of a file answer a write with the blocks they hold; those with fewer than the fullest have failed.
    copies = v.block_copies(spark, sf_dir).where("client <> 'c1' or replica <> 2").select("file", "replica", "block_id").distinct()
    held = copies.groupBy("file", "replica").agg(F.count(F.lit(1)).alias("count"))
    fullest = held.groupBy("file").agg(F.max("count").alias("most"))
    answers = held.join(fullest, "file").select(F.concat_ws("/", "file", F.col("replica").cast("string")).alias("vm"), "count", F.when(F.col("count") < F.col("most"), "blocks are missing").alias("error"))
    return catalog.tally(answers).withColumn("failures", F.array_join("failures", ","))


#: One block for each kind of event and day, with all its properties; every seventh or so is listed, but its file is missing.
STORED = "select event_type as file, day(ts) || '-' || event_type as block_id, 'c' || day(ts) as client, day(ts)::bigint as seq, min(epoch_us(ts)) as ts, string_agg(props, '|' order by ts, event_id) as data from events group by all"


@query("q70_block_store", f"select file, block_id, client, seq, ts, data, strlen(data)::bigint as size from ({STORED} having min(event_id) % 7 <> 0)")
def q70(spark, sf_dir):
    props = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "props"))), lambda r: r["props"])
    held = v.table(spark, sf_dir, "events").withColumn("seq", F.dayofmonth("ts").cast("long")).groupBy("event_type", "seq").agg(F.min(v.micros("ts")).alias("ts"), F.array_join(props, "|").alias("data"), F.min("event_id").alias("first"))
    made = held.select(F.col("event_type").alias("file"), F.concat_ws("-", F.col("seq").cast("string"), "event_type").alias("block_id"), F.concat(F.lit("c"), F.col("seq").cast("string")).alias("client"), "seq", "ts", "data", "first")
    metadata, folder = scratch(spark, "metadata"), scratch(spark, "blocks")
    block_store.write_metadata(made, metadata)
    block_store.write_block_texts(made.where("first % 7 <> 0"), folder)
    return block_store.read_store(spark, metadata, folder).withColumn("data", F.col("data").cast("string"))
