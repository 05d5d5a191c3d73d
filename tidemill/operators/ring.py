"""Consistent-hash placement as joins of key ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPLICAS = 3
#: Hexadecimal digits of a position that cut the ring into equal cells; a position behind all others.
DIGITS, END = 3, "g"


def cell(position: str) -> F.Column:
    return F.conv(F.substring(position, 1, DIGITS), 16, 10).cast("int")


def owners(nodes: DataFrame, replicas: int = REPLICAS) -> DataFrame:
    """(pos, owners): each node's position with the nodes that hold what falls to it, itself first.

    Positions are SHA-1 in fixed-width hexadecimal, which sorts like the number. The ring is
    gone round twice, so that the last nodes see the first behind them. It is put in order in
    one task: a ring has a row a node, however many files it places.
    """
    ring = nodes.select("node", F.sha1("node").alias("pos")).distinct()
    laps = ring.withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1))))
    following = F.collect_list("node").over(Window.orderBy("lap", "pos").rowsBetween(0, replicas - 1))
    return laps.withColumn("owners", F.array_distinct(following)).where("lap = 0").select("pos", "owners")


def arcs(points: DataFrame, *columns: str) -> DataFrame:
    """(low, high, columns...): the arcs that end in ``points`` (pos, columns...), and the one behind the last.

    A position p lies in an arc if low < p <= high; what is behind the last point falls to the first.
    """
    w = Window.orderBy("pos")
    low = points.select(F.lag("pos", 1, "").over(w).alias("low"), F.col("pos").alias("high"), *columns)
    last = points.agg(F.max("pos").alias("low"), *[F.min_by(c, "pos").alias(c) for c in columns]).where("low is not null")
    return low.unionByName(last.select("low", F.lit(END).alias("high"), *columns))


def files_in(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """Files with the arc they fall into. Arcs are listed under the cells they touch, so no file meets every arc."""
    first = F.coalesce(cell("low"), F.lit(0))
    last = F.when(F.col("high") == END, F.lit(16**DIGITS - 1)).otherwise(cell("high"))
    listed = pieces.withColumn("cell", F.explode(F.sequence(first, last)))
    keyed = files.select("file", F.sha1("file").alias("pos")).withColumn("cell", cell("pos"))
    return keyed.join(listed, "cell").where("pos > low and pos <= high")


def placement(files: DataFrame, nodes: DataFrame, replicas: int = REPLICAS) -> DataFrame:
    """(file, node, replica): for each file the first ``replicas`` nodes at or after its position, around the ring.

    An arc carries the names of all its nodes, so one join places a file; Spark broadcasts the
    arcs if their size allows. With fewer nodes than replicas, all nodes hold the file.
    """
    placed = files_in(files, arcs(owners(nodes, replicas), "owners"))
    return placed.select("file", F.posexplode("owners").alias("at", "node")).select("file", "node", (F.col("at") + 1).cast("int").alias("replica"))


def moved_arcs(before: DataFrame, after: DataFrame, replicas: int = REPLICAS) -> DataFrame:
    """(low, high, had, has): the arcs of which the owners differ between two rings.

    The nodes of both rings cut the circle; a piece's owners in a ring are those of the next of
    its nodes, or of its first one behind the last.
    """
    a, b = (owners(nodes, replicas).withColumnRenamed("owners", name) for nodes, name in ((before, "had"), (after, "has")))
    points = a.join(b, "pos", "full")
    # From the last node backwards, so that a frame grows by a row at a time: none is read anew for each row.
    onward, whole = Window.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    next_of = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(onward), F.first(c, ignorenulls=True).over(whole), F.array().cast("array<string>")).alias(c)
    pieces = arcs(points.select("pos", next_of("had"), next_of("has")), "had", "has")
    return pieces.where(F.array_sort("had") != F.array_sort("has"))


def moves(files: DataFrame, before: DataFrame, after: DataFrame, replicas: int = REPLICAS) -> DataFrame:
    """(file, node, change): copies to fetch and to delete when the nodes of a ring change.

    Only files in arcs that change hands are joined, so the work behind the scan is in
    proportion to what moves; neither placement is made.
    """
    placed = files_in(files, moved_arcs(before, after, replicas))
    tagged = lambda nodes, change: F.transform(nodes, lambda n: F.struct(n.alias("node"), F.lit(change).alias("change")))
    changes = F.concat(tagged(F.array_except("has", "had"), "fetch"), tagged(F.array_except("had", "has"), "delete"))
    return placed.select("file", F.explode(changes).alias("c")).select("file", "c.node", "c.change")


def rebalance(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, node, change): copies to fetch and to delete between two placements of any kind."""
    a, b = before.select("file", "node", F.lit(1).alias("had")), after.select("file", "node", F.lit(1).alias("has"))
    change = F.when(F.col("had").isNull(), "fetch").when(F.col("has").isNull(), "delete")
    return a.join(b, ["file", "node"], "full").select("file", "node", change.alias("change")).where("change is not null")


def missing_copies(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.select("file", "node").join(actual.select("file", "node"), ["file", "node"], "left_anti")


def surplus_copies(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return missing_copies(actual, expected)


def under_replicated(expected: DataFrame, actual: DataFrame, replicas: int = REPLICAS) -> DataFrame:
    """Files with fewer live copies than wanted, counted over the expected places."""
    held = actual.select("file", "node", F.lit(1).alias("held")).distinct()
    counted = expected.select("file", "node").join(held, ["file", "node"], "left").groupBy("file").agg(F.count("held").alias("copies"))
    return counted.where(F.col("copies") < replicas)
