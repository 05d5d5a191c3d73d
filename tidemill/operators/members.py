"""Membership records: version merge, views, differences, failure detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, SUSPECTED, FAILED, LEFT, JOINING = "ACTIVE", "SUSPECTED", "FAILED", "LEFT", "JOINING"
#: What a forgotten host's last change is called, and kinds of signs in the order of signs at one time.
REMOVED, JOIN, ALIVE, LEAVE = "REMOVED", 0, 1, 2


def merge_versions(updates: DataFrame, *fields: str, arrival: str = "arrival") -> DataFrame:
    """The record of each host with the greatest (incarnation, heartbeat), of equal ones the first to arrive.

    One aggregate over all updates, combined before the shuffle, however many a host has.
    """
    version = F.struct(F.col("incarnation"), F.col("heartbeat"), (-F.col(arrival)).alias("_early"))
    best = F.max_by(F.struct("incarnation", "heartbeat", arrival, *fields), version)
    return updates.groupBy("host").agg(best.alias("m")).select("host", "m.*")


def with_status(members: DataFrame, *statuses: str) -> DataFrame:
    return members.where(F.col("status").isin(*statuses))


def unexpired(members: DataFrame, now: str = "now", cleanup: float = 2.0) -> DataFrame:
    """Without failed or departed members whose record is older than ``cleanup``."""
    return members.where(~(F.col("status").isin(FAILED, LEFT) & (F.col(now) - F.col("ts") > cleanup)))


def reachable(members: DataFrame, own_host: str) -> DataFrame:
    return members.where((F.col("host") != own_host) & (F.col("status") != LEFT))


def joined(current: DataFrame, known: DataFrame) -> DataFrame:
    return current.select("host").distinct().join(known.select("host"), "host", "left_anti")


def departed(current: DataFrame, known: DataFrame) -> DataFrame:
    return joined(known, current)


def silence_gaps(signs: DataFrame, seconds: int) -> DataFrame:
    """(host, silent_from, silent_to): a host's consecutive signs of life further apart than ``seconds``."""
    last = F.lag("ts").over(Window.partitionBy("host").orderBy("ts"))
    held = signs.select("host", "ts").withColumn("silent_from", last)
    gap = F.timestamp_diff("SECOND", F.col("silent_from"), F.col("ts")) > seconds
    return held.where(gap).select("host", "silent_from", F.col("ts").alias("silent_to"))


def traffic(messages: DataFrame) -> DataFrame:
    """(host, sent, bytes_sent, received, bytes_received) of messages (sender, receiver, bytes); a null counts as no bytes.

    A host counts on both sides, whichever it is seen on; null hosts are left out. One
    aggregate, combined before the shuffle, serves both.
    """
    size = F.coalesce(F.col("bytes").cast("long"), F.lit(0))
    sides = F.explode(F.array(F.struct(F.col("sender").alias("host"), F.lit(True).alias("out")), F.struct(F.col("receiver").alias("host"), F.lit(False).alias("out"))))
    each = messages.select(size.alias("bytes"), sides.alias("s")).select("bytes", "s.host", "s.out").where("host is not null")
    total = lambda side, value: F.sum(F.when(side, value).otherwise(0)).cast("long")
    out, into = F.col("out"), ~F.col("out")
    return each.groupBy("host").agg(total(out, 1).alias("sent"), total(out, F.col("bytes")).alias("bytes_sent"), total(into, 1).alias("received"), total(into, F.col("bytes")).alias("bytes_received"))


def false_positives(states: DataFrame, order: str = "ts") -> DataFrame:
    """(host, n): how often a suspected host turned out to be active next."""
    last = F.lag("status").over(Window.partitionBy("host").orderBy(order))
    wrong = states.withColumn("_last", last).where((F.col("_last") == SUSPECTED) & (F.col("status") == ACTIVE))
    return wrong.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


class MemberClock:
    """The state of one host: what its signs and the passing of time change.

    A JOIN makes it JOINING, a LEAVE makes it LEFT, any other sign ACTIVE; such signs of a host
    that is LEFT are ignored. An ACTIVE host without a sign for longer than ``silence`` is SUSPECTED,
    ``expiry`` later FAILED, ``cleanup`` later REMOVED and forgotten, as a LEFT host is
    ``cleanup`` after it left last. A JOINING host has no limit. A sign at the very limit is in time.
    """

    def __init__(self, silence: int, expiry: int, cleanup: int, status: str | None = None, since: int = 0):
        self.steps = {ACTIVE: (silence, SUSPECTED), SUSPECTED: (expiry, FAILED), FAILED: (cleanup, None), LEFT: (cleanup, None)}
        self.status, self.since = status, since

    def deadline(self) -> int | None:
        """When the state changes by itself."""
        return self.since + self.steps[self.status][0] if self.status in self.steps else None

    def until(self, time: int) -> list[tuple[int, str]]:
        """Changes by the clock before ``time``."""
        told = []
        while (at := self.deadline()) is not None and at < time:
            self.since, self.status = at, self.steps[self.status][1]
            told.append((at, self.status or REMOVED))
        return told

    def sign(self, time: int, kind: int) -> list[tuple[int, str]]:
        """Changes up to and with a sign."""
        told = self.until(time)
        if kind == ALIVE and self.status == LEFT:
            return told
        status = {JOIN: JOINING, LEAVE: LEFT, ALIVE: ACTIVE}[kind]
        if status != self.status:
            told.append((time, status))
        self.status, self.since = status, time
        return told


def status_changes(signs: DataFrame, silence: int, expiry: int, cleanup: int) -> DataFrame:
    """(host, ms, status): every change of a host's state in a table of signs (host, ms, kind).

    ``kind`` is JOIN, LEAVE or anything else for a sign of life; times are in milliseconds, limits
    in seconds, and the rules those of ``MemberClock``. What follows a host's last sign counts up
    to the latest sign of any host. All is told by a sign and its neighbours: a sign of life is
    ignored if the last JOIN or LEAVE before it is a LEAVE not yet forgotten, and the state before
    a sign is what the last one that counts has become by then. So one shuffle by host serves.
    """
    s, e, c = silence * 1000, expiry * 1000, cleanup * 1000
    code = F.when(F.col("kind") == "JOIN", JOIN).when(F.col("kind") == "LEAVE", LEAVE).otherwise(ALIVE)
    held = signs.select("host", "ms", code.alias("kind"))
    w = Window.partitionBy("host").orderBy("ms", "kind")
    notice = F.last(F.when(F.col("kind") != ALIVE, F.struct("kind", "ms")), ignorenulls=True).over(w)
    held = held.withColumn("notice", notice)
    ignored = (F.col("kind") == ALIVE) & (F.col("notice.kind") == LEAVE) & (F.col("ms") <= F.col("notice.ms") + c)
    held = held.where(~F.coalesce(ignored, F.lit(False))).drop("notice")
    held = held.select("*", F.lead("ms").over(w).alias("next"), F.lag("kind").over(w).alias("before"), (F.col("ms") - F.lag("ms").over(w)).alias("since"))
    was = F.when(F.col("before") == JOIN, JOINING).when((F.col("before") == LEAVE) & (F.col("since") <= c), LEFT)
    for limit, status in ((s, ACTIVE), (s + e, SUSPECTED), (s + e + c, FAILED)):
        was = was.when((F.col("before") == ALIVE) & (F.col("since") <= limit), status)
    now = F.when(F.col("kind") == JOIN, JOINING).when(F.col("kind") == LEAVE, LEFT).otherwise(ACTIVE)
    later = lambda ms, status: F.struct((F.col("ms") + ms).alias("at"), F.lit(status).alias("status"))
    by_clock = F.when(F.col("kind") == ALIVE, F.array(later(s, SUSPECTED), later(s + e, FAILED), later(s + e + c, REMOVED))).when(F.col("kind") == LEAVE, F.array(later(c, REMOVED))).otherwise(F.array().cast("array<struct<at:bigint,status:string>>"))
    told = F.filter(by_clock, lambda t: t["at"] < F.coalesce("next", F.lit(1 << 62)))
    own = F.when(was.eqNullSafe(now), F.array().cast("array<struct<at:bigint,status:string>>")).otherwise(F.array(F.struct(F.col("ms").alias("at"), now.alias("status"))))
    changes = held.select("host", F.explode(F.concat(own, told)).alias("t")).select("host", F.col("t.at").alias("ms"), F.col("t.status").alias("status"))
    # One row, whatever the table.
    return changes.join(F.broadcast(signs.agg(F.max("ms").alias("_now"))), F.col("ms") <= F.col("_now")).drop("_now")


def hosts_of(members: DataFrame, machines: DataFrame, default: int = 1) -> DataFrame:
    """(host, vm): the machine with the host's name, else one whose name up to its first dot begins the host's, else ``default``.

    Of several machines the lowest counts. Each host emits its beginnings and joins on them, so
    no host meets every machine.
    """
    hosts = members.select("host").distinct()
    exact = machines.groupBy(F.col("hostname").alias("host")).agg(F.min("vm").alias("_exact"))
    short = machines.groupBy(F.split_part("hostname", F.lit("."), F.lit(1)).alias("_short")).agg(F.min("vm").alias("_vm"))
    heads = hosts.where("host <> ''").select("host", F.explode(F.expr("transform(sequence(1, length(host)), n -> substring(host, 1, n))")).alias("_short"))
    begun = heads.join(short, "_short").groupBy("host").agg(F.min("_vm").alias("_begun"))
    found = hosts.join(exact, "host", "left").join(begun, "host", "left")
    known = found.select("host", F.coalesce("_exact", "_begun").alias("_known"))
    return members.join(known, "host", "left").select("host", F.coalesce("_known", F.lit(default)).alias("vm"))
