"""Allow and block rules for the pages of digital events, as a sort-merge range join.

A rule has a host and the beginning of a path. It fits its host and all subdomains of it where the
path of the address begins so. With the labels of hosts in reverse order ("com.example.www.") the subdomains of
a host are the keys that begin with its own: an interval. Addresses and the two ends of each interval are
sorted together and swept once. Intervals of beginnings are nested or apart, so the rules that are active at an
address are a stack, and the innermost one is the last that was opened at the present depth.

Two sweeps are made: the first over hosts, which finds the rule hosts that an address lies under, the second over
rule host and path, which finds the longest rule of each of these hosts. Everything is made of DataFrame functions.
The sorted order is cut into chunks by range; a chunk is swept alone, and the depth and the stack that earlier chunks
leave open are added. The row number takes part in the order, so that one very frequent address is cut as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.texts import only
from riskloom.session import materialize

ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(page_url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(page_url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(page_url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(page_url, ADDRESS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse order, each closed by a dot, as bytes: the keys of subdomains begin with that of their host."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")).cast("binary")


# ---------------------------------------------------------------- the sweep

def innermost(points: DataFrame, openers: DataFrame) -> DataFrame:
    """The points (key, row, ...) with `top`: the payload of the longest opener key that theirs begins with, else null.

    `openers` are different keys (key, payload). An interval ends before its key followed by a byte that UTF-8 does
    not have, so it holds the keys that begin with its own.
    """
    starts = openers.select("key", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("row"), F.lit(1).alias("step"), "payload")
    ends = openers.select(F.concat("key", F.lit(bytearray(b"\xff"))).alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("row"),
                          F.lit(-1).alias("step"))
    events = points.withColumns({"kind": F.lit(1), "step": F.lit(0)}).unionByName(starts, allowMissingColumns=True).unionByName(
        ends, allowMissingColumns=True)
    order = ["key", "kind", "row"]
    chunks = materialize(events.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()), "url-chunks")
    upto = Window.partitionBy("chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = materialize(chunks.withColumn("local", F.sum("step").over(upto)).filter("step >= 0"), "url-swept")

    # One row per chunk: the depth that the chunks before it leave open.
    totals = chunks.groupBy("chunk").agg(F.sum("step").alias("change"))
    over = Window.orderBy("chunk")
    entered = materialize(totals.select("chunk", F.coalesce(F.sum("change").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("entry"),
                                        F.max("chunk").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last")),
                          "url-depths")
    levels = swept.join(entered, "chunk").withColumn("depth", F.col("local") + F.col("entry"))
    # Per chunk and depth the last opener, and the chunks after it up to the next one of that depth.
    opened = levels.filter("step = 1").groupBy("chunk", "depth", "last").agg(F.max_by("payload", "key").alias("carried"))
    following = F.coalesce(F.lead("chunk").over(Window.partitionBy("depth").orderBy("chunk")), F.col("last"))
    carried = materialize(opened.select("depth", "carried", F.col("chunk").alias("since"), F.col("last"), following.alias("until")).filter(
        "since < last").select("depth", "carried", F.explode(F.sequence(F.col("since") + 1, F.col("until"))).alias("chunk")), "url-stacks")

    inside = Window.partitionBy("chunk", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = levels.withColumn("own", F.last("payload", ignorenulls=True).over(inside)).filter("step = 0")
    met = placed.join(carried, ["chunk", "depth"], "left")
    top = F.when(F.col("depth") > 0, F.coalesce("own", "carried"))
    return met.select(*points.columns, top.alias("top"))


# ---------------------------------------------------------------- rules and addresses

def canonical_rules(rules: DataFrame, host: str = "host", path: str = "path", verdict: str = "verdict") -> DataFrame:
    """(host_key, path, rule, verdict), one row per host and path; of different verdicts block holds."""
    known = only(rules, host=host, path=path, verdict=verdict).filter("host IS NOT NULL AND host != '' AND verdict IN ('allow', 'block')")
    lowered = known.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    return lowered.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        host_key(F.col("host")).alias("host_key"), "path", F.concat("host", "path").alias("rule"), "verdict")


def host_chains(rules: DataFrame) -> DataFrame:
    """(key, payload): each rule host with the rule hosts that it lies under, itself included. A host has at most
    127 labels, which bounds the list."""
    hosts = rules.select("host_key").distinct()
    dots = F.split(F.col("host_key").cast("string"), r"\.", -1)
    above = hosts.select("host_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(dots) - 1), lambda n: F.concat(
        F.array_join(F.slice(dots, F.lit(1), n), "."), F.lit(".")).cast("binary"))).alias("above"))
    met = above.join(hosts.select(F.col("host_key").alias("above")), "above")
    return met.groupBy(F.col("host_key").alias("key")).agg(F.array_sort(F.collect_set("above")).alias("payload"))


def judge_events(digital_events: DataFrame, rules: DataFrame, event_id: str = "event_id", page_url: str = "page_url", host: str = "host",
                 path: str = "path", verdict: str = "verdict", default: str = "allow") -> DataFrame:
    """One row per event: event_id, host, path, rule, verdict.

    `rules` has hosts, beginnings of paths (null: empty, which fits every path) and verdicts (allow or block). Of
    the rules that fit an address that of the longest host holds, of these that of the longest path; rule is its host
    and path, null where none fits, and the verdict is then `default`. Rules without a host or with another verdict are
    ignored; of equal rules with different verdicts block holds. Null addresses and those without :// have an empty host
    and path. Repeated events and null ids stay, other columns are ignored, an empty table gives an empty result, and
    without rules every verdict is the default.
    """
    known = materialize(canonical_rules(rules, host, path, verdict), "url-rules")
    url = F.col("page_url")
    events = materialize(only(digital_events, event_id=event_id, page_url=page_url).select(
        F.monotonically_increasing_id().alias("row"), "event_id", host_of(url).alias("host"), path_of(url).alias("path")), "url-events")

    under = innermost(events.select(host_key(F.col("host")).alias("key"), "row", "event_id", "host", "path"), host_chains(known))
    probes = under.select("row", "event_id", "host", "path", F.explode_outer("top").alias("rule_host"))
    alone = probes.filter("rule_host IS NULL").select("row", "event_id", "host", "path")
    asked = probes.filter("rule_host IS NOT NULL").select(F.concat("rule_host", F.col("path").cast("binary")).alias("key"), "row", "event_id", "host", "path")
    payload = F.struct(F.octet_length("host_key").alias("host_size"), F.octet_length("path").alias("path_size"), "rule", "verdict")
    found = innermost(asked, known.select(F.concat("host_key", F.col("path").cast("binary")).alias("key"), payload.alias("payload")))
    best = found.groupBy("row").agg(F.first("event_id").alias("event_id"), F.first("host").alias("host"), F.first("path").alias("path"),
                                    F.max("top").alias("top"))
    judged = best.unionByName(alone, allowMissingColumns=True)
    return judged.select("event_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
