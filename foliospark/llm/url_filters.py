"""URL filters: a temporal list join.

A list is a log of dated entries: on a day a rule (a whole address, a host, or a domain with its subdomains) starts to
block or to allow, or is taken off the list. An entry is valid from its day until the rule's next entry or its own last
day. Every capture is judged by the entries that are active on the day it was fetched; of several active rules the most
specific one decides: address, then host, then the longest domain.

The as-of join works on days. Entries and captures are first reduced to one row per (rule, day), so a host that holds a
third of all captures is as many rows as there are days. The days of a rule are cut into blocks; each block is walked by
a window, and the last entry of earlier blocks is carried in by a second one. Captures then find their validity interval
by the equal key (rule, day), which Spark may split if it is skewed.

Defined cases: a null or malformed address has no rules and is kept without a decision; so is a capture without a day
or table without entries; entries without rule or day never apply; several entries of a rule on one day: blocking wins,
then allowing; repeated captures are each answered; further columns of the captures stay, and columns with the names of
the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS_PER_BLOCK = 32
ACTIONS = ("remove", "allow", "block")  # by rising rank


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if the address has none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.rtrim(host, F.lit("."))


def address_of(url: Column) -> Column:
    """Host and path without a final slash, query and fragment; empty if the address has no host."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(host_of(url) == "", "").otherwise(F.concat(host_of(url), F.rtrim(path, F.lit("/"))))


def rules_of(url: Column) -> Column:
    """All rules that could hold for an address: array of (rule, rank), the higher rank being more specific."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    numeric = F.get(labels, n - 1).rlike("^[0-9]+$")
    tails = F.filter(
        F.transform(labels, lambda x, i: F.struct(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i + 1, n - i), ".")).alias("rule"), (n - i).alias("rank"))),
        lambda r: (r["rank"] >= 2) & ~numeric,
    )
    top = F.array(
        F.struct(F.concat(F.lit("host:"), host).alias("rule"), F.lit(1_000_000).alias("rank")),
        F.struct(F.concat(F.lit("url:"), address_of(url)).alias("rule"), F.lit(1_000_001).alias("rank")),
    )
    return F.when(host != "", F.concat(tails, top)).otherwise(F.array().cast("array<struct<rule:string,rank:int>>"))


def _day(col: Column) -> Column:
    return F.datediff(col.cast("date"), F.lit("1970-01-01").cast("date"))


def validity(entries: DataFrame, days: DataFrame) -> DataFrame:
    """For each (rule, day) of ``days`` the entry in force: (rule, day, listed, action, until); none if there is none.

    ``entries``: rule, listed (date), action, until (last valid day or null).
    """
    action = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    dated = entries.where(F.col("rule").isNotNull() & F.col("listed").isNotNull() & (action > 0)).select(
        "rule", _day(F.col("listed")).alias("day"), F.struct(action.alias("a"), F.coalesce(_day(F.col("until")), F.lit(2**31 - 1)).alias("u")).alias("e"), F.lit(False).alias("asked")
    )
    asked = days.select("rule", "day", F.lit(None).cast(dated.schema["e"].dataType).alias("e"), F.lit(True).alias("asked"))
    line = (
        dated.unionByName(asked)
        .groupBy("rule", "day")
        .agg(F.max("e").alias("e"), F.max("asked").alias("asked"))
        .withColumn("block", F.floor(F.col("day") / DAYS_PER_BLOCK))
        .withColumn("v", F.when(F.col("e").isNotNull(), F.struct("day", "e.a", "e.u")))
    )
    in_block = Window.partitionBy("rule", "block").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    walked = line.withColumn("v", F.last("v", ignorenulls=True).over(in_block)).where("asked")
    ends = line.where(F.col("v").isNotNull()).groupBy("rule", "block").agg(F.max("v").alias("end"))
    blocks = ends.unionByName(walked.where(F.col("v").isNull()).select("rule", "block", F.lit(None).cast(ends.schema["end"].dataType).alias("end")))
    blocks = blocks.groupBy("rule", "block").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy("rule").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).select("rule", "block", "carried")
    v = F.coalesce(F.col("v"), F.col("carried"))
    return (
        walked.join(carried, ["rule", "block"], "left")
        .withColumn("v", v)
        .where(F.col("v").isNotNull() & (F.col("day") <= F.col("v.u")))
        .select(
            "rule",
            "day",
            F.date_add(F.lit("1970-01-01").cast("date"), F.col("v.day")).alias("listed"),
            F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("v.a").cast("int")).alias("action"),
        )
    )


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Every capture with action (block, allow or null), rule, listed (day of the deciding entry) and kept.

    A row number given before the join keeps repeated captures apart; the list is met on (rule, day) rows only, and the
    answer comes back by the capture's own (address, day).
    """
    made = {"action", "rule", "listed", "kept"}
    captures = captures.drop(*[c for c in captures.columns if c.lower() in made])
    asked = captures.select(F.col(url).alias("_u"), _day(F.col(fetched)).alias("day")).where("_u is not null and day is not null").distinct()
    wide = asked.select("_u", "day", F.explode(rules_of(F.col("_u"))).alias("r")).select("_u", "day", "r.rule", "r.rank")
    valid = validity(entries, wide.select("rule", "day").distinct()).where(F.col("action") != "remove")
    best = (
        wide.join(valid, ["rule", "day"])
        .groupBy(F.col("_u").alias("_url"), F.col("day").alias("_day"))
        .agg(F.max_by(F.struct("action", "rule", "listed"), "rank").alias("_best"))
    )
    return (
        captures.join(best, (F.col(url) == F.col("_url")) & (_day(F.col(fetched)) == F.col("_day")), "left")
        .select(*captures.columns, "_best.action", "_best.rule", "_best.listed", F.coalesce(F.col("_best.action") != "block", F.lit(True)).alias("kept"))
    )


def list_from_pages(pages: DataFrame) -> DataFrame:
    """A dated list over the addresses of ``pages``: every page gives one entry, whose day, rule, action and last day its
    id decides. The tables hold no block list, and this one grows with them."""
    n = F.coalesce(F.col("page_id"), F.lit(0))
    rules = rules_of(F.col("url"))
    return pages.where(F.size(rules) > 0).select(
        F.get(F.sort_array(F.transform(rules, lambda r: F.struct(r["rank"], r["rule"])), False), F.pmod(n, F.lit(3)).cast("int"))["rule"].alias("rule"),
        F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(n * 7919, F.lit(700)).cast("int")).alias("listed"),
        F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("block"), F.lit("remove")), (F.pmod(n * 31, F.lit(4)) + 1).cast("int")).alias("action"),
        F.when(F.pmod(n, F.lit(5)) == 0, F.date_add(F.lit("2023-01-01").cast("date"), (F.pmod(n * 7919, F.lit(700)) + 90).cast("int"))).alias("until"),
    )


def captures_from_pages(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day that their id decides."""
    day = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)) * 104729, F.lit(760)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), day).alias("fetched"))


ORACLE = r"""
with p as (select page_id, url, coalesce(page_id, 0) n,
 rtrim(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.') host,
 rtrim(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') path from pages),
q as (select *, string_split(host, '.') l from p),
r as (select page_id, url, n, unnest(list_concat(
  list_filter([{'rule': 'domain:' || array_to_string(l[i:], '.'), 'rank': len(l) - i + 1} for i in range(1, len(l) + 1)], lambda x: x.rank >= 2 and not regexp_matches(l[-1], '^[0-9]+$')),
  [{'rule': 'host:' || host, 'rank': 1000000}, {'rule': 'url:' || host || path, 'rank': 1000001}])) r
 from q where host <> ''),
k as (select page_id, url, n, r.rule rule, r.rank rank, date '2023-01-01' + cast(n * 104729 % 760 as int) fetched from r),
b as (select *, row_number() over (partition by page_id, url order by rank desc) - 1 pos from k),
e as (select rule, listed, max(case act when 'block' then 3 when 'allow' then 2 else 1 end * 10000000::bigint + coalesce(until - date '1970-01-01', 9000000)) x from (
 select rule, date '2023-01-01' + cast(n * 7919 % 700 as int) listed, ['block', 'allow', 'block', 'remove'][1 + n * 31 % 4] act,
 case when n % 5 = 0 then date '2023-01-01' + cast(n * 7919 % 700 + 90 as int) end until from b where pos = n % 3) group by 1, 2),
a as (select k.*, e.listed, e.x // 10000000 act, e.x % 10000000 u from k asof join e on k.rule = e.rule and k.fetched >= e.listed),
c as (select page_id, url, max_by({'act': act, 'rule': rule, 'listed': listed}, rank) best from a
 where act > 1 and fetched - date '1970-01-01' <= u group by 1, 2)
select p.page_id, p.url, date '2023-01-01' + cast(p.n * 104729 % 760 as int) fetched,
 case c.best.act when 3 then 'block' when 2 then 'allow' end as "action", c.best.rule as "rule", c.best.listed listed,
 coalesce(c.best.act <> 3, true) kept
from p left join c on p.page_id = c.page_id and p.url = c.url
"""
