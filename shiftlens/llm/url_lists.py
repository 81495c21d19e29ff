"""URL filters by a temporal list join, in native columns only.

List events (value, category, action add or remove, day) become validity
intervals: an ``add`` opens one, the next event of the same entry closes it.  A
capture's candidate keys are its host and every parent domain; an equi-join on
the key followed by the interval test picks the entries active on the
capture's day, and the latest one decides (as-of join).

Captures are reduced to distinct (host, day) before the join, so a very
common host meets the list once per day.

The list is given by the caller; values are domains, hosts or addresses, in any
case and with or without dots at their end.  :func:`derived_events` makes one
for tables that hold none.

Defined results: a null or hostless URL matches nothing; a null day matches
nothing; an entry without a remove stays active; repeated adds restart the
entry; of events on one day ``remove`` counts last; of entries that started
on one day the longest value, then the alphabetically first category decides;
repeated captures each get a row; URLs of any length are read whole; columns of
any name pass through, but for those that are added; empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

BASE_DAY = "2024-01-01"
DAYS = 365
# Terms whose hosts enter the derived lists, with their category.
TERMS = {"ads": "ads", "adult": "adult", "bets": "gambling", "casino": "gambling", "pills": "pharma", "spam": "spam"}
# First labels that a list entry leaves out, so that it covers sibling hosts too.
SERVICE_LABELS = r"^(www|m|blog)\."


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, with or without its scheme; an IPv6 one in brackets, no dots at its end."""
    host = F.regexp_extract(F.lower(F.btrim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def parents(host: Column) -> Column:
    """The host and every parent domain of at least two labels; an IP address has no parents."""
    domains = let(F.split(host, r"\."), lambda p: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))),
        lambda i: F.concat_ws(".", F.slice(p, i, F.size(p)))))
    return F.when(host.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$"), F.array(host)).otherwise(domains)


def intervals(events: DataFrame) -> DataFrame:
    """(value, category, start, stop) from list events (value, category, action, day)."""
    entry = Window.partitionBy("value", "category").orderBy("day", "action")
    value = F.regexp_replace(F.lower(F.btrim(F.col("value"))), r"\.+$", "").alias("value")
    return (events.where(F.col("value").isNotNull() & F.col("day").isNotNull())
            .select(value, "category", "action", "day").distinct()
            .withColumn("stop", F.lead("day").over(entry))
            .where(F.col("action") == "add").select("value", "category", F.col("day").alias("start"), "stop"))


def active_entries(captures: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct (host, day) of captures with the deciding entry and all categories."""
    keys = (captures.select("host", "day").where("host is not null and day is not null").distinct()
            .withColumn("value", F.explode(parents(F.col("host")))))
    hit = (F.col("day") >= F.col("start")) & (F.col("stop").isNull() | (F.col("day") < F.col("stop")))
    met = keys.join(intervals(events), "value").where(hit)
    rank = F.struct(F.datediff("start", F.lit("1970-01-01")), F.length("value"))
    top = Window.partitionBy("host", "day").orderBy(rank.desc(), "category")
    return (met.withColumn("__r", F.row_number().over(top)).groupBy("host", "day").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"),
        F.max(F.when(F.col("__r") == 1, F.col("value"))).alias("entry"),
        F.max(F.when(F.col("__r") == 1, F.col("start"))).alias("listed_on")))


def url_filter(captures: DataFrame, events: DataFrame) -> DataFrame:
    """Captures (id, url, day) with host, n_entries, categories, entry, listed_on, blocked."""
    added = ["host", "n_entries", "categories", "entry", "listed_on", "blocked"]
    keep = [c for c in captures.columns if c not in added]
    # The row stays whole in one struct, so that no column of it clashes with the joined ones.
    base = captures.select(F.struct(*keep).alias("row"), host_of(F.col("url")).alias("host"), "day")
    found = active_entries(base, events).withColumnRenamed("host", "f_host").withColumnRenamed("day", "f_day")
    out = base.join(found, (F.col("host") == F.col("f_host")) & (F.col("day") == F.col("f_day")), "left")
    n = F.coalesce("n_entries", F.lit(0).cast("long"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "host", n.alias("n_entries"), "categories", "entry",
                      "listed_on", (n > 0).alias("blocked"))


def dated(pages: DataFrame) -> DataFrame:
    """Captures of ``pages`` with a fetch day derived from the page id."""
    day = F.date_add(F.lit(BASE_DAY).cast("date"), F.pmod(F.col("page_id"), F.lit(DAYS)).cast("int"))
    return pages.select("page_id", "url", day.alias("day"))


def derived_events(pages: DataFrame) -> DataFrame:
    """List events from the hosts of ``pages``.

    Each host holding a listed term is listed without its service label; the
    days of adding and removing come from MD5s of the entry.
    """
    hosts = pages.select(F.regexp_replace(host_of(F.col("url")), SERVICE_LABELS, "").alias("value")).where("value is not null").distinct()
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(c).alias("category")) for t, c in TERMS.items()])
    listed = (hosts.withColumn("t", F.explode(terms)).where(F.expr("contains(value, t.term)"))
              .select("value", "t.category").distinct())
    def draw(mark: str) -> Column:
        digits = F.substring(F.md5(F.concat("value", F.lit(mark))), 1, 4)
        return (F.conv(digits, 16, 10).cast("int") % (DAYS // 2)).cast("int")

    start, length = draw("+"), draw("-") + 1
    first = F.date_add(F.lit(BASE_DAY).cast("date"), start)
    return listed.select("value", "category", F.explode(F.array(
        F.struct(F.lit("add").alias("action"), first.alias("day")),
        F.struct(F.lit("remove").alias("action"), F.date_add(first, length).alias("day")))).alias("e")).select(
        "value", "category", "e.action", "e.day")
