"""URL filter lists that change over time, joined as of each capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomatch.plans.stages import materialize

FOREVER = "9999-12-31 00:00:00"
RESULTS = ("host", "n_entries", "lists", "blocked")
#: Verdicts up to so many rows are sent to all executors; more are met by a shuffle.
BROADCAST_ROWS = 200_000


def intervals(events: DataFrame) -> DataFrame:
    """Validity intervals ``(list, pattern, valid_from, valid_to)``, timestamps, of ``events(list, pattern, action, at)``.

    An entry is active from an ``add`` until the next event of the same list and pattern; ``remove`` ends it. Of events
    at the same moment the last action by name counts, so ``remove`` wins over ``add``. Other actions, and nulls in any
    column, are ignored. Patterns are folded to lower case, a leading ``www.`` or ``*.`` goes. The intervals include
    their start and not their end; an entry added twice without a removal has two that meet.
    """
    pattern = F.regexp_replace(F.lower(F.trim("pattern")), r"^(\*\.|www\.)", "")
    clean = events.where(F.col("action").isin("add", "remove")).select("list", pattern.alias("pattern"), "action", F.col("at").cast("timestamp").alias("at"))
    one = clean.where("at IS NOT NULL AND list IS NOT NULL AND pattern <> ''").groupBy("list", "pattern", "at").agg(F.max("action").alias("action"))
    following = F.lead("at").over(Window.partitionBy("list", "pattern").orderBy("at"))
    dated = one.withColumn("valid_to", F.coalesce(following, F.lit(FOREVER).cast("timestamp")))
    return dated.where("action = 'add'").select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case without user, port and leading ``www.``; empty where there is none.

    An IPv6 address keeps its brackets; percent-coded characters are decoded where that gives text.
    """
    host = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[0-9a-f:.]*\]|[^/?#:]*)", 1)
    plain = F.when(host.contains("%"), F.lower(F.coalesce(F.try_url_decode(host), host))).otherwise(host)
    return F.regexp_replace(plain, r"^www\.|\.$", "")


def patterns_of(host: Column) -> Column:
    """The patterns that can match a host: itself and its parent domains of at least two labels; an address has no parents."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    address = host.startswith("[") | host.rlike(r"^\d+(\.\d+){3}$")
    return F.when(host == "", F.array().cast("array<string>")).when(address, F.array(host)).otherwise(parents)


def filter_urls(captures: DataFrame, events: DataFrame) -> DataFrame:
    """Evaluate every capture against the list entries that were active at the moment when it was fetched.

    ``captures(page_id, url, fetched_on, ...)`` get ``host string``, ``n_entries int`` (active entries that match),
    ``lists string`` (their lists, sorted, joined by commas) and ``blocked boolean``; all other columns stay, but those of
    these names. ``fetched_on`` is a timestamp, or a date or text that casts to one. A null or unusable URL has the host
    '' and, like a null fetch time, matches nothing. Repeated captures are all kept. No events leave everything unblocked.

    What a capture meets depends on its host and time alone. Distinct (host, day) pairs, which gather a host that has a
    third of all captures in as many rows as there are days, are looked up among the entries of the host and its parent
    domains; where entries change within a day, it falls into spans with a verdict each. The captures then join the span
    of their host and day that holds their time, so each meets one row at most and none is grouped.
    """
    kept = [c for c in captures.columns if c not in RESULTS]
    at = F.col("fetched_on").cast("timestamp")
    named = captures.select(F.struct(*kept).alias("row"), host_of(F.col("url")).alias("host"), at.alias("at"), F.to_date(at).alias("day"))
    seen = named.where("host <> '' AND day IS NOT NULL").select("host", "day").distinct()
    first, end = F.col("day").cast("timestamp"), F.date_add("day", 1).cast("timestamp")
    keys = seen.select("host", "day", F.explode(patterns_of(F.col("host"))).alias("pattern"))
    hits = keys.join(intervals(events), "pattern").where((F.col("valid_from") < end) & (F.col("valid_to") > first))
    hits = materialize(hits.select("host", "day", "list", "valid_from", "valid_to"), "url-hits")
    marks = hits.select("host", "day", F.explode(F.array(F.greatest("valid_from", first), F.when(F.col("valid_to") < end, F.col("valid_to")))).alias("since"))
    marks = marks.where("since IS NOT NULL").distinct()
    until = F.lead("since").over(Window.partitionBy("host", "day").orderBy("since"))
    spans = marks.withColumn("until", F.coalesce(until, end))
    met = spans.join(hits, ["host", "day"]).where("valid_from <= since AND valid_to > since")
    found = met.groupBy("host", "day", "since", "until").agg(
        F.count("*").cast("int").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists")
    )
    found = materialize(found, "url-verdicts")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found.hint("merge")
    here = (named["host"] == found["host"]) & (named["day"] == found["day"]) & (named["at"] >= found["since"]) & (named["at"] < found["until"])
    out = named.join(found, here, "left")
    n = F.coalesce("n_entries", F.lit(0))
    return out.select("row.*", named["host"].alias("host"), n.alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), (n > 0).alias("blocked"))
