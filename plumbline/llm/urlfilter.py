"""URL filters by a temporal list join.

A list changes: each event adds or removes an entry on a day.  A run of events of one entry becomes validity
intervals, from an addition up to the next removal.  Every capture gets the keys under which an entry could
match it (its host and each parent domain; its host with each leading part of its path), and an equi-join on
the key with the interval as a condition finds the entries active at fetch time.  So no capture is tried
against entries of other keys, and neither side must fit in memory.

Entries: ``domain`` entries match a host and all hosts below it, ``prefix`` entries a host and the beginning of its path
in whole segments (none: the whole host), upper and lower case alike.  Entries are normalised as URLs are: scheme, user info,
port, query and fragment are ignored, and dots after the host and slashes after the path.  Intervals hold their first day,
not their last.  Events of one entry on one day: the last (by ``seq``) decides.

Keys that more than a thousandth of all captures ask for are joined by broadcast.  An entry's intervals, of which there are
at most as many as days, come as one row.

Defined results: null, empty or odd URLs without a host match nothing; a null fetch time matches nothing; user info,
port, query and fragment are ignored, the host is lower-cased, an address in brackets is a host; events with a null or empty
entry, a null day or an unknown kind or action are ignored; repeated rows are judged one by one; an empty list or table gives
what follows from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import join_hot
from .scratch import table

#: Scheme, authority without user info and port (an address in brackets whole), path.
SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*://"
HOST = rf"^{SCHEME}(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)"
PATH = rf"^{SCHEME}[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.+$", "")


def segments_of(url: Column) -> Column:
    """The parts of a URL's path, lower-cased, without empty ones."""
    return F.filter(F.split(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)), "/"), lambda s: s != "")


def normal_entry(kind: Column, entry: Column) -> Column:
    """An entry in the form that URLs are brought into too: without scheme, user info, port, query, dots that end the host
    and slashes that end the path; of a domain entry, without a leading dot or ``*.``."""
    bare = F.trim(entry)
    url = F.when(bare.rlike("^" + SCHEME), bare).otherwise(F.concat(F.lit("any://"), F.when(kind == "domain", F.regexp_replace(bare, r"^(\*?\.)+", "")).otherwise(bare)))
    host = host_of(url)
    return F.when(kind == "domain", host).otherwise(F.array_join(F.concat(F.array(host), segments_of(url)), "/"))


def intervals(events: DataFrame) -> DataFrame:
    """From (kind, entry, action add/remove, day, seq): kind, entry, since, until (null: still active)."""
    sound = events.where("kind in ('domain', 'prefix') and entry is not null and day is not null and action in ('add', 'remove')")
    sound = sound.select("kind", normal_entry(F.col("kind"), F.col("entry")).alias("entry"), "day", "action", "seq").where("entry != '' and entry not like '/%'")
    daily = sound.groupBy("kind", "entry", "day").agg(F.max_by("action", "seq").alias("action"))
    by_day = Window.partitionBy("kind", "entry").orderBy("day")
    turns = daily.withColumn("was", F.lag("action").over(by_day)).where("was is null and action = 'add' or was != action")
    spans = turns.withColumn("until", F.lead("day").over(by_day))
    return spans.where("action = 'add'").select("kind", "entry", F.col("day").alias("since"), "until")


def judge_urls(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched", key: str = "page_id") -> DataFrame:
    """Per row of ``captures``: key, url, host, fetched, n_active (entries active at fetch time that match), entry (the
    first of them, as kind:entry) and allowed."""
    active = table(intervals(events), "intervals")
    deepest = active.where("kind = 'prefix'").agg(F.max(F.size(F.split("entry", "/")) - 1)).first()[0] or 0
    own = captures.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(fetched).cast("date").alias("fetched"), F.monotonically_increasing_id().alias("row"), host_of(F.col(url)).alias("host"))
    own = table(own, "captures")  # row numbers must not change between the two uses
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    # the host, then with each leading part of the path that an entry could have
    steps = F.concat(F.array("host"), F.slice(segments_of(F.col("url")), F.lit(1), F.lit(deepest)))
    leading = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("prefix:"), F.array_join(F.slice(steps, F.lit(1), i), "/")))
    # what a capture needs in the join is its row number, day and one key
    asked = own.where("host != '' and fetched is not null").select("row", "fetched", F.explode(F.array_distinct(F.concat(domains, leading))).alias("match"))
    listed = active.select(F.concat_ws(":", "kind", "entry").alias("match"), "since", "until")
    # captures by listed key, so that keys of very many are known, and keys that are not listed go
    weight = asked.groupBy("match").agg(F.count("*").alias("rows")).join(listed.select("match").distinct(), "match", "left_semi")
    spans = listed.groupBy("match").agg(F.collect_list(F.struct("since", "until")).alias("spans")).join(weight, "match")
    held = join_hot(asked, table(spans, "listed"), ["match"], "rows", own.count())
    active_then = F.size(F.filter("spans", lambda s: (F.col("fetched") >= s["since"]) & (s["until"].isNull() | (F.col("fetched") < s["until"])))) > 0
    hits = held.where(active_then).groupBy("row").agg(F.count("*").alias("n_active"), F.min("match").alias("entry"))
    out = own.join(hits, "row", "left")
    return out.select(F.col("key").alias(key), "url", "host", "fetched", F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"), "entry", F.col("n_active").isNull().alias("allowed"))
