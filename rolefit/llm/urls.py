"""URL filters by a temporal list join.

A list is a history of dated entries: (pattern, changed_at, listed). An entry holds from its date until the pattern's
next entry, so the history becomes validity intervals, and a capture is judged by the interval that holds at its fetch
time, not by today's list. Patterns are a host, with all hosts below it, or a host with a path prefix of whole segments
(`example.com/a`). Equal patterns dated alike: the entry that lists wins. Rows with a null pattern or date are ignored.

A capture joins the intervals of each of its own prefixes by equality, with the dates as further condition; each pattern
has one interval at a time, so a capture gets one row for each listed prefix at most. A host with a third of all captures is a
hot key on the capture side only, which the adaptive skew join splits. Null or host-less URLs and null times match
nothing and are not blocked. Repeated captures are judged each by itself. Empty tables give an empty result or none blocked.
Columns of the same name as a result are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, with_new


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def prefixes(url: Column) -> Column:
    """All patterns that cover a URL: the host and its parents, and the host with each path prefix."""
    labels = F.split(host(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    path = F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), "/")
    segments = F.filter(path, lambda s: s != "")
    paths = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.concat(host(url), F.lit("/"), F.array_join(F.slice(segments, 1, k), "/")))
    empty = F.array().cast("array<string>")
    return F.when(host(url) != "", F.array_distinct(F.concat(parents, F.when(F.size(segments) > 0, paths).otherwise(empty)))).otherwise(empty)


def intervals(entries: DataFrame, pattern: str = "pattern", changed_at: str = "changed_at", listed: str = "listed") -> DataFrame:
    """(pattern, valid_from, valid_to) of the stretches in which a pattern is listed; valid_to is null while it holds."""
    dated = entries.where(F.col(pattern).isNotNull() & F.col(changed_at).isNotNull())
    one = dated.groupBy(F.col(pattern).alias("pattern"), F.col(changed_at).alias("valid_from")).agg(F.max(F.coalesce(F.col(listed), F.lit(False))).alias("listed"))
    order = Window.partitionBy("pattern").orderBy("valid_from")
    return one.withColumn("valid_to", F.lead("valid_from").over(order)).where("listed").select("pattern", "valid_from", "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at", key: str = "page_id") -> DataFrame:
    """`captures` with n_matches, the number of patterns that list the URL at its fetch time, the longest of them
    (matched, null if none; the first by name of equal length) and blocked."""
    seen = captures.select(F.col(url).alias("url"), F.col(fetched_at).alias("at")).where("url is not null and at is not null").distinct()
    asked = seen.select("url", "at", F.explode(prefixes(F.col("url"))).alias("pattern"))
    held = intervals(entries).withColumnRenamed("pattern", "listed_pattern")
    hit = asked.join(held, (F.col("pattern") == F.col("listed_pattern")) & (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    per = hit.groupBy("url", "at").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.length("pattern")).alias("l"), "pattern")).alias("best"))
    u, t, n, best = (free_name(captures, x) for x in ("u", "t", "n", "best"))
    per = per.select(F.col("url").alias(u), F.col("at").alias(t), F.col("n").alias(n), F.col("best.pattern").alias(best))
    both = captures.join(per, (captures[url] == per[u]) & (captures[fetched_at] == per[t]), "left")
    out = with_new(both, {"n_matches": F.coalesce(F.col(n), F.lit(0)), "matched": F.col(best), "blocked": F.col(n).isNotNull()})
    return out.drop(u, t, n, best)
