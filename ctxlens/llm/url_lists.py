"""Temporal URL filter: dated list entries as validity intervals, joined as of fetch time.

Only DataFrame functions. An entry says that from its day on a domain is listed or no
longer listed. Captures are judged by host and parent domains, so one listed domain
covers its subdomains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxlens.llm.tables import stage

def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and trailing dot; null if there is none.

    The user ends at the last `@` of the authority; a backslash ends the authority as a
    slash does; an IPv6 address keeps its brackets.
    """
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    place = F.regexp_replace(authority, r"^.*@", "")
    name = F.when(place.startswith("["), F.regexp_extract(place, r"^(\[[^\]]+\])", 1)).otherwise(
        F.regexp_extract(place, r"^([^:]+)", 1)
    )
    return plain_name(name)


def plain_name(name: Column) -> Column:
    """A host or listed domain in lower case, without trailing dots; null if nothing is left."""
    name = F.lower(F.regexp_replace(name, r"\.+$", ""))
    return F.when(name != "", name)


def domains(name: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first; an IP address alone."""
    labels = F.split(name, r"\.")
    count = F.size(labels)
    address = name.startswith("[") | name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    return F.when(address | (count < 2), F.array(name)).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), count - 1)),
            lambda i: F.array_join(F.slice(labels, i, count - i + 1), "."),
        )
    )


def intervals(entries: DataFrame) -> DataFrame:
    """domain, since, until (null: open) of every time a domain was listed.

    `entries` has domain, day (date) and listed (boolean). Of several entries of a
    domain and day, listing wins. Entries without domain, day or state play no part.
    They are first made one per domain and day, so the window over a domain holds no
    more rows than there are days. Domains are taken in lower case without trailing dots.
    """
    daily = (
        entries.where(F.col("domain").isNotNull() & F.col("day").isNotNull() & F.col("listed").isNotNull())
        .groupBy(plain_name(F.col("domain")).alias("domain"), "day")
        .agg(F.max("listed").alias("listed"))
        .where(F.col("domain").isNotNull())
    )
    order = W.partitionBy("domain").orderBy("day")
    changes = daily.withColumn("before", F.lag("listed", 1, False).over(order)).where(
        F.col("listed") != F.col("before")
    )
    return changes.withColumn("until", F.lead("day").over(order)).where("listed").select(
        "domain", F.col("day").alias("since"), "until"
    )


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture_id, host, listed, domain and since of every capture.

    `captures` has capture_id, url and day. domain and since tell the longest listed
    domain and since when; both are null for a capture that no interval covers, as
    for one without host or day. An entry counts from its own day on, its end does
    not. Equal hosts of a day are judged once; the hot ones come back by a join that
    AQE may split. Repeated rows give repeated rows.
    """
    rows = captures.select("capture_id", host(F.col("url")).alias("host"), "day")
    asked = rows.where(F.col("host").isNotNull() & F.col("day").isNotNull()).select("host", "day").distinct()
    spread = asked.select("host", "day", F.explode(domains(F.col("host"))).alias("domain"))
    # Written, so that Spark can split the join where many hosts share a domain.
    listed = stage(intervals(entries), "intervals")
    covered = (
        spread.join(listed, "domain")
        .where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
        .groupBy("host", "day")
        .agg(F.max_by(F.struct("domain", "since"), F.length("domain")).alias("hit"))
    )
    return rows.join(covered, ["host", "day"], "left").select(
        "capture_id", "host", F.col("hit").isNotNull().alias("listed"),
        F.col("hit.domain").alias("domain"), F.col("hit.since").alias("since"),
    )
