"""Temporal list join: captures against the list entries that were active when they were fetched.

Entries (list, domain, listed_at, listed) are dated: from ``listed_at`` on the domain stands on the list, or no longer
does. They become validity intervals [from, until). A capture is evaluated for its host and all parent domains of it as
of its own fetch time. Everything is DataFrame functions.

Of entries with one list, domain and time, a listing wins over a removal; repeated entries change nothing. Entries with
a null in any field are ignored. A capture without a usable host (null, no scheme, over ``LONGEST`` characters) or
without a time matches nothing and stays in the result; repeated captures are judged each by itself.

Hot domains: the successor of an entry is looked up inside (domain, days) buckets, and between buckets by one row each;
the join's key is (domain, bucket) too, so a domain with a third of all rows is dealt over its days, and what remains
skewed is an ordinary join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST = 253
DAYS = 7
#: Fixed value: scheme, optional user, host.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without trailing dots; null where there is none or it is too long."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when((host != "") & (F.length(host) <= LONGEST), host)


def domains_of(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def _bucket(time: Column) -> Column:
    return F.floor(F.datediff(time, F.lit("1970-01-01").cast("date")) / DAYS).cast("int")


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (list, domain, from_ts, until_ts); until_ts is null while nothing has ended them."""
    known = entries.select("list", "domain", "listed_at", "listed").dropna()
    states = known.groupBy("list", "domain", "listed_at").agg(F.max("listed").alias("listed")).withColumn("bucket", _bucket(F.col("listed_at")))
    firsts = states.groupBy("list", "domain", "bucket").agg(F.min("listed_at").alias("first"))
    later = firsts.select("list", "domain", "bucket", F.lead("first").over(Window.partitionBy("list", "domain").orderBy("bucket")).alias("later"))
    inside = F.lead("listed_at").over(Window.partitionBy("list", "domain", "bucket").orderBy("listed_at"))
    ended = states.withColumn("inside", inside).join(later, ["list", "domain", "bucket"])
    return ended.where("listed").select("list", "domain", F.col("listed_at").alias("from_ts"), F.coalesce("inside", "later").alias("until_ts"))


def listed_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Per capture: the ``keep`` columns, host, n_active (entries active for it) and lists (sorted distinct names)."""
    shots = captures.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"), host_of(F.col(url_col)).alias("host"), F.col(time_col).alias("at"))
    shots = shots.withColumn("bucket", _bucket(F.col("at"))).withColumn("domain", F.explode_outer(domains_of(F.col("host"))))
    # Intervals are cut to the days of the captures; open ones reach to the last.
    first, last = captures.agg(F.min(_bucket(F.col(time_col))), F.max(_bucket(F.col(time_col)))).head()
    spans, first, last = validity(entries), F.lit(first).cast("int"), F.lit(last).cast("int")
    low, high = F.greatest(_bucket(F.col("from_ts")), first), F.least(F.coalesce(_bucket(F.col("until_ts")), last), last)
    spans = spans.where(low <= high).select("list", "domain", "from_ts", "until_ts", F.explode(F.sequence(low, high)).alias("bucket"))
    active = (F.col("at") >= F.col("from_ts")) & (F.col("until_ts").isNull() | (F.col("at") < F.col("until_ts")))
    met = shots.alias("s").join(spans.alias("e"), (F.col("s.domain") == F.col("e.domain")) & (F.col("s.bucket") == F.col("e.bucket")) & active, "left")
    # A capture meets few entries, each list and domain at most once; partial sums come before the shuffle.
    out = met.groupBy("row", "kept", "host").agg(F.count("list").alias("n_active"), F.concat_ws(",", F.array_sort(F.collect_set("list"))).alias("lists"))
    return out.select("kept.*", "host", "n_active", "lists")
