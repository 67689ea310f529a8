"""URL filters against dated lists: entries become validity intervals, captures meet those active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small, table

#: Seconds of a time bucket; both sides of the join carry (domain, bucket), so a hot domain is spread over time.
BUCKET = 30 * 86_400
#: A domain above more than one in so many hosts and times is dealt out in parts of that size.
SALTS = 512
# Fixed values of the query's list: first second of fetches, their span, and how long before it entries begin.
START, SPAN, BEFORE = 1_704_067_200, 31_622_400, 10_000_000


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and a final dot; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def suffixes(name: Column) -> Column:
    """The host and all domains above it, the longest first; an address stands for itself."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(name.rlike(r"^[0-9.]+$|^\["), F.array(name)).otherwise(every)


def bucket(seconds: Column) -> Column:
    return F.floor(seconds / BUCKET).cast("long")


def validity(entries: DataFrame) -> DataFrame:
    """entries (domain, category, action, listed_at) as intervals (domain, category, valid_from, valid_to).

    An "add" is valid until the next entry of its domain and category, a "remove" ends it; valid_to is null while
    nothing follows. Entries of one second count once, and a removal among them wins. Rows with nulls are
    not used. Entries are put in order inside time buckets, and the buckets of a domain among themselves, so no
    window holds all entries of a hot domain.
    """
    known = entries.where("domain is not null and category is not null and listed_at is not null and action is not null")
    at = known.groupBy("domain", "category", "listed_at").agg(F.max(F.col("action") == "remove").alias("removed"))
    at = at.withColumn("b", bucket(F.col("listed_at")))
    first = at.groupBy("domain", "category", "b").agg(F.min("listed_at").alias("first"))
    later = W.partitionBy("domain", "category").orderBy("b")
    following = first.select("domain", "category", "b", F.lead("first").over(later).alias("after"))
    inside = W.partitionBy("domain", "category", "b").orderBy("listed_at")
    at = at.withColumn("next", F.lead("listed_at").over(inside)).join(following, ["domain", "category", "b"])
    return at.where(~F.col("removed")).select(
        "domain", "category", F.col("listed_at").alias("valid_from"), F.coalesce("next", "after").alias("valid_to")
    )


def active_entries(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """captures (with host and fetched_at) with the entry that decides them: matched_domain, category, listed_at.

    Of the entries that are active at fetch time for the host or a domain above it the longest domain decides,
    then "allow" before other categories, then the later entry. Every row stays, repeated ones too; without host,
    time or entry the three are null. Hosts and times are looked up once each. An interval is valid from its
    first second to the one before its last.
    """
    asked = captures.where("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    keys = asked.select("*", F.explode(suffixes(F.col("host"))).alias("domain"), bucket(F.col("fetched_at")).alias("b"))
    # Open intervals reach to the last fetch that there is.
    last = asked.agg(F.max("fetched_at").alias("last"))
    spans = intervals.crossJoin(F.broadcast(last)).where("valid_from <= last")
    end = F.least(F.coalesce(F.col("valid_to") - 1, F.col("last")), F.col("last"))
    spans = spans.where(end >= F.col("valid_from")).select(
        "domain", "category", "valid_from", "valid_to", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(end))).alias("b")
    )
    spans = cut(spans)
    # Most domains above a host have no entry; of the others some are above very many hosts and are dealt out.
    keys = cut(keys.join(small(spans.select("domain").distinct()), "domain", "left_semi"))
    ways = F.least(F.lit(SALTS), F.col("keys"), F.ceil(F.col("keys") * SALTS / F.col("all"))).cast("int").alias("ways")
    counts = keys.groupBy("domain").agg(F.count(F.lit(1)).alias("keys")).crossJoin(F.broadcast(keys.agg(F.count(F.lit(1)).alias("all"))))
    # A host has few domains above it, so few times SALTS of them at most are as frequent as this.
    hot = F.broadcast(counts.where(F.col("keys") * SALTS > F.col("all")).select("domain", ways))
    keys = keys.join(hot, "domain", "left").withColumn("salt", F.pmod(F.xxhash64("host", "fetched_at"), F.coalesce("ways", F.lit(1))).cast("int"))
    spans = spans.join(hot, "domain", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)))
    active = keys.drop("ways").join(spans.drop("ways"), ["domain", "b", "salt"]).where(
        (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    )
    order = F.struct(F.length("domain"), (F.col("category") == "allow"), "valid_from", "category")
    chosen = active.groupBy("host", "fetched_at").agg(F.max_by(F.struct("domain", "category", "valid_from"), order).alias("e"))
    chosen = chosen.select(
        F.col("host").alias("__host"),
        F.col("fetched_at").alias("__at"),
        F.col("e.domain").alias("matched_domain"),
        F.col("e.category").alias("category"),
        F.col("e.valid_from").alias("listed_at"),
    )
    kept = captures.drop("matched_domain", "category", "listed_at")
    same = (kept["host"] == chosen["__host"]) & (kept["fetched_at"] == chosen["__at"])
    return kept.join(chosen, same, "left").drop("__host", "__at")


def _digits(text: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, n), 16, 10).cast("long")


def dated_list(hosts: DataFrame) -> DataFrame:
    """A list history for the hosts of a crawl and the domains above them, by a fixed rule on their names.

    A name has up to four entries, adds and removals in turn, at times that its md5 gives. Null hosts have none; repeated
    ones count once; no hosts give no entries.
    """
    names = hosts.where("host is not null").select(F.explode(suffixes(F.col("host"))).alias("domain")).distinct()
    rows = names.select("domain", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    key = F.concat(F.col("domain"), F.lit("#"), F.col("k").cast("string"))
    return rows.where(_digits(key, 1, 2) % 4 != 0).select(
        "domain",
        F.when(_digits(F.col("domain"), 1, 2) % 3 == 0, "allow").otherwise("block").alias("category"),
        F.when(F.col("k") % 2 == 0, "add").otherwise("remove").alias("action"),
        (F.lit(START - BEFORE) + _digits(key, 3, 7) % (SPAN + BEFORE)).alias("listed_at"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's verdict under the entries active at its fetch time, which its id gives by a fixed rule."""
    pages = table(spark, sf_dir, "pages")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    captures = pages.select(
        "page_id", host(F.col("url")).alias("host"), (F.lit(START) + _digits(name, 1, 7) % SPAN).alias("fetched_at")
    )
    found = active_entries(captures, validity(dated_list(captures.select("host"))))
    verdict = F.when(F.col("category") == "block", "drop").otherwise("keep")
    return found.select("page_id", "host", "fetched_at", verdict.alias("verdict"), "matched_domain", "category", "listed_at")


SQL = {
    "op2_url_filter": r"""
with c as (select page_id,
             nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)', 1), '.'), '') as host,
             1704067200 + ('0x' || substr(md5(coalesce(cast(page_id as varchar), 'null')), 1, 7))::bigint % 31622400 as fetched_at
           from pages),
 h as (select distinct host from c where host is not null),
 s as (select host, unnest(case when regexp_matches(host, '^[0-9.]+$|^\[') then [host]
        else list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) end) as domain from h),
 e as (select domain, case when ('0x' || substr(md5(domain), 1, 2))::bigint % 3 = 0 then 'allow' else 'block' end as category,
              k % 2 = 1 as removed,
              1704067200 - 10000000 + ('0x' || substr(md5(domain || '#' || k), 3, 7))::bigint % (31622400 + 10000000) as since
       from (select distinct domain from s), range(0, 4) r(k)
       where ('0x' || substr(md5(domain || '#' || k), 1, 2))::bigint % 4 <> 0),
 g as (select domain, category, since, bool_or(removed) as removed from e group by all),
 v as (select *, lead(since) over (partition by domain, category order by since) as until from g),
 m as (select c.host, c.fetched_at,
              arg_max({'d': v.domain, 'c': v.category, 'l': v.since},
                      {'a': length(v.domain), 'b': v.category = 'allow', 'c': v.since, 'd': v.category}) as x
       from (select distinct host, fetched_at from c) c join s on s.host = c.host join v on v.domain = s.domain
       where not v.removed and v.since <= c.fetched_at and (v.until is null or c.fetched_at < v.until)
       group by c.host, c.fetched_at)
select c.page_id, c.host, c.fetched_at, case when x.c = 'block' then 'drop' else 'keep' end as verdict,
       x.d as matched_domain, x.c as category, x.l as listed_at
from c left join m on m.host = c.host and m.fetched_at = c.fetched_at
"""
}
