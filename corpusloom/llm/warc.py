"""Resolving not-modified revisits of web archives against the full responses they refer to."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise

#: Fields of a 304 response that must not replace the stored response's (fixed values of HTTP caching).
NOT_MERGED = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authorization",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without www., default port, fragment, tracking parameters and last slash.

    http and https name the same page. Null stays null.
    """
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(plain, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1), ":(80|443)$", ""))
    rest = F.regexp_replace(plain, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*", "")
    rest = F.regexp_replace(rest, r"([?&])(?:utm_[A-Za-z]*=[^&]*&?)+", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?&]$", ""), "/$", "")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), rest)


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that then meet, the last one's value stays. Null is no headers."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def weak_tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^[Ww]/", "")


def resolve_revisits(records: DataFrame, merge_unchecked: bool = False) -> DataFrame:
    """One row per revisit: record_id, url (canonical), refers_to, status, headers.

    records has record_id, url, ts (any ordered type), kind ("response" or "revisit"), http_status (int) and
    headers (map of strings); other columns are ignored. A revisit is a record of kind revisit with status
    304. It refers to the latest earlier full response (kind response, status 200) of the same canonical URL,
    earlier by (ts, record_id). status is

    - resolved: both have an ETag and they match weakly, or else both have Last-Modified and they are equal;
    - unchecked: they share no validator;
    - mismatch: a shared validator differs; refers_to names the response, headers stay the revisit's;
    - orphan: there is no such response; refers_to is null and headers stay the revisit's.

    For resolved, and for unchecked if merge_unchecked is set, headers are the response's, updated by the
    revisit's except NOT_MERGED; otherwise no validator agreed and headers stay the revisit's.
    Revisits without URL or time are orphans; repeated revisits each give a row; of repeated responses the
    largest record_id of the latest time counts. An empty table gives an empty result.

    Records are range-partitioned by (URL, time), so one URL that holds a third of them spans many
    partitions. Each partition finds responses of its own; the latest response before a partition comes from
    one row per URL and partition, a table that grows with the input and so is never broadcast. Bodies are
    never read.
    """
    rows = records.select(
        "record_id",
        canonical_url(F.col("url")).alias("url"),
        "ts",
        ((F.col("kind") == "revisit") & (F.col("http_status") == 304)).alias("revisit"),
        ((F.col("kind") == "response") & (F.col("http_status") == 200)).alias("full"),
        lower_names(F.col("headers")).alias("headers"),
    ).where("revisit or full")
    can_order = F.col("url").isNotNull() & F.col("ts").isNotNull()
    dealt = rows.where(can_order).repartitionByRange("url", "ts", "record_id")
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id()), "captures")
    response = F.when(F.col("full"), F.struct(F.col("record_id").alias("id"), "headers"))
    here = Window.partitionBy("url", "part").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("own", F.last(response, ignorenulls=True).over(here)).where("revisit")
    ends = dealt.groupBy("url", "part").agg(
        F.max_by(response, F.when(F.col("full"), F.struct("ts", "record_id"))).alias("end")
    )
    earlier = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("url").alias("_url"), F.col("part").alias("_part"), F.last("end", ignorenulls=True).over(earlier).alias("carry")
    ).where("carry is not null")
    found = within.join(carried.hint("merge"), (F.col("url") == F.col("_url")) & (F.col("part") == F.col("_part")), "left")
    found = found.select("record_id", "url", "headers", F.coalesce("own", "carry").alias("of"))
    lost = rows.where(~can_order).where("revisit").select("record_id", "url", "headers", F.lit(None).alias("of"))
    found = found.unionByName(lost)
    tags = weak_tag(F.col("headers")["etag"]), weak_tag(F.col("of.headers")["etag"])
    dates = F.trim(F.col("headers")["last-modified"]), F.trim(F.col("of.headers")["last-modified"])
    same = F.coalesce(tags[0] == tags[1], dates[0] == dates[1])
    status = (
        F.when(F.col("of").isNull(), "orphan")
        .when(same, "resolved")
        .when(same.isNull(), "unchecked")
        .otherwise("mismatch")
    )
    permitted = F.map_filter("headers", lambda name, _: ~name.isin(*NOT_MERGED))
    merged = F.map_zip_with(F.col("of.headers"), permitted, lambda _, old, new: F.coalesce(new, old))
    found = found.withColumn("status", status)
    agreed = ["resolved", "unchecked"] if merge_unchecked else ["resolved"]
    return found.select(
        "record_id",
        "url",
        F.col("of.id").alias("refers_to"),
        "status",
        F.when(F.col("status").isin(agreed), merged).otherwise(F.col("headers")).alias("headers"),
    )
