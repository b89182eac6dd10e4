"""Not-modified revisits resolved against the latest earlier full response of the same canonical URL.

Records are dealt by range of (URL, time), so that a URL with a third of all records fills many
partitions. Inside a partition a window carries the last full response forward; what crosses
partitions is one summary row per URL and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onefold.session import settle, small_side, stage

# Header fields that a not-modified answer must not change (hop-by-hop fields and
# those that describe the stored body).
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
# Query parameters that do not select content.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme, www., default port, fragment, tracking parameters and a final slash go; parameters are sorted.

    Host in lower case. A null URL stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _fields(headers: Column) -> Column:
    """Header entries with lower-case names; of names that then clash, the first in order of the original names."""
    entries = F.array_sort(F.map_entries(headers))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    return F.filter(named, lambda e, i: F.array_position(names, e["key"]) == i + 1)


def resolve_revisits(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per revisit record with the response that it confirms.

    ``records``: record_id long, url, ts long, kind ('response' or 'revisit'), etag, last_modified, digest,
    headers map<string,string>. Result: record_id, url_key, ts, response_id (latest response of the
    canonical URL with a smaller ts; among equal times the largest record_id), outcome, digest, headers.

    outcome: 'resolved' if the first validator that the revisit has (etag, compared weakly, else
    last_modified) equals the response's; 'unchecked' if it has none; 'mismatch' if they differ;
    'missing' without an earlier response. digest and headers are given for 'resolved' and
    'unchecked': the response's headers, overlaid with the revisit's but for ``KEPT_FIELDS``; names in
    lower case. Records without url, ts or record_id cannot be placed: such a revisit is 'missing',
    such a response is no candidate. Null headers are an empty map. Repeated revisits are answered
    each. Records of other kinds and other columns are ignored.
    """
    spark = records.sparkSession
    empty = F.array().cast("array<struct<key:string,value:string>>")
    rows = records.where("kind IN ('response', 'revisit')").select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"),
        (F.col("kind") == "response").alias("full"), "etag", "last_modified", "digest",
        F.coalesce(_fields(F.col("headers")), empty).alias("fields"),
    )
    sound = F.expr("url_key IS NOT NULL AND ts IS NOT NULL AND record_id IS NOT NULL")
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # All records of a URL with one time are in one partition, so what is carried over is strictly earlier.
    dealt = stage(rows.where(sound).repartitionByRange(count, "url_key", "ts").withColumn("part", F.spark_partition_id()), "captures")
    own = ["etag", "last_modified", "digest", "fields"]
    response = F.when(F.col("full"), F.struct("ts", F.col("record_id").alias("response_id"), *own))

    # At most one URL crosses from a partition into the next: these tables have some rows per partition.
    crossing = dealt.groupBy("url_key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    crossing = small_side(settle(crossing.select("url_key")))
    last = dealt.join(crossing, "url_key", "left_semi").groupBy("url_key", "part").agg(F.max(response).alias("last"))
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = small_side(settle(last.select("url_key", "part", F.max("last").over(before).alias("carried"))))

    earlier = Window.partitionBy("url_key", "part").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    asked = dealt.withColumn("inside", F.max(response).over(earlier)).where("NOT full").join(carried, ["url_key", "part"], "left")
    asked = asked.withColumn("found", F.coalesce("inside", "carried")).select("record_id", "url_key", "ts", *own, "found")
    nowhere = rows.where(~sound & ~F.col("full"))
    asked = asked.unionByName(nowhere.select("record_id", "url_key", "ts", *own), allowMissingColumns=True)

    by_tag = _strong(F.col("etag")) == _strong(F.col("found.etag"))
    by_date = F.trim("last_modified") == F.trim("found.last_modified")
    checked = F.when(F.col("etag").isNotNull(), F.coalesce(by_tag, F.lit(False))).when(
        F.col("last_modified").isNotNull(), F.coalesce(by_date, F.lit(False))
    )
    outcome = F.when(F.col("found").isNull(), "missing").when(checked.isNull(), "unchecked").when(checked, "resolved").otherwise("mismatch")
    confirmed = F.col("outcome").isin("resolved", "unchecked")
    new = F.filter("fields", lambda e: ~e["key"].isin(*KEPT_FIELDS))
    names = F.transform(new, lambda e: e["key"])
    old = F.filter("found.fields", lambda e: ~F.array_contains(names, e["key"]))
    return asked.withColumn("outcome", outcome).select(
        "record_id", "url_key", "ts", F.col("found.response_id").alias("response_id"), "outcome",
        F.when(confirmed, F.col("found.digest")).alias("digest"),
        F.when(confirmed, F.map_from_entries(F.array_sort(F.concat(old, new)))).alias("headers"),
    )
