"""WARC: server-not-modified revisits get the headers and the payload of the response that they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsreduce.llm.shared import ascii_lower

#: Header fields that a 304 response may replace.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, www., default port and fragment don't tell URLs apart; the host is lower-cased; an empty path is /. Null and urls without :// stay as they are."""
    host = F.regexp_replace(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), r"^www\.|:(80|443)$", "")
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))).otherwise(url)


def _etag(h: Column) -> Column:
    return F.regexp_replace(F.trim(h), "^W/", "")


def latest_before(instants: DataFrame, block_seconds: int) -> DataFrame:
    """(url, at, full) with prior: the full of the latest earlier instant of the url that has one.

    A url's instants are cut into blocks of time; what a block hands on is aggregated before any window runs over it.
    """
    block = F.floor(F.col("at") / block_seconds).alias("block")
    cut = instants.select("url", "at", "full", block)
    before = F.last("full", True).over(Window.partitionBy("url", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    handed = cut.groupBy("url", "block").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.col("at"))).alias("last"))
    earlier = F.last("last", True).over(Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    handed = handed.select("url", "block", earlier.alias("earlier"))
    return cut.withColumn("inner", before).join(handed, ["url", "block"]).select("url", "at", F.coalesce("inner", "earlier").alias("prior"))


def resolve_revisits(records: DataFrame, *, block_seconds: int = 86_400, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """records (record_id, url, at, kind, headers, payload) with resolution, refers_to, and headers and payload as resolved.

    at is in seconds; kind is 'response' (a full one) or 'revisit'; headers is a map with names in lower case. A revisit
    takes the latest response of its canonical URL at an earlier time (of equal times the largest record_id). If both
    have an ETag those must agree (weakly), else if both have Last-Modified those must. Then its payload is that
    response's and its headers are too, but for the permitted fields that it brings itself. resolution is 'response',
    'resolved', 'mismatch' (validators differ), or 'missing' (no earlier response, or no url or time); the last two
    keep what they have. Null headers are empty; repeated record_ids are rows of their own, of which a revisit may take
    any; an empty table gives an empty result.
    """
    ours = records.select("record_id", "url", "at", "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "payload").withColumn("canonical", canonical_url(F.col("url")))
    full = F.when(F.col("kind") == "response", F.col("record_id"))
    known = ours.where("canonical IS NOT NULL AND at IS NOT NULL")
    # copies of a moment meet before the shuffle
    instants = known.groupBy(F.col("canonical").alias("url"), "at").agg(F.max(full).alias("full"))
    prior = latest_before(instants, block_seconds).where("prior IS NOT NULL")
    revisits = ours.where("kind <> 'response' OR kind IS NULL")
    # revisits without a url or time, and below those without an earlier response, match nothing: dealt by record, they
    # don't all meet in one task. The others' spread, always 0, is no literal: both sides are then dealt by all keys
    spread = F.pmod(F.hash("record_id"), F.lit(4096))
    nowhere = F.col("canonical").isNull() | F.col("at").isNull()
    at = prior.withColumnRenamed("url", "canonical").withColumn("spread", F.pmod(F.hash("prior"), F.lit(1)))
    asked = revisits.withColumn("spread", F.when(nowhere, spread).otherwise(0)).join(at, ["canonical", "at", "spread"], "left").drop("spread")
    source = ours.where("kind = 'response'").select(F.col("record_id").alias("prior"), F.pmod(F.hash("record_id"), F.lit(1)).alias("spread"), F.col("headers").alias("full_headers"), F.col("payload").alias("full_payload")).dropDuplicates(["prior", "spread"])
    met = asked.withColumn("spread", F.when(F.col("prior").isNull(), spread).otherwise(0)).join(source, ["prior", "spread"], "left")
    mine, full_h = F.col("headers"), F.col("full_headers")
    tags = (_etag(mine["etag"]), _etag(full_h["etag"]))
    dates = (F.trim(mine["last-modified"]), F.trim(full_h["last-modified"]))
    agrees = F.when(tags[0].isNotNull() & tags[1].isNotNull(), tags[0] == tags[1]).when(dates[0].isNotNull() & dates[1].isNotNull(), dates[0] == dates[1]).otherwise(True)
    how = F.when(F.col("prior").isNull(), "missing").when(agrees, "resolved").otherwise("mismatch")
    allowed = F.map_filter(mine, lambda k, _: k.isin(*permitted))
    merged = F.map_concat(F.map_filter(full_h, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)
    done = F.col("resolution") == "resolved"
    met = met.withColumn("resolution", how).select("record_id", "url", "at", "kind", F.when(done, merged).otherwise(mine).alias("headers"), F.when(done, F.col("full_payload")).otherwise(F.col("payload")).alias("payload"), "resolution", F.when(F.col("resolution") != "missing", F.col("prior")).alias("refers_to"))
    whole = ours.where("kind = 'response'").select("record_id", "url", "at", "kind", "headers", "payload", F.lit("response").alias("resolution"), F.lit(None).cast(records.schema["record_id"].dataType).alias("refers_to"))
    return whole.unionByName(met)
