"""Audit of source links: what may be kept of a link is its digest and its host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The longest link and the longest host.
MAX_LINK_BYTES, MAX_HOST_BYTES = 2048, 253


def audit_source_links(links: DataFrame, url: str = "url") -> DataFrame:
    """``links`` without the link itself: verdict, host (of accepted ones) and link_sha256."""
    u = F.col(url)
    host = F.regexp_extract(u, "^https://([^/?#]*)", 1)
    verdict = (
        F.when((F.length(u) > MAX_LINK_BYTES) | ~u.rlike(r"^[\x21-\x7e]*\z"), "unprintable").when(~u.startswith("https://"), "not_https")
        .when(~host.rlike(rf"^[a-z0-9.:\[\]-]{{1,{MAX_HOST_BYTES}}}\z"), "bad_host").otherwise("accepted")
    )
    return links.withColumn("verdict", verdict).withColumn("host", F.when(F.col("verdict") == "accepted", host)).withColumn("link_sha256", F.sha2(u, 256)).drop(url)
