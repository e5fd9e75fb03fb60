"""Queries over raw pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..tables import table


@query(r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title_length, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links,
 regexp_extract(url, 'https?://([^/]+)/', 1) AS host, CASE WHEN NOT contains(html, '<html') THEN 'parse_error' WHEN NOT contains(html, '<article>') THEN 'empty' ELSE 'success' END AS status FROM pages""")
def html_source_extract(spark, sf_dir):
    """Fields of raw pages by pattern; a page that lacks its parts stays as a quarantine row."""
    h = F.col("html")
    count = lambda p, k: F.size(F.regexp_extract_all(h, F.lit(p), F.lit(k))).cast("long")
    status = F.when(~F.contains(h, F.lit("<html")), "parse_error").when(~F.contains(h, F.lit("<article>")), "empty").otherwise("success")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"),
        F.length(F.regexp_extract(h, "<title>([^<]*)</title>", 1)).cast("long").alias("title_length"),
        count("<p>", 0).alias("paragraphs"),
        count('<a href="([^"]*)"', 1).alias("links"),
        F.regexp_extract("url", "https?://([^/]+)/", 1).alias("host"),
        status.alias("status"),
    )


@query("SELECT n_name, r_name, count(*) AS suppliers, count(*) FILTER (WHERE s_acctbal > 0) AS positive, CASE WHEN r_regionkey < 2 THEN 1 WHEN r_regionkey < 4 THEN 2 ELSE 3 END AS tier FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def source_tiers(spark, sf_dir):
    """The source registry: tier by region, sources by nation."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    tier = F.when(F.col("r_regionkey") < 2, 1).when(F.col("r_regionkey") < 4, 2).otherwise(3)
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.groupBy("n_name", "r_name", tier.alias("tier")).agg(F.count("*").alias("suppliers"), F.count_if(F.col("s_acctbal") > 0).alias("positive"))
