"""Crawl queries over a link graph made of unit ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl
from .base import query


@query("""WITH RECURSIVE l AS (SELECT DISTINCT birim_id AS src, CAST(regexp_extract(url, '[?&]id=([0-9]+)', 1) AS INTEGER) AS dst FROM page_results WHERE regexp_matches(url, '[?&]id=[0-9]+') AND birim_id IS NOT NULL),
  w(node, depth) AS (SELECT min(src), 0 FROM l UNION SELECT dst, depth + 1 FROM w JOIN l ON src = node WHERE depth < 12)
  SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node""")
def crawl_frontier(t):
    dst = F.regexp_extract("url", r"[?&]id=([0-9]+)", 1)
    links = t.page_results.filter((dst != "") & F.col("birim_id").isNotNull()).select(F.col("birim_id").alias("src"), F.nullif(dst, F.lit("")).cast("int").alias("dst")).distinct()
    seeds = links.agg(F.min("src").alias("node"))
    return crawl.frontier(links, seeds)
