"""DuckDB SQL of the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _site_lines() -> str:
    return rf"""
    pages AS (SELECT page_id, body_content,
                     nullif(regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '') AS site
              FROM page_results WHERE body_content IS NOT NULL),
    split AS (SELECT page_id, site, string_split(body_content, chr(10)) AS ls FROM pages),
    raw AS (SELECT page_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM split),
    lines AS (SELECT page_id, site, line, line_no,
                     regexp_replace(trim(regexp_replace(line, '{SPACES}', ' ', 'g')), '\p{{Nd}}+', '0', 'g') AS n FROM raw),
    sizes AS (SELECT site, count(*) AS site_rows FROM pages WHERE site IS NOT NULL GROUP BY site),
    counts AS (SELECT site, n, count(DISTINCT page_id) AS c FROM lines WHERE n <> '' AND site IS NOT NULL GROUP BY site, n),
    frequent AS (SELECT site, n FROM counts JOIN sizes USING (site) WHERE c >= 4 AND c >= site_rows * 0.25)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {_site_lines()} SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN frequent USING (site, n)",
        "p3_bodies": f"""WITH {_site_lines()},
            marked AS (SELECT l.page_id, l.line, l.line_no, f.n IS NOT NULL AS gone FROM lines l LEFT JOIN frequent f ON l.site = f.site AND l.n = f.n)
            SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS body_content,
                   CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS removed FROM marked GROUP BY page_id
            UNION ALL SELECT page_id, NULL, 0 FROM page_results WHERE body_content IS NULL""",
        "p7_found": """SELECT 'test_seed' AS tbl, seed_id AS rec_id FROM test_seed WHERE length(content) > 1200
            UNION ALL SELECT 'page_results', page_id FROM page_results WHERE length(body_content) > 1200""",
    }
