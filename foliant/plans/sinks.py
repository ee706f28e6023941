"""Queries over the texts that sinks write."""
from __future__ import annotations

from foliant.operators import sinks as S
from foliant.registry import query
from foliant.session import read_table

_LINE = "'- ' || id || ' [' || type || '] ' || coalesce(section, '') || CASE WHEN coalesce(sub_section, '') <> '' THEN ' > ' || sub_section ELSE '' END || ' ' || coalesce(CASE WHEN page_start = page_end THEN 'p' || page_start ELSE 'p' || page_start || '-' || page_end END, '')"
_ESC = "replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query("chunks_md", f"""WITH l AS (SELECT leaflet_key, string_agg({_LINE}, chr(10) ORDER BY id, chunk_key) AS body FROM chunks GROUP BY leaflet_key), n AS (SELECT leaflet_key, string_agg(type || '=' || n, ', ' ORDER BY type) AS head FROM (SELECT leaflet_key, type, count(*) AS n FROM chunks GROUP BY leaflet_key, type) GROUP BY leaflet_key)
 SELECT leaflet_key, '# chunks: ' || head || chr(10) || body AS md FROM l JOIN n USING (leaflet_key)""")
def chunks_md(spark, d):
    return S.chunks_markdown(read_table(spark, d, "chunks"), "leaflet_key")


@query("report_html", f"SELECT leaflet_key, string_agg('<tr><td>' || {_ESC.format(c='id')} || '</td><td>' || {_ESC.format(c='section')} || '</td><td>' || {_ESC.format(c='content')} || '</td></tr>', '' ORDER BY chunk_key) AS html FROM chunks GROUP BY leaflet_key")
def report_html(spark, d):
    return S.report_html(read_table(spark, d, "chunks"), "leaflet_key")


@query("layout_json")
def layout_json(spark, d):
    return S.layout_json(read_table(spark, d, "chunks"), "leaflet_key")
