"""Queries over parsed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import controls, html
from ..plans.catalog import Catalog, load

C = Catalog()


@C.add("page_sections")
def page_sections(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.posexplode(html.sections("html")).alias("k", "s"))
    return p.select("page_id", "k", "s.heading", F.length("s.text").alias("chars"))


@C.add("page_links_parsed", """
SELECT page_id, count(DISTINCT href) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS href FROM pages) GROUP BY page_id""")
def page_links_parsed(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.explode(html.links("html")).alias("l"))
    return p.groupBy("page_id").agg(F.countDistinct("l.href").alias("links"))


@C.add("page_forms", "SELECT page_id, CAST(len(regexp_extract_all(lower(html), '<form[ >]')) AS INT) AS forms FROM pages")
def page_forms(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.size(html.forms("html")).alias("forms"))


# Pages have anchors only; each gets a control of some kind behind its text.
_ADDED = (
    '<a href="/dl/K.PDF?utm_source=a#x" title="t">Paper  <b>K</b></a>',
    '<form action="/send/K.docx?share=1"><button formaction="//files.example.org/K.docx">Word</button></form>',
    """<button class="get file" onclick="go('/code/K.pdf?v=2')">Go</button>""",
    '<div data-url="/fetch/K">Download now</div>',
    '<div data-url="/fetch/K">Share the download</div>',
    '<span data-link="https://www.mediafire.com/file/K">mirror</span>',
    '<p>see https://mega.nz/file/K.</p>',
)
_N = len(_ADDED)
_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_KIND = f"page_id % {_N}"


def _found(spark, sf):
    p = load(spark, sf, "pages").select("page_id", "url", "html")
    added = F.element_at(F.array(*[F.lit(a) for a in _ADDED]), (F.col("page_id") % _N + 1).cast("int"))
    p = p.withColumn("html", F.concat("html", F.replace(added, F.lit("K"), F.col("page_id").cast("string"))))
    return p.select("page_id", "url", controls.controls("html", "url").alias("found"))


@C.add("file_links", f"""
SELECT page_id, CASE {_KIND} WHEN 0 THEN {_ORIGIN} || '/dl/' || page_id || '.PDF' WHEN 1 THEN regexp_extract(url, '^([a-z]+):', 1) || '://files.example.org/' || page_id || '.docx' ELSE {_ORIGIN} || '/code/' || page_id || '.pdf?v=2' END AS url,
  CASE {_KIND} WHEN 0 THEN 'Paper ' || page_id WHEN 1 THEN 'Word' ELSE 'Go' END AS label
FROM pages WHERE {_KIND} < 3""")
def file_links(spark, sf):
    """Documents that anchors, forms, buttons and scripts of pages name; share pages are refused."""
    return _found(spark, sf).select("page_id", F.inline(F.array_distinct(controls.file_links(F.col("found")))))


@C.add("provider_link_rows", f"""
SELECT page_id, CASE {_KIND} WHEN 5 THEN 'https://www.mediafire.com/file/' ELSE 'https://mega.nz/file/' END || page_id AS url, CASE {_KIND} WHEN 5 THEN 'mediafire' ELSE 'mega' END AS provider
FROM pages WHERE {_KIND} >= 5""")
def provider_link_rows(spark, sf):
    """Links of pages to file providers, each once."""
    return _found(spark, sf).select("page_id", F.inline(controls.provider_links(F.col("found")))).select("page_id", "url", "provider").distinct()


@C.add("labelled_controls", f"SELECT page_id, {_ORIGIN} || '/fetch/' || page_id AS url, 'Download now' AS label FROM pages WHERE {_KIND} = 3")
def labelled_control_rows(spark, sf):
    """Controls that say download and name no document; those that say something else, too, are none."""
    return _found(spark, sf).select("page_id", F.inline(F.array_distinct(controls.labelled_controls(F.col("found"), F.col("url")))))
