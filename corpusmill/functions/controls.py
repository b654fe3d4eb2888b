"""What a page offers for download: targets of anchors, forms, buttons and scripted controls.

One parse a page lists every target with its element's label and description; what kind of target it
is, is decided by column expressions.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import links
from .html import _VOID

# Attributes with targets, and words that mark a download or something else.
TARGETS = ("href", "action", "formaction", "data-url", "data-href", "data-link", "data-download-url")
DOWNLOAD = r"(?i)\b(download(?:\s+now|\s+file)?|get\s+file|pdf|docx)\b"
NO_DOWNLOAD = r"(?i)\b(share|telegram|reply|comment|print|whatsapp|facebook|twitter|pinterest|bookmark|follow)\b"
_QUOTED = re.compile(r"""['"]([^'"]+)['"]""")
_PLAIN = re.compile(r"""https?://[^\s"'<>]+""", re.I)
FIELDS = "array<struct<url:string,label:string,marker:string,kind:string>>"


class _Element:
    """An open element that has targets; its text is gathered until it closes."""

    __slots__ = ("tag", "attrs", "text", "place")

    def __init__(self, tag: str, attrs: dict[str, str], place: int):
        self.tag, self.attrs, self.text, self.place = tag, attrs, [], place


class _Controls(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.base, self.open, self.done, self.depth = "", [], [], {}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "base" and not self.base:
            self.base = a.get("href", "")
        elif "onclick" in a or any(k in TARGETS or k.startswith("data-") for k in a):
            e = _Element(tag, a, len(self.open) + len(self.done))
            (self.done if tag in _VOID else self.open).append(e)
        if tag not in _VOID:
            self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open and any(e.tag == tag for e in self.open):
            k = max(k for k, e in enumerate(self.open) if e.tag == tag)
            if self.depth.get(tag, 0) <= sum(e.tag == tag for e in self.open):
                self.done.append(self.open.pop(k))
        self.depth[tag] = max(self.depth.get(tag, 0) - 1, 0)

    def handle_data(self, data):
        for e in self.open:
            e.text.append(data)


def targets(html: str | None, page: str | None) -> list[dict]:
    """``url, label, marker, kind`` of every target of a page, absolute, in page order.

    The kind is ``anchor``, ``attribute``, ``code`` (quoted in a script of the element) or ``plain`` (a
    URL anywhere in the source).  Labels are the element's text, else its title; markers add its other
    descriptions.  What can't be joined with the page's address is left out.
    """
    p = _Controls()
    p.feed(html or "")
    p.close()
    out: list[dict] = []
    base = page or ""

    def add(raw: str, label: str, marker: str, kind: str) -> None:
        raw = raw.strip()
        if raw and not raw.startswith("#"):
            try:
                out.append({"url": urljoin(base, raw), "label": label, "marker": marker, "kind": kind})
            except ValueError:
                pass

    try:
        base = urljoin(base, p.base) if p.base else base
    except ValueError:
        pass
    for e in sorted(p.done + p.open, key=lambda e: e.place):
        text = " ".join("".join(e.text).split())
        label = text or e.attrs.get("title", "")
        marker = " ".join([text, *(e.attrs.get(k, "") for k in ("title", "aria-label", "id", "class", "value"))])
        for name, value in e.attrs.items():
            if name in TARGETS or name.startswith("data-"):
                add(value, label, marker, "anchor" if e.tag == "a" and name == "href" else "attribute")
        for m in _QUOTED.finditer(e.attrs.get("onclick", "")):
            add(m[1].replace("\\/", "/"), label, marker, "code")
    for m in _PLAIN.finditer((html or "").replace("\\/", "/")):
        add(m[0].rstrip(").,;}"), "", "", "plain")
    return out


def _targets(html: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([targets(h, p) for h, p in zip(html, page, strict=True)])


def controls(html: Column | str, page: Column | str) -> Column:
    """``array<struct<url, label, marker, kind>>`` of :func:`targets`."""
    return F.pandas_udf(_targets, FIELDS)(html, page)


def file_links(found: Column) -> Column:
    """``array<struct<url, label>>``: targets that name a document, guarded; other elements' plain text doesn't count."""
    kept = F.transform(F.filter(found, lambda c: c["kind"] != "plain"), lambda c: F.struct(links.guard(c["url"]).alias("url"), c["label"].alias("label")))
    return F.filter(kept, lambda c: c["url"].isNotNull() & links.is_document(c["url"]))


def provider_links(found: Column) -> Column:
    """``array<struct<url, provider, label>>``: targets on hosts of file providers, wherever they stand."""
    kept = F.transform(found, lambda c: F.struct(c["url"].alias("url"), links.provider(c["url"]).alias("provider"), c["label"].alias("label")))
    return F.filter(kept, lambda c: c["provider"].isNotNull())


def labelled_controls(found: Column, page: Column) -> Column:
    """``array<struct<url, label>>``: targets on the page's own site whose element says download, without a document's ending."""
    says = lambda c: c["marker"].rlike(DOWNLOAD) & ~c["marker"].rlike(NO_DOWNLOAD)
    own = lambda c: links.site_key(c["url"]) == links.site_key(page)
    kept = F.filter(found, lambda c: (c["kind"] != "plain") & says(c) & own(c) & links.scheme(c["url"]).isin("http", "https") & ~links.is_document(c["url"]))
    return F.transform(kept, lambda c: F.struct(F.regexp_replace(c["url"], "#.*$", "").alias("url"), c["label"].alias("label")))
