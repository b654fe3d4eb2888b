"""HTML extraction with the standard parser, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.head, self.sections, self.links, self.link, self.forms = 0, "", [["", []]], [], None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        elif tag in ("h1", "h2", "h3"):
            self.head = tag
            self.sections.append(["", []])
        elif tag == "a" and a.get("href"):
            self.link = [a["href"], ""]
        elif tag == "form":
            self.forms.append([a.get("method", "get").lower(), a.get("action", ""), []])
        elif tag in ("input", "select", "button") and self.forms and a.get("name"):
            self.forms[-1][2].append(f"{a['name']}={a.get('value', '')}")
        for name in ("formaction", "data-href", "data-url"):
            if a.get(name):
                self.links.append([a[name], ""])

    def handle_endtag(self, tag):
        if tag in _SKIP and self.skip:
            self.skip -= 1
        elif tag == self.head:
            self.head = ""
        elif tag == "a" and self.link:
            self.links.append(self.link)
            self.link = None

    def handle_data(self, data):
        s = " ".join(data.split())
        if self.link is not None:
            self.link[1] = f"{self.link[1]} {s}".strip()
        if self.skip or not s:
            return
        if self.head:
            self.sections[-1][0] = f"{self.sections[-1][0]} {s}".strip()
        else:
            self.sections[-1][1].append(s)


def parse(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    return p


def _sections(s: pd.Series) -> pd.Series:
    return s.map(lambda h: [{"heading": a, "text": " ".join(b)} for a, b in parse(h).sections if a or b])


def _links(s: pd.Series) -> pd.Series:
    return s.map(lambda h: [{"href": a, "label": b} for a, b in {x[0]: x for x in reversed(parse(h).links)}.values()][::-1])


def _forms(s: pd.Series) -> pd.Series:
    stable = lambda f: "&".join(sorted(x for x in f[2] if not any(v in x.lower() for v in ("token", "csrf", "nonce"))))
    return s.map(lambda h: [{"method": f[0], "action": f[1], "identity": stable(f)} for f in parse(h).forms])


def sections(html: Column | str) -> Column:
    """Text by heading, without scripts, menus and page furniture."""
    return F.pandas_udf(_sections, "array<struct<heading:string,text:string>>")(html)


def links(html: Column | str) -> Column:
    """Links with their labels, in page order, the first of equal ones."""
    return F.pandas_udf(_links, "array<struct<href:string,label:string>>")(html)


def forms(html: Column | str) -> Column:
    """Forms with their sorted fields as a stable identity; volatile tokens are left out."""
    return F.pandas_udf(_forms, "array<struct<method:string,action:string,identity:string>>")(html)
