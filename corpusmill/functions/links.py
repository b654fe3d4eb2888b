"""URL and identity expressions, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track, and query keys of pages that aren't downloads.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "yclid")
NOT_DOWNLOADS = ("share", "shared", "sharing", "share_source", "replytocom", "amp", "output", "print")
# Hosts of file providers by kind.
PROVIDERS = {
    "drive": ("drive.google.com", "docs.google.com", "drive.usercontent.google.com", "drive.googleusercontent.com"),
    "mega": ("mega.nz", "mega.co.nz"),
    "mediafire": ("mediafire.com",),
    "dropbox": ("dropbox.com", "dropboxusercontent.com"),
    "terabox": ("terabox.com", "teraboxapp.com", "1024terabox.com", "1024tera.com", "terabox.app"),
    "scribd": ("scribd.com",),
}
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, group: int) -> Column:
    """Scheme 1, userinfo 2, host 3, port 4, path 5 or query 6 of a URL; empty where there is none."""
    return F.regexp_extract(F.trim(url), _URL, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """The lower-cased host, null where there is none."""
    return F.nullif(F.lower(part(url, 3)), F.lit(""))


def site_key(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def _query(q: Column) -> Column:
    return F.when(F.coalesce(q, F.lit("")) != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """Lower-cased scheme and host, no default port, no fragment; null unless http(s) with a host."""
    port = F.when(part(url, 4).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(url, 4)))
    whole = F.concat(scheme(url), F.lit("://"), host(url), port, part(url, 5), _query(part(url, 6)))
    return F.when(scheme(url).isin("http", "https") & host(url).isNotNull(), whole)


def _pairs(query: Column) -> Column:
    return F.filter(F.split(query, "&"), lambda p: p != "")


def _key(pair: Column) -> Column:
    return F.lower(F.get(F.split(pair, "=", 2), F.lit(0)))


def variants(url: Column) -> Column:
    """Distinct forms of a URL: canonical, without query, without tracking keys; none if it isn't one."""
    c = canonical(url)
    bare = F.regexp_replace(c, r"\?.*$", "")
    kept = F.filter(_pairs(part(c, 6)), lambda p: ~(_key(p).isin(*TRACKING) | _key(p).startswith("utm_")))
    clean = F.concat(bare, _query(F.array_join(kept, "&")))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.array(c, bare, clean))))


def guard(url: Column) -> Column:
    """A download URL without tracking keys and fragment; null for share and print pages.  The query
    stays as it was when nothing goes; an empty path becomes ``/``; port and userinfo stay."""
    pairs = _pairs(part(url, 6))
    refused = F.exists(pairs, lambda p: _key(p).isin(*NOT_DOWNLOADS))
    kept = F.filter(pairs, lambda p: ~(_key(p).isin(*TRACKING) | _key(p).startswith("utm_")))
    query = F.when(F.size(kept) == F.size(pairs), part(url, 6)).otherwise(F.array_join(kept, "&"))
    user = F.when(part(url, 2) != "", F.concat(part(url, 2), F.lit("@"))).otherwise(F.lit(""))
    port = F.when(part(url, 4) != "", F.concat(F.lit(":"), part(url, 4))).otherwise(F.lit(""))
    path = F.when(part(url, 5) == "", "/").otherwise(part(url, 5))
    whole = F.concat(scheme(url), F.lit("://"), user, host(url), port, path, _query(query))
    return F.when(scheme(url).isin("http", "https") & host(url).isNotNull() & ~refused, whole)


def in_domain(name: Column, domain: Column | str) -> Column:
    """The host is the domain or below it."""
    d = F.lit(domain) if isinstance(domain, str) else domain
    return (name == d) | name.endswith(F.concat(F.lit("."), d))


def provider(url: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, hosts in PROVIDERS.items():
        found = F.lit(False)
        for h in hosts:
            found = found | in_domain(host(url), h)
        out = F.when(found, kind).otherwise(out)
    return out


def is_document(url: Column) -> Column:
    return part(url, 5).rlike(r"(?i)\.(pdf|docx)$")


def looks_like_download(url: Column) -> Column:
    return is_document(url) | provider(url).isNotNull()


def is_search(url: Column) -> Column:
    return F.array_contains(F.split(F.lower(part(url, 5)), "/"), "search") | F.exists(_pairs(part(url, 6)), lambda p: _key(p).isin("s", "q", "search"))


def ancestors(url: Column) -> Column:
    """Every leading part of the path, shortest first."""
    segments = F.filter(F.split(part(url, 5), "/"), lambda s: s != "")
    made = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(segments, 1, k), "/")))
    return F.when(F.size(segments) > 0, made).otherwise(F.array().cast("array<string>"))


def is_prefix_child(child: Column, parent: Column) -> Column:
    """The child's path strictly extends the parent's on the same host."""
    at = F.regexp_replace(part(parent, 5), "/+$", "")
    return (host(child) == host(parent)) & part(child, 5).startswith(F.concat(at, F.lit("/"))) & (F.length(part(child, 5)) > F.length(at) + 1)


def trunk(url: Column) -> Column:
    """The path without slashes at its end."""
    return F.regexp_replace(part(url, 5), "/+$", "")


def trunks_above(url: Column) -> Column:
    """Every part of the path in front of a slash that something follows: the trunks of those that :func:`is_prefix_child` takes for parents."""
    path = part(url, 5)
    segments = F.split(path, "/")
    fronts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments) - 1, F.lit(1))), lambda k: F.array_join(F.slice(segments, 1, k), "/"))
    return F.when(path.contains("/"), F.filter(fronts, lambda x: F.length(path) > F.length(x) + 1))


def is_query_child(child: Column, parent: Column) -> Column:
    """Same host and path, another query that isn't empty."""
    return (host(child) == host(parent)) & (part(child, 5) == part(parent, 5)) & (part(child, 6) != "") & (part(child, 6) != part(parent, 6))


def drive_id(url: Column) -> Column:
    """A drive file id: after ``/d/``, or in ``id=``."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/d/([A-Za-z0-9_-]{10,})", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]{10,})", 1), F.lit("")))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf$", "")


def safe_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{M}\p{N}._-]+", "_"), r"^[._]+|[._]+$", "")


def slug(title: Column, most: int = 48) -> Column:
    """Lower-cased letters, digits and Myanmar, other runs as one hyphen, cut to ``most`` characters."""
    s = F.regexp_replace(F.lower(title), "[^a-z0-9က-႟]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(most)), "-+$", "")


def size_text(n: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB with one decimal."""
    v = n.cast("double")
    out = F.format_string("%.1f TB", v / 1024**4)
    for unit, k in (("GB", 3), ("MB", 2), ("KB", 1)):
        out = F.when(v < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", v / 1024**k)).otherwise(out)
    return F.when(v < 1024, F.format_string("%d B", n.cast("bigint"))).otherwise(out)


def paragraph_id(chapter: Column, index: Column, text: Column) -> Column:
    """``0012-003-<first 8 digits of the sha256>``."""
    return F.format_string("%04d-%03d-%s", chapter.cast("int"), index.cast("int"), F.left(F.sha2(text, 256), F.lit(8)))


def cache_key(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *fields), 256)


def is_token(name: Column) -> Column:
    """1 to 128 of ``[A-Za-z0-9._-]`` without two dots in a row."""
    return name.rlike(r"^[A-Za-z0-9._-]{1,128}$") & ~name.contains("..")


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.when(s >= 3600, F.format_string("%dh %dm", (s / 3600).cast("bigint"), F.pmod((s / 60).cast("bigint"), F.lit(60)))).otherwise(F.format_string("%dm", (s / 60).cast("bigint")))


# Agents that copy whole sites, and crawlers that are welcome.
DOWNLOADER_AGENT = r"(?i)(httrack|webcopier|cyotek|webcopy|teleport\s*pro|offline\s*explorer|webzip|sitesucker|website\s*downloader|webreaper|webstripper|getleft|pavuk|wpull|grab-site|httrack|wget|curl\/|libwww-perl|lwp::simple|python-requests|python-urllib|scrapy|go-http-client|okhttp|apache-httpclient|java\/\d|node-fetch|axios\/)"
FRIENDLY_AGENT = r"(?i)(googlebot|google-inspectiontool|bingbot|adidxbot|slurp|duckduckbot|baiduspider|yandexbot|applebot|facebookexternalhit|twitterbot|linkedinbot|discordbot|telegrambot|whatsapp|pinterestbot|ia_archiver|uptimerobot|pingdom)"


def is_downloader(agent: Column) -> Column:
    return F.coalesce(agent, F.lit("")).rlike(DOWNLOADER_AGENT)


def is_friendly(agent: Column) -> Column:
    return F.coalesce(agent, F.lit("")).rlike(FRIENDLY_AGENT)


def is_document_request(dest: Column, accept: Column) -> Column:
    """A navigation: by the destination where one is sent, else by what is accepted."""
    sent = F.lower(F.coalesce(dest, F.lit("")))
    return F.when(sent != "", sent == "document").otherwise(F.coalesce(accept, F.lit("")).contains("text/html"))


def pdf_offset(head: Column, window: int = 1024) -> Column:
    """Where a PDF's mark starts within its first bytes, from 0; null without one."""
    at = F.instr(F.left(head, F.lit(window)), "%PDF-")
    return F.when(at > 0, at - 1)


def exclusion(name: Column, families: dict[str, tuple[str, ...]]) -> Column:
    """The first family of domains that a host belongs to, null for none."""
    out = F.lit(None).cast("string")
    for family, domains in reversed(families.items()):
        found = F.lit(False)
        for d in domains:
            found = found | in_domain(name, d)
        out = F.when(found, family).otherwise(out)
    return out


def ranges_of(spec: Column) -> Column:
    """``"1-2,5"`` as ordered distinct numbers; a range that runs backwards is null as a whole."""
    parts = F.filter(F.split(F.regexp_replace(spec, " ", ""), ","), lambda p: p != "")
    low, high = (lambda p: F.get(F.split(p, "-"), F.lit(0)).try_cast("int")), (lambda p: F.element_at(F.split(p, "-"), -1).try_cast("int"))
    return F.when(F.forall(parts, lambda p: low(p) <= high(p)), F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p))))))
