"""URL canonicalisation and builders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from resultloom.functions.text import strip

# Query keys that only track the reader.
TRACKING_KEYS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "fbclid",
    "gclid",
    "gclsrc",
    "dclid",
    "ref",
    "referrer",
    "source",
    "spm",
    "mtm_source",
    "mtm_medium",
    "mtm_campaign",
    "mtm_content",
    "igshid",
    "mc_cid",
    "mc_eid",
    "yclid",
    "_ga",
    "gbraid",
    "wbraid",
)

# scheme, authority (with its slashes), path, query
_PARTS = r"\A([A-Za-z][A-Za-z0-9+.\-]*):(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?"


def form_decode(text: Column) -> Column:
    """Decode form text; a percent sign that starts no escape stays itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def form_encode(text: Column) -> Column:
    """Form encoding that keeps ``~`` and escapes ``*``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def percent_encode(text: Column) -> Column:
    return F.replace(form_encode(text), F.lit("+"), F.lit("%20"))


def _in_domain(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain)


def _query(query: Column, host: Column) -> Column:
    tracking = F.array(*[F.lit(k) for k in TRACKING_KEYS])
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike(r"(?s)\A[^=]*=."))
    decoded = F.transform(
        pairs,
        lambda p: F.struct(
            form_decode(F.substring_index(p, "=", 1)).alias("k"),
            form_decode(F.regexp_extract(p, r"(?s)\A[^=]*=(.*)\z", 1)).alias("v"),
        ),
    )
    video = (host == "youtu.be") | _in_domain(host, "youtube.com")
    paper = _in_domain(host, "theguardian.com")
    kept = F.filter(
        decoded,
        lambda p: ~F.array_contains(tracking, F.lower(p["k"]))
        & F.when(video, p["k"] == "v").when(paper, p["k"] != "page").otherwise(F.lit(True)),
    )
    return F.array_join(
        F.transform(
            F.array_sort(kept),
            lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"])),
        ),
        "&",
    )


def canonical_url(url: Column) -> Column:
    """One spelling for every URL of the same page."""
    url = strip(url)
    web = url.rlike(r"\A(?i:https?):")
    scheme = F.lower(F.regexp_extract(url, _PARTS, 1))
    authority = F.lower(F.regexp_extract(url, _PARTS, 2))
    site = F.regexp_replace(F.substring(authority, 3, 1 << 20), r"\A.*@", "")
    port = F.regexp_extract(site, r":([0-9]+)\z", 1)
    host = F.regexp_replace(site, r":[0-9]+\z", "")
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    netloc = F.when(usual, host).otherwise(site)
    path = F.regexp_replace(F.regexp_extract(url, _PARTS, 3), "/{2,}", "/")
    path = F.when(path == "", "/").otherwise(F.regexp_replace(path, "(?<=.)/+\\z", ""))
    query = _query(F.regexp_extract(url, _PARTS, 4), host)
    rebuilt = F.concat(
        scheme, F.lit("://"), netloc, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    )
    return F.when(web, rebuilt).otherwise(F.lower(F.regexp_replace(url, r"#.*\z", "")))


def dedupe_key(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def post_url(permalink: Column, subreddit: Column, post_id: Column, url: Column) -> Column:
    """Discussion page of a post; the page it links to is never used."""
    base = "https://www.reddit.com"
    return (
        F.when(permalink.startswith("/"), F.concat(F.lit(base), permalink))
        .when(permalink != "", permalink)
        .when(
            (post_id != "") & (subreddit != ""),
            F.concat(F.lit(base + "/r/"), subreddit, F.lit("/comments/"), post_id, F.lit("/")),
        )
        .when(url.startswith(base + "/"), url)
    )


def article_url(title: Column, language: str) -> Column:
    return F.concat(
        F.lit(f"https://{language}.wikipedia.org/wiki/"),
        percent_encode(F.replace(title, F.lit(" "), F.lit("_"))),
    )


def bare_url(url: Column) -> Column:
    """An http(s) URL without query and fragment; anything else is null."""
    found = F.regexp_extract(url, r"\A(https?://[^/?#]+[^?#]*)", 1)
    return F.when(found != "", found)
