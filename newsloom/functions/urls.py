"""URL expressions: one core, five sets of rules.

All functions take and return Columns; nulls stay null. A blank URL is ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that each normalisation drops.
TRACKING = {
    "collector": ("from", "utm_source", "utm_medium", "utm_campaign", "utm_content", "fbclid", "gclid"),
    "candidate": ("from", "utm_source", "utm_medium", "utm_campaign", "utm_content", "fbclid", "gclid", "utm_term", "ref", "source"),
    "event": ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "gclid"),
    # beside every key that begins with utm_
    "newsletter": (
        "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "mkt_tok", "vero_id", "oly_anon_id", "oly_enc_id", "sr_share", "ncid", "ocid",
        "ref", "ref_", "source", "campaign", "trk", "tracking_id", "from",
    ),
}

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, index: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; '' if there is none."""
    return F.regexp_extract(F.trim(url), _PARTS, index)


def host(url: Column) -> Column:
    """Lower-cased host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def domain(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def kept_query(url: Column, drop: tuple[str, ...]) -> Column:
    """Query pairs with a value, sorted, without the dropped keys."""
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p.rlike("^[^=]+=.+$") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*drop))
    return F.array_join(F.array_sort(pairs), "&")


def _join(base: Column, query: Column) -> Column:
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def collector_url(url: Column) -> Column:
    """Scheme, authority and path lower-cased, no trailing slash, no fragment, tracking keys dropped."""
    base = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.regexp_replace(F.lower(part(url, 3)), "/+$", ""))
    return F.when(part(url, 1) == "", F.lower(F.trim(url))).otherwise(_join(base, kept_query(url, TRACKING["collector"])))


def candidate_url(url: Column) -> Column:
    """As above with more keys dropped, host without user and port, empty path as ``/``."""
    path = F.regexp_replace(F.lower(part(url, 3)), "/+$", "")
    base = F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), F.when(path == "", "/").otherwise(path))
    return F.when(part(url, 1) == "", F.lower(F.trim(url))).otherwise(_join(base, kept_query(url, TRACKING["candidate"])))


def event_url(url: Column) -> Column:
    """Path case and a root path kept."""
    path = F.when(part(url, 3) == "/", "/").otherwise(F.regexp_replace(part(url, 3), "/+$", ""))
    base = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path)
    return F.when(part(url, 1) == "", F.trim(url)).otherwise(_join(base, kept_query(url, TRACKING["event"])))


def newsletter_url(url: Column) -> Column:
    """https only, path lower-cased, ``utm_*`` and the newsletter keys dropped, pairs without a value kept; an unsafe link gives ''."""
    link = F.regexp_replace(F.trim(url), "^[<>\"']+|[<>\"']+$", "")
    name = lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1))
    pairs = F.filter(F.split(part(link, 4), "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING["newsletter"]))
    named = F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    path, port = F.lower(F.regexp_replace(part(link, 3), "/+$", "")), F.regexp_extract(part(link, 2), r":0*([1-9]\d*)$", 1)
    base = F.concat(F.lit("https://"), F.regexp_replace(host(link), r"\.+$", ""), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), F.when(path == "", "/").otherwise(path))
    return F.when(safe_url(link), _join(base, F.array_join(F.array_sort(named), "&"))).otherwise("")


def release_url(url: Column) -> Column:
    """Lower-cased, trailing slashes and ``utm_`` pairs removed by pattern."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"[?&]utm_[^&#]*", "")
    return F.regexp_replace(bare, "/+$", "")


def private_host(url: Column) -> Column:
    """Loopback, private, link-local, reserved and unspecified addresses, IPv6 ones too, odd numeric hosts, names of local zones."""
    h = F.regexp_replace(host(url), r"\.+$", "")
    mapped = F.regexp_extract(h, r"^\[::ffff:(\d+\.\d+\.\d+\.\d+)\]$", 1)

    def local(a: Column) -> Column:
        return a.rlike(r"^(0|10|127|24\d|25[0-5])\.") | a.rlike(r"^(192\.168|169\.254|198\.1[89])\.") | a.rlike(r"^172\.(1[6-9]|2\d|3[01])\.") | a.rlike(r"^(192\.0\.[02]|198\.51\.100|203\.0\.113)\.")

    v4 = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    odd = h.rlike(r"^(0x[0-9a-f]+|\d+)(\.(0x[0-9a-f]+|\d+))*$") & (~v4 | h.rlike(r"(^|\.)0\d"))
    public_v6 = h.rlike(r"^\[[23][0-9a-f]{3}:[0-9a-f:.]+\]$") & ~h.rlike(r"^\[2001:(0?db8|0{0,3}:|:)")
    v6 = h.startswith("[") & ~F.when(mapped != "", ~local(mapped)).otherwise(public_v6)
    return h.isin("localhost", "localhost.localdomain") | h.rlike(r"\.(local|localhost|internal)$") | (v4 & local(h)) | odd | v6 | h.contains("%")


def safe_url(url: Column) -> Column:
    """https, with a host, without credentials, not private."""
    return (F.lower(part(url, 1)) == "https") & (host(url) != "") & ~part(url, 2).contains("@") & ~private_host(url)


def allowed_host(url: Column, allowed: list[str]) -> Column:
    """The host is one of ``allowed`` or below one."""
    out = F.lit(False)
    for d in allowed:
        out = out | (host(url) == d) | host(url).endswith("." + d)
    return out


def identity_key(url: Column) -> Column:
    """Site and article number where a path ends in one, else the collector form."""
    number = F.regexp_extract(part(url, 3), r"/(\d{2,})/?$", 1)
    return F.when(number != "", F.concat(F.lit("id:"), domain(url), F.lit(":"), number)).otherwise(F.concat(F.lit("url:"), collector_url(url)))
