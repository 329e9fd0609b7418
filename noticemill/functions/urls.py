"""URL policy as columns; nothing is ever fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import java, let, matches

# Public host suffixes and hosts accepted as official.
OFFICIAL_SUFFIXES = [".gov.in", ".nic.in"]
OFFICIAL_HOSTS = [
    "aiimsbathinda.edu.in",
    "aiimsbilaspur.edu.in",
    "bfuhsonline.ac.in",
    "gmcpatiala.edu.in",
    "gmc.edu.in",
    "slbsgmchmandi.com",
    "pgimer.edu.in",
    "rpgmc.ac.in",
    "igmcshimla.edu.in",
]
DOCUMENT_LINK = r"\.(?:pdf|xlsx?)(?:$|\?)"
SESSION_COMPONENT = r"docDownoad|DirectLink_(?:1|9)$"

_CANONICAL = r"^https?://[a-z0-9.\-]+/(?!.*/\.{1,2}/)[^ ]*$"
_ABSOLUTE = r"^(?i)[a-z][a-z0-9+.\-]*:"
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.nullif(F.lower(_part(url, 1)), F.lit(""))


def authority(url: Column) -> Column:
    return _part(url, 2)


def host(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(authority(url), r"^[^@]*@", ""), r":\d*$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(authority(url), r":(\d+)$", 1), F.lit("")).try_cast("int")


def path(url: Column) -> Column:
    p = _part(url, 3)
    return F.when(host(url).isNotNull(), F.when(p == "", F.lit("/")).otherwise(p))


def query(url: Column) -> Column:
    """Query text without the question mark; empty when absent."""
    return F.regexp_replace(_part(url, 4), r"^\?", "")


def parameter(url: Column, name: str) -> Column:
    """First value of a query parameter, NULL when the parameter is absent."""
    value = F.regexp_extract(query(url), rf"(?:^|&){name}=([^&]*)", 1)
    return F.when(
        query(url).rlike(rf"(?:^|&){name}="), let(value, lambda v: F.coalesce(F.try_url_decode(v), v))
    )


def has_credentials(url: Column) -> Column:
    return F.contains(authority(url), F.lit("@"))


def absolute(href: Column, base: Column) -> Column:
    """Resolve a link against its page."""

    def resolve(link: Column, page: Column) -> Column:
        root = F.concat(scheme(page), F.lit("://"), authority(page))
        folder = F.regexp_replace(path(page), r"[^/]*$", "")
        return (
            F.when(link.rlike(_ABSOLUTE), link)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme(page), F.lit(":"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(root, link))
            .when(F.startswith(link, F.lit("?")), F.concat(root, path(page), link))
            .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(page, "#.*$", ""), link))
            .when(link == "", page)
            .otherwise(F.concat(root, folder, link))
        )

    return canonical(let(base, lambda page: let(F.trim(href), lambda link: resolve(link, page))))


def canonical(url: Column) -> Column:
    """Lower case scheme and host, default port dropped, spaces encoded, ``.`` steps removed."""

    def build(u: Column) -> Column:
        p = F.regexp_replace(F.regexp_replace(path(u), r"/\./", "/"), r"/[^/]+/\.\./", "/")
        number = port(u)
        standard = F.coalesce((scheme(u) == "https") & (number == 443), F.lit(False))
        shown_port = F.when(
            number.isNotNull() & ~standard, F.concat(F.lit(":"), number.cast("string"))
        ).otherwise("")
        user = F.regexp_extract(authority(u), r"^([^@]*@)", 1)
        built = F.concat(scheme(u), F.lit("://"), user, host(u), shown_port, p, _part(u, 4), _part(u, 5))
        # Most links are canonical already; one pattern settles them.
        return (
            F.when(u.rlike(_CANONICAL), u)
            .when(host(u).isNotNull(), F.replace(built, F.lit(" "), F.lit("%20")))
            .otherwise(u)
        )

    return let(url, build)


def _allowed_host(h: Column, suffixes: list[str], hosts: list[str]) -> Column:
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | F.endswith(h, F.lit(s))
    for name in hosts:
        ok = ok | (h == name) | F.endswith(h, F.lit("." + name))
    return F.coalesce(ok, F.lit(False))


def official_url(
    url: Column,
    base: Column | None = None,
    suffixes: list[str] = OFFICIAL_SUFFIXES,
    hosts: list[str] = OFFICIAL_HOSTS,
) -> Column:
    """The absolute URL if it is https on an allowed host without credentials, else NULL."""

    def check(full: Column) -> Column:
        ok = (
            (scheme(full) == "https")
            & ~has_credentials(full)
            & (port(full).isNull() | (port(full) == 443))
            & let(host(full), lambda h: _allowed_host(h, suffixes, hosts))
        )
        return F.when(ok, full)

    return let(canonical(url) if base is None else absolute(url, base), check)


def public_link(
    url: Column, suffixes: list[str] = OFFICIAL_SUFFIXES, hosts: list[str] = OFFICIAL_HOSTS
) -> Column:
    """An official link that stays valid outside a session; local document routes pass."""
    local = matches(url, r"^\/api\/documents\/bfuhs\/\d+$", "")

    def check(full: Column) -> Column:
        sessionless = parameter(full, "session").isNull() & ~matches(
            F.coalesce(parameter(full, "component"), F.lit("")), SESSION_COMPONENT, ""
        )
        return F.when(full.isNotNull() & sessionless, full)

    return F.when(local, url).otherwise(let(official_url(url, None, suffixes, hosts), check))


def without_session(url: Column) -> Column:
    """Drop the ``session`` parameter and any ``;jsessionid`` path part."""
    no_path = F.regexp_replace(url, r"(?i);jsessionid=[^/?#]+", "")
    middle = F.regexp_replace(no_path, r"([?&])session=[^&#]*&", "$1")
    return F.regexp_replace(middle, r"[?&]session=[^&#]*(?=#|$)", "")


def specific_document(url: Column) -> Column:
    """True when a URL names one document or one record rather than a listing."""
    keys = matches(query(url), r"(?:^|&)(?:bidid|bid_id|tenderid|tender_id)(?:=|&|$)")
    return F.coalesce(
        host(url).isNotNull()
        & (
            matches(path(url), r"\.pdf$")
            | keys
            | matches(path(url), r"\/(?:tender|bid|detail)\/[^/]+$")
        ),
        F.lit(False),
    )


def document_link(url: Column) -> Column:
    return matches(url, DOCUMENT_LINK)


def web_reference(url: Column, base: Column, max_length: int = 2500) -> Column:
    """Any http(s) link without credentials up to a length, resolved against a base."""
    return let(
        absolute(url, base),
        lambda full: F.when(
            scheme(full).isin("http", "https") & ~has_credentials(full) & (F.length(full) <= max_length), full
        ),
    )
