"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesieve.functions.text import let

# Second-last labels that belong to the registry, not the owner.
REGISTRY_LABELS = ("co", "com", "gov", "org", "net", "ac", "edu")

# Page prefixes that are never scanned.
PROTECTED_PREFIXES = (
    "https://chrome.google.com/webstore",
    "https://chromewebstore.google.com/",
    "https://addons.mozilla.org",
)

# Groups: scheme, user info, host, port, path, query, fragment.
_HTTP = r"(?i)^(https?):[/\\]*((?:[^/\\?#@]*@)?)(\[[^\]]*\]|[^/\\?#:]*)(:[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?\z"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _HTTP, group)


def url_host(url: Column) -> Column:
    """Host of an http(s) URL in lower case, '' for anything else."""
    return F.lower(_part(url, 3))


def url_scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def _authority(url: Column, user: bool) -> Column:
    port = F.concat(url_scheme(url), _part(url, 4))
    port = F.regexp_replace(port, r"^http:80\z|^https:443\z|^https?:?\z|^https?(?=:)", "")
    return F.concat(url_scheme(url), F.lit("://"), *([_part(url, 2)] if user else []), url_host(url), port)


def url_origin(url: Column) -> Column:
    """scheme://host[:port] without the default port."""
    return _authority(url, user=False)


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    def step(acc: Column, seg: Column) -> Column:
        up = seg.rlike(r"(?i)^(?:\.|%2e){2}\z")
        here = seg.rlike(r"(?i)^(?:\.|%2e)\z")
        shorter = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - F.lit(1), F.lit(1)))
        return F.when(up, shorter).when(here, acc).otherwise(F.concat(acc, F.array(seg)))

    def fold(p: Column) -> Column:
        kept = F.aggregate(F.split(p, "/", -1), F.array().cast("array<string>"), step)
        # A path that ends in a dot segment names a folder.
        tail = F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}\z"), F.lit("/")).otherwise(F.lit(""))
        joined = F.concat(F.array_join(kept, "/"), tail)
        return F.when(p.rlike(r"(?i)/(?:\.|%2e)"), F.regexp_replace(joined, r"^\z", "/")).otherwise(p)

    return let(path, fold)


_PATH_CODES = ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"), ("{", "%7B"), ("}", "%7D"))


def _encode(text: Column, codes: tuple[tuple[str, str], ...]) -> Column:
    for ch, code in codes:
        text = F.replace(text, F.lit(ch), F.lit(code))
    return text


def _clean(url: Column) -> Column:
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]", "")


def normalize_url(url: Column, keep_fragment: bool = False) -> Column:
    """Serialised form of an absolute http(s) URL, null when it is none."""
    def build(u: Column) -> Column:
        path = F.regexp_replace(F.translate(_part(u, 5), "\\", "/"), r"^\z", "/")
        pieces = [_authority(u, user=True), _encode(_fold_dots(path), _PATH_CODES), _encode(_part(u, 6), _PATH_CODES[:4])]
        if keep_fragment:
            pieces.append(_encode(_part(u, 7), _PATH_CODES[:5]))
        return F.when(_part(u, 3) != "", F.concat(*pieces))

    return let(_clean(url), build)


def resolve_url(ref: Column, base: Column, keep_fragment: bool = False) -> Column:
    """Absolute http(s) URL that ``ref`` means on the page ``base``, else null."""
    def absolute(r: Column) -> Column:
        def on(b: Column) -> Column:
            path = _part(b, 5)
            folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
            folder = F.when(folder == "", F.lit("/")).otherwise(folder)
            page = F.concat(_authority(b, user=True), F.when(path == "", F.lit("/")).otherwise(path))
            return (
                F.when(r.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), r)
                .when(r.rlike(r"^[/\\]{2}"), F.concat(url_scheme(b), F.lit(":"), r))
                .when(r.rlike(r"^[/\\]"), F.concat(_authority(b, user=True), r))
                .when(r == "", F.concat(page, _part(b, 6)))
                .when(r.startswith("?"), F.concat(page, r))
                .when(r.startswith("#"), F.concat(page, _part(b, 6), r))
                .otherwise(F.concat(_authority(b, user=True), folder, r))
            )

        return let(base, on)

    return normalize_url(let(_clean(ref), absolute), keep_fragment)


def is_ipv4(host: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return host.rlike(rf"^{octet}(?:\.{octet}){{3}}\z")


def base_domain(host: Column) -> Column:
    """Registrable part of a host by a short list of registry labels; null for IPv4."""
    labels = F.split(host, r"\.", -1)
    second_last = F.try_element_at(labels, F.lit(-2))
    keep = F.when(second_last.isin(*REGISTRY_LABELS), 3).otherwise(2)
    cut = F.substring_index(host, ".", -3)
    return (
        F.when(is_ipv4(host), F.lit(None).cast("string"))
        .when(F.size(labels) <= 2, host)
        .when(keep == 3, cut)
        .otherwise(F.substring_index(host, ".", -2))
    )


def current_hostname(host: Column) -> Column:
    return F.when(~is_ipv4(host), host)


def is_scannable(url: Column) -> Column:
    """A web page outside the protected stores; null URLs are not scannable."""
    keep = url.startswith("http")
    for prefix in PROTECTED_PREFIXES:
        keep = keep & ~url.startswith(prefix)
    return F.coalesce(keep, F.lit(False))


def report_name(url: Column) -> Column:
    """File name of a page's report."""
    def name(plain: Column) -> Column:
        path = F.regexp_replace(plain, r"^https?://[^/]*/?|/?(?:\?.*)?\z", "")
        return F.concat(
            F.lit("recon_"), url_host(plain),
            F.regexp_replace(F.translate(path, "/", "_"), r"^(?=.)", "_"), F.lit(".json"))

    return F.coalesce(let(normalize_url(url), name), F.lit("recon_scan_results.json"))
