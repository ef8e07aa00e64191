"""URL columns: the safe-link gate, hosts, and resolving a link against its page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, let, trim

_ABSOLUTE = r"^(?i)(https?):/*([^/?#\\]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def safe_http_url(col: Column) -> Column:
    """Canonical http(s) URL, or null: nothing else may become a link."""

    def canonical(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, _ABSOLUTE, i)
        address = F.regexp_replace(
            F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2))), "^(http://[^:]*):80$|^(https://[^:]*):443$", "$1$2"
        )
        path_ = F.regexp_replace(part(3), "^$", "/")
        ok = text.rlike(_ABSOLUTE) & ~part(2).rlike(r"[\s<>^|%\[\]]")
        return F.when(ok, F.replace(F.concat(address, path_, part(4), part(5)), F.lit(" "), F.lit("%20")))

    return let(trim(col), canonical)


def safe_href(col: Column) -> Column:
    return F.coalesce(safe_http_url(col), F.lit("#"))


def host(col: Column) -> Column:
    return F.lower(F.regexp_extract(col, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def bare_host(col: Column) -> Column:
    return F.regexp_replace(host(col), r"^www\.", "")


def host_label(col: Column) -> Column:
    return F.replace(first_label(col), F.lit("-"), F.lit(""))


def first_label(col: Column) -> Column:
    return F.split_part(bare_host(col), F.lit("."), F.lit(1))


def path(col: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(col, r"^(?i)https?://[^/?#]+([^?#]*)", 1), "^$", "/")


def query(col: Column) -> Column:
    return F.regexp_extract(col, r"^[^?#]*(\?[^#]*)", 1)


def origin(col: Column) -> Column:
    return F.lower(F.regexp_extract(col, r"^(?i)(https?://[^/?#]+)", 1))


def _tidy_path(p: Column) -> Column:
    """Resolve '.' and '..' segments."""

    def walk(x: Column) -> Column:
        kept = F.aggregate(
            F.split(F.substr(x, F.lit(2)), "/", -1),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.array_append(acc, s)),
        )
        tail = F.when(x.rlike(r"/\.\.?$"), "/").otherwise("")
        return F.when(x.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(x)

    return let(p, walk)


def resolve(href: Column, page: Column) -> Column:
    """Absolute http(s) form of a link found on ``page``; null for any other scheme."""

    def absolute(h: Column) -> Column:
        before = F.regexp_extract(h, r"^([^?#]*)", 1)
        after = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
        folder = F.regexp_extract(path(page), r"^(.*/)", 1)
        relative = F.when(F.startswith(h, F.lit("/")), before).otherwise(F.concat(folder, before))
        return (
            F.when(h.rlike(r"^(?i)https?:"), h)
            .when(h.rlike(r"^//"), F.concat(F.regexp_extract(page, r"^(?i)(https?:)", 1), h))
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(h.rlike(r"^\?"), F.concat(origin(page), path(page), h))
            .when(h.rlike("^#|^$"), F.concat(origin(page), path(page), query(page), h))
            .otherwise(F.concat(origin(page), _tidy_path(relative), after))
        )

    return safe_http_url(let(trim(href), absolute))


def without_fragment(col: Column) -> Column:
    return F.regexp_replace(col, "#.*$", "")


def quote(col: Column) -> Column:
    """Percent-encode one path segment (spaces as %20)."""
    return F.replace(F.url_encode(col), F.lit("+"), F.lit("%20"))


def nullable_host(col: Column) -> Column:
    return blank_to_null(host(col))
