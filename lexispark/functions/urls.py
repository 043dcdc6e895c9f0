"""Addresses of pages: their parts, and references resolved against them (RFC 3986), as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, authority (with its slashes), path, query (with its mark) of a reference without its fragment.
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?]*)?([^?]*)(\?.*)?$"
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(without_fragment(url), PARTS, k)


def host(url: Column) -> Column:
    """The host in lower case, without its port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def without_dots(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` segments."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda s, x: F.when(x == ".", s).when(
            x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
        ).otherwise(F.array_append(s, x))
    )
    end = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    whole = F.concat(F.lit("/"), F.array_join(kept, "/"), end)
    return F.regexp_replace(whole, "^//$", "/")


def resolve(base: Column, reference: Column) -> Column:
    """The address that a reference on a page means, without its fragment; null where either has none."""
    ref = F.trim(reference)
    scheme, authority, path, query = (_part(ref, k) for k in range(1, 5))
    b_scheme, b_authority, b_path, b_query = (_part(base, k) for k in range(1, 5))
    merged = F.concat(F.regexp_replace(F.when(b_path == "", "/").otherwise(b_path), r"[^/]*$", ""), path)
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(merged)
    return (
        F.when(base.isNull() | reference.isNull(), None)
        .when(scheme != "", F.concat(scheme, authority, F.when(authority != "", without_dots(path)).otherwise(path), query))
        .when(authority != "", F.concat(b_scheme, authority, without_dots(path), query))
        .when(path != "", F.concat(b_scheme, b_authority, without_dots(full), query))
        .otherwise(F.concat(b_scheme, b_authority, b_path, F.when(query != "", query).otherwise(b_query)))
    )


def references(html: Column) -> Column:
    """What the anchors of a page refer to, as it stands there, in order; ``&amp;`` is decoded."""
    quoted = [F.regexp_extract_all(html, F.lit(HREF), F.lit(k)) for k in (1, 2, 3)]  # one of the three is not empty
    both = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), quoted)
    return F.transform(both, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
