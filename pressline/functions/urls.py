"""URL references as expressions: joining, dot segments, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, authority, path, query and fragment of a reference.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, f"(?s){PARTS}", group)


def without_dots(path: Column) -> Column:
    """The path with . and .. segments resolved; .. above the root is dropped."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    start = F.slice(segments, 1, 1)

    def step(done: Column, s: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(s == "..", up).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    kept = F.aggregate(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), start, step)
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(segments) > 1), "/").otherwise(""))


def join_url(base: Column, reference: Column) -> Column:
    """The absolute form of a reference on a page, by the rules of RFC 3986; null where the
    reference is null. ``base`` is an absolute http(s) URL."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path, query = part(base, 3), part(base, 4)
    rest = F.concat(part(reference, 4), part(reference, 5))
    own = part(reference, 3)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    return (
        F.when(part(reference, 1) != "", reference)
        .when(reference.startswith("//"), F.concat(part(base, 1), F.lit(":"), reference))
        .when(reference == "", base)
        .when((own == "") & (part(reference, 4) == ""), F.concat(root, path, query, rest))
        .when(own == "", F.concat(root, path, rest))
        .when(own.startswith("/"), F.concat(root, without_dots(own), rest))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest))
    )


def canonical_url(url: Column) -> Column:
    """Scheme, lower-cased authority and path with one closing slash; no query or fragment."""
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.regexp_replace(part(url, 3), "/+$", ""), F.lit("/"))


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#]"), F.lit(False))
