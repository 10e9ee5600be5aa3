"""Text, URL and language expressions; all but compatibility composition stay in the JVM."""

from __future__ import annotations

import json
import unicodedata
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MEANINGFUL = r"[A-Za-z0-9一-鿿]"
#: White space of Unicode and the separators among the control characters (fixed values).
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.trim(x, F.lit(BLANKS))


def let(x: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


#: Names of character references that texts of records hold (fixed values).
COMMON = (
    "amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "trade", "hellip", "mdash", "ndash", "lsquo", "rsquo", "sbquo", "ldquo", "rdquo", "bdquo", "laquo", "raquo",
    "bull", "middot", "euro", "pound", "yen", "cent", "sect", "para", "deg", "times", "divide", "plusmn", "frac12", "larr", "rarr", "ensp", "emsp", "thinsp", "zwnj", "zwj", "shy",
)
#: Numbers below 160 that stand for something else than themselves, by the rules of HTML.
_ODD = json.dumps({str(n): unescape(f"&#{n};") for n in range(160) if unescape(f"&#{n};") != chr(n)})
_PIECE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)|[^&]+|&"


def _by_number(n: Column) -> Column:
    """The character of a code point in decimal text; of an illegal one what HTML says."""
    odd = F.from_json(F.lit(_ODD), "map<string,string>")
    cp = F.when(F.length(F.ltrim(n, F.lit("0"))) > 9, F.lit(0x110000).cast("long")).otherwise(n.cast("long"))
    wrong = lambda c: c.between(0xD800, 0xDFFF) | (c > 0x10FFFF)
    none = lambda c: c.between(0xFDD0, 0xFDEF) | (c.bitwiseAND(F.lit(0xFFFE).cast("long")) == 0xFFFE)
    plain = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    return let(cp, lambda c: F.coalesce(F.try_element_at(odd, c.cast("string")), F.when(wrong(c), "\ufffd").when(none(c), "").otherwise(plain(c))))


def unescaped(x: Column, names: dict[str, str] = html5) -> Column:
    """Character references of HTML resolved: by number, by name, and the old names that go
    without a semicolon, of which the longest counts. Texts without & are left alone. The
    table of all names is large: it belongs on a column, not inside a larger expression."""
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    lengths = sorted({len(n) for n in names if not n.endswith(";")}, reverse=True)

    def by_name(p: Column) -> Column:
        name = F.substring(p, 2, 64)
        cut = [F.struct(name.alias("n"), F.lit("").alias("rest")), *(F.struct(F.when(F.length(name) >= n, F.substring(name, 1, n)).alias("n"), F.substr(name, F.lit(n + 1)).alias("rest")) for n in lengths)]
        found = F.transform(F.filter(F.array(*cut), lambda c: c["n"].isNotNull()), lambda c: F.concat(F.try_element_at(table, c["n"]), c["rest"]))
        return F.coalesce(F.get(F.array_compact(found), F.lit(0)), p)

    def one(p: Column) -> Column:
        digits, hexed = F.regexp_extract(p, r"^&#([0-9]+)", 1), F.regexp_extract(p, r"^&#[xX]0*([0-9a-fA-F]+)", 1)
        number = F.when(digits != "", digits).when(F.length(hexed) > 8, F.lit("9999999")).otherwise(F.conv(hexed, 16, 10))
        return F.when(~p.startswith("&") | (F.length(p) < 2), p).when(p.startswith("&#"), _by_number(number)).otherwise(by_name(p))

    return let(x, lambda v: F.when(F.contains(v, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(v, F.lit(_PIECE), F.lit(0)), one), "")).otherwise(v))


_SHORT = {n: html5[n] for c in COMMON for n in (f"{c};", c) if n in html5}


def clean_text(x: Column) -> Column:
    """References by number and by the common names resolved, NULs dropped, blanks other
    than line feeds collapsed, trimmed. Pages, which may hold any reference, are read by a parser."""
    return strip(F.regexp_replace(F.regexp_replace(unescaped(x, _SHORT), r"\x00", ""), r"[ \t\r\f\x0B]+", " "))


#: Characters whose case folding is not their lower case, by the Unicode tables of Python.
FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x110000)) if c.casefold() != c.lower()}


def casefold(x: Column) -> Column:
    """Full case folding, as for comparisons without regard to case. Most texts are all
    ASCII or have none of the few characters that lower case does not fold."""
    odd = f"[{''.join(FOLDED)}]"
    single = {c: f for c, f in FOLDED.items() if len(f) == 1}

    def fold(v: Column) -> Column:
        out = F.translate(v, "".join(single), "".join(single.values()))
        for c, f in FOLDED.items():
            if len(f) > 1:
                out = F.replace(out, F.lit(c), F.lit(f))
        return F.when((F.octet_length(v) > F.char_length(v)) & v.rlike(odd), F.lower(out)).otherwise(F.lower(v))

    return let(x, fold)


@F.pandas_udf(ArrayType(StringType()))
def _compatible(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in xs])


def compatible(names: Column) -> Column:
    """Compatibility composition (NFKC) of each text of an array. Only arrays that hold
    anything but ASCII leave the JVM, in Arrow batches."""
    plain = F.forall(names, lambda x: F.coalesce(F.octet_length(x) == F.char_length(x), F.lit(True)))
    return F.when(plain, names).otherwise(_compatible(F.when(~plain, names)))


def word_set(x: Column) -> Column:
    """Distinct lower-cased latin words and single Han characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9]+|[一-鿿])"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats."""
    return shared_share(F.size(a), F.size(b), F.size(F.array_intersect(a, b)))


def shared_share(n: Column, m: Column, shared: Column) -> Column:
    return F.when(n + m > 0, shared / (n + m - shared)).otherwise(0.0)


def meaningful_chars(x: Column) -> Column:
    return F.regexp_count(x, F.lit(MEANINGFUL))


def detect_language(x: Column) -> Column:
    visible = F.regexp_count(x, F.lit(r"(?U)\S"))
    han = F.regexp_count(x, F.lit(r"[一-鿿]"))
    return F.when(F.coalesce(visible, F.lit(0)) == 0, "unknown").when(han / visible >= 0.1, "zh-CN").otherwise("en")


def first_line(x: Column) -> Column:
    """First line with text, blanks collapsed."""
    lines = F.filter(F.transform(F.split(x, r"\r\n|[\n\r]"), lambda v: strip(F.regexp_replace(v, r"(?U)\s+", " "))), lambda v: v != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def clip(x: Column, n: int) -> Column:
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, n - 1)), F.lit("…")))


def display_title(native: Column, author: Column, text: Column, n: int = 500) -> Column:
    """The native title, else author and first line, else either; clipped."""
    name, line, own = strip(F.coalesce(author, F.lit(""))), first_line(F.coalesce(text, F.lit(""))), strip(F.coalesce(native, F.lit("")))
    value = F.when(own != "", own).when((name != "") & (line != ""), F.concat(name, F.lit("："), line)).otherwise(F.concat(name, line))
    return F.when(value != "", clip(value, n))


def evidence_gate(title: Column, text: Column, has_preview: Column, least: int = 12) -> Column:
    n = meaningful_chars(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    return F.when((n < least) & ~has_preview, "insufficient_evidence").otherwise("process")


def repost_evidence(text: Column) -> Column:
    t = F.ltrim(text)
    return t.rlike(r"(?i)^RT\s+@[A-Z0-9_]+\s*:") | t.rlike(r"(?:^|\n)转发自\s+@")


def strip_handle(author: Column) -> Column:
    return F.regexp_replace(author, r"\s+\(@[^()]+\)$", "")


def key_token(x: Column) -> Column:
    """Case-folded word key, other characters as single dashes, at most 80 long."""
    return F.substring(F.regexp_replace(F.regexp_replace(casefold(F.trim(x)), r"(?U)[^\w]+", "-"), r"^-+|-+$", ""), 1, 80)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def upstream_url(url: Column) -> Column:
    """https, lower-cased host and path without a closing slash; null for other schemes."""
    path = F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), r"/+$", "")
    return F.when(host(url) != "", F.concat(F.lit("https://"), host(url), path))


def classification_url(url: Column) -> Column:
    """Scheme, authority and path; null for other schemes and for URLs with user info."""
    ok = url.rlike(r"^https?://[^/?#@]+(?:[/?#]|$)")
    return F.when(ok, F.regexp_extract(url, r"^(https?://[^/?#]+[^?#]*)", 1))


def mime_of(url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, r"^([^?#]*)", 1))
    out = F.lit(None).cast("string")
    for ending, mime in ((".png", "image/png"), (".gif", "image/gif"), (".webp", "image/webp"), (".jpg", "image/jpeg"), (".jpeg", "image/jpeg")):
        out = F.when(path.endswith(ending), mime).otherwise(out)
    return out


def backoff_seconds(attempt: Column, table: tuple[int, ...] = (30, 120, 600)) -> Column:
    return F.element_at(F.array(*map(F.lit, table)), F.greatest(F.lit(1), F.least(attempt.cast("int"), F.lit(len(table)))))
