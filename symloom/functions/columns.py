"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key64(text: Column) -> Column:
    """A positive 60-bit key of a string that any SQL engine can compute."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Up to the last slash; '' without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The base name up to its last dot (a leading dot starts no suffix)."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last dot of the base name and what follows; '' without one."""
    return F.regexp_extract(basename(path), r".(\.[^.]*)$", 1)


def without_dots(path: Column) -> Column:
    """A path without `.` and `..` pieces; a `..` beyond the root is dropped, one beyond the
    beginning of a relative path stays."""
    rooted = path.startswith("/")

    def step(held: Column, piece: Column) -> Column:
        up = (piece == "..") & (F.size(held) > 0) & (F.coalesce(F.element_at(held, -1), F.lit("")) != "..")
        return F.when((piece == "") | (piece == ".") | ((piece == "..") & rooted & (F.size(held) == 0)), held).when(up, F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(piece)))

    plain = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    # Most paths have no such pieces.
    return F.when(path.rlike(r"(^|/)\.{0,2}(/|$)"), F.concat(F.when(rooted, "/").otherwise(""), plain)).otherwise(path)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    places = F.sequence(F.lit(1), n)
    first = F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(first, F.lit(0)) - 1, n))


def glob_regex(pattern: Column) -> Column:
    """A glob as an anchored regular expression: `**/` any directories, `**` anything, `*` and
    `?` within one directory."""
    out = F.regexp_replace(pattern, r"([.+^$(){}|\[\]\\])", r"\\$1")
    for found, put in ((r"\*\*/", "\x01"), (r"\*\*", "\x02"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", ".*")):
        out = F.regexp_replace(out, found, put)
    return F.concat(F.lit("^"), out, F.lit("$"))


def percentile_floor(values: Column, p: float) -> Column:
    """Of a sorted array: the element at floor(p * (n - 1)), or null for none."""
    return F.get(values, F.floor(F.lit(p) * (F.size(values) - 1)).cast("int"))
