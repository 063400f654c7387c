"""File names, ids and configuration strings as column expressions (SC1, F-S1-F-S8)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_matches(name: Column, contains: list[str] = (), excludes: list[str] = ()) -> Column:
    """SC1: the name holds all of `contains` and none of `excludes`, case-sensitively."""
    out = F.lit(True)
    for x in contains:
        out = out & F.contains(name, F.lit(x))
    for x in excludes:
        out = out & ~F.contains(name, F.lit(x))
    return out


def split_filename(path: Column) -> tuple[Column, Column, Column]:
    """F-S3: (folder, base, extension); .nii.gz and .tar.gz are one extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    folder = F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"(?<=.)/$", "")
    ext = F.regexp_extract(name, r"(?i)(\.nii\.gz|\.tar\.gz|\.[^.]+)$", 1)
    return folder, F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext


def subject_ids(filename: Column, keywords: list[str]) -> Column:
    """F-S1: candidates for the subject id: the base name split on the keywords, without other than word characters,
    blanks dropped; if several parts are left, their concatenation comes last."""
    _, base, _ = split_filename(filename)
    pattern = "|".join(re.escape(k) for k in keywords) or r"(?!)"
    parts = F.filter(F.transform(F.split(base, pattern), lambda x: F.regexp_replace(x, r"\W+", "")), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.concat(parts, F.array(F.array_join(parts, "")))).otherwise(parts)


def remove_from_id(filename: Column, pattern: str) -> Column:
    """F-S2: the base name without what the pattern matches."""
    return F.regexp_replace(split_filename(filename)[1], pattern, "")


def damerau_levenshtein(a: Column, b: Column) -> Column:
    """F-S4: restricted edit distance (insert, delete, replace, swap of neighbours), by rows of the table in one fold."""
    n = F.length(b)
    zero = F.sequence(F.lit(0), n)
    start = F.struct(F.array().cast("array<int>").alias("p"), zero.cast("array<int>").alias("r"))

    def row(acc: Column, i: Column) -> Column:
        def cell(out: Column, j: Column) -> Column:
            same = F.substring(a, i, 1) == F.substring(b, j, 1)
            swap = (i > 1) & (j > 1) & (F.substring(a, i, 1) == F.substring(b, j - 1, 1)) & (F.substring(a, i - 1, 1) == F.substring(b, j, 1))
            plain = F.least(F.get(acc["r"], j) + 1, F.element_at(out, -1) + 1, F.get(acc["r"], j - 1) + F.when(same, 0).otherwise(1))
            best = F.when(swap, F.least(plain, F.get(acc["p"], j - 2) + 1)).otherwise(plain)
            return F.concat(out, F.array(best.cast("int")))

        first = F.array(i.cast("int"))
        columns = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.struct(acc["r"].alias("p"), F.aggregate(columns, first, cell).alias("r"))

    rows = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rows, start, row, lambda s: F.element_at(s["r"], -1))


def standard_name(text: Column) -> Column:
    """F-S6: trimmed, only letters, digits, _, - and blanks left."""
    return F.regexp_replace(F.trim(text), r"[^0-9a-zA-Z_\- ]+", "")


def parse_array(text: Column, kind: str) -> Column:
    """F-S7: the values of (a,b), {a,b} or a,b; null where a value is no `kind`."""
    inner = F.regexp_replace(F.trim(text), r"^[({]|[)}]$", "")
    return F.transform(F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.try_cast(kind))


def parse_bool(text: Column) -> Column:
    """F-S8: yes/true/t/y/1 and no/false/f/n/0, whatever the case; null otherwise."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False)
