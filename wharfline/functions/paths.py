"""Archive paths and file names as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Directories whose weight is reported, names that some systems can't store, and the longest path in bytes.
HEAVY = ("node_modules", ".git", ".svn", ".hg")
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
LONGEST = 4096


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob: * and ? stay within a segment, ** spans segments; what a match holds is matched too."""
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = re.sub(r"\*\*|\*|\?|[^*?]+", lambda m: parts.get(m[0]) or re.escape(m[0]), glob.strip("/"))
    return rf"(?s)^{body}(?:/.*)?\z"


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether any glob takes the path or a directory above it."""
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def under(path: Column, roots: list[str]) -> Column:
    """Whether the path is one of the roots or below one."""
    out = F.lit(False)
    for root in roots:
        out = out | (path == root) | path.startswith(root.rstrip("/") + "/")
    return out


def problem(path: Column) -> Column:
    """Why a path can't be an archive entry, or null: empty, too_long, absolute, drive, control, backslash, segment (empty, . or ..)."""
    return (
        F.when(path == "", "empty")
        .when(F.octet_length(path) > LONGEST, "too_long")
        .when(path.startswith("/"), "absolute")
        .when(path.rlike("^[A-Za-z]:"), "drive")
        .when(path.rlike(r"[\x00-\x1f\x7f]"), "control")
        .when(F.contains(path, F.lit("\\")), "backslash")
        .when(path.rlike(r"(^|/)\.{0,2}(/|$)"), "segment")
    )


def unstorable(path: Column) -> Column:
    """The first segment that some systems can't store (reserved name, forbidden character, dot or space at its end), or null."""
    bad = F.filter(F.split(path, "/"), lambda s: s.rlike(RESERVED) | s.rlike(r'[<>:"|?*\\]') | s.rlike(r"[. ]$"))
    return F.when(F.size(bad) > 0, bad[0])


def heavy_root(path: Column) -> Column:
    """The outermost directory of a heavy kind above the path, or null."""
    names = "|".join(map(re.escape, HEAVY))
    found = F.regexp_extract(path, rf"^(.*?(?:^|/)(?:{names}))/", 1)
    return F.when(found != "", found)


@F.pandas_udf(T.StringType())
def _composed(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else unicodedata.normalize("NFC", p).lower(), na_action="ignore")


def path_key(path: Column) -> Column:
    """Composed Unicode, in lower case: equal keys may be one file where case doesn't count. All rows go through Python, which ``with_path_key`` spares those in ASCII."""
    plain = F.octet_length(path) == F.length(path)
    return F.coalesce(F.when(plain, F.lower(path)), _composed(F.when(~plain, path)))


def with_path_key(df: DataFrame, path: str, out: str) -> DataFrame:
    """df with ``path_key`` of a column as ``out``, null for null. Rows in ASCII stay in the JVM; the others, told apart by a filter, are composed in Python. A column named like ``out`` is replaced."""
    plain = F.coalesce(F.octet_length(path) == F.length(path), F.lit(True))
    return df.where(plain).withColumn(out, F.lower(path)).unionByName(df.where(~plain).withColumn(out, _composed(F.col(path))))


def target_key(path: Column, *, fold: bool = True, trim: bool = False) -> Column:
    """The key of a path on a target that folds case and composes (``fold``) or drops dots and spaces at the ends of segments (``trim``)."""
    out = F.regexp_replace(path, r"[. ]+(?=/|$)", "") if trim else path
    return path_key(out) if fold else out


def slug(url: Column, longest: int = 40) -> Column:
    """Host and path of an address as lower-case letters and digits joined by hyphens; "site" if nothing is left."""
    rest = F.regexp_replace(F.lower(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")), "[^a-z0-9]+", "-")
    short = F.trim(F.substring(F.regexp_replace(rest, "^-+|-+$", ""), 1, longest), F.lit("-"))
    return F.when(short == "", "site").otherwise(short)


def merged_globs(defaults: DataFrame, extra: DataFrame, glob: str) -> DataFrame:
    """glob: the patterns of both lists, trimmed of slashes and white space, each once; empty ones and nulls go."""
    both = defaults.select(glob).union(extra.select(glob))
    return both.select(F.btrim(F.col(glob), F.lit("/ \t\r\n")).alias(glob)).where(F.length(glob) > 0).distinct()
