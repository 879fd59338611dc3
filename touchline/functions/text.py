"""Name normalisation and similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Letters and digits with marks, and what is left of them without; all other characters come to the same with and without canonical decomposition.
_MARKED = {c: d[0] for c in map(chr, range(0x80, 0x10000)) for d in (unicodedata.normalize("NFD", c),) if d[0].isascii() and d[0].isalnum() and all("\u0300" <= x <= "\u036f" for x in d[1:])}


@F.pandas_udf(T.StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def _plain(decomposed: Column, dash: bool) -> Column:
    s = F.lower(F.regexp_replace(decomposed, "[\\u0300-\\u036f]", ""))
    s = F.translate(s, "-", " ") if dash else s
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\s]", " "), r"\s+", " "))


def normal_name(name: Column) -> Column:
    """Without combining marks, lower case, other characters to single spaces."""
    return _plain(F.translate(name, "".join(_MARKED), "".join(_MARKED.values())), False)


def normal_name_compatible(name: Column) -> Column:
    """The same by compatibility decomposition, dashes to spaces."""
    return _plain(_compatible(name), True)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, of normal names; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).otherwise(1 - F.try_divide(F.levenshtein(a, b).cast("double"), longest.cast("double")))


def given_similarity(a: Column, b: Column) -> Column:
    prefix = ((F.length(a) >= 3) & F.startswith(b, a)) | ((F.length(b) >= 3) & F.startswith(a, b))
    return F.when(a == b, 1.0).when(prefix, 0.95).otherwise(similarity(a, b))


def first_token(name: Column) -> Column:
    return F.substring_index(name, " ", 1)


def last_token(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def token_similarity(first_a: Column, last_a: Column, first_b: Column, last_b: Column) -> Column:
    """Surname 0.6, given name 0.4, straight or swapped, whichever is better; of tokens of normal names."""
    straight = similarity(last_a, last_b) * 0.6 + given_similarity(first_a, first_b) * 0.4
    swapped = similarity(last_a, first_b) * 0.6 + given_similarity(first_a, last_b) * 0.4
    return F.greatest(straight, swapped)


def name_similarity(a: Column, b: Column) -> Column:
    """Token similarity of normal names; 0 if either is empty."""
    both = token_similarity(first_token(a), last_token(a), first_token(b), last_token(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(both)


def club_similarity(a: Column, b: Column) -> Column:
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.95).otherwise(similarity(a, b))


def guess_positions(label: Column, group: Column) -> Column:
    """Native positions from a feed's label and group; the first rule that fits."""
    s = F.lower(label)
    has, eq = lambda *w: F.coalesce(*(F.when(s.contains(x), True) for x in w), F.lit(False)), lambda *w: s.isin(*w)
    p = lambda *names: F.array(*map(F.lit, names))
    back = (
        F.when(has("right wing") | eq("rwb"), p("RB", "WB")).when(has("left wing") | eq("lwb"), p("LB", "WB")).when(has("wing") | eq("wb", "e"), p("WB"))
        .when(has("right") | eq("rb", "dd"), p("RB")).when(has("left") | eq("lb", "ds"), p("LB")).otherwise(p("CB"))
    )
    middle = F.when(has("defensive") | eq("dm", "cdm", "m"), p("DM")).when(has("attacking") | eq("am", "cam", "t"), p("AM")).when(has("wing") | eq("w", "lw", "rw"), p("W")).otherwise(p("CM"))
    front = F.when(has("second", "shadow") | eq("ss", "a"), p("FW")).otherwise(p("ST"))
    return F.when(group == "GK", p("GK")).when(group == "DEF", back).when(group == "MID", middle).otherwise(front)


def score_part(score: Column, i: int) -> Column:
    """The whole number that a part of a score text such as "2 - 1" begins with."""
    return F.regexp_extract(F.get(F.split(score, "-"), F.lit(i)), r"^\s*([+-]?\d+)", 1).try_cast("int")


def singular(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, "(?i)s$", ""))


def full_name(first: Column, last: Column) -> Column:
    """The parts that are there and not empty, joined by a space."""
    return F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))


def initial(name: Column) -> Column:
    return F.substring(name, 1, 1)


def cache_key(collection: str, **parts: Column) -> Column:
    """A canonical key: the collection and a JSON object with sorted names."""
    return F.concat(F.lit(f"{collection}:"), F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"}))


def visible(cells: Column) -> Column:
    """The cells that aren't null or empty."""
    return F.filter(cells, lambda x: F.coalesce(x, F.lit("")) != "")
