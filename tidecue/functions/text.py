"""Text expressions: words, trigrams, similarity, subtitle times, budgets, hashes."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Spoken Mandarin characters in a second, and the least budget of a line.
CHARS_PER_SECOND, MIN_BUDGET = 4.6, 4


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: expressions that name a column often would repeat its tree."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def round_to(c: Column | str, digits: int) -> Column:
    """Rounded half up in plain double arithmetic, which every SQL engine repeats bit for bit."""
    scale = float(10**digits)
    return F.floor(col(c) * scale + 0.5) / scale


def strip(c: Column | str) -> Column:
    """Without white space (as Unicode has it) at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def norm_words(c: Column | str) -> Column:
    """Lower-case words of ASCII letters and apostrophes, two characters or more; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z']+)"), F.lit(1))
    return F.filter(found, lambda w: F.length(w) > 1)


def trigrams(words: Column | str) -> Column:
    """Distinct runs of three words, joined by a space. Materialise the words in a select of their own first."""
    w = col(words)
    places = F.sequence(F.lit(1), F.size(w) - 2)
    return F.when(F.size(w) >= 3, F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(w, i, 3), " ")))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared part of two word sets; 0 if either is empty."""
    both, union = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when((F.size(col(a)) > 0) & (F.size(col(b)) > 0), both / union).otherwise(F.lit(0.0))


#: Character references: as browsers take them, the semicolon may be missing; and those that are ended by one.
_LOOSE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\x00\t\n\f <&#;]{1,32};?)"
_ENDED = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});"


@F.pandas_udf(StringType())
def _resolved(refs: pd.Series) -> pd.Series:
    """Each of references joined by line ends, which are in none; what they stand for, joined by zeros, which none stands for."""
    return refs.map(lambda r: "\0".join(map(html.unescape, r.split("\n"))) if r else "", na_action="ignore")


def unescape_html(c: Column | str, ended: bool = False) -> Column:
    """With HTML character references resolved; with ``ended`` only those that a semicolon ends. Only the references go through
    Python, not the text around them."""
    kind = _ENDED if ended else _LOOSE
    parts = F.split(col(c), kind)
    found = F.split(_resolved(F.array_join(F.regexp_extract_all(col(c), F.lit(kind), F.lit(0)), "\n")), "\0")
    whole = F.array_join(F.zip_with(parts, found, lambda part, ref: F.concat(part, F.coalesce(ref, F.lit("")))), "")
    return F.when(F.contains(col(c), F.lit("&")), whole).otherwise(col(c))


def clean_script_text(c: Column | str, entities: bool = False, ended: bool = False) -> Column:
    """Without [..] and (..), white space collapsed; with ``entities`` HTML entities are resolved first (``ended``: see unescape_html)."""
    x = unescape_html(c, ended) if entities else col(c)
    x = F.regexp_replace(F.regexp_replace(x, r"\[[^\]]*\]", " "), r"\([^)]*\)", " ")
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def clean_markup(c: Column | str, ended: bool = False) -> Column:
    """Text of an HTML fragment: tags become spaces, then as ``clean_script_text``."""
    return clean_script_text(F.regexp_replace(col(c), "<[^>]+>", " "), entities=True, ended=ended)


def srt_time(seconds: Column | str) -> Column:
    """HH:MM:SS,mmm; negative times are zero."""
    return let(F.bround(F.greatest(col(seconds), F.lit(0.0)) * 1000).cast("long"), _clock)


def _clock(ms: Column) -> Column:
    unit = lambda size, most, width: F.lpad(((ms / size).cast("long") % most).cast("string"), width, "0")
    hours = F.floor(ms / 3600000)
    return F.concat(F.when(hours < 10, F.concat(F.lit("0"), hours.cast("string"))).otherwise(hours.cast("string")), F.lit(":"), unit(60000, 60, 2), F.lit(":"), unit(1000, 60, 2), F.lit(","), unit(1, 1000, 3))


def clean_emotion(c: Column | str) -> Column:
    """A cue of up to 30 characters in square brackets, or an empty string."""
    x = F.regexp_replace(strip(F.coalesce(col(c).cast("string"), F.lit(""))), "\n", " ")
    x = strip(F.regexp_replace(x, r"^[\[\]() ]+|[\[\]() ]+$", ""))
    return F.when((F.length(x) > 0) & (F.length(x) <= 30), F.concat(F.lit("["), x, F.lit("]"))).otherwise("")


def char_budget(start: Column | str, end: Column | str) -> Column:
    """Characters that a translation of a line may have."""
    return F.greatest(F.floor(F.greatest(col(end) - col(start), F.lit(0.6)) * CHARS_PER_SECOND), F.lit(MIN_BUDGET)).cast("int")


def stable_pick(name: Column | str, n: Column | int) -> Column:
    """SHA-1 of the name as one number, modulo n: the hex digits fold, so no number is wider than 64 bits."""
    size = (n if isinstance(n, Column) else F.lit(n)).cast("long")
    digits = F.split(F.sha1(col(name)), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: F.when(d == "", a).otherwise((a * 16 + F.conv(d, 16, 10).cast("long")) % size))


def fingerprint(value: object) -> str:
    """SHA-256 of a value as canonical JSON: the identity of a materialised stage."""
    import hashlib

    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def fit_key(identity: Column | str, tempo: Column | str) -> Column:
    """Content-addressed name of a clip at a tempo: 20 hex digits."""
    return F.substring(F.sha1(F.concat(col(identity), F.lit("|"), F.format_string("%.4f", col(tempo)))), 1, 20)


# Fixed set: characters after which a subtitle line may break.
BREAKS = "，。！？、；：,.!?;… "


def wrap_cjk(c: Column | str, width: int = 18) -> Column:
    """Lines of up to ``width`` characters, as an array. A full line breaks after the last punctuation mark among its last five
    characters but one, else where it is full; lines of white space alone are left out. A text that fits is one line; null
    is an empty one.

    Whole lines are found by one pattern, greedy first: the latest mark that may end a line, else the full width."""
    low = max(width - 5, 1)
    marked = f"(?=.{{{width}}}).{{{low - 1},{width - 2}}}[{re.escape(BREAKS)}]|" if low < width else ""
    pattern = f"(?s){marked}.{{{width}}}|.+"

    def lines(text: Column) -> Column:
        found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), strip), lambda x: x != "")
        return F.when(F.length(text) <= width, F.array(text)).otherwise(found)

    return let(strip(F.coalesce(col(c), F.lit(""))), lines)


def chunk_by_two(lines: Column | str) -> Column:
    """Wrapped lines two at a time, as subtitle screens; none becomes one empty screen."""
    x = col(lines)
    whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 2).cast("int")), lambda i: F.array_join(F.slice(x, 2 * i + 1, 2), "\n"))
    return F.when(F.size(x) > 0, whole).otherwise(F.array(F.lit("")))
