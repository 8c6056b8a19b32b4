"""Column expressions for strings, paths and literal matching.

Java regular expressions are ASCII unless told otherwise; ``(?U)`` makes ``\\s`` and
``\\d`` cover U+3000 and full-width digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters replaced one by one when text is brought to half width.
WIDE_PUNCTUATION = "：，．；－（）［］／＼％＆＃＠　"
NARROW_PUNCTUATION = ":,.;-()[]/\\%&#@ "
# Fixed value: private-use, zero-width and tag characters that OCR leaves behind.
OCR_JUNK = (
    r"[\x{E000}-\x{F8FF}\x{FFFD}\x{200B}-\x{200F}\x{FEFF}\x{2028}\x{2029}"
    r"\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}\x{E0000}-\x{E007F}]"
)

_WIDE_ALNUM = "".join(
    chr(0xFF00 + ord(c) - 0x20)
    for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
)
_NARROW_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
BLANK = r"[\s\p{Z}\x{FFFD}]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.  A named intermediate column can be
    copied into every place that uses it, even into the loop of a higher-order function;
    a lambda variable cannot."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (SQL trim knows only U+0020)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    plain = F.rtrim(c)
    return F.when(F.rlike(F.right(plain, F.lit(1)), F.lit(r"(?U)\s")), F.regexp_replace(plain, r"(?U)\s+\z", "")).otherwise(plain)


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def squeeze(c: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def unix_lines(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def lines(c: Column) -> Column:
    """Array of lines; a final line break opens no further line."""
    parts = F.split(c, LINE_BREAK, -1)
    return let(parts, lambda ls: F.when(F.element_at(ls, -1) == "", F.slice(ls, 1, F.size(ls) - 1)).otherwise(ls))


def half_width(c: Column) -> Column:
    narrow = F.translate(c, _WIDE_ALNUM + WIDE_PUNCTUATION, _NARROW_ALNUM + NARROW_PUNCTUATION)
    return F.regexp_replace(narrow, OCR_JUNK, "")


def ascii_digits(c: Column) -> Column:
    return F.translate(c, _WIDE_ALNUM[:10], _NARROW_ALNUM[:10])


def quoted(c: Column) -> Column:
    """The string as a regular expression matching exactly itself."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


# ---- file names and paths -------------------------------------------------------


def raw_ext(name: Column) -> Column:
    """Extension with its dot as written; a name of leading dots only has none."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def ext(name: Column) -> Column:
    return F.lower(raw_ext(name))


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(raw_ext(name)))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)[\\/][^\\/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^\\/]*)$", 1)


def norm_path(path: Column) -> Column:
    """Comparable form of a location: trimmed, no final separators, lower case."""
    return F.lower(F.regexp_replace(strip(path), r"[\\/]+$", ""))


def join_path(directory: Column, name: Column) -> Column:
    return F.concat_ws("/", empty_to_null(directory), name)


def safe_name(c: Column, default: str = "未命名", limit: int = 80) -> Column:
    """A string usable as a file name."""
    s = F.regexp_replace(c, r'[\\/:*?"<>|\r\n\t]+', "_")
    s = F.regexp_replace(strip_chars(s, " ._"), r"(?U)\s+", " ")
    return F.substring(F.coalesce(empty_to_null(s), F.lit(default)), 1, limit)


def letters_and_digits(c: Column) -> Column:
    """Lower case without any separator or punctuation, for phrase search in names."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def is_cjk_name(c: Column) -> Column:
    n = F.regexp_count(c, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    return (n >= 2) & (n >= F.length(c) * 0.6)


def size_label(n: Column) -> Column:
    """1024-step size text; bytes carry no decimals."""
    step = F.least(F.floor(F.log(1024.0, F.greatest(n, F.lit(1)))), F.lit(4)).cast("int")
    value = n / F.pow(F.lit(1024.0), step)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), step + 1)
    return F.when(step == 0, F.format_string("%d B", n.cast("long"))).otherwise(
        F.format_string("%.1f %s", value, unit)
    )


# ---- literal occurrences ---------------------------------------------------------


def count_literal(text: Column, term: Column) -> Column:
    """Occurrences of a literal that do not overlap."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return (gone / F.length(term)).cast("long")


def snippet(text: Column, term: Column, chars: int = 70) -> Column:
    """Text around the first occurrence: ``chars`` before it to twice as many after its start."""
    at = F.greatest(F.instr(text, term) - 1, F.lit(0))
    start = F.greatest(at - chars, F.lit(0))
    return squeeze(F.substring(text, start + 1, at + 2 * chars - start))


def compact(c: Column) -> Column:
    """Text without white space of any kind and without replacement characters."""
    return F.regexp_replace(c, f"{BLANK}+", "")


def loose_pattern(term: Column) -> Column:
    """Expression matching a term whose characters may be parted by blanks or line ends."""
    parts = F.transform(F.split(compact(term), ""), quoted)
    return F.array_join(F.filter(parts, lambda p: p != "\\Q\\E"), f"{BLANK}*")
