"""Text expressions: tokens, white space, number forms, hashed n-gram vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words that amounts are written with.
UNITS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
SCALES = ["hundred", "thousand", "million"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def clean_white_space(text: Column) -> Column:
    """CRLF to LF, runs of blanks to one, no blanks around line ends, at most one empty line, trimmed."""
    x = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, " ?\n ?", "\n"), "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


def flat(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def amounts(text: Column) -> Column:
    """Dollar amounts and grouped numbers, as written."""
    return F.regexp_extract_all(text, F.lit(r"\$?[0-9]{1,3}(?:,[0-9]{3})+|\$[0-9]+|[0-9]{4,}"), F.lit(0))


def amount_value(amount: Column) -> Column:
    return F.regexp_replace(amount, "[$,]", "").try_cast("decimal(38,0)")


def grouped(n: Column) -> Column:
    """12345 as 12,345."""
    return F.format_number(n, 0)


def holds_amount(text: Column, n: Column) -> Column:
    """Whether the text, without spaces, has the number in one of its forms."""
    bare = F.regexp_replace(text, r"\s+", "")
    return F.contains(bare, grouped(n)) | F.contains(bare, n.cast("string")) | F.contains(bare, F.concat(F.lit("$"), grouped(n)))


def bucket_of(gram: Column, dims: int) -> Column:
    """Bucket and sign from the gram's md5."""
    return F.conv(F.substring(F.md5(gram.cast("binary")), 1, 8), 16, 10).cast("bigint") % dims


def sign_of(gram: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(gram.cast("binary")), 9, 1), 16, 10).cast("int") >= 8, -1).otherwise(1)


#: Eight heights of a bar.
BARS = "▁▂▃▄▅▆▇█"


def sparkline(counts: Column) -> Column:
    """An array of counts as a line of bars, the largest the highest; empty for an empty array."""
    top = F.array_max(counts)
    level = lambda c: F.least(F.floor(c * len(BARS) / F.greatest(top, F.lit(1))), F.lit(len(BARS) - 1)).cast("int")
    return F.concat_ws("", F.transform(counts, lambda c: F.substr(F.lit(BARS), level(c) + 1, F.lit(1))))


def human_duration(seconds: Column) -> Column:
    """Seconds as 0.5s, 42s, 3m 20s, 2h 5m or 4d 3h."""
    s = F.floor(seconds).cast("bigint")
    two = lambda big, a, small, b: F.concat(F.floor(s / big).cast("string"), F.lit(a + " "), F.floor(F.pmod(s, F.lit(big)) / small).cast("string"), F.lit(b))
    short = F.concat(F.format_string("%.1f", seconds.cast("double")), F.lit("s"))
    return F.when(seconds < 1, short).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, two(60, "m", 1, "s")).when(s < 86_400, two(3600, "h", 60, "m")).otherwise(two(86_400, "d", 3600, "h"))


def human_bytes(n: Column) -> Column:
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    out = None
    for k in range(len(units) - 1, -1, -1):
        form = F.concat(F.format_number(n / F.lit(float(1024**k)), 1), F.lit(f" {units[k]}"))
        out = form if out is None and k == 0 else (F.when(n >= 1024**k, form) if out is None else out.when(n >= 1024**k, form) if k else out.otherwise(form))
    return out


def file_name_of(url: Column) -> Column:
    """Host and path as a file name: everything but letters, digits, dot and dash becomes one underscore."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[^A-Za-z0-9.\-]+", "_")


def html_text(html: Column) -> Column:
    """The plain variant of HTML to text by expressions: no scripts or styles, block ends as line breaks, tags dropped."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|li|tr|br|h[1-6]|ul|table|article|footer|nav)[^>]*>", "\n")
    return clean_white_space(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"<[^>]*>", ""), "&lt;", "<"), "&amp;", "&"))
