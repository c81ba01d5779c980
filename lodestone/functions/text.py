"""Scalar functions over text as Column expressions, all inside whole-stage code generation or JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"([\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*)"
WORD = r"([\p{L}\p{N}_]+)"
#: A secret's name, a separator and its value; placeholders are left alone.
ASSIGNMENT = r"((?:token|secret|password|api_key)\s*[=:]\s*)(\"[^\"<$]+\"|[^\s\"<$]+)"


def query_terms(text: Column, most: int = 32) -> Column:
    """Distinct lower-case terms in order of appearance, at most `most`."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM))), 1, most)


def body_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD)))


def collapse(text: Column) -> Column:
    """White space runs to one blank, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"))


def garbled_count(text: Column) -> Column:
    """Replacement and control characters other than tab, line feed and carriage return."""
    return F.length(text) - F.length(F.regexp_replace(text, r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def non_ascii_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))


def redact_assignments(text: Column) -> Column:
    return F.regexp_replace(text, ASSIGNMENT, "$1[REDACTED]")


def has_secret(text: Column) -> Column:
    return text.rlike(ASSIGNMENT)


def stable_bucket(text: Column, buckets: int = 2048) -> Column:
    """A bucket from the first 16 bits of the SHA-256 digest."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 4), 16, 10).cast("long"), F.lit(buckets))


def lock_key(text: Column) -> Column:
    """A non-negative 60-bit key from the SHA-256 digest."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def git_blob(text: Column) -> Column:
    """The object name that git gives a file's content."""
    data = text.cast("binary")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(text).cast("string").cast("binary"), F.lit(bytes(1)), data))


def pointer_escape(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def table_cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[table_cell(c) for c in cells]), F.lit(" |"))


def column_number(letters: Column) -> Column:
    """A spreadsheet column's letters as its number, A = 1."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("long"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def column_letters(number: Column, digits: int = 4) -> Column:
    """The inverse of column_number for numbers of up to `digits` letters."""
    out, n = F.lit(""), number
    for _ in range(digits):
        out = F.when(n > 0, F.concat(F.char(F.pmod(n - 1, F.lit(26)) + 65), out)).otherwise(out)
        n = F.floor((n - 1) / 26)
    return out


def cue_seconds(stamp: Column) -> Column:
    """[hh:]mm:ss with "." or "," before the milliseconds, in seconds."""
    part = [F.coalesce(F.regexp_extract(stamp, r"^(?:(\d+):)?(\d+):(\d+)[.,](\d+)$", i), F.lit("")) for i in (1, 2, 3, 4)]
    whole = F.when(part[0] == "", 0).otherwise(part[0]).cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("long")
    return whole + part[3].cast("double") / 1000


def base64url(text: Column) -> Column:
    return F.unbase64(F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4)))))


def retry_after(value: Column) -> Column:
    """Seconds to wait, between one second and a day; a minute where the header is no number."""
    return F.least(F.greatest(F.coalesce(value.try_cast("long"), F.lit(60)), F.lit(1)), F.lit(86_400))


def backoff(attempt: Column, base: int = 2, most: int = 3600) -> Column:
    return F.least(F.pow(F.lit(float(base)), attempt), F.lit(float(most))).cast("long")


ADDRESS = r"[^@\s]+@[^@\s.]+(\.[^@\s.]+)+"


def is_address(text: Column) -> Column:
    """One name, one "@", and a host of two labels or more."""
    return text.rlike(r"\A" + ADDRESS + r"\z")


def address_domain(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"@([^@\s]+)$", 1))


def brief(text: Column, most: int) -> Column:
    """One line of at most `most` bytes whole, otherwise its first characters and an ellipsis."""
    line = F.regexp_replace(text, r"\s+", " ")
    return F.when(F.octet_length(text) > most, F.concat(F.rtrim(F.substr(line, F.lit(1), F.lit(most - 1))), F.lit("…"))).otherwise(line)


def labelled(**values: Column) -> Column:
    """A line "Label: value" for each value that isn't null."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in values.items()])
