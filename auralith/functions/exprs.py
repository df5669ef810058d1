"""Column expressions of the data model: names, paths, vectors, levels. All run inside the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: file extensions and their formats
FORMATS = {
    "wav": "wav",
    "aif": "aiff",
    "aiff": "aiff",
    "mp3": "mp3",
    "flac": "flac",
    "ogg": "ogg",
    "oga": "ogg",
    "aac": "aac",
    "m4a": "m4a",
}
SILENCE_DBFS = -120.0


def normalize_name(c: Column) -> Column:
    """Lower case, underscores and hyphens as blanks, white space single and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[_\-\s]+", " "))


def slug(c: Column) -> Column:
    return F.replace(normalize_name(c), F.lit(" "), F.lit("-"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """What follows the last dot of a file name, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def format_of(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit("unknown"))


def supported_extensions() -> list[str]:
    return sorted(FORMATS)


def timestamp_text(c: Column) -> Column:
    """UTC time as text with as many decimals as it needs; empty for null."""
    whole, part = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(c, "SSSSSS")
    decimals = F.regexp_replace(part, "0+$", "")
    return F.coalesce(F.concat(whole, F.when(decimals != "", F.concat(F.lit("."), decimals)).otherwise(""), F.lit("Z")), F.lit(""))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def _comparable(a: Column, b: Column, value: Column, zero_norm_fails: bool) -> Column:
    checked = F.when((F.size(a) == 0) | (F.size(b) == 0), F.raise_error(F.lit("vectors must not be empty")).cast("double"))
    checked = checked.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector dimensions differ")).cast("double"))
    if zero_norm_fails:
        checked = checked.when((norm(a) == 0) | (norm(b) == 0), F.raise_error(F.lit("cosine of a zero vector")).cast("double"))
    return checked.otherwise(value)


def cosine(a: Column, b: Column) -> Column:
    """Fails on empty, unequally long and zero vectors, as the query surface demands."""
    return _comparable(a, b, dot(a, b) / (norm(a) * norm(b)), True)


def euclidean(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return _comparable(a, b, F.sqrt(total), False)


def hash_bits(hex16: Column) -> Column:
    """Sixteen hexadecimal digits as a signed 64-bit integer; anything else fails."""
    return F.when(hex16.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(hex16, 16, -10).cast("long")).otherwise(F.raise_error(F.lit("malformed hash")).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dbfs(level: Column) -> Column:
    return F.when(level > 0, 20 * F.log10(level)).otherwise(F.lit(SILENCE_DBFS))


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def percentile(sorted_values: Column, p: float) -> Column:
    """Linear interpolation at p (n - 1) in an array that is taken as it comes."""
    at = F.lit(p) * (F.size(sorted_values) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, high)
    return F.when(F.size(sorted_values) == 0, F.lit(0.0)).otherwise(a + (b - a) * (at - low))


def distinct_first(values: Column) -> Column:
    """Values without null or empty ones, each at its first place."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def bits_to_hash(flags: Column) -> Column:
    """A 64-bit integer with bit k set where flag k holds."""
    return F.aggregate(F.transform(flags, lambda f, k: F.when(f, F.expr("1L")).otherwise(F.expr("0L"))).alias("b"), F.expr("struct(0L as acc, 0 as k)"), lambda s, x: F.struct(s["acc"].bitwiseOR(F.call_function("shiftleft", x, s["k"])).alias("acc"), (s["k"] + 1).alias("k")), lambda s: s["acc"])


def least_of(first: Column, *rest: Column) -> Column:
    return functools.reduce(lambda a, b: F.least(a, b), rest, first)
