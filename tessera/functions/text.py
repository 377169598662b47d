"""Text expressions: identifier tokens, edit similarity, hashed vectors, source normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Everything but ASCII letters and digits. Written as ranges: Java matches a negated class some twenty times slower.
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x{10FFFF}]+"
#: Between tokens: others, case changes, acronyms' ends, and digits' edges.
BETWEEN = OTHER + "|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """Lower-cased parts of identifiers: split at underscores, case changes, acronyms and digits."""
    # lower-casing the joined parts once is cheaper than each of them
    parts = F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")
    return F.array_remove(F.split(F.lower(F.array_join(parts, " ")), " "), "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, over lower-cased code points; 1 for two empty texts."""
    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    longer = F.greatest(F.char_length(x), F.char_length(y), F.lit(1))
    return 1.0 - F.levenshtein(x, y) / longer


def hash_vector(text: Column, dim: int) -> Column:
    """Unit vector of hashed words: two bytes of each word's SHA-1 name a place, the third's parity a sign."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    place = lambda w: F.conv(F.substring(F.sha1(w), 1, 4), 16, 10).cast("int") % dim
    sign = lambda w: 1 - 2 * (F.conv(F.substring(F.sha1(w), 5, 2), 16, 10).cast("int") % 2)
    hits = F.transform(words, lambda w: F.struct(place(w).alias("i"), sign(w).cast("double").alias("s")))
    # the vector is written once: each place sums the hits that name it, of which there are as many as words
    at = lambda found: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(found, i), F.lit(0.0)))
    places = lambda h: F.array_distinct(F.transform(h, lambda x: x["i"]))
    summed = lambda h: F.map_from_arrays(places(h), F.transform(places(h), lambda i: F.aggregate(F.filter(h, lambda x: x["i"] == i), F.lit(0.0), lambda s, x: s + x["s"])))
    total = let(hits, lambda h: let(summed(h), at))
    norm = lambda t: F.sqrt(F.aggregate(t, F.lit(0.0), lambda s, v: s + v * v))
    return let(total, lambda t: let(norm(t), lambda n: F.transform(t, lambda v: F.when(n > 0, v / n).otherwise(v))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 for null, empty or zero vectors."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), F.greatest(n, F.lit(0))).cast("array<double>"), F.slice(b, F.lit(1), F.greatest(n, F.lit(0))).cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    full_a, full_b = a.cast("array<double>"), b.cast("array<double>")
    scale = F.when(length(full_a) == 0, 1.0).otherwise(length(full_a)) * F.when(length(full_b) == 0, 1.0).otherwise(length(full_b))
    return F.coalesce(F.when(n > 0, dot / scale), F.lit(0.0))


COMMENTS = (r"(?s)/\*.*?\*/", r"(?m)//[^\n]*")


def without_comments(source: Column) -> Column:
    out = F.coalesce(source, F.lit(""))
    for pattern in COMMENTS:
        out = F.regexp_replace(out, pattern, "")
    return out


def body_hash(source: Column) -> Column:
    """SHA-1 of source without comments, white space collapsed."""
    return F.sha1(F.trim(F.regexp_replace(without_comments(source), r"\s+", " ")))


def normalised(source: Column) -> Column:
    """Source without comments, white space collapsed, and none around punctuation."""
    flat = F.trim(F.regexp_replace(without_comments(source), r"\s+", " "))
    return F.regexp_replace(flat, r"\s*([{}();,])\s*", "$1")


def argument_count(inside: Column) -> Column:
    """Commas plus one, 0 for blank text: of what lies between a call's parentheses."""
    return F.when(F.trim(inside) == "", 0).otherwise(F.size(F.split(inside, ",")))


def parameter_count(signature: Column) -> Column:
    return argument_count(F.regexp_extract(signature, r"\((.*)\)", 1))


def package_bucket(fqname: Column) -> Column:
    """Package of a symbol, five parts deep at most; names of one or two parts stay whole."""
    name = F.substring_index(F.coalesce(fqname, F.lit("")), "#", 1)
    parts = F.array_remove(F.split(name, r"\."), "")
    return F.when(name == "", "default").when(F.size(parts) <= 2, name).otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(5))), "."))


def snippet(text: Column, line: Column, around: int = 2) -> Column:
    """Lines around a 1-based line, clipped to the text; null for a null text."""
    lines = F.split(text, "\n")
    first = F.greatest(line - around, F.lit(1))
    last = F.least(line + around, F.size(lines))
    return F.when(last >= first, F.array_join(F.slice(lines, first.cast("int"), (last - first + 1).cast("int")), "\n"))
