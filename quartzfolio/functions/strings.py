"""String functions: normal forms, distances, keywords, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Words too common to be keywords, English and Italian.
STOP_WORDS = tuple("the and for with that this from are was were has have not but can all per del della delle dei con una uno che non sono alla nel".split())


def normalized(x: Column) -> Column:
    """Lower case without accents; letters, digits and single blanks only."""
    s = F.translate(F.lower(x), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\s]", " "), r"\s+", " "))


def column_name(x: Column) -> Column:
    """Lower-case words joined by single underscores."""
    s = F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9_À-ſ]", "_")
    return F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalized(x), " ", "-"), "^-|-$", "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, ignoring case; two empty strings are equal."""
    a, b = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def bigrams(x: Column) -> Column:
    return F.when(F.length(x) >= 2, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def bigram_cosine(a: Column, b: Column) -> Column:
    """Cosine of bigram counts; 0 where a side has none."""
    ga, gb = bigrams(a), bigrams(b)
    count = lambda g, x: F.size(F.filter(g, lambda y: y == x)).cast("double")
    dot = F.aggregate(F.array_intersect(ga, gb), F.lit(0.0), lambda s, x: s + count(ga, x) * count(gb, x))
    norm = lambda g: F.sqrt(F.aggregate(F.array_distinct(g), F.lit(0.0), lambda s, x: s + count(g, x) * count(g, x)))
    return F.when((F.size(ga) > 0) & (F.size(gb) > 0), dot / (norm(ga) * norm(gb))).otherwise(0.0)


def keywords(x: Column) -> Column:
    """Distinct words of three letters or more that aren't stop words."""
    words = F.filter(F.split(F.lower(x), r"[^a-z0-9àèéìòù]+"), lambda w: F.length(w) >= 3)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def split_on(x: Column, separators: str = r"[,;|/]") -> Column:
    """Trimmed parts that aren't empty."""
    return F.filter(F.transform(F.split(x, separators), lambda p: F.trim(p)), lambda p: p != "")
