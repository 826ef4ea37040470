"""Names that stand in other names: whole names and words, without all pairs.

A pattern can only be in a text that has the pattern's rarest run of ``RUN`` signs
(of all its signs, if it is shorter), so the two meet on that run, the asymmetric
form of the prefix filter, and are then compared. Names that no pattern tells apart
are one class; classes are linked, not items, and counts follow from their sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfolio.operators.tables import join_by_weight, materialize, shuffled

#: Signs of a run that texts and patterns meet on.
RUN = 4
#: Rows of a key on either side that meet in a task; keys with more are cut.
MOST = 2000
#: Words of a name count if they are longer than this.
SHORT = 3


def across(left: DataFrame, right: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, which are not null. A key of many
    rows is cut by a hash into blocks on both sides, and each two blocks meet on
    their own. What is cut is broadcast: one key in ``most`` rows at most."""
    most, keys = most or MOST, list(keys)
    blocks = lambda d, m: d.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(m))
    cut = shuffled(blocks(left, "_l")).join(blocks(right, "_r"), keys).where("_l > 1 OR _r > 1")

    def spread(d: DataFrame, own: str, other: str) -> DataFrame:
        rest = [c for c in d.columns if c not in keys]
        d = d.join(F.broadcast(cut), keys, "left").fillna(1, ["_l", "_r"])
        here, there = F.pmod(F.xxhash64(*rest), F.col(own)).cast("int").alias(f"_of{own}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"_of{other}")
        return d.select(*keys, *rest, here, there)

    on = [*keys, "_of_l", "_of_r"]
    return shuffled(spread(left, "_l", "_r")).join(spread(right, "_r", "_l"), on).drop("_of_l", "_of_r")


def runs(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` signs of a text; none of a shorter text."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``within, text, pattern``, once each, where a text (within, text) holds a
    pattern (within, pattern) of the same ``within``, which is not null. Null and
    empty patterns are in no text."""
    texts, patterns = texts.select("within", "text").where("text <> ''").distinct(), patterns.select("within", "pattern").where("pattern <> ''").distinct()
    pattern, size = F.col("pattern"), F.length("pattern")
    own = F.coalesce(*(F.when(size == n, runs(pattern, n)) for n in range(1, RUN)), runs(pattern, RUN))
    asked = patterns.select("within", "pattern", F.explode(own).alias("run"))
    shown = texts.select("within", "text", F.explode(F.flatten(F.array(*(runs(F.col("text"), n) for n in range(1, RUN + 1))))).alias("run"))
    counts = shown.groupBy("within", "run").agg(F.count("*").alias("n"))
    seen = asked.join(counts, ["within", "run"], "left").fillna(0, ["n"])
    rarest = seen.groupBy("within", "pattern").agg(F.min(F.struct("n", "run")).alias("x")).where("x.n > 0").select("within", "pattern", F.col("x.run").alias("run"))
    return across(shown, rarest, ["within", "run"]).where(F.contains("text", pattern)).select("within", "text", "pattern")


def offered(name: Column) -> Column:
    """What links a name to those that hold it: its long words, and itself."""
    return F.array_distinct(F.array_append(F.filter(F.split(name, " "), lambda w: F.length(w) > SHORT), name))


def overlaps(items: DataFrame) -> DataFrame:
    """``tenant, name, n, n_links``: of each name of a tenant, in lower case, how many
    items have it and with how many other items each of them overlaps. Two items
    overlap if one name holds the other or a word of it of more than three letters;
    items have no order, so this goes either way. A null name is an empty one, which
    is in every name; items of equal names overlap. Names with the same links are one
    class, so a word that very many names share makes one pair, not one of each two.
    """
    name = F.lower(F.coalesce(F.col("name"), F.lit("")))
    of = F.coalesce(F.concat(F.lit("="), F.col("tenant").cast("string")), F.lit(""))  # a null tenant is one too
    names = shuffled(materialize(items.groupBy("tenant", name.alias("name")).agg(F.count("*").alias("n")).select("tenant", of.alias("within"), "name", "n"), "names"))
    offers = names.where("name <> ''").select("within", "name", F.explode(offered(F.col("name"))).alias("pattern"))
    held = contained(names.select("within", F.col("name").alias("text")), offers).withColumnRenamed("text", "name")
    held = shuffled(materialize(held.join(offers.withColumn("own", F.lit(True)), ["within", "name", "pattern"], "left"), "held"))
    live = held.groupBy("within", "pattern").agg(F.count("*").alias("k")).where("k > 1")  # what one name alone holds links nothing
    links = join_by_weight(held, live, ["within", "pattern"], "k", held.count())
    sets = links.groupBy("within", "name").agg(F.array_sort(F.collect_set(F.when(F.col("own"), F.col("pattern")))).alias("offers"), F.array_sort(F.collect_set("pattern")).alias("holds"))  # of one name
    told = shuffled(materialize(names.where("name <> ''").join(sets, ["within", "name"]).select("within", "name", "n", "offers", "holds"), "sets"))
    classes = shuffled(materialize(told.groupBy("within", "offers", "holds").agg(F.sum("n").alias("size"), F.min("name").alias("class"), F.count("*").alias("k")), "classes"))
    a = classes.select("within", "class", "size", "offers", "holds", F.explode("offers").alias("pattern"))
    b = classes.select("within", *(F.col(c).alias(f"b_{c}") for c in ("class", "size", "offers", "holds")), F.explode("holds").alias("pattern"))
    first = F.array_min(F.array_union(F.array_intersect("offers", "b_holds"), F.array_intersect("b_offers", "holds")))  # a pair counts where it meets first
    once = (F.col("class") < F.col("b_class")) | ((F.col("class") != F.col("b_class")) & ~F.array_contains("b_offers", F.col("pattern")))
    met = across(a, b, ["within", "pattern"]).where(once & (F.col("pattern") == first))
    ends = met.select("within", F.explode(F.array(F.struct("class", F.col("b_size").alias("more")), F.struct(F.col("b_class").alias("class"), F.col("size").alias("more")))).alias("x"))
    more = ends.groupBy("within", F.col("x.class").alias("class")).agg(F.sum("x.more").alias("more"))
    known = classes.join(more, ["within", "class"], "left").fillna(0, ["more"]).select("within", "offers", "holds", "k", F.when(F.size("offers") > 0, F.col("size")).alias("mates"), "more")
    linked = join_by_weight(told, known, ["within", "offers", "holds"], "k", told.count()).select("within", "name", "mates", "more")
    sizes = names.groupBy("within").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("name") == "", F.col("n")).otherwise(0)).alias("empty"))  # a row a tenant
    rows = names.join(linked, ["within", "name"], "left").join(sizes, "within")
    others = F.when(F.col("name") == "", F.col("total") - 1).otherwise(F.coalesce("mates", "n") - 1 + F.coalesce("more", F.lit(0)) + F.col("empty"))
    return rows.select("tenant", "name", "n", others.cast("long").alias("n_links"))


def part_of(items: DataFrame, is_part: Column, confidence: float = 0.75) -> DataFrame:
    """``kind, name, whole, n_parts, n_wholes, first_part, first_whole, confidence``:
    components, those items (id, kind, name) for which ``is_part`` holds over the
    lower-cased ``name``, and the wholes of the same kind whose shorter name theirs
    holds. A row for each two names, with the items that have them; items without a
    kind or a name take no part, and an empty name is no whole."""
    classes = items.where("kind <> '' AND name <> ''").groupBy(F.col("kind").cast("string").alias("within"), F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    classes = materialize(classes, "kinds")
    parts = classes.where(is_part).select("within", "name", F.col("n").alias("n_parts"), F.col("first").alias("first_part"))
    wholes = classes.select("within", F.col("name").alias("whole"), F.col("n").alias("n_wholes"), F.col("first").alias("first_whole"))
    pairs = contained(parts.select("within", F.col("name").alias("text")), wholes.select("within", F.col("whole").alias("pattern")))
    pairs = pairs.where(F.length("pattern") < F.length("text")).select("within", F.col("text").alias("name"), F.col("pattern").alias("whole"))
    return pairs.join(parts, ["within", "name"]).join(wholes, ["within", "whole"]).select(F.col("within").alias("kind"), "name", "whole", "n_parts", "n_wholes", "first_part", "first_whole", F.lit(confidence).alias("confidence"))
