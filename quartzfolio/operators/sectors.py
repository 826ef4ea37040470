"""Sectors, companies' sectors, taxonomy codes, types and weighed sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A curated list: words (with their weight) that tell a sector.
WORDS: dict[str, tuple[tuple[str, float], ...]] = {
    "it_software": (("software", 1.5), ("saas", 1.5), ("cloud", 1.3), ("api", 1.3), ("database", 1.2), ("erp", 1.4), ("crm", 1.4), ("kubernetes", 1.4), ("data warehouse", 1.3)),
    "food_beverage": (("food", 1.5), ("organic", 1.2), ("coffee", 1.3), ("wine", 1.3), ("dairy", 1.3), ("snack", 1.2), ("olive oil", 1.3)),
    "healthcare": (("medical", 1.5), ("patient", 1.4), ("hospital", 1.5), ("clinical", 1.3), ("diagnostic", 1.2), ("health record", 1.4)),
    "automotive": (("vehicle", 1.5), ("engine", 1.2), ("tyre", 1.3), ("car", 1.2), ("brake pads", 1.4)),
    "fashion": (("apparel", 1.5), ("leather", 1.2), ("shoe", 1.3), ("silk", 1.2), ("garment", 1.4)),
    "construction": (("cement", 1.4), ("concrete", 1.4), ("scaffold", 1.3), ("brick", 1.2), ("building site", 1.4)),
    "energy": (("solar", 1.4), ("turbine", 1.3), ("battery", 1.2), ("grid", 1.2), ("power plant", 1.5)),
    "finance": (("bank", 1.5), ("payment", 1.3), ("loan", 1.4), ("financial", 1.3), ("accounting", 1.2), ("credit card", 1.4)),
    "logistics": (("shipping", 1.4), ("freight", 1.5), ("warehouse", 1.2), ("courier", 1.3), ("supply chain", 1.4)),
    "cosmetics": (("perfume", 1.5), ("skincare", 1.5), ("shampoo", 1.3), ("lotion", 1.3)),
    "electronics": (("widget", 1.0), ("sensor", 1.3), ("circuit", 1.3), ("display", 1.1), ("gear", 1.0)),
    "agriculture": (("seed", 1.3), ("fertilizer", 1.4), ("harvest", 1.4), ("tractor", 1.5)),
    "education": (("school", 1.4), ("training", 1.2), ("course", 1.2), ("university", 1.5)),
    "hospitality": (("hotel", 1.5), ("restaurant", 1.4), ("booking", 1.2), ("tourism", 1.4)),
}
#: Some codes of public classifications, with level, sector and description.
CPV = (("48000000", 1, "it_software", "software package and information systems"), ("48600000", 2, "it_software", "database and operating software package"), ("72000000", 1, "it_software", "it services consulting software internet support"), ("33100000", 2, "healthcare", "medical equipments"), ("15860000", 3, "food_beverage", "coffee tea and related products"), ("15000000", 1, "food_beverage", "food beverages and related products"), ("66110000", 3, "finance", "banking services"), ("60000000", 1, "logistics", "transport services freight"), ("09330000", 3, "energy", "solar energy"), ("34300000", 2, "automotive", "parts for vehicles and their engines"))
ATECO = (("62.01", 2, "it_software", "software production"), ("63.11", 2, "it_software", "data processing hosting and database"), ("86.10", 2, "healthcare", "hospital services"), ("10.83", 2, "food_beverage", "coffee and tea processing"), ("64.19", 2, "finance", "bank intermediation"), ("35.11", 2, "energy", "production of electric power solar"), ("29.32", 2, "automotive", "other parts for vehicle engine"))


def dictionary(spark: SparkSession, words: Mapping[str, tuple[tuple[str, float], ...]] = WORDS) -> DataFrame:
    """(sector, word, weight): a literal of the plan, so its size is known."""
    return spark.createDataFrame([(s, w, x) for s, ws in words.items() for w, x in ws], "sector string, word string, weight double")


def keyword_scores(items: DataFrame, words: DataFrame) -> DataFrame:
    """(id, sector, score): weights of the words of each text (id, text), once for
    each time a word is there; phrases that the text holds count 1.2 times. Over
    five, 1 at most. Tokens meet the dictionary, which is broadcast, and are
    summed before they are shuffled; few phrases are compared with the text."""
    one, many = words.where(~F.contains("word", F.lit(" "))), words.where(F.contains("word", F.lit(" ")))
    tokens = items.select("id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).join(F.broadcast(one), "word").select("id", "sector", "weight")
    held = items.join(F.broadcast(many), F.contains(F.lower("text"), F.col("word"))).select("id", "sector", (F.col("weight") * 1.2).alias("weight"))
    both = tokens.unionByName(held).groupBy("id", "sector").agg(F.sum("weight").alias("w"))
    return both.select("id", "sector", F.least(F.lit(1.0), F.floor(F.col("w") / 5 * 1e9 + 0.5) / 1e9).alias("score"))


def detected(items: DataFrame, scores: DataFrame, least: float = 0.2) -> DataFrame:
    """Sector and confidence of every item: the best one if it is 0.5 or more and
    leads by over 0.15, else the best of at least ``least``, else unknown."""
    ranked = scores.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "sector"))).alias("r"))  # one for each sector
    top, lead = -F.get("r", 0)["s"], F.get("r", 0)["s"] * -1 + F.coalesce(F.get("r", 1)["s"], F.lit(0.0))
    good = F.coalesce((top >= 0.5) & (lead > 0.15), F.lit(False))
    some = F.coalesce(top >= least, F.lit(False))
    return items.select("id").join(ranked, "id", "left").select(
        "id", F.when(some, F.get("r", 0)["sector"]).otherwise("unknown").alias("sector"), F.when(good, F.least(top, F.lit(0.95))).when(some, top).otherwise(0.3).alias("confidence")
    )


def hybrid(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """0.4 of the one and 0.6 of the other score of each (id, sector)."""
    both = keyword.withColumnRenamed("score", "k").join(semantic.withColumnRenamed("score", "s"), ["id", "sector"], "full")
    return both.select("id", "sector", (F.lit(0.4) * F.coalesce("k", F.lit(0.0)) + F.lit(0.6) * F.coalesce("s", F.lit(0.0))).alias("score"))


def company_sectors(items: DataFrame, words: DataFrame) -> DataFrame:
    """Of each company (items of company, id, text): its sector, up to two others
    with 30 % of its score, and a confidence. Companies with fewer than three
    items are unknown."""
    hits = items.join(F.broadcast(words), F.contains(F.lower("text"), F.col("word"))).groupBy("company", "sector").agg(F.sum("weight").alias("w"))
    ranked = hits.groupBy("company").agg(F.array_sort(F.collect_list(F.struct((-F.floor(F.col("w") * 1e6 + 0.5)).alias("w"), "sector"))).alias("r"))
    n = items.groupBy("company").agg(F.count("*").alias("n"))
    known = (F.col("n") >= 3) & F.col("r").isNotNull()
    top, total = -F.get("r", 0)["w"], F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s - x["w"])
    others = F.slice(F.filter(F.slice("r", F.lit(2), F.size("r")), lambda x: -x["w"] >= F.lit(0.3) * -F.get("r", 0)["w"]), 1, 2)
    return n.join(ranked, "company", "left").select(
        "company", F.when(known, F.get("r", 0)["sector"]).otherwise("unknown").alias("sector"), F.when(known, F.array_join(F.transform(others, lambda x: x["sector"]), ",")).otherwise("").alias("others"),
        F.when(known, F.least(F.lit(0.95), top / total + 0.3)).otherwise(0.3).alias("confidence"),
    )


def best_code(items: DataFrame, codes, bonus: float) -> DataFrame:
    """The code whose description an item (id, text, sector) has most words of,
    alone or inside others; 1.3 times for its own sector, and a bonus for each
    level. Codes are a literal; 0.3 at least."""
    text = F.lower("text")
    options = []
    for i, (code, level, sector, description) in enumerate(codes):
        words = [w for w in description.split() if len(w) > 2]
        share = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) / float(len(words))
        score = share * F.when(F.col("sector") == sector, 1.3).otherwise(1.0) + F.when(share > 0, bonus * level).otherwise(0.0)
        options.append(F.struct((F.floor(score * 1e6 + 0.5) / 1e6).alias("score"), F.lit(-i).alias("o"), F.lit(code).alias("code")))
    return items.select("id", F.array_max(F.array(*options)).alias("b")).where("b.score >= 0.3").select("id", "b.code", "b.score")
