"""Catalog files to items, and items to files.

CSV with sniffed delimiter, JSON catalogs, free text with lists and markdown
tables, web pages. All give rows of (name, description, vendor, category, price,
type, raw); rows without a name fall away. Spreadsheets, PDF files and images
need a reader that isn't here: pass their cells or text on to these functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzfolio.functions import numbers, strings
from quartzfolio.functions.similarity import jaro_winkler_of

#: Names that the columns of catalogs have, by field.
ALIASES: dict[str, tuple[str, ...]] = {
    "name": ("name", "nome", "product", "product_name", "service", "software", "title", "titolo"), "description": ("description", "descrizione", "desc", "features", "key_features"),
    "vendor": ("vendor", "brand", "provider", "supplier", "fornitore", "marca"), "category": ("category", "categoria", "tipo_prodotto", "subcategory"), "price": ("price", "prezzo", "cost", "monthly_cost", "price_usd", "unit_cost"),
    "budget": ("budget", "spesa"), "status": ("status", "stato"), "priority": ("priority", "priorita"), "owner": ("owner", "responsabile"), "type": ("type", "tipo", "item_type"), "sku": ("sku", "ean", "internal_id", "codice"),
    "quantity": ("quantity", "stock", "qty", "quantita"), "technologies": ("technologies", "tecnologie", "tags"),
}
ITEM_FIELDS = ("name", "description", "vendor", "category", "price", "type")


def plain_name(column: str) -> str:
    out = "".join(c if c.isalnum() or c == "_" else "_" for c in column.strip().lower())
    while "__" in out:
        out = out.replace("__", "_")
    return out.strip("_")


def likeness(column: str, alias: str) -> float:
    """1 if equal; less if one holds the other or both are spelled alike."""
    if column == alias:
        return 0.98
    held = 0.9 * min(len(column), len(alias)) / max(len(column), len(alias)) if column in alias or alias in column else 0.0
    spelled = jaro_winkler_of(column, alias)
    return max(held, 0.85 * spelled if spelled >= 0.85 else 0.0)


def map_columns(columns: Sequence[str], template: Mapping[str, str] | None = None, least: float = 0.6) -> dict[str, tuple[str, float]]:
    """Field and confidence of each column that has one: from the template, an
    exact alias or a similar one. A field is given to one column, exact ones first.
    Works on names alone, which the driver has."""
    out: dict[str, tuple[str, float]] = {}
    for c in columns:
        if template and c in template:
            out[c] = (template[c], 0.95)
    ranked = sorted(((-likeness(plain_name(c), a), i, f, c) for i, c in enumerate(columns) for f, names in ALIASES.items() for a in names), key=lambda x: x[:3])
    for s, _, field, c in ranked:
        if -s >= least and c not in out and field not in {f for f, _ in out.values()}:
            out[c] = (field, -s)
    return out


def to_items(rows: DataFrame, mapping: Mapping[str, tuple[str, float]] | None = None, kind: str = "product") -> DataFrame:
    """Items of any table: mapped columns become fields, the others ``raw``."""
    mapping = map_columns(rows.columns) if mapping is None else mapping
    of = {f: F.col(f"`{c}`") for c, (f, _) in mapping.items()}
    text = lambda f: F.nullif(F.trim(of[f].cast("string")), F.lit("")) if f in of else F.lit(None).cast("string")
    rest = [c for c in rows.columns if c not in mapping]
    raw = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest))) if rest else F.lit("{}")
    sure = sum(s for _, s in mapping.values()) / len(mapping) if mapping else 0.0
    price = numbers.currency(text("price")) if "price" in of else F.lit(None).cast("double")
    kinds = F.coalesce(F.when(F.lower(text("type")).isin("product", "service"), F.lower(text("type"))), F.lit(kind))
    out = rows.select(text("name").alias("name"), text("description").alias("description"), text("vendor").alias("vendor"), text("category").alias("category"), price.alias("price"), kinds.alias("type"), raw.alias("raw"))
    return out.where("name IS NOT NULL").withColumn("confidence", F.lit(round(sure, 6)))


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Rows of a CSV file as strings; the delimiter is that of its first line."""
    if sep is None:
        from quartzfolio.sources.formats import delimiter

        first = spark.read.text(path).limit(1).select(delimiter(F.col("value"))).first()
        sep = first[0] if first else ","
    return spark.read.csv(path, header=True, sep=sep, multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, escape='"', mode="PERMISSIVE")


def read_json_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON catalogs (an object with ``products`` or ``services``); files
    with neither give none."""
    entry = "array<struct<id:string,name:string,vendor:string,brand:string,category:string,description:string,pricing_model:string,aliases:array<string>,keywords:array<string>>>"
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", f"products {entry}, services {entry}").alias("j"))
    lists = F.array(*(F.struct(F.lit(k[:-1]).alias("type"), F.col(f"j.{k}").alias("x")) for k in ("products", "services")))
    rows = files.select(F.explode(lists).alias("l")).select("l.type", F.explode("l.x").alias("i")).select("type", "i.*")
    return rows.where("name IS NOT NULL").withColumn("vendor", F.coalesce("vendor", "brand")).drop("brand")


BULLET = r"^\s*(?:[-*•]|[0-9]+[.)])\s+"


def list_items(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item, name, description) of bulleted and numbered lists: lines after
    a bullet belong to it, lines before the first one to none."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "s"))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("bullet", F.col("s").rlike(BULLET)).withColumn("item", F.count_if("bullet").over(w)).where("item > 0")
    content = F.trim(F.regexp_replace("s", BULLET, ""))
    parts = lines.groupBy(key, "item").agg(F.max(F.when(F.col("bullet"), content)).alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("bullet") & (F.trim("s") != ""), F.struct("line", F.trim("s").alias("t"))))), lambda x: x["t"]), " ").alias("more"))
    name = F.trim(F.regexp_replace("head", r"(\s-\s|:\s|\s\().*$", ""))
    rest = F.trim(F.regexp_replace(F.substr("head", F.length(name) + 1), r"^[\s:(-]+|\)$", ""))
    return parts.where("head <> ''").select(key, "item", name.alias("name"), F.trim(F.concat_ws(" ", rest, "more")).alias("description"))


def markdown_rows(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, cells) of the rows of markdown tables, separators left out."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "s")).where(F.col("s").rlike(r"^\s*\|.*\|\s*$") & ~F.col("s").rlike(r"^[\s|:-]+$"))
    inner = F.regexp_replace("s", r"^\s*\||\|\s*$", "")
    return lines.select(key, "line", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))


def page_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def page_title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, "(?i)<title>([^<]*)</title>", 1), F.lit(""))


def from_json_text(text: Column, ddl: str) -> Column:
    """The object in a text that may have a fence or words around it; null if it
    can't be read."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), ddl)


def save_items(items: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by type; a shared folder on a cluster."""
    items.write.mode(mode).partitionBy("type").parquet(path)


def save_template(spark: SparkSession, path: str, columns: Sequence[str] = ITEM_FIELDS) -> None:
    """An empty CSV file with a header to fill in."""
    spark.range(0).select(*(F.lit("").alias(c) for c in columns)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def mermaid(edges: DataFrame) -> DataFrame:
    """Lines of a diagram for (src, dst, kind), in order: a row a line."""
    return edges.select("src", "dst", F.concat(F.lit("  n"), F.col("src").cast("string"), F.lit(" -->|"), "kind", F.lit("| n"), F.col("dst").cast("string")).alias("line"))


def rag_text(*columns: str) -> Column:
    """Fields of an item as lines, those without a value left out."""
    return F.concat_ws("\n", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c.title()}: "), F.col(c).cast("string"))) for c in columns))


def split_technologies(text: Column) -> Column:
    return strings.split_on(text)
