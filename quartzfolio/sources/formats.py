"""What a file or text is: magic bytes, content, delimiter, encoding, types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes of binary formats, in hexadecimal digits.
MAGIC = {"25504446": "pdf", "504B0304": "xlsx", "89504E47": "image", "FFD8FF": "image", "47494638": "image", "D0CF11E0": "excel"}
EXTENSIONS = {"csv": "csv", "tsv": "tsv", "txt": "text", "md": "text", "json": "json", "xlsx": "xlsx", "xls": "excel", "pdf": "pdf", "docx": "docx", "png": "image", "jpg": "image", "jpeg": "image", "html": "html", "htm": "html"}
DELIMITERS = (",", ";", "\t", "|")


def magic(content: Column) -> Column:
    """Format by the first bytes; null if none fits."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for digits, name in MAGIC.items():
        out = F.when(head.startswith(digits), name).otherwise(out)
    return out


def by_extension(name: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.try_element_at(kinds, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))


def count_of(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def delimiter(text: Column) -> Column:
    """The most frequent delimiter of the first line, the first of equals; a comma if it has none."""
    line = F.split_part(text, F.lit("\n"), F.lit(1))
    best = F.array_max(F.array(*(F.struct(count_of(line, d).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS))))
    return F.coalesce(best["d"], F.lit(","))


def sniff(text: Column) -> Column:
    """html, json, csv, tsv or text by content. Null and empty texts are text."""
    line = F.split_part(text, F.lit("\n"), F.lit(1))
    return (
        F.when(text.rlike("(?i)<(html|head|body|div|table|!doctype)"), "html")
        .when(text.rlike(r"^\s*[\[{]") & text.rlike(r"[\]}]\s*$"), "json")
        .when((count_of(line, ",") >= 2) | (count_of(line, ";") >= 2), "csv")
        .when(count_of(line, "\t") >= 2, "tsv")
        .otherwise("text")
    )


def encoding(content: Column) -> Column:
    """By byte order mark, else UTF-8 if valid, else Latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head.startswith("EFBBBF"), "utf-8").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be").when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("iso-8859-1")


#: What all values of a column must look like, tried in order.
TYPES = {
    "currency": r"^[€$£]?\s*[0-9][0-9.,]*\s*(€|\$|£|EUR|USD|k|K|M)?$", "number": r"^-?[0-9]+(\.[0-9]+)?", "date": r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})",
    "boolean": r"(?i)^(true|false|yes|no|si|sì|0|1)$",
}
