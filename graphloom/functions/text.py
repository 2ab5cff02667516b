"""Text functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and anything beyond ASCII: what is between other characters (regexp_extract_all
    copies the text for every match)."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), BETWEEN), "")


def clean_markdown(c: Column) -> Column:
    """Without front matter, comments, div tags (their bodies stay) and images; trimmed."""
    for pattern in (r"^---[\s\S]*?---", r"<!--[\s\S]*?-->", r"</?div[^>]*>", r"!\[[^\]]*\]\([^)]*\)"):
        c = F.regexp_replace(c, pattern, "")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse_space(c: Column) -> Column:
    """At most one blank line and one space in a row."""
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r" {2,}", " ")


def toc_links(c: Column) -> Column:
    """Module files of a table of contents, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\(contents/(m.*?\.md)\)"), F.lit(1)))


def preview(c: Column, size: int = 200) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def contains_ci(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def word_chunks(c: Column, size: int = 512) -> Column:
    """Array of texts of size words each, without overlap."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def title_case(c: Column) -> Column:
    """Each letter that follows no letter upper, the other letters lower."""
    chars = F.filter(F.split(F.lower(c), ""), lambda x: x != "")
    return F.array_join(F.transform(chars, lambda x, i: F.when((i == 0) | ~F.rlike(F.coalesce(F.get(chars, i - 1), F.lit("")), F.lit(r"\p{L}")), F.upper(x)).otherwise(x)), "")


def fenced_json(c: Column) -> Column:
    """Body of a ```json block, else of any ``` block, else the trimmed text."""
    tagged = F.regexp_extract(c, r"```json([\s\S]*?)```", 1)
    fenced = F.regexp_extract(c, r"```([\s\S]*?)```", 1)
    return F.trim(F.when(F.contains(c, F.lit("```json")), tagged).when(F.contains(c, F.lit("```")), fenced).otherwise(c))


def numbered_context(texts: Column) -> Column:
    """[1] first, blank line, [2] second and so on."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n\n")


def read_only(c: Column) -> Column:
    """Whether a graph query holds no write operation outside of string literals."""
    return ~F.rlike(F.regexp_replace(c, "'[^']*'|\"[^\"]*\"", ""), F.lit(r"(?i)\b(CREATE|DELETE|DETACH|REMOVE|SET|MERGE|DROP|CALL\s*\{)"))


def asks_to_write(c: Column) -> Column:
    """Whether a question asks for a change of the data."""
    return F.rlike(c, F.lit(r"(?i)\b(delete|remove|drop|destroy|truncate|erase|wipe|detach)\b"))


def client_key(forwarded: Column, address: Column) -> Column:
    """First of X-Forwarded-For, else the address."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(F.coalesce(F.length(forwarded), F.lit(0)) > 0, first).otherwise(address)


def tenant_label(prefix: str, label: str) -> str:
    return f"{prefix}_{label}" if prefix else label
