"""Text expressions: tokens, queries, kinds, previews and embedding inputs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

EMBED_BYTES, PREVIEW_CHARS = 2000, 300
#: Stored tag of a chunk -> how it is shown.
KINDS = {
    "function": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "class": "class",
    "method": "method", "type_decl": "type", "block_mapping": "mapping", "expression": "expression", "section": "section",
}
#: Tags that older tables have.
LEGACY = {"function_item": "function", "function_definition": "function", "function_declaration": "function", "struct_item": "struct", "enum_item": "enum", "trait_item": "trait", "impl_item": "impl", "class_definition": "class", "method_declaration": "method", "type_declaration": "type_decl", "type_spec": "type_decl", "block_mapping_pair": "block_mapping", "expression_statement": "expression"}


def _plain() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without."""
    marked = [c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


def fold(c: Column) -> Column:
    """Lower case without accents (Latin letters and combining marks)."""
    return F.lower(F.regexp_replace(F.translate(c, *_plain()), r"\p{Mn}+", ""))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sanitize_query(c: Column) -> Column:
    """Words of letters, digits and underscores, each in double quotes."""
    return F.array_join(F.transform(F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: x != ""), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " ")


def query_terms(query: str) -> list[list[str]]:
    """A query's terms, each a phrase of tokens; repeated terms are kept, terms without tokens are not."""
    import re

    out = []
    for word in re.findall(r"\w+", query):
        plain = "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn").lower()
        if phrase := re.findall(r"[^\W_]+", plain):
            out.append(phrase)
    return out


def kind_from_tag(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for k, v in {**LEGACY, **{k: k for k in KINDS}}.items() for x in (k, v)))
    return F.coalesce(F.try_element_at(known, c), F.lit("function"))


def kind_shown(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), c), c)


def embed_input(kind: Column, name: Column, path: Column, text: Column) -> Column:
    return F.concat(kind, F.lit(" "), name, F.lit(" in "), path, F.lit("\n\n"), text)


def embed_text(c: Column, limit: int = EMBED_BYTES) -> Column:
    """The longest prefix of whole characters within `limit` bytes."""
    raw = F.encode(c, "UTF-8")
    head = F.substring(raw, 1, limit)
    whole = F.expr("0")
    for back in (1, 2, 3):  # bytes of a last character that is cut: its first byte says how many it has
        lead = F.conv(F.hex(F.substring(head, F.lit(limit - back + 1), F.lit(1))), 16, 10).cast("int")
        needs = F.when(lead >= 240, 4).when(lead >= 224, 3).when(lead >= 192, 2).otherwise(0)
        whole = F.when((whole == 0) & (needs > back), back).otherwise(whole)
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.decode(F.substring(head, F.lit(1), F.lit(limit) - whole), "UTF-8"))


def preview(c: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.left(c, F.lit(chars))
