"""Predicates and text functions of the asset index, as built-in column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that name nothing, identifiers of scaffolding, kinds of files by extension
NOISE = ("none", "default", "null", "true", "false", "any", "all")
SCAFFOLDING = ("Prototype", "Debug", "Template", "Filter", "Test")
FILE_KINDS = {
    "texture": ("png", "jpg", "jpeg", "tga"),
    "model": ("blockymodel", "bbmodel"),
    "audio": ("ogg", "wav", "mp3"),
    "ui": ("ui",),
}
LONGEST_VALUE, LONGEST_PATH = 96, 192
SHORTEST_STEM = 5


def is_noise(c: Column) -> Column:
    return F.lower(c).isin(*NOISE)


def asset_id_from_path(path: Column) -> Column:
    """The last segment without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def file_kind(path: Column) -> Column:
    """texture, model, audio, ui or other, by the extension."""
    kind = None
    for name, extensions in FILE_KINDS.items():
        test = extension(path).isin(*extensions)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind.otherwise("other")


def glob_prefix(glob: Column) -> Column:
    """The directories of a glob before its first wildcard."""
    return F.regexp_extract(glob, r"^((?:[^*?/]*/)*)", 1)


def locale_from_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"/Languages/([A-Za-z]{2}(?:-[A-Za-z0-9]+)?)/", 1), F.lit(""))


def is_leaf_value(value: Column) -> Column:
    """Whether a string is short enough to be kept as a leaf; paths may be longer."""
    n = F.length(F.trim(value))
    path = value.contains("/") & value.contains(".") & ~value.contains(" ")
    return n.between(1, F.when(path, LONGEST_PATH).otherwise(LONGEST_VALUE))


def follows_convention(pointer: Column) -> Column:
    """Whether a field's name says that it refers to an asset; case counts."""
    return pointer.rlike(r"(Id|/Set|/Model|/BlockType)$|/BlockTypes/|/BlockSets/")


def is_identifier(value: Column) -> Column:
    """Two characters or more, a letter first, an identifier character somewhere after, no space."""
    return value.rlike(r"(?s)^[A-Za-z].*[_A-Za-z0-9]") & ~value.contains(" ")


def is_container(declared_type: Column) -> Column:
    """Whether a declared type holds fields of its own; null is none."""
    return F.coalesce(declared_type.contains("object") | declared_type.contains("array") | declared_type.startswith("$ref") | declared_type.isin("anyOf", "oneOf"), F.lit(False))


def is_translation(value: Column) -> Column:
    return value.rlike(r"^(server|common)\.[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)+$")


def translation_key(value: Column) -> Column:
    """A translation reference without its root server. or common."""
    return F.regexp_replace(value, r"^(server|common)\.", "")


def is_scaffolding(identifier: Column) -> Column:
    return identifier.rlike(f"^({'|'.join(SCAFFOLDING)})_")


def family(identifier: Column) -> Column:
    """What stands before the first underscore, if that isn't first itself; else the whole."""
    return F.when(F.instr(identifier, "_") > 1, F.substring_index(identifier, "_", 1)).otherwise(identifier)


def parent_pointer(pointer: Column) -> Column:
    return F.regexp_replace(pointer, r"/[^/]*$", "")


def escape_segment(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def normalize_search(text: Column) -> Column:
    """Ideographs set apart, one letter for both spellings of Ukrainian ghe, white space squeezed."""
    spaced = F.regexp_replace(text, "([㐀-䶿一-鿿豈-﫿])", " $1 ")
    return F.trim(F.regexp_replace(F.translate(spaced, "Ґґ", "Гг"), r"(?U)\s+", " "))


def _accents() -> tuple[str, str]:
    """Latin letters with diacritics and what they are without, derived from their decompositions."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(i)) != chr(i)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without Latin diacritics."""
    return F.lower(F.translate(text, *_accents()))


def terms(text: Column) -> Column:
    """The folded words of a text, in order."""
    return F.filter(F.split(fold(normalize_search(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def expand_identifier(text: Column) -> Column:
    """The words of identifiers: parts between other characters, and those at changes of case, in order, once each; parts of one letter are dropped."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    # Fixed value: where an identifier's words meet, as the index has always cut them
    cut = r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    parts = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.filter(F.split(w, cut), lambda x: F.length(x) > 1))))
    return F.array_distinct(parts)


def relax(term: Column, by: int) -> Column:
    """A term less its last `by` letters, at least four being kept; short terms and ideographs stay."""
    fits = (F.length(term) >= SHORTEST_STEM) & ~term.rlike("[㐀-䶿一-鿿豈-﫿]")
    return F.when(fits, F.substring(term, F.lit(1), F.greatest(F.lit(SHORTEST_STEM - 1), F.length(term) - by))).otherwise(term)


def clip(text: Column, width: int) -> Column:
    """On one line, and no longer than width, an ellipsis included."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)
