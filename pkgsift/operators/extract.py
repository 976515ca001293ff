"""Class extraction (E1-E11): one row per class match, features per file.

Every feature array is computed once per *file* (narrow projection, no
shuffle), then the class-name matches are exploded. ``content`` is dropped
right after the projection, so no shuffle ever carries file text.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import rx_all, rx_first, str_array, strip_ws

CLASS_COLUMNS = [
    "project_id", "class_pos", "class_name", "package", "file_path", "relative_path",
    "imports", "methods", "fields", "annotations", "extends", "implements",
    "class_type", "content_preview",
]


def package_of(content):
    """First package declaration, else 'default'."""
    return F.coalesce(F.nullif(rx_first(content, C.PACKAGE_RX), F.lit("")), F.lit("default"))


def imports_of(content):
    """All imported names (static and wildcard imports do not match)."""
    return rx_all(content, IMPORT_SCAN_RX)


# The scans below give the matches of the full patterns with less work at each
# place of the text: a place is left at its first letter unless a keyword can
# start there, a quantifier whose characters can't start what follows is possessive,
# and the class of type characters and whitespace is listed (one lookup, no ranges).
_TYPE_CHARS = "[" + string.ascii_letters + string.digits + r"_<>\[\], \t\n\x0B\f\r]"
IMPORT_SCAN_RX = r"import\s++([\w.]++)\s*+;"

# The optional visibility / modifier prefixes of the class pattern never change
# which names are captured (a prefix only moves a match's start to the left
# of the keyword it must be followed by, and no prefix word contains a
# keyword), so the scan uses the pattern without them: same captures, far
# less backtracking. The oracle runs the full pattern on every fixture file.
_NAME = r"([A-Za-z_]\w*+)"
CLASS_SCAN_RX = r"[cie](?:(?<=c)lass|(?<=i)nterface|(?<=e)num)\s++" + _NAME


def class_names_of(content):
    """Every class / interface / enum name match, comments included.

    A search for one word skips through the text, a choice of words looks at every place. So texts
    without the two rarer words are scanned for the first alone.
    """
    return (F.when(content.rlike("interface") | content.rlike("enum"), rx_all(content, CLASS_SCAN_RX))
            .otherwise(rx_all(content, r"class\s++" + _NAME)))


# In the method and field patterns the optional 'static ' / 'final ' groups
# are already covered by the following character class (letters and
# whitespace), and the captured name is always the identifier right before
# the first '(' (methods) or the first ';' / '=' (fields) after the
# visibility word. Dropping the groups keeps every match, its start, end and
# capture, and removes a 4-way backtracking fan-out. The oracle and the
# property test run the full patterns.
# All from the visibility word to that sign is type characters and whitespace, so
# a run of them that ends otherwise is left at once; and as whitespace is among
# them, one whitespace character each after the visibility word and before the
# name is enough, which leaves no nested quantifiers (linear on long blank runs).
def _member_rx(word: str, end: str) -> str:
    return word + r"\s(?=" + _TYPE_CHARS + "++" + end + ")" + _TYPE_CHARS + r"+\s" + _NAME + r"\s*+" + end


_VISIBILITY = r"p(?:ublic|rivate|rotected)"
METHOD_SCAN_RX = _member_rx(_VISIBILITY, r"\(") + r"[^)]*+\)"
FIELD_SCAN_RX = _member_rx(_VISIBILITY, "[;=]")


def _members(content, usual: str, others: tuple[str, str], end: str, tail: str = ""):
    """Member names: a scan for the usual visibility word alone where no other word can start a match."""
    possible = [content.rlike(w + r"\s" + _TYPE_CHARS + "++" + end) for w in others]
    return (F.when(possible[0] | possible[1], rx_all(content, _member_rx(_VISIBILITY, end) + tail))
            .otherwise(rx_all(content, _member_rx(usual, end) + tail)))


def methods_of(content):
    """Method names (visibility + type + name + parameter list)."""
    return _members(content, "public", ("private", "protected"), r"\(", r"[^)]*+\)")


def fields_of(content):
    """E5: field names, Java keywords removed."""
    kw = str_array(C.JAVA_KEYWORDS)
    return F.filter(_members(content, "private", ("public", "protected"), "[;=]"), lambda x: ~F.array_contains(kw, x))


def annotations_of(content):
    """Every '@Name' (Javadoc tags and e-mail hosts included)."""
    return rx_all(content, C.ANNOTATION_RX)


def extends_of(content):
    """First 'extends X', '' if none."""
    return rx_first(content, C.EXTENDS_RX)


def implements_of(content):
    """First implements clause split on commas and stripped; [] if none."""
    # the capture stands in one place, so the scan runs once
    found = F.filter(F.array(rx_first(content, C.IMPLEMENTS_RX)), lambda cap: cap != "")
    parts = F.flatten(F.transform(found, lambda cap: F.transform(F.split(cap, ",", -1), strip_ws)))
    return F.when(content.isNotNull(), parts)


def class_types_of(content, names):
    """Per name: 'interface ' + name in text -> interface, then enum, else class."""
    return F.transform(names, lambda n: (
        F.when(F.contains(content, F.concat(F.lit("interface "), n)), F.lit("interface"))
        .when(F.contains(content, F.concat(F.lit("enum "), n)), F.lit("enum"))
        .otherwise(F.lit("class"))))


def preview_of(content):
    """First 500 characters, newlines as blanks, carriage returns removed."""
    head = F.substring(content, 1, C.PREVIEW_CHARS)
    return F.replace(F.replace(head, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def file_features(java_files: DataFrame) -> DataFrame:
    """Per-file features; ``content`` is not carried further."""
    c = F.col("content")
    # class names first, so the type lookup below reuses them instead of
    # running the class scan a second time
    named = java_files.select("*", class_names_of(c).alias("class_names"))
    return named.select(
        "project_id", "file_path", "relative_path",
        package_of(c).alias("package"),
        imports_of(c).alias("imports"),
        "class_names",
        class_types_of(c, F.col("class_names")).alias("class_types"),
        methods_of(c).alias("methods"),
        fields_of(c).alias("fields"),
        annotations_of(c).alias("annotations"),
        extends_of(c).alias("extends"),
        implements_of(c).alias("implements"),
        preview_of(c).alias("content_preview"),
    )


def classes_from_files(java_files: DataFrame) -> DataFrame:
    """The class table, one row per class match (files without a match give none)."""
    feats = file_features(java_files)
    # Of a plain column that is exploded, Spark infers the filter "not empty" and pushes it below the
    # projections, where it runs the class scan twice more for each file; not so of an expression.
    names = F.coalesce(F.col("class_names"), F.array().cast("array<string>"))
    exploded = feats.select(
        "*", F.posexplode(names).alias("class_pos", "class_name"))
    return exploded.select(
        "project_id", F.col("class_pos").cast("int").alias("class_pos"), "class_name", "package",
        "file_path", "relative_path", "imports", "methods", "fields", "annotations", "extends",
        "implements",
        F.element_at("class_types", (F.col("class_pos") + 1).cast("int")).alias("class_type"),
        "content_preview",
    )
