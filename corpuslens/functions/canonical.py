"""Canonical names, types and labels of graph entities."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import collapse_ws, let

DEFAULT_LABEL, LABEL_CHARS = "相关", 8

# fixed values: the relation classes, and the classes of older names of relations
RELATION_CLASSES = ["RELATED", "STRUCTURAL", "FUNCTIONAL", "CAUSAL", "SEQUENCE", "OWNERSHIP", "COMPARISON", "CONSTRAINT"]
RELATION_ALIASES = {
    "RELATED_TO": "RELATED",
    "RELATES_TO": "RELATED",
    "HAS": "STRUCTURAL",
    "HAS_PART": "STRUCTURAL",
    "PART_OF": "STRUCTURAL",
    "CONTAINS": "STRUCTURAL",
    "INCLUDES": "STRUCTURAL",
    "TYPE_OF": "STRUCTURAL",
    "INSTANCE_OF": "STRUCTURAL",
    "IS_A": "STRUCTURAL",
    "USES": "FUNCTIONAL",
    "USED_FOR": "FUNCTIONAL",
    "BUILT_WITH": "FUNCTIONAL",
    "CALLS": "FUNCTIONAL",
    "READS": "FUNCTIONAL",
    "WRITES": "FUNCTIONAL",
    "STORES": "FUNCTIONAL",
    "QUERIES": "FUNCTIONAL",
    "CREATES": "FUNCTIONAL",
    "PRODUCES": "FUNCTIONAL",
    "CONSUMES": "FUNCTIONAL",
    "CONFIGURES": "FUNCTIONAL",
    "IMPLEMENTS": "FUNCTIONAL",
    "CAUSES": "CAUSAL",
    "CAUSED_BY": "CAUSAL",
    "RESULTS_IN": "CAUSAL",
    "LEADS_TO": "CAUSAL",
    "TRIGGERS": "CAUSAL",
    "NOTIFIES": "CAUSAL",
    "NOTIFIES_ABOUT": "CAUSAL",
    "PRECEDES": "SEQUENCE",
    "FOLLOWS": "SEQUENCE",
    "OWNS": "OWNERSHIP",
    "OWNED_BY": "OWNERSHIP",
    "MANAGES": "OWNERSHIP",
    "MANAGED_BY": "OWNERSHIP",
    "CONTROLLED_BY": "OWNERSHIP",
    "COMPARED_WITH": "COMPARISON",
    "CONTRASTS_WITH": "COMPARISON",
    "ALTERNATIVE_TO": "COMPARISON",
    "SIMILAR_TO": "COMPARISON",
    "EVALUATES": "COMPARISON",
    "REQUIRES": "CONSTRAINT",
    "DEPENDS_ON": "CONSTRAINT",
    "GOVERNED_BY": "CONSTRAINT",
    "PROTECTS_AGAINST": "CONSTRAINT",
    "PREVENTS": "CONSTRAINT",
    "AVOIDS": "CONSTRAINT",
}


def nfkc(x: str | Column) -> Column:
    """Compatibility composition; Spark has no built-in for it."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))

    return F.pandas_udf(run, "string")(x)


def canonical_name(x: str | Column) -> Column:
    return F.lower(collapse_ws(nfkc(x)))


def canonical_names(names: Column) -> Column:
    """:func:`canonical_name` of each of an array of names; Python gets the arrays that aren't all ASCII only."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else [v if v is None else unicodedata.normalize("NFKC", v) for v in a])

    composed = F.pandas_udf(run, "array<string>")(F.when(F.exists(names, lambda v: v.rlike(r"[^\x00-\x7F]")), names))
    return F.transform(F.coalesce(composed, names), lambda v: F.lower(collapse_ws(v)))


def snake_upper(x: str | Column, default: str) -> Column:
    """Letters and digits in capitals, anything between them as one underscore; ``default`` if nothing is left."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{Nd}]+", "_"), "^_+|_+$", "")
    return let(out, lambda v: F.when(v == "", F.lit(default)).otherwise(v))


def node_type(x: str | Column) -> Column:
    return snake_upper(x, "ENTITY")


def relation_type(x: str | Column) -> Column:
    """One of the relation classes: by its own name, by an older name, or RELATED."""
    known = {c: c for c in RELATION_CLASSES} | RELATION_ALIASES
    table = F.create_map(*[F.lit(v) for pair in known.items() for v in pair])
    return F.coalesce(F.try_element_at(table, snake_upper(x, "RELATED")), F.lit("RELATED"))


def display_label(x: str | Column) -> Column:
    """A short Han label without white space or Latin letters, or the default."""
    x = F.col(x) if isinstance(x, str) else x

    def shortened(v: Column) -> Column:
        good = (F.length(v) <= LABEL_CHARS) & v.rlike(r"\p{IsHan}") & ~v.rlike("[A-Za-z]")
        return F.when(good, v).otherwise(F.lit(DEFAULT_LABEL))

    return let(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", ""), shortened)


def shown(x: str | Column, most: int) -> Column:
    x = collapse_ws(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))
    return F.btrim(F.substring(x, 1, most))


def relation_description(source: Column, target: Column, label: Column, text: Column, most: int = 280) -> Column:
    """The text if it has a Han character, else a sentence made of the ends and the label."""
    own, a, b, name = shown(text, most), shown(source, 120), shown(target, 120), display_label(label)
    made = F.concat(F.when(a != "", F.concat(a, F.lit(" "))).otherwise(""), name, F.when(b != "", F.concat(F.lit(" "), b)).otherwise(""), F.lit("。"))
    return F.when(own.rlike(r"\p{IsHan}"), own).otherwise(shown(made, most))


def evidence_text(x: Column) -> Column:
    """Text as evidence is compared: compatibility forms composed, lower case, without white space and punctuation."""
    # texts in ASCII have no other forms; Python gets nulls in their place
    composed = F.coalesce(nfkc(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x)
    return F.regexp_replace(F.lower(composed), r"[\s\p{P}\p{Z}]+", "")


def quote_found(content: Column, quote: Column, prepared: bool = False) -> Column:
    """Whether a quote stands in a content; ``prepared`` says that the content is evidence text already."""
    c = content if prepared else evidence_text(F.coalesce(content, F.lit("")))
    q = evidence_text(F.coalesce(quote, F.lit("")))
    return (q != "") & F.contains(c, q)
