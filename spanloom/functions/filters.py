"""Predicates built from small specifications."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from spanloom.functions.spans import WHITESPACE, _c
from spanloom.functions.text import era, lab

_NUMBER = r"-?[\d.]+"


def number_filter(col, text: str) -> Column:
    """'>5', '>=5', '<5', '<=5', '=5', '5' or '2..9'. NULL never passes."""
    col, text = _c(col), text.strip()
    between = re.fullmatch(rf"({_NUMBER})\.\.({_NUMBER})", text)
    if between:
        test = col.between(float(between[1]), float(between[2]))
    else:
        parts = re.fullmatch(rf"(>=|<=|>|<|=)?\s*({_NUMBER})", text)
        if not parts:
            return F.lit(True)
        value = float(parts[2])
        test = {">": col > value, "<": col < value, ">=": col >= value, "<=": col <= value}.get(
            parts[1], col == value)
    return F.coalesce(test, F.lit(False))


def text_filter(col, text: str) -> Column:
    """'abc' contains, '!abc' does not, '=abc' equals; case does not matter."""
    low = F.lower(F.coalesce(_c(col), F.lit("")))
    sign, wanted = (text[0], text[1:].lower()) if text[:1] in ("!", "=") else ("", text.lower())
    if not wanted:
        return F.lit(True)
    if sign == "=":
        return low == wanted
    return ~low.contains(wanted) if sign == "!" else low.contains(wanted)


def column_filter(df, conditions: dict):
    """Keep the rows that pass every {column: specification}."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in (
        "integer", "long", "double", "float", "short", "byte") or f.dataType.typeName().startswith("decimal")}
    for name, spec in conditions.items():
        df = df.filter((number_filter if name in numeric else text_filter)(name, spec))
    return df


def band(df, col: str, low, high):
    """Rows with ``col`` from ``low`` to ``high``, both included; NULL is in no band."""
    return df.filter(F.col(col).between(low, high))


def line_cap(df, col: str, cap: int = 700):
    """Lines that are not blank and have at most ``cap`` characters."""
    return df.filter((F.length(col) <= cap) & (F.btrim(F.col(col), F.lit(WHITESPACE)) != ""))


def facet(df, writer=None, period=None, word=None, contains=None, noun=None, voice=None, *,
          model="model", date="released", words="words", sentences="sentences", nouns="nouns", voices="voice"):
    """AND of the given facets. ``writer`` is a model or 'lab/*'."""
    tests = []
    if writer:
        tests.append(lab(model) == writer[:-2] if writer.endswith("/*") else F.col(model) == writer)
    if period:
        tests.append(era(date) == period)
    if word:
        tests.append(F.array_contains(words, word))
    if contains:
        needle = contains.lower()
        tests.append(F.exists(sentences, lambda s: F.lower(s).contains(needle)))
    if noun:
        tests.append(F.array_contains(nouns, noun))
    if voice:
        tests.append(F.col(voices).contains(voice))
    for test in tests:
        df = df.filter(test)
    return df


def not_in_stoplist(df, stoplist, name: str, col: str = "norm"):
    """Drop captures whose norm is in the named stoplist (columns name, word)."""
    listed = stoplist.filter(F.col("name") == name).select(F.col("word").alias(col)).distinct()
    return df.join(listed, col, "left_anti")


# Words of fear, and what negates them within three words.
FEAR = r"\b(afraid|fear(s|ed|ful)?|terror|terrified|dread(s|ed)?|frighten(ed|ing)?|anxious|anxiety|panic)\b"
FEAR_NEGATED = (r"\b(not|no|nor|never|without|neither|un)\W{0,3}(\w+\W+){0,3}"
                r"(afraid|fear|terror|dread|frighten|anxi|panic)")


def term_with_negation(sentence, term=FEAR, negated=FEAR_NEGATED) -> Column:
    """struct<any,negated> of one sentence."""
    s = _c(sentence)
    hit = s.rlike("(?iU)" + term)
    return F.struct(hit.alias("any"), (hit & s.rlike("(?iU)" + negated)).alias("negated"))
