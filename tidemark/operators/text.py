"""Checks of text: numbers that must be traceable, claims that must be qualified, fault plans.

A number that a text states is found by a scan in steps, not by one pattern: what is quoted goes (code, link targets,
markup), the rest is cut into runs of word characters, dots and commas, runs that follow ``#``, ``/`` or ``-`` are parts
of names, paths and ranges and go, and the fields between commas of the others are put together where they are groups of
thousands. It is traceable if a known number, rounded to as many places, equals it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most decimal places that a stated number is compared at.
MOST_PLACES = 15


def between(text: Column, opening: str, closing: str, put: str = "") -> Column:
    """A text without what stands from an opening mark to the next closing one; ``put`` takes its place. An opening mark
    that nothing closes stays."""
    part = lambda p: F.when(F.instr(p, closing) > 0, F.concat(F.lit(put), F.substr(p, F.instr(p, closing) + F.lit(len(closing))))).otherwise(F.concat(F.lit(opening), p))
    parts = F.split(text, _literal(opening))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(part(p))), "")


def outside(text: Column, mark: str) -> Column:
    """A text without what stands between pairs of one mark; a last mark without a partner stays."""
    parts = F.split(text, _literal(mark))
    lone = lambda i: (F.size(parts) % 2 == 0) & (i == F.size(parts) - 1)
    kept = F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).when(lone(i), F.concat(F.lit(mark), p)).otherwise(F.lit("")))
    return F.array_join(kept, "")


def _literal(mark: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in mark)


def stated(text: Column) -> Column:
    """A text without fenced code, code in a line, link targets and markup."""
    unfenced = F.substr(outside(F.concat(F.lit("\n"), text), "\n```"), F.lit(2))
    lines = F.transform(F.split(unfenced, "\n"), lambda line: between(outside(line, "`"), "](", ")", "]"))
    return between(F.array_join(lines, "\n"), "<", ">")


def _joined(fields: Column) -> Column:
    """Fields between commas, those that are groups of thousands put together."""
    group = lambda f: F.length(F.split_part(f, F.lit("."), F.lit(1))) == 3
    open_end = lambda f: F.length(F.split_part(f, F.lit(","), F.lit(1))).between(1, 3) & ~F.contains(f, F.lit("."))

    def step(done: Column, field: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        fits = _is_number(field) & group(field) & _is_number(F.replace(last, F.lit(","), F.lit(""))) & open_end(last)
        return F.when(fits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit(","), field)))).otherwise(F.concat(done, F.array(field)))

    return F.aggregate(fields, F.expr("cast(array() as array<string>)"), step)


def _is_number(field: Column) -> Column:
    """Digits, or digits, one dot and digits."""
    return F.rlike(field, F.lit(r"^[0-9]+(?:[.][0-9]+)?$"))


def numbers(texts: DataFrame, key: str, column: str) -> DataFrame:
    """``key, number, places``: every number that a text states, and how many decimal places it has."""
    marked = F.regexp_replace(stated(F.col(column)), r"[#/-][\w.,]*", " ")  # what follows these goes with them
    runs = F.filter(F.split(marked, r"[^\w.,]+"), lambda r: r != "")
    found = F.filter(F.flatten(F.transform(runs, lambda r: _joined(F.split(r, ",")))), lambda f: _is_number(F.replace(f, F.lit(","), F.lit(""))))
    raw = texts.select(key, F.explode(F.transform(found, lambda f: F.replace(f, F.lit(","), F.lit("")))).alias("raw"))
    places = F.length(F.split_part("raw", F.lit("."), F.lit(2)))
    return raw.select(key, F.col("raw").cast("double").alias("number"), places.alias("places")).distinct()


def leaves(value: Any) -> Iterator[float]:
    """Every number in a parsed JSON value at any depth, and every key that is one; true and false are none."""
    if isinstance(value, dict):
        for name, inner in value.items():
            if name.lstrip("-").replace(".", "", 1).isdecimal() and name[-1] != "." and name.count("-") <= 1 and name.lstrip("-")[0] != ".":
                yield float(name)
            yield from leaves(inner)
    elif isinstance(value, list):
        for inner in value:
            yield from leaves(inner)
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        yield float(value)


@F.udtf(returnType="number double")
class JsonNumbers:
    """Numbers of a JSON text; a text that is no JSON has none."""

    def eval(self, text: str) -> Iterator[tuple[float]]:
        try:
            parsed = json.loads(text) if text is not None else None
        except ValueError:
            return
        for number in leaves(parsed):
            yield (number,)


@F.udtf(returnType="places int, rounded double")
class Rounded:
    """A number rounded to each of some places, as Python rounds: exactly, halves to even."""

    def eval(self, number: float, places: list) -> Iterator[tuple[int, float]]:
        for n in places or ():
            yield n, round(number, n)


def json_numbers(texts: DataFrame, column: str) -> DataFrame:
    """``number``: every number inside JSON texts, at any depth, and every key that is a number."""
    return texts.select(F.col(column).alias("_json")).lateralJoin(JsonNumbers(F.col("_json").outer())).select("number")


def untraceable(stated: DataFrame, known: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Stated numbers (``number``, ``places``) that no known ``number`` equals when it is rounded to as many places, and
    that ``allowed`` (``number``) does not name. Known numbers are rounded to the places that occur (at most 15, so a
    list of a few numbers), and the join is by equality, so known numbers may be many."""
    used = [r[0] for r in stated.where(F.col("places") <= MOST_PLACES).select("places").distinct().collect()]
    asked = known.select("number").where("number IS NOT NULL").distinct().select("number", F.array(*map(F.lit, sorted(used))).cast("array<int>").alias("_places"))
    near = asked.lateralJoin(Rounded(F.col("number").outer(), F.col("_places").outer())).select("places", F.col("rounded").alias("number")).distinct()
    out = stated.join(near, ["places", "number"], "left_anti")
    if allowed is not None:
        out = out.join(allowed.select("number").distinct(), "number", "left_anti")
    return out.select(*stated.columns)


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after a full stop, question or exclamation mark, and at line ends."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def bare_claims(texts: DataFrame, key: str, column: str, terms: list[str], qualifiers: list[str]) -> DataFrame:
    """``key, sentence`` of sentences with a term and no qualifier."""
    one_of = lambda words: r"(?i)(?:^|[^\p{L}\p{N}])(?:" + "|".join(words) + r")(?:[^\p{L}\p{N}]|$)"
    each = texts.select(key, F.explode(sentences(F.col(column))).alias("sentence"))
    return each.where(F.col("sentence").rlike(one_of(terms)) & ~F.col("sentence").rlike(one_of(qualifiers)))


def parse_fault(plan: Column) -> tuple[Column, Column]:
    """(fault, selectors) of ``F3:wf=a:seq=2``."""
    fault = F.split_part(plan, F.lit(":"), F.lit(1))
    rest = F.regexp_replace(plan, "^[^:]*:?", "")
    return fault, F.when(rest == "", F.expr("cast(map() as map<string,string>)")).otherwise(F.str_to_map(rest, F.lit(":"), F.lit("=")))


def fault_matches(selectors: Column, values: dict[str, Column]) -> Column:
    """Whether all selectors that a plan gives hold; one that it leaves out holds for all."""
    out = F.lit(True)
    for name, value in values.items():
        wanted = F.try_element_at(selectors, F.lit(name))
        out = out & (wanted.isNull() | (wanted == value.cast("string")))
    return out
