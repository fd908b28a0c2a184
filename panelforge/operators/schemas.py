"""Nested document schemas, compiled to one column that holds the first violation by path.

A schema is made of the functions below; `violation` turns it into a Column over a VARIANT value,
so all documents of a table are checked in one projection. Violations are in order of their paths:
a node's own come before those in it, names in alphabetical order, items by number. The text is
`path: rule`, with names and item numbers separated by slashes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    kind: str
    null: bool = False
    low: float | None = None
    high: float | None = None
    values: tuple | None = None
    item: Node | None = None
    names: dict[str, Node] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    others: bool = True


def number(low: float | None = None, high: float | None = None, null: bool = False) -> Node:
    return Node("number", null, low, high)


def whole(low: int | None = None, high: int | None = None, null: bool = False) -> Node:
    return Node("whole", null, low, high)


def text(values: tuple[str, ...] | None = None, null: bool = False) -> Node:
    return Node("text", null, values=values)


def const(value: str) -> Node:
    return Node("text", values=(value,))


def flag() -> Node:
    return Node("flag")


def items(item: Node, least: int | None = None, most: int | None = None, depth: int = 1, null: bool = False) -> Node:
    """An array, of arrays where depth is more than one; least and most count the innermost items."""
    inner = Node("array", null if depth == 1 else False, least, most, item=item)
    return inner if depth == 1 else items(inner, depth=depth - 1, null=null)


def fields(names: dict[str, Node], optional: tuple[str, ...] = (), others: bool = True, null: bool = False) -> Node:
    """An object; all names but the optional ones must be there."""
    return Node("object", null, names=names, required=tuple(n for n in names if n not in optional), others=others)


_WORDS = {"number": "a number", "whole": "a whole number", "text": "a text", "flag": "true or false", "array": "an array", "object": "an object"}


def _is(kind: str, value: Column, held: Column | None) -> Column:
    """held: an array's items. The schema of a value is asked for where it is a single one: that of a container
    reads all that is in it, at each depth again."""
    if kind == "array":
        return held.isNotNull()
    if kind == "object":
        return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()
    found = F.schema_of_variant(value)
    if kind in ("number", "whole"):
        numeric = found.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
        if kind == "number":
            return numeric
        as_double = F.try_variant_get(value, "$", "double")
        return numeric & (found.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | (as_double == F.floor(as_double)))
    return {"text": found == "STRING", "flag": found == "BOOLEAN"}[kind]


def _at(name: str) -> str:
    return f"$['{name}']"


def _said(path: Column, rule: str) -> Column:
    return F.concat(path, F.lit(f": {rule}"))


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def violation(node: Node, value: Column, path: Column | None = None) -> Column:
    """The first violation of a VARIANT value that isn't SQL null, or null."""
    path = F.lit("") if path is None else path
    if node.kind == "array":
        out = _let(F.try_variant_get(value, "$", "array<variant>"), lambda held: _first(node, value, path, held))
    else:
        out = _first(node, value, path, None)
    return F.when(~F.is_variant_null(value), out) if node.null else out


def _first(node: Node, value: Column, path: Column, held: Column | None) -> Column:
    """The first violation of a value that may not be null. held: the items, if it should be an array."""
    below = lambda part: F.when(path == "", part).otherwise(F.concat(path, F.lit("/"), part))
    named = lambda n: lambda v: F.when(v.isNotNull(), violation(node.names[n], v, below(F.lit(n))))
    wrong = ~_is(node.kind, value, held)
    own: list[tuple[Column, str]] = []
    inner: list[Column] = []
    if node.kind in ("number", "whole"):
        v = F.try_variant_get(value, "$", "double")
        own += [(v < node.low, f"below {node.low}")] if node.low is not None else []
        own += [(v > node.high, f"above {node.high}")] if node.high is not None else []
    elif node.kind == "text" and node.values is not None:
        own.append((~F.try_variant_get(value, "$", "string").isin(*node.values), "not one of " + ", ".join(node.values)))
    elif node.kind == "array":
        own += [(F.size(held) < node.low, f"fewer than {node.low} items")] if node.low is not None else []
        own += [(F.size(held) > node.high, f"more than {node.high} items")] if node.high is not None else []
        each = F.transform(held, lambda x, i: violation(node.item, x, below(i.cast("string"))))
        inner.append(F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0)))
    elif node.kind == "object":
        own += [(F.try_variant_get(value, _at(n), "variant").isNull(), f"{n} is missing") for n in node.required]
        if not node.others:
            extra = F.filter(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), lambda k: ~k.isin(*node.names))
            own.append((F.size(extra) > 0, "a name that isn't known"))
        for n in sorted(node.names):
            there = F.try_variant_get(value, _at(n), "variant")
            inner.append(_let(there, named(n)))
    cases = F.when(wrong, _said(path, f"not {_WORDS[node.kind]}"))
    for broken, rule in own:
        cases = cases.when(broken, _said(path, rule))
    # what is in a value of the wrong kind isn't looked at, as its case comes first
    return F.coalesce(cases, *inner) if inner else cases


def violations(documents: DataFrame, node: Node, column: str = "value") -> DataFrame:
    """documents (JSON texts in a column) with their first violation, null where there is none."""
    parsed = documents.withColumn("_v", F.try_parse_json(column))
    return parsed.withColumn("violation", F.when(F.col("_v").isNull(), ": not JSON").otherwise(violation(node, F.col("_v")))).drop("_v")


def check(documents: DataFrame, node: Node, column: str = "value") -> DataFrame:
    """documents, if none breaks its schema; else ValueError with the first violation by path."""
    bad = violations(documents, node, column).where(F.col("violation").isNotNull()).agg(F.min("violation").alias("first"), F.count(F.lit(1)).alias("n")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} documents break their schema, first at {bad['first']}")
    return documents


#: Published documents, a JSON text each.
DETECTIONS = fields({"schema": const("detections"), "year": whole(2000, 2100), "period": whole(1, 46), "s": items(whole(0, 4)), "t": items(whole()), "frp": items(number(0, null=True)), "x": items(whole(0, 2)), "u": items(whole(-1))})
DAILY = fields({"schema": const("daily"), "year": whole(2000, 2100), "days": whole(365, 366), "seen": items(whole(-1, 100), 365, 366, depth=2)})
SNAPSHOT = fields({"schema": const("snapshot"), "year": whole(2000, 2100), "units": items(whole()), "verdict": items(whole(-1, 8), 46, 46, depth=2), "raw": items(whole(0, null=True), 46, 46, depth=2)})
