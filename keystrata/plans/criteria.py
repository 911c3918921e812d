"""Criteria: an AND/OR tree of leaves, parsed from requests."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from .types import RequestError

MAX_DEPTH = 16

#: Fixed value: operator names and their synonyms.
NAMES = {
    "eq": "equal", "neq": "not_equal", "lt": "less", "gt": "greater", "lte": "less_eq", "gte": "greater_eq",
    "like": "", "not_like": "nlike", "contains": "", "not_contains": "ncontains", "starts_with": "starts", "ends_with": "ends",
    "in": "", "not_in": "nin", "between": "", "exists": "", "not_exists": "nexists",
    "len_eq": "", "len_neq": "", "len_lt": "", "len_gt": "", "len_lte": "", "len_gte": "", "len_between": "",
    "ilike": "", "not_ilike": "inlike inot_like", "icontains": "", "not_icontains": "incontains inot_contains", "istarts_with": "istarts", "iends_with": "iends",
    "eq_field": "", "neq_field": "", "lt_field": "", "gt_field": "", "lte_field": "", "gte_field": "",
    "regex": "", "not_regex": "nregex",
}
OPERATORS = {alias: name for name, others in NAMES.items() for alias in (name, *others.split())}


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: Any = None
    value2: Any = None

    def listed(self) -> list[Any]:
        """Values of in / not_in: a list, or text separated by commas."""
        if isinstance(self.value, (list, tuple)):
            return list(self.value)
        return [] if self.value is None else [x.strip() for x in str(self.value).split(",")]


@dataclass(frozen=True)
class All:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Any_:
    children: tuple[Node, ...]


Node = Leaf | All | Any_


def operator(name: str, lenient: bool = False) -> str:
    op = OPERATORS.get(name)
    if op is None:
        if lenient:
            return "eq"
        raise RequestError(f"unknown operator: {name}")
    return op


def _leaf(item: dict, lenient: bool) -> Leaf:
    if not item.get("field"):
        raise RequestError("criterion without a field")
    op = operator(item.get("op", "eq"), lenient)
    value, value2 = item.get("value"), item.get("value2")
    if op in ("between", "len_between") and value2 is None:
        if isinstance(value, (list, tuple)) and len(value) == 2:
            value, value2 = value
        else:
            raise RequestError(f"{op} needs value and value2")
    return Leaf(item["field"], op, value, value2)


def _node(item: Any, depth: int, lenient: bool) -> Node:
    if depth > MAX_DEPTH:
        raise RequestError(f"criteria are nested deeper than {MAX_DEPTH}")
    if not isinstance(item, dict):
        raise RequestError("a criterion must be an object")
    for name, kind in (("or", Any_), ("and", All)):
        if name in item:
            children = item[name]
            if not isinstance(children, list) or not children:
                raise RequestError(f"empty {name}")
            return kind(tuple(_node(x, depth + 1, lenient) for x in children))
    return _leaf(item, lenient)


def parse(criteria: Any, lenient: bool = False) -> Node | None:
    """A list (all must hold), an ``and`` / ``or`` object, one leaf, or ``{field: value}`` equalities."""
    if isinstance(criteria, str):
        try:
            criteria = json.loads(criteria) if criteria.strip() else None
        except ValueError:
            raise RequestError("criteria aren't valid JSON") from None
    if criteria is None or criteria == [] or criteria == {}:
        return None
    if isinstance(criteria, list):
        return All(tuple(_node(x, 1, lenient) for x in criteria))
    if not isinstance(criteria, dict):
        raise RequestError("criteria must be an array or an object")
    if "or" in criteria or "and" in criteria or "field" in criteria:
        return _node(criteria, 0, lenient)
    return All(tuple(Leaf(k, "eq", v) for k, v in criteria.items()))
