"""Field types: specs, Spark types, zero values and literals.

A value that a record lacks is NULL. Where a predicate would hold for the type's zero value, the
compiler adds the NULL case, so that absence behaves as that zero without rewriting any data."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field, replace
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from typing import Any

from pyspark.sql import types as T

INTEGERS = {"int": (T.IntegerType(), -(2**31), 2**31 - 1), "long": (T.LongType(), -(2**63), 2**63 - 1), "short": (T.ShortType(), -(2**15), 2**15 - 1), "byte": (T.ShortType(), 0, 255)}
NUMBERS = {*INTEGERS, "double", "numeric"}
TIMES = {"date", "datetime"}
MAX_FIELDS = 256
NAME = re.compile(r"[^:+/\s]+\Z")


class RequestError(ValueError):
    """A request that can't be planned or carried out; the text goes to the client."""


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    size: int = 0  # bytes of a varchar, precision of a numeric
    scale: int = 0
    default: str | None = None  # literal, auto_create, auto_update, seq(name), uuid(), random(n)
    removed: bool = False

    @property
    def spark_type(self) -> T.DataType:
        if self.kind in INTEGERS:
            return INTEGERS[self.kind][0]
        if self.kind == "numeric":
            return T.DecimalType(min(38, max(self.size, self.scale + 1)), self.scale)
        return {"varchar": T.StringType(), "double": T.DoubleType(), "bool": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType()}[self.kind]

    @property
    def spec(self) -> str:
        param = {"varchar": f":{self.size}", "numeric": f":{self.size},{self.scale}"}.get(self.kind, "")
        rule = "" if self.default is None else f":{self.default}" if self.default.startswith("auto_") else f":default={self.default}"
        return f"{self.name}:{self.kind}{param}{rule}"

    @property
    def width(self) -> int:
        """Bytes of a packed value."""
        return {"varchar": self.size + 2, "int": 4, "long": 8, "short": 2, "byte": 1, "double": 8, "bool": 1, "numeric": 8, "date": 4, "datetime": 6}[self.kind]

    @property
    def zero(self) -> Any:
        """What an absent value counts as; None for dates, which match nothing then."""
        return {"varchar": "", "double": 0.0, "numeric": Decimal(0), "bool": False, "date": None, "datetime": None}.get(self.kind, 0)

    def removed_now(self) -> Field:
        return replace(self, removed=True)

    def literal(self, text: Any, lenient: bool = False) -> Any:
        """A request's value in this field's type. Bad text raises, or is read as far as it goes."""
        if isinstance(text, bool):
            text = "true" if text else "false"
        s = "" if text is None else str(text)
        try:
            return _STRICT[self.kind](self, s.strip() if self.kind != "varchar" else s)
        except (ValueError, InvalidOperation):
            if not lenient:
                raise RequestError(f"bad {self.kind} value for {self.name}: {s!r}") from None
        m = re.match(r"\s*[-+]?\d*\.?\d*(?:[eE][-+]?\d+)?", s)
        number = m[0].strip() if m else ""
        if self.kind in INTEGERS:
            whole = re.match(r"[-+]?\d+", number)
            return max(INTEGERS[self.kind][1], min(INTEGERS[self.kind][2], int(whole[0]))) if whole else 0
        if self.kind in ("double", "numeric"):
            try:
                return _STRICT[self.kind](self, number)
            except (ValueError, InvalidOperation):
                return self.zero
        return False if self.kind == "bool" else None


def _integer(f: Field, s: str) -> int:
    n = int(s)
    if not INTEGERS[f.kind][1] <= n <= INTEGERS[f.kind][2]:
        raise ValueError(s)
    return n


def _numeric(f: Field, s: str) -> Decimal:
    return Decimal(s).quantize(Decimal(1).scaleb(-f.scale), ROUND_HALF_UP)


def _bool(f: Field, s: str) -> bool:
    if s[:1] in ("t", "T", "1"):
        return True
    if s[:1] in ("f", "F", "0", ""):
        return False
    raise ValueError(s)


def _digits(s: str, n: int) -> str:
    d = re.sub(r"[-:/ T.]", "", s)
    if not d.isdigit() or len(d) < 8:
        raise ValueError(s)
    return d[:n].ljust(n, "0")


def _date(f: Field, s: str) -> dt.date:
    return dt.datetime.strptime(_digits(s, 8), "%Y%m%d").date()


def _datetime(f: Field, s: str) -> dt.datetime:
    return dt.datetime.strptime(_digits(s, 14), "%Y%m%d%H%M%S")


_STRICT = {
    "varchar": lambda f, s: s, "int": _integer, "long": _integer, "short": _integer, "byte": _integer, "double": lambda f, s: float(s),
    "numeric": _numeric, "bool": _bool, "date": _date, "datetime": _datetime,
}


def parse_field(text: str) -> Field:
    """``name:type[:param][:modifier]``; modifiers: auto_create, auto_update, default=..."""
    name, _, rest = text.partition(":")
    if not NAME.match(name) or name == "key" or not rest:
        raise RequestError(f"invalid field spec: {text}")
    kind, _, rest = rest.partition(":")
    size = scale = 0
    if kind == "varchar":
        param, _, rest = rest.partition(":")
        size = int(param) if param.isdigit() else 0
        if not 1 <= size <= 65535:
            raise RequestError(f"varchar needs a size from 1 to 65535: {text}")
    elif kind in ("numeric", "currency"):
        size, scale = (19, 4) if kind == "currency" else (18, 2)
        if kind == "numeric" and (m := re.match(r"(\d+)(?:,(\d+))?(?::|\Z)", rest)):
            size, scale, rest = int(m[1]), int(m[2]) if m[2] else 2, rest[m.end() :]
        kind = "numeric"
    elif kind not in {*INTEGERS, "double", "bool", *TIMES}:
        raise RequestError(f"unknown type: {text}")
    if rest in ("auto_create", "auto_update"):
        return Field(name, kind, size, scale, rest)
    if rest and not rest.startswith("default="):
        raise RequestError(f"unknown modifier: {text}")
    out = Field(name, kind, size, scale, rest[8:] if rest else None)
    if out.default is not None and not re.match(r"(seq|uuid|random)\(", out.default):
        out.literal(out.default)
    return out


@dataclass(frozen=True)
class Schema:
    """Fields by name, the key column (None: the table has no key) and indexed names."""

    name: str
    fields: dict[str, Field]
    key: str | None = "key"
    indexes: frozenset[str] = field(default_factory=frozenset)

    def live(self) -> list[Field]:
        return [f for f in self.fields.values() if not f.removed]

    def find(self, name: str) -> Field | None:
        f = self.fields.get(name)
        if name == self.key and f is None:
            return Field(name, "varchar", 1024)
        return None if f is None or f.removed else f

    def parts(self, name: str) -> list[Field] | None:
        """The fields of a composite name ``a+b``; None unless there are two or more and all exist."""
        found = [self.find(x) for x in name.split("+")]
        return found if len(found) > 1 and all(found) else None


def field_of(name: str, kind: T.DataType) -> Field | None:
    """The field of a column of a plain Parquet table; None for types that the data model lacks."""
    simple = {T.IntegerType: "int", T.LongType: "long", T.ShortType: "short", T.ByteType: "short", T.DoubleType: "double", T.FloatType: "double", T.BooleanType: "bool", T.DateType: "date", T.TimestampNTZType: "datetime", T.TimestampType: "datetime"}
    if isinstance(kind, T.StringType):
        return Field(name, "varchar", 65535)
    if isinstance(kind, T.DecimalType):
        return Field(name, "numeric", kind.precision, kind.scale)
    return Field(name, simple[type(kind)]) if type(kind) in simple else None
