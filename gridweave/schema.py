"""Types of stage outputs, lossless casts and value contracts, as Spark types and columns."""

from __future__ import annotations

import ctypes
import json
import pickle
import re
import threading
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMED = {
    "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(),
    "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def record(fields: str) -> T.StructType:
    """A record from "name type, ..." that needs no session."""
    return T.StructType([T.StructField(name, _NAMED[kind]) for name, kind in (f.split() for f in re.split(r",\s+", fields))])


FILE_REF = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("written", T.BooleanType()), T.StructField("existed", T.BooleanType())])
#: One record of a stage for a row.
DIAG = record(
    "stage string, ok boolean, skipped boolean, status string, started_at timestamp, ended_at timestamp, duration_ms double, host string, attempt int, retry_count int, queue_ms double, error_class string, error_message string"
)


def dbl() -> T.DataType:
    return T.DoubleType()


def int_() -> T.DataType:
    return T.IntegerType()


def chr_() -> T.DataType:
    return T.StringType()


def lgl() -> T.DataType:
    return T.BooleanType()


def lst(element: T.DataType | None = None) -> T.DataType:
    """A list; without an element type, opaque bytes."""
    return T.ArrayType(element) if element is not None else T.BinaryType()


def tbl(**columns: T.DataType) -> T.DataType:
    """A nested table."""
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in columns.items()]))


def pack(**fields: T.DataType) -> T.DataType:
    """A nested record."""
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


struct = pack


def file_ref() -> T.DataType:
    return FILE_REF


artifact = file_ref


@dataclass(frozen=True)
class Flex:
    """A type that is a test of values. They are kept as ``stored``; the default is pickled bytes."""

    test: Callable[[Any], bool]
    name: str
    cost: str = "light"
    timeout: float | None = None
    stored: T.DataType = T.BinaryType()

    def accepts(self, value: Any, mode: str = "light") -> bool:
        """Tests of full cost are left out in light mode; one that raises or takes too long fails."""
        if self.cost == "full" and mode == "light":
            return True
        if self.timeout is None:
            return _passes(self.test, value)
        found: list[bool] = []
        worker = threading.Thread(target=lambda: found.append(_passes(self.test, value)), daemon=True)
        worker.start()
        worker.join(self.timeout)
        if worker.is_alive():
            # Ends the test at its next step; one that waits outside of Python ends when it comes back.
            ctypes.pythonapi.PyThreadState_SetAsyncExc(ctypes.c_ulong(worker.ident), ctypes.py_object(SystemExit))
        return bool(found and found[0])

    def held_by(self, value: Column) -> Column | None:
        """Whether a variant column's value is of the type, where Spark can tell without calling the test."""
        return None


def _passes(test: Callable[[Any], bool], value: Any) -> bool:
    try:
        return test(value) is True
    except Exception:
        return False


def variant() -> T.DataType:
    """Any value that JSON can hold, as a variant: numbers, text, truth values, lists and records, read by paths."""
    return T.VariantType()


#: What the schema of a variant begins with, by the kind of type that its value is of.
_SCHEMAS = (
    (T.BooleanType, "BOOLEAN"), (T.IntegralType, "BIGINT"), (T.NumericType, "(BIGINT|DECIMAL|DOUBLE|FLOAT)"), (T.StringType, "STRING"), (T.ArrayType, "ARRAY"), ((T.StructType, T.MapType), "OBJECT"),
)


def variant_is(value: Column, kind: T.DataType) -> Column | None:
    """Whether a variant's value is of the kind of a type; None if variants have no such kind."""
    begin = next((b for of, b in _SCHEMAS if isinstance(kind, of)), None)
    return None if begin is None else F.schema_of_variant(value).rlike(f"^{begin}")


def isa(kind: type | str, stored: T.DataType = T.BinaryType()) -> Flex:
    """Values of a class, or of one with that name."""
    named = lambda v: any(c.__name__ == kind for c in type(v).__mro__)
    return Flex(named if isinstance(kind, str) else lambda v: isinstance(v, kind), f"isa {kind if isinstance(kind, str) else kind.__name__}", stored=stored)


def blob(kind: type | str | None = None) -> Flex | T.DataType:
    """Any object, as bytes, or one of a class."""
    return T.BinaryType() if kind is None else isa(kind)


def pred(test: Callable[[Any], bool], cost: str = "light", timeout: float | None = None, stored: T.DataType = T.BinaryType()) -> Flex:
    """Values that a function accepts, within so many seconds if a timeout is given."""
    if cost not in ("light", "full"):
        raise ValueError("cost is light or full")
    return Flex(test, "pred", cost, timeout, stored)


def check_type(value: Any, spec: Flex | T.DataType, mode: str = "light") -> bool:
    """Whether a value is of a type; Spark's own take what can be cast to them without loss."""
    if isinstance(spec, Flex):
        return spec.accepts(value, mode)
    try:
        lossless(value, spec)
    except (TypeError, AttributeError):
        return False
    return True


def one_of(*specs: Flex | T.DataType, stored: T.DataType = T.BinaryType()) -> Flex:
    """Values of any of the types."""
    return _Union(lambda v: False, "one of several types", stored=stored, specs=specs)


def maybe(kind: Flex | T.DataType) -> Flex | T.DataType:
    """An optional value. Every field of Spark's is nullable, so those stay as they are."""
    return _Union(lambda v: v is None, f"maybe {kind.name}", stored=kind.stored, specs=(kind,)) if isinstance(kind, Flex) else kind


@dataclass(frozen=True)
class _Union(Flex):
    """The test or any of the types; a type of full cost accepts all in light mode."""

    specs: tuple = ()

    def accepts(self, value: Any, mode: str = "light") -> bool:
        return _passes(self.test, value) or any(check_type(value, s, mode) for s in self.specs)

    def held_by(self, value: Column) -> Column | None:
        tests = [s.held_by(value) if isinstance(s, Flex) else variant_is(value, s) for s in self.specs]
        if any(t is None for t in tests):
            return None
        out = value.isNull() | F.is_variant_null(value) if self.name.startswith("maybe") else F.lit(False)
        for t in tests:
            out = out | t
        return out


def is_flex(spec: Any) -> bool:
    return isinstance(spec, Flex)


def validate_row(row: dict[str, Any], schema: Returns, mode: str = "light") -> list[str]:
    """What is wrong with the fields of flexible types; nothing if all is well."""
    out = []
    for name, spec in schema.fields:
        if isinstance(spec, Flex):
            if name not in row:
                out.append(f"{name}: missing")
            elif not spec.accepts(row[name], mode):
                out.append(f"{name}: {type(row[name]).__name__} is not {spec.name}")
    return out


def stored_value(value: Any, spec: Flex) -> Any:
    """A value as it is kept."""
    if value is not None and isinstance(spec.stored, T.VariantType):
        return as_json(value)
    if value is None or not isinstance(spec.stored, T.BinaryType):
        return value if value is None else lossless(value, spec.stored)
    return pickle.dumps(value)


def as_json(value: Any) -> str:
    """A value as it goes to a variant; a TypeError if JSON cannot hold it."""
    try:
        return json.dumps(value, allow_nan=False, default=lambda v: v.item() if hasattr(v, "item") else _no_json(v))
    except ValueError as e:
        raise TypeError(str(e)) from None


def _no_json(value: Any) -> Any:
    raise TypeError(f"a variant holds no {type(value).__name__}")


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type of one of Spark's."""
    simple = {T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.ShortType: pa.int16(), T.ByteType: pa.int8(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.DateType: pa.date32(), T.TimestampType: pa.timestamp("us", tz="UTC")}
    if type(kind) in simple:
        return simple[type(kind)]
    if isinstance(kind, T.VariantType):
        return pa.string()
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind])
    if isinstance(kind, T.MapType):
        return pa.map_(arrow_type(kind.keyType), arrow_type(kind.valueType))
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(kind.precision, kind.scale)
    raise TypeError(f"no output is of type {kind.simpleString()}")


@dataclass(frozen=True)
class Rule:
    """A rule of one field. ``min``, ``max``, ``choices``, ``length``, ``allow_na`` and ``type`` (a value that is not of it
    without loss breaks the rule) hold for stages of either kind; ``predicate`` is a function of a column."""

    name: str
    type: T.DataType | None = None
    min: float | None = None
    max: float | None = None
    choices: tuple | None = None
    length: int | None = None
    allow_na: bool = True
    predicate: Any = None

    def broken(self, value: Column, kind: T.DataType) -> Column:
        """The name of what the value breaks, or null."""
        out = F.lit(None).cast("string")
        if self.predicate is not None:
            out = F.when(~F.coalesce(self.predicate(value), F.lit(False)) & value.isNotNull(), F.lit("predicate")).otherwise(out)
        if self.length is not None and isinstance(kind, (T.ArrayType, T.MapType)):
            out = F.when(F.size(value) != self.length, F.lit("length")).otherwise(out)
        if self.type is not None:
            out = F.when(value.isNotNull() & lossless_column(value, kind, self.type).isNull(), F.lit("type")).otherwise(out)
        if self.choices is not None:
            out = F.when(~value.isin(*self.choices), F.lit("choices")).otherwise(out)
        if self.max is not None:
            out = F.when(value > self.max, F.lit("max")).otherwise(out)
        if self.min is not None:
            out = F.when(value < self.min, F.lit("min")).otherwise(out)
        if not self.allow_na:
            out = F.when(value.isNull(), F.lit("missing")).otherwise(out)
        return out

    def holds(self, value: Any) -> str | None:
        """The same for a value in a task."""
        if value is None:
            return None if self.allow_na else "missing"
        if self.type is not None and not check_type(value, self.type):
            return "type"
        if self.min is not None and value < self.min:
            return "min"
        if self.max is not None and value > self.max:
            return "max"
        if self.choices is not None and value not in self.choices:
            return "choices"
        if self.length is not None and hasattr(value, "__len__") and not isinstance(value, str) and len(value) != self.length:
            return "length"
        return None


def ctr_field(name: str, **rule: Any) -> Rule:
    return Rule(name, **rule)


def contract(*rules: Rule) -> tuple[Rule, ...]:
    return rules


@dataclass(frozen=True)
class Returns:
    """The declared outputs of a stage."""

    fields: tuple[tuple[str, T.DataType | Flex], ...]
    rules: tuple[Rule, ...] = ()

    def rule(self, name: str) -> Rule | None:
        return next((r for r in self.rules if r.name == name), None)


def returns(_contract: tuple[Rule, ...] = (), **fields: T.DataType | Flex) -> Returns:
    return Returns(tuple(fields.items()), tuple(_contract))


schema = returns


_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def lossless(value: Any, kind: T.DataType) -> Any:
    """A value as the declared type where that keeps it as it is; otherwise a TypeError. None stays None. Whole numbers
    become integers that can hold them, numbers and truth values doubles, 0 and 1 truth values; text is text."""
    if value is None:
        return None
    if isinstance(kind, T.VariantType):
        return as_json(value)
    if hasattr(value, "item") and not isinstance(value, (bytes, bytearray)):
        value = value.item()
    if type(kind) in _BITS:
        if (isinstance(value, (bool, int)) or isinstance(value, float) and value.is_integer()) and -(1 << _BITS[type(kind)] - 1) <= value < 1 << _BITS[type(kind)] - 1:
            return int(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        if isinstance(value, (bool, int, float)):
            return None if value != value else float(value)
    elif isinstance(kind, T.BooleanType):
        if isinstance(value, (bool, int, float)) and value in (0, 1):
            return bool(value)
    elif isinstance(kind, T.StringType):
        if isinstance(value, str):
            return value
    elif isinstance(kind, T.StructType):
        if isinstance(value, dict):
            return {f.name: lossless(value.get(f.name), f.dataType) for f in kind}
    elif isinstance(kind, T.ArrayType):
        if isinstance(value, (list, tuple)):
            return [lossless(v, kind.elementType) for v in value]
    else:
        return value
    raise TypeError(f"{value!r} is no {kind.simpleString()}")


def lossless_column(value: Column, own: T.DataType, kind: T.DataType) -> Column:
    """The same for a column of type ``own``; null where :func:`lossless` has an error."""
    numeric, null = isinstance(own, T.NumericType), F.lit(None).cast(kind)
    if isinstance(own, T.NullType):
        return null
    if isinstance(kind, T.VariantType):
        return value if isinstance(own, T.VariantType) else F.to_variant_object(value) if isinstance(own, (T.StructType, T.ArrayType, T.MapType)) else value.cast(kind)
    if type(kind) in _BITS:
        if isinstance(own, (T.BooleanType, T.IntegralType)):
            return value.try_cast(kind)
        return F.when(value == F.floor(value), value.try_cast(kind)) if numeric else null
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # A NaN is no value.
        return F.nanvl(value.cast(kind), null) if numeric or isinstance(own, T.BooleanType) else null
    if isinstance(kind, T.BooleanType):
        return value if isinstance(own, T.BooleanType) else F.when(value.isin(0, 1), value == 1) if numeric else null
    if isinstance(kind, T.StringType):
        return value if isinstance(own, T.StringType) else null
    if isinstance(kind, T.StructType):
        if not isinstance(own, T.StructType):
            return null
        have = {f.name: f.dataType for f in own}
        parts = {f.name: lossless_column(value[f.name], have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in kind}
        spoilt = F.lit(False)
        for n, v in parts.items():
            spoilt = spoilt | (value[n].isNotNull() & v.isNull() if n in have else F.lit(False))
        return F.when(value.isNotNull() & ~spoilt, F.struct(*[v.alias(n) for n, v in parts.items()]))
    if isinstance(kind, T.ArrayType):
        if not isinstance(own, T.ArrayType):
            return null
        one = lambda v: lossless_column(v, own.elementType, kind.elementType)
        return F.when(~F.exists(value, lambda v: v.isNotNull() & one(v).isNull()), F.transform(value, one))
    return value if own == kind else value.try_cast(kind)
