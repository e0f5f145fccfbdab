"""Names in queries to columns, over declared columns and dynamic (VARIANT) payloads alike.

``a.b.c`` is looked up as a column of that whole name, then as ``b.c`` inside column ``a`` (struct,
map or variant), then in the payload column ``data``, then, for ``log.x`` and ``network.x``, as
``x`` in events of that type, and, in correlated rows, inside the left and then the right event. A name
that is nowhere is missing: null, not an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD = "data"
#: What packets call the fields that queries name by role.
NETWORK_ALIASES = {
    "dst_port": ("tcp_dst_port", "udp_dst_port"),
    "src_port": ("tcp_src_port", "udp_src_port"),
    "src_ip": ("ip_src",),
    "dst_ip": ("ip_dst",),
}
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Field:
    """One resolved name. ``kind``: string, number, bool, time, variant, other or missing."""

    kind: str
    column: Column

    def exists(self) -> Column:
        if self.kind == "missing":
            return F.lit(False)
        if self.kind == "variant":
            return self.column.isNotNull() & ~F.is_variant_null(self.column)
        return self.column.isNotNull()

    def present(self) -> Column:
        """Whether the event has the key at all, be its value null."""
        return F.lit(False) if self.kind == "missing" else self.column.isNotNull()

    def _variant_is(self, *types: str) -> Column:
        kind = F.schema_of_variant(self.column)
        out = F.lit(False)
        for t in types:
            out = out | kind.startswith(t)
        return out

    def string(self) -> Column:
        """Its value if it is a string, else null."""
        if self.kind == "string":
            return self.column
        if self.kind == "variant":
            return F.when(self._variant_is("STRING"), F.try_variant_get(self.column, "$", "string"))
        return F.lit(None).cast("string")

    def number(self) -> Column:
        """Its value if it is a number, else null."""
        if self.kind == "number":
            return self.column
        if self.kind == "variant":
            return F.when(self._variant_is("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(self.column, "$", "double"))
        return F.lit(None).cast("double")

    def bool(self) -> Column:
        if self.kind == "bool":
            return self.column
        if self.kind == "variant":
            return F.when(self._variant_is("BOOLEAN"), F.try_variant_get(self.column, "$", "boolean"))
        return F.lit(None).cast("boolean")

    def measure(self) -> Column:
        """A double for aggregation: missing and non-numeric values count as 0.0."""
        return F.coalesce(self.number().cast("double"), F.lit(0.0))

    def value(self) -> Column:
        """Its value for output and grouping; a variant's scalar as a string."""
        if self.kind == "missing":
            return F.lit(None).cast("string")
        if self.kind == "variant":
            return F.try_variant_get(self.column, "$", "string")
        return self.column


def field_of(column: Column, kind: T.DataType) -> Field:
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return Field("string", column)
    if isinstance(kind, _NUMERIC):
        return Field("number", column)
    if isinstance(kind, T.BooleanType):
        return Field("bool", column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Field("time", column)
    if isinstance(kind, T.VariantType):
        return Field("variant", column)
    return Field("other", column)


def missing() -> Field:
    return Field("missing", F.lit(None).cast("string"))


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _inside(column: Column, kind: T.DataType, name: str) -> Field | None:
    """``name`` within a struct, map or variant column."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            if f.name == name:
                return field_of(column.getField(quoted(name) if "." in name else name), f.dataType)
        head, dot, rest = name.partition(".")
        while dot:
            for f in kind.fields:
                if f.name == head and (got := _inside(column.getField(quoted(head) if "." in head else head), f.dataType, rest)):
                    return got
            more, dot, rest = rest.partition(".")
            head = f"{head}.{more}"
        return None
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return field_of(F.try_element_at(column, F.lit(name)), kind.valueType)
    if isinstance(kind, T.VariantType):
        found = F.try_variant_get(column, _path(name), "variant")
        head, dot, rest = name.partition(".")
        nested = "$" + "".join(_path(p)[1:] for p in name.split("."))
        return Field("variant", F.coalesce(found, F.try_variant_get(column, nested, "variant")) if dot else found)
    return None


class Resolver:
    """Resolves names against one DataFrame's schema."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema
        self.kinds = {f.name: f.dataType for f in df.schema.fields}

    def _column(self, name: str) -> Column:
        return F.col(quoted(name))

    def _plain(self, name: str) -> Field | None:
        if name in self.kinds:
            return field_of(self._column(name), self.kinds[name])
        head, dot, rest = name.partition(".")
        while dot:
            if head in self.kinds and (got := _inside(self._column(head), self.kinds[head], rest)):
                return got
            more, dot, rest = rest.partition(".")
            head = f"{head}.{more}"
        if PAYLOAD in self.kinds and (got := _inside(self._column(PAYLOAD), self.kinds[PAYLOAD], name)):
            return got
        return None

    def _guarded(self, got: Field, kind: str) -> Field:
        if "type" not in self.kinds or got.kind == "missing":
            return got
        return Field(got.kind, F.when(self._column("type") == kind, got.column))

    def _either(self, fields: list[Field]) -> Field | None:
        """The first of several that has a value, if their kinds agree."""
        fields = [f for f in fields if f.kind != "missing"]
        if not fields:
            return None
        same = [f for f in fields if f.kind == fields[0].kind]
        return Field(same[0].kind, F.coalesce(*[f.column for f in same]) if len(same) > 1 else same[0].column)

    def __call__(self, name: str) -> Field:
        direct = self._plain(name)
        found = [direct] if direct else []
        if not direct or direct.kind == "variant":
            for space in ("log", "network"):
                if name.startswith(space + "."):
                    rest = name[len(space) + 1 :]
                    for alias in (rest, *(NETWORK_ALIASES.get(rest, ()) if space == "network" else ())):
                        if got := self._plain(alias):
                            found.append(self._guarded(got, space))
            for side in ("left_event", "right_event"):
                if isinstance(self.kinds.get(side), T.StructType):
                    got = _Nested(self._column(side), self.kinds[side])(name)
                    if got:
                        found.append(got)
        return self._either(found) or missing()


class _Nested(Resolver):
    """The same lookups inside a struct column."""

    def __init__(self, outer: Column, kind: T.StructType):
        self.outer = outer
        self.kinds = {f.name: f.dataType for f in kind.fields}

    def _column(self, name: str) -> Column:
        return self.outer.getField(quoted(name) if "." in name else name)

    def __call__(self, name: str) -> Field | None:
        got = super().__call__(name)
        return None if got.kind == "missing" else got
