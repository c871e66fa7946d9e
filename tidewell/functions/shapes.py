"""JSON answers checked against a declared shape, strictly and then tolerantly.

A shape is compiled to expressions over VARIANT, so a column of texts is parsed
once and checked where it is read, nested records and lists included. Strictly,
every key without `optional` must be there and right. Tolerantly, keys of the top
record that are wrong are dropped, and those with a default take it; a list with
one wrong item is dropped whole. Keys that the shape doesn't name are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MISSING = object()


class Shape:
    """A kind of JSON value."""

    sql: str

    def fits(self, value: Column) -> Column:
        """Whether a VARIANT, which may be absent (null), is of the kind; never null."""
        raise NotImplementedError

    def read(self, value: Column) -> Column:
        """The value of one that fits."""
        return F.try_variant_get(value, "$", self.sql)


def _kind(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit(""))


@dataclass(frozen=True)
class Text(Shape):
    """A string, of the choices where some are given."""

    choices: tuple[str, ...] = ()
    sql = "string"

    def fits(self, value):
        right = _kind(value) == "STRING"
        return right & F.coalesce(self.read(value).isin(*self.choices), F.lit(False)) if self.choices else right


@dataclass(frozen=True)
class Number(Shape):
    """A number; with `whole` one without a fraction."""

    whole: bool = False

    @property
    def sql(self):
        return "bigint" if self.whole else "double"

    def fits(self, value):
        right = _kind(value).isin("BIGINT", "DECIMAL", "DOUBLE")
        if not self.whole:
            return right
        number = F.try_variant_get(value, "$", "double")
        return right & F.coalesce((F.floor(number) == number) & self.read(value).isNotNull(), F.lit(False))


@dataclass(frozen=True)
class Flag(Shape):
    sql = "boolean"

    def fits(self, value):
        return _kind(value) == "BOOLEAN"


@dataclass(frozen=True)
class Items(Shape):
    """A list whose items all fit."""

    of: Shape

    @property
    def sql(self):
        return f"array<{self.of.sql}>"

    def _items(self, value):
        return F.try_variant_get(value, "$", "array<variant>")

    def fits(self, value):
        return (_kind(value) == "ARRAY") & F.coalesce(F.forall(self._items(value), self.of.fits), F.lit(False))

    def read(self, value):
        return F.transform(self._items(value), self.of.read)


@dataclass(frozen=True)
class Key:
    """A key of a record: optional (absent or JSON null will do), or with a default, or required."""

    shape: Shape
    optional: bool = False
    default: object = _MISSING

    @property
    def has_default(self) -> bool:
        return self.default is not _MISSING

    def fits(self, value: Column, absent_too: bool = True) -> Column:
        right = self.shape.fits(value)
        if self.optional:
            return right | value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))
        return right | value.isNull() if self.has_default and absent_too else right

    def read(self, value: Column) -> Column:
        """The value where it fits, else the default, else null."""
        found = F.when(self.shape.fits(value), self.shape.read(value))
        if not self.has_default:
            return found
        default = self.default
        filled = F.array(*map(F.lit, default)) if isinstance(default, (list, tuple)) else F.lit(default)
        return F.coalesce(found, filled.cast(self.shape.sql))


@dataclass(frozen=True)
class Record(Shape):
    """An object with named keys."""

    keys: dict[str, Key]

    @property
    def sql(self):
        return "struct<" + ", ".join(f"`{name}`: {key.shape.sql}" for name, key in self.keys.items()) + ">"

    def at(self, value: Column, name: str) -> Column:
        return F.try_variant_get(value, f"$['{name}']", "variant")

    def fits(self, value):
        parts = [key.fits(self.at(value, name)) for name, key in self.keys.items()]
        return reduce(lambda a, b: a & b, parts, _kind(value) == "OBJECT")

    def read(self, value):
        return F.struct(*(key.read(self.at(value, name)).alias(name) for name, key in self.keys.items()))


def validated(rows: DataFrame, column: str, shape: Record, out: str = "checked") -> DataFrame:
    """rows with a struct `out`: status, value, dropped, defaulted.

    status: strict; tolerant, when keys were dropped or took their default; invalid,
    when a required key is absent or wrong; broken, when the text is no JSON object
    (null and empty texts, and objects that repeat a key, are none). value is null
    where it is invalid or broken. The lists name keys of the top record in order.
    """
    value = F.col("__json")

    def named(condition) -> Column:
        """Names of the keys for which condition(key, value) holds."""
        return F.array_compact(F.array(*(F.when(condition(key, shape.at(value, name)), F.lit(name)) for name, key in shape.keys.items())))

    parsed = rows.withColumn("__json", F.try_parse_json(column))
    object_ = _kind(value) == "OBJECT"
    dropped = F.when(object_, named(lambda key, v: ~key.fits(v))).otherwise(F.array().cast("array<string>"))
    defaulted = F.when(object_, named(lambda key, v: ~key.shape.fits(v) if key.has_default else F.lit(False))).otherwise(F.array().cast("array<string>"))
    required = [name for name, key in shape.keys.items() if not key.optional and not key.has_default]
    staged = parsed.withColumns({"__dropped": dropped, "__defaulted": defaulted, "__object": object_})
    lost = F.arrays_overlap("__dropped", F.array(*map(F.lit, required)).cast("array<string>"))
    status = (
        F.when(~F.col("__object"), "broken").when(lost, "invalid")
        .when((F.size("__dropped") > 0) | (F.size("__defaulted") > 0), "tolerant").otherwise("strict")
    )
    kept = status.isin("strict", "tolerant")
    made = F.struct(
        status.alias("status"), F.when(kept, shape.read(value)).alias("value"),
        F.col("__dropped").alias("dropped"), F.when(kept, F.col("__defaulted")).otherwise(F.array().cast("array<string>")).alias("defaulted"),
    )
    return staged.withColumn(out, made).drop("__json", "__dropped", "__defaulted", "__object")
