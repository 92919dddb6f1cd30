"""Columns as searchable fields: what is indexed, what is stored, and the key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

STRING, DOUBLE, KEY = "string", "double", "key"
_NUMBERS = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


@dataclass(frozen=True)
class FieldSpec:
    """One field. ``tokenized`` makes it searchable (words of a string, points of a number), ``stored`` returns it."""

    name: str
    type: str
    tokenized: bool = True
    stored: bool = True

    @property
    def flags(self) -> int:
        """One byte: stored, tokenized, double, string, key from the lowest bit up."""
        return self.stored | self.tokenized << 1 | (self.type == DOUBLE) << 2 | (self.type == STRING) << 3 | (self.type == KEY) << 4


def infer(schema: T.StructType, key: str) -> list[FieldSpec]:
    """Strings are tokenized and stored, numbers are points and stored, ``key`` is the primary key; the rest is stored only."""
    specs = []
    for f in schema.fields:
        if f.name == key:
            specs.append(FieldSpec(f.name, KEY, False, True))
        elif isinstance(f.dataType, T.StringType):
            specs.append(FieldSpec(f.name, STRING))
        elif isinstance(f.dataType, _NUMBERS):
            specs.append(FieldSpec(f.name, DOUBLE))
        else:
            specs.append(FieldSpec(f.name, STRING, False, True))
    return specs
