"""Loading of tab-separated product lines: valid rows loaded, the others apart with their reason.

Blocks of records are checked column by column and parsed in bulk by Arrow's CSV reader. A block that fails is
halved, again and again, until each of its bad records stands alone; only those are read by the strict
character-level parser, which names the first rule that they break. What a check found for a whole block answers
for every part of it, so halving costs no second check, and all parts that pass are parsed together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_LINE = rf"\A{_FIELD}\t{_FIELD}\t{_FIELD}\z"
_BAD_TITLE = r"\A[\s\x{85}\p{Z}]*\z|[\x00-\x08\x0a-\x1f\x{fffd}]"
_PRICE = r"\A[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
_PRICE_PY = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
SCHEMA = pa.schema([("record_id", pa.int64()), ("source_id", pa.string()), ("title", pa.string()), ("price", pa.float64()), ("reason", pa.string())])


def split_strict(line: str) -> list[str] | None:
    """The fields of one line, or None if its quoting is broken."""
    fields, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            value, at = [], at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return None
                value.append(line[at:end])
                at = end + 1
                if line[at : at + 1] != '"':
                    break
                value.append('"')
                at += 1
            fields.append("".join(value))
            if at < len(line) and line[at] != "\t":
                return None
        else:
            end = line.find("\t", at)
            end = len(line) if end < 0 else end
            fields.append(line[at:end])
            at = end
        if at >= len(line):
            return fields
        at += 1


def diagnose(line: str | None) -> tuple[str | None, str | None, float | None, str | None]:
    """(source_id, title, price, reason) of one line by the strict rules; reason is null if it loads."""
    if line is None:
        return None, None, None, "missing"
    fields = split_strict(line.removesuffix("\r"))
    if fields is None:
        return None, None, None, "quoting"
    if len(fields) != 3:
        return None, None, None, "columns"
    source, title, price = fields
    if not title or title.isspace() or any(c == "�" or c < " " and c != "\t" for c in title):
        return source, None, None, "title"
    price = price.strip(" ")
    if not _PRICE_PY.fullmatch(price) or not math.isfinite(value := float(price)):
        return source, title, None, "price"
    return source, title, value, None


def isolate(n: int, fails: Callable[[int, int], bool]) -> tuple[list[int], list[int]]:
    """The records 0 to n-1 in passing blocks, and those that fail by themselves, by halving blocks that fail."""
    passing, failing, todo = [], [], [(0, n)] if n else []
    while todo:
        a, b = todo.pop()
        if not fails(a, b):
            passing += range(a, b)
        elif b - a == 1:
            failing.append(a)
        else:
            middle = (a + b) // 2
            todo += [(middle, b), (a, middle)]
    return passing, failing


def _by_mask(bad: pa.Array) -> Callable[[int, int], bool]:
    """Whether a block has any record that a check of the whole found bad."""
    before = np.concatenate([[0], np.cumsum(bad.to_numpy(zero_copy_only=False))])
    return lambda a, b: before[b] > before[a]


def bad_form(lines: pa.Array) -> pa.Array:
    """Which lines are not three fields, quoted well, on one line."""
    fits = pc.fill_null(pc.match_substring_regex(lines, _LINE), False)
    return pc.or_(pc.invert(fits), pc.fill_null(pc.match_substring_regex(lines, r"[\r\n\x00]"), False))


def read_block(lines: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array] | None:
    """Source ids, titles and prices as text of lines of good form; None if the reader takes them otherwise."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_py()
    data = f"a\tb\tc\n{whole}\n".encode()  # a header line, so that a byte order mark of the first record isn't taken away
    try:
        read = csv.read_csv(
            pa.BufferReader(data),
            read_options=csv.ReadOptions(use_threads=False, block_size=len(data) + 1),
            parse_options=csv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, escape_char=False, newlines_in_values=False, ignore_empty_lines=False),
            convert_options=csv.ConvertOptions(column_types=dict.fromkeys("abc", pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    return tuple(read.column(k).combine_chunks() for k in "abc") if read.num_rows == len(lines) else None


def bad_values(title: pa.Array, price: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Which rows have an unusable title or price; and the prices as numbers, null where they are unusable."""
    text = pc.utf8_trim(price, " ")
    text = pc.if_else(pc.match_substring_regex(text, _PRICE), pc.replace_substring_regex(text, r"\A\+", ""), pa.scalar(None, pa.string()))
    number = pc.cast(text, pa.float64())
    fine = pc.fill_null(pc.is_finite(number), False)
    return pc.or_(pc.match_substring_regex(title, _BAD_TITLE), pc.invert(fine)), number


def _parse(ids: pa.Array, lines: pa.Array) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(lines), BLOCK):
        yield from _parse_block(ids.slice(at, BLOCK), lines.slice(at, BLOCK))


def _parse_block(ids: pa.Array, lines: pa.Array) -> Iterator[pa.RecordBatch]:
    body = pc.if_else(pc.ends_with(lines, "\r"), pc.utf8_slice_codeunits(lines, 0, -1), lines)
    rows, strict = isolate(len(lines), _by_mask(bad_form(body)))
    fields = read_block(body.take(pa.array(rows, pa.int64())))
    if fields is None:  # not even this many together: the reader itself is asked about ever smaller blocks
        rows, odd = (([rows[i] for i in part]) for part in isolate(len(rows), lambda a, b: read_block(body.take(pa.array(rows[a:b], pa.int64()))) is None))
        strict = strict + odd
        fields = read_block(body.take(pa.array(rows, pa.int64())))
        if fields is None:
            rows, strict, fields = [], [*strict, *rows], read_block(body.slice(0, 0))
    source, title, price = fields
    bad, number = bad_values(title, price)
    good, odd = isolate(len(rows), _by_mask(bad))
    strict = [*strict, *(rows[i] for i in odd)]
    if good:
        kept = pa.array(good, pa.int64())
        yield pa.record_batch([ids.take(pa.array([rows[i] for i in good])), *(x.take(kept) for x in (source, title, number)), pa.nulls(len(good), pa.string())], schema=SCHEMA)
    if strict:
        known = [diagnose(x) for x in lines.take(pa.array(strict)).to_pylist()]
        columns = [pa.array(x, k) for x, k in zip(zip(*known), (pa.string(), pa.string(), pa.float64(), pa.string()))]
        yield pa.record_batch([ids.take(pa.array(strict)), *columns], schema=SCHEMA)


def parse_records(lines: DataFrame, id_column: str, line_column: str) -> DataFrame:
    """(record_id, source_id, title, price, reason), one row for each row of ``lines``.

    ``reason`` is null for a loaded row, else the first that holds of 'missing' (a null line), 'quoting',
    'columns', 'title' and 'price'; what was readable before the failure is kept, the rest is null. Repeated
    lines and ids stay as often as they come, an empty table gives an empty result, an empty line breaks
    'columns', and other columns are ignored whatever their names. A line may be of any length.

    No shuffle and no order: every task parses its own records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _parse(batch.column(0), pc.cast(batch.column(1), pa.string()))

    picked = lines.select(F.col(id_column).cast("bigint"), F.col(line_column).cast("string"))
    return picked.mapInArrow(run, "record_id bigint, source_id string, title string, price double, reason string")
