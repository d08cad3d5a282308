"""Rows that fail to parse.

A recursive-descent parser for delimited records.  The grammar::

    text    := record (EOL record)*
    record  := field (',' field)*
    field   := blanks (quoted | bare)
    quoted  := '"' (char-but-quote | '""')* '"' blanks
    bare    := (char-but-quote-or-comma)*

Each rule consumes input at a position and either returns or reports a located error.  After an
error the parser is not trusted until the next *validated anchor*: a position that certainly
starts a record.  In tables of physical lines every line start is such an anchor, as a quoted
stretch may not cross a line end; in whole texts (``parse_text``) a line start is an anchor if
the record parsed from it has the full number of fields and a valid first field, so that a broken
quote neither swallows the records after it nor shifts them.
Parsing needs no neighbours, so it runs inside the scan, without a shuffle.  Lines that are plainly
valid (no quotes, the right number of fields, each of its kind) are told and typed by Column expressions;
only the others go through the descent.

Defined results: a null line is an empty line (one field, so ``columns``); blanks are spaces and
tabs, no other white space; the first reason that applies is the only one; columns of the input
other than ``file_id, line_no, line`` are left out; line 1 of a file is its header.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t"
MISSING = frozenset(("", "NA", "missing"))
NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\Z")
DIGITS = re.compile(r"[0-9]+\Z")
DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}\Z")
LARGEST = 9223372036854775807

FIELDS = (("date", "date"), ("ticker", "string"), ("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"), ("volume", "bigint"))
ARROW = {"date": pa.date32(), "string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}


class SyntaxFault(Exception):
    """A located error: the rule that failed and the offset in the line."""

    def __init__(self, reason: str, at: int):
        super().__init__(reason)
        self.reason, self.at = reason, at


class RecordParser:
    """Recursive descent over one text; ``pos`` is where the next rule starts."""

    def __init__(self, text: str, pos: int = 0, end: int | None = None):
        self.text, self.pos, self.end = text, pos, len(text) if end is None else end

    def blanks(self) -> None:
        while self.pos < self.end and self.text[self.pos] in BLANKS:
            self.pos += 1

    def quoted(self) -> str:
        start = self.pos
        self.pos += 1
        parts = []
        while True:
            close = self.text.find('"', self.pos, self.end)
            if close < 0:
                raise SyntaxFault("quoting", start)
            parts.append(self.text[self.pos : close])
            self.pos = close + 1
            if self.pos < self.end and self.text[self.pos] == '"':
                parts.append('"')
                self.pos += 1
                continue
            break
        self.blanks()
        if self.pos < self.end and self.text[self.pos] != ",":
            raise SyntaxFault("quoting", self.pos)
        return "".join(parts)

    def bare(self, start: int) -> str:
        comma = self.text.find(",", self.pos, self.end)
        stop = self.end if comma < 0 else comma
        stray = self.text.find('"', self.pos, stop)
        if stray >= 0:
            raise SyntaxFault("quoting", stray)
        self.pos = stop
        return self.text[start:stop].strip(BLANKS)

    def field(self) -> tuple[str, int]:
        start = self.pos
        self.blanks()
        if self.pos < self.end and self.text[self.pos] == '"':
            return self.quoted(), start
        return self.bare(start), start

    def record(self) -> list[tuple[str, int]]:
        fields = [self.field()]
        while self.pos < self.end:
            self.pos += 1  # field() stops only at a comma or at the end
            fields.append(self.field())
        return fields


def typed(fields: list[tuple[str, int]]) -> list:
    """The seven values of a record, or a located ``columns`` or ``value`` fault."""
    if len(fields) != len(FIELDS):
        raise SyntaxFault("columns", fields[min(len(fields), len(FIELDS)) - 1][1])
    out: list = []
    for (name, kind), (text, at) in zip(FIELDS, fields):
        if kind == "date":
            try:
                out.append(datetime.date.fromisoformat(text) if DAY.match(text) else None)
            except ValueError:
                out.append(None)
            if out[-1] is None:
                raise SyntaxFault("value", at)
        elif text in MISSING:
            if name == "ticker":
                raise SyntaxFault("value", at)
            out.append(None)
        elif kind == "double":
            if not NUMBER.match(text):
                raise SyntaxFault("value", at)
            out.append(float(text))
        elif kind == "bigint":
            # the length is looked at first: int() of a very long text is slow and refused
            if not DIGITS.match(text) or len(text.lstrip("0")) > 19 or int(text.lstrip("0") or "0") > LARGEST:
                raise SyntaxFault("value", at)
            out.append(int(text.lstrip("0") or "0"))
        else:
            out.append(text)
    return out


def parse_line(line: str | None) -> tuple[list | None, str | None, int | None]:
    """(values, None, None), or (None, reason, offset)."""
    line = line or ""
    try:
        return typed(RecordParser(line).record()), None, None
    except SyntaxFault as fault:
        return None, fault.reason, fault.at


def parse_text(text: str) -> Iterator[tuple[int, str, list | None, str | None, int | None]]:
    """Records of a whole text: (offset, raw, values, reason, offset of the error).

    Quoted fields may hold line ends here.  A record whose quotes are broken ends at the first
    line start after it from which a record validates (the anchor), or at its own line end.
    """
    pos = 0
    while pos < len(text):
        eol = text.find("\n", pos)
        eol = len(text) if eol < 0 else eol
        values, reason, at = parse_line(text[pos:eol].rstrip("\r"))
        stop = eol
        if reason == "quoting":
            # a quoted field may go on over line ends; it is accepted only if all lines up to its
            # end make one valid record and no line start between them is an anchor
            reach = eol
            while reach < len(text):
                following = text.find("\n", reach + 1)
                following = len(text) if following < 0 else following
                if parse_line(text[reach + 1 : following].rstrip("\r"))[1] is None:
                    break  # an anchor: whatever came before is broken
                whole = parse_line(text[pos:following].rstrip("\r"))
                if whole[1] is None:
                    (values, reason, at), stop = whole, following
                    break
                reach = following
        yield pos, text[pos:stop], values, reason, None if at is None else pos + at
        pos = stop + 1


_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_PLAIN = rf'^[ \t]*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})[ \t]*,[^",]*(?:,[ \t]*(?:{_NUMBER}|NA|missing)?[ \t]*){{4}},[ \t]*(?:[0-9]{{1,18}}|NA|missing)?[ \t]*\z'


def _cell(i: int) -> Column:
    return F.btrim(F.get(F.split("line", ","), i), F.lit(BLANKS))


def plainly_valid() -> Column:
    """Whether ``line`` is a valid record that needs no descent; a year 0 is left to the descent."""
    day = F.regexp_extract("line", _PLAIN, 1)
    return F.coalesce((day != "") & ~day.startswith("0000") & day.try_cast("date").isNotNull() & ~_cell(1).isin(*sorted(MISSING)), F.lit(False))


_SCHEMA = ", ".join(f"{n} {k}" for n, k in FIELDS) + ", reason string, error_at int, line string"


def _told(got: list[tuple], lines: list[str | None]) -> list[pa.Array]:
    """Columns of parsed records: the values, the reason, the place of the error, the line of failed ones."""
    columns = [pa.array([v[i] if v is not None else None for v, _, _ in got], ARROW[kind]) for i, (_, kind) in enumerate(FIELDS)]
    bad = [line if r is not None else None for (_, r, _), line in zip(got, lines)]
    return [*columns, pa.array([r for _, r, _ in got], pa.string()), pa.array([a for _, _, a in got], pa.int32()), pa.array(bad, pa.string())]


def parse_rows(lines: DataFrame) -> DataFrame:
    """``file_id, line_no``, the seven typed fields, and ``reason, error_at, line`` of failed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            columns = [batch.column(0), batch.column(1), *_told([parse_line(x) for x in texts], texts)]
            yield pa.RecordBatch.from_arrays(columns, ["file_id", "line_no", *[n for n, _ in FIELDS], "reason", "error_at", "line"])

    body = lines.where(F.col("line_no") > 1).select(F.col("file_id").cast("bigint"), F.col("line_no").cast("int"), F.col("line").cast("string"))
    none = lambda kind: F.lit(None).cast(kind)
    known = body.where(plainly_valid()).select(
        "file_id", "line_no", *[_cell(i).try_cast(kind).alias(n) for i, (n, kind) in enumerate(FIELDS)],
        none("string").alias("reason"), none("int").alias("error_at"), none("string").alias("line"),
    )
    return known.unionByName(body.where(~plainly_valid()).mapInArrow(run, f"file_id bigint, line_no int, {_SCHEMA}"))


def parse_texts(texts: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """Records of whole texts, whose quoted fields may hold line ends.

    ``<key>, record_no, start``, the seven typed fields, and ``reason, error_at, line`` of stretches that are no record.
    ``start`` and ``error_at`` are offsets in the text; after a broken quote records go on at the next validated anchor.
    A null text has no records; the first record is not taken for a header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "record_no", "start", *[n for n, _ in FIELDS], "reason", "error_at", "line"]
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(enumerate(parse_text(batch.column(1)[i].as_py() or ""), 1))
                for a in range(0, len(found), 10_000):
                    part = found[a : a + 10_000]
                    told = _told([(v, r, at) for _, (_, _, v, r, at) in part], [raw for _, (_, raw, *_) in part])
                    owner = batch.column(0).take(pa.array([i] * len(part)))
                    yield pa.RecordBatch.from_arrays([owner, pa.array([n for n, _ in part], pa.int64()), pa.array([x[0] for _, x in part], pa.int64()), *told], names)

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, record_no bigint, start bigint, {_SCHEMA}")


def bad_rows(lines: DataFrame) -> DataFrame:
    """``file_id, line_no, reason, error_at, line`` of the lines that are no record."""
    return parse_rows(lines).where(F.col("reason").isNotNull()).select("file_id", "line_no", "reason", "error_at", "line")


def good_rows(lines: DataFrame) -> DataFrame:
    """The typed rows of all other lines."""
    return parse_rows(lines).where(F.col("reason").isNull()).drop("reason", "error_at", "line")
