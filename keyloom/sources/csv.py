"""Loading delimited files whose headers may differ.

Files are grouped by header (only first lines are read to tell), each group is read by Spark's CSV
reader under its own names, and the groups are put together by name; columns that a file does not have
are missing.  All cells are read as text, missing spellings become null, and types are found in
one pass over everything (not from the first rows), so a late value never breaks a column.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce as fold_left
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.frame import ARRAY, TABLE, KeyedFrame, quoted

# Cells that mean missing.
NASTRINGS = ("", "NA", "#NA", "N/A", "#N/A", "missing", "null", "NaN")

_WHOLE, _NUMBER, _DAY = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_STAMP, _TRUTH = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$", r"^(?i:true|false)$"
MANY_FILES = 1000  # up to so many the driver reads the headers itself
_KINDS: list[tuple[str, str, T.DataType]] = [
    ("long", _WHOLE, T.LongType()),
    ("double", _NUMBER, T.DoubleType()),
    ("date", _DAY, T.DateType()),
    ("stamp", _STAMP, T.TimestampNTZType()),
    ("bool", _TRUTH, T.BooleanType()),
]


def _status(spark: SparkSession, pattern: str) -> list[Any]:
    """What a path or pattern stands for, on any file system that Hadoop knows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return list(found) if found is not None else []


def resolve_files(files: str | Sequence[str], spark: SparkSession | None = None) -> list[str]:
    """Paths, directories (visible regular files, not recursive) and patterns as a list of files."""
    spark = spark or SparkSession.getActiveSession()
    given = [files] if isinstance(files, str) else list(files)
    out: list[str] = []
    for f in given:
        found = _status(spark, f)
        if not found:
            raise FileNotFoundError(f"{f} is neither a file nor a directory")
        for status in found:
            path = status.getPath()
            if not status.isDirectory():
                out.append(path.toString())
                continue
            inside = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
            out += sorted(s.getPath().toString() for s in inside if s.isFile() and s.getPath().getName()[0] not in "._")
    if not out:
        raise ValueError("there are no files to load")
    return out


def canonical(name: str) -> str:
    """A name from a header: trimmed, unquoted, inner white space as underscores."""
    bare = name.strip()
    if len(bare) >= 2 and bare[0] == bare[-1] == '"':
        bare = bare[1:-1].strip()
    return re.sub(r"\s+", "_", bare)


def _split(line: str, delim: str, quote: str, spaces: bool) -> list[str]:
    if spaces:
        return line.split()
    import csv

    return next(csv.reader([line], delimiter=delim, quotechar=quote or '"', skipinitialspace=True), [])


def _first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    stream = where.getFileSystem(conf).open(where)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    if codec is not None:
        stream = codec.createInputStream(stream)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        return [reader.readLine() or "" for _ in range(n)]
    finally:
        reader.close()


def _headers(spark: SparkSession, paths: list[str], delim: str, quote: str, spaces: bool, skip: int) -> list[list[str]]:
    """The header of each file; only first lines are read, many files at a time."""
    parse = lambda line: [canonical(n) for n in _split(line.lstrip("\ufeff").rstrip("\r\n"), delim, quote, spaces)]
    if len(paths) <= MANY_FILES:
        with ThreadPoolExecutor(min(32, len(paths))) as pool:
            return list(pool.map(lambda p: parse(_first_lines(spark, p, skip + 1)[-1]), paths))
    # many files: tasks read their beginnings; one line a file comes back
    place = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = lines.where(F.col("block") == 0).withColumn("n", place).where(F.col("n") == skip + 1)
    found = {_bare(r["file"]): r["value"] for r in first.select("file", "value").collect()}
    return [parse(found.get(_bare(p), "")) for p in paths]


def _bare(path: str) -> str:
    """A path as both file listing and scans name it."""
    return unquote(re.sub("^file:/*", "/", path))


def _read(spark: SparkSession, paths: list[str], names: list[str], header: bool, delim: str, quote: str, escape: str, spaces: bool, skip: int, multiline: bool, longer: str) -> DataFrame:
    """The body of files of one header, all text, with ``__file``."""
    if spaces or skip:
        lines = spark.read.text(paths).select(F.col("value"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
        if skip or header:
            # lines to leave out stand at the start of each file; only the first block of a file can hold them
            first = lines.where(F.col("__block") == 0)
            cut = skip + (1 if header else 0)
            w = Window.partitionBy("__file").orderBy("__at")
            dropped = first.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cut).select("__file", "__at")
            lines = lines.join(dropped, ["__file", "__at"], "left_anti")
        if spaces:
            cells = F.split(F.btrim("value"), r"\s+")
            return lines.select(*[F.get(cells, i).alias(n) for i, n in enumerate(names)], "__file")
        parsed = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), {"sep": delim, "quote": quote, "escape": escape, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
        return lines.where(F.length("value") > 0).select(parsed.alias("r"), "__file").select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], "__file")
    reader = (
        spark.read.schema(T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("__record", T.StringType())]))
        .option("columnNameOfCorruptRecord", "__record").option("multiLine", multiline)
        .option("sep", delim).option("quote", quote).option("escape", escape).option("header", header).option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE")
    )
    df = reader.csv(paths)
    if longer == "error":
        # records whose number of cells is not that of the header come with their text; short ones are filled up
        parsed = F.from_csv("__record", ", ".join(f"c{i} string" for i in range(len(names) + 1)), {"sep": delim, "quote": quote, "escape": escape, "nullValue": "\u0000", "emptyValue": ""})
        more = F.col("__record").isNotNull() & parsed.getField(f"c{len(names)}").isNotNull()
        more = more & F.coalesce(F.length("c0") >= 0, F.lit(True))  # Spark does not read that column alone
        df = df.where(F.when(more, F.raise_error(F.concat(F.lit("a record has more cells than the header: "), F.col("__record"))).cast("boolean")).otherwise(F.lit(True)))
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("_metadata.file_path").alias("__file"))


def _typed(df: DataFrame, columns: list[str], parsers: dict[str, Any]) -> DataFrame:
    """The narrowest type that all cells of a column have; columns without any cell stay text."""
    free = [c for c in columns if c not in parsers]
    if free:
        tests = []
        for i, c in enumerate(free):
            tests.append(F.count(quoted(c)).alias(f"n{i}"))
            tests += [F.count_if(quoted(c).rlike(p)).alias(f"{k}{i}") for k, p, _ in _KINDS]
        counts = df.agg(*tests).first()
    cast: dict[str, Column] = {}
    for i, c in enumerate(free):
        n = counts[f"n{i}"]
        for k, _, kind in _KINDS:
            if n and counts[f"{k}{i}"] == n:
                cast[c] = quoted(c).try_cast(kind)
                break
    for c, parser in parsers.items():
        if callable(parser) and not isinstance(parser, (type, T.DataType)):
            cast[c] = parser(quoted(c))
        else:
            cast[c] = quoted(c).try_cast(parser if isinstance(parser, (str, T.DataType)) else {int: "bigint", float: "double", str: "string", bool: "boolean"}[parser])
    return df.withColumns(cast) if cast else df


def _load(
    files: str | Sequence[str],
    spark: SparkSession | None = None,
    indexcols: Sequence[Any] = (),
    datacols: Sequence[Any] | None = None,
    delim: str = ",",
    spacedelim: bool = False,
    quotechar: str = '"',
    escapechar: str = '"',
    filenamecol: str | tuple[str, Callable] | None = None,
    header_exists: bool = True,
    colnames: Sequence[str] | None = None,
    samecols: Sequence[Sequence[str]] = (),
    colparsers: dict[Any, Any] | None = None,
    nastrings: Sequence[str] = NASTRINGS,
    skiplines_begin: int = 0,
    multiline: bool = True,
    long_records: str = "error",
    chunks: int | None = None,
    agg: Any = None,
    output: str | None = None,
    append: bool = False,
    kind: str = TABLE,
    **ignored: Any,
) -> KeyedFrame:
    if long_records not in ("error", "drop"):
        raise ValueError("long_records must be error or drop")
    unknown = set(ignored) - {"distributed", "type_detect_rows", "usecache", "presorted", "copy", "csvread", "row_estimate"}
    if unknown:
        raise TypeError(f"unknown options {sorted(unknown)}")
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise ValueError("there is no active session")
    paths = resolve_files(files, spark)
    groups: dict[tuple[str, ...], list[str]] = {}
    for p, names in zip(paths, _headers(spark, paths, delim, quotechar, spacedelim, skiplines_begin)):
        if colnames:
            names = list(colnames)
        elif not header_exists:
            names = [f"_{i}" for i in range(1, len(names) + 1)]
        same = {alt: group[0] for group in samecols for alt in group}
        names = [same.get(n, n) for n in names]
        if not any(names):
            raise ValueError(f"{p} has no columns")
        if len(set(names)) != len(names):
            raise ValueError(f"{p} has a column twice: {names}")
        groups.setdefault(tuple(names), []).append(p)
    frames = [_read(spark, ps, list(ns), header_exists, delim, quotechar, escapechar, spacedelim, skiplines_begin, multiline, long_records) for ns, ps in groups.items()]
    df = fold_left(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    columns = list(dict.fromkeys(n for ns in groups for n in ns))
    df = df.select(*[F.when(~F.btrim(quoted(c)).isin(*nastrings), quoted(c)).alias(c) for c in columns], "__file")

    def find(sel: Any) -> str | None:
        for s in sel if isinstance(sel, (tuple, list)) else [sel]:
            if isinstance(s, int) and 1 <= s <= len(columns):
                return columns[s - 1]
            if s in columns:
                return s
        return None

    df = _typed(df, columns, {find(c): p for c, p in (colparsers or {}).items() if find(c)})
    if filenamecol is not None:
        name, f = filenamecol if isinstance(filenamecol, tuple) else (filenamecol, None)
        base = F.element_at(F.split(F.col("__file"), "/"), -1)
        shown = f(base) if f else F.regexp_replace(base, r"(?i)\.csv$", "")
        df = df.select(shown.alias(name), *[quoted(c) for c in columns], "__file")
        columns = [name, *[c for c in columns if c != name]]
    keys, taken, out = [], [], []
    for s in indexcols:
        found = find(s)
        if found is None:
            raise ValueError(f"no index column {s!r}; there are {columns}")
        # of alternative names the key takes the first
        keys.append(s[0] if isinstance(s, (tuple, list)) and isinstance(s[0], str) else found)
        taken.append(found)
        out.append(quoted(found).alias(keys[-1]))
    data = [c for c in columns if c not in taken]
    if datacols is not None:
        data = []
        for s in datacols:
            found = find(s)
            data.append(found or (s if isinstance(s, str) else s[0]))
            out.append(quoted(found) if found else F.lit(None).cast("string").alias(data[-1]))
    else:
        out += [quoted(c) for c in data]
    if not data:
        raise ValueError("there are no data columns")
    final = df.select(*out) if kind == TABLE or keys else df.select(*out, "__file")
    if chunks:
        final = final.repartition(chunks)
    if kind == ARRAY and not keys:
        # an implicit dimension 1..n: order of files, then of rows
        order = F.array_position(F.array(*[F.lit(re.sub("^file:/*", "/", p)) for p in paths]), F.regexp_replace("__file", "^file:/*", "/"))
        numbered = KeyedFrame(final.withColumn("__order", order).withColumn("__at", F.monotonically_increasing_id()), ["__order", "__at"]).with_row_number("_1", _next_number(spark, output) if append and output else 1)
        frame = KeyedFrame(numbered.select("_1", *[quoted(c) for c in data]), ["_1"], ARRAY)
    else:
        frame = KeyedFrame(final, keys, kind)
        nullable = [k for k in keys if frame.schema[k].nullable]
        if nullable and not final.where(fold_left(lambda a, b: a | b, [quoted(k).isNull() for k in nullable])).isEmpty():
            warnings.warn(f"some keys of {nullable} are missing", stacklevel=3)
        if agg is not None:
            from keyloom.operators.group import groupreduce

            frame = KeyedFrame(groupreduce(frame, [(v, v, agg) for v in frame.values], keys).df, keys, kind)
    if output:
        from keyloom.sources.store import load, save

        save(frame, output, append=append)
        return load(output, spark)
    return frame


def _next_number(spark: SparkSession, path: str) -> int:
    """The number after the last one saved, so that appended rows go on counting."""
    from keyloom.sources.store import exists, load

    if not exists(spark, path):
        return 1
    saved = load(path, spark)
    return (saved.df.agg(F.max(quoted(saved.keys[0]))).first()[0] or 0) + 1


def load_table(files: str | Sequence[str], **options: Any) -> KeyedFrame:
    """A table from files.

    Options: ``indexcols`` (names, positions, tuples of alternative names), ``datacols`` (a subset
    in order; an absent one is all missing), ``delim``, ``spacedelim``, ``quotechar``,
    ``escapechar``, ``filenamecol`` (a name, or (name, function of the file name)),
    ``header_exists``, ``colnames``, ``samecols`` (groups of names for the same column),
    ``colparsers`` (types or functions), ``nastrings``, ``skiplines_begin``, ``chunks``, ``agg``,
    ``output`` and ``append``, ``multiline`` (quoted cells may hold line ends, so a file is read by one task;
    False lets large files be split), ``long_records`` (what becomes of a record with more cells than the header:
    "error", or "drop" for the cells beyond it).  ``distributed``, ``type_detect_rows``, ``usecache``, ``presorted``
    and ``copy`` are accepted and have no effect.
    """
    return _load(files, kind=TABLE, **options)


def load_array(files: str | Sequence[str], **options: Any) -> KeyedFrame:
    """A sparse array from files; without ``indexcols`` rows are numbered from 1."""
    return _load(files, kind=ARRAY, **options)


load_files = load_array


def ingest(files: str | Sequence[str], output: str, **options: Any) -> KeyedFrame:
    """Load files as an array and keep it saved in ``output``."""
    return load_array(files, output=output, **options)


def ingest_append(files: str | Sequence[str], output: str, **options: Any) -> KeyedFrame:
    """Add files to what is saved in ``output``."""
    return load_array(files, output=output, append=True, **options)


def csvread(files: str | Sequence[str], **options: Any) -> DataFrame:
    """The plain DataFrame of files."""
    return load_table(files, **options).df


def glob(pattern: str) -> list[str]:
    """The files and directories that match a pattern, sorted."""
    return sorted(s.getPath().toString() for s in _status(SparkSession.getActiveSession(), pattern))


def dateformat(pattern: str) -> Callable[[Column], Column]:
    """A column parser for dates written in a pattern; unreadable cells are missing."""
    return lambda c: F.try_to_date(c, pattern) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(c, F.lit(pattern)))
