"""Schemas that drift between files.

Every file brings its own header.  For each file and column path the operator keeps a tagged
union: how many cells fall into each alternative (missing, long, double, date, string).  Unions
of parallel files are fused by adding counts, which is associative, so all counting is done with
map-side combined aggregates keyed by (file, position); a line never meets its header before the
counts are a few rows a file.  Comparing the union of a file with that of the file before it
yields the changes; following the renames backwards yields one canonical name for each column,
and conflicting alternatives become typed branches beside a canonical conversion.

Defined results: a file without lines has no columns; an empty header cell is a column with the
empty name; of a name repeated in one header the leftmost column counts; missing trailing cells
are missing, cells beyond the header are ignored; a null line is an empty line.  Files without a
feed are compared among themselves.  Two old names whose carried cells both agree with one new
name (or the reverse) are all renamed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import cells
from keyloom.session import checkpointed, guarded_broadcast, previous_row

TAGS = ("long", "double", "date", "string")


def column_unions(lines: DataFrame) -> DataFrame:
    """One row for each file and header column: ``file_id, pos, name`` and a count for each tag.

    ``lines`` has ``file_id, line_no, line``; line 1 is the header.
    """
    lines = lines.select("file_id", "line_no", "line")
    header = (
        lines.where(F.col("line_no") == 1)
        .groupBy("file_id")
        .agg(F.min("line").alias("line"))
        .select("file_id", F.posexplode(cells.split_cells(F.col("line"))).alias("pos", "cell"))
        .select("file_id", "pos", cells.column_name(F.col("cell")).alias("name"))
        .groupBy("file_id", "name")
        .agg(F.min("pos").alias("pos"))
    )
    counts = (
        lines.where(F.col("line_no") > 1)
        .select("file_id", F.posexplode(cells.split_cells(F.col("line"))).alias("pos", "cell"))
        .select("file_id", "pos", cells.tag(cells.clean(F.col("cell"))).alias("tag"))
        .groupBy("file_id", "pos")
        .agg(*[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in TAGS])
    )
    joined = header.join(counts, ["file_id", "pos"], "left")
    return joined.select("file_id", "pos", "name", *[F.coalesce(f"n_{t}", F.lit(0)).alias(f"n_{t}") for t in TAGS])


def union_type(long: str = "n_long", double: str = "n_double", date: str = "n_date", string: str = "n_string"):
    """The narrowest type that holds all alternatives of a union; null where no cell has a value."""
    n = [F.col(c) for c in (long, double, date, string)]
    whole, number, day, text = n
    return (
        F.when(whole + number + day + text == 0, F.lit(None).cast("string"))
        .when((number + day + text) == 0, F.lit("long"))
        .when((day + text) == 0, F.lit("double"))
        .when((whole + number + text) == 0, F.lit("date"))
        .otherwise(F.lit("string"))
    )


def _carried_cells(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """``later_id, side, k, pos, cell`` of the carried records: side 1 the later file's, 0 the earlier file's.

    Only the records that a file carries are looked at: the first of a file and the last of the
    file before it.  Both ends are cut by a map-side limited ranking before anything is joined.
    """
    most = pairs.agg(F.max("carried")).first()[0] or 0
    body = lines.where(F.col("line_no") > 1)
    head = body.where(F.col("line_no") <= most + 1)
    later = head.join(pairs.select("file_id", "carried"), "file_id").where(F.col("line_no") <= F.col("carried") + 1)
    later = later.select(F.col("file_id").alias("later_id"), F.lit(1).alias("side"), (F.col("line_no") - 1).alias("k"), "line")
    # rank 1 is the last record of a file; tasks drop their other rows before the shuffle
    back = Window.partitionBy("file_id").orderBy(F.col("line_no").desc())
    tail = body.withColumn("back", F.row_number().over(back)).where(F.col("back") <= most)
    wanted = pairs.select(F.col("file_id").alias("later_id"), F.col("before_id").alias("file_id"), "carried")
    earlier = tail.join(wanted, "file_id").where(F.col("back") <= F.col("carried"))
    earlier = earlier.select("later_id", F.lit(0).alias("side"), (F.col("carried") - F.col("back") + 1).alias("k"), "line")
    both = later.unionByName(earlier)
    return both.select("later_id", "side", "k", F.posexplode(cells.split_cells(F.col("line"))).alias("pos", "cell")).select(
        "later_id", "side", "k", "pos", cells.clean(F.col("cell")).alias("cell")
    )


def _compared(lines: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Files with the file before; columns of every pair on both sides; renames (the new and old columns that agree); unions."""
    catalog = catalog.select("file_id", "feed", "written_at", F.coalesce("carried", F.lit(0)).cast("int").alias("carried"))
    feed = F.coalesce(F.col("feed"), F.lit(""))
    files = previous_row(catalog.withColumn("feed", feed), ["feed"], "written_at", "file_id", ["file_id"])
    pairs = files.select("file_id", "feed", "written_at", "carried", F.col("prev_row.file_id").alias("before_id"))
    pairs = checkpointed(pairs)
    unions = checkpointed(column_unions(lines).withColumn("type", union_type()))
    linked = pairs.where(F.col("before_id").isNotNull())
    now = unions.join(linked.select("file_id"), "file_id").select("file_id", "name", "pos", "type")
    before = linked.select("file_id", F.col("before_id").alias("b")).join(
        unions.select(F.col("file_id").alias("b"), "name", F.col("pos").alias("before_pos"), F.col("type").alias("before_type")), "b"
    )
    sides = now.join(before.drop("b"), ["file_id", "name"], "full")

    found = _carried_cells(lines, linked.where(F.col("carried") > 0))
    only = sides.where(F.col("pos").isNull() | F.col("before_pos").isNull())
    alone = only.select(
        F.col("file_id").alias("later_id"), F.col("pos").isNotNull().cast("int").alias("side"), F.coalesce("pos", "before_pos").alias("pos"),
        F.struct("name", F.coalesce("type", "before_type").alias("type")).alias("column"),
    )
    # columns agree in all cells if they have the same cells that are not missing; such columns meet in one
    # row, so no pairs of columns are formed
    told = found.where(~cells.is_missing(F.col("cell"))).join(alone, ["later_id", "side", "pos"])
    told = told.select("later_id", "side", "column", "k", cells.comparable(F.col("cell")).alias("key"))
    columns = told.groupBy("later_id", "side", "column").agg(F.sort_array(F.collect_list(F.struct("k", "key"))).alias("held"))
    met = columns.groupBy("later_id", "held").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == 1, F.col("column")))).alias("new"), F.sort_array(F.collect_list(F.when(F.col("side") == 0, F.col("column")))).alias("old")
    )
    renames = met.where((F.size("new") > 0) & (F.size("old") > 0)).select(F.col("later_id").alias("file_id"), "new", "old")
    return pairs, sides, checkpointed(renames), unions


def _changes(sides: DataFrame, renames: DataFrame) -> DataFrame:
    only_now, only_before = F.col("before_pos").isNull(), F.col("pos").isNull()
    differ = F.col("type").isNotNull() & F.col("before_type").isNotNull() & (F.col("type") != F.col("before_type"))
    kept = sides.where(~only_now & ~only_before & differ).select("file_id", F.col("name").alias("column_name"), F.lit("retyped").alias("change_kind"))
    new = renames.select("file_id", F.explode("new").alias("column"), "old")
    olds = renames.select("file_id", F.explode("old.name").alias("name"))
    renamed = new.select("file_id", F.col("column.name").alias("column_name"), F.lit("renamed").alias("change_kind"))
    added = sides.where(only_now).join(new.select("file_id", F.col("column.name").alias("name")), ["file_id", "name"], "left_anti")
    removed = sides.where(only_before).join(olds, ["file_id", "name"], "left_anti")
    moved = new.where(F.exists("old.type", lambda t: t != F.col("column.type"))).select("file_id", F.col("column.name").alias("column_name"), F.lit("retyped").alias("change_kind"))
    label = lambda d, kind: d.select("file_id", F.col("name").alias("column_name"), F.lit(kind).alias("change_kind"))
    return kept.unionByName(renamed).unionByName(label(added, "added")).unionByName(label(removed, "removed")).unionByName(moved)


def schema_changes(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """``file_id, column_name, change_kind`` of every file against the file before it of its feed.

    ``catalog`` has ``file_id, feed, written_at, carried``, one row for each file of ``lines``;
    ``carried`` is the number of leading records that repeat the last records of the file before.
    Kinds: renamed, added, removed, retyped.
    """
    _, sides, renames, _ = _compared(lines, catalog)
    return _changes(sides, renames)


def appearing_alternatives(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """``file_id, column_name, alternative`` that a column holds and did not hold in the file before.

    Unlike ``retyped`` it also tells alternatives inside a wider type, such as the first dates of a
    string column.  Only columns that were in the file before, under this name or an old one, are
    compared; a column without values before holds no alternative there.
    """
    pairs, sides, renames, unions = _compared(lines, catalog)
    kept = sides.where(F.col("before_pos").isNotNull() & F.col("pos").isNotNull()).select("file_id", F.concat(F.lit("="), F.col("name")).alias("group"), "name")
    group = F.concat(F.lit(">"), F.col("new")[0]["name"])
    now = kept.unionByName(renames.select("file_id", group.alias("group"), F.explode("new.name").alias("name")))
    before = kept.unionByName(renames.select("file_id", group.alias("group"), F.explode("old.name").alias("name")))
    tags = F.array_compact(F.array(*[F.when(F.col(f"n_{t}") > 0, F.lit(t)) for t in TAGS]))
    held = unions.select("file_id", "name", F.explode(tags).alias("alternative"))
    old = held.select(F.col("file_id").alias("before_id"), "name", "alternative")
    seen = before.join(pairs.select("file_id", "before_id"), "file_id").join(old, ["before_id", "name"]).select("file_id", "group", "alternative").distinct()
    new = held.join(now, ["file_id", "name"]).join(seen, ["file_id", "group", "alternative"], "left_anti")
    return new.select("file_id", F.col("name").alias("column_name"), "alternative")


def _descent(renames: DataFrame) -> DataFrame:
    """``file_id, name, old_name``: the renames paired one to one.

    Columns that agree are alike in all carried cells; they are paired in order, and a name left over has no
    ancestor.
    """
    pair = F.explode(F.arrays_zip(F.col("new.name").alias("new"), F.col("old.name").alias("old"))).alias("pair")
    return renames.select("file_id", pair).select("file_id", F.col("pair.new").alias("name"), F.col("pair.old").alias("old_name")).where(F.col("name").isNotNull() & F.col("old_name").isNotNull())


def canonical_names(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """``file_id, pos, name, type, canonical``: each column with the name its oldest ancestor had.

    No two columns of a file have the same one.  Where a column is renamed and a new column takes
    its old name, the column whose ancestor is older keeps the plain name; the other one is
    ``<name>@<file_id of its ancestor>`` in all of its files.  Ancestors are found by pointer doubling
    over (file, name) nodes, so a chain of n files takes about log2(n) joins of a few rows a file.
    """
    pairs, sides, renames, unions = _compared(lines, catalog)
    before = pairs.select("file_id", "before_id")
    kept = sides.where(F.col("before_pos").isNotNull() & F.col("pos").isNotNull()).select("file_id", "name", F.col("name").alias("old_name"))
    link = _descent(renames).unionByName(kept).join(before, "file_id")
    nodes = (
        unions.join(link, ["file_id", "name"], "left")
        .select(
            "file_id", "pos", "name", "type",
            F.coalesce("before_id", "file_id").alias("up_id"),
            F.when(F.col("before_id").isNull(), F.col("name")).otherwise(F.col("old_name")).alias("up_name"),
        )
    )
    nodes = checkpointed(nodes)
    while True:
        up = nodes.select(F.col("file_id").alias("up_id"), F.col("name").alias("up_name"), F.col("up_id").alias("top_id"), F.col("up_name").alias("top_name"))
        stepped = checkpointed(nodes.join(up, ["up_id", "up_name"], "left").select(
            "file_id", "pos", "name", "type",
            F.coalesce("top_id", "up_id").alias("up_id"), F.coalesce("top_name", "up_name").alias("up_name"),
            ((F.col("top_id") != F.col("up_id")) | (F.col("top_name") != F.col("up_name"))).alias("moved"),
        ))
        done = stepped.where("moved").isEmpty()
        nodes = stepped.drop("moved")
        if done:
            return _told_apart(nodes, pairs)


def _told_apart(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Canonical names from ancestors (``up_id, up_name``), which are unique in a file."""
    age = pairs.select(F.col("file_id").alias("up_id"), F.struct(F.col("written_at").isNotNull(), "written_at", F.col("file_id").alias("id")).alias("age"))
    oldest = F.min("age").over(Window.partitionBy("file_id", "up_name"))
    aged = nodes.join(age, "up_id", "left").withColumn("younger", F.col("age") > oldest)
    # a header's own name of that form is told apart as well
    later = aged.where(F.col("younger") | F.col("up_name").rlike(r"@-?[0-9]+$")).select("up_id", "up_name").distinct().withColumn("later", F.lit(True))
    name = F.when(F.col("later"), F.concat("up_name", F.lit("@"), F.col("up_id").cast("string"))).otherwise(F.col("up_name"))
    return nodes.join(later, ["up_id", "up_name"], "left").select("file_id", "pos", "name", "type", name.alias("canonical"))


def _branches(value: Column, tag: Column) -> list[Column]:
    """The typed branches of a cell: the one of its own alternative is set (a long is a double as well)."""
    return [
        F.when(tag == "long", value.try_cast("bigint")).alias("long"),
        F.when(tag.isin("long", "double"), value.try_cast("double")).alias("double"),
        F.when(tag == "date", value.try_cast("date")).alias("date"),
        F.when(tag == "string", value).alias("text"),
    ]


def consistent_table(lines: DataFrame, catalog: DataFrame, fields: list[str]) -> DataFrame:
    """Every record of every file under one schema.

    For each name of ``fields`` (canonical names) there are the canonical conversion ``<f>`` (numbers
    as plain decimals, days and texts as they are) and the typed branches ``<f>_long``, ``<f>_double``,
    ``<f>_date``, ``<f>_text``, of which that of the cell's own alternative is set.  All other columns
    come in the map ``other`` from canonical name to ``canonical, long, double, date, text``.  Missing cells
    are null, and not in the map.
    """
    names = canonical_names(lines, catalog)
    shape = names.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "canonical"))).alias("shape"))
    body = lines.where(F.col("line_no") > 1).select("file_id", "line_no", cells.split_cells(F.col("line")).alias("cells"))
    # a few names a file: where they are few enough in all, lines stay where they are
    wide = body.join(guarded_broadcast(checkpointed(shape)), "file_id", "left")
    pairs = F.transform(F.col("cells"), lambda c, i: F.struct(F.col("shape")[i].alias("k"), cells.clean(c).alias("v")))
    pairs = F.filter(pairs, lambda p: p["k"].isNotNull() & ~cells.is_missing(p["v"]))
    record = wide.select("file_id", "line_no", pairs.alias("pairs"))
    value = lambda f: F.try_element_at(F.transform(F.filter("pairs", lambda p: p["k"] == f), lambda p: p["v"]), F.lit(1))
    record = record.withColumns({f"__{i}": value(f) for i, f in enumerate(fields)})
    out = [F.col("file_id"), F.col("line_no")]
    for i, f in enumerate(fields):
        cell = F.col(f"__{i}")
        out += [cells.canonical(cell).alias(f), *[b.alias(f"{f}_{n}") for b, n in zip(_branches(cell, cells.tag(cell)), ("long", "double", "date", "text"))]]
    rest = F.filter("pairs", lambda p: ~p["k"].isin(*fields)) if fields else F.col("pairs")
    typed = lambda p: F.struct(p["k"], F.struct(cells.canonical(p["v"]).alias("canonical"), *_branches(p["v"], cells.tag(p["v"]))))
    return record.select(*out, F.map_from_entries(F.transform(rest, typed)).alias("other"))
