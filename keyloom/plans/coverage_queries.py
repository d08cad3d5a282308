"""Queries for the operators that the star-schema queries do not reach: sources and sinks, selectors, access by
position, reducers and their odd forms, partitioning, features and timing.

What an operator returns to the driver (a length, a value, an error) comes as a small table.
"""

from __future__ import annotations

import uuid
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import keyloom as k
from keyloom import aggs, diagnostics
from keyloom.frame import KeyedFrame
from keyloom.operators.features import width
from keyloom.session import checkpoint_root

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str, keys=(), kind: str = "table") -> KeyedFrame:
    return KeyedFrame(spark.read.parquet(f"{d}/{name}.parquet"), keys, kind)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def facts(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def failing(f: Any) -> str:
    try:
        f()
    except Exception as e:  # the kind of error is the result
        return type(e).__name__
    return "none"


def written(df: DataFrame, path: str, order: str | None = None, **options: Any) -> str:
    """``df`` as CSV; in one file in an order, where that matters."""
    df = df.coalesce(1).sortWithinPartitions(order) if order else df
    df.write.options(header=True, **options).csv(path)
    return path


# -- sources and sinks ---------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def csv_load(spark, d):
    df = read(spark, d, "orders").df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return k.load_table(written(df, place(spark, "csv")), indexcols=["o_orderkey"]).df


@query("select p_partkey, p_name || chr(10) || '\"' || p_brand || '\", x' as note, p_size from part")
def csv_quoted_line_ends(spark, d):
    df = read(spark, d, "part").df.select("p_partkey", F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", x')).alias("note"), "p_size")
    return k.load_table(written(df, place(spark, "csv"), escape='"', quoteAll=True)).df


@query("select o_orderkey, o_totalprice from orders")
def csv_compressed(spark, d):
    df = read(spark, d, "orders").df.select("o_orderkey", "o_totalprice")
    return k.load_table(written(df, place(spark, "csv"), compression="gzip")).df


@query("select row_number() over (order by c_custkey) as _1, c_custkey, c_acctbal from customer")
def csv_array(spark, d):
    df = read(spark, d, "customer").df.select("c_custkey", "c_acctbal")
    return k.load_array(written(df, place(spark, "csv"), "c_custkey")).df


def _two_headers(spark, d) -> list[str]:
    s, c = read(spark, d, "supplier").df, read(spark, d, "customer").df
    return [
        written(s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), "s_nationkey"), place(spark, "csv"), "key"),
        written(c.select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id")), place(spark, "csv"), "id"),
    ]


@query("""select s_suppkey as key, s_name as name, s_nationkey, null::double as balance from supplier
union all select c_custkey, null, null, c_acctbal from customer""")
def csv_drift(spark, d):
    return k.load_table(_two_headers(spark, d), samecols=[("key", "id")]).df


@query("""select row_number() over (order by source, key) as _1, key, round(balance, 2) as balance from (
select 1 as source, s_suppkey as key, s_acctbal as balance from supplier union all select 2, c_custkey, c_acctbal from customer)""")
def csv_append(spark, d):
    s = read(spark, d, "supplier").df.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    c = read(spark, d, "customer").df.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    kept = place(spark, "kept")
    k.ingest(written(s, place(spark, "csv"), "key"), kept)
    return k.ingest_append(written(c, place(spark, "csv"), "key"), kept).df.withColumn("balance", F.round("balance", 2))


@query("""select n_nationkey, 'file' as source, case when n_regionkey = 2 then null else n_regionkey end as region, n_name as label, null::varchar as absent from nation""")
def csv_options(spark, d):
    df = read(spark, d, "nation").df.select("n_nationkey", F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 2, "none").otherwise(F.col("n_regionkey").cast("string")).alias("region"), F.lit("x").alias("rest"))
    path = written(df, place(spark, "csv"), sep="|")
    t = k.load_table(
        path, delim="|", filenamecol=("source", lambda n: F.when(n.startswith("part-"), F.lit("file"))), nastrings=["", "none"], colparsers={"region": int},
        indexcols=["n_nationkey"], datacols=["source", "region", ("label", "name"), "absent"], chunks=3,
    )
    return t.df.select("n_nationkey", "source", "region", F.col(t.columns[3]).alias("label"), "absent")


@query("select o_orderkey, o_orderdate::date as day from orders")
def csv_dateformat(spark, d):
    df = read(spark, d, "orders").df.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return k.load_table(written(df, place(spark, "csv")), colparsers={"day": k.dateformat("dd/MM/yyyy")}).df


@query("select s_suppkey, s_name, s_acctbal from supplier")
def csvread_glob(spark, d):
    path = written(read(spark, d, "supplier").df.select("s_suppkey", "s_name", "s_acctbal"), place(spark, "csv"))
    return k.csvread(k.glob(f"{path}/*.csv"))


@query("select * from (values ('no file', 'FileNotFoundError'), ('no option', 'TypeError'), ('no index', 'ValueError'), ('long record', 'SparkRuntimeException')) t(what, error)")
def csv_bad_input(spark, d):
    path = written(read(spark, d, "nation").df.select("n_nationkey", "n_name"), place(spark, "csv"))
    long = place(spark, "csv")
    spark.createDataFrame([("a,b",), ("1,2,3",)], "value string").coalesce(1).write.text(long)
    errors = {
        "no file": lambda: k.load_table(path + "-absent"),
        "no option": lambda: k.load_table(path, wrong=1),
        "no index": lambda: k.load_table(path, indexcols=["absent"]),
        "long record": lambda: k.load_table(long).df.collect(),
    }
    return facts(spark, [(n, failing(f)) for n, f in errors.items()], "what string, error string")


@query("select c_custkey, c_name, c_acctbal from customer")
def save_single(spark, d):
    path = place(spark, "saved")
    return k.load(path if k.save(read(spark, d, "customer", ["c_custkey"]).select(["c_custkey", "c_name", "c_acctbal"]), path, single=True) else "", spark).df


@query("select s_nationkey as nation, s_acctbal as balance from supplier union all select c_nationkey, c_acctbal from customer")
def save_append(spark, d):
    path = place(spark, "saved")
    s = read(spark, d, "supplier").df.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    c = read(spark, d, "customer").df.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    k.save(KeyedFrame(s, ["nation"]), path)
    return k.save(KeyedFrame(c, ["nation"]), path, append=True).df


@query("select c_nationkey, round(sum(c_acctbal), 2) as c_acctbal from customer group by all")
def array_agg(spark, d):
    df = read(spark, d, "customer").df.select("c_nationkey", "c_acctbal")
    return k.array(df, ["c_nationkey"], agg="+").df.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("select n_name, count(*) as n from nation join supplier on s_nationkey = n_nationkey group by n_name")
def table_from_sql(spark, d):
    for name in ("nation", "supplier"):
        read(spark, d, name).df.createOrReplaceTempView(f"keyloom_{name}")
    got = spark.sql("select n_name, count(*) as n from keyloom_nation join keyloom_supplier on s_nationkey = n_nationkey group by n_name")
    return k.table(got, keys=["n_name"]).df


@query("select * from (values (1, 'a', 0.5, 'dict'), (2, 'b', 1.5, 'dict'), (1, 'a', 0.5, 'pandas'), (2, 'b', 1.5, 'pandas'), (1, 'a', 0.5, 'rows'), (2, 'b', 1.5, 'rows')) t(x, y, z, source)")
def table_from_values(spark, d):
    data = {"x": [1, 2], "y": ["a", "b"], "z": [0.5, 1.5]}
    made = {"dict": k.table(data, spark=spark), "pandas": k.table(pd.DataFrame(data), spark=spark), "rows": k.table(list(zip(*data.values())), names=list(data), spark=spark)}
    return k.fromchunks([KeyedFrame(t.df.withColumn("source", F.lit(n))) for n, t in made.items()]).df


# -- partitions, materialisation, metadata -------------------------------------------------------------


def _sizes(t: KeyedFrame) -> DataFrame:
    return t.df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))


@query("select 6 as parts, count(*) as n, true as even from customer")
def distribute_number(spark, d):
    sizes = _sizes(read(spark, d, "customer").distribute(6))
    return sizes.agg(F.count("*").cast("int").alias("parts"), F.sum("n").alias("n"), (F.max("n") - F.min("n") <= 6).alias("even"))


@query("select * from (values (0, 5), (1, 13), (2, 7)) t(part, n)")
def distribute_sizes(spark, d):
    return _sizes(read(spark, d, "nation", ["n_nationkey"]).distribute([5, 13, 7]))


@query("select count(distinct c_nationkey) as nations, count(*) as n, 4 as parts from customer")
def distribute_like(spark, d):
    t = read(spark, d, "customer").distribute(read(spark, d, "nation").distribute(4))
    return t.df.agg(F.count_distinct("c_nationkey").alias("nations"), F.count("*").alias("n")).withColumn("parts", F.lit(t.df.rdd.getNumPartitions()))


@query("select s_suppkey as id, s_name as name, null::double as balance from supplier union all select c_custkey, null, c_acctbal from customer")
def fromchunks(spark, d):
    s = read(spark, d, "supplier").df.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = read(spark, d, "customer").df.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return k.fromchunks([KeyedFrame(s, ["id"]), KeyedFrame(c, ["id"]), KeyedFrame(c.limit(0), ["id"])]).df


@query("select n_nationkey, n_name, row_number() over (order by n_nationkey) as place from nation")
def compute_collect(spark, d):
    kept = read(spark, d, "nation", ["n_nationkey"]).select(["n_nationkey", "n_name"]).compute()
    rows = kept.copy().collect()
    kept.df.unpersist()
    return facts(spark, [(r[0], r[1], i) for i, r in enumerate(rows, 1)], "n_nationkey long, n_name string, place long")


@query("select (row_number() over (order by n_nationkey) - 1) // 7 as piece, n_nationkey from nation")
def partition_pieces(spark, d):
    pieces = read(spark, d, "nation", ["n_nationkey"]).select("n_nationkey").partition(7)
    return facts(spark, [(i, r[0]) for i, piece in enumerate(pieces) for r in piece], "piece long, n_nationkey long")


@query("""select count(*) as n, 1 as ndims, 'n_nationkey' as pkeys, 'n_name,n_regionkey' as vals, 'bigint' as keytype, 'n_nationkey,n_name,n_regionkey' as cols, true as shown from nation""")
def metadata(spark, d):
    t = read(spark, d, "nation", ["n_nationkey"]).select(["n_nationkey", "n_name", "n_regionkey"])
    shown = t.show(3).splitlines()
    row = (len(t), t.ndims, ",".join(t.pkeynames), ",".join(t.valuenames), t.keytype()["n_nationkey"].replace("int", "bigint").replace("bigbigint", "bigint"), ",".join(t.eltype()), len(shown) == 5 and t.dimlabels == t.keys and t.colnames == t.columns)
    return facts(spark, [row], "n long, ndims int, pkeys string, vals string, keytype string, cols string, shown boolean")


# -- selectors and columns ----------------------------------------------------------------------------


@query("select s_suppkey, s_nationkey, s_acctbal from supplier")
def select_keys_function(spark, d):
    t = read(spark, d, "supplier", ["s_suppkey"])
    return t.select(k.All(k.Keys(), lambda name: name.endswith(("key", "bal")))).df


@query("select (row_number() over (order by n_nationkey) * 10)::bigint as _1 from nation")
def select_literal_values(spark, d):
    t = read(spark, d, "nation", ["n_nationkey"])
    return t.select([float(10 * i) for i in range(1, len(t) + 1)]).df.select(F.col("_1").cast("bigint").alias("_1"))


@query("""select 'row' as kind, n_nationkey as key, n_name as value from nation union all select 'pair', n_nationkey, n_name from nation
union all select 'column', null, n_name from nation union all select 'key', n_nationkey, null from nation union all select 'value', null, n_name from nation
union all select 'columns', n_nationkey, null from nation""")
def access(spark, d):
    t = read(spark, d, "nation", ["n_nationkey"]).select(["n_nationkey", "n_name"])
    none = lambda kind: F.lit(None).cast(kind)
    out = [
        ("row", t.rows(), F.col("row.n_nationkey"), F.col("row.n_name")), ("pair", t.pairs(), F.col("key.n_nationkey"), F.col("value.n_name")),
        ("column", t.column("n_name"), none("bigint"), F.col("n_name")), ("key", t.key_rows(), F.col("n_nationkey"), none("string")),
        ("value", t.value_rows(), none("bigint"), F.col("n_name")), ("columns", t.column_frames("n_nationkey")["n_nationkey"], F.col("n_nationkey"), none("string")),
    ]
    return k.fromchunks([df.select(F.lit(n).alias("kind"), key.cast("bigint").alias("key"), value.alias("value")) for n, df, key, value in out]).df


@query("select s_suppkey, s_suppkey + 1 as next, s_name, 'x' as mark, s_acctbal * 2 as double from supplier")
def builder_edits(spark, d):
    b = k.ColumnBuilder(read(spark, d, "supplier", ["s_suppkey"]).select(["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]))
    b.insert_after("s_suppkey", "next", ("s_suppkey", lambda x: x + 1))
    b.insert_before("s_acctbal", "mark", ("s_name", lambda n: F.lit("x")))
    b["s_acctbal"] = ("s_acctbal", lambda x: x * 2)
    b.rename("s_acctbal", "double")
    del b["s_nationkey"]
    return b.build().df


@query("select c_nationkey, c_custkey, c_name from customer")
def reindex(spark, d):
    return read(spark, d, "customer", ["c_custkey"]).reindex(["c_nationkey", "c_custkey"], "c_name").convertmissing().df


# -- index and position ------------------------------------------------------------------------------------


@query("""select (select n_name from nation where n_nationkey = 7) as found, 'KeyError' as absent, (select n_name from nation order by n_nationkey desc limit 1) as last,
(select n_name from nation order by n_nationkey limit 1 offset 2) as third""")
def index_scalar(spark, d):
    t = k.array(read(spark, d, "nation").df.select("n_nationkey", "n_name"), ["n_nationkey"])
    row = (t.at(7), failing(lambda: t.at(999)), t.row_at(-1)["n_name"], t.row_at(3)["n_name"])
    return facts(spark, [row], "found string, absent string, last string, third string")


@query("select o_orderkey, o_totalprice from orders where o_orderkey between 3 and 20000 and (o_orderkey - 3) % 7 = 0")
def index_step(spark, d):
    t = k.array(read(spark, d, "orders").df.select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return t.at(range(3, 20001, 7)).df


@query("select o_orderkey, o_totalprice from (select *, row_number() over (order by o_orderkey) as r from orders) where r between 100 and 900")
def subtable(spark, d):
    return read(spark, d, "orders", ["o_orderkey"]).select(["o_orderkey", "o_totalprice"]).subtable(100, 900).df


@query("select s_suppkey, s_acctbal from supplier where s_acctbal < 0")
def mask(spark, d):
    return read(spark, d, "supplier").select(["s_suppkey", "s_acctbal"]).mask(F.col("s_acctbal") < 0).df


# -- joins --------------------------------------------------------------------------------------------------


@query("select s_nationkey, s_suppkey, c_custkey from supplier join customer on c_nationkey = s_nationkey")
def join_many(spark, d):
    return read(spark, d, "supplier").join(read(spark, d, "customer"), lkey="s_nationkey", rkey="c_nationkey", lselect="s_suppkey", rselect="c_custkey").df


_NATION_SUMS = "select {0}_nationkey as nation, round(sum({0}_acctbal), 2) as v from {1} group by all"


def _nation_sums(spark, d, p, name):
    df = read(spark, d, name).df.groupBy(F.col(f"{p}_nationkey").alias("nation")).agg(F.round(F.sum(f"{p}_acctbal"), 2).alias("v"))
    return KeyedFrame(df, ["nation"], "array")


@query(f"select nation, round(a.v + b.v, 2) as v from ({_NATION_SUMS.format('s', 'supplier')}) a join ({_NATION_SUMS.format('c', 'customer')}) b using (nation)")
def map_two_arrays(spark, d):
    got = k.map_pair(lambda a, b: a + b, _nation_sums(spark, d, "s", "supplier"), _nation_sums(spark, d, "c", "customer"))
    return got.df.withColumn("v", F.round("v", 2))


@query("""select c_nationkey, c_mktsegment, round(v * w, 2) as v from (select c_nationkey, c_mktsegment, count(*) as v from customer group by all)
join (select s_nationkey, count(*)::double as w from supplier group by all) on s_nationkey = c_nationkey""")
def broadcast_dimmap(spark, d):
    a = read(spark, d, "customer").df.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("v"))
    b = read(spark, d, "supplier").df.groupBy("s_nationkey").agg(F.count("*").cast("double").alias("w"))
    got = k.broadcast(lambda x, y: {"v": F.round(x * y, 2)}, KeyedFrame(a, ["c_nationkey", "c_mktsegment"], "array"), KeyedFrame(b, ["s_nationkey"], "array"), (1, 0))
    return got.df


@query("select o_orderkey, o_custkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey")
def rechunk_together(spark, d):
    a, b = read(spark, d, "orders", ["o_orderkey"]).rechunk_together(read(spark, d, "lineitem", ["l_orderkey"]))
    return a.join(b, lkey="o_orderkey", rkey="l_orderkey", lselect="o_custkey", rselect="l_linenumber").df


@query("""select l.at, coalesce(r.v, l.v) as v from (select o_orderkey as at, o_totalprice as v from orders where o_orderstatus = 'F') l
asof left join (select o_orderkey as at, o_totalprice as v from orders where o_orderstatus = 'P') r on l.at >= r.at""")
def asof_numbers(spark, d):
    side = lambda s: KeyedFrame(read(spark, d, "orders").df.where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("v")), ["at"], "array")
    return side("F").asofjoin(side("P")).df


# -- reducers --------------------------------------------------------------------------------------------


@query("""select round(sum(o_totalprice), 2) as total, min(o_totalprice) as least, max(o_orderkey) as newest, count(*) as n, round(avg(o_totalprice), 4) as mean from orders""")
def reduce_values(spark, d):
    t = read(spark, d, "orders")
    several = t.reduce({"least": ("o_totalprice", "min"), "newest": ("o_orderkey", "max"), "n": ("o_orderkey", "length")})
    row = (round(t.reduce("+", "o_totalprice"), 2), several["least"], several["newest"], several["n"], round(t.reduce("mean", "o_totalprice"), 4))
    return facts(spark, [row], "total double, least double, newest long, n long, mean double")


@query("select max(l_quantity)::bigint as largest, greatest(max(l_quantity), 1000)::bigint as with_init, sum(l_linenumber)::bigint + 5 as total from lineitem")
def reduce_binary(spark, d):
    t = read(spark, d, "lineitem")
    larger = lambda a, b: a if a > b else b
    row = (int(t.reduce(larger, "l_quantity")), int(t.reduce(larger, "l_quantity", init=1000.0)), t.reduce("+", "l_linenumber", init=5))
    return facts(spark, [row], "largest long, with_init long, total long")


@query("select o_custkey, round(max(o_totalprice), 2) as value from orders group by all")
def fold_rows(spark, d):
    best = k.Mergeable(lambda: None, lambda s, r: r["o_totalprice"] if s is None else max(s, r["o_totalprice"]), lambda a, b: max(a, b))
    return read(spark, d, "orders").fold(best, ["o_orderkey", "o_totalprice"], "o_custkey").df.withColumn("value", F.round("value", 2))


@query("select o_custkey, last(o_totalprice order by o_orderkey) as o_totalprice from orders group by all")
def reducedim_vector(spark, d):
    t = read(spark, d, "orders", ["o_custkey", "o_orderkey"], "array").selectvalues("o_totalprice")
    return t.reducedim_vec(lambda cells: float(cells.iloc[-1]), "o_orderkey", returns="double").df


@query("select round(avg(s_acctbal), 4) as mean, count(*) as n from supplier")
def groupby_empty_key(spark, d):
    t = read(spark, d, "supplier")
    return facts(spark, [(round(t.groupby("mean", (), "s_acctbal"), 4), t.groupby("length", (), "s_acctbal"))], "mean double, n long")


@query("select s_nationkey, s_nationkey * 100 + count(*) as code from supplier group by s_nationkey")
def groupby_usekey(spark, d):
    return read(spark, d, "supplier").groupby(lambda key, g: int(key[0]) * 100 + len(g), "s_nationkey", "s_suppkey", usekey=True, returns="code bigint").df


@query("select o_orderstatus, round(avg(o_totalprice), 4) as mean, round(var_samp(o_totalprice), 0) as var from orders group by all")
def aggregate_stats(spark, d):
    got = read(spark, d, "orders").aggregate_stats({"mean": ("o_totalprice", "mean"), "var": ("o_totalprice", "var")}, "o_orderstatus").df
    return got.withColumns({"mean": F.round("mean", 4), "var": F.round("var", 0)})


@query("select n_regionkey, round(product((n_nationkey + 1)::double), 0) as product, list_sort(list(distinct n_nationkey % 3)) as kinds from nation group by all")
def product_union(spark, d):
    t = read(spark, d, "nation").transform({"one_more": ("n_nationkey", lambda x: (x + 1).cast("double")), "kind": ("n_nationkey", lambda x: x % 3)})
    got = t.groupreduce({"product": ("one_more", "*"), "kinds": ("kind", "union")}, "n_regionkey").df
    return got.withColumn("product", F.round("product", 0))


@query("""select o_orderstatus, count(o_totalprice) as count, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as least, max(o_totalprice) as most,
count(*) filter (where o_totalprice > 100000) as many from orders group by all""")
def series_of_stats(spark, d):
    t = read(spark, d, "orders")
    got = t.groupreduce({"s": ("o_totalprice", aggs.series("count", "mean", "extrema")), "many": ("o_totalprice", aggs.filtered("count", lambda x: x > 100000))}, "o_orderstatus").df
    return got.select("o_orderstatus", F.col("s.count").alias("count"), F.round("s.mean", 4).alias("mean"), F.col("s.extrema.min").alias("least"), F.col("s.extrema.max").alias("most"), "many")


@query("select count(*) as n, true as few from lineitem")
def adaptive_histogram(spark, d):
    bins = read(spark, d, "lineitem").df.agg(aggs.adaptive_hist(20)(F.col("l_extendedprice")).alias("h")).select(F.explode("h").alias("b"))
    return bins.agg(F.sum("b.y").cast("bigint").alias("n"), (F.count("*") <= 20).alias("few"))


@query("""with o as (select o_totalprice, row_number() over (order by o_orderkey) - 1 as r, count(*) over () as n from orders)
select (r * 10 // n)::int as bucket, min(r) as first_row, max(r) as last_row, min(o_totalprice) as least, max(o_totalprice) as most from o group by 1""")
def partition_rows(spark, d):
    got = read(spark, d, "orders", ["o_orderkey"]).partitioned("o_totalprice", parts=10).df
    return got.select("bucket", "first_row", "last_row", F.col("extrema.min").alias("least"), F.col("extrema.max").alias("most"))


@query("select * from (values ('itself', true, true), ('copy', true, true), ('other', false, false), ('missing', true, null)) t(what, isequal, equal)")
def equality(spark, d):
    a = read(spark, d, "supplier", ["s_suppkey"]).select(["s_suppkey", "s_acctbal"])
    b = a.transform({"s_acctbal": ("s_acctbal", lambda x: x + 1)})
    m = a.transform({"s_acctbal": ("s_acctbal", lambda x: F.when(x > 0, x))})
    pairs = {"itself": (a, a), "copy": (a, a.copy().distribute(3)), "other": (a, b), "missing": (m, m)}
    return facts(spark, [(n, x.isequal(y), x.equal(y)) for n, (x, y) in pairs.items()], "what string, isequal boolean, equal boolean")


# -- windows, reshaping -------------------------------------------------------------------------------------


@query("select o_orderkey, round(o_totalprice - lag(o_totalprice) over (order by o_orderkey), 4) as o_totalprice_diff from orders")
def lag_without_groups(spark, d):
    t = read(spark, d, "orders").select(["o_orderkey", "o_totalprice"]).lagdiff("o_totalprice", "o_orderkey")
    return t.df.select("o_orderkey", F.round("o_totalprice_diff", 4).alias("o_totalprice_diff"))


@query("""select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'purchase') as purchase
from events where event_type in ('click', 'purchase') group by user_id""")
def unstack_found(spark, d):
    t = read(spark, d, "events").filter(lambda e: e.isin("click", "purchase"), "event_type").groupreduce({"n": ("event_id", "length")}, ["user_id", "event_type"])
    wide = t.unstack("user_id", "event_type", "n").df
    return wide.fillna(0).select("user_id", "click", "purchase")


# -- functions, features, timing ------------------------------------------------------------------------------


@query("select c_custkey, length(c_name) * 2 as n from customer")
def scalar_udf(spark, d):
    return read(spark, d, "customer").map(lambda g: pd.DataFrame({"c_custkey": g["c_custkey"], "n": g["c_name"].str.len() * 2}), ["c_custkey", "c_name"], returns="c_custkey bigint, n bigint").df


@query("select count(*) as n, round(sum(c_acctbal), 2) as total from customer")
def chunk_function(spark, d):
    parts = read(spark, d, "customer").mapchunks(lambda g: pd.DataFrame({"n": [len(g)], "total": [g["c_acctbal"].sum()]}), "n bigint, total double")
    return parts.agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("""select 'c_acctbal' as feature, 'Continuous' as kind, 1 as width union all select 'c_mktsegment', 'Categorical', count(distinct c_mktsegment)::int from customer
union all select 'rich', 'Maybe', 2 union all select 'all', 'width', 3 + count(distinct c_mktsegment)::int from customer union all select 'apart', 'width', 2""")
def feature_kinds(spark, d):
    t = read(spark, d, "customer").select(["c_acctbal", "c_mktsegment"]).transform({"rich": ("c_acctbal", lambda x: F.when(x > 0, x))})
    found = k.feature_schema(t, {"c_mktsegment": k.Categorical})
    _, apart = k.splitschema(found, "rich")
    rows = [(n, type(f).__name__, f.width) for n, f in found.items()] + [("all", "width", width(found)), ("apart", "width", width(apart))]
    return facts(spark, rows, "feature string, kind string, width int")


@query("select * from (values ('block', 2, true), ('size', 1, true)) t(name, calls, told)")
def timing(spark, d):
    diagnostics.fetch_timings()
    for _ in range(2):
        diagnostics.start_tracking_time("block")
        read(spark, d, "nation").df.count()
        diagnostics.stop_tracking_time("block")
    runs = diagnostics.fetch_timings()
    table = diagnostics.time_table(runs)
    size = diagnostics.approx_size(read(spark, d, "nation").df)
    told = bool(table["jobs"][0] >= 2 and "block" in diagnostics.show_timings(runs))
    return facts(spark, [("block", int(table["calls"][0]), told), ("size", 1, size > 0)], "name string, calls int, told boolean")
