"""Queries over the star-schema tables, one or more for each operator, with their SQL.

Sums and averages of doubles are rounded on both sides, as the order of addition differs.
"""

from __future__ import annotations

import operator
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import keyloom as k
from keyloom import aggs
from keyloom.frame import KeyedFrame

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function as a query, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str, keys=(), kind: str = "table") -> KeyedFrame:
    return KeyedFrame(spark.read.parquet(f"{d}/{name}.parquet"), keys, kind)


def rounded(t: KeyedFrame | DataFrame, digits: int = 4) -> DataFrame:
    df = t.df if isinstance(t, KeyedFrame) else t
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


# -- projection and filters ----------------------------------------------------------------------


@query("""select l_orderkey, l_quantity, round(l_extendedprice * (1 - l_discount), 4) as revenue
from lineitem where l_shipdate <= timestamp '1996-12-31' and l_quantity > 25""")
def filter_select(spark, d):
    t = read(spark, d, "lineitem").filter((("l_shipdate", lambda x: x <= F.lit("1996-12-31").cast("timestamp_ntz")), ("l_quantity", lambda q: q > 25)))
    return rounded(t.select(["l_orderkey", "l_quantity", ("revenue", ["l_extendedprice", "l_discount"], lambda r: r.l_extendedprice * (1 - r.l_discount))]))


@query("select * from orders where o_orderstatus = 'F' and o_totalprice between 1000 and 100000 and o_orderpriority in ('1-URGENT', '2-HIGH')")
def filter_conjunction(spark, d):
    return read(spark, d, "orders").filter({"o_orderstatus": lambda s: s == "F", "o_totalprice": lambda p: p.between(1000, 100000), "o_orderpriority": lambda p: p.isin("1-URGENT", "2-HIGH")}).df


@query("select c_custkey, c_nationkey, c_acctbal from customer")
def select_by_type(spark, d):
    t = read(spark, d, "customer")
    return t.select(k.All(k.Not(str), float)).df


@query("select p_partkey, p_name, p_brand, p_type from part")
def select_between(spark, d):
    return read(spark, d, "part").select(k.Between("p_partkey", "p_type")).df


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem")
def select_pattern(spark, d):
    return read(spark, d, "lineitem").select(re.compile("key$|number")).df


@query("select c_custkey as id, c_name, c_nationkey, c_acctbal, c_mktsegment, c_acctbal < 0 as in_debt from customer")
def transform_rename(spark, d):
    return read(spark, d, "customer").rename({"c_custkey": "id"}).transform({"in_debt": ("c_acctbal", lambda b: b < 0)}).df


@query("select s_suppkey, s_suppkey * 2 as twice, s_name, s_nationkey, s_acctbal from supplier")
def insert_columns(spark, d):
    return read(spark, d, "supplier", ["s_suppkey"]).insertcolsafter("s_suppkey", {"twice": ("s_suppkey", lambda x: x * 2)}).df


@query("select row_id, open, volume from stock_sample where open is not null and volume is not null")
def drop_missing(spark, d):
    return read(spark, d, "stock_sample").select(["row_id", "open", "volume"]).dropmissing().df


@query("select round(c_acctbal * 2 + c_nationkey, 4) as value from customer")
def map_rows(spark, d):
    return rounded(read(spark, d, "customer").map(lambda r: r.c_acctbal * 2 + r.c_nationkey))


# -- reductions and groups ---------------------------------------------------------------------


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as sum_qty, round(avg(l_extendedprice), 4) as avg_price, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def groupreduce_multi(spark, d):
    t = read(spark, d, "lineitem").filter(lambda x: x <= F.lit("1998-09-02").cast("timestamp_ntz"), "l_shipdate")
    return rounded(t.groupreduce({"sum_qty": ("l_quantity", "+"), "avg_price": ("l_extendedprice", "mean"), "n": ("l_orderkey", "length")}, ["l_returnflag", "l_linestatus"]))


@query("""select round(sum(o_totalprice), 2) as total, round(min(o_totalprice), 2) as least, round(max(o_totalprice), 2) as most,
round(avg(o_totalprice), 2) as mean, round(var_samp(o_totalprice), 0) as variance from orders""")
def reduce_scalar(spark, d):
    t = read(spark, d, "orders")
    row = t.df.agg(*[aggs.stat(s)(F.col("o_totalprice")).alias(n) for n, s in (("total", "+"), ("least", min), ("most", max), ("mean", "mean"), ("variance", "variance"))])
    return rounded(row, 2).withColumn("variance", F.round("variance", 0))


@query("""select o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) as q25, round(median(o_totalprice), 4) as q50,
round(quantile_cont(o_totalprice, 0.75), 4) as q75 from orders group by all""")
def groupby_quantiles(spark, d):
    return rounded(read(spark, d, "orders").groupby({"q25": aggs.quantile(0.25), "q50": "median", "q75": aggs.quantile(0.75)}, "o_orderpriority", "o_totalprice"))


@query("select event_type, count(*) as n, count(distinct user_id) as users from events group by all")
def groupby_distinct(spark, d):
    return read(spark, d, "events").groupby({"n": ("event_id", "length"), "users": ("user_id", aggs.distinct())}, "event_type").df


@query("""select ticker, count(distinct feed) + max((feed is null)::int) as feeds, count(volume) as told,
case when count(*) > count(volume) then null else sum(volume)::bigint end as total from stock_sample group by ticker""")
def missing_propagates(spark, d):
    t = read(spark, d, "stock_sample")
    strict = aggs.SUM(F.col("volume"), skipmissing=False).alias("total")
    return t.df.groupBy("ticker").agg(aggs.distinct(count_missing=True)(F.col("feed")).alias("feeds"), aggs.COUNT(F.col("volume")).alias("told"), strict)


@query("""select s_nationkey, round(avg(s_acctbal), 4) as s_acctbal_mean, round(stddev_samp(s_acctbal), 4) as s_acctbal_std,
round(avg(s_suppkey), 4) as s_suppkey_mean, round(stddev_samp(s_suppkey), 4) as s_suppkey_std from supplier group by all""")
def summarize_grid(spark, d):
    return rounded(read(spark, d, "supplier", ["s_nationkey"]).summarize(["mean", "std"], sel=["s_acctbal", "s_suppkey"]))


@query("select s_nationkey, list(s_suppkey order by s_suppkey) as identity from supplier group by all")
def groupby_identity(spark, d):
    return read(spark, d, "supplier").groupby("identity", "s_nationkey", "s_suppkey").df


@query("select l_suppkey, l_quantity from lineitem")
def groupby_flatten(spark, d):
    return read(spark, d, "lineitem").groupby(aggs.IDENTITY, "l_suppkey", "l_quantity", flatten=True).rename({"identity": "l_quantity"}).df


@query("select o_orderpriority, round(sum(o_totalprice) / count(*), 4) as value from orders group by all")
def fold_custom_mean(spark, d):
    mean = k.Mergeable(lambda: (0.0, 0), lambda s, v: (s[0] + v, s[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[0] / s[1])
    return rounded(read(spark, d, "orders").fold(mean, "o_totalprice", "o_orderpriority"))


@query("select o_custkey, max(o_orderkey) as value from orders group by all")
def fold_binary_function(spark, d):
    return read(spark, d, "orders").fold(max, "o_orderkey", "o_custkey", returns="bigint").df


@query("select floor(least(l_quantity, 49.999) / 10)::int as bin, count(*) as n from lineitem where l_quantity <= 50 group by all")
def hist_fixed(spark, d):
    t = read(spark, d, "lineitem")
    counts = t.df.agg(aggs.hist([0, 10, 20, 30, 40, 50])(F.col("l_quantity")).alias("h"))
    return counts.select(F.posexplode("h").alias("bin", "n")).where("n > 0")


@query("select l_returnflag, l_linestatus, count(*) as count from lineitem group by all")
def mosaic(spark, d):
    return read(spark, d, "lineitem").mosaic("l_returnflag", "l_linestatus").df


@query("select event_type, count(*) as n from events group by all")
def countmap(spark, d):
    return read(spark, d, "events").countmap("event_type").df.select(F.explode("counts").alias("event_type", "n"))


@query("select o_orderstatus, min(o_totalprice) as least, max(o_totalprice) as most from orders group by all")
def extrema(spark, d):
    return read(spark, d, "orders").groupreduce(aggs.EXTREMA, "o_orderstatus", "o_totalprice").df.select("o_orderstatus", F.col("extrema.min").alias("least"), F.col("extrema.max").alias("most"))


@query("select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept from lineitem")
def regression(spark, d):
    out = read(spark, d, "lineitem").df.agg(aggs.regression("l_quantity")(F.col("l_extendedprice")).alias("r"))
    return out.select(F.round("r.slope", 4).alias("slope"), F.round("r.intercept", 2).alias("intercept"))


@query("""with b as (select min(l_quantity) as a, max(l_quantity) as b from lineitem)
select least(floor((l_quantity - a) / ((b - a) / 10)), 9)::int as bucket, min(l_quantity) as x_min, max(l_quantity) as x_max,
round(avg(l_extendedprice), 4) as mean from lineitem, b group by 1""")
def partition_plot(spark, d):
    return rounded(read(spark, d, "lineitem").partitioned("l_extendedprice", "mean", 10, x="l_quantity"))


# -- joins ---------------------------------------------------------------------------------------

_ORDER_SUMS = "select l_orderkey, round(sum(l_quantity), 4) as qty from lineitem group by all"


def _order_sums(spark, d):
    return KeyedFrame(rounded(read(spark, d, "lineitem").groupreduce({"qty": ("l_quantity", "+")}, "l_orderkey")), ["l_orderkey"])


@query("select o_orderkey, o_totalprice, l_linenumber, l_quantity from orders join lineitem on l_orderkey = o_orderkey")
def join_inner(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "lineitem"), lkey="o_orderkey", rkey="l_orderkey", lselect="o_totalprice", rselect=["l_linenumber", "l_quantity"]).df


@query(f"select o_orderkey, o_custkey, qty from orders left join ({_ORDER_SUMS}) on l_orderkey = o_orderkey")
def join_left(spark, d):
    return read(spark, d, "orders", ["o_orderkey"]).join(_order_sums(spark, d), "left", lselect="o_custkey").df


@query(f"""select coalesce(o_orderkey, l_orderkey) as o_orderkey, o_custkey, qty
from (select * from orders where o_orderstatus <> 'F') full join (select * from ({_ORDER_SUMS}) where qty > 60) on l_orderkey = o_orderkey""")
def join_outer(spark, d):
    orders = read(spark, d, "orders", ["o_orderkey"]).filter(lambda s: s != "F", "o_orderstatus")
    return orders.join(_order_sums(spark, d).filter(lambda q: q > 60, "qty"), "outer", lselect="o_custkey").df


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def join_anti(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "lineitem"), "anti", lkey="o_orderkey", rkey="l_orderkey", lselect="o_custkey").df


@query("select l_partkey, l_orderkey, p_brand from lineitem join part on p_partkey = l_partkey")
def join_broadcast(spark, d):
    return read(spark, d, "lineitem").join(read(spark, d, "part"), lkey="l_partkey", rkey="p_partkey", lselect="l_orderkey", rselect="p_brand", broadcast="right").df


@query("select o_orderkey, round(o_totalprice - l_quantity, 4) as value from orders join lineitem on l_orderkey = o_orderkey")
def join_function(spark, d):
    got = read(spark, d, "orders").join(read(spark, d, "lineitem"), lkey="o_orderkey", rkey="l_orderkey", lselect="o_totalprice", rselect="l_quantity", f=lambda a, b: {"value": a - b})
    return rounded(got)


@query("""select n_nationkey, coalesce(g, []) as groups from nation left join
(select s_nationkey, list(s_suppkey order by s_suppkey) as g from supplier where s_acctbal > 5000 group by all) on s_nationkey = n_nationkey""")
def groupjoin_lists(spark, d):
    rich = read(spark, d, "supplier").filter(lambda b: b > 5000, "s_acctbal")
    got = read(spark, d, "nation").groupjoin(rich, "left", lkey="n_nationkey", rkey="s_nationkey", lselect=[], rselect="s_suppkey")
    return got.df.withColumn("groups", F.transform("groups", lambda s: s["s_suppkey"]))


@query("""select n_nationkey, count(s_suppkey) as n from nation join supplier on s_nationkey = n_nationkey group by all""")
def groupjoin_reduced(spark, d):
    return read(spark, d, "nation").groupjoin(read(spark, d, "supplier"), lkey="n_nationkey", rkey="s_nationkey", lselect=[], rselect="s_suppkey", f={"n": ("s_suppkey", "count")}).df


_ASOF = """select l.user_id, l.ts, coalesce(r.value, l.value) as value from (select * from events where event_type = 'purchase') l
asof left join (select * from events where event_type = 'signup') r on l.user_id = r.user_id and l.ts >= r.ts"""


def _events(spark, d, kind):
    t = read(spark, d, "events").filter(lambda e: e == kind, "event_type")
    return KeyedFrame(t.df.select("user_id", "ts", "value"), ["user_id", "ts"], "array")


@query(_ASOF)
def asof_join(spark, d):
    return _events(spark, d, "purchase").asofjoin(_events(spark, d, "signup")).df


@query(_ASOF)
def asof_join_tiled(spark, d):
    return _events(spark, d, "purchase").asofjoin(_events(spark, d, "signup"), tile="day").df


# -- arrays ---------------------------------------------------------------------------------------

_CELLS = "select o_custkey, year(o_orderdate) as y, round(sum(o_totalprice), 2) as v from orders group by all"


def _cells(spark, d) -> KeyedFrame:
    df = read(spark, d, "orders").df.groupBy("o_custkey", F.year("o_orderdate").cast("bigint").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return KeyedFrame(df, ["o_custkey", "y"], "array")


@query("select p_partkey, p_size from part where p_size <= 30 union all select p_partkey, p_size from part where p_size > 20")
def merge_tables(spark, d):
    part = read(spark, d, "part", ["p_partkey"]).select(["p_partkey", "p_size"])
    return part.filter(lambda s: s <= 30, "p_size").merge(part.filter(lambda s: s > 20, "p_size")).df


def _merge_sides(spark, d):
    part = read(spark, d, "part", ["p_partkey"], "array").selectvalues("p_size")
    return part.filter(lambda s: s <= 30, "p_size"), part.filter(lambda s: s > 20, "p_size").selectvalues(("p_size", "p_size", lambda s: s * 10))


_SIDES = "(select p_partkey, p_size from part where p_size <= 30) l full join (select p_partkey, p_size * 10 as p_size from part where p_size > 20) r on l.p_partkey = r.p_partkey"


@query(f"select coalesce(l.p_partkey, r.p_partkey) as p_partkey, coalesce(r.p_size, l.p_size) as p_size from {_SIDES}")
def merge_right_wins(spark, d):
    a, b = _merge_sides(spark, d)
    return a.merge(b).df


@query(f"select coalesce(l.p_partkey, r.p_partkey) as p_partkey, coalesce(l.p_size + r.p_size, l.p_size, r.p_size) as p_size from {_SIDES}")
def merge_agg(spark, d):
    a, b = _merge_sides(spark, d)
    return a.merge(b, agg=operator.add).df


@query(f"with c as ({_CELLS}) select c.o_custkey, c.y, round(c.v * f.v, 3) as v from c join (select y, count(*)::double as v from c group by y) f on f.y = c.y")
def broadcast_dims(spark, d):
    cells = _cells(spark, d)
    factor = cells.reducedim("length", "o_custkey").selectvalues(("v", "v", lambda v: v.cast("double")))
    return rounded(k.broadcast(operator.mul, cells, factor), 3)


@query(f"select y, round(sum(v), 2) as v from ({_CELLS}) group by y")
def reduce_dims(spark, d):
    return rounded(_cells(spark, d).reduce("+", dims="o_custkey"), 2)


@query(f"select o_custkey, max(v) as v from ({_CELLS}) group by o_custkey")
def selectkeys_agg(spark, d):
    return _cells(spark, d).selectkeys("o_custkey", "max").df


@query("select date_trunc('month', o_orderdate)::date as o_orderdate, count(*) as n from orders group by 1")
def convertdim_month(spark, d):
    t = read(spark, d, "orders", ["o_orderdate"], "array").selectvalues({"n": "o_orderkey"})
    return t.convertdim("o_orderdate", lambda x: F.trunc(x, "month"), vecagg="length").df


@query(f"select y, o_custkey, v from ({_CELLS})")
def permute_dims(spark, d):
    return _cells(spark, d).permutedims([2, 1]).df


@query(f"select o_custkey, y, v from ({_CELLS}) where o_custkey between 10 and 500 and y in (1995, 1997)")
def index_range(spark, d):
    return _cells(spark, d).at(slice(10, 500), [1995, 1997]).df


@query(f"select o_custkey, v from ({_CELLS}) where y = 1996")
def index_point(spark, d):
    return _cells(spark, d).at(slice(None), 1996).df


@query(f"select a.o_custkey, a.y, round(a.v - b.v, 2) as v from ({_CELLS}) a join (select o_custkey, y + 1 as y, v from ({_CELLS})) b on a.o_custkey = b.o_custkey and a.y = b.y")
def natural_join(spark, d):
    cells = _cells(spark, d)
    return rounded(cells.naturaljoin(cells.convertdim("y", lambda y: y + 1), operator.sub), 2)


@query(f"select a.o_custkey, a.y, a.v as v_1, b.v as v_2 from ({_CELLS}) a left join (select o_custkey, y + 1 as y, v from ({_CELLS})) b on a.o_custkey = b.o_custkey and a.y = b.y")
def left_join(spark, d):
    cells = _cells(spark, d)
    return cells.leftjoin(cells.convertdim("y", lambda y: y + 1)).df


@query("select n_nationkey, n_regionkey, case when n_nationkey = 3 then 'new' else n_name end as n_name from nation union all select 99, 9, 'added'")
def upsert(spark, d):
    t = read(spark, d, "nation", ["n_nationkey", "n_regionkey"], "array")
    region = t.df.where("n_nationkey = 3").select("n_nationkey", "n_regionkey").first()
    return t.upsert({(region[0], region[1]): "new", (99, 9): "added"}).df.select("n_nationkey", "n_regionkey", "n_name")


@query("select o_custkey, round(max(o_totalprice) - min(o_totalprice), 4) as spread from orders group by all")
def map_slices(spark, d):
    t = read(spark, d, "orders", ["o_custkey", "o_orderkey"], "array").selectvalues("o_totalprice")
    return rounded(t.mapslices(lambda s: s.o_totalprice.max() - s.o_totalprice.min(), "o_orderkey", "spread double"))


# -- order, windows ---------------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 25")
def sort_topn(spark, d):
    return read(spark, d, "orders").select(["o_orderkey", "o_totalprice"]).top(25, ["o_totalprice", "o_orderkey"], reverse=True)


@query("select o_orderkey, o_custkey from orders")
def rechunk_sorted(spark, d):
    return read(spark, d, "orders").rechunk("o_custkey", "o_orderkey").df


@query("select o_orderkey, row_number() over (order by o_orderkey) as row from orders")
def row_numbers(spark, d):
    return read(spark, d, "orders", ["o_orderkey"]).select("o_orderkey").with_row_number("row")


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) <= 3")
def window_topk(spark, d):
    return read(spark, d, "orders").select(["o_custkey", "o_orderkey", "o_totalprice"]).topk(3, ["o_totalprice", "o_orderkey"], "o_custkey").df


@query("select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey))::int as rank from orders")
def window_rank(spark, d):
    return read(spark, d, "orders").select(["o_custkey", "o_orderkey"]).rank("o_orderkey", "o_custkey").df


@query("select user_id, ts, round(value - lag(value) over (partition by user_id order by ts), 4) as value_diff from events")
def window_lag(spark, d):
    t = read(spark, d, "events").select(["user_id", "ts", "value"])
    return rounded(t.lagdiff("value", "ts", "user_id").df.drop("value"))


@query("select o_orderkey, round(avg(o_totalprice) over (partition by o_custkey), 6) as mean from orders")
def window_groupmean(spark, d):
    return rounded(read(spark, d, "orders").groupvalue("o_totalprice", "mean", "o_custkey", "mean").df.select("o_orderkey", "mean"), 6)


@query("select distinct o_orderpriority, o_orderstatus from orders")
def unique_rows(spark, d):
    return read(spark, d, "orders").unique(["o_orderpriority", "o_orderstatus"])


@query("select l_suppkey, l_linenumber from lineitem where l_quantity < 25 intersect all select l_suppkey, l_linenumber from lineitem where l_quantity >= 25")
def intersect_rows(spark, d):
    t = read(spark, d, "lineitem")
    part = lambda c: t.filter(c).select(["l_suppkey", "l_linenumber"])
    return part("l_quantity < 25").intersect(part("l_quantity >= 25")).df


# -- reshaping --------------------------------------------------------------------------------------


@query("""select p_partkey, 'p_size' as variable, p_size::double as value from part union all select p_partkey, 'p_retailprice', p_retailprice from part""")
def stack_long(spark, d):
    return read(spark, d, "part", ["p_partkey"]).stack(sel=["p_size", "p_retailprice"]).df


@query("""select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'purchase') as purchase
from events where event_type in ('click', 'purchase') group by user_id""")
def unstack_wide(spark, d):
    t = read(spark, d, "events").filter(lambda e: e.isin("click", "purchase"), "event_type").groupreduce({"n": ("event_id", "length")}, ["user_id", "event_type"])
    return t.unstack("user_id", "event_type", "n", names=["click", "purchase"]).df.fillna(0)


@query("select vec_id, unnest(embedding) as embedding from embeddings")
def flatten_array(spark, d):
    return read(spark, d, "embeddings").select(["vec_id", "embedding"]).flatten("embedding").df


# -- features, sources ----------------------------------------------------------------------------------


@query("""select s_suppkey, round(((s_acctbal - (select avg(s_acctbal) from supplier)) / (select stddev_samp(s_acctbal) from supplier))::float::double, 4) as z,
(s_nationkey % 2 = 0)::int::double as even from supplier""")
def featuremat(spark, d):
    t = read(spark, d, "supplier").select(["s_suppkey", "s_acctbal", ("even", "s_nationkey", lambda n: F.when(n % 2 == 0, "even").otherwise("odd"))])
    features = t.feature_schema({"s_suppkey": None, "even": k.Categorical(["even", "odd"])})
    out = t.featuremat(features)
    return out.select("s_suppkey", F.round(F.get("features", 0).cast("double"), 4).alias("z"), F.get("features", 1).cast("double").alias("even"))


@query("select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders")
def save_load(spark, d):
    import uuid

    from keyloom.session import checkpoint_root

    path = f"{checkpoint_root(spark)}/saved-{uuid.uuid4().hex}"
    return k.save(read(spark, d, "orders", ["o_orderkey"]).select(["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]), path).df
