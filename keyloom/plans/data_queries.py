"""Queries p1 to p5 over the stock tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import badrows, drift, profile, rolling, spikes


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _drift_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "t1").unionByName(table(spark, d, "t2"))
    return lines, table(spark, d, "filecatalog").where(F.col("dataset").isin("t1", "t2"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(*_drift_input(spark, d))


def p1_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.appearing_alternatives(*_drift_input(spark, d))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    """Every record under one schema; of the map the canonical forms are shown, as sorted text."""
    wide = drift.consistent_table(*_drift_input(spark, d), ["a", "x", "y"])
    shown = F.transform(F.map_entries("other"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["canonical"]))
    return wide.withColumn("other", F.array_join(F.array_sort(shown), ";"))


def _bad_stock() -> dict:
    return {
        "ticker": ~F.col("ticker").rlike(rolling.TICKER),
        "open": F.isnan("open") | ~(F.col("open") > 0),
        "volume": F.col("volume") < 0,
    }


def _stock_profile(spark: SparkSession, d: str, quantiles=()) -> DataFrame:
    catalog = table(spark, d, "filecatalog").where(F.col("dataset") == "sample")
    return profile.profile_loads(table(spark, d, "stock_sample"), catalog, bad=_bad_stock(), quantiles=quantiles)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_issues(_stock_profile(spark, d))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    full = _stock_profile(spark, d, (0.25, 0.5, 0.75))
    return full.select(
        "file_id", "column_name", "n_rows", "nulls", "bad", "n_distinct", "least", "most",
        *[F.round(F.col(f"`q_{q}`"), 6).alias(f"q{int(float(q) * 100)}") for q in ("0.25", "0.5", "0.75")],
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.bad_rows(table(spark, d, "sample_raw")).select("file_id", "line_no", "reason")


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    return badrows.good_rows(table(spark, d, "sample_raw"))


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    return rolling.last_delivery(table(spark, d, "stock_sample"), table(spark, d, "filecatalog"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    quiet = rolling.trailing_totals(_deliveries(spark, d), "ticker", "date", "volume", (7, 30), quiet_only=True)
    return quiet.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("day_iso"))


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    full = rolling.trailing_totals(_deliveries(spark, d), "ticker", "date", "volume", (7, 30))
    return full.select(
        "ticker", "date",
        F.col("total_7").cast("bigint").alias("total_7"), F.col("total_30").cast("bigint").alias("total_30"),
        F.round("avg_7", 4).alias("avg_7"), F.round("avg_30", 4).alias("avg_30"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "stock_sample"))


QUERIES = {f.__name__: f for f in (p1_found, p1_alternatives, p1_table, p2_found, p2_profile, p3_found, p3_rows, p4_found, p4_rolling, p5_found)}

_P2_BASE = r"""
loads as (select c.file_id, c.feed, c.written_at,
    lag(c.file_id) over (partition by c.feed order by c.written_at, c.file_id) as before_id
  from filecatalog c where c.dataset = 'sample'),
counts as (select file_id, count(*) as n, count(*) - count(open) as open_nulls, count(*) - count(volume) as volume_nulls,
    count(*) - count(ticker) as ticker_nulls, count(distinct ticker) as tickers,
    count(*) filter (where not regexp_full_match(ticker, '[A-Z]{3,5}(\.[A-Z])?')) as ticker_bad,
    count(*) filter (where isnan(open) or not open > 0) as open_bad, count(*) filter (where volume < 0) as volume_bad
  from stock_sample group by file_id)"""

_VALUES = """
vals as (select file_id, 'open' as column_name, open as v, count(*) as c from stock_sample where isfinite(open) group by all
  union all select file_id, 'volume', volume::double, count(*) from stock_sample where volume is not null group by all),
sizes as (select file_id, column_name, sum(c) as n from vals group by all),
both_ as (select l.file_id, v.column_name, v.v, v.c as own, 0 as old from loads l join vals v on v.file_id = l.file_id where l.before_id is not null
  union all select l.file_id, v.column_name, v.v, 0, v.c from loads l join vals v on v.file_id = l.before_id),
steps as (select file_id, column_name, v, sum(own) as own, sum(old) as old from both_ group by all),
curves as (select file_id, column_name, sum(own) over w as own, sum(old) over w as old from steps
  window w as (partition by file_id, column_name order by v)),
shifts as (select c.file_id, c.column_name, max(abs(c.own::double * p.n - c.old::double * s.n) / (s.n::double * p.n)) as ks
  from curves c join loads l using (file_id) join sizes s on s.file_id = c.file_id and s.column_name = c.column_name
  join sizes p on p.file_id = l.before_id and p.column_name = c.column_name group by all)"""

ORACLES = {
    "p2_found": f"""with {_P2_BASE}, {_VALUES},
pairs as (select l.file_id, c.*exclude(file_id), p.n as pn, p.open_nulls as po, p.volume_nulls as pv, p.ticker_nulls as pt, p.tickers as ptk
  from loads l join counts c using (file_id) left join counts p on p.file_id = l.before_id)
select file_id, 'ticker' as column_name, 'pattern' as issue from counts where ticker_bad > 0
union all select file_id, 'open', 'range' from counts where open_bad > 0
union all select file_id, 'volume', 'range' from counts where volume_bad > 0
union all select file_id, 'open', 'nulls' from pairs where (open_nulls * pn - po * n) * 20 > n * pn
union all select file_id, 'volume', 'nulls' from pairs where (volume_nulls * pn - pv * n) * 20 > n * pn
union all select file_id, 'ticker', 'nulls' from pairs where (ticker_nulls * pn - pt * n) * 20 > n * pn
union all select file_id, 'ticker', 'distinct' from pairs where tickers * 2 < ptk or tickers > 2 * ptk
union all select file_id, column_name, 'shift' from shifts where ks > 0.35 + 1e-12""",
    "p2_profile": f"""with {_P2_BASE},
q as (select file_id, min(open) filter (where isfinite(open)) as lo, max(open) filter (where isfinite(open)) as hi,
    round(quantile_cont(open, 0.25) filter (where isfinite(open)), 6) as q25, round(quantile_cont(open, 0.5) filter (where isfinite(open)), 6) as q50,
    round(quantile_cont(open, 0.75) filter (where isfinite(open)), 6) as q75, count(distinct open) as od,
    min(volume)::double as vlo, max(volume)::double as vhi, round(quantile_cont(volume::double, 0.25), 6) as v25,
    round(quantile_cont(volume::double, 0.5), 6) as v50, round(quantile_cont(volume::double, 0.75), 6) as v75, count(distinct volume) as vd
  from stock_sample group by file_id)
select file_id, 'open' as column_name, n as n_rows, open_nulls as nulls, open_bad as bad, od as n_distinct, lo as least, hi as most, q25, q50, q75 from counts join q using (file_id)
union all select file_id, 'volume', n, volume_nulls, volume_bad, vd, vlo, vhi, v25, v50, v75 from counts join q using (file_id)
union all select file_id, 'ticker', n, ticker_nulls, ticker_bad, tickers, null, null, null, null, null from counts""",
}

_DAYS = r"""
delivered as (select s.feed, s.ticker, s.date, case when s.volume > 0 then s.volume else 0 end as v,
    row_number() over (partition by s.feed, s.ticker, s.date order by c.written_at desc nulls last, s.row_id desc) as r
  from stock_sample s left join filecatalog c on c.file_id = s.file_id
  where s.date is not null and regexp_full_match(s.ticker, '[A-Z]{3,5}(\.[A-Z])?')),
totals as (select ticker, date, sum(v)::bigint as v from delivered where r = 1 group by all),
spans as (select ticker, min(date) as a, max(date) as b from totals group by all),
calendar as (select ticker, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as date from spans),
rolled as (select c.ticker, c.date, sum(coalesce(t.v, 0)) over w7 as total_7, sum(coalesce(t.v, 0)) over w30 as total_30
  from calendar c left join totals t on t.ticker = c.ticker and t.date = c.date
  window w7 as (partition by c.ticker order by c.date rows 6 preceding), w30 as (partition by c.ticker order by c.date rows 29 preceding))"""

ORACLES |= {
    "p4_found": f"with {_DAYS} select ticker, strftime(date, '%Y-%m-%d') as day_iso from rolled where total_7 = 0 and total_30 > 0",
    "p4_rolling": f"with {_DAYS} select ticker, date, total_7::bigint as total_7, total_30::bigint as total_30, round(total_7 / 7.0::double, 4) as avg_7, round(total_30 / 30.0::double, 4) as avg_30 from rolled",
}

_P3_BASE = r"""b as (select file_id, line_no, coalesce(line, '') as line from sample_raw where line_no > 1),
f as (select *, list_transform(regexp_extract_all(',' || line, ',([ \t]*"[^"]*(?:""[^"]*)*"[ \t]*|[^",]*)', 1), lambda x: trim(x, ' ' || chr(9))) as raw from b),
c as (select *, list_transform(raw, lambda x: case when length(x) >= 2 and x[1] = '"' then replace(x[2:-2], '""', '"') else x end) as v from f),
r as (select file_id, line_no, case
  when not regexp_full_match(line, '([ \t]*"[^"]*(?:""[^"]*)*"[ \t]*|[^",]*)(,([ \t]*"[^"]*(?:""[^"]*)*"[ \t]*|[^",]*))*') then 'quoting'
  when len(v) <> 7 then 'columns'
  when not regexp_full_match(v[1], '[0-9]{4}-[0-9]{2}-[0-9]{2}') or try_cast(v[1] as date) is null or v[2] in ('', 'NA', 'missing')
    or len(list_filter(v[3:6], lambda x: not (x in ('', 'NA', 'missing') or regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')))) > 0
    or not (v[7] in ('', 'NA', 'missing') or (regexp_full_match(v[7], '[0-9]+') and try_cast(v[7] as bigint) is not null)) then 'value' end as reason, v from c)"""

ORACLES["p3_found"] = f"with {_P3_BASE} select file_id, line_no, reason from r where reason is not null"

_READ = "case when v[{0}] in ('', 'NA', 'missing') then null else try_cast(v[{0}] as {1}) end as {2}"
ORACLES["p3_rows"] = f"with {_P3_BASE} select file_id, line_no, " + ", ".join(
    _READ.format(i, kind, name) for i, (name, kind) in enumerate(badrows.FIELDS, 1)
).replace(" as string)", " as varchar)") + " from r where reason is null"


_P1_BASE = r"""lines as (select * from t1 union all select * from t2),
cat as (select file_id, feed, written_at, coalesce(carried, 0) as carried, lag(file_id) over (partition by feed order by written_at, file_id) as before_id
  from filecatalog where dataset in ('t1', 't2')),
split as (select file_id, line_no, regexp_extract_all(',' || coalesce(line, ''), ',([ \t]*"[^"]*(?:""[^"]*)*"[ \t]*|[^,]*)', 1) as cs from lines),
raw as (select file_id, line_no, trim(unnest(cs), ' ' || chr(9)) as b, generate_subscripts(cs, 1) as pos from split),
clean as (select file_id, line_no, pos, case when length(b) >= 2 and b[1] = '"' and b[-1] = '"' then trim(replace(b[2:-2], '""', '"'), ' ' || chr(9)) else b end as c from raw),
names as (select file_id, regexp_replace(lower(c), '[ \t]+', '_', 'g') as name, min(pos) as pos from clean where line_no = 1 group by all),
told as (select n.file_id, n.name, c.line_no, c.c as v, regexp_full_match(c.c, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') as num,
    regexp_extract(c.c, '^([+-]?)([0-9]*)\.?([0-9]*)', 1) as sign, regexp_extract(c.c, '^([+-]?)([0-9]*)\.?([0-9]*)', 2) as whole,
    regexp_extract(c.c, '^([+-]?)([0-9]*)\.?([0-9]*)', 3) as frac, regexp_extract(c.c, '[eE]([+-]?[0-9]+)$', 1) as ex
  from names n join clean c on c.file_id = n.file_id and c.pos = n.pos where c.line_no > 1 and c.c not in ('', 'NA', 'missing')),
sized as (select *, rtrim(ltrim(whole || frac, '0'), '0') as d,
    coalesce(try_cast(ex as bigint), 0) - length(frac) + length(ltrim(whole || frac, '0')) - length(rtrim(ltrim(whole || frac, '0'), '0')) as pow from told),
vals as (select file_id, name, line_no, v, num, case when not num then 't' || v when d = '' then 'n0' else 'n' || case when sign = '-' then '-' else '' end || d || 'e' || pow end as key,
    case when not num then v when d = '' then '0' else case when sign = '-' then '-' else '' end || case when abs(pow) > 40 then d || 'e' || pow when pow >= 0 then d || repeat('0', pow)
      when length(d) > -pow then left(d, length(d) + pow) || '.' || right(d, -pow) else '0.' || repeat('0', -pow - length(d)) || d end end as canon from sized),
new_ as (select p.file_id, p.before_id, p.carried, c.name from cat p join names c on c.file_id = p.file_id where p.before_id is not null),
old_ as (select p.file_id, p.before_id, p.carried, c.name from cat p join names c on c.file_id = p.before_id),
only_new as (select * from new_ n where not exists (select 1 from old_ o where o.file_id = n.file_id and o.name = n.name)),
only_old as (select * from old_ o where not exists (select 1 from new_ n where o.file_id = n.file_id and o.name = n.name)),
ends as (select file_id, max(line_no) as e from lines group by all),
new_held as (select n.file_id, n.name, string_agg((v.line_no - 1) || ':' || v.key, chr(10) order by v.line_no) as held
  from only_new n join vals v on v.file_id = n.file_id and v.name = n.name where v.line_no <= n.carried + 1 group by all),
old_held as (select o.file_id, o.name, string_agg((v.line_no - e.e + o.carried) || ':' || v.key, chr(10) order by v.line_no) as held
  from only_old o join ends e on e.file_id = o.before_id join vals v on v.file_id = o.before_id and v.name = o.name where v.line_no > 1 and v.line_no > e.e - o.carried group by all)"""

_KIND = "case when regexp_full_match(v, '[+-]?[0-9]+') then 'long' when num then 'double' when regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then 'date' else 'string' end"

ORACLES["p1_found"] = rf"""with {_P1_BASE},
typed as (select file_id, name, case when bool_and(k = 'long') then 'long' when bool_and(k in ('long', 'double')) then 'double' when bool_and(k = 'date') then 'date' else 'string' end as kind
  from (select file_id, name, {_KIND} as k from vals) group by all),
cols as (select n.file_id, n.name, t.kind from names n left join typed t on t.file_id = n.file_id and t.name = n.name),
renames as (select n.file_id, n.name as new_name, o.name as old_name from new_held n join old_held o on o.file_id = n.file_id and o.held = n.held),
before_ as (select p.file_id, p.before_id from cat p where p.before_id is not null)
select distinct file_id, new_name as column_name, 'renamed' as change_kind from renames
union all select file_id, name, 'added' from only_new n where not exists (select 1 from renames r where r.file_id = n.file_id and r.new_name = n.name)
union all select file_id, name, 'removed' from only_old o where not exists (select 1 from renames r where r.file_id = o.file_id and r.old_name = o.name)
union all select p.file_id, n.name, 'retyped' from before_ p join cols n on n.file_id = p.file_id join cols o on o.file_id = p.before_id and o.name = n.name where n.kind <> o.kind
union all select distinct r.file_id, r.new_name, 'retyped' from renames r join before_ p on p.file_id = r.file_id join cols n on n.file_id = r.file_id and n.name = r.new_name
  join cols o on o.file_id = p.before_id and o.name = r.old_name where n.kind <> o.kind"""

ORACLES["p1_table"] = rf"""with recursive {_P1_BASE},
links as (select p.file_id, n.name, p.before_id, n.name as old_name from cat p join names n on n.file_id = p.file_id join names o on o.file_id = p.before_id and o.name = n.name
  union all select n.file_id, n.name, p.before_id, o.name from (select *, row_number() over (partition by file_id, held order by name) as r from new_held) n
    join (select *, row_number() over (partition by file_id, held order by name) as r from old_held) o on o.file_id = n.file_id and o.held = n.held and o.r = n.r join cat p on p.file_id = n.file_id),
roots as (select n.file_id, n.name, n.file_id as root_id, n.name as root_name from names n where not exists (select 1 from links l where l.file_id = n.file_id and l.name = n.name)
  union all select l.file_id, l.name, r.root_id, r.root_name from links l join roots r on r.file_id = l.before_id and r.name = l.old_name),
aged as (select r.*, row_number() over (partition by r.file_id, r.root_name order by c.written_at, c.file_id) as place from roots r left join cat c on c.file_id = r.root_id),
later as (select distinct root_id, root_name from aged where place > 1 or regexp_matches(root_name, '@-?[0-9]+$')),
canonical as (select a.file_id, a.name, case when l.root_id is null then a.root_name else a.root_name || '@' || a.root_id end as canonical
  from aged a left join later l on l.root_id = a.root_id and l.root_name = a.root_name),
cells as (select v.file_id, v.line_no, c.canonical as name, v.v, v.canon, {_KIND} as kind from vals v join canonical c on c.file_id = v.file_id and c.name = v.name),
records as (select file_id, line_no from lines where line_no > 1)
select r.file_id, r.line_no, """ + ", ".join(
    f"""max(c.canon) filter (where c.name = '{f}') as {f}, max(try_cast(c.v as bigint)) filter (where c.name = '{f}' and c.kind = 'long') as {f}_long,
  max(try_cast(c.v as double)) filter (where c.name = '{f}' and c.kind in ('long', 'double')) as {f}_double, max(try_cast(c.v as date)) filter (where c.name = '{f}' and c.kind = 'date') as {f}_date,
  max(c.v) filter (where c.name = '{f}' and c.kind = 'string') as {f}_text"""
    for f in ("a", "x", "y")
) + """,
  coalesce(string_agg(c.name || '=' || c.canon, ';' order by c.name || '=' || c.canon) filter (where c.name not in ('a', 'x', 'y')), '') as other
from records r left join cells c on c.file_id = r.file_id and c.line_no = r.line_no group by r.file_id, r.line_no"""
