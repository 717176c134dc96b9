"""Named queries with their SQL counterpart."""

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows can be checked."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def fresh_path(folder: str, name: str) -> str:
    """A path no earlier run has written to."""
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def r6(c: Column | str) -> Column:
    """Rounded to 6 decimals, for comparison between engines; no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, r6(c))
    return df


NUDGE = 1e-9


def rounded_stats(df: DataFrame, *columns: str) -> DataFrame:
    """As :func:`rounded`, moved off exact halves, which means of short decimals often are."""
    for c in columns:
        df = df.withColumn(c, r6(F.col(c) + F.lit(NUDGE)))
    return df


# --- SQL fragments ---------------------------------------------------------------------------

CELLS = """cells as (
  select l_suppkey as slide_id,
         (l_orderkey * 8 + l_linenumber) * 640000000 + l_partkey * 64 + cast(l_quantity as bigint) as cell_ord,
         (l_partkey * 7919 + l_orderkey * 31) % 3200 + l_discount as cx,
         (l_orderkey * 6151 + l_suppkey * 17 + l_linenumber * 101) % 3200 + l_tax as cy,
         (l_partkey * 7919 + l_orderkey * 31) % 3200 as x,
         (l_orderkey * 6151 + l_suppkey * 17 + l_linenumber * 101) % 3200 as y,
         cast(1 + (l_partkey + l_linenumber * 2 + l_orderkey) % 5 as integer) as cell_type,
         2 + cast(l_quantity as int) % 4 as hw, 2 + l_linenumber % 3 as hh
  from lineitem)"""

_IN_FIRST = "({r} between 10 + {s} % 5 and 44 + {s} % 7 and {c} between 15 and 50 + {s})"
_IN_SECOND = (
    "(({r} between 60 and 85 and {c} between 20 + 2 * ({s} % 10) and 80)"
    " or ({r} between 86 and 90 and {c} between 81 and 85))"
)

# region of each cell: 1 and 2 by construction of the mask, 0 outside
LOCATED = f"""{CELLS},
located as (
  select *, case when {_IN_FIRST.format(r='(y // 32)', c='(x // 32)', s='(slide_id % 20)')} then 1
                 when {_IN_SECOND.format(r='(y // 32)', c='(x // 32)', s='(slide_id % 20)')} then 2 else 0 end as region_id
  from cells)"""

MASK = f"""px as (
  select s_suppkey as slide_id, s_suppkey % 20 as s, t1.r, t2.c
  from supplier, range(100) t1(r), range(100) t2(c)),
mask as (
  select slide_id, r, c,
         case when {_IN_FIRST.format(r='r', c='c', s='s')} then 1
              when {_IN_SECOND.format(r='r', c='c', s='s')} then 2 else 0 end as region_id,
         case when {_IN_FIRST.format(r='r', c='c', s='s')} or {_IN_SECOND.format(r='r', c='c', s='s')}
              then 255 else 0 end as v
  from px)"""


def morph_sql(k: int) -> str:
    """Dilated and eroded mask (columns d, e) on top of MASK."""
    a, b = k // 2, k - 1 - k // 2
    return f"""{MASK},
rows_done as (
  select slide_id, r, c, v,
         max(v) over w as dr, min(v) over w as er
  from mask window w as (partition by slide_id, r order by c rows between {a} preceding and {b} following)),
grown as (
  select slide_id, r, c, v, max(dr) over w as d, min(er) over w as e
  from rows_done window w as (partition by slide_id, c order by r rows between {a} preceding and {b} following))"""


def runs_sql(source: str, condition: str) -> str:
    """Final select: maximal runs of pixels meeting a condition."""
    return f"""select slide_id, cast(r as integer) as "row", cast(min(c) as integer) as c0, cast(max(c) as integer) as c1
from (select slide_id, r, c, c - row_number() over (partition by slide_id, r order by c) as g
      from {source} where {condition}) group by slide_id, r, g"""


def stats_sql(source: str, keys: Sequence[str], value: str) -> str:
    """The seven statistics; moments and mean absolute deviation written out."""
    k = ", ".join(keys)
    return f"""select {k}, count(v) as n, round(avg(v) + {NUDGE}, 6) as mean, round(stddev_pop(v) + {NUDGE}, 6) as std,
       round(quantile_cont(v, 0.5) + {NUDGE}, 6) as median, round(avg(abs(v - mu)) + {NUDGE}, 6) as "MAD",
       case when max(v) > min(v) then round(avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5) + {NUDGE}, 6) + 0.0 end as skewness,
       case when max(v) > min(v) then round(avg(pow(v - mu, 4)) / pow(avg(pow(v - mu, 2)), 2) - 3 + {NUDGE}, 6) + 0.0 end as kurt,
       round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25) + {NUDGE}, 6) as iqr
from (select {k}, cast({value} as double) as v, avg({value}) over (partition by {k}) as mu from {source})
group by {k}"""


TILES = """base as (
  select p_partkey as tile_id, p_size % 4 as sh, t1.r, t2.c from part, range(20) t1(r), range(20) t2(c)),
inst as (
  select tile_id, r, c,
         case when r % 10 < 8 and c % 10 < 8 then (r // 10) * 2 + c // 10 + 1 else 0 end as ti,
         case when c >= sh and r % 10 < 8 and (c - sh) % 10 < 8 then (r // 10) * 2 + (c - sh) // 10 + 1 else 0 end as pi
  from base),
tiles as (
  select tile_id, cast(r as integer) as r, cast(c as integer) as c, cast(ti as integer) as ti, cast(pi as integer) as pi,
         cast(case when ti = 0 then 0 else 1 + (ti + tile_id) % 5 end as integer) as tc,
         cast(case when pi = 0 then 0
                   else 1 + (pi + tile_id + case when tile_id % 3 = 0 and pi % 4 = 0 then 1 else 0 end) % 5 end as integer) as pc
  from inst)"""

FM = """fm as (
  select vec_id as slide_id, printf('f%02d', i - 1) as feature, cast(embedding[i] as double) as value,
         label % 2 as label, label // 2 as cohort_id
  from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings))"""

SCORED = """scored as (
  select event_id as slide_id, cast(user_id % 3 as integer) as fold,
         case when event_type = 'purchase' then 1 else 0 end as label, value as score from events)"""
