"""Cells, masks, regions, morphology, distances and the per-slide features."""

from pyspark.sql import functions as F

from cytolake.functions import geometry as G
from cytolake.functions import text as TX
from cytolake.operators import cells as C
from cytolake.operators import distance as D
from cytolake.operators import features as FT
from cytolake.operators import mask as M
from cytolake.operators import regions as R
from cytolake.operators.morphology import morphology
from cytolake.functions.summary import STATS, distribution_summary
from cytolake.plans import slide_features as P
from cytolake.runtime import cut, shared_dir
from cytolake.sources import masks as MI
from workloads import inputs as I
from workloads.registry import CELLS, LOCATED, MASK, fresh_path, morph_sql, query, r6, rounded, rounded_stats, runs_sql, stats_sql

ALL5 = [1, 2, 3, 4, 5]
MARGIN = 704  # kernel 11
EVEN_MARGIN = 640  # kernel 10


def mask_of(spark, sf):
    return M.remap_pixels(I.raw_mask(spark, sf))


def layers_of(spark, sf, margin=MARGIN):
    runs, profile = P.prepare_mask(mask_of(spark, sf))
    return P.population_layers(runs, profile, P.Settings(margin=margin))


def located_of(spark, sf):
    return D.located_cells(I.cells(spark, sf), R.label_regions(M.mask_runs(mask_of(spark, sf))), ALL5)


# --- projections ------------------------------------------------------------------------------


@query("prj1_cell_pixel", f'with {CELLS} select slide_id, cell_ord, cast(y // 32 as integer) as "row", cast(x // 32 as integer) as col from cells')
def cell_pixel(spark, sf):
    return C.cell_pixel(I.cells(spark, sf)).select("slide_id", "cell_ord", "row", "col")


@query("prj2_remap_pixels", f'with {MASK} select slide_id, cast(r as integer) as "row", cast(v as integer) as value, count(*) as n from mask group by all')
def remap(spark, sf):
    return mask_of(spark, sf).groupBy("slide_id", "row", "value").agg(F.count("*").alias("n"))


@query("prj3_select_classes", f"with {CELLS} select slide_id, cell_ord, cell_type from cells where cell_type in (2, 5)")
def select_classes(spark, sf):
    return C.select_classes(I.cells(spark, sf), [2, 5]).select("slide_id", "cell_ord", "cell_type")


@query(
    "prj4_class_name",
    f"""with {CELLS} select slide_id, cell_type,
    ['Granulocyte','Lymphocyte','Plasma','Stroma','Tumor','Epithelial'][cell_type] as class_name, count(*) as n
    from cells group by all""",
)
def named(spark, sf):
    df = I.cells(spark, sf).groupBy("slide_id", "cell_type").agg(F.count("*").alias("n"))
    return df.withColumn("class_name", C.class_name(F.col("cell_type")))


_RELABEL = f"with {LOCATED} select slide_id, cell_ord, case when cell_type = 5 and region_id = 0 then 6 else cell_type end as cell_type from located"


@query("prj5_relabel_outside", _RELABEL)
def relabel(spark, sf):
    runs = M.mask_runs(mask_of(spark, sf))
    return C.relabel_outside(I.cells(spark, sf).drop("contour"), runs).select("slide_id", "cell_ord", "cell_type")


@query("prj6_undo_relabel", f"with {CELLS} select slide_id, cell_ord, cell_type from cells")
def undo(spark, sf):
    return C.undo_relabel(relabel(spark, sf))


@query(
    "prj18_tile_assign",
    f"with {CELLS} select slide_id, cast(x // 1024 as integer) as tile_x, cast(y // 1024 as integer) as tile_y, count(*) as n from cells group by all",
)
def tiles(spark, sf):
    return C.tile_assign(I.cells(spark, sf)).groupBy("slide_id", "tile_x", "tile_y").agg(F.count("*").alias("n"))


# --- scalar geometry --------------------------------------------------------------------------

_SHAPE = f"""with {CELLS} select slide_id, cell_ord, cast(4.0 * hw * hh as double) as area, cast(4.0 * (hw + hh) as double) as perimeter,
  cast(2.0 * hw as double) as width, cast(2.0 * hh as double) as height,
  round(4 * pi() * (4.0 * hw * hh) / pow(4.0 * (hw + hh), 2), 6) as circularity,
  round(cast(least(hw, hh) as double) / greatest(hw, hh), 6) as aspect from cells"""


@query("scl1_5_polygon_measures", _SHAPE)
def shapes(spark, sf):
    c = F.col("contour")
    df = I.cells(spark, sf).select(
        "slide_id",
        "cell_ord",
        G.polygon_area(c).alias("area"),
        G.polygon_perimeter(c).alias("perimeter"),
        G.polygon_width(c).alias("width"),
        G.polygon_height(c).alias("height"),
    )
    return df.withColumn("circularity", r6(G.circularity(F.col("area"), F.col("perimeter")))).withColumn(
        "aspect", r6(G.aspect_ratio(F.col("width"), F.col("height")))
    )


@query(
    "scl3_polygon_bounds",
    f"with {CELLS} select slide_id, cell_ord, cast(x - hw as double) as min_x, cast(y - hh as double) as min_y, cast(x + hw as double) as max_x, cast(y + hh as double) as max_y from cells",
)
def bounds(spark, sf):
    df = I.cells(spark, sf).select("slide_id", "cell_ord", G.polygon_bounds(F.col("contour")).alias("b"))
    return df.select("slide_id", "cell_ord", "b.*")


@query(
    "scl6_centroid_distance",
    f"with {CELLS} select slide_id, cell_ord, round(sqrt(cast((x - 1600) * (x - 1600) + (y - 1600) * (y - 1600) as double)), 6) as dist from cells",
)
def to_centre(spark, sf):
    return I.cells(spark, sf).select(
        "slide_id", "cell_ord", r6(G.distance(F.col("cx"), F.col("cy"), F.lit(1600.4), F.lit(1600.9))).alias("dist")
    )


@query("scl7_log_ratio", "select p_partkey, round(ln((p_size + 0.001) / (p_retailprice + 0.001)), 6) as ratio from part")
def ratios(spark, sf):
    part = I.table(spark, sf, "part")
    return part.select("p_partkey", r6(G.log_ratio(F.col("p_size"), F.col("p_retailprice"))).alias("ratio"))


# --- mask -------------------------------------------------------------------------------------


@query("agg5_tumour_area", f"with {MASK} select slide_id, cast(count(*) filter (v = 255) * 1024 as bigint) as area from mask group by slide_id")
def tumour_area(spark, sf):
    return M.pixel_area(mask_of(spark, sf))


@query("win1_dilate", f"with {morph_sql(11)} {runs_sql('grown', 'd = 255')}")
def dilated(spark, sf):
    runs, profile = P.prepare_mask(mask_of(spark, sf))
    return M.dilate(runs, profile.select("slide_id", "height", "width"), 11)


@query("win2_erode", f"with {morph_sql(10)} {runs_sql('grown', 'e = 255')}")
def eroded(spark, sf):
    runs, profile = P.prepare_mask(mask_of(spark, sf))
    return M.erode(runs, profile.select("slide_id", "height", "width"), 10)


@query("win3_border_band", f"with {morph_sql(11)} {runs_sql('grown', 'd - e = 255')}")
def band(spark, sf):
    runs, profile = P.prepare_mask(mask_of(spark, sf))
    return M.border_band(runs, profile.select("slide_id", "height", "width"), M.band_kernel(MARGIN))


@query("win3_border_band_even", f"with {morph_sql(10)} {runs_sql('grown', 'd - e = 255')}")
def band_even(spark, sf):
    runs, profile = P.prepare_mask(mask_of(spark, sf))
    return M.border_band(runs, profile.select("slide_id", "height", "width"), M.band_kernel(EVEN_MARGIN))


@query("win3_border_band_wide", f"with {morph_sql(67)} {runs_sql('grown', 'd - e = 255')}")
def band_wide(spark, sf):
    """The published margin, whose kernel is two thirds of the image."""
    runs, profile = P.prepare_mask(mask_of(spark, sf))
    return M.border_band(runs, profile.select("slide_id", "height", "width"), M.band_kernel())


def _mask_images(spark, sf) -> str:
    """The masks written as an image per slide."""
    runs, profile = P.prepare_mask(mask_of(spark, sf))
    path = fresh_path(shared_dir(spark), "masks")
    MI.write_masks(runs, profile.select("slide_id", "height", "width"), path)
    return path


@query("src2_mask_images", f"with {MASK} select cast(slide_id as varchar) as slide_id, cast(r as integer) as row, count(*) as n, cast(sum(c) as bigint) as cols, cast(sum(v) as bigint) as total from mask group by slide_id, r")
def mask_images(spark, sf):
    px = MI.read_masks(spark, _mask_images(spark, sf))
    return px.groupBy("slide_id", "row").agg(F.count("*").alias("n"), F.sum("col").alias("cols"), F.sum("value").alias("total"))


@query(
    "src2_mask_image_runs",
    f"""with {MASK}, g as (select *, c - row_number() over (partition by slide_id, r, v order by c) as g from mask)
    select cast(slide_id as varchar) as slide_id, cast(100 as integer) as height, cast(100 as integer) as width, cast(r as integer) as row,
    cast(min(c) as integer) as c0, cast(max(c) as integer) as c1, v as value from g group by slide_id, r, v, g""",
)
def mask_image_runs(spark, sf):
    return MI.read_mask_runs(spark, _mask_images(spark, sf))


@query("win4_mask_runs", f"with {MASK} {runs_sql('mask', 'v = 255')}")
def runs(spark, sf):
    return M.mask_runs(mask_of(spark, sf))


@query(
    "itr1_connected_regions",
    f"""with {MASK} select slide_id, region_id, cast(min(r) as integer) as min_row, cast(min(c) as integer) as min_col,
    cast(max(r) + 1 as integer) as max_row, cast(max(c) + 1 as integer) as max_col, count(*) as n_pixels
    from mask where region_id > 0 group by all""",
)
def regions(spark, sf):
    boxes = R.region_boxes(R.label_regions(M.mask_runs(mask_of(spark, sf))))
    return boxes.withColumn("n_pixels", F.col("n_pixels").cast("bigint"))


# --- joins and counts -------------------------------------------------------------------------


@query("jn1_cells_inside", f"with {LOCATED} select slide_id, cell_ord from located where region_id > 0")
def inside(spark, sf):
    return C.inside_cells(I.cells(spark, sf), M.mask_runs(mask_of(spark, sf))).select("slide_id", "cell_ord")


_BAND_CELLS = f"""with {morph_sql(11)}, {CELLS},
tagged as (
  select cells.*, 'tumour' as population from cells join grown on cells.slide_id = grown.slide_id and y // 32 = r and x // 32 = c where v = 255
  union all
  select cells.*, 'band' as population from cells join grown on cells.slide_id = grown.slide_id and y // 32 = r and x // 32 = c where d - e = 255)"""


@query("jn2_populations", f"{_BAND_CELLS} select slide_id, cell_ord, population from tagged")
def population_rows(spark, sf):
    return C.populations(I.cells(spark, sf).drop("contour"), layers_of(spark, sf)).select(
        "slide_id", "cell_ord", "population"
    )


@query("jn3_cells_by_region", f"with {LOCATED} select slide_id, cell_ord, region_id from located where region_id > 0")
def by_region(spark, sf):
    return located_of(spark, sf).select("slide_id", "cell_ord", "region_id")


_COUNT_GRID = """select s_suppkey as slide_id, population, cast(cell_type as integer) as cell_type from supplier,
  (select 'tumour' as population, unnest([1,2,3,4,5]) as cell_type union all select 'band', unnest([1,2,3,4,6]))"""


@query(
    "agg1_slide_counts",
    f"""with {CELLS}, grid as (select s_suppkey as slide_id, cast(k as integer) as cell_type from supplier, range(7) t(k))
    select slide_id, cell_type, ['Background','Granulocyte','Lymphocyte','Plasma','Stroma','Tumor','Epithelial'][cell_type + 1] as class_name,
    count(cell_ord) as n from grid left join cells using (slide_id, cell_type) group by all""",
)
def slide_counts(spark, sf):
    return C.slide_counts(I.cells(spark, sf))


@query(
    "agg2_substring_counts",
    "select doc_id, cast((length(text) - length(replace(text, 'the', ''))) / 3 as bigint) as n_the, cast(length(text) - length(replace(text, 'e', '')) as bigint) as n_e from documents",
)
def substrings(spark, sf):
    t = F.col("text")
    return I.table(spark, sf, "documents").select(
        "doc_id", TX.count_substring(t, "the").alias("n_the"), TX.count_substring(t, "e").alias("n_e")
    )


@query(
    "agg3_inside_counts",
    f"""with {LOCATED}, grid as (select s_suppkey as slide_id, cast(k as integer) as cell_type from supplier, range(1, 6) t(k)),
    c as (select slide_id, cell_type, count(*) as n, sum(4 * hw * hh) as a from located where region_id > 0 group by all)
    select slide_id, cell_type, ['Granulocyte','Lymphocyte','Plasma','Stroma','Tumor'][cell_type] as class_name,
    coalesce(n, 0) as n, cast(coalesce(a, 0) as bigint) as area,
    round(cast(coalesce(n, 0) as double) / sum(n) over (partition by slide_id), 6) as fraction
    from grid left join c using (slide_id, cell_type)""",
)
def inside_counts(spark, sf):
    """Count, area and class fraction of the cells on the tumour mask."""
    return rounded(P.class_shares_in_region(I.cells(spark, sf), mask_of(spark, sf)), "fraction")


@query(
    "agg4_population_counts",
    f"""{_BAND_CELLS}, grid as ({_COUNT_GRID}),
    moved as (select slide_id, population, case when cell_type = 5 and population = 'band' and cell_ord % 2 = 0 then 6 else cell_type end as cell_type, hw, hh from tagged),
    c as (select slide_id, population, cell_type, count(*) as n, sum(4 * hw * hh) as a from moved group by all)
    select slide_id, population, cell_type, coalesce(n, 0) as n, cast(coalesce(a, 0) as bigint) as area
    from grid left join c using (slide_id, population, cell_type)""",
)
def population_counts(spark, sf):
    # even tumour cells are made epithelial to give the band its own class; the tumour list ignores it
    measured = C.with_measures(I.cells(spark, sf))
    lean = measured.select("slide_id", "cell_ord", "cx", "cy", "cell_type", "area")
    epithelial = (F.col("cell_type") == 5) & (F.col("cell_ord") % 2 == 0)
    both = lean.withColumn("cell_type", F.when(epithelial, F.lit(6)).otherwise(F.col("cell_type")))
    # tumour counts keep class 5, so each population is counted on its own labels
    layers = layers_of(spark, sf)
    tum = C.population_counts(lean, layers, ALL5, None)
    bnd = C.population_counts(both, layers, ALL5, [1, 2, 3, 4, 6]).where("population = 'band'")
    return tum.unionByName(bnd)


@query(
    "agg6_distribution_summary",
    f"with src as (select l_returnflag, l_linestatus, l_extendedprice from lineitem) {stats_sql('src', ['l_returnflag', 'l_linestatus'], 'l_extendedprice')}",
)
def summary(spark, sf):
    li = I.table(spark, sf, "lineitem")
    return rounded_stats(distribution_summary(li, ["l_returnflag", "l_linestatus"], "l_extendedprice"), *STATS)


_MORPH_MEASURES = """measures as (
  select slide_id, population, cell_type, unnest(['areas', 'circularities', 'aspectratios']) as measure,
         unnest([cast(4 * hw * hh as double), 4 * pi() * (4.0 * hw * hh) / pow(4.0 * (hw + hh), 2),
                 cast(least(hw, hh) as double) / greatest(hw, hh)]) as v from chosen)"""


def _morph_sql(source: str, grid: str) -> str:
    fill = ", ".join(f'case when n is null then 0.0 else "{s}" end as "{s}"' for s in STATS)
    return f"""{source}, {_MORPH_MEASURES}, stats as ({stats_sql('measures', ['slide_id', 'population', 'cell_type', 'measure'], 'v')}),
    grid as (select g.*, measure from ({grid}) g, (select unnest(['areas', 'circularities', 'aspectratios']) as measure))
    select slide_id, population, cell_type, measure, coalesce(n, 0) as n, {fill}
    from grid left join stats using (slide_id, population, cell_type, measure)"""


@query(
    "agg7_morphology_inside",
    _morph_sql(
        f"with {LOCATED}, chosen as (select *, 'tumour' as population from located where region_id > 0)",
        "select s_suppkey as slide_id, 'tumour' as population, cast(k as integer) as cell_type from supplier, range(1, 6) t(k)",
    ),
)
def morphology_inside(spark, sf):
    layers = C.population_layers(M.mask_runs(mask_of(spark, sf)))
    measured = C.with_measures(I.cells(spark, sf))
    return rounded_stats(morphology(measured, layers, ALL5, None), *STATS)


@query(
    "agg8_morphology_populations",
    _morph_sql(
        f"{_BAND_CELLS}, chosen as (select * from tagged where population = 'tumour' or cell_type in (1, 2, 3, 4))",
        _COUNT_GRID,
    ),
)
def morphology_populations(spark, sf):
    measured = C.with_measures(I.cells(spark, sf))
    return rounded_stats(morphology(measured, layers_of(spark, sf)), *STATS)


# --- distances --------------------------------------------------------------------------------

_PAIR_ROWS = """pairs as (select a.slide_id, a.region_id, a.cell_ord, a.cell_type as source, b.cell_type as target, a.cx, a.cy, a.x, a.y, b.x as tx, b.y as ty,
          (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2
  from inside a join inside b on a.slide_id = b.slide_id and a.region_id = b.region_id and a.cell_type < b.cell_type)"""
_NEAR_ROWS = """nearest as (
  select slide_id, region_id, cell_ord, source, target, sqrt(cast(min(d2) as double)) as dist from pairs group by all)"""
_PAIRS = f"with {LOCATED}, inside as (select * from located where region_id > 0), {_PAIR_ROWS}"
_NEAREST = f"{_PAIRS}, {_NEAR_ROWS}"
_BOXED = f"""{_PAIRS},
boxes as (
  select s as slide_id, 1 as region_id, (50 + s % 20 - 15 + 1) * 32 * 0.05 as sx, (44 + s % 20 % 7 - 10 - s % 20 % 5 + 1) * 32 * 0.05 as sy from (select s_suppkey as s from supplier)
  union all
  select s, 2, (85 - (20 + 2 * (s % 20 % 10)) + 1) * 32 * 0.05, (90 - 60 + 1) * 32 * 0.05 from (select s_suppkey as s from supplier)),
stepped as (
  select p.*, greatest(1, cast(ceil(round(greatest(abs(cx - tx) / sx, abs(cy - ty) / sy), 9)) as bigint)) as m
  from pairs p join boxes using (slide_id, region_id)),
first_hit as (select slide_id, region_id, cell_ord, source, target, min(m) as m from stepped group by all),
nearest as (
  select slide_id, region_id, cell_ord, source, target, sqrt(cast(min(d2) as double)) as dist
  from stepped join first_hit using (slide_id, region_id, cell_ord, source, target, m) group by all)"""
_NEAR_OUT = "select slide_id, region_id, cell_ord, source, target, round(dist, 6) as dist from nearest"


@query("jn4_nearest_exact", f"{_NEAREST} {_NEAR_OUT}")
def nearest_exact(spark, sf):
    return rounded(D.nearest_targets(located_of(spark, sf), ALL5), "dist")


# a margin of 14 px grows regions by three px on each side: they stay apart, the first one above row 55
_IN_MARGIN = f"""with {morph_sql(7)}, {CELLS}, inside as (
  select cells.*, case when grown.r < 55 then 1 else 2 end as region_id
  from cells join grown on cells.slide_id = grown.slide_id and cells.y // 32 = grown.r and cells.x // 32 = grown.c where grown.d = 255)"""


@query("jn4_nearest_margin", f"{_IN_MARGIN}, {_PAIR_ROWS}, {_NEAR_ROWS} {_NEAR_OUT}")
def nearest_margin(spark, sf):
    """Distances within the regions grown by their margin."""
    runs, profile = P.prepare_mask(mask_of(spark, sf))
    regions = R.margin_regions(runs, profile.select("slide_id", "height", "width"), 14)
    return rounded(D.nearest_targets(D.located_cells(I.cells(spark, sf), regions, ALL5), ALL5), "dist")


@query("jn4_nearest_whole_slide", f"with {CELLS}, inside as (select *, 1 as region_id from cells), {_PAIR_ROWS}, {_NEAR_ROWS} {_NEAR_OUT}")
def nearest_whole_slide(spark, sf):
    """Distances between all cells of a slide, whatever the mask."""
    return rounded(D.nearest_targets(D.whole_slide(I.cells(spark, sf), ALL5), ALL5), "dist")


@query("jn5_nearest_box_search", f"{_BOXED} {_NEAR_OUT}")
def nearest_box(spark, sf):
    regions = cut(R.label_regions(M.mask_runs(mask_of(spark, sf))))
    located = D.located_cells(I.cells(spark, sf), regions, ALL5)
    return rounded(D.nearest_targets(located, ALL5, D.search_boxes(regions)), "dist")


@query(
    "jn6_class_pairs",
    f"""with {CELLS}, k as (select slide_id, cell_type, count(*) as n from cells group by all)
    select a.slide_id, a.cell_type as source, b.cell_type as target, a.n as n_source, b.n as n_target
    from k a join k b on a.slide_id = b.slide_id and a.cell_type < b.cell_type""",
)
def pairs_of_classes(spark, sf):
    n = I.cells(spark, sf).groupBy("slide_id", "cell_type").agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t in D.class_pairs(ALL5)])
    named = lambda side: n.select("slide_id", F.col("cell_type").alias(side), F.col("n").alias(f"n_{side}"))
    grid = n.select("slide_id").distinct().select("slide_id", F.explode(pairs).alias("p")).select("slide_id", "p.*")
    return grid.join(named("source"), ["slide_id", "source"]).join(named("target"), ["slide_id", "target"])


def _distance_sql() -> str:
    fill = ", ".join(f'case when not held then 0.0 else "{s}" end as "{s}"' for s in STATS)
    return f"""{_NEAREST}, stats as ({stats_sql('nearest', ['slide_id', 'source', 'target'], 'dist')}),
    present as (select distinct slide_id, cell_type from inside),
    grid as (select s_suppkey as slide_id, cast(a as integer) as source, cast(b as integer) as target,
             (s_suppkey, a) in (select (slide_id, cell_type) from present) and (s_suppkey, b) in (select (slide_id, cell_type) from present) as held
             from supplier, range(1, 6) t1(a), range(1, 6) t2(b) where a < b)
    select slide_id, source, target, coalesce(n, 0) as n, {fill} from grid left join stats using (slide_id, source, target)"""


@query("agg9_distance_summary", _distance_sql())
def distances(spark, sf):
    cells = I.cells(spark, sf)
    located = cut(D.located_cells(cells, R.label_regions(M.mask_runs(mask_of(spark, sf))), ALL5))
    nearest = cut(D.nearest_targets(located, ALL5, stored=True))
    return rounded_stats(D.distance_summary(cells, located, nearest, ALL5), *STATS)


@query(
    "agg10_mean_distance",
    f"{_NEAREST} select slide_id, source, target, count(*) as n, round(avg(dist), 6) as mean_dist from nearest group by all",
)
def mean_distance(spark, sf):
    return rounded(D.mean_distances(D.nearest_targets(located_of(spark, sf), ALL5)), "mean_dist")


@query(
    "win8_carried_distance",
    f"""{_NEAREST}, each_pair as (
      select i.slide_id, i.region_id, i.cell_ord, i.cell_type as source, cast(t.k as integer) as target from inside i, range(1, 6) t(k)
      where i.cell_type < t.k and (i.slide_id, t.k) in (select (slide_id, cell_type) from inside)),
    carried as (
      select e.*, last_value(dist ignore nulls) over (partition by e.slide_id, e.source, e.target order by e.cell_ord
        rows between unbounded preceding and current row) as d
      from each_pair e left join nearest n using (slide_id, region_id, cell_ord, source, target))
    select slide_id, region_id, cell_ord, source, target, round(d, 6) as dist from carried where d > 0""",
)
def carried(spark, sf):
    located = cut(located_of(spark, sf))
    return rounded(D.carried_distances(located, D.nearest_targets(located, ALL5, stored=True), ALL5), "dist")


@query(
    "agg34_density_grid",
    f"""with {CELLS}, g as (select slide_id, cell_type, cast(x // 128 as integer) as gx, cast(y // 128 as integer) as gy, count(*) as n from cells group by all)
    select a.slide_id, a.cell_type, a.gx, a.gy, a.n, cast(sum(b.n) as bigint) as n_around from g a join g b
    on a.slide_id = b.slide_id and a.cell_type = b.cell_type and abs(a.gx - b.gx) <= 1 and abs(a.gy - b.gy) <= 1 group by all""",
)
def density(spark, sf):
    return C.density_grid(I.cells(spark, sf))


# --- features ---------------------------------------------------------------------------------

_NAMES = "['Granulocytes','Lymphocytes','PlasmaCells','StromaCells','TumorCells','EpithelialCells']"


def _ratio_sql(source: str, orders: str, suffix: str) -> str:
    """Log ratios from counts (slide_id, cell_type, n); ``orders`` gives each denominator's place."""
    return f"""select a.slide_id, 'LogRatio_' || {_NAMES}[a.cell_type] || '_' ||
        case when '{suffix}' = '' and b.cell_type = 4 then 'StromalCells' else {_NAMES}[b.cell_type] end || '{suffix}' as feature,
        round(ln((a.n + 0.001) / (b.n + 0.001)), 6) + 0.0 as value
      from {source} a join {source} b on a.slide_id = b.slide_id
      where list_position({orders}, a.cell_type) > list_position({orders}, b.cell_type)"""


_FEATURE_BASE = f"""{morph_sql(11)}, {CELLS},
spots as (select cells.*, v, d, e from cells join grown on cells.slide_id = grown.slide_id and y // 32 = r and x // 32 = c),
fixed as (select * exclude (cell_type), case when cell_type = 5 and v = 0 then 6 else cell_type end as cell_type from spots),
kinds as (select s_suppkey as slide_id, k as cell_type from supplier, range(1, 7) t(k)),
w as (select slide_id, cell_type, count(cell_ord) as n from kinds left join fixed using (slide_id, cell_type) group by all),
nt as (select k.slide_id, k.cell_type, count(f.cell_ord) as n, coalesce(sum(4 * hw * hh), 0) as a from kinds k
       left join fixed f on k.slide_id = f.slide_id and k.cell_type = f.cell_type and v = 255 where k.cell_type <= 5 group by all),
nb as (select k.slide_id, k.cell_type, count(f.cell_ord) as n from kinds k
       left join fixed f on k.slide_id = f.slide_id and k.cell_type = f.cell_type and d - e = 255 where k.cell_type <> 5 group by all),
area as (select slide_id, count(*) filter (v = 255) * 1024 as area from mask group by slide_id)"""

_FRACTIONS = f"""select slide_id, {_NAMES}[cell_type] || '_Percentage' as feature, round(n / sum(n) over (partition by slide_id), 6) as value from w"""
_REGION_FRACTIONS = f"""select slide_id, 'Percentage_' || {_NAMES}[cell_type] || '_allcellsinTumor' as feature, round(n / sum(n) over (partition by slide_id), 6) as value from nt
  union all select slide_id, 'Percentage_' || {_NAMES}[cell_type] || '_allcellsinTumorVicinity', round(n / sum(n) over (partition by slide_id), 6) from nb"""
_WSI_RATIOS = _ratio_sql("w", "[5,2,3,1,4,6]", "")
_REGION_RATIOS = (
    _ratio_sql("nt", "[5,2,3,1,4]", "_inTumor") + " union all " + _ratio_sql("nb", "[6,2,3,1,4]", "_inTumorVicinity")
)
_DENSITY = f"""select slide_id, {_NAMES}[cell_type] || '_perTumorarea' as feature, round(n / area, 9) as value from nt join area using (slide_id)
  union all select slide_id, {_NAMES}[cell_type] || 'Density_insideTumorarea', round(a / area, 9) from nt join area using (slide_id)"""
_SHARES = f"""select slide_id, 'Percentage_' || {_NAMES}[cell_type] || '_insideTumor' as feature, round(nt.n / w.n, 6) as value
  from nt join w using (slide_id, cell_type) where cell_type <= 4"""


def _wide(spark, sf):
    """Counts of all kinds side by side, after relabelling."""
    cfg = P.Settings(margin=MARGIN, relabel=True)
    runs, profile = P.prepare_mask(mask_of(spark, sf))
    return P.counts_side_by_side(P.tagged_cells(I.cells(spark, sf), runs, profile, cfg), profile, cfg)


def _plain(df, *features):
    out = df.select("slide_id", "feature", "value")
    return out.where(" or ".join(f"feature like '{f}'" for f in features)) if features else out


@query("agg11_slide_fractions", f"with {_FEATURE_BASE} {_FRACTIONS}")
def fractions(spark, sf):
    mask = M.mask_runs(mask_of(spark, sf))
    cells = C.relabel_outside(I.cells(spark, sf).drop("contour"), mask)
    return rounded(_plain(FT.unfold(FT.wide_counts(C.slide_counts(cells)), FT.slide_features()), "%\\_Percentage"), "value")


@query("agg12_log_ratios", f"with {_FEATURE_BASE} {_WSI_RATIOS} union all {_REGION_RATIOS}")
def log_ratios(spark, sf):
    both = FT.unfold(_wide(spark, sf), FT.slide_features() + FT.region_features())
    return rounded(_plain(both, "LogRatio%"), "value")


@query("agg13_region_fractions", f"with {_FEATURE_BASE} {_REGION_FRACTIONS}")
def region_fractions(spark, sf):
    return rounded(_plain(FT.unfold(_wide(spark, sf), FT.region_features()), "Percentage%"), "value")


@query("agg14_densities", f"with {_FEATURE_BASE} {_DENSITY}")
def densities(spark, sf):
    df = _plain(FT.unfold(_wide(spark, sf), FT.density_features()))
    return df.withColumn("value", F.round("value", 9))


@query("agg15_inside_shares", f"with {_FEATURE_BASE} {_SHARES}")
def shares(spark, sf):
    return rounded(_plain(FT.unfold(_wide(spark, sf), FT.share_features())), "value")


@query(
    "tissue_features_default",
    f"""with {_FEATURE_BASE}, f as ({_FRACTIONS} union all {_WSI_RATIOS} union all {_REGION_FRACTIONS} union all {_REGION_RATIOS}
    union all {_DENSITY.replace(', 9)', ', 6)')} union all {_SHARES})
    select slide_id, feature, value from f""",
)
def default_features(spark, sf):
    """The 65 features of the default switches, for every slide, in one job."""
    df = P.tissue_features(I.cells(spark, sf), mask_of(spark, sf), P.Settings(margin=MARGIN, relabel=True))
    return rounded(df.select("slide_id", "feature", "value"), "value")


@query("tissue_features_full")
def full_features(spark, sf):
    """All 317 features, morphology and distances included."""
    settings = P.Settings(margin=MARGIN, relabel=True, morphology=True, distances=True)
    df = P.tissue_features(I.cells(spark, sf), mask_of(spark, sf), settings)
    return rounded(df.select("slide_id", "section", "grp", "feature", "value"), "value")
