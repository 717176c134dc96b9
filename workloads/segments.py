"""Segmentation scores over the tile pixels."""

from itertools import permutations

from pyspark.sql import functions as F

from cytolake.operators import segmentation as S
from cytolake.runtime import shared_dir
from cytolake.sources.tables import read_tile_pixels
from workloads import inputs as I
from workloads.registry import TILES, fresh_path, query, rounded

_PAIRS = f"""with {TILES},
ov as (select tile_id, ti, pi, count(*) as n from tiles group by all),
ta as (select tile_id, ti, sum(n) as a from ov where ti > 0 group by all),
pa as (select tile_id, pi, sum(n) as a from ov where pi > 0 group by all),
pairs as (select ov.tile_id, ov.ti, ov.pi, ov.n, ov.n / (ta.a + pa.a - ov.n) as iou
  from ov join ta using (tile_id, ti) join pa using (tile_id, pi))"""


@query("agg16_iou_pairs", f"{_PAIRS} select tile_id, ti as true_inst, pi as pred_inst, n as inter, round(iou, 6) as iou from pairs")
def iou(spark, sf):
    return rounded(S.iou_pairs(I.tile_pixels(spark, sf)), "iou")


@query("jn8_overlap", f"with {TILES} select tile_id, ti as true_inst, pi as pred_inst, count(*) as inter from tiles where ti > 0 and pi > 0 group by all")
def overlap(spark, sf):
    return S.iou_pairs(I.tile_pixels(spark, sf)).select("tile_id", "true_inst", "pred_inst", "inter")


@query("jn13_matched", f"{_PAIRS} select tile_id, ti as true_inst, pi as pred_inst, round(iou, 6) as iou from pairs where iou > 0.5")
def matched(spark, sf):
    pairs = S.match_pairs(S.iou_pairs(I.tile_pixels(spark, sf)), 0.5)
    return rounded(pairs.select("tile_id", "true_inst", "pred_inst", "iou"), "iou")


def _best(source: str, name: str) -> str:
    """Pairs that are the best of both their members."""
    order = "order by iou desc, ti, pi"
    return f"""{name} as (select tile_id, ti, pi, iou from (
      select *, row_number() over (partition by tile_id, ti {order}) as rt, row_number() over (partition by tile_id, pi {order}) as rp
      from {source}) where rt = 1 and rp = 1)"""


@query(
    "jn14_matched_greedy",
    f"""{_PAIRS}, open1 as (select * from pairs where iou > 0.05), {_best('open1', 'won1')},
    open2 as (select * from open1 where (tile_id, ti) not in (select (tile_id, ti) from won1) and (tile_id, pi) not in (select (tile_id, pi) from won1)),
    {_best('open2', 'won2')},
    open3 as (select * from open2 where (tile_id, ti) not in (select (tile_id, ti) from won2) and (tile_id, pi) not in (select (tile_id, pi) from won2)),
    {_best('open3', 'won3')}
    select tile_id, ti as true_inst, pi as pred_inst, round(iou, 6) as iou from (from won1 union all from won2 union all from won3)""",
)
def matched_greedy(spark, sf):
    pairs = S.match_pairs(S.iou_pairs(I.tile_pixels(spark, sf)), 0.05)
    return rounded(pairs.select("tile_id", "true_inst", "pred_inst", "iou"), "iou")


_ORDERS = ", ".join(f"({a}, {b}, {c}, {d})" for a, b, c, d in permutations(range(1, 5)))


@query(
    "jn14_best_total",
    f"""{_PAIRS}, orders as (select row_number() over () as o, * from (values {_ORDERS}) as v(a, b, c, d)),
    chosen as (select o, 1 as ti, a as pi from orders union all select o, 2, b from orders union all select o, 3, c from orders union all select o, 4, d from orders),
    totals as (select tile_id, o, sum(iou) as total from pairs join chosen using (ti, pi) group by all)
    select tile_id, round(max(total), 6) as total from totals group by tile_id""",
)
def best_total(spark, sf):
    """The greatest total a one-to-one pairing of a tile's instances reaches; in SQL by trying all orders of four."""
    pairs = S.assign_pairs(S.iou_pairs(I.tile_pixels(spark, sf)))
    return rounded(pairs.groupBy("tile_id").agg(F.sum("iou").alias("total")), "total")


@query(
    "jn11_unpaired",
    f"""{_PAIRS} select tile_id, 'true' as side, ti as inst from ta where (tile_id, ti) not in (select (tile_id, ti) from pairs where iou > 0.5)
    union all select tile_id, 'pred', pi from pa where (tile_id, pi) not in (select (tile_id, pi) from pairs where iou > 0.5)""",
)
def left_over(spark, sf):
    px = I.tile_pixels(spark, sf)
    return S.unpaired(px, S.match_pairs(S.iou_pairs(px), 0.5))


@query(
    "agg18_panoptic_quality",
    f"""{_PAIRS}, h as (select tile_id, count(*) as tp, sum(iou) as s from pairs where iou > 0.5 group by all),
    m as (select p_partkey as tile_id, coalesce(tp, 0) as tp, coalesce(s, 0) as s, coalesce(nt, 0) as nt, coalesce(np, 0) as np from part
      left join h on h.tile_id = p_partkey
      left join (select tile_id, count(*) as nt from ta group by all) a on a.tile_id = p_partkey
      left join (select tile_id, count(*) as np from pa group by all) b on b.tile_id = p_partkey)
    select tile_id, round(tp / (tp + 0.5 * (np - tp) + 0.5 * (nt - tp)), 6) as dq, round(s / (tp + 1e-6), 6) as sq,
    round(tp / (tp + 0.5 * (np - tp) + 0.5 * (nt - tp)) * (s / (tp + 1e-6)), 6) as pq from m""",
)
def quality(spark, sf):
    return rounded(S.panoptic_quality(I.tile_pixels(spark, sf)), "dq", "sq", "pq")


_CLASS_PQ = f"""with {TILES},
ov as (select tile_id, tc, ti, pc, pi, count(*) as n from tiles group by all),
ta as (select tile_id, tc as k, ti, sum(n) as a from ov where tc > 0 group by all),
pa as (select tile_id, pc as k, pi, sum(n) as a from ov where pc > 0 group by all),
hits as (select ov.tile_id, ov.tc as k, count(*) as tp, sum(ov.n / (ta.a + pa.a - ov.n)) as s
  from ov join ta on ta.tile_id = ov.tile_id and ta.k = ov.tc and ta.ti = ov.ti
          join pa on pa.tile_id = ov.tile_id and pa.k = ov.pc and pa.pi = ov.pi
  where tc = pc and ov.ti > 0 and ov.pi > 0 and ov.n / (ta.a + pa.a - ov.n) > 0.5 group by all),
grid as (select p_partkey as tile_id, cast(k as integer) as k from part, range(1, 6) t(k)),
q as (select grid.tile_id, grid.k, nt, np, coalesce(tp, 0) as tp, coalesce(s, 0) as s from grid
  left join (select tile_id, k, count(*) filter (ti > 0) as nt from ta group by all) using (tile_id, k)
  left join (select tile_id, k, count(*) filter (pi > 0) as np from pa group by all) using (tile_id, k)
  left join hits using (tile_id, k)),
scored as (select tile_id, k as class,
  case when nt is not null and np is null then 0.0 when nt > 0 and np > 0 then tp / (tp + 0.5 * (np - tp) + 0.5 * (nt - tp)) end as dq,
  case when nt is not null and np is null then 0.0 when nt > 0 and np > 0 then s / (tp + 1e-6) end as sq,
  case when nt is not null and np is null then 0.0 when nt > 0 and np > 0
       then tp / (tp + 0.5 * (np - tp) + 0.5 * (nt - tp)) * (s / (tp + 1e-6)) end as pq from q)"""


@query("agg18_class_panoptic_quality", f"{_CLASS_PQ} select tile_id, class, round(dq, 6) as dq, round(sq, 6) as sq, round(pq, 6) as pq from scored")
def class_quality(spark, sf):
    return rounded(S.class_panoptic_quality(I.tile_pixels(spark, sf)), "dq", "sq", "pq")


@query("agg19_mean_panoptic_quality", f"{_CLASS_PQ} select class, count(pq) as n_tiles, round(avg(pq), 6) as mean_pq from scored group by class")
def mean_quality(spark, sf):
    return rounded(S.mean_panoptic_quality(S.class_panoptic_quality(I.tile_pixels(spark, sf))), "mean_pq")


_GEOMETRY = f"""with {TILES}, geo as (
  select tile_id, ti as inst, count(*) as area, cast(floor(avg(r)) as integer) as "row", cast(floor(avg(c)) as integer) as col,
         min(r) as min_row, min(c) as min_col, max(r) + 1 as max_row, max(c) + 1 as max_col
  from tiles where ti > 0 group by all)"""


@query("agg17_instance_geometry", f"{_GEOMETRY} select * from geo")
def geometry(spark, sf):
    return S.instance_geometry(I.tile_pixels(spark, sf), "true_inst")


@query(
    "jn10_class_at_centroid",
    f"""{_GEOMETRY} select tile_id, inst, tiles.tc as class from geo join tiles using (tile_id) where tiles.r = geo."row" and tiles.c = geo.col""",
)
def at_centroid(spark, sf):
    return S.class_at_centroid(I.tile_pixels(spark, sf), "true_inst", "true_class")


_PAIRED = f"""{_PAIRS},
tg as (select tile_id, ti, cast(floor(avg(r)) as integer) as r, cast(floor(avg(c)) as integer) as c from tiles where ti > 0 group by all),
pg as (select tile_id, pi, cast(floor(avg(r)) as integer) as r, cast(floor(avg(c)) as integer) as c from tiles where pi > 0 group by all),
tn as (select tg.tile_id, tg.ti, tiles.tc as t from tg join tiles using (tile_id, r, c)),
pn as (select pg.tile_id, pg.pi, tiles.pc as p from pg join tiles using (tile_id, r, c)),
paired as (select pairs.tile_id, pairs.ti as true_inst, pairs.pi as pred_inst, t, p from pairs join tn using (tile_id, ti) join pn using (tile_id, pi)
  where iou > 0.5 and t <> 0 and p <> 0)"""


@query("prj16_paired_classes", f"{_PAIRED} select * from paired")
def paired(spark, sf):
    return S.paired_classes(I.tile_pixels(spark, sf))


@query(
    "agg20_confusion_matrix",
    f"""{_PAIRED}, k as (select t as c from paired union select p from paired),
    m as (select a.c as t, b.c as p, count(paired.t) as n from k a cross join k b left join paired on paired.t = a.c and paired.p = b.c group by all),
    s as (select *, coalesce(n / nullif(sum(n) over (partition by t), 0), 0.0) as of_t, coalesce(n / nullif(sum(n) over (partition by p), 0), 0.0) as of_p from m)
    select t, p, n, round(of_t, 6) as of_truth, round(of_p, 6) as of_pred, printf('%d (%.2f%%)', n, of_t * 100) as truth_text,
    printf('%d (%.2f%%)', n, of_p * 100) as pred_text from s""",
)
def confusion(spark, sf):
    return rounded(S.confusion_matrix(S.paired_classes(I.tile_pixels(spark, sf))), "of_truth", "of_pred")


@query(
    "agg20_label_confusion",
    """with k as (select quality as c from labels union select toxic from labels),
    m as (select a.c as t, b.c as p, count(l.doc_id) as n from k a cross join k b left join labels l on l.quality = a.c and l.toxic = b.c group by all),
    s as (select *, coalesce(n / nullif(sum(n) over (partition by t), 0), 0.0) as of_t, coalesce(n / nullif(sum(n) over (partition by p), 0), 0.0) as of_p from m)
    select t, p, n, round(of_t, 6) as of_truth, round(of_p, 6) as of_pred, printf('%d (%.2f%%)', n, of_t * 100) as truth_text,
    printf('%d (%.2f%%)', n, of_p * 100) as pred_text from s""",
)
def label_confusion(spark, sf):
    labels = I.table(spark, sf, "labels").select(F.col("quality").alias("t"), F.col("toxic").alias("p"))
    return rounded(S.confusion_matrix(labels), "of_truth", "of_pred")


@query(
    "agg21_cell_counts",
    f"""{_GEOMETRY}, named as (select tile_id, inst, tiles.tc as class from geo join tiles using (tile_id) where tiles.r = geo."row" and tiles.c = geo.col and tiles.tc <> 0)
    select tile_id, class, count(*) as n from named group by grouping sets ((tile_id, class), (class), ())""",
)
def counts(spark, sf):
    return S.cell_counts(I.tile_pixels(spark, sf))


@query(
    "agg22_majority_class",
    f"""with {TILES}, votes as (select tile_id, pi, tc, count(*) as n, min(r * 100 + c) as first from tiles where pi > 0 and tc > 0 group by all),
    best as (select tile_id, pi, tc from votes qualify row_number() over (partition by tile_id, pi order by n desc, first) = 1),
    dom as (select tile_id, tc from (select tile_id, tc, count(*) as n from tiles where tc > 0 group by all)
      qualify row_number() over (partition by tile_id order by n desc, tc) = 1),
    ids as (select distinct tile_id, pi from tiles where pi > 0)
    select ids.tile_id, ids.pi as inst, coalesce(best.tc, dom.tc) as class from ids left join best using (tile_id, pi) left join dom using (tile_id)""",
)
def majority(spark, sf):
    return S.majority_class(I.tile_pixels(spark, sf))


@query(
    "agg23_layers_from_channels",
    f"""with {TILES}, ch as (
      select tile_id, r, c, 0 as channel, case when ti % 2 = 0 then ti else 0 end as value from tiles
      union all select tile_id, r, c, 1, case when ti > 0 and c % 3 = 0 then ti + 2 else 0 end from tiles
      union all select tile_id, r, c, 2, case when pi = 3 then 1 else 0 end from tiles
      union all select tile_id, r, c, 3, 9 from tiles),
    l as (select tile_id, r, c, coalesce(arg_max(value, channel) filter (value <> 0 and channel < 3), 0) as inst,
          coalesce(max(channel + 1) filter (value <> 0 and channel < 3), 0) as type from ch group by all)
    select tile_id, cast(sum(case when inst = 1 then 0 else inst end) as bigint) as inst_sum, cast(sum(case when type = 1 then 0 else type end) as bigint) as type_sum,
      count(*) as n from l group by tile_id""",
)
def channels(spark, sf):
    px = I.tile_pixels(spark, sf)
    t, c = F.col("true_inst"), F.col("col")
    values = F.array(
        F.when(t % 2 == 0, t).otherwise(0),
        F.when((t > 0) & (c % 3 == 0), t + 2).otherwise(0),
        F.when(F.col("pred_inst") == 3, 1).otherwise(0),
        F.lit(9),
    )
    ch = px.select("tile_id", "row", "col", F.posexplode(values).alias("channel", "value"))
    layers = S.layers_from_channels(ch, background=3)
    return layers.groupBy("tile_id").agg(
        F.sum("inst").alias("inst_sum"), F.sum("type").alias("type_sum"), F.count("*").alias("n")
    )


@query(
    "jn7_class_map",
    f"with {TILES} select tile_id, cast(case when ti = 0 then 0 else 1 + (ti + tile_id) % 5 end as integer) as class_map, count(*) as n from tiles group by all",
)
def class_map(spark, sf):
    px = I.tile_pixels(spark, sf)
    vector = px.where("true_inst > 0").select(
        "tile_id",
        F.col("true_inst").alias("inst"),
        (1 + (F.col("true_inst") + F.col("tile_id")) % 5).cast("int").alias("class"),
    ).distinct()
    mapped = S.class_map_from_vector(px, "true_inst", vector)
    return mapped.groupBy("tile_id", "class_map").agg(F.count("*").alias("n"))


@query(
    "jn9_stacked_layers",
    f"""with {TILES} select tile_id, cast(sum((r * 7 + c) % 256) as bigint) as red, cast(sum(ti) as bigint) as inst, cast(sum(tc) as bigint) as type, count(*) as n
    from tiles where (tile_id + r) % 5 <> 0 and tc > 0 group by tile_id""",
)
def stacked(spark, sf):
    px = I.tile_pixels(spark, sf)
    at = ["tile_id", "row", "col"]
    rgb = px.select(*at, ((F.col("row") * 7 + F.col("col")) % 256).alias("r"))
    inst = px.where((F.col("tile_id") + F.col("row")) % 5 != 0).select(*at, F.col("true_inst").alias("inst"))
    cls = px.where("true_class > 0").select(*at, F.col("true_class").alias("type"))
    return S.stack_layers(rgb, inst, cls).groupBy("tile_id").agg(
        F.sum("r").alias("red"), F.sum("inst").alias("inst"), F.sum("type").alias("type"), F.count("*").alias("n")
    )


@query("jn9_grouped_labels", f"with {TILES} select tile_id, r as row, c as col, ti as inst, tc as type from tiles")
def grouped(spark, sf):
    """Instance and class maps of every tile, written as nested arrays and read back as pixels."""
    path = fresh_path(shared_dir(spark), "grouped")
    px = I.tile_pixels(spark, sf).select("tile_id", "row", "col", F.col("true_inst").alias("inst"), F.col("true_class").alias("type"))
    S.grouped_labels(px).write.parquet(path)
    return S.grouped_pixels(spark.read.parquet(path))


@query(
    "prj17_per_class_instances",
    f"with {TILES} select tile_id, tc as class, ti as inst, count(*) as n from tiles where tc between 1 and 5 and ti > 0 group by all",
)
def per_class(spark, sf):
    px = S.per_class_instances(I.tile_pixels(spark, sf), "true_inst", "true_class")
    return px.groupBy("tile_id", "class", "inst").agg(F.count("*").alias("n"))


_IDS = f"with {TILES}, ids as (select tile_id, pi * 3 as inst, count(*) as area from tiles where pi > 0 group by all)"


@query(
    "win9_remap_labels",
    f"{_IDS} select tile_id, cast(inst as integer) as inst, cast(row_number() over (partition by tile_id order by inst) as integer) as new_inst from ids",
)
def relabelled(spark, sf):
    return S.remap_labels(_gapped(spark, sf))


@query(
    "win9_remap_labels_by_size",
    f"{_IDS} select tile_id, cast(inst as integer) as inst, cast(row_number() over (partition by tile_id order by area desc, inst) as integer) as new_inst from ids",
)
def relabelled_by_size(spark, sf):
    return S.remap_labels(_gapped(spark, sf), by_size=True)


def _gapped(spark, sf):
    """Predicted instances renumbered 3, 6, 9, .."""
    px = I.tile_pixels(spark, sf)
    return px.where("pred_inst > 0").groupBy("tile_id", (F.col("pred_inst") * 3).alias("inst")).agg(
        F.count("*").alias("area")
    )


@query(
    "src9_tile_pixels",
    f"with {TILES} select tile_id, count(*) as n, cast(sum(ti) as bigint) as t, cast(sum(pi) as bigint) as p from tiles group by tile_id",
)
def stored_tiles(spark, sf):
    path = fresh_path(shared_dir(spark), "tile_pixels")
    I.tile_pixels(spark, sf).write.parquet(path)
    return read_tile_pixels(spark, path).groupBy("tile_id").agg(
        F.count("*").alias("n"), F.sum("true_inst").alias("t"), F.sum("pred_inst").alias("p")
    )
