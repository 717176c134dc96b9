"""Sources, sinks, documents and name handling."""

from pyspark.sql import functions as F

from cytolake.functions import text as TX
from cytolake.operators import cells as C
from cytolake.operators import documents as DOC
from cytolake.operators import matrix as MX
from cytolake.operators import segmentation as S
from cytolake.functions.ordering import positions
from cytolake.plans import feature_matrix as FMP
from cytolake.plans import slide_features as P
from cytolake.runtime import cut, shared_dir
from cytolake.sources import cells as SC
from cytolake.sources import sinks as K
from cytolake.sources import tables as ST
from cytolake.sources.files import write_files
from cytolake.streaming.ingest import stream_cells
from workloads import inputs as I
from workloads.registry import CELLS, FM, LOCATED, TILES, fresh_path, query, r6, rounded
from workloads.spatial import mask_of

SLIDE_FOLDER = r"slide=([^/]+)/"


def _cell_documents(spark, sf) -> str:
    path = fresh_path(shared_dir(spark), "cell_documents")
    K.write_cell_documents(I.cells(spark, sf), path)
    return path


# --- sources ----------------------------------------------------------------------------------

_CELL_ROWS = f"""with {CELLS} select slide_id, 'n-' || cell_ord as cell_id, round(cx, 6) as cx, round(cy, 6) as cy, cell_type,
  cast(4 * hw * hh as double) as area"""


def _checked(cells):
    measured = C.with_measures(cells).withColumn("slide_id", F.col("slide_id").cast("bigint"))
    return rounded(measured.select("slide_id", "cell_ord", "cell_id", "cx", "cy", "cell_type", "area"), "cx", "cy")


@query("src1_read_cells", f"{_CELL_ROWS}, row_number() over (partition by slide_id order by cell_ord) as nth from cells")
def read_cells(spark, sf):
    """Documents are written, read back and parsed; ``nth`` checks their order."""
    found = cut(_checked(SC.read_cells(spark, _cell_documents(spark, sf), SLIDE_FOLDER)))
    return positions(found, ["slide_id"], "cell_ord", "nth").drop("cell_ord")


@query("src5_stream_cells", f"{_CELL_ROWS} from cells")
def streamed_cells(spark, sf):
    """The same documents through the streaming reader; a second run must add nothing."""
    source, folder = _cell_documents(spark, sf), fresh_path(shared_dir(spark), "stream")
    for _ in range(2):
        stream_cells(spark, source, f"{folder}/cells", f"{folder}/state", SLIDE_FOLDER).awaitTermination()
    stored = spark.read.parquet(f"{folder}/cells/batch=*")
    return _checked(stored).drop("cell_ord")


@query(
    "src1_documents_in_column",
    """with e as (select event_id, cast(json_extract(props, '$.k') as integer) as k from events)
    select event_id as slide_id, 'a' as cell_id, cast(k as double) as cx, cast(k + 0.5 as double) as cy, k % 6 + 1 as cell_type from e
    union all select event_id, 'b', cast(k * 2 as double), 7.0, 2 from e""",
)
def column_documents(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    doc = F.format_string(
        '{"mag": null, "nuc": {"a": {"bbox": [[1, 2], [3, 4]], "centroid": [%d, %d.5], "type": %d}, "b": {"centroid": [%d, 7], "type": 2}}}',
        k, k, k % 6 + 1, k * 2,
    )
    docs = I.table(spark, sf, "events").select(F.col("event_id").alias("slide_id"), doc.alias("doc"))
    return SC.cells_from_documents(docs).select("slide_id", "cell_id", "cx", "cy", "cell_type")


@query(
    "src3_pair_slides",
    "select c_custkey as slide_id, c_custkey in (select o_custkey from orders) as has_mask from customer",
)
def pair(spark, sf):
    slides = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("slide_id"))
    masks = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("slide_id"))
    return ST.pair_slides(slides, masks)


_FILES = """files as (select p_partkey, replace(p_name, ' ', '_') ||
  ['', '_data', '_analysed', '_cellnbr', '_vicinity_analysed'][p_size % 5 + 1] || '.json' as name from part
  union all select p_partkey, '._' || replace(p_name, ' ', '_') || '_analysed.json' from part)"""


def _files(spark, sf):
    tail = F.array(*[F.lit(t) for t in ("", "_data", "_analysed", "_cellnbr", "_vicinity_analysed")])
    stem = F.replace("p_name", F.lit(" "), F.lit("_"))
    part = I.table(spark, sf, "part")
    plain = part.select("p_partkey", F.concat(stem, tail[F.col("p_size") % 5], F.lit(".json")).alias("name"))
    return plain.unionByName(
        part.select("p_partkey", F.concat(F.lit("._"), stem, F.lit("_analysed.json")).alias("name"))
    )


@query(
    "src4_source_filters",
    f"""with {_FILES} select 'input' as kind, name, count(*) as n from files
    where not contains(name, 'data') and not contains(name, 'analysed') and not contains(name, 'cellnbr') group by all
    union all select 'result', name, count(*) from files where contains(name, 'analysed') and not contains(name, '._') and not contains(name, '.DS_S') group by all""",
)
def source_filters(spark, sf):
    files = _files(spark, sf)
    kind = lambda df, k: df.groupBy(F.lit(k).alias("kind"), "name").agg(F.count("*").alias("n"))
    return kind(ST.input_sources(files), "input").unionByName(kind(ST.result_sources(files), "result"))


@query(
    "src5_unprocessed",
    "select p_partkey as slide_id from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 45)",
)
def unprocessed(spark, sf):
    """Parts without a large order stand for slides without a result."""
    done = I.table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("slide_id"))
    return ST.unprocessed(I.table(spark, sf, "part").select(F.col("p_partkey").alias("slide_id")), done)


@query("src6_id_lookup", "select cast(user_id as varchar) as k, arg_max(event_type, event_id) as v from events group by 1")
def lookup(spark, sf):
    """The pairs are written as headerless CSV files in event order and read back."""
    path = fresh_path(shared_dir(spark), "lookup")
    events = I.table(spark, sf, "events").repartitionByRange("event_id").sortWithinPartitions("event_id")
    events.select(F.col("user_id").cast("string"), "event_type").write.csv(path)
    return ST.read_id_lookup(spark, path)


@query(
    "jn12_sample_ids",
    """with l as (select cast(user_id as varchar) as k, arg_max(event_type, event_id) as v from events group by 1)
    select c_custkey as slide_id, cast(c_custkey as varchar) as sample, v as patient from customer left join l on k = cast(c_custkey as varchar)""",
)
def sample_ids(spark, sf):
    slides = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("slide_id"), F.col("c_custkey").cast("string").alias("sample")
    )
    return ST.with_sample_ids(slides, lookup(spark, sf), "sample", "patient")


@query(
    "src8_ranking",
    """select p_partkey, unnest([p_type, p_brand, replace(p_name, ' ', '_')]) as feature, unnest([1, 2, 3]) as rank from part""",
)
def ranking(spark, sf):
    doc = F.format_string('{"%s": {"count": 3}, "%s": 1, "%s": 2}', "p_type", "p_brand", F.replace("p_name", F.lit(" "), F.lit("_")))
    return ST.ranking_from_documents(I.table(spark, sf, "part").select("p_partkey", doc.alias("doc")))


@query(
    "src8_ranking_files",
    """with t as (select p_brand, p_type, sum(p_retailprice) as s from part group by all)
    select p_brand as name, p_type as feature, cast(row_number() over (partition by p_brand order by s desc, p_type) as integer) as rank from t""",
)
def ranking_files(spark, sf):
    """One ranking document per brand, its keys in falling order, written as a file of its own and read back."""
    worth = I.table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("s"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("down"), "p_type", "s")))
    entry = lambda x: F.concat(F.lit('"'), x["p_type"], F.lit('": '), x["s"].cast("string"))
    docs = worth.groupBy("p_brand").agg(F.concat(F.lit("{"), F.array_join(F.transform(order, entry), ", "), F.lit("}")).alias("doc"))
    path = fresh_path(shared_dir(spark), "rankings")
    write_files(docs.select(F.concat("p_brand", F.lit(".json")).alias("name"), F.col("doc").alias("content")), path)
    return ST.read_ranking(spark, path).select("name", "feature", "rank")


@query(
    "src7_document_files",
    """select cast(l_suppkey as varchar) as slide_id, l_returnflag || '_' || unnest(['lines', 'quantity']) as feature,
    unnest([count(*) + 0.0, cast(sum(l_quantity) as double)]) as value from lineitem group by l_suppkey, l_returnflag""",
)
def document_files(spark, sf):
    """Result documents written as a file per slide under their published names; every value is read back from them."""
    sums = I.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("slide_id"), "l_returnflag").agg(
        F.count("*").cast("double").alias("lines"), F.sum("l_quantity").cast("double").alias("quantity")
    )
    features = sums.unpivot(["slide_id", "l_returnflag"], ["lines", "quantity"], "leaf", "value").select(
        "slide_id", F.array("l_returnflag", "leaf").alias("path"), "value"
    )
    path = fresh_path(shared_dir(spark), "documents")
    named = F.concat(F.col("slide_id").cast("string"), F.lit("_analysed.json"))
    write_files(K.feature_documents(features).select(named.alias("name"), F.col("doc").alias("content")), path)
    docs = ST.read_feature_docs(spark, path).withColumn("slide_id", F.replace("slide_id", F.lit("_analysed")))
    return DOC.numeric_features(DOC.flatten_full(DOC.document_leaves(docs), ["slide_id"])).select("slide_id", "feature", "value")


# --- documents --------------------------------------------------------------------------------

# {"S": {"G1": {"areas_mean": k, "x": id}, "G2": {"areas_mean": v, "x": "Not calculated"}}, "Empty": {}, "top": 1}
_DOC_SQL = """e as (select event_id, cast(json_extract(props, '$.k') as integer) as k, value from events)"""


def _documents(spark, sf):
    doc = F.format_string(
        '{"S": {"G1": {"areas_mean": %d, "x": %d}, "G2": {"areas_mean": %s, "x": "Not calculated"}}, "Empty": {}, "top": 1}',
        F.get_json_object("props", "$.k").cast("int"),
        "event_id",
        F.col("value").cast("string"),
    )
    return I.table(spark, sf, "events").select(F.col("event_id").alias("slide_id"), doc.alias("doc"))


def _numbers(flat):
    return rounded(DOC.numeric_features(flat).select("slide_id", "feature", "value"), "value")


@query(
    "src7_feature_documents",
    f"""with {_DOC_SQL} select event_id as slide_id, unnest(['S_G1_areas_mean', 'S_G2_areas_mean', 'top', 'x']) as feature,
    unnest([k + 0.0, value, 1.0, null]) as value from e""",
)
def feature_documents(spark, sf):
    """Documents are written as files' lines, read back and flattened with ancestor names."""
    path = fresh_path(shared_dir(spark), "feature_docs")
    _documents(spark, sf).write.json(path)
    docs = spark.read.schema("slide_id bigint, doc string").json(path)
    return _numbers(DOC.rename_by_ancestors(DOC.document_leaves(docs), ["slide_id"]))


@query(
    "scl9_flatten_full",
    f"""with {_DOC_SQL} select event_id as slide_id, unnest(['S_G1_areas_mean', 'S_G1_x', 'S_G2_areas_mean', 'S_G2_x', 'top']) as feature,
    unnest([k + 0.0, event_id + 0.0, value, null, 1.0]) as value from e""",
)
def flatten_full(spark, sf):
    return _numbers(DOC.flatten_full(DOC.document_leaves(_documents(spark, sf)), ["slide_id"]))


@query(
    "scl10_flatten_leaf",
    f"""with {_DOC_SQL} select event_id as slide_id, unnest(['areas_mean', 'x', 'top']) as feature, unnest([value, null, 1.0]) as value from e""",
)
def flatten_leaf(spark, sf):
    return _numbers(DOC.flatten_leaf(DOC.document_leaves(_documents(spark, sf)), ["slide_id"]))


@query(
    "scl11_rename_parent",
    f"""with {_DOC_SQL} select event_id as slide_id, unnest(['G1_areas_mean', 'G2_areas_mean', 'x', 'top']) as feature, unnest([k + 0.0, value, null, 1.0]) as value from e""",
)
def rename_parent(spark, sf):
    leaves = DOC.document_leaves(_documents(spark, sf))
    return _numbers(DOC.rename_by_ancestors(leaves, ["slide_id"], ["areas_mean"], levels=1))


@query(
    "scl12_rename_ancestors",
    f"""with {_DOC_SQL} select event_id as slide_id, unnest(['S_G1_areas_mean', 'S_G2_areas_mean', 'S_G1_x', 'S_G2_x', 'top']) as feature,
    unnest([k + 0.0, value, event_id + 0.0, null, 1.0]) as value from e""",
)
def rename_ancestors(spark, sf):
    leaves = DOC.document_leaves(_documents(spark, sf))
    return _numbers(DOC.rename_by_ancestors(leaves, ["slide_id"], ["areas_mean", "x"], levels=2))


@query(
    "prj9_matrix_from_documents",
    f"""with {_DOC_SQL} select event_id as slide_id, unnest(['S_G1_areas_mean', 'S_G2_areas_mean', 'top']) as feature, unnest([k + 0.0, value, 1.0]) as value from e""",
)
def matrix_from_documents(spark, sf):
    return rounded(FMP.matrix_from_documents(_documents(spark, sf)), "value")


# --- text -------------------------------------------------------------------------------------


@query(
    "scl8_text_replace",
    "select doc_id, md5(replace(replace(text, 'the', '<>'), 'an', '')) as h from documents",
)
def replaced(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", F.md5(TX.replace_twice(F.col("text"), "the", "<>", "an", "")).alias("h")
    )


@query(
    "scl13_stable_ids",
    "select count(distinct p_name) as names, count(distinct p_name) as ids from part",
)
def stable_ids(spark, sf):
    return I.table(spark, sf, "part").agg(
        F.countDistinct("p_name").alias("names"), F.countDistinct(TX.stable_id(F.col("p_name"))).alias("ids")
    )


@query(
    "scl14_positions_by_value",
    "select p_brand, row_number() over (partition by p_brand order by p_partkey) - 1 as nth, p_partkey from part",
)
def by_value(spark, sf):
    return MX.positions_by_value(I.table(spark, sf, "part"), "p_brand", "p_partkey")


@query(
    "win10_ordered_ids",
    "select p_name, row_number() over (order by min(p_partkey)) as id from part group by p_name",
)
def ordered(spark, sf):
    return MX.ordered_ids(I.table(spark, sf, "part"), "p_name", "p_partkey")


@query(
    "scl15_json_numbers",
    "select p_partkey, '{\"size\":' || p_size || ',\"list\":[' || p_size || ',' || p_size + 1 || ']}' as j from part",
)
def json_numbers(spark, sf):
    s = F.col("p_size")
    return I.table(spark, sf, "part").select(
        "p_partkey", F.to_json(F.struct(s.alias("size"), F.array(s, s + 1).alias("list"))).alias("j")
    )


@query(
    "prj10_11_labels_from_names",
    """select p_partkey, replace(p_name, ' ', '_') || case when p_size % 2 = 0 then '_vicinity_no_response_analysed' else '_response_analysed.json' end as slide_id,
    case when p_size % 2 = 0 then 0 else 1 end as label, replace(p_name, ' ', '_') as sample from part""",
)
def labels(spark, sf):
    stem = F.replace("p_name", F.lit(" "), F.lit("_"))
    tail = F.when(F.col("p_size") % 2 == 0, "_vicinity_no_response_analysed").otherwise("_response_analysed.json")
    name = F.col("slide_id")
    return I.table(spark, sf, "part").select("p_partkey", F.concat(stem, tail).alias("slide_id")).select(
        "p_partkey", "slide_id", TX.label_from_name(name).alias("label"), TX.sample_from_name(name).alias("sample")
    )


# --- sinks ------------------------------------------------------------------------------------


@query(
    "snk1_class_counts",
    f"""with {CELLS}, kinds as (select distinct slide_id, cast(k as integer) as cell_type from cells, range(7) t(k))
    select slide_id, cell_type, count(cell_ord) as n from kinds left join cells using (slide_id, cell_type) group by all""",
)
def class_counts(spark, sf):
    path = fresh_path(shared_dir(spark), "class_counts")
    K.write_class_counts(C.slide_counts(I.cells(spark, sf)), path)
    return spark.read.parquet(path).select("slide_id", "cell_type", "n")


@query(
    "snk2_feature_documents",
    f"""with {LOCATED}, n as (select s_suppkey as slide_id, k, (select count(*) from located l where l.slide_id = s_suppkey and l.cell_type = k and region_id > 0) as n,
      (select count(*) from located l where l.slide_id = s_suppkey and l.cell_type = k) as w from supplier, range(1, 5) t(k))
    select slide_id || '_vicinity_analysed.json' as name, 'Granulocytes' as probe, round(n / w, 6) as share from n where k = 1""",
)
def feature_files(spark, sf):
    """Nested documents are written, and one value is read back by its path."""
    path = fresh_path(shared_dir(spark), "features")
    features = P.tissue_features(I.cells(spark, sf), mask_of(spark, sf), P.Settings(margin=704))
    K.write_feature_documents(features, path)
    spot = "$.CalculationsMixed.Percentage_of_Cells_inside_Tumor_regions_for_a_given_cell_type.Percentage_Granulocytes_insideTumor"
    docs = spark.read.schema("name string, doc string").json(path)
    share = F.get_json_object("doc", spot).cast("double")
    return docs.select("name", F.lit("Granulocytes").alias("probe"), r6(share).alias("share"))


@query(
    "snk3_matrix",
    f"""with {FM}, c as (select a.feature as a, b.feature as b, corr(a.value, b.value) as r from fm a join fm b using (slide_id) group by all)
    select 'matrix' as part, slide_id::varchar as a, feature as b, round(value, 6) as value from fm
    union all select 'labels', vec_id::varchar, (label % 2)::varchar, cast(label // 2 as double) from embeddings
    union all select distinct 'names', feature, null, null from fm
    union all select 'correlations', a, b, round(r, 6) + 0.0 from c""",
)
def matrix_files(spark, sf):
    """All four parts are written and read back."""
    path = fresh_path(shared_dir(spark), "matrix")
    fm = I.feature_matrix(spark, sf)
    K.write_matrix(fm, I.sample_labels(spark, sf), MX.correlations(fm), path)
    text = lambda c: F.col(c).cast("string")
    part = lambda name, df, a, b, value: df.select(
        F.lit(name).alias("part"), a.alias("a"), b.cast("string").alias("b"), value.cast("double").alias("value")
    )
    none = F.lit(None)
    out = part("matrix", spark.read.parquet(f"{path}/matrix"), text("slide_id"), F.col("feature"), F.col("value"))
    out = out.unionByName(part("labels", spark.read.parquet(f"{path}/labels"), text("slide_id"), F.col("label"), F.col("cohort_id")))
    out = out.unionByName(part("names", spark.read.parquet(f"{path}/names"), F.col("feature"), none, none))
    corr = K.read_csv(spark, f"{path}/correlations")
    return rounded(out.unionByName(part("correlations", corr, F.col("feature_a"), F.col("feature_b"), F.col("r"))), "value")


@query(
    "snk4_count_table",
    f"""with {TILES}, geo as (select tile_id, ti, cast(floor(avg(r)) as integer) as r, cast(floor(avg(c)) as integer) as c from tiles where ti > 0 group by all),
    named as (select geo.tile_id, tiles.tc as k from geo join tiles using (tile_id, r, c) where tiles.tc <> 0)
    select tile_id || '.png' as "Image", cast(count(*) filter (k = 1) as varchar) as "Granulocyte", cast(count(*) filter (k = 2) as varchar) as "Lymphocyte",
    cast(count(*) filter (k = 3) as varchar) as "Plasma", cast(count(*) filter (k = 4) as varchar) as "Stromal", cast(count(*) filter (k = 5) as varchar) as "Tumor"
    from named group by tile_id""",
)
def count_csv(spark, sf):
    path = fresh_path(shared_dir(spark), "counts")
    K.write_csv(K.count_table(S.image_class_counts(I.tile_pixels(spark, sf))), path)
    return K.read_csv(spark, path)


@query("snk4_type_table", "select p_partkey || '.png' as img, 'Skin' as type from part")
def type_csv(spark, sf):
    images = I.table(spark, sf, "part").select(F.col("p_partkey").alias("tile_id"))
    return K.type_table(images)


@query(
    "snk7_geojson",
    f"""with {CELLS} select slide_id, cell_ord, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' ||
    (x - hw) || '.0,' || (y - hh) || '.0],[' || (x + hw) || '.0,' || (y - hh) || '.0],[' || (x + hw) || '.0,' || (y + hh) || '.0],[' ||
    (x - hw) || '.0,' || (y + hh) || '.0],[' || (x - hw) || '.0,' || (y - hh) || '.0]]]}},"properties":{{"objectType":"annotation","classification":{{"name":"' ||
    ['Granulocyte','Lymphocyte','Plasma cell','Stroma','Tumor'][cell_type] || '"}}}}}}' as feature from cells""",
)
def geojson(spark, sf):
    return K.geojson_features(I.cells(spark, sf), {"Plasma": "Plasma cell"})
