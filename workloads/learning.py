"""Feature matrix, selection, folds, scores and descriptive statistics."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cytolake.functions.ordering import positions
from cytolake.operators import describe as DS
from cytolake.operators import evaluation as E
from cytolake.operators import folds as FO
from cytolake.operators import linkage as LK
from cytolake.operators import matrix as MX
from cytolake.operators import models as ML
from cytolake.operators import selection as SE
from cytolake.plans import cross_validation as CV
from cytolake.runtime import cut, shared_dir
from workloads import inputs as I
from workloads.registry import FM, SCORED, fresh_path, query, r6, rounded


def labelled(spark, sf):
    return I.feature_matrix(spark, sf).join(I.sample_labels(spark, sf), "slide_id")


def scored_long(spark, sf):
    """Event values as one labelled feature per fold."""
    return I.scored_events(spark, sf).select(
        "slide_id", F.concat(F.lit("fold"), "fold").alias("feature"), "label", F.col("score").alias("value")
    )


_LONG = f"{SCORED}, long as (select slide_id, 'fold' || fold as feature, label, score as value from scored)"

# --- matrix -----------------------------------------------------------------------------------

_MEANS = "select feature, count(*) as n, round(avg(value), 6) as mean from fm where {keep} group by feature"


def _means(fm):
    return rounded(fm.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


def _ranking(spark, sf):
    """Positions of the embedding in falling order of their name stand for a stored ranking."""
    names = I.table(spark, sf, "embeddings").select(F.explode(F.sequence(F.lit(1), F.size("embedding"))).alias("i")).distinct()
    return names.select(F.format_string("f%02d", F.col("i") - 1).alias("feature"), (65 - F.col("i")).alias("rank"))


@query("prj7_project_features", f"with {FM} {_MEANS.format(keep='cast(feature[2:] as int) % 3 = 1')}")
def project(spark, sf):
    chosen = _ranking(spark, sf).where((64 - F.col("rank")) % 3 == 1)
    return _means(MX.project_features(I.feature_matrix(spark, sf), chosen))


@query("prj8_topk_predefined", f"with {FM} {_MEANS.format(keep='64 - cast(feature[2:] as int) <= 19')}")
def topk(spark, sf):
    return _means(MX.topk_predefined(I.feature_matrix(spark, sf), _ranking(spark, sf), 19))


@query("prj12_require_both", "select count(*) filter (label % 2 = 0) as n0, count(*) filter (label % 2 = 1) as n1 from embeddings")
def both_classes(spark, sf):
    return MX.require_both_classes(I.sample_labels(spark, sf))


@query(
    "prj13_trim_outliers",
    f"""with {_LONG}, q as (select feature, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from long group by feature)
    select slide_id, feature, label, round(value, 6) as value from long join q using (feature) where value > lo and value < hi""",
)
def trimmed(spark, sf):
    return rounded(MX.trim_outliers(scored_long(spark, sf), 0.1), "value")


@query(
    "prj13_trim_by_class0",
    f"""with {_LONG}, q as (select feature, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from long where label = 0 group by feature)
    select slide_id, feature, label, round(value, 6) as value from long join q using (feature) where value > lo and value < hi""",
)
def trimmed_by_zero(spark, sf):
    return rounded(MX.trim_outliers(scored_long(spark, sf), 0.1, reference_label=0), "value")


@query("prj14_convert_unit", "select event_id, round(value * 0.053, 6) as area from events")
def converted(spark, sf):
    return I.table(spark, sf, "events").select("event_id", r6(MX.convert_unit(F.col("value"))).alias("area"))


@query("prj15_binarize", "select event_id, cast(value > 50 as integer) as pred from events")
def binarized(spark, sf):
    return I.table(spark, sf, "events").select("event_id", E.binarize(F.col("value"), 50.0).alias("pred"))


@query("prj19_grade_name", "select p_partkey, ['-', '+', '++/+++'][p_size % 4 + 1] as grade from part")
def grades(spark, sf):
    return I.table(spark, sf, "part").select("p_partkey", DS.grade_name(F.col("p_size") % 4).alias("grade"))


@query(
    "agg24_correlation",
    f"with {FM} select a.feature as feature_a, b.feature as feature_b, round(corr(a.value, b.value), 6) + 0.0 as r from fm a join fm b using (slide_id) group by all",
)
def correlation(spark, sf):
    return rounded(MX.correlations(I.feature_matrix(spark, sf)), "r")


@query("top1_sample_order", "select p_name as slide_id, row_number() over (order by p_name) - 1 as sample_ord from (select distinct p_name from part)")
def sample_order(spark, sf):
    return MX.sample_order(I.table(spark, sf, "part").select(F.col("p_name").alias("slide_id")))


@query(
    "top4_closest_sized",
    """with l as (select doc_id, len(string_split(text, ' ')) as n from documents)
    select doc_id as pos, cast(n as integer) as n from l order by abs(n - 120), doc_id limit 1""",
)
def closest(spark, sf):
    docs = I.table(spark, sf, "documents")
    lists = docs.select(F.col("doc_id").alias("pos"), F.split("text", " ").alias("items"))
    return MX.closest_sized(lists, 120).select("pos", F.size("items").alias("n"))


@query(
    "top5_random_holdout",
    """with h as (select vec_id, md5('7:' || vec_id) as d, count(*) over () as n from embeddings),
    p as (select vec_id, n, row_number() over (order by d[1:13], vec_id) as pos from h)
    select vec_id as slide_id, pos, pos <= n * 15 // 100 as held_out from p""",
)
def holdout(spark, sf):
    return MX.random_holdout(I.sample_labels(spark, sf), 15.0, seed=7)


# --- folds ------------------------------------------------------------------------------------


@query(
    "win6_stratified_folds",
    """with s as (select event_id as slide_id, event_type as label, event_id as ord from events),
    k as (select label, min(ord) as f, count(*) as n from s group by label),
    o as (select label, coalesce(sum(n) over (order by f rows between unbounded preceding and 1 preceding), 0) as start, n from k),
    q as (select label, fold, count(*) as quota from (select label, unnest(range(cast(start as bigint), cast(start + n as bigint))) % 3 as fold from o) group by all),
    u as (select label, fold, sum(quota) over (partition by label order by fold) as upto, quota from q),
    j as (select *, row_number() over (partition by label order by ord) as j from s)
    select slide_id, label, ord as sample_ord, cast(fold as integer) as fold from j join u using (label) where j <= upto and j > upto - quota""",
)
def stratified(spark, sf):
    samples = I.table(spark, sf, "events").select(
        F.col("event_id").alias("slide_id"), F.col("event_type").alias("label"), F.col("event_id").alias("sample_ord")
    )
    return FO.stratified_folds(samples, 3)


@query("win7_leave_one_group_out", "select vec_id as slide_id, label // 2 as cohort_id, cast(dense_rank() over (order by label // 2) - 1 as integer) as fold from embeddings")
def leave_one_out(spark, sf):
    return FO.leave_one_group_out(I.sample_labels(spark, sf))


# --- selection --------------------------------------------------------------------------------

_F = f"""with {FM}, g as (select feature, label, count(*) as n, avg(value) as m, var_pop(value) as v from fm group by all),
t as (select *, sum(n * m) over w / sum(n) over w as grand from g window w as (partition by feature))
select feature, round((sum(n * pow(m - grand, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) as f_stat from t group by feature"""


@query("fs1_anova_f", _F)
def anova(spark, sf):
    return rounded(SE.anova_f(labelled(spark, sf)), "f_stat")


@query("fs1_mrmr_ranking")
def mrmr(spark, sf):
    return rounded(SE.mrmr_ranking(labelled(spark, sf), 10), "score")


_MWU = """r as (select feature, label, value, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as r,
  count(*) over (partition by feature, value) as t from {src}),
s as (select feature, count(*) filter (label = 0) as n0, count(*) filter (label = 1) as n1, sum(r) filter (label = 0) as r0,
  sum(cast(t * t - 1 as double)) as ties from r group by feature),
u as (select *, r0 - n0 * (n0 + 1) / 2.0 as u, cast(n0 + n1 as double) as n from s)
select feature, n0, n1, cast(u as double) as u, round((greatest(u, n0 * n1 - u) - n0 * n1 / 2.0 - 0.5) / sqrt(n0 * n1 / 12.0 * (n + 1 - ties / (n * (n - 1)))), 6) as z from u"""


@query("fs2_mann_whitney", f"with {FM}, {_MWU.format(src='fm')}")
def mann_whitney(spark, sf):
    return rounded(SE.mann_whitney(labelled(spark, sf), with_p=False), "z")


@query("win5_mann_whitney_ties", f"with {_LONG}, {_MWU.format(src='long')}")
def mann_whitney_ties(spark, sf):
    return rounded(SE.mann_whitney(scored_long(spark, sf), with_p=False), "z")


@query("top2_best_by_p")
def best_by_p(spark, sf):
    return rounded(SE.best_by_p(SE.mann_whitney(labelled(spark, sf)), 10), "p", "z")


@query(
    "top2_best_by_z",
    f"with {FM}, {_MWU.format(src='fm')} order by z desc, feature limit 10",
)
def best_by_z(spark, sf):
    """The same selection checked by z, which orders features as the normal p-value does."""
    tests = SE.mann_whitney(labelled(spark, sf))
    return rounded(SE.best_by_p(tests, 10).drop("p", "rank"), "z")


@query("fs3_boruta")
def boruta(spark, sf):
    """With the depth and the seed that the published scripts set, and as many trees as let every column be tried."""
    return SE.boruta(labelled(spark, sf).drop("cohort_id"), max_depth=1, trees=None, seed=0)


@query(
    "fs4_correlated_pairs",
    f"""with {FM}, c as (select a.feature as feature_a, b.feature as feature_b, corr(a.value, b.value) as r from fm a join fm b using (slide_id) group by all)
    select feature_a, feature_b, round(r, 6) + 0.0 as r from c where feature_a < feature_b and abs(r) > 0.12""",
)
def correlated_pairs(spark, sf):
    return rounded(SE.correlated_pairs(MX.correlations(I.feature_matrix(spark, sf)), 0.12), "r")


@query(
    "fs4_correlation_groups",
    f"""with recursive {FM}, c as (select a.feature as u, b.feature as v from fm a join fm b using (slide_id) group by all having abs(corr(a.value, b.value)) > 0.12 or a.feature = b.feature),
    reach as (select u, v from c union select reach.u, c.v from reach join c on reach.v = c.u)
    select u as feature, min(v) as representative from reach group by u""",
)
def correlation_groups(spark, sf):
    return SE.correlation_groups(cut(MX.correlations(I.feature_matrix(spark, sf))), 0.12)


_SCAN = [0.08, 0.1, 0.12, 0.14]


@query(
    "fs4_threshold_scan",
    f"""with recursive {FM}, t as (select unnest({_SCAN}::double[]) as threshold),
    c as (select a.feature as u, b.feature as v, abs(corr(a.value, b.value)) as r from fm a join fm b using (slide_id) group by all),
    e as (select threshold, u, v from c, t where r > threshold or u = v),
    reach as (select threshold, u, v from e union select reach.threshold, reach.u, e.v from reach join e on reach.v = e.u and reach.threshold = e.threshold)
    select distinct threshold, min(v) over (partition by threshold, u) as feature from reach""",
)
def threshold_scan(spark, sf):
    """Representatives of the correlation groups at each threshold."""
    found = SE.threshold_scan(MX.correlations(I.feature_matrix(spark, sf)), _SCAN)
    parts = [df.select(F.lit(t).alias("threshold"), "feature") for t, df in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_HEIGHTS = [0.5 * i for i in range(1, 10)]


def _feature_distances(spark, sf, absolute=False):
    return LK.correlation_distances(cut(MX.correlations(I.feature_matrix(spark, sf))), absolute)


@query("fs4_linkage_merges")
def linkage_merges(spark, sf):
    """Every merge of the average linkage on 1 - |r|."""
    return rounded(LK.merge_table(_feature_distances(spark, sf, True), "average"), "height")


@query("fs4_complete_clusters")
def complete_clusters(spark, sf):
    """Clusters of the complete linkage on 1 - |r|, cut at 0.9."""
    distances = cut(_feature_distances(spark, sf, True))
    return LK.clusters(distances.select(F.col("a").alias("feature")), LK.merge_table(distances, "complete"), 0.9)


@query("fs4_ward_representatives")
def ward_representatives(spark, sf):
    """Representatives of the Ward clusters on 1 - r at heights 0.5 to 4.5."""
    distances = cut(_feature_distances(spark, sf))
    return LK.representatives(distances.select(F.col("a").alias("feature")), LK.merge_table(distances, "ward"), _HEIGHTS)


# --- scores -----------------------------------------------------------------------------------


@query(
    "agg25_balanced_accuracy",
    "with r as (select quality, avg(case when quality = toxic then 1.0 else 0.0 end) as recall from labels group by quality) select round(avg(recall), 6) as balanced_accuracy from r",
)
def balanced(spark, sf):
    pred = I.table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"))
    return rounded(E.balanced_accuracy(pred), "balanced_accuracy")


@query("agg26_accuracy", f"with {SCORED} select fold, round(avg(case when label = cast(score > 50 as int) then 1.0 else 0.0 end), 6) as accuracy from scored group by fold")
def accuracy(spark, sf):
    pred = I.scored_events(spark, sf).withColumn("pred", E.binarize(F.col("score"), 50.0))
    return rounded(E.accuracy(pred, ["fold"]), "accuracy")


# scores of a sweep: fold and feature count from the customer key, the account balance as score
_SWEEP = "sweep as (select c_custkey % 3 as fold, c_nationkey + 1 as k, c_acctbal as score from customer)"
# a fold whose feature counts start later: counts below 6 and above 25 are not common
_UNEVEN = "sweep as (select c_custkey % 3 as fold, c_nationkey + 1 + case when c_custkey % 3 = 2 then 5 else 0 end as k, c_acctbal as score from customer)"


def _sweep(spark, sf):
    c = I.table(spark, sf, "customer")
    return c.select((F.col("c_custkey") % 3).alias("fold"), (F.col("c_nationkey") + 1).alias("k"), F.col("c_acctbal").alias("score"))


def _uneven(spark, sf):
    shift = F.when(F.col("fold") == 2, 5).otherwise(0)
    return _sweep(spark, sf).withColumn("k", F.col("k") + shift)


_BY_K = "select k, round(avg(score), 6) as mean, min(score) as min, max(score) as max, round(stddev_pop(score), 6) as std from {src} group by k"


@query("agg27_score_by_count", f"with {_SWEEP} {_BY_K.format(src='sweep')}")
def by_count(spark, sf):
    return rounded(E.score_by_count(_sweep(spark, sf)), "mean", "std")


@query(
    "cv2_common_counts",
    f"with {_UNEVEN}, ok as (select k from sweep group by k having count(distinct fold) = (select count(distinct fold) from sweep)), s as (select * from sweep where k in (select k from ok)) {_BY_K.format(src='s')}",
)
def common(spark, sf):
    return rounded(E.score_by_count(E.common_counts(_uneven(spark, sf))), "mean", "std")


@query("top3_best_count", f"with {_SWEEP}, b as ({_BY_K.format(src='sweep')}) select * from b order by mean desc, k desc limit 1")
def best_count(spark, sf):
    return rounded(E.best_count(E.score_by_count(_sweep(spark, sf))), "mean", "std")


@query(
    "agg28_consensus_ranking",
    """with r as (select p_brand as feature, row_number() over (partition by p_size order by p_partkey) as rank from part)
    select feature, count(*) as count, round(log10(sum(pow(10.0, 12 + 1 - rank))), 6) as score from r where rank <= 12 group by feature""",
)
def consensus(spark, sf):
    parts = I.table(spark, sf, "part").select("p_size", "p_partkey", F.col("p_brand").alias("feature"))
    return rounded(E.consensus_ranking(positions(parts, ["p_size"], "p_partkey", "rank"), 12), "score")


@query(
    "top6_final_features",
    """with r as (select p_brand as feature, row_number() over (partition by p_size order by p_partkey) as rank from part),
    c as (select feature, count(*) as count, log10(sum(pow(10.0, 12 + 1 - rank))) as score from r where rank <= 12 group by feature)
    select cast(row_number() over (order by count desc, score desc, feature) as integer) as position, feature, count, round(score, 6) as score
    from c qualify position <= 10""",
)
def final_features(spark, sf):
    parts = I.table(spark, sf, "part").select("p_size", "p_partkey", F.col("p_brand").alias("feature"))
    return rounded(CV.final_features(positions(parts, ["p_size"], "p_partkey", "rank"), 12, 10), "score")


_ROC = f"""with {SCORED}, st as (select fold, score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from scored group by all),
cum as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by fold) as p, sum(neg) over (partition by fold) as n
  from st window w as (partition by fold order by score desc rows unbounded preceding)),
pts as (select fold, score, (fp - neg) / n as f0, (tp - pos) / p as t0, fp / n as f1, tp / p as t1 from cum)"""


@query("agg29_roc_points", f"{_ROC} select fold, score as threshold, round(f1, 6) as fpr, round(t1, 6) as tpr from pts")
def roc(spark, sf):
    pts = E.roc_points(I.scored_events(spark, sf))
    return rounded(pts.select("fold", "threshold", "fpr", "tpr"), "fpr", "tpr")


@query("agg29_roc_auc", f"{_ROC} select fold, round(sum((f1 - f0) * (t1 + t0) / 2), 6) as auc from pts group by fold")
def auc(spark, sf):
    return rounded(E.roc_auc(E.roc_points(I.scored_events(spark, sf))), "auc")


@query(
    "agg30_mean_roc",
    f"""{_ROC}, grid as (select cast(i as integer) as i, i / 99.0 as x from range(100) t(i)),
    spots as (select fold, i, case when i = 0 then 0.0 when i = 99 then 1.0 else t0 + (t1 - t0) / (f1 - f0) * (x - f0) end as y
      from pts, grid where f1 > f0 and ((round(f0 * 99, 9) <= i and i < round(f1 * 99, 9)) or (i = 99 and f1 = 1)))
    select round(i / 99.0, 6) as fpr, round(avg(y), 6) as mean_tpr, round(greatest(avg(y) - stddev_pop(y), 0), 6) as low,
    round(least(avg(y) + stddev_pop(y), 1), 6) as high from spots group by i""",
)
def mean_roc(spark, sf):
    curve = E.mean_roc(E.roc_points(I.scored_events(spark, sf)))
    return rounded(curve, "fpr", "mean_tpr", "low", "high")


# --- description ------------------------------------------------------------------------------


@query(
    "agg31_box_stats",
    f"""with {_LONG}, q as (select feature, label, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from long group by all)
    select feature, label, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
    min(value) filter (value >= q1 - 1.5 * (q3 - q1)) as low_whisker, max(value) filter (value <= q3 + 1.5 * (q3 - q1)) as high_whisker,
    count(*) filter (value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as n_outliers
    from long join q using (feature, label) group by feature, label, q1, median, q3""",
)
def boxes(spark, sf):
    return rounded(DS.box_stats(scored_long(spark, sf)), "q1", "median", "q3")


@query(
    "agg32_t_statistic",
    f"""with {FM}, s as (select feature, count(*) filter (label = 0) as n0, count(*) filter (label = 1) as n1, avg(value) filter (label = 0) as m0,
      avg(value) filter (label = 1) as m1, var_pop(value) filter (label = 0) as v0, var_pop(value) filter (label = 1) as v1 from fm group by feature)
    select feature, round((m0 - m1) / sqrt((n0 * v0 + n1 * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 6) + 0.0 as t, n0 + n1 - 2 as df from s""",
)
def t_statistic(spark, sf):
    return rounded(DS.t_test(labelled(spark, sf), with_p=False), "t")


@query("agg32_t_test")
def t_test(spark, sf):
    return rounded(DS.t_test(labelled(spark, sf)), "t", "p")


@query(
    "agg33_density_curve",
    f"""with {_LONG}, p as (select feature, label, count(*) as n, stddev_samp(value) * pow(count(*), -0.2) as h from long group by all),
    b as (select feature, min(value) as lo, max(value) as hi from long group by feature),
    g as (select feature, label, n, h, i, lo + (hi - lo) * i / 49.0 as x from p join b using (feature), range(50) t(i))
    select g.feature, g.label, cast(i as integer) as i, round(x, 6) as x, round(sum(exp(-0.5 * pow((x - value) / h, 2))) / (n * h * sqrt(2 * pi())), 6) as density
    from g join long on g.feature = long.feature and g.label = long.label group by g.feature, g.label, i, x, n, h""",
)
def density(spark, sf):
    return rounded(DS.density_curve(scored_long(spark, sf)), "x", "density")


# --- models -----------------------------------------------------------------------------------


def _rows(spark, sf):
    fm = I.feature_matrix(spark, sf)
    vectors = MX.to_vectors(fm, MX.feature_names(fm))
    return ML.training_rows(vectors, I.sample_labels(spark, sf))


def _held_out(spark, sf):
    """Training rows with weights of their own, and the rows of the last of three folds."""
    fm, labels = I.feature_matrix(spark, sf), I.sample_labels(spark, sf)
    folds = FO.stratified_folds(labels.select("slide_id", "label", F.col("slide_id").alias("sample_ord")), 3)
    vectors = cut(MX.to_vectors(fm, MX.feature_names(fm)).join(folds.select("slide_id", "fold"), "slide_id"))
    last = vectors.agg(F.max("fold")).first()[0]
    train = cut(ML.training_rows(vectors.where(F.col("fold") != last), labels))
    return train, vectors.where(F.col("fold") == last).join(labels.select("slide_id", "label"), "slide_id")


def _scores(spark, sf, *models):
    """Accuracy and balanced accuracy on rows no model was fitted on."""
    train, test = _held_out(spark, sf)
    out = None
    for model in models:
        scored = cut(ML.predict(ML.fit(train, model), test))
        row = E.accuracy(scored).crossJoin(E.balanced_accuracy(scored)).select(  # one row each
            F.lit(model).alias("model"), r6("accuracy").alias("accuracy"), r6("balanced_accuracy").alias("balanced_accuracy")
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("ml1_boosted_trees")
def boosted(spark, sf):
    return _scores(spark, sf, "boosted_trees")


@query("ml2_linear_and_forest")
def simple_models(spark, sf):
    return _scores(spark, sf, "logistic", "forest", "ridge")


@query("ml3_grid_search")
def grid(spark, sf):
    """Inverse penalties of the logistic model by three folds, on the training rows."""
    train, _ = _held_out(spark, sf)
    n, strengths = train.count(), [0.01, 0.1, 1.0, 10.0]
    found = ML.grid_search(train, "logistic", {"regParam": [1.0 / (c * n) for c in strengths]})
    return spark.createDataFrame([(c, float(m)) for c, m in zip(strengths, found.avgMetrics)], "c double, score double")


@query("ml4_saved_model_inference")
def inference(spark, sf):
    """Fit, store, load, then score every sample."""
    rows = cut(_rows(spark, sf))
    path = fresh_path(shared_dir(spark), "model")
    ML.save(ML.fit(rows, "logistic"), path)
    return ML.predict(ML.load(path), rows).select("slide_id", "label", "pred", r6("proba").alias("proba"))


@query("ml4_model_selection_table")
def model_selection_table(spark, sf):
    """Three models on all features and on those that three selections keep; accuracies on a fold no step has seen."""
    fm, labels = I.feature_matrix(spark, sf), I.sample_labels(spark, sf)
    folds = FO.stratified_folds(labels.select("slide_id", "label", F.col("slide_id").alias("sample_ord")), 3)
    rows = cut(fm.join(labels.select("slide_id", "label"), "slide_id").join(folds.select("slide_id", "fold"), "slide_id"))
    train, test = (rows.where(c).drop("fold") for c in ("fold <> 2", "fold = 2"))
    ranked = {"mann_whitney": CV.mann_whitney, "mrmr": CV.mrmr, "ward": CV.group_ranker("ward")}
    chosen = {name: [r["feature"] for r in rank(train, 19).orderBy("rank").collect()] for name, rank in ranked.items()}
    table = CV.model_table(train, test, {"all": MX.feature_names(fm), **chosen}, ["logistic", "ridge", "forest"])
    return rounded(table, "accuracy", "balanced_accuracy")


@query("ml5_principal_components")
def components(spark, sf):
    projected, shares = ML.principal_components(_rows(spark, sf).select("slide_id", "features"), 3)
    parts = projected.select("slide_id", vector_to_array("pca").alias("v"))
    return parts.select("slide_id", *[F.round(F.abs(F.col("v")[i]), 4).alias(f"pc{i + 1}") for i in range(3)], F.lit(round(shares[0], 6)).alias("share1"))


def _ranked_sweep(spark, sf, ranker):
    """(scores, rankings) of a logistic sweep over 3 folds for every count of features."""
    fm, labels = I.feature_matrix(spark, sf), I.sample_labels(spark, sf)
    folds = FO.stratified_folds(labels.select("slide_id", "label", F.col("slide_id").alias("sample_ord")), 3)
    every = len(MX.feature_names(fm))
    return (*CV.sweep(fm, labels, cut(folds), ranker, "logistic", range(1, every + 1)), every)


@query("cv1_sweep")
def sweep(spark, sf):
    """Mann-Whitney ranking and logistic regression over 3 folds for every count of features; the written report."""
    scores, rankings, every = _ranked_sweep(spark, sf, CV.mann_whitney)
    path = fresh_path(shared_dir(spark), "report")
    CV.write_report(scores, rankings, every, path)
    kinds = "feature string, count bigint, score double, best_k int, best_mean double, all_mean double"
    return rounded(spark.read.schema(kinds).json(path), "score", "best_mean", "all_mean")


@query("cv1_sweep_mrmr")
def sweep_mrmr(spark, sf):
    """Scores by fold and count of features, ranked by relevance over redundancy."""
    return rounded(_ranked_sweep(spark, sf, CV.mrmr)[0], "score")


@query("cv1_sweep_groups")
def sweep_groups(spark, sf):
    """Scores by fold and count of features, ranked by how long they stand for their Ward cluster."""
    return rounded(_ranked_sweep(spark, sf, CV.group_ranker("ward"))[0], "score")


@query("cv1_sweep_boruta")
def sweep_boruta(spark, sf):
    """One score per fold: the model on all features that Boruta confirms on the other folds; no row for a fold without any."""
    scores, rankings, _ = _ranked_sweep(spark, sf, CV.boruta_ranker(rounds=100, max_depth=1, trees=None, seed=0))
    last = rankings.groupBy("fold").agg(F.max("rank").alias("k"))
    return rounded(scores.join(last, ["fold", "k"]), "score")
