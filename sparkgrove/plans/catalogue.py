"""Queries over the ``embeddings`` table, which stands in for a feature table, and their
DuckDB twins. Test rows are those whose id is divisible by five."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tidy, to_long, width_of
from ..operators import analysis, approximate, boosting, cells, classify, clustering, evaluate, folds, impute, margin, mixture, neighbours, regress, scaling, spatial, survival
from ..sources.features import read_features

K_FOLDS, NEIGHBOURS, CLASSES = 5, 5, 10
Query = Callable[[SparkSession, str], DataFrame]


def features(spark: SparkSession, sf_dir: str, check: bool = False) -> DataFrame:
    return read_features(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding", "label", check)


def split(feat: DataFrame) -> tuple[DataFrame, DataFrame]:
    return feat.where("entity_id % 5 != 0"), feat.where("entity_id % 5 = 0")


def planted(feat: DataFrame) -> DataFrame:
    """``feat`` with 3.0 added to the element that each row's label numbers: a table whose
    classes any classifier or clustering that works tells apart."""
    return feat.withColumn("features", F.transform("features", lambda x, i: x + F.when(i == F.col("label"), 3.0).otherwise(0.0)))


def plane(feat: DataFrame) -> DataFrame:
    """``feat`` with the first two features only, whose principal axes have a closed form."""
    return feat.withColumn("features", F.slice("features", 1, 2))


def _feat(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(features(spark, sf_dir))


def _long(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(to_long(features(spark, sf_dir)))


def _split(make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(*split(features(spark, sf_dir)))


def p1_read_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    feat = features(spark, sf_dir, check=True)
    return feat.select("entity_id", F.size("features").alias("width"), "label")


def p7_zscore(feat: DataFrame) -> DataFrame:
    return to_long(scaling.zscore(feat)).select("entity_id", "pos", tidy(F.col("v")).alias("z"))


def p10_cluster_by_class(feat: DataFrame) -> DataFrame:
    """The nearest class mean of each row serves as its cluster."""
    clusters = classify.nearest_centroid(feat, feat).select("entity_id", F.col("predicted").alias("cluster"))
    return clustering.cluster_by_class(clusters, feat)


def p8_pca_plane(feat: DataFrame) -> DataFrame:
    """Squares of both components: an axis may point either way."""
    return clustering.pca(plane(feat), 2).select("entity_id", *[tidy(F.col("pc")[i] * F.col("pc")[i]).alias(f"square{i + 1}") for i in range(2)])


def p8_pca_norms(feat: DataFrame) -> DataFrame:
    """All components together keep every row's distance from the mean, and have no
    covariance; the mean is taken off here, since projection keeps it."""
    pc = to_long(clustering.pca(feat, width_of(feat)).withColumnRenamed("pc", "features"))
    centred = pc.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("pos")))
    return centred.groupBy("entity_id").agg(tidy(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def p8_pca_covariance(feat: DataFrame) -> DataFrame:
    """Covariance of each two of the first three components."""
    pc = clustering.pca(feat, 3)
    found = [F.covar_samp(F.col("pc")[i], F.col("pc")[j]).alias(f"c{i + 1}{j + 1}") for i, j in ((0, 1), (0, 2), (1, 2))]
    return pc.agg(*found).select(*[tidy(F.col(c)).alias(c) for c in ("c12", "c13", "c23")])


def p9_kmeans_planted(feat: DataFrame) -> DataFrame:
    """Clusters of the planted table by the class they hold: label, n, share."""
    feat = planted(feat)
    return clustering.cluster_by_class(clustering.kmeans(feat, CLASSES), feat).select("label", "n", "share")


def p9_silhouette(feat: DataFrame) -> DataFrame:
    feat = planted(feat)
    value = clustering.silhouette(feat, clustering.kmeans(feat, CLASSES))
    return feat.sparkSession.createDataFrame([(value,)], "silhouette double").select(tidy(F.col("silhouette")).alias("silhouette"))


def _planted_scores(classifier: Callable[[DataFrame, DataFrame], DataFrame], places: int) -> Query:
    """Test rows of the planted table by label: n and accuracy, to so many places."""

    def make(feat: DataFrame) -> DataFrame:
        right = (F.col("label") == F.col("predicted")).cast("double")
        return classifier(*split(planted(feat))).agg(F.count(F.lit(1)).alias("n"), tidy(F.avg(right), places).alias("accuracy"))

    return _feat(make)


def p15_logistic_confusion(feat: DataFrame) -> DataFrame:
    """label, predicted, n of the planted table's test rows, and how many of them have
    probabilities that add up to 1, with the greatest for the class predicted."""
    total = F.aggregate("prob", F.lit(0.0), lambda s, p: s + p)
    fit = (F.abs(total - 1) < 1e-9) & (F.array_position("prob", F.array_max("prob")) == F.col("predicted") + 1)
    made = classify.logistic(*split(planted(feat)), reg=0.01)
    return made.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"), F.sum(fit.cast("long")).alias("n_fit"))


def p19_forest_top(feat: DataFrame) -> DataFrame:
    """The features most important to a forest on the planted table, as many as classes."""
    importance = classify.forest_importance(planted(feat))
    return importance.orderBy(F.col("importance").desc(), "pos").limit(CLASSES).select("pos")


def in_groups(feat: DataFrame) -> DataFrame:
    """entity_id, group: groups of 1, 3, 5, ... entities with consecutive ids, then of 64."""
    return feat.select("entity_id", F.expr("CASE WHEN entity_id < 1024 THEN floor(sqrt(entity_id)) ELSE 16 + entity_id div 64 END").cast("long").alias("group"))


def p20_grouped_folds(feat: DataFrame) -> DataFrame:
    return folds.grouped_folds(feat, in_groups(feat), K_FOLDS)


def p20_grouped_validation(feat: DataFrame) -> DataFrame:
    return evaluate.cross_validate(feat, K_FOLDS, classify.nearest_centroid, groups=in_groups(feat))


def hidden(feat: DataFrame) -> DataFrame:
    """``feat`` without about a fifth of its elements, by md5 of id and position."""
    mark = lambda i: F.substring(F.md5(F.concat_ws(":", F.col("entity_id"), i)), 1, 1)
    return feat.withColumn("features", F.transform("features", lambda x, i: F.when(mark(i) >= "3", x)))


def _p21_fill(fill: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """Test rows, filled from training rows."""

    def make(feat: DataFrame) -> DataFrame:
        train, test = split(hidden(feat))
        return to_long(fill(test, train)).select("entity_id", "pos", tidy(F.col("v")).alias("v"))

    return _feat(make)


def p21_fill_error(feat: DataFrame) -> DataFrame:
    """Error of both fillings on the planted table, whose rows have neighbours."""
    feat = planted(feat)
    train, test = split(hidden(feat))
    made = None
    for name, fill in (("mean", impute.mean_fill), ("neighbours", impute.neighbour_fill)):
        one = impute.fill_error(fill(test, train), test, feat).select(F.lit(name).alias("method"), "n", tidy(F.col("rmse"), 4).alias("rmse"))
        made = one if made is None else made.unionByName(one)
    return made


def followed(feat: DataFrame) -> DataFrame:
    """label, time, event of each row: times with many ties, about a third of them censored."""
    first, second = F.col("features")[0], F.col("features")[1]
    return feat.select("label", F.floor(F.abs(first) * 100).cast("double").alias("time"), (second > -0.05).alias("event"))


def p22_survival_curve(feat: DataFrame) -> DataFrame:
    curve = survival.kaplan_meier(followed(feat))
    return curve.withColumns({c: tidy(F.col(c)) for c in ("survival", "std_err")})


def p22_logrank(feat: DataFrame) -> DataFrame:
    return survival.logrank(followed(feat)).withColumns({c: tidy(F.col(c)) for c in ("expected", "variance")})


def p22_logrank_test(feat: DataFrame) -> DataFrame:
    """Of two classes, whose statistic has a closed form."""
    found = survival.logrank_test(followed(feat).where("label IN (0, 1)"))
    return found.select(tidy(F.col("statistic")).alias("statistic"), "degrees")


DECILES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def observations(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    """Order lines as finer observations: of suppliers, or of the three states of return."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(f"{entity} AS entity_id", "l_returnflag AS kind", "l_extendedprice AS value")


def p23_cell_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cells.cell_features(observations(spark, sf_dir, "l_suppkey"))
    return made.select(*[tidy(F.col(c), 4).alias(c) if kind == "double" else F.col(c) for c, kind in made.dtypes])


def p23_cell_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three entities that hold all rows between them."""
    found = cells.quantiles(observations(spark, sf_dir, "l_returnflag"), DECILES)
    return found.select("entity_id", F.posexplode("quantiles").alias("i", "q")).select("entity_id", "i", tidy(F.col("q")).alias("q"))


RADIUS = 2.5


def placed(feat: DataFrame) -> DataFrame:
    """The first two features as places in the plane, of a tenth of a unit, with the label as kind."""
    x, y = (F.round(F.col("features")[i] * 100, 1) for i in range(2))
    return feat.select("entity_id", x.alias("x"), y.alias("y"), F.col("label").alias("kind"))


def p24_neighbourhoods(feat: DataFrame) -> DataFrame:
    return spatial.neighbourhoods(placed(feat), RADIUS).withColumn("entropy", tidy(F.col("entropy")))


RIDGE = 0.01


def p25_ridge(feat: DataFrame) -> DataFrame:
    """The first feature from the two after it, each fold by the model of the others."""
    folded = folds.with_folds(feat.withColumn("features", F.slice("features", 1, 3)), K_FOLDS)
    return regress.out_of_fold(folded, 0, RIDGE).withColumns({c: tidy(F.col(c)) for c in ("v", "predicted")})


def p26_mixture_planted(feat: DataFrame) -> DataFrame:
    """Components of the planted table by the class they hold: label, n, share."""
    feat = planted(feat)
    found = mixture.responsibilities(feat, mixture.gaussian_mixture(feat, CLASSES))
    return clustering.cluster_by_class(found.select("entity_id", "cluster"), feat).select("label", "n", "share")


def p26_mixture_components(feat: DataFrame) -> DataFrame:
    """Parameters of the planted table's components, named by the element that is planted."""
    made = mixture.components(feat.sparkSession, mixture.gaussian_mixture(planted(feat), CLASSES))
    label = made.groupBy("component").agg(F.max_by("pos", "mean").alias("label"))
    return made.join(label, "component").select("label", "pos", *[tidy(F.col(c)).alias(c) for c in ("weight", "mean", "variance")])


def p27_approximate(feat: DataFrame) -> DataFrame:
    """Neighbours of the planted table's test rows."""
    train, test = split(planted(feat))
    return approximate.approximate(test, train, NEIGHBOURS).withColumn("near", tidy(F.col("near")))


def p27_recall(feat: DataFrame) -> DataFrame:
    """Of the exact neighbours of the planted table's test rows, the share found."""
    train, test = split(planted(feat))
    exact = neighbours.nearest(test, train, NEIGHBOURS, neighbours.cosine)
    return approximate.recall(approximate.approximate(test, train, NEIGHBOURS), exact).withColumn("recall", tidy(F.col("recall"), 4))


def p28_svm_slope(feat: DataFrame) -> DataFrame:
    """The first subgradient: label, pos (0: intercept), slope. All rows lie within the margin."""
    rows, planes, n = margin.start(feat)
    _, slope = margin.subgradient(rows, planes, n, margin.REG)
    found = [(int(label), pos, float(v)) for label, own in zip(planes.labels, slope) for pos, v in enumerate(own)]
    made = feat.sparkSession.createDataFrame(found, "label int, pos int, slope double")
    return made.withColumn("slope", tidy(F.col("slope")))


def p28_svm_confusion(feat: DataFrame) -> DataFrame:
    return evaluate.confusion(margin.linear_svm(*split(planted(feat))))


def p29_first_splits(feat: DataFrame) -> DataFrame:
    """Roots of the first round's trees: label, pos, cut, gain."""
    rows, trees = boosting.start(feat)
    best = boosting.best_splits(rows, trees, boosting.no_tree(trees, 1), 0).collect()  # a row for each class
    found = [(int(trees.labels[r["class"]]), r.pos, float(trees.cuts[r.pos, r.bin]), r.gain) for r in best]
    made = feat.sparkSession.createDataFrame(found, "label int, pos int, cut double, gain double")
    return made.withColumns({c: tidy(F.col(c)) for c in ("cut", "gain")})


def p29_boosting_planted(feat: DataFrame) -> DataFrame:
    """n of the planted table's test rows, and whether 95 in a hundred go to their class."""
    made = boosting.boosted(*split(planted(feat)))
    right = F.avg((F.col("label") == F.col("predicted")).cast("double"))
    return made.agg(F.count(F.lit(1)).alias("n"), (right >= 0.95).alias("reached"))


def queries() -> dict[str, Query]:
    return {
        "p1_read_features": p1_read_features,
        "p2_to_long": _long(lambda long: long.withColumn("v", tidy(F.col("v")))),
        "p3_class_summary": _long(analysis.class_summary),
        "p4_feature_corr": _feat(analysis.feature_corr),
        "p5_welch_t": _long(lambda long: analysis.welch_t(long, 0, 1)),
        "p6_anova_f": _long(analysis.anova_f),
        "p7_zscore": _feat(p7_zscore),
        "p8_pca": _feat(lambda feat: clustering.pca(feat, 3)),
        "p8_explained_variance": _feat(lambda feat: clustering.explained_variance(feat, 3)),
        "p8_pca_plane": _feat(p8_pca_plane),
        "p8_plane_variance": _feat(lambda feat: clustering.explained_variance(plane(feat), 2).withColumn("share", tidy(F.col("share")))),
        "p8_pca_norms": _feat(p8_pca_norms),
        "p8_pca_covariance": _feat(p8_pca_covariance),
        "p9_kmeans": _feat(lambda feat: clustering.kmeans(feat, 10)),
        "p9_kmeans_planted": _feat(p9_kmeans_planted),
        "p9_silhouette": _feat(p9_silhouette),
        "p10_cluster_by_class": _feat(p10_cluster_by_class),
        "p11_stratified_folds": _feat(lambda feat: folds.stratified_folds(feat, K_FOLDS)),
        "p12_nearest_centroid": _split(classify.nearest_centroid),
        "p13_gaussian_nb": _split(classify.gaussian_nb),
        "p14_knn_classify": _split(lambda train, test: classify.knn_classify(train, test, NEIGHBOURS)),
        "p15_logistic": _split(lambda train, test: classify.logistic(train, test, reg=0.01)),
        "p15_logistic_planted": _planted_scores(lambda train, test: classify.logistic(train, test, reg=0.01), 6),
        "p15_logistic_confusion": _feat(p15_logistic_confusion),
        "p16_random_forest": _split(classify.random_forest),
        "p16_forest_planted": _planted_scores(classify.random_forest, 1),
        "p17_confusion": _split(lambda train, test: evaluate.confusion(classify.nearest_centroid(train, test))),
        "p17_class_scores": _split(lambda train, test: evaluate.class_scores(classify.nearest_centroid(train, test))),
        "p18_cross_validate": _feat(lambda feat: evaluate.cross_validate(feat, K_FOLDS, classify.nearest_centroid)),
        "p19_forest_top": _feat(p19_forest_top),
        "p19_rank_features": _long(lambda long: analysis.rank_features(long, 20)),
        "p20_grouped_folds": _feat(p20_grouped_folds),
        "p20_grouped_validation": _feat(p20_grouped_validation),
        "p28_svm_slope": _feat(p28_svm_slope),
        "p28_svm_confusion": _feat(p28_svm_confusion),
        "p29_first_splits": _feat(p29_first_splits),
        "p29_boosting_planted": _feat(p29_boosting_planted),
        "p27_approximate": _feat(p27_approximate),
        "p27_recall": _feat(p27_recall),
        "p26_mixture_planted": _feat(p26_mixture_planted),
        "p26_mixture_components": _feat(p26_mixture_components),
        "p25_ridge": _feat(p25_ridge),
        "p24_neighbour_kinds": _feat(lambda feat: spatial.neighbour_kinds(placed(feat), RADIUS)),
        "p24_neighbourhoods": _feat(p24_neighbourhoods),
        "p23_cell_features": p23_cell_features,
        "p23_cell_quantiles": p23_cell_quantiles,
        "p22_survival_curve": _feat(p22_survival_curve),
        "p22_logrank": _feat(p22_logrank),
        "p22_logrank_test": _feat(p22_logrank_test),
        "p21_mean_fill": _p21_fill(impute.mean_fill),
        "p21_neighbour_fill": _p21_fill(impute.neighbour_fill),
        "p21_fill_error": _feat(p21_fill_error),
    }


_LONG = "long AS (SELECT vec_id AS entity_id, label, generate_subscripts(embedding, 1)::INTEGER - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_F = f"""{_LONG},
g AS (SELECT pos, label, count(v) AS n, avg(v) AS m, coalesce(var_samp(v), 0) AS s2 FROM long GROUP BY ALL),
a AS (SELECT *, sum(n * m) OVER (PARTITION BY pos) / sum(n) OVER (PARTITION BY pos) AS g FROM g),
f AS (SELECT pos, round(sum(n * (m - g) * (m - g)) / (count(*) - 1) / (sum((n - 1) * s2) / (sum(n) - count(*))), 6) + 0.0e0 AS f FROM a GROUP BY pos)"""
_CENTROID = f"""{_LONG},
c AS (SELECT label AS k, pos, avg(v) AS m FROM long WHERE entity_id % 5 <> 0 GROUP BY ALL),
d AS (SELECT entity_id, label, k, sum((v - m) * (v - m)) AS d FROM long JOIN c USING (pos) WHERE entity_id % 5 = 0 GROUP BY ALL),
p AS (SELECT entity_id, any_value(label) AS label, arg_min(k, (d, k)) AS predicted FROM d GROUP BY entity_id)"""
_FOLDS = """folds AS (
  SELECT vec_id AS entity_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) - 1) % 5)::INTEGER AS fold FROM embeddings)"""


#: Groups one after another in a recursion whose state is the folds' entities by class.
_GROUPS = """member AS (
  SELECT vec_id AS entity_id, label, (CASE WHEN vec_id < 1024 THEN floor(sqrt(vec_id)) ELSE 16 + vec_id // 64 END)::BIGINT AS grp FROM embeddings),
cls AS (SELECT label, count(*) AS t, 1000000 * max(count(*)) OVER () * max(count(*)) OVER () // (count(*) * count(*)) AS w, row_number() OVER (ORDER BY label) AS place FROM embeddings GROUP BY label),
per AS (SELECT grp, label, count(*) AS n FROM member GROUP BY ALL),
kinds AS (SELECT grp, list((label, n) ORDER BY label) AS kind, sum(n)::BIGINT AS size, md5('g' || grp) AS mark FROM per GROUP BY grp),
alike AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY mark) AS i, min(mark) OVER (PARTITION BY kind) AS first FROM kinds),
lft AS (
  SELECT grp, first, row_number() OVER (ORDER BY size DESC, first, i) AS turn,
    (SELECT list(coalesce(n, 0)::HUGEINT ORDER BY place) FROM cls LEFT JOIN per ON per.label = cls.label AND per.grp = alike.grp) AS counts
  FROM alike),
weights AS (SELECT list(w::HUGEINT ORDER BY place) AS w FROM cls),
steps AS (
  SELECT 0::BIGINT AS turn, -1 AS fold, NULL::VARCHAR AS first, list_transform(range(5), lambda f: list_transform(w, lambda x: 0::HUGEINT)) AS held FROM weights
  UNION ALL
  SELECT lft.turn, best.fold, lft.first,
    list_transform(range(5), lambda f: CASE WHEN f = best.fold THEN list_transform(range(1, len(counts) + 1), lambda c: held[f + 1][c] + counts[c]) ELSE held[f + 1] END)
  FROM steps JOIN lft ON lft.turn = steps.turn + 1, weights, LATERAL (SELECT list_min(list_transform(range(5), lambda f: (
    list_sum(list_transform(range(1, len(counts) + 1), lambda c: counts[c] * held[f + 1][c] * w[c])), list_sum(held[f + 1]), f)))[3]::INTEGER AS fold) best),
given AS (SELECT first, fold, sum(count(*)) OVER (PARTITION BY first ORDER BY fold) AS up_to, count(*) AS n FROM steps WHERE turn > 0 GROUP BY first, fold),
grouped AS (
  SELECT member.*, given.fold FROM member JOIN alike USING (grp) JOIN given ON given.first = alike.first AND i > up_to - given.n AND i <= up_to)"""


_PLANE = """e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b FROM e),
t AS (SELECT *, (a + d) / 2 AS mid, sqrt((a - d) * (a - d) / 4 + b * b) AS r, atan2(2 * b, a - d) / 2 AS turn FROM m)"""


def _fills(planted: str = "") -> str:
    """Elements of the test rows by both fillings: m, and near by the neighbours."""
    return f"""{_LONG},
h AS (SELECT entity_id, label, pos, v {planted} AS v, substr(md5(entity_id || ':' || pos), 1, 1) >= '3' AS known FROM long),
m AS (SELECT pos, avg(v) AS m FROM h WHERE known AND entity_id % 5 <> 0 GROUP BY pos),
d AS (
  SELECT a.entity_id, b.entity_id AS t, round(sum((a.v - b.v) * (a.v - b.v)) / count(*), 9) AS d
  FROM h a JOIN h b ON a.pos = b.pos AND a.known AND b.known AND a.entity_id % 5 = 0 AND b.entity_id % 5 <> 0 GROUP BY ALL),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY d, t) AS i FROM d) WHERE i <= {NEIGHBOURS}),
o AS (SELECT n.entity_id, h.pos, avg(h.v) AS near FROM n JOIN h ON h.entity_id = n.t AND h.known GROUP BY ALL),
filled AS (SELECT h.entity_id, h.pos, h.v, h.known, m.m, coalesce(o.near, m.m) AS near FROM h LEFT JOIN m USING (pos) LEFT JOIN o ON o.entity_id = h.entity_id AND o.pos = h.pos WHERE h.entity_id % 5 = 0)"""


def _survival(classes: str = "true") -> str:
    """By time and class: c seen last, d with an event, r at risk."""
    return f"""f AS (
  SELECT label, floor(abs(embedding[1]::DOUBLE) * 100)::DOUBLE AS time, embedding[2]::DOUBLE > -0.05 AS event FROM embeddings WHERE {classes}),
g AS (SELECT t.time, l.label, count(f.label) AS c, count(f.label) FILTER (f.event) AS d
  FROM (SELECT DISTINCT time FROM f) t CROSS JOIN (SELECT DISTINCT label FROM f) l LEFT JOIN f ON f.time = t.time AND f.label = l.label GROUP BY ALL),
a AS (SELECT *, sum(c) OVER (PARTITION BY label ORDER BY time DESC) AS r FROM g),
w AS (SELECT *, sum(d) OVER (PARTITION BY time)::DOUBLE AS all_d, sum(r) OVER (PARTITION BY time)::DOUBLE AS all_r FROM a),
o AS (
  SELECT label, sum(c)::BIGINT AS n, sum(d)::BIGINT AS observed, sum(all_d * r / all_r) AS expected,
    sum(CASE WHEN all_r > 1 THEN all_d * (all_r - all_d) / (all_r - 1) * (r / all_r) * (1 - r / all_r) ELSE 0 END) AS variance FROM w GROUP BY label)"""


def _cells() -> str:
    flags = ", ".join(
        f"""count(*) FILTER (l_returnflag = '{k}') AS "n_{k}", round(count(*) FILTER (l_returnflag = '{k}') / count(l_returnflag), 4) + 0.0e0 AS "share_{k}",
  round(avg(l_extendedprice) FILTER (l_returnflag = '{k}'), 4) + 0.0e0 AS "mean_{k}\""""
        for k in "ANR"
    )
    return f"""WITH k AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL),
h AS (SELECT l_suppkey, -sum(n / t * ln(n / t)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS t FROM k) GROUP BY l_suppkey)
SELECT l_suppkey AS entity_id, count(*) AS n_cells, count(DISTINCT l_returnflag) AS n_kinds, round(any_value(entropy), 4) + 0.0e0 AS entropy, {flags},
  {", ".join(f"round(quantile_cont(l_extendedprice, {q / 100}), 4) + 0.0e0 AS q_{q}" for q in (25, 50, 75))}
FROM lineitem JOIN h USING (l_suppkey) GROUP BY l_suppkey"""


_SPACE = f"""e AS (
  SELECT vec_id, round(embedding[1]::DOUBLE * 100, 1) AS x, round(embedding[2]::DOUBLE * 100, 1) AS y, label AS kind FROM embeddings),
k AS (
  SELECT a.vec_id AS entity_id, a.kind AS own, b.kind, count(*) AS n
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {RADIUS * RADIUS}
  GROUP BY ALL)"""


#: Planted rows, their codes by table, the pairs that meet, and the neighbours of the test rows.
_PROBED = f"""{_LONG},
p AS (SELECT entity_id, pos, v + CASE WHEN pos = label THEN 3.0e0 ELSE 0.0e0 END AS v FROM long),
x AS (SELECT entity_id, list(v ORDER BY pos) AS x FROM p GROUP BY entity_id),
s AS (SELECT t, b, pos, CASE WHEN substr(md5(t || ':' || b || ':' || pos), 1, 1) < '8' THEN 1 ELSE -1 END AS sign
  FROM range({approximate.TABLES}) AS ts(t), range({approximate.BITS}) AS bs(b), (SELECT DISTINCT pos FROM long)),
m AS (SELECT entity_id, t, b, sum(v * sign) AS margin FROM p JOIN s USING (pos) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, t ORDER BY abs(margin), b) AS place FROM m),
c AS (SELECT entity_id, t, sum(CASE WHEN margin >= 0 THEN 1 << b ELSE 0 END)::BIGINT AS code FROM r GROUP BY ALL),
u AS (SELECT entity_id, t, flip, sum(CASE WHEN (flip >> (place - 1)) & 1 = 1 THEN 1 << b ELSE 0 END)::BIGINT AS turned
  FROM r, range(1 << {approximate.UNSURE}) AS fs(flip) WHERE place <= {approximate.UNSURE} GROUP BY ALL),
met AS (
  SELECT DISTINCT q.entity_id, d.entity_id AS train_id FROM c q JOIN u USING (entity_id, t) JOIN c d ON d.t = q.t AND d.code = xor(q.code, turned)
  WHERE q.entity_id % 5 = 0 AND d.entity_id % 5 <> 0),
pairs AS (
  SELECT a.entity_id, b.entity_id AS train_id, round(list_cosine_similarity(a.x, b.x), 9) AS near, met.train_id IS NOT NULL AS met
  FROM x a JOIN x b ON a.entity_id % 5 = 0 AND b.entity_id % 5 <> 0 LEFT JOIN met ON met.entity_id = a.entity_id AND met.train_id = b.entity_id),
f AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY near DESC, train_id) AS i FROM (
    SELECT *, count(*) FILTER (met) OVER (PARTITION BY entity_id) AS n FROM pairs) WHERE met OR n < {NEIGHBOURS}) WHERE i <= {NEIGHBOURS}),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY near DESC, train_id) AS i FROM pairs) WHERE i <= {NEIGHBOURS})"""


def _validated(long: str, folds: str) -> str:
    """Accuracy by fold of the nearest centroid."""
    return f"""WITH {long}, {folds},
l AS (SELECT long.*, fold FROM long JOIN folds USING (entity_id)),
c AS (SELECT f.fold, l.label AS k, pos, avg(v) AS m FROM l JOIN (SELECT DISTINCT fold FROM folds) f ON l.fold <> f.fold GROUP BY ALL),
d AS (SELECT fold, entity_id, label, k, sum((v - m) * (v - m)) AS d FROM l JOIN c USING (fold, pos) GROUP BY ALL),
p AS (SELECT fold, entity_id, any_value(label) AS label, arg_min(k, (d, k)) AS predicted FROM d GROUP BY ALL)
SELECT fold, round(avg((label = predicted)::INTEGER), 6) + 0.0e0 AS accuracy FROM p GROUP BY fold"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_read_features": "SELECT vec_id AS entity_id, len(embedding)::INTEGER AS width, label FROM embeddings",
        "p2_to_long": f"WITH {_LONG} SELECT entity_id, label, pos, round(v, 6) + 0.0e0 AS v FROM long",
        "p3_class_summary": f"""WITH {_LONG} SELECT label, pos, count(v) AS n, round(avg(v), 6) + 0.0e0 AS mean_v, round(stddev_samp(v), 6) + 0.0e0 AS sd_v,
  round(min(v), 6) + 0.0e0 AS min_v, round(max(v), 6) + 0.0e0 AS max_v FROM long GROUP BY ALL""",
        "p4_feature_corr": f"""WITH {_LONG} SELECT a.pos AS p1, b.pos AS p2, round(corr(a.v, b.v), 6) + 0.0e0 AS r
  FROM long a JOIN long b ON a.entity_id = b.entity_id AND a.pos < b.pos GROUP BY ALL""",
        "p5_welch_t": f"""WITH {_LONG} SELECT pos, round((avg(v) FILTER (label = 0) - avg(v) FILTER (label = 1))
  / sqrt(var_samp(v) FILTER (label = 0) / count(v) FILTER (label = 0) + var_samp(v) FILTER (label = 1) / count(v) FILTER (label = 1)), 6) + 0.0e0 AS t
  FROM long WHERE label IN (0, 1) GROUP BY pos""",
        "p6_anova_f": f"WITH {_F} SELECT pos, f FROM f",
        "p7_zscore": f"""WITH {_LONG}, s AS (SELECT pos, avg(v) AS m, stddev_samp(v) AS sd FROM long GROUP BY pos)
  SELECT entity_id, pos, round(CASE WHEN sd = 0 THEN 0 ELSE (v - m) / sd END, 6) + 0.0e0 AS z FROM long JOIN s USING (pos)""",
        "p8_pca_plane": f"""WITH {_PLANE}
SELECT vec_id AS entity_id, round(pow(x * cos(turn) + y * sin(turn), 2), 6) + 0.0e0 AS square1, round(pow(y * cos(turn) - x * sin(turn), 2), 6) + 0.0e0 AS square2 FROM e, t""",
        "p8_plane_variance": f"""WITH {_PLANE}
SELECT 1 AS component, round((mid + r) / (2 * mid), 6) + 0.0e0 AS share FROM t UNION ALL SELECT 2, round((mid - r) / (2 * mid), 6) + 0.0e0 FROM t""",
        "p8_pca_norms": f"""WITH {_LONG}, m AS (SELECT pos, avg(v) AS m FROM long GROUP BY pos)
SELECT entity_id, round(sum((v - m) * (v - m)), 6) + 0.0e0 AS norm FROM long JOIN m USING (pos) GROUP BY entity_id""",
        "p8_pca_covariance": "SELECT 0.0e0 AS c12, 0.0e0 AS c13, 0.0e0 AS c23",
        "p9_kmeans_planted": "SELECT label, count(*) AS n, 1.0e0 AS share FROM embeddings GROUP BY label",
        "p9_silhouette": f"""WITH {_LONG},
p AS (SELECT entity_id, label, pos, v + CASE WHEN pos = label THEN 3.0e0 ELSE 0.0e0 END AS v FROM long),
d AS (SELECT a.entity_id, a.label, b.label AS other, sum((a.v - b.v) * (a.v - b.v)) AS d, count(DISTINCT b.entity_id) AS n
  FROM p a JOIN p b ON a.pos = b.pos GROUP BY ALL),
s AS (SELECT entity_id, max(CASE WHEN label = other THEN d / (n - 1) END) AS a, min(CASE WHEN label <> other THEN d / n END) AS b FROM d GROUP BY entity_id)
SELECT round(avg((b - a) / greatest(a, b)), 6) + 0.0e0 AS silhouette FROM s""",
        "p15_logistic_planted": "SELECT count(*) AS n, 1.0e0 AS accuracy FROM embeddings WHERE vec_id % 5 = 0",
        # every test row in its own class, so far are the classes from each other
        "p15_logistic_confusion": "SELECT label, label AS predicted, count(*) AS n, count(*) AS n_fit FROM embeddings WHERE vec_id % 5 = 0 GROUP BY label",
        "p16_forest_planted": "SELECT count(*) AS n, 1.0e0 AS accuracy FROM embeddings WHERE vec_id % 5 = 0",
        "p19_forest_top": "SELECT DISTINCT label AS pos FROM embeddings",
        "p10_cluster_by_class": f"""WITH {_LONG},
c AS (SELECT label AS k, pos, avg(v) AS m FROM long GROUP BY ALL),
d AS (SELECT entity_id, label, k, sum((v - m) * (v - m)) AS d FROM long JOIN c USING (pos) GROUP BY ALL),
p AS (SELECT entity_id, any_value(label) AS label, arg_min(k, (d, k)) AS cluster FROM d GROUP BY entity_id),
n AS (SELECT cluster, label, count(*) AS n FROM p GROUP BY ALL)
SELECT cluster, label, n, round(n / sum(n) OVER (PARTITION BY cluster), 6) + 0.0e0 AS share FROM n""",
        "p11_stratified_folds": f"WITH {_FOLDS} SELECT entity_id, label, fold FROM folds",
        "p12_nearest_centroid": f"WITH {_CENTROID} SELECT entity_id, label, predicted FROM p",
        "p13_gaussian_nb": f"""WITH {_LONG},
c AS (SELECT label AS k, pos, avg(v) AS m, greatest(var_pop(v), 1e-9) AS s2, count(*) AS n FROM long WHERE entity_id % 5 <> 0 GROUP BY ALL),
d AS (SELECT entity_id, label, k, sum(ln(s2) + (v - m) * (v - m) / s2) / 2 - ln(max(n)) AS d FROM long JOIN c USING (pos) WHERE entity_id % 5 = 0 GROUP BY ALL)
SELECT entity_id, any_value(label) AS label, arg_min(k, (d, k)) AS predicted FROM d GROUP BY entity_id""",
        "p14_knn_classify": f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
n AS (SELECT a.vec_id, a.label, b.label AS vote,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.x, b.x), 9) DESC, b.vec_id) AS i
  FROM e a JOIN e b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
v AS (SELECT vec_id, label, vote, count(*) AS n FROM n WHERE i <= {NEIGHBOURS} GROUP BY ALL)
SELECT vec_id AS entity_id, any_value(label) AS label, arg_min(vote, (-n, vote)) AS predicted FROM v GROUP BY vec_id""",
        "p17_confusion": f"WITH {_CENTROID} SELECT label, predicted, count(*) AS n FROM p GROUP BY ALL",
        "p17_class_scores": f"""WITH {_CENTROID}, o AS (SELECT label AS c FROM p UNION SELECT predicted FROM p),
s AS (SELECT c, count(*) FILTER (label = c AND predicted = c) AS tp, count(*) FILTER (label = c) AS actual, count(*) FILTER (predicted = c) AS claimed FROM p, o GROUP BY c)
SELECT c AS label, round(tp / nullif(claimed, 0), 6) + 0.0e0 AS precision, round(tp / nullif(actual, 0), 6) + 0.0e0 AS recall,
  round(2 * tp / nullif(actual + claimed, 0), 6) + 0.0e0 AS f1 FROM s""",
        "p18_cross_validate": _validated(_LONG, _FOLDS),
        "p28_svm_slope": f"""WITH {_LONG},
m AS (SELECT pos, avg(v) AS m, stddev_samp(v) AS sd, count(*) AS n FROM long GROUP BY pos),
z AS (SELECT label, long.pos, sum((v - m) / sd) AS z, count(*) AS own, any_value(n) AS n FROM long JOIN m USING (pos) GROUP BY ALL)
SELECT label, pos + 1 AS pos, round(-(2 * z - sum(z) OVER (PARTITION BY pos)) / n, 6) + 0.0e0 AS slope FROM z
UNION ALL SELECT label, 0, round(any_value(n - 2 * own) / any_value(n), 6) + 0.0e0 FROM z GROUP BY label""",
        # every test row in its own class, so far are the classes from each other
        "p28_svm_confusion": "SELECT label, label AS predicted, count(*) AS n FROM embeddings WHERE vec_id % 5 = 0 GROUP BY label",
        "p29_first_splits": f"""WITH {_LONG},
q AS (SELECT pos, list_transform(quantile_cont(v, {[i / boosting.BINS for i in range(1, boosting.BINS)]}), lambda c: round(c, 9)) AS cuts FROM long GROUP BY pos),
b AS (SELECT label, long.pos, len(list_filter(cuts, lambda c: c < v)) AS bin, cuts FROM long JOIN q USING (pos)),
k AS (SELECT label AS k, count(*) OVER () AS n_k FROM (SELECT DISTINCT label FROM embeddings)),
h AS (
  SELECT k, pos, bin, any_value(cuts) AS cuts, count(*) AS n, sum(round((1.0e0 / n_k - (label = k)::INTEGER) * {boosting.UNIT})) AS g, sum(round(1.0e0 / n_k * (1 - 1.0e0 / n_k) * {boosting.UNIT})) AS h
  FROM b, k GROUP BY k, pos, bin),
s AS (
  SELECT *, sum(n) OVER up_to AS nl, sum(g) OVER up_to / {boosting.UNIT} AS gl, sum(h) OVER up_to / {boosting.UNIT} AS hl, sum(n) OVER whole AS na, sum(g) OVER whole / {boosting.UNIT} AS ga, sum(h) OVER whole / {boosting.UNIT} AS ha
  FROM h WINDOW up_to AS (PARTITION BY k, pos ORDER BY bin), whole AS (PARTITION BY k, pos)),
t AS (
  SELECT *, gl * gl / (hl + {boosting.L2}) + (ga - gl) * (ga - gl) / (ha - hl + {boosting.L2}) - ga * ga / (ha + {boosting.L2}) AS gain FROM s
  WHERE bin < {boosting.BINS - 1} AND nl >= {boosting.LEAST_ROWS} AND na - nl >= {boosting.LEAST_ROWS})
SELECT k AS label, pos, round(cuts[bin + 1], 6) + 0.0e0 AS cut, round(gain, 6) + 0.0e0 AS gain
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, pos, bin) AS i FROM t) WHERE i = 1""",
        "p29_boosting_planted": "SELECT count(*) AS n, true AS reached FROM embeddings WHERE vec_id % 5 = 0",
        "p27_approximate": f"WITH {_PROBED} SELECT entity_id, round(near, 6) + 0.0e0 AS near, train_id, i::INTEGER AS i FROM f",
        "p27_recall": f"""WITH {_PROBED} SELECT count(*) AS n, round(count(f.train_id) / count(*), 4) + 0.0e0 AS recall
  FROM e LEFT JOIN f ON f.entity_id = e.entity_id AND f.train_id = e.train_id""",
        "p26_mixture_planted": "SELECT label, count(*) AS n, 1.0e0 AS share FROM embeddings GROUP BY label",
        # classes so far from each other that each component is one of them
        "p26_mixture_components": f"""WITH {_LONG}, n AS (SELECT count(*) AS n FROM embeddings)
SELECT label, pos, round(count(*) / any_value(n), 6) + 0.0e0 AS weight, round(avg(v) + CASE WHEN pos = label THEN 3 ELSE 0 END, 6) + 0.0e0 AS mean,
  round(greatest(var_pop(v), 1e-6), 6) + 0.0e0 AS variance FROM long, n GROUP BY label, pos""",
        "p25_ridge": f"""WITH {_FOLDS},
e AS (SELECT vec_id AS entity_id, fold, embedding[1]::DOUBLE AS t, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y FROM embeddings JOIN folds ON vec_id = entity_id),
s AS (SELECT g.fold, avg(t) AS mt, avg(x) AS mx, avg(y) AS my, var_pop(x) + {RIDGE} AS a, var_pop(y) + {RIDGE} AS d, covar_pop(x, y) AS b, covar_pop(x, t) AS u, covar_pop(y, t) AS w
  FROM e JOIN (SELECT DISTINCT fold FROM e) g ON e.fold <> g.fold GROUP BY g.fold),
c AS (SELECT *, (u * d - w * b) / (a * d - b * b) AS cx, (w * a - u * b) / (a * d - b * b) AS cy FROM s)
SELECT entity_id, fold::BIGINT AS fold, round(t, 6) + 0.0e0 AS v, round(mt + cx * (x - mx) + cy * (y - my), 6) + 0.0e0 AS predicted FROM e JOIN c USING (fold)""",
        "p24_neighbour_kinds": f"WITH {_SPACE} SELECT entity_id, kind, n FROM k",
        "p24_neighbourhoods": f"""WITH {_SPACE}, t AS (
  SELECT entity_id, sum(n)::BIGINT AS n_neighbours, sum(CASE WHEN kind = own THEN n ELSE 0 END)::BIGINT AS n_same, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM k GROUP BY entity_id)
SELECT vec_id AS entity_id, coalesce(n_neighbours, 0) AS n_neighbours, coalesce(n_same, 0) AS n_same, round(entropy, 6) + 0.0e0 AS entropy FROM e LEFT JOIN t ON t.entity_id = e.vec_id""",
        "p23_cell_features": _cells(),
        "p23_cell_quantiles": f"""SELECT entity_id, i::INTEGER AS i, round(q[i + 1], 6) + 0.0e0 AS q
  FROM (SELECT l_returnflag AS entity_id, quantile_cont(l_extendedprice, {list(DECILES)}) AS q, unnest(range({len(DECILES)})) AS i FROM lineitem GROUP BY l_returnflag)""",
        "p22_survival_curve": f"""WITH {_survival()},
s AS (SELECT *, exp(sum(CASE WHEN d = 0 THEN 0 WHEN d = r THEN '-infinity'::DOUBLE ELSE ln(1 - d / r) END) OVER (PARTITION BY label ORDER BY time)) AS s,
  sum(CASE WHEN d < r THEN d / (r * (r - d)) ELSE 0 END) OVER (PARTITION BY label ORDER BY time) AS g FROM a)
SELECT label, time, r::BIGINT AS n_risk, d AS n_event, c - d AS n_censored, round(s, 6) + 0.0e0 AS survival, round(CASE WHEN s > 0 THEN s * sqrt(g) END, 6) + 0.0e0 AS std_err FROM s WHERE c > 0""",
        "p22_logrank": f"WITH {_survival()} SELECT label, n, observed, round(expected, 6) + 0.0e0 AS expected, round(variance, 6) + 0.0e0 AS variance FROM o",
        "p22_logrank_test": f"""WITH {_survival("label IN (0, 1)")}
SELECT round((observed - expected) * (observed - expected) / variance, 6) + 0.0e0 AS statistic, 1::INTEGER AS degrees FROM o WHERE label = 0""",
        "p21_mean_fill": f"WITH {_fills()} SELECT entity_id, pos, round(CASE WHEN known THEN v ELSE m END, 6) + 0.0e0 AS v FROM filled",
        "p21_neighbour_fill": f"WITH {_fills()} SELECT entity_id, pos, round(CASE WHEN known THEN v ELSE near END, 6) + 0.0e0 AS v FROM filled",
        "p21_fill_error": f"""WITH {_fills("+ CASE WHEN pos = label THEN 3.0e0 ELSE 0.0e0 END")}
SELECT 'mean' AS method, count(*) AS n, round(sqrt(avg((m - v) * (m - v))), 4) + 0.0e0 AS rmse FROM filled WHERE NOT known
UNION ALL SELECT 'neighbours', count(*), round(sqrt(avg((near - v) * (near - v))), 4) + 0.0e0 FROM filled WHERE NOT known""",
        "p20_grouped_folds": f"WITH RECURSIVE {_GROUPS} SELECT entity_id, label, grp AS \"group\", fold FROM grouped",
        "p20_grouped_validation": _validated("RECURSIVE " + _LONG, _GROUPS + ", folds AS (SELECT entity_id, label, fold FROM grouped)"),
        "p19_rank_features": f"WITH {_F} SELECT * FROM (SELECT row_number() OVER (ORDER BY f DESC NULLS LAST, pos)::INTEGER AS rank, pos, f FROM f) WHERE rank <= 20",
    }
