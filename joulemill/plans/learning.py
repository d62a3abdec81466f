"""Machine-learning jobs with the built-in estimators; metrics also as plain aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, classification as C, clustering as K, evaluation as E, feature as X, regression as R, stat as S, tuning as T
from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, functions as F

from joulemill.operators.ordered import running, top_per_key
from joulemill.plans.similarity import similarity_join
from joulemill.registry import query
from joulemill.storage import cut, spread

TEXT_CHARS = 16 << 20  # of the texts that one task trains word vectors on, about


def size(v):
    """Number of non-zero entries of a vector column, from the values it stores: a sparse vector isn't spelled out to its full length."""
    return F.size(F.filter(F.unwrap_udt(v)["values"], lambda e: e != 0))


@query("ml_01_text_features", "ML-01", r"""
WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 1) AS w FROM conversations)
SELECT conv_id, turn, len(w) AS words, greatest(len(w) - 1, 0) AS bigrams, len(list_filter(w, lambda x: NOT list_contains(['the', 'and', 'de'], x))) AS kept, len(list_distinct(w)) AS terms, true AS same FROM w""")
def text_features(t):
    """Tokens, stop words, bigrams and term counts, checked by number; hashing, IDF, word vectors by size.

    The vocabulary holds every word. Word vectors are trained on all texts, in one task for each ``TEXT_CHARS`` letters of them, and the built-in
    estimator averages what the tasks have learnt."""
    c = t.conversations.select("conv_id", "turn", "text")
    tasks = -(-(c.agg(F.sum(F.length("text"))).first()[0] or 1) // TEXT_CHARS)
    stages = [
        X.Tokenizer(inputCol="text", outputCol="plain"), X.RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=1),
        X.StopWordsRemover(inputCol="words", outputCol="kept", stopWords=["the", "and", "de"]), X.NGram(inputCol="words", outputCol="bigrams", n=2),
        X.CountVectorizer(inputCol="words", outputCol="counts", vocabSize=(1 << 31) - 1), X.HashingTF(inputCol="words", outputCol="hashed", numFeatures=4096), X.IDF(inputCol="hashed", outputCol="idf"),
        X.Word2Vec(inputCol="words", outputCol="w2v", vectorSize=8, minCount=3, maxIter=1, seed=1, numPartitions=tasks), X.FeatureHasher(inputCols=["turn", "text"], outputCol="fh", numFeatures=1024),
    ]
    out = Pipeline(stages=stages).fit(c).transform(c)
    same = (size("hashed") <= size("counts")) & (size("idf") <= size("hashed")) & (F.size(vector_to_array("w2v")) == 8) & (size("fh") >= 1) & (F.size("plain") >= 1)
    return out.select("conv_id", "turn", F.size("words").cast("long").alias("words"), F.size("bigrams").cast("long").alias("bigrams"), F.size("kept").cast("long").alias("kept"), size("counts").cast("long").alias("terms"), same.alias("same"))


@query("ml_02_numeric_features", "ML-02", """
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_tax) FILTER (l_tax <> 0) AS mt FROM lineitem)
SELECT l_returnflag, round(avg((l_quantity > 25)::INT), 6) AS binary, round(avg(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 1 ELSE 2 END), 6) AS bucket, round(avg(CASE WHEN l_tax = 0 THEN mt ELSE l_tax END), 6) AS imputed, round(avg((l_quantity - mq) / sq), 5) + 0.0 AS standard,
 round(avg((l_quantity - lo) / (hi - lo)), 6) AS minmax, round(avg(l_quantity / hi), 6) AS maxabs, round(avg(l_quantity / sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber)), 6) AS unit, round(avg(l_quantity * l_linenumber), 5) AS product, round(avg(l_quantity * 2), 5) AS weighted, true AS shapes FROM lineitem, s GROUP BY 1""")
def numeric_features(t):
    l = t.lineitem.select("l_returnflag", "l_quantity", "l_linenumber", F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"))
    pair = ["l_quantity", "l_linenumber"]
    stages = [
        X.Binarizer(inputCol="l_quantity", outputCol="b", threshold=25.0), X.Bucketizer(inputCol="l_quantity", outputCol="bk", splits=[-float("inf"), 10, 30, float("inf")]), X.QuantileDiscretizer(inputCol="l_quantity", outputCol="qd", numBuckets=4), X.Imputer(inputCols=["tax"], outputCols=["ti"]),
        X.VectorAssembler(inputCols=pair, outputCol="v"), X.StandardScaler(inputCol="v", outputCol="ss", withMean=True), X.MinMaxScaler(inputCol="v", outputCol="mm"), X.MaxAbsScaler(inputCol="v", outputCol="ma"), X.RobustScaler(inputCol="v", outputCol="rs"), X.Normalizer(inputCol="v", outputCol="nz"),
        X.PolynomialExpansion(inputCol="v", outputCol="px", degree=2), X.DCT(inputCol="v", outputCol="dct"), X.ElementwiseProduct(inputCol="v", outputCol="ep", scalingVec=Vectors.dense([2.0, 1.0])), X.Interaction(inputCols=pair, outputCol="ia"), X.PCA(inputCol="v", outputCol="pca", k=1),
    ]
    out = Pipeline(stages=stages).fit(l).transform(l)
    at = lambda c, i=0: vector_to_array(c)[i]
    shapes = (F.size(vector_to_array("px")) == 5) & (F.size(vector_to_array("dct")) == 2) & (F.size(vector_to_array("rs")) == 2) & (F.size(vector_to_array("pca")) == 1) & F.col("qd").between(0, 3)
    avg = lambda c, n, d=6: (F.round(F.avg(c), d) + 0.0).alias(n)
    return out.groupBy("l_returnflag").agg(avg("b", "binary"), avg("bk", "bucket"), avg("ti", "imputed"), avg(at("ss"), "standard", 5), avg(at("mm"), "minmax"), avg(at("ma"), "maxabs"), avg(at("nz"), "unit"), avg(at("ia"), "product", 5), avg(at("ep"), "weighted", 5), F.bool_and(shapes).alias("shapes"))


@query("ml_03_categorical", "ML-03", """
WITH f AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS i FROM part GROUP BY 1)
SELECT p_partkey, i::DOUBLE AS idx, p_type AS back, CASE WHEN i = 5 THEN 0 ELSE 1 END AS ones, p_size * 2.0 AS doubled, true AS shapes FROM part JOIN f USING (p_type)""")
def categorical(t):
    p = t.part.select("p_partkey", "p_type", "p_size", "p_retailprice")
    stages = [
        X.StringIndexer(inputCol="p_type", outputCol="idx"), X.OneHotEncoder(inputCols=["idx"], outputCols=["hot"]), X.VectorAssembler(inputCols=["p_size", "p_retailprice", "hot"], outputCol="raw"), X.VectorSizeHint(inputCol="raw", size=7),
        X.VectorSlicer(inputCol="raw", outputCol="first", indices=[0, 1]), X.VectorIndexer(inputCol="first", outputCol="vi", maxCategories=4), X.SQLTransformer(statement="SELECT *, p_size * 2.0D AS doubled FROM __THIS__"), X.RFormula(formula="p_retailprice ~ p_size + p_type", featuresCol="rf", labelCol="rl"),
    ]
    model = Pipeline(stages=stages).fit(p)
    out = X.IndexToString(inputCol="idx", outputCol="back", labels=model.stages[0].labels).transform(model.transform(p))
    shapes = (F.size(vector_to_array("rf")) == 6) & (F.size(vector_to_array("vi")) == 2) & (F.col("rl") == F.col("p_retailprice"))
    return out.select("p_partkey", "idx", "back", size("hot").alias("ones"), "doubled", shapes.alias("shapes"))


def labelled(t) -> DataFrame:
    return t.embeddings.select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"))


@query("ml_04_selection", "ML-04")
def selection(t):
    """Selected column numbers of three selectors over embeddings and their class."""
    e = cut(labelled(t), "labelled")
    picked = {
        "chi": X.ChiSqSelector(featuresCol="pos", labelCol="label", outputCol="o", numTopFeatures=10).fit(e.withColumn("pos", array_to_vector(F.transform(vector_to_array("features"), lambda v: F.round(v * 10 + 10)))) ).selectedFeatures,
        "anova": X.UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="o", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(10).fit(e).selectedFeatures,
        "variance": X.VarianceThresholdSelector(featuresCol="features", outputCol="o", varianceThreshold=0.0156).fit(e).selectedFeatures,
    }
    rows = [(k, int(i)) for k, v in picked.items() for i in v]
    return t.spark.createDataFrame(rows, "selector string, feature int")


@query("ml_04_variance", "ML-04", """
WITH x AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings) SELECT feature::INTEGER AS feature FROM x GROUP BY 1 HAVING var_samp(v) > 0.0156""")
def variance_selection(t):
    """Columns whose sample variance exceeds the threshold, by the built-in selector."""
    picked = X.VarianceThresholdSelector(featuresCol="features", outputCol="o", varianceThreshold=0.0156).fit(labelled(t)).selectedFeatures
    return t.spark.createDataFrame([(int(i),) for i in picked], "feature int")


def word_sets(df, key) -> DataFrame:
    """(id, items): the hashes of a text's different words, of texts of three words and more."""
    w = F.split(F.lower("text"), r"\s+")
    return df.filter(F.size(w) >= 3).select(F.col(key).alias("id"), F.array_distinct(F.transform(w, lambda x: F.xxhash64(x))).alias("items"))


@query("ml_05_similar", "ML-05")
def similar(t):
    """Nearest embeddings of one vector by random projections, and documents close to a benchmark passage by banded min-hashes of their words."""
    e = cut(labelled(t), "labelled")
    lsh = X.BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=1.0, numHashTables=3, seed=3).fit(e)
    key = e.orderBy("vec_id").first()["features"]
    near = lsh.approxNearestNeighbors(e, key, 5).select(F.lit("vector").alias("kind"), F.col("vec_id").alias("id"), F.lit(-1).cast("long").alias("of"), F.round("distCol", 6).alias("distance"))
    close = similarity_join(word_sets(t.documents, "doc_id"), word_sets(t.benchmark, "item_id"), 0.4)
    return near.union(close.select(F.lit("text").alias("kind"), F.col("a").alias("id"), F.col("b").alias("of"), F.round(1 - F.col("similarity"), 6).alias("distance")))


@query("ml_06_classification", "ML-06")
def classify(t):
    """Training accuracy of every classifier on the embeddings (two-class models see class 0 against the rest)."""
    e = labelled(t).withColumn("two", (F.col("label") == 0).cast("double")).withColumn("positive", array_to_vector(F.transform(vector_to_array("features"), lambda v: v + 1)))
    e = cut(e, "labelled")
    many = {
        "logistic": C.LogisticRegression(maxIter=10), "tree": C.DecisionTreeClassifier(maxDepth=4), "forest": C.RandomForestClassifier(numTrees=5, maxDepth=4, seed=1), "bayes": C.NaiveBayes(featuresCol="positive"),
        "perceptron": C.MultilayerPerceptronClassifier(layers=[64, 16, 10], maxIter=20, seed=1), "one_vs_rest": C.OneVsRest(classifier=C.LinearSVC(maxIter=3)),
    }
    two = {"svc": C.LinearSVC(labelCol="two", maxIter=5), "gbt": C.GBTClassifier(labelCol="two", maxIter=2, maxDepth=3, seed=1), "factorization": C.FMClassifier(labelCol="two", maxIter=5, seed=1)}
    rows = []
    for name, est in {**many, **two}.items():
        label = "label" if name in many else "two"
        got = est.fit(e).transform(e)
        rows.append((name, round(got.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0], 4)))
    return t.spark.createDataFrame(rows, "model string, accuracy double")


def priced(t) -> DataFrame:
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_quantity", "p_size", "l_discount", F.col("l_extendedprice").alias("label"))
    return X.VectorAssembler(inputCols=["l_quantity", "p_size", "l_discount"], outputCol="features").transform(j)


@query("ml_07_linear_regression", "ML-07", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 5) AS r2 FROM lineitem")
def linear_regression(t):
    l = X.VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(t.lineitem.select("l_quantity", F.col("l_extendedprice").alias("label")))
    m = R.LinearRegression(solver="normal").fit(l)
    return t.spark.range(1).select(F.round(F.lit(float(m.coefficients[0])), 3).alias("slope"), F.round(F.lit(float(m.intercept)), 2).alias("intercept"), F.round(F.lit(float(m.summary.r2)), 5).alias("r2"))


def pooled(d: DataFrame) -> DataFrame:
    """(features, label, weight): the rows of one value of the first feature as one row, with their mean label and their number.

    The isotonic fit pools them like this itself, but first brings them all to one task as objects. What a task gets here follows the number of different values."""
    groups = d.groupBy(vector_to_array("features")[0].alias("x")).agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    return spread(cut(groups, "pooled"), "x").select(array_to_vector(F.array("x")).alias("features"), "label", "weight")


@query("ml_07_regression", "ML-07")
def regress(t):
    """Fit error of every regressor relative to the spread of the price (below 1 means it explains something)."""
    d = cut(priced(t).withColumn("censor", F.lit(1.0)), "priced")
    models = {
        "linear": R.LinearRegression(maxIter=10), "glm": R.GeneralizedLinearRegression(family="gaussian", maxIter=5), "tree": R.DecisionTreeRegressor(maxDepth=4), "forest": R.RandomForestRegressor(numTrees=5, maxDepth=4, seed=1), "gbt": R.GBTRegressor(maxIter=3, maxDepth=3, seed=1),
        "survival": R.AFTSurvivalRegression(maxIter=10), "isotonic": R.IsotonicRegression(featureIndex=0, weightCol="weight"), "factorization": R.FMRegressor(maxIter=20, stepSize=0.5, seed=1),
    }
    deviation = d.agg(F.stddev_pop("label")).first()[0]
    rows = []
    for name, est in models.items():
        model = est.fit(pooled(d) if name == "isotonic" else d)
        rows.append((name, float(E.RegressionEvaluator(metricName="rmse").evaluate(model.transform(d)) / deviation)))
    return t.spark.createDataFrame(rows, "model string, relative_rmse double").withColumn("relative_rmse", F.round("relative_rmse", 4))


@query("ml_08_clustering", "ML-08")
def cluster(t):
    """Cluster sizes of the vector models, topic count of LDA and the power-iteration clusters of a nation graph."""
    e = cut(labelled(t).withColumn("few", array_to_vector(F.slice(vector_to_array("features"), 1, 4))), "labelled")
    out = None

    def add(name, df):
        nonlocal out
        part = df.groupBy(F.col("prediction").cast("int").alias("cluster")).agg(F.count("*").alias("n")).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)

    add("kmeans", K.KMeans(k=10, seed=1, maxIter=5).fit(e).transform(e))
    add("bisecting", K.BisectingKMeans(k=4, seed=1, maxIter=3).fit(e).transform(e))
    add("mixture", K.GaussianMixture(k=2, seed=1, maxIter=5, featuresCol="few").fit(e).transform(e))
    words = X.HashingTF(inputCol="w", outputCol="features", numFeatures=512).transform(t.conversations.select(F.split(F.lower("text"), r"\s+").alias("w")))
    topics = K.LDA(k=4, maxIter=3, seed=1).fit(words).transform(words)
    add("lda", topics.withColumn("prediction", F.array_position(vector_to_array("topicDistribution"), F.array_max(vector_to_array("topicDistribution"))) - 1))
    trade = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").cast("long").alias("a"), (F.col("l_partkey") % 25).alias("b")).agg(F.count("*").cast("double").alias("weight"))
    graph = trade.filter("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    add("power", K.PowerIterationClustering(k=2, maxIter=5, weightCol="weight").assignClusters(graph).withColumnRenamed("cluster", "prediction"))
    return out


@query("ml_09_recommendation", "ML-09 WL-19")
def recommend(t):
    """Implicit factors of customers and parts from bought quantities; the best three of each customer's parts."""
    q = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").cast("int").alias("customer"), F.col("l_partkey").cast("int").alias("part")).agg(F.sum("l_quantity").alias("rating"))
    q = cut(q, "ratings")
    model = ALS(rank=4, maxIter=3, implicitPrefs=True, userCol="customer", itemCol="part", ratingCol="rating", seed=1).fit(q)
    scored = model.transform(q).select("customer", "part", F.round("prediction", 5).alias("score"))
    return top_per_key(scored, ["customer"], [F.desc("score"), F.asc("part")], 3)


@query("ml_10_baskets", "ML-10", """
WITH b AS (SELECT l_orderkey, list(DISTINCT p_type ORDER BY p_type) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), d AS (SELECT w, count(*) AS n FROM b GROUP BY 1),
m AS (SELECT w, n, unnest(range(1, 1 << len(w))) AS mask FROM d), s AS (SELECT array_to_string(list_filter(w, lambda x, i: (mask >> (i - 1)) % 2 = 1), ',') AS item, sum(n)::BIGINT AS freq FROM m GROUP BY 1)
SELECT item, freq FROM s WHERE freq >= ceil(0.05 * (SELECT count(*) FROM b))""")
def baskets(t):
    """Frequent sets of part types per order; a basket holds at most the six types."""
    b = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_type").alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=0.05).fit(b).freqItemsets
    return found.select(F.array_join(F.sort_array("items"), ",").alias("item"), "freq")


@query("ml_10_sequences", "ML-10")
def sequences(t):
    """Frequent event orders within a user day: per hour the set of event types, at most 24 hours of 5 types."""
    e = t.events.groupBy("user_id", F.to_date("ts").alias("d"), F.hour("ts").alias("h")).agg(F.sort_array(F.collect_set("event_type")).alias("s"))
    days = e.groupBy("user_id", "d").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "s"))), lambda x: x["s"]).alias("sequence"))
    found = PrefixSpan(minSupport=0.05, maxPatternLength=3).findFrequentSequentialPatterns(days.select("sequence"))
    return found.select(F.array_join(F.transform("sequence", lambda s: F.array_join(s, "+")), ">").alias("pattern"), "freq")


def mean_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, rank): the mean position of the rows with this value in the order of all rows, from the counts of the values."""
    counts = cut(df.groupBy(value).agg(F.count("*").alias("_n")), "values")
    placed = running(counts, [], [F.col(value)], {"_hi": ("sum", F.col("_n"))})
    return placed.select(value, (F.col("_hi") - (F.col("_n") - 1) / 2).alias(f"_rank_{value}"))


def spearman(df: DataFrame, a: str, b: str) -> float:
    """Rank correlation of two columns, equal values at their mean rank: the correlation of the ranks, with the values ranked instead of the rows.

    The built-in one sorts and numbers an object for every row and column; nulls are an error here as there."""
    df = df.select(a, b)
    ranked = df.join(mean_ranks(df, a), a, "left").join(mean_ranks(df, b), b, "left").select(f"_rank_{a}", f"_rank_{b}")
    ranks = X.VectorAssembler(inputCols=ranked.columns, outputCol="v").transform(ranked)
    return float(S.Correlation.corr(ranks, "v").first()[0].toArray()[0, 1])


@query("ml_11_statistics", "ML-11", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr, round(avg(l_quantity), 5) AS mean, round(var_samp(l_extendedprice) / 1e6, 4) AS var, count(*) AS n, true AS valid FROM lineitem")
def statistics(t):
    v = X.VectorAssembler(inputCols=["l_quantity", "l_extendedprice"], outputCol="v").transform(t.lineitem.select("l_quantity", "l_extendedprice", "l_linenumber"))
    corr = S.Correlation.corr(v, "v").first()[0].toArray()[0, 1]
    rank = spearman(t.lineitem, "l_quantity", "l_extendedprice")
    chi = S.ChiSquareTest.test(v.select((F.col("l_linenumber") % 2).cast("double").alias("label"), array_to_vector(F.array(F.col("l_quantity") % 5)).alias("f")), "f", "label").first()
    ks = S.KolmogorovSmirnovTest.test(v.select(((F.col("l_quantity") - 25) / 14).alias("x")), "x", "norm", 0.0, 1.0).first()
    valid = bool(0 <= chi["pValues"][0] <= 1 and 0 <= ks["pValue"] <= 1 and -1 <= rank <= 1)
    return v.select(S.Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select(
        F.round(F.lit(float(corr)), 6).alias("corr"), F.round(vector_to_array("s.mean")[0], 5).alias("mean"), F.round(vector_to_array("s.variance")[1] / 1e6, 4).alias("var"), F.col("s.count").alias("n"), F.lit(valid).alias("valid"))


# predictions by rule, so that every metric can be followed in SQL
PREDICTIONS = "WITH p AS (SELECT l_orderkey % 3 AS label, CASE WHEN l_quantity > 25 THEN l_orderkey % 3 ELSE l_partkey % 3 END AS prediction, l_quantity AS y, l_linenumber * 5.0 AS yhat, (l_orderkey % 2) AS two, l_quantity + (l_orderkey % 2) * 5 AS score FROM lineitem)"


def predictions(t) -> DataFrame:
    k, q = F.col("l_orderkey"), F.col("l_quantity")
    return t.lineitem.select((k % 3).cast("double").alias("label"), F.when(q > 25, k % 3).otherwise(F.col("l_partkey") % 3).cast("double").alias("prediction"), q.alias("y"), (F.col("l_linenumber") * 5.0).alias("yhat"), (k % 2).cast("double").alias("two"), (q + (k % 2) * 5).alias("score"))


@query("ml_12_evaluators", "ML-12", PREDICTIONS + """
, c AS (SELECT label, count(*) AS n, sum((prediction = label)::INT) AS tp FROM p GROUP BY 1), d AS (SELECT prediction AS label, count(*) AS m FROM p GROUP BY 1), a AS (SELECT sum(n) AS al FROM c),
r AS (SELECT two, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM p), u AS (SELECT sum(k) FILTER (two = 1) AS s, count(*) FILTER (two = 1) AS pos, count(*) FILTER (two = 0) AS neg FROM r)
SELECT (SELECT round(sum(tp) / any_value(al), 6) FROM c, a) AS accuracy, (SELECT round(sum(tp / m * n) / any_value(al), 6) FROM c JOIN d USING (label), a) AS weighted_precision, (SELECT round(sum(tp / n * n) / any_value(al), 6) FROM c, a) AS weighted_recall,
 (SELECT round(sqrt(avg(pow(y - yhat, 2))), 6) FROM p) AS rmse, (SELECT round(avg(abs(y - yhat)), 6) FROM p) AS mae, (SELECT round(1 - sum(pow(y - yhat, 2)) / (var_pop(y) * count(*)), 6) FROM p) AS r2, (SELECT round((s - pos * (pos + 1) / 2) / (pos * neg), 5) FROM u) AS auc, true AS others""")
def evaluators(t):
    p = cut(predictions(t), "predictions")
    multi = lambda m: float(E.MulticlassClassificationEvaluator(metricName=m).evaluate(p))
    reg = lambda m: float(E.RegressionEvaluator(predictionCol="yhat", labelCol="y", metricName=m).evaluate(p))
    auc = float(E.BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="two", numBins=0).evaluate(p))
    lists = t.orders.select(F.array((F.col("o_custkey") % 3).cast("double"), F.lit(7.0)).alias("prediction"), F.array((F.col("o_orderkey") % 3).cast("double")).alias("label"))
    labels = float(E.MultilabelClassificationEvaluator(metricName="precision").evaluate(lists))
    ranking = float(E.RankingEvaluator(metricName="meanAveragePrecision").evaluate(lists))
    e = cut(labelled(t), "labelled")
    silhouette = float(E.ClusteringEvaluator().evaluate(e.withColumn("prediction", F.col("label").cast("int"))))
    others = 0 <= labels <= 1 and 0 <= ranking <= 1 and -1 <= silhouette <= 1
    named = {"accuracy": (multi("accuracy"), 6), "weighted_precision": (multi("weightedPrecision"), 6), "weighted_recall": (multi("weightedRecall"), 6), "rmse": (reg("rmse"), 6), "mae": (reg("mae"), 6), "r2": (reg("r2"), 6), "auc": (auc, 5)}
    return t.spark.range(1).select(*[F.round(F.lit(v), d).alias(k) for k, (v, d) in named.items()], F.lit(others).alias("others"))


@query("ml_13_model_selection", "ML-13")
def model_selection(t):
    """Grid search by cross validation and by a single split, folds fitted in parallel."""
    d = cut(priced(t), "priced")
    lr = R.LinearRegression(maxIter=5)
    grid = T.ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).addGrid(lr.fitIntercept, [True, False]).build()
    ev = E.RegressionEvaluator(metricName="r2")
    cv = T.CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=ev, numFolds=2, parallelism=4, seed=1).fit(d)
    tv = T.TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, evaluator=ev, trainRatio=0.75, parallelism=4, seed=1).fit(d)
    rows = [("cross_validation", i, float(m)) for i, m in enumerate(cv.avgMetrics)] + [("split", i, float(m)) for i, m in enumerate(tv.validationMetrics)]
    return t.spark.createDataFrame(rows, "method string, setting int, r2 double").withColumn("r2", F.round("r2", 4))


@query("ml_14_matrix_product", "ML-14", """
WITH a AS (SELECT o_custkey AS r, year(o_orderdate) AS c, sum(o_totalprice) / 1e5 AS v FROM orders GROUP BY ALL), b AS (SELECT o_custkey AS r, left(o_orderpriority, 1)::INT AS c, count(*) AS v FROM orders GROUP BY ALL)
SELECT a.c AS i, b.c AS j, round(sum(a.v * b.v), 4) AS v FROM a JOIN b USING (r) GROUP BY ALL""")
def matrix_product(t):
    """Transposed product of two coordinate matrices over the same rows (customers): join on the row, sum per
    cell. Both have few columns (years, priorities), so a row contributes a bounded number of cells."""
    a = t.orders.groupBy(F.col("o_custkey").alias("r"), F.year("o_orderdate").alias("i")).agg((F.sum("o_totalprice") / 1e5).alias("x"))
    b = t.orders.groupBy(F.col("o_custkey").alias("r"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("j")).agg(F.count("*").alias("y"))
    return a.join(b, "r").groupBy("i", "j").agg(F.round(F.sum(F.col("x") * F.col("y")), 4).alias("v"))


@query("ml_14_singular_values", "ML-14")
def singular_values(t):
    """Singular values of the embedding matrix from the Gram matrix of its columns, added up once per partition."""
    import pyarrow as pa

    def gram(batches):
        g = None
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(float)
                g = x.T @ x if g is None else g + x.T @ x
        if g is not None:
            i, j = np.indices(g.shape).reshape(2, -1)
            yield pa.RecordBatch.from_pydict({"i": i.astype("int32"), "j": j.astype("int32"), "s": g.ravel()})

    cells = t.embeddings.select("embedding").mapInArrow(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # columns x columns
    d = 1 + max((r["i"] for r in cells), default=-1)
    g = np.zeros((d, d))
    for r in cells:
        g[r["i"], r["j"]] = r["s"]
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1], 0))
    return t.spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(values)], "place int, singular_value double")


@query("ml_15_metric_tables", "ML-15", PREDICTIONS + """
, c AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY ALL)
SELECT 'confusion' AS metric, label AS k, prediction AS l, n::DOUBLE AS v FROM c UNION ALL SELECT 'precision', prediction, -1, round(sum(CASE WHEN label = prediction THEN n ELSE 0 END) / sum(n), 6) FROM c GROUP BY 2
UNION ALL SELECT 'recall', label, -1, round(sum(CASE WHEN label = prediction THEN n ELSE 0 END) / sum(n), 6) FROM c GROUP BY 2 UNION ALL SELECT 'explained', -1, -1, round(avg(pow(yhat - (SELECT avg(y) FROM p), 2)), 5) FROM p""")
def metric_tables(t):
    """Class metrics and a regression metric as aggregates over (label, prediction) rows."""
    p = predictions(t)
    c = p.groupBy(F.col("label").cast("long").alias("k"), F.col("prediction").cast("long").alias("l")).agg(F.count("*").alias("n"))
    right = F.sum(F.when(F.col("k") == F.col("l"), F.col("n")).otherwise(0)) / F.sum("n")
    none = F.lit(-1).cast("long")
    confusion = c.select(F.lit("confusion").alias("metric"), "k", "l", F.col("n").cast("double").alias("v"))
    precision = c.groupBy("l").agg(F.round(right, 6).alias("v")).select(F.lit("precision"), "l", none, "v")
    recall = c.groupBy("k").agg(F.round(right, 6).alias("v")).select(F.lit("recall"), "k", none, "v")
    mean = p.agg(F.avg("y").alias("m"))
    explained = p.crossJoin(F.broadcast(mean)).agg(F.round(F.avg(F.pow(F.col("yhat") - F.col("m"), F.lit(2))), 5).alias("v")).select(F.lit("explained"), none, none, "v")
    return confusion.union(precision).union(recall).union(explained)


@query("ml_15_ranking_metrics", "ML-15", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS good FROM orders), k AS (SELECT * FROM r WHERE place <= 5),
x AS (SELECT o_custkey, sum(good) / 5.0 AS p5, sum(good / ln(place + 1)) AS dcg, sum(good) AS hits FROM k GROUP BY 1), y AS (SELECT o_custkey, sum(good) AS relevant FROM r GROUP BY 1)
SELECT round(avg(p5), 6) AS precision_at_5, round(avg(CASE WHEN relevant = 0 THEN 0 ELSE hits / relevant END), 6) AS recall_at_5, round(avg(CASE WHEN relevant = 0 THEN 0 ELSE dcg / (list_sum(list_transform(range(1, least(relevant, 5)::BIGINT + 1), lambda i: 1 / ln(i + 1)))) END), 6) AS ndcg_at_5 FROM x JOIN y USING (o_custkey)""")
def ranking_metrics(t):
    """Ranking metrics at five per customer: the five best orders are kept by the ranked filter, the number of
    relevant ones is an aggregate, so no list of a customer's orders is ever built."""
    good = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", good.alias("good"))
    k = top_per_key(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)
    x = k.groupBy("o_custkey").agg((F.sum("good") / 5).alias("p5"), F.sum(F.col("good") / F.log(F.col("place") + 1)).alias("dcg"), F.sum("good").alias("hits"))
    y = o.groupBy("o_custkey").agg(F.sum("good").alias("relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("relevant"), F.lit(5)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log(i + 1))
    some = F.col("relevant") > 0
    return x.join(y, "o_custkey").agg(F.round(F.avg("p5"), 6).alias("precision_at_5"), F.round(F.avg(F.when(some, F.col("hits") / F.col("relevant")).otherwise(0.0)), 6).alias("recall_at_5"),
                                      F.round(F.avg(F.when(some, F.col("dcg") / ideal).otherwise(0.0)), 6).alias("ndcg_at_5"))


@query("ml_15_auc", "ML-15", PREDICTIONS + """, r AS (SELECT two, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM p)
SELECT round((sum(k) FILTER (two = 1) - count(*) FILTER (two = 1) * (count(*) FILTER (two = 1) + 1) / 2) / (count(*) FILTER (two = 1) * count(*) FILTER (two = 0)), 6) AS auc FROM r""")
def auc(t):
    """Area under the curve from score counts: the rows are reduced to (score, positives, negatives) first."""
    s = predictions(t).groupBy("score").agg(F.sum("two").alias("pos"), F.sum(1 - F.col("two")).alias("neg"))
    r = running(s, [], [F.col("score")], {"below": ("sum", F.col("neg"))})
    return r.agg(F.round(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))
