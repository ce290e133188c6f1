"""The linear model over TF-IDF terms, kept as tables: a dictionary of terms with their idf and coefficients, and intercepts.

Terms are counted in their rows, so only distinct terms of a message become rows of their own. The dictionary is numbered without
a gap by counts of buckets; no list of terms is ever in the driver. Sparse vectors are built of arrays and written as
Spark ML's vector type, so the fit needs no Python. Spark ML holds the coefficients of all classes in the driver while it fits (24 bytes for each
term with three classes, `most_terms` bounds it); they leave it as a table. Scoring is a join of a message's terms with the dictionary and a sum: terms are joined by broadcast only
while the dictionary has at most `SMALL` terms. Beyond, terms in a thousandth of all messages or more - at most a thousand times as many as a message has terms - are
joined by broadcast and the others by their hash, so no common term is a task of its own.

Null text: no terms and no score (ml is null). A text without a known term is judged by the intercepts. Repeated rows count each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as tx
from ..session import materialize, shared_folder
from .features import char_terms, word_terms

BLOCKS = {"word": 1, "char": 2}  # least document frequency
WEIGHTS = {0: 1.0, 1: 1.2, 2: 1.6}
SMALL = 500_000
COMMON = 1000
BUCKETS = 256


@dataclass(frozen=True)
class Tables:
    """terms: block, term, idx, df, idf, coefficients (array by class). intercepts: class, intercept. facts: n (rows of the fit), classes."""

    terms: DataFrame
    intercepts: DataFrame
    facts: DataFrame

    def save(self, path: str) -> None:
        for name in ("terms", "intercepts", "facts"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Tables | None:
    """The tables of a saved model; None where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/facts/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return Tables(*[spark.read.parquet(f"{path}/{name}") for name in ("terms", "intercepts", "facts")])


def counted(terms: Column) -> Column:
    """array<struct<term, tf>> of an array of terms: sorted, equal neighbours counted."""

    def runs(s: Column) -> Column:
        places = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return tx.let(places, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).cast("long").alias("tf"))))

    return tx.let(F.array_sort(terms), runs)


MAKE = {"word": word_terms, "char": char_terms}


def term_rows(df: DataFrame, key: str, normal: str = "normal", *carried: str, blocks: tuple[str, ...] = tuple(MAKE)) -> DataFrame:
    """(key, carried..., block, term, tf): a row for each distinct term of a text."""
    each = [_tagged(counted(MAKE[block](F.col(normal))), block) for block in blocks]
    return df.where(F.col(normal).isNotNull()).select(key, *carried, F.explode(F.concat(*each)).alias("t")).select(key, *carried, "t.*")


def _tagged(counts: Column, block: str) -> Column:
    return F.transform(counts, lambda x: F.struct(F.lit(block).alias("block"), x["term"].alias("term"), x["tf"].alias("tf")))


def numbered(terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """terms (block, term, ...) with idx from 0 without a gap: a number within its bucket, and the sizes of the buckets before."""
    dealt = materialize(terms.withColumn("_bucket", F.pmod(F.xxhash64("block", "term"), buckets).cast("int")))
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("n"))  # at most `buckets` rows
    before = sizes.select("_bucket", F.coalesce(F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("block", "term")) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_bucket").withColumn("idx", (F.col("_before") + F.col("_own")).cast("int")).drop("_bucket", "_own", "_before")


def with_terms(rows: DataFrame, terms: DataFrame, n: int, small: int = SMALL) -> DataFrame:
    """rows (block, term, ...) with what the dictionary says of their terms. See the module on how they meet."""
    if terms.count() <= small:
        return rows.join(F.broadcast(terms), ["block", "term"])
    often = terms.where(F.col("df") >= max(2, n // COMMON))
    rest = rows.join(F.broadcast(often.select("block", "term")), ["block", "term"], "left_anti")
    return rows.join(F.broadcast(often), ["block", "term"]).unionByName(rest.join(terms.where(F.col("df") < max(2, n // COMMON)), ["block", "term"]))


def dictionary(rows: DataFrame, n: int, copies: str = "copies") -> DataFrame:
    """block, term, df, idf, idx, of rows (block, term, copies). Terms in fewer messages than their block asks for are left out."""
    least = F.create_map(*[F.lit(x) for p in BLOCKS.items() for x in p])[F.col("block")]
    found = rows.groupBy("block", "term").agg(F.sum(copies).alias("df")).where(F.col("df") >= least)
    return numbered(found.withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))


def raw_weight() -> Column:
    return (1 + F.log(F.col("tf"))) * F.col("idf")


def vectors(rows: DataFrame, key: str, size: int) -> DataFrame:
    """key, indices, values: the weights of a text's known terms, each block of length 1."""
    part = F.sum(F.when(F.col("block") == "word", F.col("raw") * F.col("raw")).otherwise(0.0))
    other = F.sum(F.when(F.col("block") == "char", F.col("raw") * F.col("raw")).otherwise(0.0))
    every = rows.withColumn("raw", raw_weight()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "raw", "block"))).alias("v"), F.sqrt(part).alias("word"), F.sqrt(other).alias("char"))
    return every.select(key, F.transform("v", lambda x: x["idx"]).alias("indices"), F.transform("v", lambda x: x["raw"] / F.when(x["block"] == "word", F.col("word")).otherwise(F.col("char"))).alias("values"))


def as_vectors(df: DataFrame, size: int) -> DataFrame:
    """label, weight and the sparse vector of indices and values: written as the vector type is stored, and read as that type."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), none("indices", "array<int>").alias("indices"), none("values", "array<double>").alias("values"))
    df.select("label", "weight", parts.alias("features")).write.parquet(path)
    return spark.read.schema(StructType([StructField("label", DoubleType()), StructField("weight", DoubleType()), StructField("features", VectorUDT())])).parquet(path)


def classifier(n_rows: float, iterations: int = 2000, c: float = 4.0, tolerance: float = 1e-4) -> LogisticRegression:
    """Logistic regression with weights by class; C as the inverse of the penalty. It ends when a step changes the loss by less than `tolerance`, or after `iterations`."""
    return LogisticRegression(labelCol="label", weightCol="weight", maxIter=iterations, tol=tolerance, regParam=1.0 / (c * max(1.0, n_rows)), elasticNetParam=0.0, standardization=False, family="multinomial")


def coefficients(model: LogisticRegressionModel, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(idx, coefficients by class) and (class, intercept) of a fitted model, as Spark ML writes it: its numbers don't pass through Python."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    vector, matrix = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>", "struct<type: tinyint, numRows: int, numCols: int, colPtrs: array<int>, rowIndices: array<int>, values: array<double>, isTransposed: boolean>"
    data = spark.read.schema(f"numClasses int, numFeatures int, interceptVector {vector}, coefficientMatrix {matrix}, isMultinomial boolean").parquet(f"{path}/data")
    m, k = F.col("coefficientMatrix"), F.col("numClasses")
    dense = data.where("coefficientMatrix.type = 1").select("numClasses", "numFeatures", m["isTransposed"].alias("by_class"), F.posexplode(m["values"]).alias("at", "value"))
    dense = dense.select(
        F.when(F.col("by_class"), F.col("at") % F.col("numFeatures")).otherwise(F.floor(F.col("at") / k)).cast("int").alias("idx"),
        F.when(F.col("by_class"), F.floor(F.col("at") / F.col("numFeatures"))).otherwise(F.col("at") % k).cast("int").alias("class"), "value",
    )
    # a sparse matrix: the numbers of a column, or of a row where it is transposed, lie between two pointers
    each = data.where("coefficientMatrix.type = 0").select("coefficientMatrix", F.posexplode(F.slice(m["colPtrs"], F.lit(1), F.size(m["colPtrs"]) - 1)).alias("line", "low"))
    high = F.get(m["colPtrs"], F.col("line") + 1)
    each = each.where(high > F.col("low")).select("coefficientMatrix", "line", F.explode(F.sequence(F.col("low"), high - 1)).alias("at"))
    other = F.get(m["rowIndices"], F.col("at"))
    sparse = each.select(F.when(m["isTransposed"], other).otherwise(F.col("line")).alias("idx"), F.when(m["isTransposed"], F.col("line")).otherwise(other).alias("class"), F.get(m["values"], F.col("at")).alias("value"))
    long = dense.unionByName(sparse)
    at = lambda n: F.coalesce(F.max(F.when(F.col("class") == n, F.col("value"))), F.lit(0.0))
    wide = long.groupBy("idx").agg(F.array(*[at(n) for n in range(3)]).alias("coefficients"))
    v = F.col("interceptVector")
    full = F.when(v["type"] == 1, v["values"]).otherwise(F.transform(F.sequence(F.lit(0), v["size"] - 1), lambda i: F.coalesce(F.get(v["values"], F.array_position(v["indices"], i).cast("int") - 1), F.lit(0.0))))
    return wide, data.select(F.posexplode(full).alias("class", "intercept"))


def dealt(df: DataFrame) -> DataFrame:
    """Rows on all configured partitions: few bytes of text are much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fit_rows(df: DataFrame, most_terms: int = 50_000_000) -> tuple[DataFrame, DataFrame, int, float]:
    """(label, weight, features) of distinct texts, the dictionary, the number of rows and the sum of their weights. Equal texts are one row with a weight."""
    label = F.col("label").cast("int")
    counts = [F.count("*").alias("copies"), *[F.count_if(label == k).alias(f"n{k}") for k in WEIGHTS]]
    written = materialize(df.where(F.col("text").isNotNull() & label.isNotNull()).groupBy("text").agg(*counts))  # folding is dear, so copies go first
    normal = dealt(written).withColumn("normal", tx.for_model(F.col("text")))
    texts = normal.groupBy("normal").agg(*[F.sum(c).alias(c) for c in ("copies", *[f"n{k}" for k in WEIGHTS])])
    texts = dealt(texts).withColumn("key", F.monotonically_increasing_id())
    texts = materialize(texts)
    total = texts.agg(F.sum("copies").alias("n"), *[F.sum(f"n{k}").alias(f"n{k}") for k in WEIGHTS]).first()
    n = total["n"] or 0
    rows = materialize(term_rows(texts, "key", "normal", "copies"))
    terms = materialize(dictionary(rows, n))
    size = terms.count()
    if not 0 < size <= most_terms:
        raise ValueError(f"{size} terms; a fit holds the coefficients of 1 to {most_terms} in the driver")
    made = vectors(with_terms(rows, terms, n), "key", size)
    labels = F.array(*[F.struct(F.lit(float(k)).alias("label"), (F.col(f"n{k}") * w).alias("weight")) for k, w in WEIGHTS.items()])
    ready = texts.join(made, "key", "left").select("indices", "values", F.explode(F.filter(labels, lambda x: x["weight"] > 0)).alias("l")).select("l.label", "l.weight", "indices", "values")
    return as_vectors(ready, size), terms, n, sum((total[f"n{k}"] or 0) * w for k, w in WEIGHTS.items())


def train(df: DataFrame) -> Tables:
    """df: text, label."""
    spark = df.sparkSession
    ready, terms, n, weight = fit_rows(df)
    return as_tables(classifier(weight).fit(ready), terms, n, spark)


def as_tables(model: LogisticRegressionModel, terms: DataFrame, n: int, spark: SparkSession) -> Tables:
    wide, intercepts = coefficients(model, spark)
    none = F.array(*[F.lit(0.0)] * 3)
    known = materialize(terms.join(wide, "idx", "left").withColumn("coefficients", F.coalesce("coefficients", none)))
    return Tables(known, materialize(intercepts), spark.createDataFrame([(n, model.numClasses)], "n long, classes int"))


def predict(model: Tables, df: DataFrame, text: str = "text", small: int = SMALL) -> DataFrame:
    """df with ml: struct<safe, suspicious, dangerous>, and ml_class; both null for a null text."""
    kept = [c for c in df.columns if c not in ("ml", "ml_class")]
    keyed = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), tx.for_model(F.col(text)).alias("_normal")))
    # equal texts are scored once
    texts = materialize(dealt(keyed.where(F.col("_normal").isNotNull()).groupBy("_normal").agg(F.count("*").alias("_copies"))).withColumn("_key", F.monotonically_increasing_id()))
    facts = model.facts.first()
    rows = with_terms(term_rows(texts, "_key", "_normal"), model.terms, facts["n"], small).withColumn("raw", raw_weight())
    if_block = lambda b, x: F.sum(F.when(F.col("block") == b, x).otherwise(0.0))
    sums = rows.groupBy("_key").agg(
        *[if_block(b, F.col("raw") * F.col("raw")).alias(f"l_{b}") for b in BLOCKS], *[if_block(b, F.col("raw") * F.col("coefficients")[k]).alias(f"m_{b}_{k}") for b in BLOCKS for k in range(facts["classes"])]
    )
    start = {r["class"]: r["intercept"] for r in model.intercepts.collect()}  # one row for each class

    def margin(k: int) -> Column:
        out = F.lit(start[k])
        for b in BLOCKS:
            out = out + F.coalesce(F.try_divide(F.col(f"m_{b}_{k}"), F.sqrt(f"l_{b}")), F.lit(0.0))
        return out

    scored = texts.join(sums, "_key", "left").withColumn("_z", F.array(*[margin(k) for k in range(facts["classes"])]))
    scored = scored.withColumn("_e", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))))
    share = lambda k: F.get("_e", F.lit(k)) / F.aggregate("_e", F.lit(0.0), lambda a, x: a + x) if k < facts["classes"] else F.lit(0.0)
    ml = F.struct(share(0).alias("safe"), share(1).alias("suspicious"), share(2).alias("dangerous"))
    best = F.array_position("_z", F.array_max("_z")).cast("int") - 1
    scored = materialize(scored.select("_normal", "_copies", ml.alias("ml"), best.alias("ml_class")))
    return given_back(keyed, scored, small).select(*[F.col(f"_row.`{c}`") for c in kept], "ml", "ml_class")


def given_back(keyed: DataFrame, scored: DataFrame, small: int) -> DataFrame:
    """Rows with the scores of their text, null where it is null. As with terms: by broadcast below a counted size; beyond it texts with a thousandth of all rows are, and the others by hash."""
    total = scored.agg(F.count("*").alias("texts"), F.sum("_copies").alias("rows")).first()
    if total["texts"] <= small:
        return keyed.join(F.broadcast(scored), "_normal", "left")
    often = scored.where(F.col("_copies") * COMMON >= (total["rows"] or 0))
    rest = keyed.join(F.broadcast(often.select("_normal")), "_normal", "left_anti").join(scored.where(F.col("_copies") * COMMON < (total["rows"] or 0)), "_normal", "left")
    return keyed.join(F.broadcast(often), "_normal").unionByName(rest)


def log_odds(df: DataFrame, blocks: tuple[str, ...] = tuple(MAKE)) -> Tables:
    """A model by counts alone, without a fit: a coefficient is ln((1 + messages of the class with the term) / (3 + messages with it)), an intercept the same of all messages."""
    labels = F.col("label")
    rows = materialize(df.where(F.col("text").isNotNull() & labels.isNotNull()).select(F.monotonically_increasing_id().alias("key"), tx.for_model(F.col("text")).alias("normal"), labels.cast("int").alias("label")))
    count = [F.count_if(labels == k).alias(f"n{k}") for k in WEIGHTS]
    whole = rows.agg(F.count("*").alias("n"), *count)
    n = whole.first()["n"]
    least = F.create_map(*[F.lit(x) for p in BLOCKS.items() for x in p])[F.col("block")]
    found = term_rows(rows, "key", "normal", "label", blocks=blocks).groupBy("block", "term").agg(F.count("*").alias("df"), *count).where(F.col("df") >= least)
    terms = numbered(found.withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).withColumn("coefficients", F.array(*[F.log((1 + F.col(f"n{k}")) / (3 + F.col("df"))) for k in WEIGHTS])))
    intercepts = whole.select(F.posexplode(F.array(*[F.log((1 + F.col(f"n{k}")) / (3 + F.col("n"))) for k in WEIGHTS])).alias("class", "intercept"))
    return Tables(materialize(terms.drop(*[f"n{k}" for k in WEIGHTS])), materialize(intercepts), df.sparkSession.createDataFrame([(n, len(WEIGHTS))], "n long, classes int"))


def cross_fitted(df: DataFrame, fold: Column, folds: int, fit: Callable[[DataFrame], Tables] | None = None) -> DataFrame:
    """df with ml and ml_class, each from a model that saw no row of its fold (0 to folds - 1): a fold holds whole groups, so no message is judged by its like."""
    fit = fit or train
    dealt = materialize(df.withColumn("_fold", fold))
    parts = [predict(fit(dealt.where(F.col("_fold") != k)), dealt.where(F.col("_fold") == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_fold")


def six_digits(c: Column) -> Column:
    digits = 6 - F.ceil(F.log10(F.abs(c))).cast("int")
    return F.when(c == 0, 0.0).otherwise(F.round(c * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits))


def export(model: Tables) -> dict[str, DataFrame]:
    """The model to six significant digits: terms (block, term, idx, df, idf), weights (idx, class, weight), intercepts (class, intercept)."""
    return {
        "terms": model.terms.select("block", "term", "idx", "df", six_digits(F.col("idf")).alias("idf")),
        "weights": model.terms.select("idx", F.posexplode("coefficients").alias("class", "w")).select("idx", "class", six_digits(F.col("w")).alias("weight")),
        "intercepts": model.intercepts.select("class", six_digits(F.col("intercept")).alias("intercept")),
    }
