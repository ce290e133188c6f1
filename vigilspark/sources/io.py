"""Readers and writers of the engine's files. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalogue as cat
from ..session import materialize

MESSAGE = "id string, text string, label int, label_name string, category string, template_id string, risk_entities array<string>, split string, original_label int, source string"
LEVELS = ["SAFE", "SUSPICIOUS", "DANGEROUS"]


def stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_messages(spark: SparkSession, *paths: str) -> DataFrame:
    """Labelled messages from JSON lines; blank lines don't count, and a missing path is an error. The source is the file's name where a row has none."""
    df = spark.read.schema(MESSAGE).json(list(paths))
    return df.withColumn("source", F.coalesce("source", stem())).where(F.col("id").isNotNull() | F.col("text").isNotNull())


def text_and_label(df: DataFrame) -> DataFrame:
    return df.select("text", F.col("label").cast("int").alias("label"))


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """message, label: header, quoted line breaks, byte-order mark."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema("message string, label string").csv(path)
    return df


def convert_csv(df: DataFrame, split: str) -> DataFrame:
    """Records of one split, as read by read_labelled_csv. Ids number the rows before any is dropped, in the order of the files' names and of the rows in them.

    A file with quoted line breaks isn't split, so its rows have running ids within one task; only the files' counts are added up in order.
    """
    parts = materialize(df.withColumn("_p", F.col("_metadata.file_name")).withColumn("_m", F.monotonically_increasing_id()))
    counts = parts.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("low"))
    base = counts.select("_p", "low", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = parts.join(base, "_p").withColumn("n", F.col("base") + F.col("_m") - F.col("low") + 1)
    good = rows.where((F.trim(F.coalesce("message", F.lit(""))) != "") & F.trim("label").isin("0", "1"))
    label = F.when(F.trim("label") == "1", 2).otherwise(0)
    return good.select(
        F.format_string(f"EXT_VISMS_{split.upper()}_%05d", "n").alias("id"), tx.rehydrate(F.trim("message")).alias("text"), label.alias("label"), F.when(label == 2, "DANGEROUS").otherwise("SAFE").alias("label_name"),
        F.lit("EXTERNAL_SMS").alias("category"), F.lit(split).alias("split"), F.trim("label").cast("int").alias("original_label"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_blocklist(spark: SparkSession, path: str | None) -> DataFrame:
    """domain; an absent file is an empty list."""
    empty = spark.createDataFrame([], "domain string")
    if path is None or not exists(spark, path):
        return empty
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("v")).where((F.col("v") != "") & ~F.startswith("v", F.lit("#")))
    return lines.select(F.regexp_replace("v", r"^\.+", "").alias("domain"))


def write_messages(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def metadata(df: DataFrame, title: str, licence: str) -> DataFrame:
    counts = df.groupBy("label_name").agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("records"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label_name", "n")))).alias("labels")).select(F.lit(title).alias("title"), F.lit(licence).alias("licence"), "records", "labels")


def write_blocklist(df: DataFrame, path: str) -> None:
    """Text files, sorted within and by name, below a header in the first."""
    header = df.sparkSession.createDataFrame([("# blocked domains",), ("# one for each line",)], "value string").withColumn("o", F.lit(0))
    rows = header.unionByName(df.select(F.col("domain").alias("value"), F.lit(1).alias("o")))
    rows.repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def blocklist_info(df: DataFrame) -> tuple[int, list[str]]:
    return df.count(), [r["domain"] for r in df.orderBy("domain").limit(5).collect()]


def dims(spark: SparkSession) -> dict[str, DataFrame]:
    """The engine's knowledge as tables."""
    one = lambda values: spark.createDataFrame([(v,) for v in values], "value string")
    return {
        "rules": spark.createDataFrame([(r.ord, r.rule_id, r.signal, r.category, r.weight, r.reason, "H" in r.flags, "A" in r.flags, "S" in r.flags) for r in cat.RULES], "ord int, rule_id string, signal string, category string, weight double, reason string, hard_danger boolean, amplifier boolean, standalone boolean"),
        "rule_patterns": spark.createDataFrame([(r.rule_id, n, p) for r in cat.RULES for n, p in enumerate(r.patterns)], "rule_id string, pos int, pattern string"),
        "combos": spark.createDataFrame([tuple(c) for c in cat.COMBOS], "combo_id string, requires array<array<string>>, category string, boost double, hard boolean, names_category boolean, reason string"),
        "suppressions": spark.createDataFrame(cat.SUPPRESS, "trigger string, target string"),
        "categories": spark.createDataFrame([(c, cat.TITLES[c], p) for c, p in cat.PRIORITY.items()], "category string, title string, priority int"),
        "official": one(cat.OFFICIAL), "brands": one(cat.BRANDS), "risky_tlds": one(cat.RISKY_TLDS), "suffixes": one(cat.SUFFIXES), "shorteners": one(cat.SHORTENERS), "never_block": one(cat.NEVER_BLOCK),
        "datasets": spark.createDataFrame([("vi_sms", "labelled SMS, landed as CSV", "as published"), ("generated", "synthesised messages", "own")], "name string, title string, licence string"),
    }


def knowledge(tables: dict[str, DataFrame], most: int = 10_000) -> cat.Knowledge:
    """Rules, combinations and suppressions from tables like those of dims(). They become expressions of a plan, so they are few: more than `most` patterns are an error, as are
    repeated ids, patterns of unknown rules, unknown signals, weights outside 0 to 1, and patterns that Java can't compile.
    """
    rules = tables["rules"].orderBy("ord").limit(most + 1).collect()
    patterns = tables["rule_patterns"].orderBy("rule_id", "pos").limit(most + 1).collect()
    combos, suppressions = (tables[k].limit(most + 1).collect() for k in ("combos", "suppressions"))
    spark = tables["rules"].sparkSession
    ids = [r["rule_id"] for r in rules]
    wrong = [i for i in ids if ids.count(i) > 1] + [p["rule_id"] for p in patterns if p["rule_id"] not in ids] + [r["rule_id"] for r in rules if r["signal"] not in cat.SIGNALS or not 0 <= r["weight"] <= 1]
    wrong += [i for i in ids if all(p["rule_id"] != i for p in patterns)]
    if wrong or max(len(rules), len(patterns), len(combos), len(suppressions)) > most:
        raise ValueError(f"rules that can't be used: {sorted(set(wrong)) or 'too many'}")
    compiler = spark._jvm.java.util.regex.Pattern
    for p in patterns:
        compiler.compile("(?U)" + p["pattern"])
    flags = lambda r: "".join(f for f, k in (("H", "hard_danger"), ("A", "amplifier"), ("S", "standalone")) if r[k])
    of = lambda i: tuple(p["pattern"] for p in patterns if p["rule_id"] == i)
    return cat.Knowledge(
        [cat.Rule(r["ord"], r["rule_id"], r["signal"], r["category"], r["weight"], flags(r), r["reason"], of(r["rule_id"])) for r in rules],
        [(c["combo_id"], [list(g) for g in c["requires"]], c["category"], c["boost"], c["hard"], c["names_category"], c["reason"]) for c in combos], [(x["trigger"], x["target"]) for x in suppressions],
    )


def export_knowledge(spark: SparkSession, folder: str, blocklist: DataFrame | None = None, most: int = 20_000) -> None:
    """Every table as Parquet; of the blocklist the first `most` in order (the limit is the feature)."""
    for name, df in dims(spark).items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    if blocklist is not None:
        blocklist.orderBy("domain").limit(most).write.mode("overwrite").parquet(f"{folder}/blocklist")
