"""Rule scan, gates, fusion and explanation. One row-local pipeline without a shuffle, unless links are judged by a blocklist table; each step is a projection of its own, so that its result is computed once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import links as lk
from ..functions import text as tx
from ..session import materialize, shared_folder
from . import catalogue as cat
from . import literals

HIT = "struct<ord: int, rule_id: string, signal: string, category: string, weight: double, hard: boolean, amplifier: boolean, standalone: boolean, reason: string, phrases: array<string>>"
SMALL = 50_000  # judged texts that are joined by broadcast
COMMON = 1000  # beyond, texts in a thousandth of all rows are
EACH = 20_000  # texts of a task


def by_text(df: DataFrame, judge: Callable[[DataFrame], DataFrame], *columns: str, text: str = "text", small: int = SMALL) -> DataFrame:
    """Rows of df with `columns`, which judge(texts) adds to their text. Equal texts are judged once, so copies of a message cost a join only.

    judge must keep the columns of its input; it may leave out texts (their rows go too) or give several rows for one. Null texts are left out. Texts are dealt to
    tasks by their number, whatever the files are. They meet the rows by broadcast below a counted size; beyond it common texts do, and the others by hash.
    """
    rows = materialize(df)
    texts = materialize(rows.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("_copies")))
    total = texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows")).first()
    parts = max(df.sparkSession.sparkContext.defaultParallelism, total["texts"] // EACH)
    judged = materialize(judge(texts.repartition(parts, text)).select(text, "_copies", *columns))
    if judged.count() <= small:
        return rows.join(F.broadcast(judged.drop("_copies")), text)
    common = F.col("_copies") * COMMON >= total["rows"]
    often, seldom = judged.where(common).drop("_copies"), judged.where(~common).drop("_copies")
    rest = rows.join(F.broadcast(often.select(text)), text, "left_anti")
    return rows.join(F.broadcast(often), text).unionByName(rest.join(seldom, text))


def prepare(df: DataFrame, text: str = "text", keep_bad: bool = False) -> DataFrame:
    """Adds m (text that rules are matched on), d (the same places as written) and error_code. Rows that can't be judged (null, blank, too long) are left out; `quarantine` has them."""
    t = tx.strip(F.col(text))
    df = df.withColumn("error_code", tx.error_code(F.col(text)))
    df = df if keep_bad else df.where(F.col("error_code").isNull())
    return df.withColumn("m", tx.deleet(tx.fold(t))).withColumn("d", tx.display(t))


def quarantine(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Good rows, bad rows with their error_code, and how many there are of each code (OK: good ones).

    The input is read once: rows are written by their code, counts are observed on the way, and each part is read back.
    """
    spark = df.sparkSession
    seen = Observation()
    codes = ["EMPTY", "TOO_LONG"]
    checked = df.withColumn("error_code", tx.error_code(F.col(text)))
    counts = [F.count_if(F.col("error_code").isNull()).alias("OK"), *[F.count_if(F.col("error_code") == c).alias(c) for c in codes]]
    path = f"{shared_folder(spark)}/checked-{uuid.uuid4().hex}"
    checked.observe(seen, *counts).withColumn("_part", F.coalesce("error_code", F.lit("OK"))).write.partitionBy("_part").parquet(path)
    whole = spark.read.schema(StructType([*checked.schema.fields, StructField("_part", StringType())])).parquet(path)
    return whole.where("_part = 'OK'").drop("_part", "error_code"), whole.where("_part <> 'OK'").drop("_part"), {k: int(v) for k, v in seen.get.items()}


def scan(df: DataFrame, rules: list[cat.Rule] = cat.RULES) -> DataFrame:
    """Adds rule_hits: every rule that matches, in the order of the catalogue, with the distinct phrases as written.

    Words that a rule can't match without are sought for all rules at once; only rules that have one run their expressions, which
    are literal patterns, compiled once. Matches are marked in the text, so each pattern of such a rule reads it once.
    """
    m, d = F.col("m"), F.col("d")
    needed = [literals.words(r.patterns) for r in rules]
    wanted = sorted(set().union(*[n for n in needed if n]))
    df = df.withColumn("_words", literals.present(m, wanted))
    found = []
    for n, r in enumerate(rules):
        matches = m.rlike("(?U)" + "|".join(f"(?:{p})" for p in r.patterns))
        if needed[n] is not None:
            matches = F.arrays_overlap("_words", F.lit(sorted(needed[n]))) & matches
        found.append(F.when(matches, F.struct(F.lit(n).alias("n"), F.array(*[tx.marked(m, p) for p in r.patterns]).alias("marked"))))
    df = df.withColumn("_found", F.array_compact(F.array(*found))).drop("_words")
    column = lambda name, values: F.lit(values).alias(name)
    table = F.arrays_zip(
        column("ord", [r.ord for r in rules]), column("rule_id", [r.rule_id for r in rules]), column("signal", [r.signal for r in rules]), column("category", [r.category for r in rules]), column("weight", [r.weight for r in rules]),
        column("hard", ["H" in r.flags for r in rules]), column("amplifier", ["A" in r.flags for r in rules]), column("standalone", ["S" in r.flags for r in rules]), column("reason", [r.reason for r in rules]),
    )
    plain = [x.split(":")[0].strip() for x in HIT[7:-1].split(", ")][:-1]
    phrases = lambda x: tx.distinct_ignoring_case(F.flatten(F.transform(x["marked"], lambda t: tx.between_marks(t, d))))
    hit = lambda x: tx.let(F.get(table, x["n"]), lambda r: F.struct(*[r[k].alias(k) for k in plain], phrases(x).alias("phrases")))
    return df.withColumn("rule_hits", F.transform("_found", hit)).drop("_found")


def as_hits(found: Column, rules: int = len(cat.RULES)) -> Column:
    """Hits of array<struct<url, rule>>, in order."""
    info = F.create_map(*[x for k, (w, h, s, why) in cat.LINK_RULES.items() for x in (F.lit(k), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(s).alias("s"), F.lit(why).alias("why")))])
    of = lambda x: info[x["rule"]]
    return F.transform(
        found,
        lambda x, i: F.struct(
            (F.lit(rules + 1) + i).alias("ord"), x["rule"].alias("rule_id"), F.lit("LINK").alias("signal"), F.lit("PHISHING_LINK").alias("category"), of(x)["w"].alias("weight"), of(x)["h"].alias("hard"),
            F.lit(False).alias("amplifier"), of(x)["s"].alias("standalone"), of(x)["why"].alias("reason"), F.array(x["url"]).alias("phrases"),
        ),
    )


def scan_links(df: DataFrame, text: str = "text", blocked: list[str] | DataFrame = cat.BLOCKED) -> DataFrame:
    """Adds link_hits: for each link in order its rule, and one for a file. blocked: a short list, or a table (domain) of any size."""
    if isinstance(blocked, DataFrame):
        return scan_links_by_host(df, blocked, text)
    df = df.withColumn("_urls", lk.urls(F.col(text)))
    df = df.withColumn("_lr", F.flatten(F.transform("_urls", lambda u: F.transform(lk.in_row(u, blocked), lambda r: F.struct(u.alias("url"), r.alias("rule"))))))
    return df.withColumn("link_hits", as_hits(F.col("_lr"))).drop("_lr", "_urls")


def scan_links_by_host(df: DataFrame, blocked: DataFrame, text: str = "text", small: int = lk.SMALL) -> DataFrame:
    """The same with a blocklist table. Links leave their message with their place, distinct hosts are judged once, and the verdicts come back in order.

    Rows are written once with a key, so that all that came before isn't computed for the links and again for the messages.
    """
    kept = [c for c in df.columns if c != "link_hits"]
    keyed = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.monotonically_increasing_id().alias("_key"), lk.urls(F.col(text)).alias("_urls")))
    links = keyed.select("_key", F.posexplode("_urls").alias("pos", "url")).withColumn("host", lk.host_of(F.col("url")))
    rules = lk.rules_by_host(links, blocked, small).withColumn("rules", lk.with_download(F.col("url"), F.col("rule")))
    found = rules.select("_key", "pos", F.transform("rules", lambda r: F.struct(F.col("url").alias("url"), r.alias("rule"))).alias("found"))
    each = found.groupBy("_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "found"))), lambda x: x["found"])).alias("_lr"))
    none = F.array().cast("array<struct<url: string, rule: string>>")
    return keyed.join(each, "_key", "left").select(*[F.col(f"_row.`{c}`") for c in kept], as_hits(F.coalesce("_lr", none)).alias("link_hits"))


def gates(df: DataFrame, combinations: list[tuple] = cat.COMBOS, suppress: list[tuple[str, str]] = cat.SUPPRESS) -> DataFrame:
    """Adds hits, safe, risk, signals, combos: suppression, split by signal, the amplifier gate, active signals, matched combinations."""
    df = df.withColumn("hits", F.concat("rule_hits", "link_hits"))
    ids = F.transform("hits", lambda h: h["rule_id"])
    dropped = F.array_compact(F.array(*[F.when(F.array_contains(ids, a), F.lit(b)) for a, b in suppress]))
    df = df.withColumn("hits", F.filter("hits", lambda h: ~F.array_contains(dropped, h["rule_id"])))
    df = df.withColumn("safe", F.filter("hits", lambda h: h["signal"] == "SAFE")).withColumn("risk", F.filter("hits", lambda h: h["signal"] != "SAFE"))
    df = df.withColumn("risk", F.when(F.exists("risk", lambda h: ~h["amplifier"]), F.col("risk")).otherwise(F.array().cast(f"array<{HIT}>")))
    df = df.withColumn("signals", F.array_sort(F.array_distinct(F.transform("risk", lambda h: h["signal"]))))
    each = []
    for cid, groups, category, boost, hard, names, why in combinations:
        good = F.lit(True)
        for g in groups:
            good = good & F.arrays_overlap(F.col("signals"), F.lit(g))
        each.append(F.when(good, F.struct(F.lit(cid).alias("combo_id"), F.lit(category).alias("category"), F.lit(boost).alias("boost"), F.lit(hard).alias("hard"), F.lit(names).alias("names"), F.lit(why).alias("reason"))))
    return df.withColumn("combos", F.array_compact(F.array(*each)))


def matched(df: DataFrame, text: str = "text", blocked: list[str] | DataFrame = cat.BLOCKED, knowledge: cat.Knowledge | None = None) -> DataFrame:
    """All up to the gates: what is found in rows that can be judged, before it is fused."""
    k = knowledge or cat.Knowledge(cat.RULES, cat.COMBOS, cat.SUPPRESS)
    return gates(scan_links(scan(prepare(df, text), k.rules), text, blocked), k.combos, k.suppress)


def noisy_or(weights: Column) -> Column:
    return 1 - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), w))))


def fuse(df: DataFrame, ml: str | None = None, external: str | None = None) -> DataFrame:
    """Adds rule_score, hard, safe_score, score and level. ml, external: columns of struct<safe, suspicious, dangerous>, nullable."""
    df = df.withColumn("r", noisy_or(F.concat(F.transform("risk", lambda h: h["weight"]), F.transform("combos", lambda c: c["boost"]))))
    weak = (F.size("combos") == 0) & ~F.arrays_overlap(F.col("signals"), F.lit(cat.STANDALONE)) & ~F.exists("risk", lambda h: h["standalone"])
    df = df.withColumn("r", F.when(weak, F.least(F.col("r"), F.lit(0.53))).otherwise(F.col("r")))
    df = df.withColumn("hard", F.exists("risk", lambda h: h["hard"]) | F.exists("combos", lambda c: c["hard"]))
    df = df.withColumn("safe_score", noisy_or(F.transform("safe", lambda h: h["weight"])))
    s, r = F.col("safe_score"), F.col("r")
    damped = r * (1 - 0.5 * F.least(F.lit(0.6), s))
    damped = F.when(s >= 0.4, F.least(damped, F.lit(0.56))).otherwise(damped)
    only = (F.size("combos") == 0) & (F.size("signals") > 0) & (F.size(F.array_except("signals", F.lit(["IMPERSONATION"]))) == 0)
    damped = F.when(only, F.least(damped, F.lit(0.24))).otherwise(damped)
    df = df.withColumn("rule_score", F.when((s > 0) & ~F.col("hard"), damped).otherwise(r))
    layers = [(F.col(c), w) for c, w in ((ml, cat.W_ML), (external, cat.W_EXTERNAL)) if c]
    top, bottom, safest = F.lit(cat.W_RULES) * F.col("rule_score"), F.lit(cat.W_RULES), []
    for p, w in layers:
        risk = p["dangerous"] + 0.45 * p["suspicious"]
        top, bottom = top + F.when(p.isNotNull(), w * risk).otherwise(0.0), bottom + F.when(p.isNotNull(), w).otherwise(0.0)
        safest.append(p["safe"])
    f = F.when(bottom > cat.W_RULES, top / bottom).otherwise(F.col("rule_score")) if layers else F.col("rule_score")
    for p, _ in layers:
        f = F.when(p["dangerous"] >= 0.8, F.greatest(f, F.lit(0.31))).when(p["suspicious"] >= 0.6, F.greatest(f, F.lit(0.26))).otherwise(f)
    if safest:
        least = safest[0] if len(safest) == 1 else F.least(*safest)
        f = F.when(~F.col("hard") & (least >= 0.8), f * 0.4).otherwise(f)
    f = F.when(F.col("hard"), F.greatest(f, F.lit(0.85))).otherwise(f)
    df = df.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), f)), 4))
    return df.withColumn("level", F.when(F.col("score") >= cat.DANGEROUS, "DANGEROUS").when(F.col("score") >= cat.SUSPICIOUS, "SUSPICIOUS").otherwise("SAFE")).drop("r")


def priority(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in cat.PRIORITY.items() for x in p])[c]


def explain(df: DataFrame) -> DataFrame:
    """Adds chosen (category), evidence, highlights, confidence, explanation, summary, badge, matched_rules."""
    named = F.concat(
        F.transform(F.filter("risk", lambda h: h["category"] != "SAFE"), lambda h: F.struct(h["category"].alias("category"), h["weight"].alias("weight"), h["hard"].alias("hard"))),
        F.transform(F.filter("combos", lambda c: c["names"]), lambda c: F.struct(c["category"].alias("category"), c["boost"].alias("weight"), c["hard"].alias("hard"))),
    )
    df = df.withColumn("_named", named)
    kinds = F.array_distinct(F.transform("_named", lambda x: x["category"]))
    total = lambda c: F.aggregate(F.filter("_named", lambda x: x["category"] == c), F.lit(0.0), lambda a, x: a + x["weight"])
    hard = F.array_max(F.transform(F.filter("_named", lambda x: x["hard"]), lambda x: F.struct(priority(x["category"]).alias("p"), x["category"].alias("c"))))["c"]
    best = F.array_max(F.transform(kinds, lambda c: F.struct(F.round(total(c), 9).alias("s"), priority(c).alias("p"), c.alias("c"))))["c"]
    df = df.withColumn("chosen", F.when(F.col("level") == "SAFE", "SAFE").otherwise(F.coalesce(hard, best, F.lit("SAFE")))).drop("_named")
    ordered = F.array_sort(F.transform("risk", lambda h, i: F.struct((-(h["category"] == F.col("chosen")).cast("int")).alias("a"), (-h["hard"].cast("int")).alias("b"), (-h["weight"]).alias("c"), i.alias("i"), h["phrases"][0].alias("phrase"), h["reason"].alias("reason"), h["rule_id"].alias("rule_id"))))
    df = df.withColumn("_ordered", ordered)
    low = F.transform("_ordered", lambda x: F.lower(x["phrase"]))
    df = df.withColumn("_ordered", F.filter("_ordered", lambda x, i: F.array_position(low, F.lower(x["phrase"])) == i + 1))
    rules = F.transform(F.slice("_ordered", 1, 5), lambda x: F.struct(x["phrase"].alias("phrase"), x["reason"].alias("reason"), x["rule_id"].alias("rule_id")))
    combos = F.transform("combos", lambda c: F.struct(F.lit("").alias("phrase"), c["reason"].alias("reason"), c["combo_id"].alias("rule_id")))
    df = df.withColumn("evidence", F.when(F.col("level") == "SAFE", F.array().cast("array<struct<phrase: string, reason: string, rule_id: string>>")).otherwise(F.slice(F.concat(rules, combos), 1, 6))).drop("_ordered")
    df = df.withColumn("highlights", F.transform(F.filter("evidence", lambda e: e["phrase"] != ""), lambda e: e["phrase"]))
    f = F.col("score")
    sure = 0.75 + 0.2 * F.least(F.lit(1.0), (f - 0.58) / 0.42)
    sure = F.when(F.col("hard"), F.greatest(sure, F.lit(0.9))).otherwise(sure) + 0.01 * F.least(F.lit(4), F.size("evidence"))
    conf = F.when(F.col("level") == "DANGEROUS", sure).when(F.col("level") == "SUSPICIOUS", F.greatest(F.lit(0.55), 0.72 - 0.25 * F.abs(f - 0.42) / 0.16)).otherwise(0.7 + 0.29 * (1 - f / 0.26))
    df = df.withColumn("confidence", F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.5), conf)), 2))
    of = lambda texts: F.create_map(*[F.lit(x) for p in texts.items() for x in p])[F.col("chosen")]
    df = df.withColumn("explanation", of(cat.EXPLANATIONS)).withColumn("summary", of(cat.SUMMARIES))
    small = F.concat(F.lower(F.substring("summary", 1, 1)), F.substr("summary", F.lit(2)))
    df = df.withColumn("summary", F.when(F.col("level") == "SUSPICIOUS", F.concat(F.lit("Take care: "), small)).otherwise(F.col("summary")))
    named = F.concat(F.when(F.col("level") == "DANGEROUS", "Danger").otherwise("Doubtful"), F.lit(" - "), of(cat.TITLES))
    plain = F.when(F.col("level") == "DANGEROUS", "Danger").when(F.col("level") == "SUSPICIOUS", "Doubtful").otherwise("Safe")
    df = df.withColumn("badge", F.when(F.col("chosen") == "SAFE", plain).otherwise(named))
    return df.withColumn("matched_rules", F.concat(F.transform("hits", lambda h: h["rule_id"]), F.transform("combos", lambda c: c["combo_id"])))


def score(df: DataFrame, text: str = "text", ml: str | None = None, external: str | None = None, blocked: list[str] | DataFrame = cat.BLOCKED, knowledge: cat.Knowledge | None = None) -> DataFrame:
    """The whole pipeline over all rows that can be judged; `quarantine` has the others. knowledge: rules, combinations and suppressions in place of the engine's own."""
    return explain(fuse(matched(df, text, blocked, knowledge), ml, external))


def engine_label(*layers: str | None) -> Column:
    """rules, and the layers that gave a score for the row: rules+ml, rules+external, rules+ml+external."""
    return F.concat_ws("+", F.lit("rules"), *[F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in zip(("ml", "external"), layers, strict=False) if c])


def payload(df: DataFrame, ml: str | None = None, external: str | None = None) -> DataFrame:
    """msg_id and the nested verdict; ml, external: the layers' columns, if df was scored with them."""
    engine = engine_label(ml, external)
    return df.select(
        "msg_id",
        F.struct("level", "score", F.col("chosen").alias("category"), "confidence", "badge").alias("verdict"), "summary", "evidence", "highlights",
        F.struct("matched_rules", "signals", engine.alias("engine"), "error_code", F.length("text").alias("char_count"), tx.word_count(F.col("text")).alias("word_count")).alias("meta"),
    )


def hits_table(df: DataFrame) -> DataFrame:
    """The exploded form: a row for each hit that counts."""
    return df.select("msg_id", "label", F.explode("risk").alias("h")).select("msg_id", "label", "h.ord", "h.rule_id", "h.signal", "h.category", "h.weight", "h.hard", F.element_at("h.phrases", 1).alias("phrase"))
