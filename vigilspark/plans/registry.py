"""Every query of the engine by name, and its SQL where SQL can express it. Each takes (spark, sf_dir) and works on the whole given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import entities as en
from ..functions import links as lk
from ..functions import text as tx
from ..operators import advice, evaluation, features, linear_model, messages, outer_model, scoring, splits
from ..operators import catalogue as cat
from ..operators.templates import TEMPLATES
from ..session import materialize, shared_folder
from ..sources import io
from ..streaming import stream
from . import sqlparts as sp

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Heavy row-local work is dealt to all cores, whatever the files are: a row group is one task, and the parts of a file beside it have no rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(4 * n, df.rdd.getNumPartitions()))


def msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.from_events(spread(table(spark, sf_dir, "events")))


def judged(spark: SparkSession, sf_dir: str, judge, rows: tuple[str, ...], *columns: str) -> DataFrame:
    """Columns `rows` of the messages with what judge finds in their text."""
    return scoring.by_text(msgs(spark, sf_dir).select("text", *rows), judge, *columns)


def scored(spark: SparkSession, sf_dir: str, rows: tuple[str, ...], *columns: str) -> DataFrame:
    return judged(spark, sf_dir, scoring.score, rows, *columns)


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the hits that count."""
    return judged(spark, sf_dir, scoring.matched, ("msg_id", "label"), "risk")


def join_(c) -> F.Column:
    return F.array_join(c, "|")


M = f"WITH {messages.sql()}"
FOLDED = f"{M}, folded AS (SELECT *, {sp.fold('text')} AS f, {sp.deleet(sp.fold('text'))} AS m FROM messages)"


# -- A: sources and sinks


@query(f"{M} SELECT msg_id AS id, text, label, 'messages' AS source FROM messages")
def a1_a7_jsonl_round_trip(spark, sf_dir):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = msgs(spark, sf_dir).select(F.col("msg_id").cast("string").alias("id"), "text", "label", F.lit("messages").alias("source"))
    io.write_messages(rows, path)
    return io.read_messages(spark, path).select(F.col("id").cast("long").alias("id"), "text", "label", "source")


@query(f"{M} SELECT text, label FROM messages")
def a2_text_label(spark, sf_dir):
    return io.text_and_label(msgs(spark, sf_dir))


@query(f"""{M}, numbered AS (SELECT *, row_number() OVER (ORDER BY msg_id) AS n FROM messages)
SELECT format('EXT_VISMS_TRAIN_{{:05d}}', n) AS id, CASE WHEN label = 2 THEN 2 ELSE 0 END AS label, CASE WHEN label = 2 THEN 1 ELSE 0 END AS original_label FROM numbered WHERE label <> 1""")
def a3_a4_csv_records(spark, sf_dir):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    m = messages.from_events(table(spark, sf_dir, "events"))
    rows = m.select("msg_id", F.col("text").alias("message"), F.when(F.col("label") == 2, "1").when(F.col("label") == 0, "0").otherwise("x").alias("label"))
    rows.repartitionByRange("msg_id").sortWithinPartitions("msg_id").select("message", "label").write.option("header", True).option("escape", '"').csv(path)
    return io.convert_csv(io.read_labelled_csv(spark, path), "train").select("id", "label", "original_label")


@query(f"""WITH hosts AS (SELECT DISTINCT {sp.host('url')} AS host FROM pages)
SELECT DISTINCT {sp.registrable('host')} AS domain FROM hosts WHERE contains(host, '.') AND NOT {sp.is_ip('host')} AND NOT list_contains({sp.strings(cat.NEVER_BLOCK)}, {sp.registrable('host')})""")
def a5_e16_blocklist_build(spark, sf_dir):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    table(spark, sf_dir, "pages").where(F.col("url").isNotNull()).select(F.col("url").alias("value")).write.text(path)
    return lk.blocklist(io.read_lines(spark, path))


@query(f"""WITH hosts AS (SELECT DISTINCT {sp.host('url')} AS host FROM pages), d AS (SELECT DISTINCT {sp.registrable('host')} AS domain FROM hosts WHERE contains(host, '.') AND NOT {sp.is_ip('host')})
SELECT count(*) AS n, min(domain) AS first_domain FROM d""")
def a6_a9_a10_blocklist_file(spark, sf_dir):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    io.write_blocklist(a5_e16_blocklist_build(spark, sf_dir), path)
    return io.read_blocklist(spark, path).agg(F.count("*").alias("n"), F.min("domain").alias("first_domain"))


@query(f"SELECT domain FROM ({SQL['a5_e16_blocklist_build']}) ORDER BY domain LIMIT 5")
def a10_blocklist_head(spark, sf_dir):
    """The first five blocked domains, as the listing shows them."""
    _, first = io.blocklist_info(a5_e16_blocklist_build(spark, sf_dir))
    return spark.createDataFrame([(d,) for d in first], "domain string")


@query(f"SELECT domain FROM ({SQL['a5_e16_blocklist_build']}) ORDER BY domain LIMIT 20000")
def a13_blocklist_export(spark, sf_dir):
    """The blocklist of the exported knowledge; its limit is part of the format."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    io.export_knowledge(spark, path, a5_e16_blocklist_build(spark, sf_dir))
    return spark.read.parquet(f"{path}/blocklist")


@query(f"""{M} SELECT CASE label WHEN 2 THEN 'DANGEROUS' WHEN 1 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS label_name, count(*) AS n FROM messages GROUP BY 1""")
def a8_metadata(spark, sf_dir):
    m = msgs(spark, sf_dir).withColumn("label_name", F.element_at(F.lit(io.LEVELS), F.col("label") + 1))
    return io.metadata(m, "generated", "own").select(F.explode("labels").alias("label_name", "n"))


# -- B: text


@query("SELECT coalesce(CASE WHEN text IS NULL OR regexp_matches(text, '^\\s*$') THEN 'EMPTY' WHEN length(text) > 2000 THEN 'TOO_LONG' END, 'OK') AS code, count(*) AS n FROM documents GROUP BY 1")
def b1_b2_validate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(tx.error_code(F.col("text")), F.lit("OK")).alias("code")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT doc_id, NULL FROM labels),
c AS (SELECT coalesce(CASE WHEN text IS NULL OR regexp_matches(text, '^\\s*$') THEN 'EMPTY' WHEN length(text) > 2000 THEN 'TOO_LONG' END, 'OK') AS code, id, text FROM t)
SELECT code, count(*) AS n, min(id) AS least, max(coalesce(length(text), 0)) AS longest, (SELECT count(*) FROM c x WHERE x.code = c.code) AS observed FROM c GROUP BY code""")
def b1_quarantine(spark, sf_dir):
    """Good and bad texts of one scan, each read back, beside the counts observed on the way. A text is missing where there is only a label."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))
    t = t.unionByName(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("text")))
    good, bad, seen = scoring.quarantine(t)
    both = good.withColumn("code", F.lit("OK")).unionByName(bad.withColumnRenamed("error_code", "code"))
    observed = F.create_map(*[F.lit(x) for p in seen.items() for x in p])
    return both.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("longest")).withColumn("observed", observed[F.col("code")])


@query(f"SELECT doc_id, md5({sp.fold('text')}) AS folded, length({sp.fold('text')}) AS n FROM documents")
def b3_b4_fold_documents(spark, sf_dir):
    f = tx.fold(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(f.cast("binary")).alias("folded"), F.length(f).cast("long").alias("n"))


@query(f"{FOLDED} SELECT msg_id, f AS folded, length(f) AS d_length FROM folded")
def b5_aligned_display(spark, sf_dir):
    return msgs(spark, sf_dir).select("msg_id", tx.fold(F.col("text")).alias("folded"), F.length(tx.display(F.col("text"))).cast("long").alias("d_length"))


@query(f"{FOLDED} SELECT msg_id, regexp_extract(f, '[a-z]+ [0-9]+k', 0) AS folded_span FROM folded WHERE regexp_matches(f, '[a-z]+ [0-9]+k')")
def b6_span_recovery(spark, sf_dir):
    m = msgs(spark, sf_dir).withColumn("f", tx.fold(F.col("text"))).withColumn("d", tx.display(F.col("text")))
    found = materialize(m.withColumn("s", tx.spans(F.col("f"), F.col("d"), "[a-z]+ [0-9]+k")).select("msg_id", "s"))
    return found.where(F.size("s") > 0).select("msg_id", tx.fold(F.col("s")[0]).alias("folded_span"))


@query(f"{FOLDED} SELECT msg_id, m FROM folded")
def b7_b16_deleet(spark, sf_dir):
    return msgs(spark, sf_dir).select("msg_id", tx.for_model(F.col("text")).alias("m"))


@query(f"{FOLDED} SELECT msg_id, regexp_replace(f, '[^a-z0-9]+', '', 'g') AS dense FROM folded")
def b8_dense(spark, sf_dir):
    return msgs(spark, sf_dir).select("msg_id", tx.dense(tx.fold(F.col("text"))).alias("dense"))


@query(f"{M} SELECT msg_id, lower(text) <> replace(strip_accents(lower(text)), 'đ', 'd') AS accented FROM messages")
def b9_has_diacritics(spark, sf_dir):
    return msgs(spark, sf_dir).select("msg_id", tx.has_diacritics(F.col("text")).alias("accented"))


@query()
def b10_b12_normalized(spark, sf_dir):
    return msgs(spark, sf_dir).select("msg_id", tx.normalized(F.col("text")).alias("normalized"))


@query(f"{M} SELECT msg_id, trim(regexp_replace(regexp_replace(text, '([.,!?;:])(\\s|$)', ' \\1\\2', 'g'), '\\s+', ' ', 'g')) AS shown FROM messages")
def b11_detach(spark, sf_dir):
    return msgs(spark, sf_dir).select("msg_id", tx.detach(F.col("text")).alias("shown"))


@query("SELECT conv_id, turn, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM conversations")
def b13_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(t).cast("long").alias("chars"), tx.word_count(t).cast("long").alias("words"))


TAGS = "[PHONE]|[BANK_ACC]|[MONEY]|[NUMBER]|[TIME]|[DATE]|[NAME]|[POINT]|[URL]|[QC]|[ODD_TAG]|[low]|[9]"


@query(f"{M} SELECT msg_id, concat(text, ' 0987654321|19001234567|500.000d|123456|15:30|20/09/2026|Nam|1000|http://example.vip/abc|QC|ODD_TAG|[low]|[9]') AS text FROM messages")
def b14_rehydrate(spark, sf_dir):
    return msgs(spark, sf_dir).select("msg_id", tx.rehydrate(F.concat("text", F.lit(f" {TAGS}"))).alias("text"))


@query()
def b15_merge_entities(spark, sf_dir):
    """Entities of the normalised text, with those that a caller supplies for every kind (here: those of the text as written)."""
    m = en.extract(msgs(spark, sf_dir)).withColumnRenamed("entities", "given").withColumn("n", tx.normalized(F.col("text")))
    both = materialize(en.extract(m, "n").select("msg_id", en.merged(F.col("entities"), F.col("given")).alias("entities")))
    return en.long_form(both, "msg_id").groupBy("msg_id", "kind").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("found"))


@query()
def c1_c6_entities(spark, sf_dir):
    df = en.extract(msgs(spark, sf_dir))
    return df.select("msg_id", *[join_(F.col(f"entities.{k}")).alias(k) for k in en.KINDS])


@query(f"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i){en.EMAIL}')) AS email FROM documents) SELECT doc_id, count(DISTINCT lower(email)) AS n FROM e GROUP BY 1""")
def c3_emails_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.size(en.emails(F.col("text"))).cast("long").alias("n"))
    return df.where("n > 0")


@query(f"""{M}, e AS (SELECT msg_id, unnest(regexp_extract_all(text, '(?:^|\\W)([0-9]{{9,16}})(?:\\W|$)', 1)) AS a FROM messages) SELECT msg_id, a AS account FROM e WHERE NOT starts_with(a, '0') GROUP BY ALL""")
def c5_bank_accounts(spark, sf_dir):
    t = F.col("text")
    return msgs(spark, sf_dir).select("msg_id", F.explode(en.accounts(t, en.phones(t))).alias("account"))


@query(f"""{FOLDED}, o AS (SELECT msg_id, unnest(regexp_extract_all(m, {sp.q(en.OTP)})) AS v FROM folded) SELECT msg_id, v AS value FROM o GROUP BY ALL""")
def c6_otp_mentions(spark, sf_dir):
    return msgs(spark, sf_dir).select("msg_id", F.explode(en.otp_mentions(tx.for_model(F.col("text")))).alias("value"))


@query()
def c7_c8_keywords(spark, sf_dir):
    df = judged(spark, sf_dir, lambda t: scoring.scan(scoring.prepare(t)), ("msg_id",), "rule_hits")
    of = lambda *s: join_(tx.distinct_ignoring_case(F.flatten(F.transform(F.filter("rule_hits", lambda h: h["signal"].isin(*s)), lambda h: h["phrases"]))))
    return df.select("msg_id", of("MONEY", "FREEBIE", "PRIZE").alias("financial"), of("URGENCY").alias("urgency"))


@query()
def c9_entities_long(spark, sf_dir):
    return en.long_form(en.extract(msgs(spark, sf_dir)), "msg_id").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("kinds"))


# -- D: rules


@query(f"WITH {sp.hit_rows()} SELECT msg_id, array_to_string(list(rule_id ORDER BY ord), '|') AS rules FROM matched JOIN rules USING (ord) GROUP BY msg_id")
def d1_d2_rule_hits(spark, sf_dir):
    ids = join_(F.transform("rule_hits", lambda h: h["rule_id"]))
    df = judged(spark, sf_dir, lambda t: scoring.scan(scoring.prepare(t)).withColumn("rules", ids), ("msg_id",), "rules")
    return df.where("rules <> ''").select("msg_id", "rules")


@query(f"WITH {sp.hit_rows()} SELECT signal, count(*) AS n FROM all_hits GROUP BY 1")
def d3_d4_hits_by_signal(spark, sf_dir):
    signals = F.transform(F.concat("rule_hits", "link_hits"), lambda h: h["signal"])
    df = judged(spark, sf_dir, lambda t: scoring.scan_links(scoring.scan(scoring.prepare(t))).withColumn("signals", signals), (), "signals")
    return df.select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


@query(f"{FOLDED} SELECT msg_id, regexp_matches(m, '\\b(?:kho|ba lo)\\b') AS added, regexp_matches(m, '\\bmini ?game\\b|\\b(?:vong quay|quay so) may man\\b') AS kept FROM folded")
def d2_d3_rules_as_rows(spark, sf_dir):
    """A catalogue from tables: the rules of one signal, without one of them, and with one more that is only a row."""
    tables = io.dims(spark)
    rules = tables["rules"].where("signal = 'INVITE' and rule_id <> 'PII_CONTACT_REQUEST'")
    one = spark.createDataFrame([(900, "OWN_RULE", "ADS", "ADS_SPAM", 0.3, "names bags", False, False, False)], rules.schema)
    patterns = tables["rule_patterns"].join(F.broadcast(rules.select("rule_id")), "rule_id").unionByName(spark.createDataFrame([("OWN_RULE", 0, r"\b(?:kho|ba lo)\b")], "rule_id string, pos int, pattern string"))
    known = io.knowledge(tables | {"rules": rules.unionByName(one), "rule_patterns": patterns})
    assert known.rule("OWN_RULE").weight == 0.3 and len(known.by_signal("ADS")) == 1
    df = materialize(scoring.scan(scoring.prepare(msgs(spark, sf_dir)), known.rules).select("msg_id", F.transform("rule_hits", lambda h: h["rule_id"]).alias("ids")))
    return df.select("msg_id", F.array_contains("ids", "OWN_RULE").alias("added"), F.array_contains("ids", "INVITE_MINIGAME").alias("kept"))


@query(f"WITH {sp.risk_rows()} SELECT msg_id, array_to_string(signals, '|') AS signals, array_to_string(list_transform(combos, lambda c: c.id), '|') AS combos, len(safes) AS n_safe, len(weights) AS n_risk FROM combined")
def d5_d9_gates_combos(spark, sf_dir):
    df = judged(spark, sf_dir, scoring.matched, ("msg_id",), "signals", "combos", "safe", "risk")
    return df.select("msg_id", join_(F.col("signals")).alias("signals"), join_(F.transform("combos", lambda c: c["combo_id"])).alias("combos"), F.size("safe").cast("long").alias("n_safe"), F.size("risk").cast("long").alias("n_risk"))


@query(f"WITH {sp.risk_rows()} SELECT rule_id, count(*) AS n, round(sum(weight), 6) AS weight FROM risk GROUP BY 1")
def d10_hits_fact(spark, sf_dir):
    return scoring.hits_table(gated(spark, sf_dir)).groupBy("rule_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"WITH {sp.risk_rows()} SELECT rule_id, count(*) FILTER (label = 0) AS false_alarms, count(*) FILTER (label = 2) AS catches, count(*) AS n FROM risk JOIN messages USING (msg_id) GROUP BY 1")
def d11_attribution(spark, sf_dir):
    return evaluation.attribution(scoring.hits_table(gated(spark, sf_dir)))


# -- E: links

LINKS = f"{M}, links AS (SELECT msg_id, url, {sp.host('url')} AS host FROM (SELECT msg_id, unnest({sp.urls('text')}) AS url FROM messages)), {sp.facts('links', cat.BLOCKED)}"


def links(spark, sf_dir):
    df = msgs(spark, sf_dir).select("msg_id", "label", F.explode(lk.urls(F.col("text"))).alias("url"))
    return df.withColumn("host", lk.host_of(F.col("url")))


def brand_table(spark):
    return spark.createDataFrame([(b,) for b in cat.BRANDS], "brand string")


def blocked_table(spark):
    return spark.createDataFrame([(d,) for d in cat.BLOCKED], "domain string")


@query(f"{LINKS} SELECT msg_id, url, host FROM links")
def e1_e2_urls(spark, sf_dir):
    return links(spark, sf_dir).select("msg_id", "url", "host")


@query(f"WITH h AS (SELECT {sp.host('url')} AS host FROM pages) SELECT host, {sp.registrable('host')} AS domain, split_part(host, '.', -1) AS tld, count(*) AS n FROM h GROUP BY ALL")
def e2_e4_page_hosts(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select(lk.host_of(F.col("url")).alias("host"))
    return h.groupBy("host").agg(F.count("*").alias("n")).select("host", lk.registrable(F.col("host")).alias("domain"), lk.tld(F.col("host")).alias("tld"), "n")


@query(f"{LINKS} SELECT host, domain, tld, ip, official, array_to_string(brands, '|') AS brands, typo, random, shortener, risky, blocked FROM facts")
def e5_e13_e17_host_facts(spark, sf_dir):
    f = lk.host_facts(links(spark, sf_dir), blocked_table(spark))
    return f.select("host", "domain", "tld", "ip", "official", join_(F.col("brands")).alias("brands"), "typo", "random", "shortener", "risky", "blocked")


@query(f"{LINKS}, judged AS (SELECT msg_id, url, {sp.CASCADE} AS rule FROM links JOIN facts USING (host)) SELECT msg_id, url, rule, rule IS NOT NULL AND rule NOT IN ('LINK_IP_ADDRESS', 'LINK_BLOCKLISTED') AND {sp.DOWNLOAD} AS download FROM judged")
def e14_e15_link_verdicts(spark, sf_dir):
    """The cascade by distinct hosts, joined back: a host is judged once."""
    found = links(spark, sf_dir)
    f = lk.host_facts(found, blocked_table(spark))
    judged = found.join(f, "host").withColumn("rule", lk.rule_of(F.col))
    extra = F.col("rule").isNotNull() & ~F.coalesce("rule", F.lit("")).isin("LINK_IP_ADDRESS", "LINK_BLOCKLISTED") & lk.downloads(F.col("url"))
    return judged.select("msg_id", "url", "rule", extra.alias("download"))


@query(f"{LINKS}, b AS (SELECT unnest({sp.strings([b for b in cat.BRANDS if len(b) >= 5])}) AS brand) SELECT host, brand, levenshtein(flat, brand) AS distance FROM facts, b WHERE len(flat) >= 5 AND levenshtein(flat, brand) <= 2 AND NOT contains(flat, brand)")
def e8_e9_typo_join(spark, sf_dir):
    """Misspelt brands by an equality join of deletions; the SQL compares every host with every brand."""
    return lk.typo_pairs(links(spark, sf_dir), brand_table(spark))


@query(f"WITH h AS (SELECT DISTINCT {sp.host('url')} AS host FROM pages), l AS (SELECT DISTINCT host, regexp_replace({sp.label_of('host')}, '[^a-z0-9]', '', 'g') AS flat FROM h), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{3,8}}')) AS w FROM documents WHERE lang = 'en'), "
       "b AS (SELECT DISTINCT w || 'com' AS brand FROM w UNION SELECT DISTINCT flat || 's' FROM l) SELECT host, brand, levenshtein(flat, brand) AS distance FROM l, b WHERE length(flat) >= 5 AND length(brand) >= 5 AND abs(length(flat) - length(brand)) <= 2 AND levenshtein(flat, brand) <= 2 AND NOT contains(flat, brand)")
def e8_e9_typos_of_many_names(spark, sf_dir):
    """The same for hosts of pages and names by the thousand: words of the English documents and the hosts' own labels, each with an ending."""
    hosts = table(spark, sf_dir, "pages").select(lk.host_of(F.col("url")).alias("host"))
    words = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,8}"), F.lit(0)))).alias("w")).select(F.concat("w", F.lit("com")).alias("brand"))
    return lk.typo_pairs(hosts, words.unionByName(hosts.select(F.concat(lk.flat_label(F.col("host")), F.lit("s")).alias("brand"))))


@query(f"{LINKS} SELECT msg_id, url FROM links WHERE {sp.listed('host', cat.BLOCKED, 2)}")
def e11_blocked_links(spark, sf_dir):
    found = lk.mark_blocked(links(spark, sf_dir), blocked_table(spark))
    return found.where("blocked").select("msg_id", "url").distinct()


BLOCKED_BY_TABLE = sp.chosen().replace(sp.listed("host", cat.BLOCKED, 2), "EXISTS (SELECT 1 FROM blocked_domains b WHERE host = b.domain OR ends_with(host, '.' || b.domain))")


@query(f"WITH blocked_domains AS (SELECT domain FROM ({SQL['a5_e16_blocklist_build']}) UNION SELECT unnest({sp.strings(cat.BLOCKED)})), {BLOCKED_BY_TABLE}, l AS (SELECT msg_id, array_to_string(list(rule_id ORDER BY ord), '|') AS link_rules FROM kept WHERE ord >= 100 GROUP BY 1) SELECT msg_id, score, level, chosen AS category, coalesce(link_rules, '') AS link_rules FROM categorized LEFT JOIN l USING (msg_id)")
def e11_e17_scores_by_table(spark, sf_dir):
    """Whole verdicts with a blocklist table: the engine's domains and those of all pages. Each host is judged once, and its verdict goes back to its places in the messages."""
    pages = lk.blocklist(table(spark, sf_dir, "pages").select(F.col("url").alias("value")))
    blocked = pages.unionByName(blocked_table(spark)).distinct()
    df = judged(spark, sf_dir, lambda t: scoring.score(t, blocked=blocked), ("msg_id",), "score", "level", "chosen", "hits")
    rules = F.transform(F.filter("hits", lambda h: h["ord"] > len(cat.RULES)), lambda h: h["rule_id"])
    return df.select("msg_id", "score", "level", F.col("chosen").alias("category"), join_(rules).alias("link_rules"))


# -- F: scores


@query(f"WITH {sp.scored()} SELECT level, count(*) AS n, round(avg(score), 6) AS mean_score FROM leveled GROUP BY 1")
def f_levels(spark, sf_dir):
    return judged(spark, sf_dir, lambda t: scoring.fuse(scoring.matched(t)), (), "score", "level").groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"WITH {sp.scored()} SELECT msg_id, round(rule_score, 9) AS rule_score, round(safe_score, 9) AS safe_score, hard, score, level FROM leveled")
def f1_f6_f11_f12_scores(spark, sf_dir):
    df = judged(spark, sf_dir, lambda t: scoring.fuse(scoring.matched(t)), ("msg_id",), "rule_score", "safe_score", "hard", "score", "level")
    return df.select("msg_id", F.round("rule_score", 9).alias("rule_score"), F.round("safe_score", 9).alias("safe_score"), "hard", "score", "level")


@query(f"WITH {sp.risk_rows()} SELECT msg_id, round(1 - product(1 - weight), 6) AS noisy_or FROM risk GROUP BY 1")
def f1_grouped_noisy_or(spark, sf_dir):
    """The exploded form of the noisy-or: a grouped product."""
    return scoring.hits_table(gated(spark, sf_dir)).groupBy("msg_id").agg(F.round(1 - F.product(1 - F.col("weight")), 6).alias("noisy_or"))


#: What scores are fused of.
FUSED = ("risk", "safe", "signals", "combos")


def outside(spark, sf_dir):
    """Scores of an outer model as a table: plain arithmetic over the events, none for every fifth."""
    e = table(spark, sf_dir, "events").where("event_id % 5 <> 0")
    d, s = (F.col("event_id") % 10) / 10.0, (F.col("event_id") % 3) / 30.0
    return e.select(F.col("event_id").alias("msg_id"), F.struct((1 - d - s * (1 - d)).alias("safe"), (s * (1 - d)).alias("suspicious"), d.alias("dangerous")).alias("outer"))


OUTSIDE = "outside AS (SELECT event_id AS msg_id, (event_id % 10) / 10.0::DOUBLE AS d, (event_id % 3) / 30.0::DOUBLE AS s0 FROM events WHERE event_id % 5 <> 0), ox AS (SELECT msg_id, 1 - d - s0 * (1 - d) AS safe, s0 * (1 - d) AS s, d FROM outside)"
BLEND = f"""WITH {sp.risk_rows()}, {OUTSIDE}, mixed AS (SELECT r.*, o.d, o.s, o.safe AS osafe, CASE WHEN o.d IS NULL THEN rule_score ELSE (0.65::DOUBLE * rule_score + 0.5::DOUBLE * (o.d + 0.45::DOUBLE * o.s)) / (0.65::DOUBLE + 0.5::DOUBLE) END AS b FROM ruled r LEFT JOIN ox o USING (msg_id)),
floored AS (SELECT *, CASE WHEN d >= 0.8 THEN greatest(b, 0.31) WHEN s >= 0.6 THEN greatest(b, 0.26) ELSE b END AS fl FROM mixed),
vetoed AS (SELECT *, CASE WHEN NOT hard AND osafe >= 0.8 THEN fl * 0.4::DOUBLE ELSE fl END AS v FROM floored), final AS (SELECT *, round(least(1.0, greatest(0.0, CASE WHEN hard THEN greatest(v, 0.85) ELSE v END)), 4) AS score FROM vetoed)"""


@query(f"{BLEND} SELECT msg_id, score, CASE WHEN score >= 0.58 THEN 'DANGEROUS' WHEN score >= 0.26 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS level FROM final")
def f7_f10_h8_outer_layer(spark, sf_dir):
    m = msgs(spark, sf_dir).select("msg_id", "text").join(outside(spark, sf_dir), "msg_id", "left")
    return scoring.fuse(scoring.by_text(m, scoring.matched, *FUSED), external="outer").select("msg_id", "score", "level")


@query(f"{M} SELECT msg_id, round((length(text) % 10) / 10.0, 6) AS dangerous, round((length(text) % 3) / 30.0 * (1 - (length(text) % 10) / 10.0), 6) AS suspicious FROM messages WHERE msg_id % 5 <> 0")
def h8_batch_model(spark, sf_dir):
    """A user's model over batches of texts, loaded once for each Python worker; here its scores are plain arithmetic over lengths. Every fifth message has no text and gets no score."""

    def load():
        import numpy as np

        def scores(texts):
            n = np.array([len(t) for t in texts])
            d, s = (n % 10) / 10.0, (n % 3) / 30.0
            return np.stack([1 - d - s * (1 - d), s * (1 - d), d], axis=1)

        return scores

    m = msgs(spark, sf_dir).withColumn("text", F.when(F.col("msg_id") % 5 != 0, F.col("text")))
    df = outer_model.score(m, load)
    return df.where(F.col("outer").isNotNull()).select("msg_id", F.round("outer.dangerous", 6).alias("dangerous"), F.round("outer.suspicious", 6).alias("suspicious"))


@query(f"WITH {sp.chosen()} SELECT level, chosen AS category, count(*) AS n FROM categorized GROUP BY ALL")
def f13_categories(spark, sf_dir):
    return scored(spark, sf_dir, (), "level", "chosen").groupBy("level", F.col("chosen").alias("category")).agg(F.count("*").alias("n"))


@query()
def f14_f15_evidence(spark, sf_dir):
    df = scored(spark, sf_dir, ("msg_id",), "evidence", "highlights")
    return df.select("msg_id", F.to_json("evidence").alias("evidence"), join_(F.col("highlights")).alias("highlights"))


@query(f"""WITH {sp.chosen()}, ranked AS (SELECT r.msg_id, r.rule_id, row_number() OVER (PARTITION BY r.msg_id ORDER BY (r.category = c.chosen) DESC, r.hard DESC, r.weight DESC, r.ord) AS k FROM risk r JOIN categorized c USING (msg_id))
SELECT msg_id, rule_id, k FROM ranked WHERE k <= 5""")
def f14_top_hits(spark, sf_dir):
    """The grouped form: the five first hits of each text by a window, given to its messages."""
    w = Window.partitionBy("text").orderBy((F.col("category") == F.col("chosen")).desc(), F.col("hard").desc(), F.col("weight").desc(), "ord")

    def first(texts):
        hits = materialize(scoring.score(texts).select("text", "_copies", "chosen", "risk")).select("text", "_copies", "chosen", F.explode("risk").alias("h")).select("text", "_copies", "chosen", "h.*")
        return hits.withColumn("k", F.row_number().over(w).cast("long")).where("k <= 5")

    return judged(spark, sf_dir, first, ("msg_id",), "rule_id", "k").select("msg_id", "rule_id", "k")


def _texts(texts: dict[str, str]) -> str:
    return "CASE chosen " + " ".join(f"WHEN {sp.q(k)} THEN {sp.q(v)}" for k, v in texts.items()) + " END"


@query(f"""WITH {sp.chosen()}, t AS (SELECT msg_id, level, chosen, {_texts(cat.EXPLANATIONS)} AS explanation, {_texts(cat.SUMMARIES)} AS line, {_texts(cat.TITLES)} AS title FROM categorized)
SELECT msg_id, explanation, CASE WHEN level = 'SUSPICIOUS' THEN 'Take care: ' || lower(substr(line, 1, 1)) || substr(line, 2) ELSE line END AS summary,
CASE level WHEN 'DANGEROUS' THEN 'Danger' WHEN 'SUSPICIOUS' THEN 'Doubtful' ELSE 'Safe' END || CASE WHEN chosen = 'SAFE' THEN '' ELSE ' - ' || title END AS badge FROM t""")
def f17_f19_texts(spark, sf_dir):
    return scored(spark, sf_dir, ("msg_id",), "explanation", "summary", "badge").select("msg_id", "explanation", "summary", "badge")


@query()
def f16_f21_verdicts(spark, sf_dir):
    verdict = ("level", "score", "chosen", "confidence", "badge", "summary", "evidence", "highlights", "matched_rules", "signals", "error_code")
    out = scoring.payload(scored(spark, sf_dir, ("msg_id",), *verdict))
    return out.select("msg_id", "verdict.*", "summary", F.to_json("meta").alias("meta"))


# -- G: advice


@query(f"""WITH {sp.chosen()}, b AS (SELECT *, CASE WHEN level <> 'SAFE' AND chosen = 'SAFE' THEN 'GENERIC_CAUTION' ELSE chosen END AS block FROM categorized JOIN (SELECT msg_id, text FROM messages) USING (msg_id)),
n AS (SELECT *, CASE WHEN block IN ('GAMBLING_SCAM', 'ADS_SPAM', 'GENERIC_CAUTION') THEN 1 ELSE 2 END AS k FROM b)
SELECT msg_id, block, concat(block, '_', 1 + CAST(concat('0x', substr(sha256(text), 1, 2)) AS INTEGER) % k) AS quiz_id, CASE WHEN level = 'DANGEROUS' THEN 6 ELSE 3 END AS n_steps FROM n""")
def g1_g5_advice(spark, sf_dir):
    df = scored(spark, sf_dir, ("msg_id",), "level", "chosen").withColumnRenamed("chosen", "category")
    return advice.advise(df, F.col("text")).select("msg_id", "block", "quiz_id", F.size("steps").alias("n_steps"))


@query()
def g7_advice_for_verdicts(spark, sf_dir):
    """Advice for verdicts from elsewhere, with levels that aren't known marked."""
    e = table(spark, sf_dir, "events")
    v = e.select("event_id", messages.pick(["SAFE", "SUSPICIOUS", "DANGEROUS", "ODD"], F.col("event_id")).alias("level"), messages.pick(list(cat.PRIORITY), F.col("user_id")).alias("category"))
    return advice.advise(v, F.col("category")).groupBy("level", "block", "error_code").agg(F.count("*").alias("n"))


QUIZ_IDS = [x[0] for x in cat.QUIZZES] + ["NO_SUCH"]


@query(f"""WITH a AS (SELECT {sp.strings(QUIZ_IDS)}[event_id % {len(QUIZ_IDS)} + 1] AS quiz_id, {sp.strings([' a', 'B ', 'c'])}[user_id % 3 + 1] AS o FROM events),
k(quiz_id, ok) AS (VALUES {', '.join(f"({sp.q(x[0])}, {sp.q(x[5])})" for x in cat.QUIZZES)})
SELECT quiz_id, count(*) AS n, count(*) FILTER (upper(trim(o)) = ok) AS correct, count(*) FILTER (ok IS NULL) AS unknown FROM a LEFT JOIN k USING (quiz_id) GROUP BY 1""")
def g6_grading(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.select(messages.pick(QUIZ_IDS, F.col("event_id")).alias("quiz_id"), messages.pick([" a", "B ", "c"], F.col("user_id")).alias("option_id"))
    return advice.grade(a).groupBy("quiz_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("correct"), F.count_if(F.col("error_code").isNotNull()).alias("unknown"))


_CARDS = ", ".join(f"({sp.q(c)}, {sp.q(t)}, {cat.PRIORITY[c]}, {sp.q(cat.ADVICE[c][2])}, {sum(q[1] == c for q in cat.QUIZZES)})" for c, t in cat.TITLES.items())


@query(f"{M}, cards(category, title, priority, card_title, n_quizzes) AS (VALUES {_CARDS}) SELECT category, title, priority, card_title, n_quizzes, count(msg_id) AS n FROM cards LEFT JOIN messages USING (category) GROUP BY ALL")
def g5_g8_category_cards(spark, sf_dir):
    """Every category with its title, card, number of quizzes and messages."""
    n = msgs(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    asked = advice.quizzes(spark).groupBy(F.col("block").alias("category")).agg(F.count("*").alias("n_quizzes"))
    cards = advice.blocks(spark).select(F.col("block").alias("category"), "card_title")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    df = io.dims(spark)["categories"].join(cards, "category").join(asked, "category", "left").join(n, "category", "left")
    return df.select("category", "title", "priority", "card_title", zero("n_quizzes"), zero("n"))


# -- H: features and models


@query(f"""WITH c AS (SELECT conv_id * 1000 + turn AS k, {sp.fold('text')} AS f FROM conversations), w AS (SELECT k, regexp_extract_all(f, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]{{2,}}') AS w FROM c),
t AS (SELECT k, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) ELSE [] END)) AS term FROM w),
tf AS (SELECT k, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM conversations),
raw AS (SELECT k, term, tf, df, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term), n), norm AS (SELECT k, sqrt(sum(raw * raw)) AS l FROM raw GROUP BY 1)
SELECT k, count(*) AS terms, round(max(raw / l), 5) AS top_weight, round(sum(raw / l), 4) AS total FROM raw JOIN norm USING (k) GROUP BY 1""")
def h1_h3_tfidf(spark, sf_dir):
    c = spread(table(spark, sf_dir, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), tx.fold(F.col("text")).alias("f"))
    t = features.tfidf(c, "k", features.word_terms(F.col("f")))
    return t.groupBy("k").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 5).alias("top_weight"), F.round(F.sum("weight"), 4).alias("total"))


@query(f"""{FOLDED}, w AS (SELECT msg_id, unnest(list_filter(string_split(m, ' '), lambda w: w <> '')) AS w FROM folded), p AS (SELECT msg_id, concat(' ', w, ' ') AS p FROM w)
SELECT msg_id, CAST(sum(CASE WHEN length(p) >= 3 THEN length(p) - 2 ELSE 1 END + CASE WHEN length(p) >= 4 THEN length(p) - 3 ELSE 0 END + CASE WHEN length(p) >= 5 THEN length(p) - 4 ELSE 0 END) AS BIGINT) AS n FROM p GROUP BY 1""")
def h2_char_terms(spark, sf_dir):
    m = msgs(spark, sf_dir).withColumn("m", tx.for_model(F.col("text")))
    return m.select("msg_id", F.size(features.char_terms(F.col("m"))).cast("long").alias("n"))


@query()
def h4_h7_model(spark, sf_dir):
    """Fitted on the train part of a split by template, then on all rows; probabilities and classes of all messages."""
    m = materialize(splits.by_group(msgs(spark, sf_dir), "template_id", 0.2))
    held = linear_model.predict(linear_model.train(m.where("part = 'train'")), m.where("part = 'test'"))
    full = linear_model.predict(linear_model.train(m), m)
    parts = held.select(F.lit("holdout").alias("fit"), "label", "ml_class").unionByName(full.select(F.lit("all").alias("fit"), "label", "ml_class"))
    return parts.groupBy("fit", "label", "ml_class").agg(F.count("*").alias("n"))


@query()
def a11_a12_model_tables(spark, sf_dir):
    """The model saved, loaded and exported: its terms, weights and intercepts to six digits, counted by class."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    linear_model.train(msgs(spark, sf_dir)).save(path)
    parts = linear_model.export(linear_model.load(spark, path))
    w = parts["weights"].groupBy("class").agg(F.count("*").alias("terms"), F.count_if(F.col("weight") != 0).alias("used"))
    return w.join(parts["intercepts"], "class").select("class", "terms", "used", F.round("intercept", 3).alias("intercept"))


@query()
def f7_f9_h5_ml_layer(spark, sf_dir):
    m = materialize(msgs(spark, sf_dir).select("text", "label"))
    model = linear_model.train(m)
    df = scoring.by_text(m, lambda t: scoring.fuse(scoring.matched(linear_model.predict(model, t)), ml="ml"), "level")
    return df.groupBy("label", "level").agg(F.count("*").alias("n"))


FOLDS = 3
#: Messages with the words and pairs of their text for the model, and the scores of a model by counts that saw no message of their fold.
LOG_ODDS = f"""folded AS (SELECT *, {sp.deleet(sp.fold('text'))} AS m, ((msg_id * 31 + 7) % {len(TEMPLATES)}) % {FOLDS} AS fold FROM messages), folds AS (SELECT unnest(range({FOLDS})) AS f),
lw AS (SELECT msg_id, label, fold, regexp_extract_all(m, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]{{2,}}') AS w FROM folded),
lt AS (SELECT msg_id, label, fold, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) ELSE [] END)) AS term FROM lw),
ltf AS (SELECT msg_id, label, fold, term, count(*) AS tf FROM lt GROUP BY ALL),
ldf AS (SELECT f, term, count(*) AS df, count(*) FILTER (label = 0) AS d0, count(*) FILTER (label = 1) AS d1, count(*) FILTER (label = 2) AS d2 FROM ltf, folds WHERE fold <> f GROUP BY ALL),
ln_ AS (SELECT f, count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 2) AS n2 FROM folded, folds WHERE fold <> f GROUP BY ALL),
lraw AS (SELECT t.msg_id, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS raw, ln((1 + d0)::DOUBLE / (3 + df)) AS c0, ln((1 + d1)::DOUBLE / (3 + df)) AS c1, ln((1 + d2)::DOUBLE / (3 + df)) AS c2
  FROM ltf t JOIN ldf d ON t.term = d.term AND t.fold = d.f JOIN ln_ ON ln_.f = t.fold),
lsum AS (SELECT msg_id, sqrt(sum(raw * raw)) AS l, sum(raw * c0) AS m0, sum(raw * c1) AS m1, sum(raw * c2) AS m2 FROM lraw GROUP BY 1),
lz AS (SELECT x.msg_id, ln((1 + n0)::DOUBLE / (3 + n)) + coalesce(m0 / l, 0) AS z0, ln((1 + n1)::DOUBLE / (3 + n)) + coalesce(m1 / l, 0) AS z1, ln((1 + n2)::DOUBLE / (3 + n)) + coalesce(m2 / l, 0) AS z2
  FROM folded x JOIN ln_ ON ln_.f = x.fold LEFT JOIN lsum USING (msg_id)),
le AS (SELECT msg_id, z0, z1, z2, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM lz),
lo AS (SELECT msg_id, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS best FROM le)"""


def by_counts(m: DataFrame) -> DataFrame:
    """Messages with the scores of a model by counts, fitted on the other folds of the templates."""
    fold = ((F.col("msg_id") * 31 + 7) % len(TEMPLATES)) % FOLDS
    return linear_model.cross_fitted(m, fold, FOLDS, lambda d: linear_model.log_odds(d, blocks=("word",)))


@query(f"{M}, {LOG_ODDS} SELECT msg_id, round(p0, 5) AS safe, round(p1, 5) AS suspicious, round(p2, 5) AS dangerous, best AS ml_class FROM lo")
def h5_h6_table_scores(spark, sf_dir):
    """Probabilities and classes by tables, from models that saw no message of the same template."""
    r = lambda k: F.round(f"ml.{k}", 5).alias(k)
    return by_counts(msgs(spark, sf_dir)).select("msg_id", r("safe"), r("suspicious"), r("dangerous"), "ml_class")


@query(f"{M}, c AS (SELECT label, count(*) AS n FROM messages GROUP BY 1) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n) * CASE WHEN label = 2 THEN 1.3 ELSE 1.0 END, 6) AS weight FROM c")
def h9_class_weights(spark, sf_dir):
    return features.class_weights(msgs(spark, sf_dir), "label").select("label", "n", F.round("weight", 6).alias("weight"))


# -- I: splits

POSITION = "CAST(concat('0x', substr(md5(concat('42|', CAST({k} AS VARCHAR))), 1, 13)) AS BIGINT)"


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'test' ELSE 'train' END AS part FROM labels")
def i1_predefined(spark, sf_dir):
    return splits.predefined(table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "test").alias("split"))).select("doc_id", "part")


@query(f"""WITH g AS (SELECT source, row_number() OVER (ORDER BY {POSITION.format(k='source')}, source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT source, CASE WHEN r <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS part, count(*) AS n_docs FROM documents JOIN g USING (source) GROUP BY ALL""")
def i2_group_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return splits.by_group(d, "source", 0.2).groupBy("source", "part").agg(F.count("*").alias("n_docs"))


@query(f"""WITH l AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {POSITION.format(k='doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, toxic, CASE WHEN r <= round(0.25 * n) THEN 'test' ELSE 'train' END AS part FROM l""")
def i3_stratified(spark, sf_dir):
    return splits.stratified(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 0.25).select("doc_id", "toxic", "part")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def i4_source_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM labels ORDER BY {POSITION.format(k='doc_id')}, doc_id LIMIT 100")
def i5_seeded_cap(spark, sf_dir):
    return splits.capped(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 100)


@query(f"{M} SELECT msg_id, text FROM messages ORDER BY msg_id LIMIT 50")
def i6_first(spark, sf_dir):
    return splits.first(msgs(spark, sf_dir).select("msg_id", "text"), 50, "msg_id")


@query("SELECT 'documents' AS origin, lang AS tag, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY ALL")
def i7_union(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("lang").alias("tag"), "doc_id")
    b = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), F.col("role").alias("tag"), "conv_id")
    return a.unionByName(b, allowMissingColumns=True).groupBy("origin", "tag").agg(F.count("*").alias("n"))


# -- J: evaluation

PRED = f"WITH {sp.scored()}, p AS (SELECT msg_id, label, channel, template_id, CASE level WHEN 'DANGEROUS' THEN 2 WHEN 'SUSPICIOUS' THEN 1 ELSE 0 END AS pred, score FROM leveled JOIN messages USING (msg_id))"


_CUBES: dict[tuple[str, str], tuple[str, StructType]] = {}


def predicted(spark, sf_dir):
    """Counts of messages by channel, label and prediction. They are written once for an application and a set of tables; every report is a sum of them."""
    at = (spark.sparkContext.applicationId, sf_dir)
    path, schema = _CUBES.get(at, (None, None))
    if path is None or not io.exists(spark, path):
        df = judged(spark, sf_dir, lambda t: scoring.fuse(scoring.matched(t)), ("label", "channel"), "level")
        cells = evaluation.cube(df.select("label", "channel", evaluation.as_label(F.col("level")).alias("pred")), "channel")
        path, schema = f"{shared_folder(spark)}/cube-{uuid.uuid4().hex}", cells.schema
        cells.write.parquet(path)
        _CUBES[at] = (path, schema)
    return spark.read.schema(schema).parquet(path)


@query(f"{PRED} SELECT label, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1, count(*) FILTER (pred = 2) AS pred_2 FROM p GROUP BY 1")
def j1_confusion(spark, sf_dir):
    return evaluation.confusion(predicted(spark, sf_dir))


def _r(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


THREE = "count(*) AS n, round(count(*) FILTER (label = pred) / count(*), 6) AS accuracy, round(count(*) FILTER (label = 2 AND pred = 2) / nullif(count(*) FILTER (label = 2), 0), 6) AS recall_dangerous, round(count(*) FILTER (label = 2 AND pred > 0) / nullif(count(*) FILTER (label = 2), 0), 6) AS caught, count(*) FILTER (label = 2 AND pred = 0) AS missed_as_safe, round(count(*) FILTER (label = 0 AND pred > 0) / nullif(count(*) FILTER (label = 0), 0), 6) AS false_alarm, count(*) FILTER (label = 0 AND pred = 2) AS false_alarms_dangerous"


@query(f"{PRED} SELECT {THREE} FROM p")
def j2_j5_three_levels(spark, sf_dir):
    return _r(evaluation.three_levels(predicted(spark, sf_dir)))


def _binary(alarm: int) -> str:
    return f"""{PRED}, c AS (SELECT count(*) FILTER (label > 0 AND pred >= {alarm}) AS tp, count(*) FILTER (label = 0 AND pred >= {alarm}) AS fp, count(*) FILTER (label > 0 AND pred < {alarm}) AS fn, count(*) FILTER (label = 0 AND pred < {alarm}) AS tn FROM p)
SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_positive_rate FROM c"""


@query(_binary(1))
def j3_binary(spark, sf_dir):
    return _r(evaluation.binary(predicted(spark, sf_dir)))


@query(_binary(2))
def j4_binary_strict(spark, sf_dir):
    return _r(evaluation.binary(predicted(spark, sf_dir), 2))


@query(f"""{PRED}, k AS (SELECT unnest([0, 1, 2]) AS class) SELECT class, round(coalesce(count(*) FILTER (label = class AND pred = class) / nullif(count(*) FILTER (pred = class), 0), 0), 6) AS precision,
round(coalesce(count(*) FILTER (label = class AND pred = class) / nullif(count(*) FILTER (label = class), 0), 0), 6) AS recall, round(coalesce(2.0 * count(*) FILTER (label = class AND pred = class) / nullif(count(*) FILTER (pred = class) + count(*) FILTER (label = class), 0), 0), 6) AS f1,
count(*) FILTER (label = class) AS support FROM p, k GROUP BY 1""")
def j6_by_class(spark, sf_dir):
    return _r(evaluation.by_class(predicted(spark, sf_dir)))


@query(f"{PRED} SELECT channel, count(*) AS n, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY ROLLUP (channel)")
def j7_sliced(spark, sf_dir):
    return _r(evaluation.sliced(predicted(spark, sf_dir), "channel"))


@query(f"""{PRED}, k AS (SELECT unnest([0, 1, 2]) AS class) SELECT channel, class, round(coalesce(count(*) FILTER (label = class AND pred = class) / nullif(count(*) FILTER (pred = class), 0), 0), 6) AS precision,
round(coalesce(count(*) FILTER (label = class AND pred = class) / nullif(count(*) FILTER (label = class), 0), 0), 6) AS recall, round(coalesce(2.0 * count(*) FILTER (label = class AND pred = class) / nullif(count(*) FILTER (pred = class) + count(*) FILTER (label = class), 0), 0), 6) AS f1,
count(*) FILTER (label = class) AS support FROM p, k GROUP BY channel, class""")
def j7_report_by_source(spark, sf_dir):
    return _r(evaluation.by_class(predicted(spark, sf_dir), "channel"))


def _fused(name: str, layers: list[tuple[str, float]]) -> str:
    """The score of a configuration from `blended` (rule_score, hard, and safe, s, d of each layer, null where it has none)."""
    risk = lambda x, w: f"CASE WHEN {x}_d IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE * ({x}_d + 0.45::DOUBLE * {x}_s) END"
    top = " + ".join(["0.65::DOUBLE * rule_score", *[risk(x, w) for x, w in layers]])
    bottom = " + ".join(["0.65::DOUBLE", *[f"CASE WHEN {x}_d IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE END" for x, w in layers]])
    f = f"CASE WHEN {bottom} > 0.65::DOUBLE THEN ({top}) / ({bottom}) ELSE rule_score END"
    for x, _ in layers:
        f = f"CASE WHEN {x}_d >= 0.8 THEN greatest({f}, 0.31) WHEN {x}_s >= 0.6 THEN greatest({f}, 0.26) ELSE {f} END"
    if layers:
        f = f"CASE WHEN NOT hard AND least({', '.join(f'{x}_safe' for x, _ in layers)}) >= 0.8 THEN ({f}) * 0.4::DOUBLE ELSE {f} END"
    return f"SELECT '{name}' AS config, label, round(least(1.0, greatest(0.0, CASE WHEN hard THEN greatest({f}, 0.85) ELSE {f} END)), 4) AS s FROM blended"


#: Configurations of the layers: name -> whether each counts.
LAYERS = {"rules": (False, False), "rules+tfidf": (True, False), "rules+external": (False, True), "rules+tfidf+external": (True, True)}
BOTH = f"""WITH {sp.risk_rows()}, {LOG_ODDS.replace('folded AS', 'lfolded AS').replace('FROM folded', 'FROM lfolded')}, {OUTSIDE},
blended AS (SELECT x.label, r.rule_score, r.hard, lo.p0 AS m_safe, lo.p1 AS m_s, lo.p2 AS m_d, ox.safe AS o_safe, ox.s AS o_s, ox.d AS o_d FROM ruled r JOIN messages x USING (msg_id) JOIN lo USING (msg_id) LEFT JOIN ox USING (msg_id)),
pair AS ({' UNION ALL '.join(_fused(k, [p for p, on in zip((('m', 0.35), ('o', 0.5)), used, strict=True) if on]) for k, used in LAYERS.items())}),
p AS (SELECT config, label, CASE WHEN s >= 0.58 THEN 2 WHEN s >= 0.26 THEN 1 ELSE 0 END AS pred FROM pair)"""


@query(f"{BOTH} SELECT config, {THREE} FROM p GROUP BY config")
def j8_f22_four_configurations(spark, sf_dir):
    """Rules alone, with a TF-IDF layer, with an outer one, with both: messages are scored once by rules and layers, and fused once for each row of configurations.

    The TF-IDF layer's scores are out of fold: no message is judged by a model that saw its template.
    """
    m = by_counts(msgs(spark, sf_dir)).join(outside(spark, sf_dir), "msg_id", "left")
    g = scoring.by_text(m.select("text", "label", "ml", "outer"), scoring.matched, *FUSED)
    configs = F.explode(F.array(*[F.struct(F.lit(k).alias("config"), F.lit(a).alias("with_ml"), F.lit(b).alias("with_outer")) for k, (a, b) in LAYERS.items()]))
    each = g.withColumn("c", configs).withColumn("ml", F.when(F.col("c.with_ml"), F.col("ml"))).withColumn("outer", F.when(F.col("c.with_outer"), F.col("outer"))).withColumn("config", F.col("c.config"))
    p = scoring.fuse(each, ml="ml", external="outer").select("config", "label", evaluation.as_label(F.col("level")).alias("pred"))
    return _r(evaluation.three_levels(p, "config"))


@query()
def j8_fitted_configurations(spark, sf_dir):
    """The same two configurations of rules and TF-IDF with the fitted model, cross-fitted by template."""
    fold = ((F.col("msg_id") * 31 + 7) % len(TEMPLATES)) % FOLDS
    m = linear_model.cross_fitted(msgs(spark, sf_dir), fold, FOLDS)
    g = scoring.by_text(m.select("text", "label", "ml"), scoring.matched, *FUSED)
    each = g.withColumn("config", F.explode(F.lit(["rules", "rules+tfidf"]))).withColumn("ml", F.when(F.col("config") == "rules+tfidf", F.col("ml")))
    return _r(evaluation.three_levels(scoring.fuse(each, ml="ml").select("config", "label", evaluation.as_label(F.col("level")).alias("pred")), "config"))


@query("""WITH r AS (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text)) AS k, count(*) OVER () AS n FROM documents) SELECT round(avg(v), 6) AS mean, min(v) FILTER (k = greatest(floor(0.95 * n), 1)) AS p95, max(v) AS max FROM r""")
def j9_mean_p95_max(spark, sf_dir):
    return _r(evaluation.mean_p95_max(table(spark, sf_dir, "documents").select(F.length("text").cast("long").alias("v")), "v"))


@query(f"{M} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM messages GROUP BY 1")
def j10_distribution(spark, sf_dir):
    return evaluation.distribution(msgs(spark, sf_dir), "label")


@query("""SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents WHERE doc_id IS NULL) AS no_id, (SELECT count(*) FROM documents WHERE trim(coalesce(text, '')) = '') AS blank, (SELECT count(*) FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) WHERE toxic IS NULL) AS bad_label,
(SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS repeated_id, (SELECT count(*) - count(DISTINCT lower(text)) FROM documents) AS repeated_text,
(SELECT count(*) FROM documents d JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) WHERE toxic <> CASE WHEN lang = 'en' THEN 0 ELSE 1 END) AS wrong_name, (SELECT count(*) BETWEEN 100 AND 1000000000000 FROM documents) AS size_fits""")
def j11_quality(spark, sf_dir):
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    named = table(spark, sf_dir, "documents").join(l, "doc_id", "left").withColumn("name", F.when(F.col("lang") == "en", "clean").otherwise("toxic"))
    return evaluation.quality(named, "doc_id", "text", "label", "name", {0: "clean", 1: "toxic"}, (100, 10**12))


# -- K: generated data


@query(f"{M} SELECT msg_id, text, label, category, template_id FROM messages")
def k1_k2_k5_generate(spark, sf_dir):
    return msgs(spark, sf_dir).select("msg_id", "text", "label", "category", "template_id")


@query(f"{M}, r AS (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY msg_id) AS k FROM messages) SELECT msg_id, label FROM r WHERE k = 1")
def k3_unique(spark, sf_dir):
    """The first of messages that differ only by case: a grouped minimum, so a frequent text is no single task."""
    m = msgs(spark, sf_dir)
    return m.groupBy(F.lower("text").alias("t")).agg(F.min(F.struct("msg_id", "label")).alias("f")).select("f.msg_id", "f.label")


@query(f"""{M}, u AS (SELECT msg_id, label, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY msg_id) AS k FROM messages) WHERE k = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {POSITION.format(k='msg_id')}, msg_id) AS k FROM u), b AS (SELECT * FROM r WHERE k <= CASE label WHEN 1 THEN 40 ELSE 80 END)
SELECT format('MSG_{{:04d}}', row_number() OVER (ORDER BY {POSITION.format(k='msg_id')}, msg_id)) AS id, msg_id, label FROM b""")
def k4_k8_buckets(spark, sf_dir):
    """A data set of 40, 20 and 40 percent: targets by label, then ids in a seeded order. The target of 200 rows is the feature."""
    unique = materialize(k3_unique(spark, sf_dir))
    r = splits.ranked(unique, "label", "msg_id").where(F.col("_rank") <= F.when(F.col("label") == 1, 40).otherwise(80))
    number = F.row_number().over(Window.orderBy(splits.position(42, "msg_id"), "msg_id"))  # of 200 rows at most
    return r.select(F.format_string("MSG_%04d", number).alias("id"), "msg_id", "label")


@query()
def k6_k7_records(spark, sf_dir):
    """Full records: risk entities are the first four highlights; suspicious sales and groups get their own category."""
    df = scored(spark, sf_dir, ("msg_id", "label", "category"), "highlights")
    category = F.when((F.col("label") == 1) & F.lower("text").rlike("khuyến mãi|giảm giá"), "ADS_SPAM").when((F.col("label") == 1) & F.lower("text").rlike("nhóm"), "SUSPICIOUS_INVITE").otherwise(F.col("category"))
    return df.select("msg_id", "text", "label", category.alias("category"), join_(F.slice("highlights", 1, 4)).alias("risk_entities"))


# -- L: streams


def _drain(df: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into files of the shared folder."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def message_stream(spark, sf_dir):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    m = msgs(spark, sf_dir).select("msg_id", "ts", "channel", "text", "label")
    m.write.parquet(path)
    return stream.read(spark, path, m.schema, 1000)


def _scored_stream(spark, sf_dir) -> str:
    """The folder of the verdicts of the message stream."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    stream.score_by_text(message_stream(spark, sf_dir), path, f"{path}-state").awaitTermination()
    return path


@query(f"WITH {sp.chosen()} SELECT msg_id, level, score, chosen AS category FROM categorized")
def l1_stream_scores(spark, sf_dir):
    """The stream's verdicts; they are those of the batch."""
    return spark.read.parquet(f"{_scored_stream(spark, sf_dir)}/*").select("msg_id", "level", "score", "category")


@query()
def l2_stream_counts(spark, sf_dir):
    """Hourly counts, as far as the watermark has closed the hours: a stream over the verdicts of the scoring stream."""
    path = _scored_stream(spark, sf_dir)
    return _drain(stream.counts(stream.read(spark, f"{path}/*", spark.read.parquet(f"{path}/*").schema, 1000)), spark)


@query(f"{LINKS} SELECT msg_id, host, CASE WHEN msg_id % 2 = 0 THEN {sp.listed('host', cat.BLOCKED[:1], 2)} ELSE {sp.listed('host', cat.BLOCKED, 2)} END AS blocked FROM links")
def l3_stream_blocklist(spark, sf_dir):
    """Links in two batches; the list grows in between, and the second batch meets the new one."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    found = materialize(links(spark, sf_dir).select("msg_id", "host"))
    full = blocked_table(spark)
    for part, blocked in ((0, full.where(F.col("domain").isin(cat.BLOCKED[:1]))), (1, full)):
        blocked.write.mode("overwrite").parquet(f"{path}/list")
        found.where(F.col("msg_id") % 2 == part).write.mode("append").parquet(f"{path}/links")
        stream.mark_blocked(stream.read(spark, f"{path}/links", found.schema, 1000), f"{path}/list", f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out/*").select("msg_id", "host", "blocked")


@query(f"WITH {sp.chosen()} SELECT msg_id, level, score, chosen AS category, CASE WHEN msg_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS blocklist FROM categorized")
def l1_l3_scoring_stream(spark, sf_dir):
    """Verdicts of a stream whose blocklist has another version for the second half of the messages; both versions have the engine's domains, so the verdicts are those of one batch."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for name, df in io.dims(spark).items():
        df.write.parquet(f"{path}/rules/r1/{name}")
    m = msgs(spark, sf_dir)
    for version, part in (("v1", 0), ("v2", 1)):
        blocked_table(spark).write.parquet(f"{path}/lists/{version}")
        m.where(F.col("msg_id") % 2 == part).write.mode("append").parquet(f"{path}/messages")
        stream.score_batches(stream.read(spark, f"{path}/messages", m.schema, 1000), f"{path}/lists", f"{path}/rules", f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out/good").select("msg_id", "level", "score", "category", "blocklist")
