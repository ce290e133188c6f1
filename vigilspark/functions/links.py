"""Links and their hosts: parsing, domain knowledge and the verdict cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import catalogue as cat
from ..session import materialize
from . import text as tx

# Fixed value: what counts as a link when risk is judged.
URL = (
    r"(?:https?://|www\.)[^\s<>\"'()\[\],]+|(?<![@\w.])[a-z0-9][a-z0-9\-]{1,40}(?:\.[a-z0-9\-]{1,30})+\.[a-z]{2,6}(?:/[^\s<>\"'()\[\],]*)?"
    r"|(?<![@\w.])[a-z0-9][a-z0-9\-]{1,40}\.(?:com|vn|net|org|info|biz|vip|top|xyz|club|icu|cc|me|tk|ml|ga|cf|gq|buzz|win|shop|online|site|store|app|link|live|fun)(?:/[^\s<>\"'()\[\],]*)?"
)


def urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?iuU)" + URL), F.lit(0))
    return tx.distinct_ignoring_case(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", "")))


def host_of(url: Column) -> Column:
    rest = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    rest = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    rest = F.regexp_replace(rest, r"^.*@", "")
    return F.trim(F.regexp_replace(rest, r":[0-9]*$", ""), F.lit("."))


def registrable(host: Column) -> Column:
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(two.isin(cat.SUFFIXES) & (F.size(labels) > 2), three).otherwise(two)


def tld(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def parents(host: Column, least: int = 1) -> Column:
    """The host and every domain above it with at least `least` labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - least + 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def listed(host: Column, domains: list[str], least: int = 1) -> Column:
    return F.arrays_overlap(parents(host, least), F.lit(domains)) if domains else F.lit(False)


def is_official(host: Column) -> Column:
    return listed(host, cat.OFFICIAL)


def brands_in(host: Column) -> Column:
    flat = F.regexp_replace(host, "[^a-z0-9]", "")
    return F.array_sort(F.filter(F.lit(cat.BRANDS), lambda b: F.contains(flat, b)))


def own_label(host: Column) -> Column:
    return F.substring_index(registrable(host), ".", 1)


def flat_label(host: Column) -> Column:
    """The label without anything but letters and digits, as it is compared with brands."""
    return F.regexp_replace(own_label(host), "[^a-z0-9]", "")


def looks_random(host: Column) -> Column:
    """A label of five letters or more with few vowels, or four consonants together; y is a vowel."""
    label = own_label(host)
    return label.rlike("^[a-z]{5,}$") & ((F.regexp_count(label, F.lit("[aeiouy]")) / F.length(label) < 0.3) | label.rlike("[^aeiouy]{4,}"))


def typo_of(host: Column) -> Column:
    """The nearest brand (then by name) at most two edits away from the label, if the label doesn't hold it; null if none."""
    label = flat_label(host)
    near = F.transform(F.lit([b for b in cat.BRANDS if len(b) >= 5]), lambda b: F.struct(F.levenshtein(label, b, 2).alias("d"), b.alias("b")))
    good = F.filter(near, lambda x: (x["d"] >= 0) & ~F.contains(label, x["b"]))
    return F.when(F.length(label) >= 5, F.array_min(good)["b"])


def is_ip(host: Column) -> Column:
    return host.rlike(r"^[0-9]+(\.[0-9]+){3}$") & F.forall(F.split(host, r"\."), lambda p: F.try_to_number(p, F.lit("999999999")).cast("int") <= 255)


#: Rows of a lookup table that may be sent to every executor; links of a host that has a thousandth of all count as frequent.
SMALL, COMMON = 500_000, 1000


def host_facts(hosts: DataFrame, blocked: DataFrame | None = None, brands: DataFrame | None = None) -> DataFrame:
    """One row for each distinct host with all that the cascade asks, so that a frequent host is judged once. blocked: a table with `domain`; joined by every parent of a host.

    brands: a table with `brand`, for lists of any size; misspelt ones are then found by their deletions. Without it the engine's few dozen are compared in the row.
    """
    h = F.col("host")
    df = hosts.select("host").distinct()
    facts = df.select(
        "host", registrable(h).alias("domain"), tld(h).alias("tld"), is_ip(h).alias("ip"), is_official(h).alias("official"), brands_in(h).alias("brands"), *([typo_of(h).alias("typo")] if brands is None else []), looks_random(h).alias("random"),
        registrable(h).isin(cat.SHORTENERS).alias("shortener"), tld(h).isin(cat.RISKY_TLDS).alias("risky"),
    )
    if brands is not None:
        near = typo_pairs(df, brands).groupBy("host").agg(F.min(F.struct("distance", "brand"))["brand"].alias("typo"))
        facts = facts.join(near, "host", "left")
    if blocked is None:
        return facts.withColumn("blocked", F.lit(False))
    return mark_blocked(facts, blocked)


def deletions(word: Column, most: int = 2) -> Column:
    """The word and what is left of it without one letter, or two."""

    def without_one(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))

    out = F.array(word)
    for _ in range(most):
        out = tx.let(out, lambda a: F.array_union(a, F.flatten(F.transform(a, lambda w: F.when(w == "", F.array().cast("array<string>")).otherwise(without_one(w))))))
    return out


def typo_pairs(hosts: DataFrame, brands: DataFrame, most: int = 2) -> DataFrame:
    """host, brand, distance: brands at most two edits away from a host's label, both of five letters or more, that the label doesn't hold.

    Words so near to each other have a deletion of two letters or less in common, so an equality join of deletions finds every pair, and only these
    are compared. Labels longer than the longest brand and two letters more can't be near one; each distinct label is compared once.
    """
    b = brands.select("brand").distinct().where(F.length("brand") >= 5)
    longest = b.agg(F.max(F.length("brand")).alias("n")).first()["n"] or 0
    labels = hosts.select("host").distinct().withColumn("label", flat_label(F.col("host"))).where(F.length("label").between(5, longest + most))
    keys = labels.select("label").distinct().select("label", F.explode(deletions(F.col("label"), most)).alias("key"))
    pairs = keys.join(b.select("brand", F.explode(deletions(F.col("brand"), most)).alias("key")), "key").select("label", "brand").distinct()
    d = F.levenshtein("label", "brand", most)
    near = pairs.withColumn("distance", d.cast("long")).where((F.col("distance") >= 0) & ~F.contains("label", "brand"))
    return labels.join(near, "label").select("host", "brand", "distance")


def rules_by_host(links: DataFrame, blocked: DataFrame, small: int = SMALL, brands: DataFrame | None = None) -> DataFrame:
    """links (host, ...) with `rule`. Verdicts of distinct hosts come back by broadcast while there are `small` at most; beyond, those of hosts with a thousandth of all links (a thousand at most) do, and the others by their hash."""
    counts = materialize(links.groupBy("host").agg(F.count("*").alias("n")))
    facts = materialize(host_facts(counts, blocked, brands).select("host", rule_of(F.col).alias("rule")))
    total = counts.agg(F.count("*").alias("hosts"), F.sum("n").alias("links")).first()
    if total["hosts"] <= small:
        return links.join(F.broadcast(facts), "host")
    often = counts.where(F.col("n") * COMMON >= (total["links"] or 0)).select("host")
    rest = links.join(F.broadcast(often), "host", "left_anti").join(facts, "host")
    return links.join(F.broadcast(facts.join(F.broadcast(often), "host", "left_semi")), "host").unionByName(rest)


def mark_blocked(rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """rows (host) with `blocked`: whether the host or a domain above it (of two labels at least) is in blocked (domain). Distinct hosts are looked up, and joined back."""
    hosts = rows.select("host").distinct()
    hit = hosts.select("host", F.explode(parents(F.col("host"), 2)).alias("domain")).join(blocked.select("domain").distinct(), "domain", "left_semi").select("host").distinct().withColumn("blocked", F.lit(True))
    return rows.join(hit, "host", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def rule_of(f) -> Column:
    """The first rule of the cascade that holds; f: name -> column of the host's facts."""
    branded = F.size(f("brands")) > 0
    return (
        F.when((f("host") == "") | ~F.contains(f("host"), F.lit(".")), None)
        .when(f("ip"), "LINK_IP_ADDRESS")
        .when(f("blocked"), "LINK_BLOCKLISTED")
        .when(f("official"), None)
        .when(branded & (f("risky") | F.contains(f("host"), F.lit("-"))), "LINK_BRAND_IMPERSONATION")
        .when(branded, "LINK_BRAND_UNVERIFIED")
        .when(f("typo").isNotNull(), "LINK_BRAND_TYPO")
        .when(f("shortener"), "LINK_SHORTENER")
        .when(f("risky"), "LINK_SUSPICIOUS_TLD")
        .when(f("random"), "LINK_RANDOM_DOMAIN")
        .otherwise("LINK_UNKNOWN_DOMAIN")
    )


def downloads(url: Column) -> Column:
    low = F.lower(url)
    return low.rlike(r"\.(apk|exe)$") | F.contains(low, F.lit(".apk?")) | F.contains(low, F.lit(".exe?"))


def in_row(url: Column, blocked: list[str]) -> Column:
    """array<string>: the rules of one link, from expressions alone; blocked: domains as a literal list, for short lists and streams."""
    return tx.let(host_of(url), lambda h: _rules(url, h, blocked))


def _rules(url: Column, h: Column, blocked: list[str]) -> Column:
    facts = {
        "host": h, "ip": is_ip(h), "blocked": listed(h, blocked, 2), "official": is_official(h), "brands": brands_in(h), "risky": tld(h).isin(cat.RISKY_TLDS), "typo": typo_of(h),
        "shortener": registrable(h).isin(cat.SHORTENERS), "random": looks_random(h),
    }
    return tx.let(rule_of(facts.__getitem__), lambda r: with_download(url, r))


def with_download(url: Column, rule: Column) -> Column:
    """The rule, if any, and one more for a link to a file."""
    return F.array_compact(F.array(rule, F.when(rule.isNotNull() & ~rule.isin("LINK_IP_ADDRESS", "LINK_BLOCKLISTED") & downloads(url), "LINK_FILE_DOWNLOAD")))


def blocklist(lines: DataFrame) -> DataFrame:
    """domain: distinct domains from lines of links or hosts; no addresses, no single labels, none of the never-blocked. Only the registrable domain decides."""
    clean = lines.select(F.trim(F.col("value")).alias("value")).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))
    hosts = clean.select(host_of(F.element_at(F.split("value", r"\s+"), -1)).alias("host")).where(F.contains("host", F.lit(".")) & ~is_ip(F.col("host")))
    return hosts.select(registrable(F.col("host")).alias("domain")).where(~F.col("domain").isin(cat.NEVER_BLOCK)).distinct()
