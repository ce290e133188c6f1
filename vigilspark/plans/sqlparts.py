"""The engine's semantics once more as SQL for another engine, against which results are compared."""

from __future__ import annotations

from ..operators import catalogue as cat
from ..operators import messages


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def fold(x: str) -> str:
    return f"trim(regexp_replace(lower(replace(replace(strip_accents(regexp_replace({x}, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g')), 'đ', 'd'), 'Đ', 'd')), '\\s+', ' ', 'g'))"


def deleet(x: str) -> str:
    letters, digits = "len(regexp_extract_all(t, '\\pL'))", "len(regexp_extract_all(t, '[0-9]'))"
    fits = f"NOT regexp_matches(t, '[:/@]') AND {letters} >= 1 AND {digits} >= 1 AND {letters} >= {digits} AND NOT regexp_matches(t, '[0-9][0-9]')"
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda t: CASE WHEN {fits} THEN translate(t, '013457@$', 'oieastas') ELSE t END), ' ')"


#: Look-behind free: the character before is part of the match, and the link its first group.
URL = (
    r"(?i)(?:^|[^@\w.])((?:https?://|www\.)[^\s<>\"''()\[\],]+|[a-z0-9][a-z0-9\-]{1,40}(?:\.[a-z0-9\-]{1,30})+\.[a-z]{2,6}(?:/[^\s<>\"''()\[\],]*)?"
    r"|[a-z0-9][a-z0-9\-]{1,40}\.(?:com|vn|net|org|info|biz|vip|top|xyz|club|icu|cc|me|tk|ml|ga|cf|gq|buzz|win|shop|online|site|store|app|link|live|fun)(?:/[^\s<>\"''()\[\],]*)?)"
)


def urls(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{URL}', 1), lambda u: regexp_replace(u, '[.,;:!?)]+$', ''))"


def host(u: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim({u})), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '.')"


def registrable(h: str) -> str:
    p = f"string_split({h}, '.')"
    return f"CASE WHEN list_contains({strings(cat.SUFFIXES)}, array_to_string({p}[-2:], '.')) AND len({p}) > 2 THEN array_to_string({p}[-3:], '.') ELSE array_to_string({p}[-2:], '.') END"


def listed(h: str, domains, least: int = 1) -> str:
    p = f"string_split({h}, '.')"
    return f"list_has_any(list_transform(range(1, greatest(len({p}) - {least - 1}, 1) + 1), lambda i: array_to_string({p}[i:], '.')), {strings(domains)})" if domains else "false"


def is_ip(h: str) -> str:
    return f"(regexp_matches({h}, '^[0-9]+(\\.[0-9]+){{3}}$') AND len(list_filter(string_split({h}, '.'), lambda p: TRY_CAST(p AS INTEGER) > 255)) = 0)"


def brands(h: str) -> str:
    return f"list_sort(list_filter({strings(cat.BRANDS)}, lambda b: contains(regexp_replace({h}, '[^a-z0-9]', '', 'g'), b)))"


def label_of(h: str) -> str:
    return f"string_split({registrable(h)}, '.')[1]"


def facts(source: str, blocked) -> str:
    """One row for each distinct host of `source` (host)."""
    return f"""facts AS (SELECT *, CASE WHEN len(flat) >= 5 THEN list_sort(list_filter(list_transform({strings([b for b in cat.BRANDS if len(b) >= 5])}, lambda b: {{'d': levenshtein(flat, b), 'b': b}}), lambda x: x.d <= 2 AND NOT contains(flat, x.b)))[1].b END AS typo,
        regexp_matches(label, '^[a-z]{{5,}}$') AND (len(regexp_extract_all(label, '[aeiouy]')) * 1.0 / len(label) < 0.3 OR regexp_matches(label, '[^aeiouy]{{4,}}')) AS random
      FROM (SELECT host, {registrable('host')} AS domain, split_part(host, '.', -1) AS tld, {is_ip('host')} AS ip, {listed('host', cat.OFFICIAL)} AS official, {brands('host')} AS brands,
        {listed('host', blocked, 2)} AS blocked, list_contains({strings(cat.SHORTENERS)}, {registrable('host')}) AS shortener, list_contains({strings(cat.RISKY_TLDS)}, split_part(host, '.', -1)) AS risky, {label_of('host')} AS label, regexp_replace({label_of('host')}, '[^a-z0-9]', '', 'g') AS flat
        FROM (SELECT DISTINCT host FROM {source})))"""


CASCADE = """CASE WHEN host = '' OR NOT contains(host, '.') THEN NULL WHEN ip THEN 'LINK_IP_ADDRESS' WHEN blocked THEN 'LINK_BLOCKLISTED' WHEN official THEN NULL
  WHEN len(brands) > 0 AND (risky OR contains(host, '-')) THEN 'LINK_BRAND_IMPERSONATION' WHEN len(brands) > 0 THEN 'LINK_BRAND_UNVERIFIED' WHEN typo IS NOT NULL THEN 'LINK_BRAND_TYPO'
  WHEN shortener THEN 'LINK_SHORTENER' WHEN risky THEN 'LINK_SUSPICIOUS_TLD' WHEN random THEN 'LINK_RANDOM_DOMAIN' ELSE 'LINK_UNKNOWN_DOMAIN' END"""
DOWNLOAD = "(regexp_matches(lower(url), '\\.(apk|exe)$') OR contains(lower(url), '.apk?') OR contains(lower(url), '.exe?'))"


def hit_rows() -> str:
    """CTEs up to hits: (msg_id, ord, rule_id, signal, category, weight, hard, amplifier, standalone), suppression not yet applied."""
    b = lambda v: "true" if v else "false"
    tests = ", ".join(f"CASE WHEN regexp_matches(m, {q('|'.join(f'(?:{p})' for p in r.patterns))}) THEN {r.ord} END" for r in cat.RULES)
    rules = ", ".join(f"({r.ord}, {q(r.rule_id)}, {q(r.signal)}, {q(r.category)}, CAST({r.weight} AS DOUBLE), {b('H' in r.flags)}, {b('A' in r.flags)}, {b('S' in r.flags)})" for r in cat.RULES)
    links = ", ".join(f"({q(k)}, CAST({w} AS DOUBLE), {b(h)}, {b(s)})" for k, (w, h, s, _) in cat.LINK_RULES.items())
    return f"""{messages.sql()}, folded AS (SELECT *, {deleet(fold('text'))} AS m FROM messages),
    rules(ord, rule_id, signal, category, weight, hard, amplifier, standalone) AS (VALUES {rules}), link_rules(rule_id, weight, hard, standalone) AS (VALUES {links}),
    matched AS (SELECT msg_id, unnest(list_filter([{tests}], lambda x: x IS NOT NULL)) AS ord FROM folded),
    links AS (SELECT msg_id, url, {host('url')} AS host, n FROM (SELECT msg_id, unnest({urls('text')}) AS url, unnest(range(1, len({urls('text')}) + 1)) AS n FROM messages)),
    {facts('links', cat.BLOCKED)},
    judged AS (SELECT msg_id, url, n, {CASCADE} AS rule FROM links JOIN facts USING (host)),
    link_hits AS (SELECT msg_id, n * 2 AS k, rule AS rule_id FROM judged WHERE rule IS NOT NULL UNION ALL SELECT msg_id, n * 2 + 1, 'LINK_FILE_DOWNLOAD' FROM judged WHERE rule IS NOT NULL AND rule NOT IN ('LINK_IP_ADDRESS', 'LINK_BLOCKLISTED') AND {DOWNLOAD}),
    all_hits AS (SELECT msg_id, ord, rule_id, signal, category, weight, hard, amplifier, standalone FROM matched JOIN rules USING (ord)
      UNION ALL SELECT msg_id, 100 + k, rule_id, 'LINK', 'PHISHING_LINK', weight, hard, false, standalone FROM link_hits JOIN link_rules USING (rule_id))"""


def risk_rows() -> str:
    """More CTEs: hits after suppression, risk after the amplifier gate, signals, combos, per message."""
    combos = ", ".join(
        f"CASE WHEN {' AND '.join(f'list_has_any(signals, {strings(g)})' for g in groups)} THEN {{'id': {q(i)}, 'category': {q(c)}, 'boost': CAST({w} AS DOUBLE), 'hard': {'true' if h else 'false'}, 'names': {'true' if n else 'false'}}} END"
        for i, groups, c, w, h, n, _ in cat.COMBOS
    )
    return f"""{hit_rows()}, kept AS (SELECT * FROM all_hits h WHERE NOT (rule_id IN ({', '.join(q(b) for _, b in cat.SUPPRESS)}) AND EXISTS (SELECT 1 FROM all_hits o WHERE o.msg_id = h.msg_id AND o.rule_id = {q(cat.SUPPRESS[0][0])}))),
    risk AS (SELECT * FROM kept k WHERE signal <> 'SAFE' AND EXISTS (SELECT 1 FROM kept o WHERE o.msg_id = k.msg_id AND o.signal <> 'SAFE' AND NOT o.amplifier)),
    per AS (SELECT m.msg_id, coalesce(r.w, []) AS weights, coalesce(r.signals, []) AS signals, coalesce(r.hard, false) AS rhard, coalesce(r.standalone, false) AS standalone, coalesce(s.w, []) AS safes
      FROM messages m LEFT JOIN (SELECT msg_id, list(weight ORDER BY ord) AS w, list_sort(list(DISTINCT signal)) AS signals, bool_or(hard) AS hard, bool_or(standalone) AS standalone FROM risk GROUP BY msg_id) r USING (msg_id)
      LEFT JOIN (SELECT msg_id, list(weight ORDER BY ord) AS w FROM kept WHERE signal = 'SAFE' GROUP BY msg_id) s USING (msg_id)),
    combined AS (SELECT *, list_filter([{combos}], lambda c: c IS NOT NULL) AS combos FROM per),
    base AS (SELECT *, 1 - list_reduce(list_prepend(CAST(1.0 AS DOUBLE), list_concat(weights, list_transform(combos, lambda c: c.boost))), lambda a, w: a * (1 - w)) AS r0, 1 - list_reduce(list_prepend(CAST(1.0 AS DOUBLE), safes), lambda a, w: a * (1 - w)) AS safe_score,
      rhard OR len(list_filter(combos, lambda c: c.hard)) > 0 AS hard FROM combined),
    weak AS (SELECT *, CASE WHEN len(combos) = 0 AND NOT list_has_any(signals, {strings(cat.STANDALONE)}) AND NOT standalone THEN least(r0, 0.53) ELSE r0 END AS r1 FROM base),
    damped AS (SELECT *, CASE WHEN safe_score > 0 AND NOT hard THEN CASE WHEN safe_score >= 0.4 THEN least(r1 * (1 - 0.5 * least(0.6, safe_score)), 0.56) ELSE r1 * (1 - 0.5 * least(0.6, safe_score)) END ELSE r1 END AS r2 FROM weak),
    ruled AS (SELECT *, CASE WHEN safe_score > 0 AND NOT hard AND len(combos) = 0 AND signals = ['IMPERSONATION'] THEN least(r2, 0.24) ELSE r2 END AS rule_score FROM damped)"""


def scored(blend: str = "rule_score") -> str:
    return f"""{risk_rows()}, scored AS (SELECT *, round(least(1.0, greatest(0.0, CASE WHEN hard THEN greatest({blend}, 0.85) ELSE {blend} END)), 4) AS score FROM ruled),
    leveled AS (SELECT *, CASE WHEN score >= {cat.DANGEROUS} THEN 'DANGEROUS' WHEN score >= {cat.SUSPICIOUS} THEN 'SUSPICIOUS' ELSE 'SAFE' END AS level FROM scored)"""


PRIORITY = "CASE category " + " ".join(f"WHEN {q(c)} THEN {p}" for c, p in cat.PRIORITY.items()) + " END"


def chosen() -> str:
    return f"""{scored()}, named AS (SELECT msg_id, category, weight, hard FROM risk WHERE category <> 'SAFE' UNION ALL SELECT msg_id, c.category, c.boost, c.hard FROM (SELECT msg_id, unnest(combos) AS c FROM combined) WHERE c.names),
    hardest AS (SELECT msg_id, arg_max(category, {PRIORITY}) AS hc FROM named WHERE hard GROUP BY msg_id),
    sums AS (SELECT msg_id, category, round(sum(weight), 9) AS s FROM named GROUP BY ALL), best AS (SELECT msg_id, arg_max(category, {{'s': s, 'p': {PRIORITY}}}) AS bc FROM sums GROUP BY msg_id),
    categorized AS (SELECT l.*, CASE WHEN level = 'SAFE' THEN 'SAFE' ELSE coalesce(hc, bc, 'SAFE') END AS chosen FROM leveled l LEFT JOIN hardest USING (msg_id) LEFT JOIN best USING (msg_id))"""
