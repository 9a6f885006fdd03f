"""SQL twins of the queries that SQL can express.

The others are compared with brute-force versions in the tests: SQL has no XXH64
of shingles, no rank-ordered merges of byte pairs and no trained network.
"""

from __future__ import annotations

import math

from tallyline.llm import collocations as phrases
from tallyline.llm import importance
from tallyline.llm import quality_rules as rules
from tallyline.llm import secret_scan as secret
from tallyline.llm import url_filter as url

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MAXSCORE = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
    FROM whole q JOIN whole d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


def _strength(level: str) -> str:
    """How many pages the parent's rate m counts for, by moments over the children in ``level``."""
    within = """(sum((k - n * m) * (k - n * m)) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m))"""
    return f"""(SELECT CASE WHEN coalesce(sum(n * (n - 1) * m * (1 - m)), 0) = 0 THEN 1.0
        WHEN {within} > 0 THEN least(1000.0, greatest(1.0, 1 / ({within}) - 1)) ELSE 1000.0 END FROM {level})"""


def _rules() -> str:
    """Branches of a CASE, longest rule first."""
    ordered = sorted(url.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    return " ".join(f"WHEN {fits.format(h, p)} THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}" for h, p, v in ordered)


_TWO = ", ".join(f"'{name}'" for name in url.TWO_LABELS)
URLS = f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
outcome AS (
    SELECT doc_id AS page_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (
    SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k,
        array_to_string(string_split(host, '.')[-2:], '.') AS two
    FROM parts LEFT JOIN outcome USING (page_id) GROUP BY host),
named AS (
    SELECT host, n, k, CASE WHEN two IN ({_TWO}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain,
        CASE WHEN two IN ({_TWO}) THEN two ELSE string_split(host, '.')[-1] END AS suffix FROM hosts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM named GROUP BY domain, suffix),
suffixes AS (
    SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM domains) AS m
    FROM domains GROUP BY suffix),
s1 AS (SELECT suffix, (k + s * m) / (n + s) AS m FROM suffixes, (SELECT {_strength("suffixes")} AS s)),
d0 AS (SELECT domain, n, k, m FROM domains JOIN s1 USING (suffix)),
d1 AS (SELECT domain, (k + s * m) / (n + s) AS m FROM d0, (SELECT {_strength("d0")} AS s)),
h0 AS (SELECT host, named.n, named.k, m FROM named JOIN d1 USING (domain)),
h1 AS (SELECT host, (k + s * m) / (n + s) AS mean, n + s AS size FROM h0, (SELECT {_strength("h0")} AS s)),
judged AS (SELECT page_id, parts.host, path, CASE {_rules()} END AS r, mean - {url.Z} * sqrt(mean * (1 - mean) / (size + 1)) AS low
    FROM parts JOIN h1 USING (host))
SELECT page_id, host, path, r.rule AS rule,
    coalesce(r.verdict, CASE WHEN low > {url.BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""

_WORDS = f"""regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
LEAKS = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS text
    FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
runs AS (
    SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS text
    FROM docs, (SELECT DISTINCT size FROM windows) s, unnest(range(1, len(w) - size + 2)) AS t(i)),
met AS (SELECT doc_id, i, size, item_id FROM runs JOIN windows USING (size, text)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM met, unnest(range(size)) AS t(k) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(pattern: str, group: int = 0) -> str:
    """Matches of a pattern as a list of {start, stop, found, value}, by the lengths of what lies between them."""
    p = _quoted(pattern)
    found, gaps = f"regexp_extract_all(t, {p})", f"string_split_regex(t, {p})"
    sizes = lambda part, upto: f"coalesce(list_sum(list_transform({part}[1 : {upto}], lambda x: length(x))), 0)"
    start = f"{sizes(gaps, 'i')} + {sizes(found, 'i - 1')}"
    value = f"regexp_extract_all(t, {p}, {group})[i]"
    return f"""list_transform(range(1, len({found}) + 1), lambda i: {{'start': {start}, 'found': {found}[i], 'value': {value}}})"""


def _hot(name: str, alphabet: str, pattern: str, bits: float) -> str:
    """Candidates as rows (doc_id, kind, start, stop) from the first to the last hot window."""
    worth = "[" + ", ".join(str(secret.window_bits(n)) for n in range(secret.WINDOW + 1)) + "]"
    rules = [*secret.ALLOWED] + (["^[0-9A-Fa-f]*$"] if name != "entropy_hex" else [])
    allowed = " OR ".join(f"regexp_matches(f.found, {_quoted(rule)})" for rule in rules)
    part = f"string_split(substr(f.found, w + 1, {secret.WINDOW}), '')"
    total = f"list_sum(list_transform(list_distinct({part}), lambda c: {worth}[len(list_filter({part}, lambda x: x = c)) + 1]))"
    return f"""SELECT doc_id, {secret.ORDER.index(name)} AS rank, '{name}' AS kind,
        f.start + min(w) AS start, f.start + max(w) + {secret.WINDOW} AS stop
    FROM (SELECT doc_id, f FROM (SELECT doc_id, unnest({_found(pattern)}) AS f FROM texts WHERE regexp_matches(t, {_quoted(pattern)}))
        WHERE NOT ({allowed})), unnest(range(length(f.found) - {secret.WINDOW - 1})) AS u(w)
    WHERE {total} <= {secret.most_sum(bits)} GROUP BY doc_id, f"""


def _base(kind: str, pattern: str, least: int, group: int = 0) -> str:
    return f"""SELECT doc_id, {secret.ORDER.index(kind)} AS rank, '{kind}' AS kind, f.start AS start, f.start + length(f.found) AS stop
    FROM (SELECT doc_id, unnest({_found(pattern, group)}) AS f FROM texts WHERE regexp_matches(t, {_quoted(pattern)}))
    WHERE length(f.value) >= {least}"""


_WRITTEN = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '')"
SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_base("assign", secret.ASSIGN, secret.LEAST_VALUE, 2)} UNION ALL {_base("access", secret.ACCESS, secret.LEAST_ACCESS)}
    UNION ALL {_base("hex", "[0-9a-f]{24,}", secret.LEAST_HEX)}),
added AS ({" UNION ALL ".join(_hot(*kind) for kind in secret.CLASSES)}),
apart AS (SELECT * FROM added a WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.start < a.stop AND a.start < b.stop)),
of_base AS (SELECT doc_id, {_WRITTEN} AS spans, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secret.ORDER[:3])}
    FROM base GROUP BY doc_id),
of_all AS (SELECT doc_id, {_WRITTEN} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM apart) GROUP BY doc_id)
SELECT texts.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret.ORDER[:3])},
    sha256(coalesce(of_base.spans, '')) AS base_sha256, coalesce(of_all.spans, '') AS spans
FROM texts LEFT JOIN of_base USING (doc_id) LEFT JOIN of_all USING (doc_id)
"""

_TABLE = """list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
_BYTES = "list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))"
RESAMPLED = f"""
WITH docs AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
wanted AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM docs UNION SELECT w FROM wanted)),
crc AS (SELECT w, xor(list_reduce(list_concat([4294967295], {_BYTES}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)
    % {importance.BUCKETS} AS bucket FROM vocabulary, (SELECT {_TABLE} AS tab)),
s AS (SELECT bucket, count(*) AS s FROM docs JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN crc USING (w) GROUP BY bucket),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + {importance.BUCKETS})
        / (CAST(s + 1 AS DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + {importance.BUCKETS})))) AS BIGINT) AS gain
    FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT doc_id, count(*) AS n, sum(gain) AS gain FROM docs JOIN crc USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
noisy AS (
    SELECT doc_id, coalesce(n, 0) AS n, CAST(coalesce(floor(CAST(gain AS DOUBLE) / n), 0) AS BIGINT) AS weight,
        CAST('0x' || substr(sha256('{importance.SEED}:' || doc_id), 1, 8) AS BIGINT) AS h
    FROM documents LEFT JOIN sums USING (doc_id)),
scored AS (SELECT doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM noisy),
placed AS (SELECT *, row_number() OVER (PARTITION BY n >= {importance.LEAST_WORDS} ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n >= {importance.LEAST_WORDS}) AS able FROM scored)
SELECT doc_id, n AS n_features, weight, score,
    CASE WHEN n >= {importance.LEAST_WORDS} AND place <= able * {importance.PERCENT} // 100 THEN place END AS rank FROM placed
"""


def _fence(rule: rules.Rule, end: str) -> str:
    """The limit of a group on one side, from its quartiles ``q1`` and ``q3``."""
    reach = f"{rules.REACH} * greatest(q3 - q1, {rule.least_spread})"
    value = f"q3 + {reach}" if end == "high" else f"q1 - {reach}"
    return f"max(CASE WHEN rule = '{rule.name}' THEN {value} END) AS {rule.name}_{end}"


_ENDS = [(rule, end) for rule in rules.RULES for end in (("high", "low") if rule.low else ("high",))]
_NONE = -1_000_000  # the bucket of 0
_MIDDLE = f"CASE WHEN {{0}} = {_NONE} THEN 0.0 ELSE 2 * pow({rules.GAMMA!r}::DOUBLE, {{0}}) / ({rules.GAMMA!r}::DOUBLE + 1) END"


def _limits(by: str) -> str:
    keys = f"{by}, " if by else ""
    at = lambda q: f"min_by(bucket, upto) FILTER (upto > floor({q} * (texts - 1)))"
    return f"""SELECT {keys}max(texts) AS texts, {", ".join(_fence(*x) for x in _ENDS)} FROM (
        SELECT {keys}rule, texts, {_MIDDLE.format("b1")} AS q1, {_MIDDLE.format("b3")} AS q3 FROM (
            SELECT {keys}rule, max(texts) AS texts, {at(0.25)} AS b1, {at(0.75)} AS b3 FROM (
                SELECT *, sum(n) OVER (PARTITION BY {keys}rule ORDER BY bucket) AS upto,
                    sum(n) OVER (PARTITION BY {keys}rule) AS texts
                FROM (SELECT {keys}rule, bucket, count(*) AS n FROM shares GROUP BY {keys}rule, bucket)) GROUP BY {keys}rule))
        GROUP BY {by or "()"}"""


def _level(name: str) -> str:
    enough = f"f.texts >= {rules.LEAST_TEXTS}"
    of = lambda c: f"CASE WHEN {enough} THEN f.{c} WHEN l.texts >= {rules.LEAST_TEXTS} THEN l.{c} ELSE a.{c} END"
    return of(name)


_BEYOND = {
    rule.name: " OR ".join(
        f"{rule.part} / {rule.whole} {'>' if end == 'high' else '<'} {_level(f'{rule.name}_{end}')}" for r, end in _ENDS if r is rule
    )
    for rule in rules.RULES
}
RULES = f"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i : i + 2] AS found FROM texts, unnest(range(1, len(w) - 1)) AS u(i)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, found) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest(range(3)) AS u(k) GROUP BY doc_id),
lines AS (
    SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
    SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines,
        coalesce(repeated.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
    FROM texts LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
measured AS ({" UNION ALL ".join(f"SELECT lang, source, '{r.name}' AS rule, {r.part} / {r.whole} AS share FROM counted WHERE n_words > 0" for r in rules.RULES)}),
shares AS (SELECT lang, source, rule, CASE WHEN share > 0 THEN ceil(ln(share) / {math.log(rules.GAMMA)!r}::DOUBLE) ELSE {_NONE} END AS bucket FROM measured),
f AS ({_limits("lang, source")}), l AS ({_limits("lang")}), a AS ({_limits("")}),
judged AS (
    SELECT counted.*, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed,
        concat_ws(',', {", ".join(f"CASE WHEN n_words > 0 AND ({beyond}) THEN '{name}' END" for name, beyond in _BEYOND.items())}) AS failed_rules
    FROM counted LEFT JOIN f USING (lang, source) LEFT JOIN l USING (lang) LEFT JOIN a ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM judged
"""

_HALF = lambda start, stop: f"array_to_string(w[{start} : {stop}], ' ')"
PHRASES = f"""
WITH pieces AS (
    SELECT coalesce(lang, '{phrases.NO_LANG}') AS lang,
        regexp_extract_all(unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
    FROM documents),
counts AS (
    SELECT lang, array_to_string(words[i : i + size - 1], ' ') AS phrase, any_value(words[i : i + size - 1]) AS w, any_value(size) AS size, count(*) AS n
    FROM pieces, unnest(range(1, {phrases.LONGEST + 1})) AS s(size), unnest(range(1, len(words) - size + 2)) AS t(i) GROUP BY 1, 2),
sizes AS (SELECT lang, sum(n) AS n FROM counts WHERE size = 1 GROUP BY lang),
often AS (SELECT * FROM counts WHERE n >= {phrases.LEAST}),
cuts AS (
    SELECT c.lang, c.phrase, k, c.n AS a, l.n AS l, r.n AS r, sizes.n AS n,
        CAST((1000 * c.n::HUGEINT * sizes.n::HUGEINT) // (l.n::HUGEINT * r.n::HUGEINT) AS BIGINT) AS score
    FROM often c, unnest(range(1, c.size)) AS u(k) JOIN sizes ON sizes.lang = c.lang
    JOIN often l ON l.lang = c.lang AND l.phrase = {_HALF(1, "k").replace("w[", "c.w[")}
    JOIN often r ON r.lang = c.lang AND r.phrase = {_HALF("k + 1", "c.size").replace("w[", "c.w[")}),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, {_HALF("i", "i + m - 1")} AS phrase, max(n) AS held
    FROM often, unnest(range(2, size)) AS u(m), unnest(range(1, size - m + 2)) AS v(i) WHERE size > 2 GROUP BY 1, 2),
kept AS (SELECT worst.* FROM worst LEFT JOIN inside USING (lang, phrase) WHERE held IS NULL OR 100 * held < {phrases.COVERED} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept QUALIFY rank <= {phrases.TOP}
"""

ORACLES: dict[str, str] = {
    "op2_maxscore_top_k": MAXSCORE,
    "op6_secret_scan": SECRETS,
    "op9_url_filter": URLS,
    "op10_decontamination": LEAKS,
    "op11_importance_resampling": RESAMPLED,
    "op12_quality_rules": RULES,
    "op13_collocations": PHRASES,
}
