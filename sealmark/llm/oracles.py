"""DuckDB texts of the operators that SQL expresses."""

WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
gram AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM g),
twice AS (SELECT doc_id, i FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 14 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""

LINES = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, source, i, l[i] AS line, regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
b AS (SELECT bare, min(doc_id) AS first_doc FROM x WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10),
k AS (SELECT x.doc_id, count(*) FILTER (b.bare IS NOT NULL AND x.doc_id <> b.first_doc) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (b.bare IS NULL OR x.doc_id = b.first_doc), '') AS t FROM x LEFT JOIN b ON b.bare = x.bare GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, length(coalesce(t, ''))::BIGINT AS kept_chars, sha256(coalesce(t, '')) AS text_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

_ESC = r"regexp_replace({0}, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESC.format('role')}) + length({_ESC.format('text')}) + 22)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

MIX = rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h, coalesce(doc_id::VARCHAR, '') AS id FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][(nr - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, level >= cap / weight AS is_full FROM l),
t AS (SELECT source, nr, source_size, CASE WHEN is_full THEN cap ELSE (SELECT arg_min(level, (cap / weight, nr)) FROM f WHERE NOT is_full) * weight END AS target FROM f),
q AS (SELECT d.*, t.nr, t.source_size, t.target, sum(size) OVER (PARTITION BY t.nr ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT doc_id, nr, h, id, size, p, (cum + source_size * p) / target AS finish FROM q, (VALUES (0), (1)) v(p) WHERE size > 0 AND target > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, nr, p, h, id, size ROWS UNBOUNDED PRECEDING) AS upto FROM e),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM g WHERE upto <= (SELECT sum(target) FROM t) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON k.doc_id = q.doc_id
"""


def _kind(kind: str, pattern: str, least: int, group: int, nr: int) -> str:
    return rf"""SELECT doc_id, {nr} AS nr, '{kind}' AS kind, i, g2, start, start + length(m) AS stop FROM (
  SELECT doc_id, i, ms[i] AS m, g2s[i] AS g2, (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT doc_id, ms, g2s, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS g2s, string_split_regex(t, '{pattern}') AS gaps
    FROM d) WHERE len(ms) > 0)) WHERE length(g2) >= {least}"""


def _secrets() -> str:
    from sealmark.llm.secrets import RULES

    kinds = " UNION ALL ".join(_kind(r.kind, ("(?i)" if r.any_case else "") + r.pattern.replace("'", "''"), r.least, r.group, nr) for nr, r in enumerate(RULES))
    digest = "kind || ':' || start || ':' || stop, ',' ORDER BY start, nr"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({kinds}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg({digest}) FILTER (nr < 3), '') AS base, coalesce(string_agg({digest}), '') AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""


_NEAR = r"regexp_matches(near, '(?:^|[^a-z])(?:{0})(?:[^a-z]|$)')::INT"
_LENGTHS = (
    "MAP {'AD': 24, 'AE': 23, 'AT': 20, 'BE': 16, 'BG': 22, 'CH': 21, 'CY': 28, 'CZ': 24, 'DE': 22, 'DK': 18, 'EE': 20, 'ES': 24, 'FI': 18, 'FR': 27, 'GB': 22, 'GR': 27, 'HR': 21, 'HU': 28, "
    "'IE': 22, 'IS': 26, 'IT': 27, 'LI': 21, 'LT': 20, 'LU': 20, 'LV': 21, 'MC': 27, 'MT': 31, 'NL': 18, 'NO': 15, 'PL': 28, 'PT': 25, 'RO': 24, 'SA': 24, 'SE': 24, 'SI': 19, 'SK': 24, 'SM': 27, 'TR': 26}"
)


def _proposed(nr: int, kind: str, pattern: str, stop: str, score: int, good: str, bad: str, where: str) -> str:
    return rf"""SELECT doc_id, {nr} AS nr, '{kind}' AS kind, start, {stop} AS stop, {score} + 20 * ({_NEAR.format(good)} - {_NEAR.format(bad)}) AS score
  FROM (SELECT *, lower(before) || ' ' || lower(after) AS near, regexp_replace(m, '[^0-9]', '', 'g') AS digits, start + length(m) AS upto FROM (
    SELECT doc_id, ms[i] AS m, right(gaps[i], 48) AS before, left(gaps[i + 1], 24) AS after,
      (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d) WHERE len(ms) > 0))) WHERE {where}"""


def _pii() -> str:
    luhn = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: (CASE WHEN i % 2 = 0 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][digits[-i]::INT + 1] ELSE digits[-i]::INT END))) % 10 = 0"
    turned = "(bare[5:] || bare[1:4])"
    number = f"list_reduce(list_transform(range(1, length(bare) + 1), lambda i: {turned}[i]), lambda a, c: CASE WHEN c BETWEEN '0' AND '9' THEN (a::INT * 10 + c::INT) % 97 ELSE (a::INT * 100 + ascii(c) - 55) % 97 END::VARCHAR, '0')::INT"
    kinds = [
        _proposed(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "upto", 90, "mail|email|contact|write", "path|handle", "true"),
        _proposed(1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "upto", 60, "ip|address|host|server|login", "version|release|section|build", "len(list_filter(string_split(m, '.'), lambda p: p::HUGEINT > 255)) = 0"),
        _proposed(2, "card", r"[0-9]([\x20-]?[0-9])+", "upto", 80, "card|visa|credit|debit|payment", "order|tracking|serial|invoice|isbn", f"length(digits) BETWEEN 13 AND 19 AND {luhn}"),
        _proposed(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "upto", 70, "phone|tel|call|mobile|fax", "score|offset|version", "length(digits) BETWEEN 9 AND 15"),
        _proposed(5, "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "upto", 40, "ssn|social|security", "serial|part|order",
                  "NOT regexp_matches(m, '^(000|666|9)|-00-|0000$') AND NOT regexp_matches(before, '[A-Za-z0-9-]$') AND NOT regexp_matches(after, '^[A-Za-z0-9-]')"),
    ]
    # an account number: the shortest head of the proposal with as many characters as its country has
    head = f"list_filter(list_transform(range(1, length(m) + 1), lambda k: m[1:k]), lambda h: length(replace(h, ' ', '')) = ({_LENGTHS})[m[1:2]])[1]"
    iban = _proposed(4, "iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", f"start + length({head})", 90, "iban|account|bank", "serial|part", "true")
    iban = iban.replace(" AS upto FROM (", f" AS upto, {head} AS head, replace({head}, ' ', '') AS bare FROM (").replace("WHERE true", rf"""WHERE head IS NOT NULL AND NOT regexp_matches(before, '[A-Za-z0-9]$')
  AND NOT regexp_matches((m || left(after, 1))[length(head) + 1:], '^[A-Za-z0-9]') AND {number} = 1""")
    digest = "kind || ':' || start || ':' || stop, ',' ORDER BY nr, start"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone", "iban", "ssn"))
    zeros = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in ("email", "ip", "card", "phone", "iban", "ssn"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT * FROM ({' UNION ALL '.join([*kinds, iban])}) WHERE nr < 4 OR score >= 50),
a AS (SELECT doc_id, {counts}, coalesce(string_agg({digest}) FILTER (nr < 4), '') AS base, string_agg({digest}) AS spans, sum(score) AS score_sum FROM m GROUP BY doc_id)
SELECT d.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(score_sum, 0)::BIGINT AS score_sum FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""


def _merkle(levels: int = 7) -> str:
    """Every level of the tree written out, for up to 8 ** levels leaves and as many groups."""
    said = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(said, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bit = "lambda c, k: xor(c >> 1, 3988292384 * (c & 1))"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], {bit}, xor(a, x)), 4294967295::BIGINT), 4294967295::BIGINT)"
    bare = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""leaves AS (SELECT doc_id, lang, {leaf('text')} AS h, CASE WHEN {crc} % 3 = 0 THEN {leaf(bare)} END AS changed FROM documents),
t0 AS (SELECT lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS nr, count(*) OVER (PARTITION BY lang) AS n, h FROM leaves)"""]

    def climb(name: str) -> None:
        for k in range(levels):
            below = f"{name}{k}"
            steps.append(f"""{name}{k + 1} AS (SELECT g, nr // 8 AS nr, max((n + 7) // 8) AS n, sha256(string_agg(h, '' ORDER BY nr)) AS h FROM {below} WHERE n > 1 GROUP BY g, nr // 8
  UNION ALL SELECT g, nr, n, h FROM {below} WHERE n = 1)""")

    climb("t")
    steps.append(f"u0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS nr, count(*) OVER () AS n, h, g AS lang FROM t{levels})")
    climb("u")
    # from a leaf to the root: its proof and the folded digest, level by level
    steps.append(f"""p0 AS (SELECT l.doc_id, l.h AS leaf, l.lang, l.rn AS nr, '' AS proof, coalesce(l.changed, l.h) AS now FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS rn FROM leaves) l)""")

    def fold(name: str, start: str, tree: str, g: str) -> str:
        at = start
        for k in range(levels):
            here = f"{name}{k + 1}"
            steps.append(f"""{tree}{k}r AS (SELECT g, nr // 8 AS up, list(h ORDER BY nr) AS run FROM {tree}{k} WHERE n > 1 GROUP BY g, nr // 8),
{here} AS (SELECT p.* EXCLUDE (nr, proof, now), CASE WHEN run IS NULL THEN p.nr ELSE p.nr // 8 END AS nr,
  CASE WHEN run IS NULL THEN proof ELSE proof || array_to_string(run[1:p.nr % 8] || run[p.nr % 8 + 2:], '') END AS proof,
  CASE WHEN run IS NULL THEN now ELSE sha256(array_to_string(run[1:p.nr % 8] || [now] || run[p.nr % 8 + 2:], '')) END AS now
  FROM {at} p LEFT JOIN {tree}{k}r r ON r.g IS NOT DISTINCT FROM {g} AND r.up = p.nr // 8)""")
            at = here
        return at

    last = fold("p", "p0", "t", "p.lang")
    steps.append(f"q0 AS (SELECT p.* EXCLUDE (nr), u.nr, u.h AS subroot FROM {last} p JOIN u0 u ON u.lang IS NOT DISTINCT FROM p.lang)")
    last = fold("q", "q0", "u", "0")
    copied = "CASE WHEN changed THEN 1 + depth ELSE 0 END"
    steps.append(f"""depths AS (SELECT lang AS of, CASE WHEN count(*) = 1 THEN 0 ELSE ceil(round(log2(count(*)) / 3, 9)) END + (SELECT CASE WHEN max(n) = 1 THEN 0 ELSE ceil(round(log2(max(n)) / 3, 9)) END FROM u0) AS depth FROM leaves GROUP BY lang)""")
    return f"""
WITH {', '.join(steps)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified, ({copied})::BIGINT AS copied
FROM (SELECT f.*, (SELECT max(h) FROM u{levels}) AS root, coalesce({crc} % 3 = 0, false) AS changed, depth FROM {last} f JOIN depths ON depths.of IS NOT DISTINCT FROM f.lang)
"""


ABLATION = f"""
WITH q AS ({QUALITY.strip()}),
r AS (SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'repeated_lines', 'short_words', 'long_words']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS bit)
SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_only, count(*) FILTER (failed_bits <> 0) AS n_rejected FROM q, r GROUP BY rule
"""


SQL = {
    "op1_line_dedup": LINES, "op2_chat_format": CHAT, "op6_secret_scan": _secrets(), "op7_source_mix": MIX, "op9_quality_rules": QUALITY, "quality_ablation": ABLATION,
    "op11_pii": _pii(), "op13_merkle_manifest": _merkle(),
}
