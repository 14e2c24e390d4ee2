"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from .chats import END, OTHER, OWN, SEGMENT, SYSTEM, SYSTEM_ROLES
from .licenses import COVERAGE, GAP, K, PHRASES, TEMPLATES
from .urls import BASE_RULES, SPAM_GLOBS

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str, pattern: str, fold: bool) -> str:
    text = f"coalesce({text}, '')"
    return f"regexp_extract_all({f"translate({text}, '{AZ}', '{az}')" if fold else text}, '{pattern}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP2 = f"""
WITH w AS (SELECT doc_id, {words("text", SPACED, False)} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM w, unnest(range(1, len(ws) - 33)) AS t(i) WHERE len(ws) >= 35),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, range(0, 35) AS r(j)),
each AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

#: The digest from its description: hashed triplets of bytes, codes of 2,048 buckets by quartiles, and the two likenesses.
OP5 = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS rn, doc_id, coalesce(text, '') AS t FROM documents),
e AS MATERIALIZED (SELECT a.rn, b.rn AS nx, a.doc_id, a.t, substr(a.t, 1, length(a.t) - length(a.t) // 3) || substr(b.t, 1, length(a.t) // 3) AS ed FROM d a JOIN d b ON b.rn = a.rn % (SELECT count(*) FROM d) + 1),
u AS MATERIALIZED (SELECT rn, kind, octet_length(encode(x)) AS n, hex(encode(x)) || CASE octet_length(encode(x)) WHEN 1 THEN '0000' WHEN 2 THEN '00' ELSE '' END AS h FROM (SELECT rn, 0 AS kind, t AS x FROM e UNION ALL SELECT rn, 1, ed FROM e)),
l AS MATERIALIZED (SELECT rn, kind, n, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::UBIGINT) AS l FROM u),
w AS MATERIALIZED (SELECT rn, kind, l[i] AS x, l[i + 1] AS y, l[i + 2] AS z, l[i + 3] AS q FROM l, unnest(range(1, len(l) - 2)) AS r(i)),
g AS MATERIALIZED (SELECT rn, kind, x * 65536 + y * 256 + z AS g FROM w UNION ALL SELECT rn, kind, x * 65536 + y * 256 + q + 16777216 FROM w UNION ALL SELECT rn, kind, x * 65536 + z * 256 + q + 33554432 FROM w
  UNION ALL SELECT rn, kind, l[-3] * 65536 + l[-2] * 256 + l[-1] FROM l WHERE n > 0),
m AS MATERIALIZED (SELECT rn, kind, g * 2654435761::UBIGINT % 4294967296 AS k FROM g),
c AS MATERIALIZED (SELECT rn, kind, ((xor(k, k >> 15) * 2246822519::UBIGINT % 4294967296) >> 21)::INT AS bucket, count(*) AS c FROM m GROUP BY ALL),
f AS MATERIALIZED (SELECT u.rn, u.kind, b AS bucket, coalesce(c, 0) AS c FROM u CROSS JOIN range(0, 2048) AS t(b) LEFT JOIN c ON c.rn = u.rn AND c.kind = u.kind AND bucket = b),
q AS MATERIALIZED (SELECT rn, kind, list_sort(list(c)) AS s FROM f GROUP BY rn, kind),
k AS MATERIALIZED (SELECT rn, kind, bucket, (c > s[512])::INT + (c > s[1024])::INT + (c > s[1536])::INT AS code FROM f JOIN q USING (rn, kind)),
z AS MATERIALIZED (SELECT rn, kind, least(255, round(4 * log2(1 + n)))::INT AS size FROM u),
p AS MATERIALIZED (SELECT rn, kind, to_base64(from_hex(printf('%02X', any_value(size)) || string_agg(printf('%02X', byte), '' ORDER BY nth))) AS fingerprint FROM (SELECT rn, kind, bucket // 4 AS nth, sum(code << (6 - 2 * (bucket % 4)))::INT AS byte FROM k GROUP BY ALL) JOIN z USING (rn, kind) GROUP BY rn, kind),
pair AS MATERIALIZED (SELECT rn, 0 AS what, rn AS other, 1 AS okind FROM e UNION ALL SELECT rn, 1, nx, 0 FROM e),
s AS MATERIALIZED (SELECT rn, kind, list(code ORDER BY bucket) AS codes FROM k GROUP BY rn, kind),
both_ AS MATERIALIZED (SELECT rn, what, unnest(x) AS x, unnest(y) AS y FROM (SELECT pair.rn, what, a.codes AS x, b.codes AS y FROM pair JOIN s a ON a.rn = pair.rn AND a.kind = 0 JOIN s b ON b.rn = other AND b.kind = okind)),
differ AS MATERIALIZED (SELECT rn, what, sum(CASE WHEN abs(x - y) = 3 THEN 6 ELSE abs(x - y) END) AS v FROM both_ GROUP BY ALL),
chance AS MATERIALIZED (SELECT a.rn, a.what, sum(a.n * b.n * CASE WHEN abs(a.x - b.y) = 3 THEN 6 ELSE abs(a.x - b.y) END)::DOUBLE / 2048 AS v FROM (SELECT rn, what, x, count(*) AS n FROM both_ GROUP BY ALL) a JOIN (SELECT rn, what, y, count(*) AS n FROM both_ GROUP BY ALL) b ON a.rn = b.rn AND a.what = b.what GROUP BY ALL),
likeness AS MATERIALIZED (SELECT pair.rn, what, greatest(0.0::DOUBLE, 1.0::DOUBLE - CASE WHEN chance.v > 0 THEN differ.v::DOUBLE / chance.v WHEN differ.v > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 0.1::DOUBLE * least(1.0::DOUBLE, abs(a.size - b.size) / 16.0::DOUBLE)) AS v
  FROM pair JOIN differ USING (rn, what) JOIN chance USING (rn, what) JOIN z a ON a.rn = pair.rn AND a.kind = 0 JOIN z b ON b.rn = other AND b.kind = okind)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(ed) AS edited_sha256, a.fingerprint, b.fingerprint AS edited_fingerprint, x.v AS near_edited, y.v AS near_next
FROM e JOIN p a ON a.rn = e.rn AND a.kind = 0 JOIN p b ON b.rn = e.rn AND b.kind = 1 JOIN likeness x ON x.rn = e.rn AND x.what = 0 JOIN likeness y ON y.rn = e.rn AND y.what = 1
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words("text", SPACED, True)} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS s FROM w, unnest(range(1, len(ws))) AS t(i) WHERE len(ws) >= 2
  UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach(doc_id, r) AS (SELECT a, b FROM link UNION SELECT reach.doc_id, b FROM reach JOIN link ON a = r),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(r, doc_id)) AS component_id, coalesce(r, doc_id) >= doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP7 = f"""
WITH w AS (SELECT doc_id, {words("text", ALNUM, True)} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {words("text", ALNUM, True)} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(ws) - 8, 2))) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM w, sizes, unnest(range(1, len(ws) - n + 2)) AS t(i) WHERE len(ws) >= n),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN iw USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS r(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_system = ", ".join(map(quoted, SYSTEM_ROLES))
_before, _after = OTHER.split("{}")
nl = lambda text: "'" + text.replace("\n", "' || chr(10) || '") + "'"
_plain = lambda text: rf"regexp_replace({text}, '<(\\*)\|', '<\\\1|', 'g')"
_name = lambda text: rf"regexp_replace({_plain(text)}, '\|(\\*)>', '|\\\1>', 'g')"
OP8 = f"""
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE -1 END AS alone, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, count(*) OVER (PARTITION BY conv_id, alone) AS n FROM t),
s AS (SELECT DISTINCT conv_id, alone, role AS speaker FROM t WHERE role NOT IN ({_system})),
q AS (SELECT conv_id, alone, (pos // {SEGMENT}) AS segment, pos, role, text FROM p UNION ALL
  SELECT conv_id, alone, later, -1, role, text FROM p, unnest(range(1, (n - 1) // {SEGMENT} + 1)) AS r(later) WHERE pos = 0 AND role IN ({_system})),
v AS (SELECT q.*, speaker, {_plain("text")} || {nl(END)} AS body,
  CASE WHEN role = speaker THEN {nl(OWN)} WHEN role IN ({_system}) THEN {nl(SYSTEM)} ELSE {nl(_before)} || {_name("role")} || {nl(_after)} END AS head
  FROM q JOIN s ON q.conv_id IS NOT DISTINCT FROM s.conv_id AND q.alone = s.alone),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, alone, segment, speaker ORDER BY pos) AS stop FROM v)
SELECT conv_id, segment::BIGINT AS segment, speaker, (count(*) FILTER (WHERE pos >= 0))::BIGINT AS n_turns, string_agg(head || body, '' ORDER BY pos) AS rendered,
  coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY pos) FILTER (WHERE role = speaker), '') AS mask,
  coalesce(sum(length(body)) FILTER (WHERE role = speaker), 0)::BIGINT AS n_learnt
FROM o GROUP BY conv_id, alone, segment, speaker
"""


def _glob_regex(glob: str) -> str:
    parts = []
    for piece in glob.split("**"):
        parts.append("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/-_" else "\\" + c for c in piece))
    return "(?s)" + ".*".join(parts)


_fits = " ".join(f"WHEN regexp_full_match(c, '{_glob_regex(r.glob)}') THEN '{r.name}'" for r in sorted(BASE_RULES, key=lambda r: -r.rank))
_verdicts = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in BASE_RULES)
_spam = " OR ".join(f"regexp_full_match(c, '{_glob_regex(r.glob)}')" for r in SPAM_GLOBS)
OP9 = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{AZ}', '{az}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {_fits} END AS rule FROM (SELECT *, '.' || host || path AS c FROM u))
SELECT page_id, host, path, rule, CASE rule {_verdicts} ELSE CASE WHEN {_spam} THEN 'block' ELSE 'allow' END END AS verdict FROM r
"""

_templates = ", ".join(f"({i}, {quoted(label)}, {phrase}, string_split({quoted(text)}, ' '))" for i, (label, text, phrase) in enumerate([(label, text, "true") for text, label in PHRASES.items()] + [(label, text, "false") for label, text in TEMPLATES]))
OP10 = f"""
WITH w AS (SELECT doc_id, {words("text", ALNUM, True)} AS ws FROM documents),
t(template, label, phrase, tw) AS (VALUES {_templates}),
tr AS (SELECT template, label, phrase, len(tw) - {K - 1} AS runs, a, array_to_string(tw[a + 1:a + {K}], ' ') AS gram FROM t, unnest(range(0, len(tw) - {K - 1})) AS r(a)),
dr AS (SELECT doc_id, i AS pos, array_to_string(ws[i + 1:i + {K}], ' ') AS gram FROM w, unnest(range(0, len(ws) - {K - 1})) AS r(i) WHERE len(ws) >= {K}),
v AS (SELECT doc_id, template, label, phrase, runs, a, pos, pos - a AS diagonal FROM dr JOIN tr USING (gram)),
place AS (SELECT doc_id, label, diagonal AS start FROM v WHERE phrase GROUP BY doc_id, template, label, runs, diagonal HAVING count(*) = runs),
lines AS (SELECT DISTINCT doc_id, template, diagonal FROM v WHERE NOT phrase),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS fresh FROM lines),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS g FROM marked),
votes AS (SELECT v.*, g FROM v JOIN grouped USING (doc_id, template, diagonal) WHERE NOT phrase),
stepped AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER near) > {GAP} OR pos - lag(pos) OVER near > {K + GAP} THEN 1 ELSE 0 END AS breaks FROM votes WINDOW near AS (PARTITION BY doc_id, template, g ORDER BY pos, a)),
parted AS (SELECT *, sum(breaks) OVER (PARTITION BY doc_id, template, g ORDER BY pos, a ROWS UNBOUNDED PRECEDING) AS part FROM stepped),
onward AS (SELECT *, a > coalesce(max(a) OVER (PARTITION BY doc_id, template, g, part ORDER BY pos, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS forth FROM parted),
measured AS (SELECT doc_id, label, (count(*) FILTER (WHERE forth))::DOUBLE / greatest(runs, max(pos) - min(pos) + 1) AS coverage FROM onward GROUP BY doc_id, template, label, runs, g, part),
span AS (SELECT * FROM measured WHERE coverage >= {COVERAGE}),
base AS (SELECT doc_id, count(*) AS n, min(start) AS f, max(start) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM (SELECT doc_id, label, coverage FROM span UNION ALL SELECT doc_id, label, 1.0 FROM place) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""

ORACLES = {"op2_substring_dedup": OP2, "op5_quartile_digest": OP5, "op6_minmax_neardups": OP6, "op7_decontamination": OP7, "op8_perspectives": OP8, "op9_url_filter": OP9, "op10_license_scan": OP10}
