"""SQL twins of the corpus queries that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _place(url: str) -> str:
    """host and path of a url expression."""
    rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"


_KEY = r"CASE WHEN {0}host <> '' THEN {0}host || regexp_replace({0}path, '/+$', '') || {0}query END"
_HREF, _TO = r"""(?is)\bhref\s*=\s*["'']?([^"''\s>]+)""", r"""(?is)\burl\s*=\s*["'']?([^"''\s>]+)"""
_ABSOLUTE = "CASE WHEN raw = '' OR starts_with(raw, '#') THEN NULL WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN raw WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') OR site = '' THEN NULL WHEN starts_with(raw, '//') THEN scheme || ':' || raw WHEN starts_with(raw, '/') THEN site || raw WHEN starts_with(raw, '?') THEN site || path || raw ELSE site || coalesce(nullif(regexp_extract(path, '^.*/'), ''), '/') || regexp_extract(raw, '^[^#]*') END"

#: Segments of one and two dots in relative links are left as they are here; no page of the tables has such a link.
OP4 = rf"""WITH RECURSIVE rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, coalesce(url, '') AS url, {_place("coalesce(url, '')")}, regexp_extract(coalesce(url, ''), '://[^?#]*(\?[^#]*)', 1) AS query, html FROM pages),
k AS (SELECT *, {_KEY.format("")} AS key, regexp_extract(url, '^(.*?)://', 1) AS scheme, regexp_extract(url, '^.*?://[^/?#]*') AS site FROM p),
tags AS (SELECT key, scheme, site, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM k WHERE key IS NOT NULL),
raws AS (SELECT key, scheme, site, path, replace(CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '{_HREF}', 1) WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '{_TO}', 1) ELSE '' END, '&amp;', '&') AS raw FROM tags),
t AS (SELECT key AS a, {_ABSOLUTE} AS target FROM raws),
ends AS (SELECT a, {_place("target")}, regexp_extract(target, '://[^?#]*(\?[^#]*)', 1) AS query FROM t WHERE target IS NOT NULL),
e AS (SELECT DISTINCT a, {_KEY.format("")} AS b, host, path FROM ends WHERE host <> ''),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
places AS (SELECT DISTINCT host, path FROM k UNION SELECT host, path FROM e),
fit AS (SELECT host, path, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, rverdict = 'allow' DESC, rhost DESC) AS place
  FROM places JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (SELECT host, path, rule, rverdict FROM fit WHERE place = 1),
named AS (SELECT key, rverdict FROM k JOIN best USING (host, path) UNION SELECT b, rverdict FROM e JOIN best USING (host, path)),
votes AS (SELECT a AS key, bool_or(rverdict = 'allow') AS allowed, bool_or(rverdict = 'block') AS blocked FROM reach JOIN named ON named.key = reach.b GROUP BY a)
SELECT page_id, k.host, k.path, rule, coalesce(rverdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM k LEFT JOIN best ON best.host = k.host AND best.path = k.path LEFT JOIN votes ON votes.key = k.key"""

_ESC = r"replace(replace(replace({0}, '\', '\\'), '###', '\h'), '</turn>', '\e')"
OP6 = rf"""WITH rows AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
loss AS (SELECT conv_id, string_agg(text, '' ORDER BY turn, role, text) AS loss FROM rows WHERE role = 'assistant' GROUP BY conv_id),
told AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(4 + length(replace({_ESC.format('role')}, chr(10), '\n')) + 1 + length({_ESC.format('text')}) + 8) AS BIGINT) AS formatted_chars FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(coalesce(loss, '')) AS loss_chars, sha256(coalesce(loss, '')) AS loss_sha256, formatted_chars FROM told LEFT JOIN loss USING (conv_id)"""


def _sets(name: str, tokens: str, part: str) -> str:
    """The templates that forms propose by their tokens' frequencies within ``part``."""
    return f"""{name} AS (SELECT n, lead, form, docs, word, spot, last_value(hash(spot, word)) OVER w AS last,
  list_filter([CASE WHEN k + 3 >= n * 0.7 AND k + 3 < n THEN kept END, CASE WHEN m + 3 = n AND m + 2 >= n * 0.7 THEN xor(whole, hash(spot, word)) END], lambda x: x IS NOT NULL) AS sets
  FROM (SELECT *, bit_xor(hash(spot, word)) OVER (PARTITION BY form ORDER BY w DESC, spot ROWS UNBOUNDED PRECEDING) AS kept, row_number() OVER (PARTITION BY form ORDER BY w DESC, spot) AS k,
      bit_xor(hash(spot, word)) OVER (PARTITION BY form) AS whole, count(*) OVER (PARTITION BY form) AS m
    FROM (SELECT *, sum(docs) OVER (PARTITION BY {part}, spot, word) AS w FROM {tokens}) WHERE w >= 3)
  WINDOW w AS (PARTITION BY form ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


_WHITE = r"[\s\x{00a0}]+"
OP7 = rf"""WITH raw AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, row_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM raw),
masked AS (SELECT *, regexp_replace(trim(regexp_replace(line, '{_WHITE}', ' ', 'g'), ' '), '[^ ]*\d[^ ]*', '<*>', 'g') AS form FROM lines),
l AS (SELECT doc_id, text, form, len(string_split(form, ' ')) AS n, array_to_string(string_split(form, ' ')[1:3], ' ') AS lead FROM masked WHERE form <> ''),
per_doc AS (SELECT DISTINCT n, lead, form, doc_id, text FROM l),
forms AS (SELECT n, lead, form, count(*) AS docs FROM per_doc GROUP BY ALL),
exact AS (SELECT form FROM forms WHERE docs >= 3),
mixed AS (SELECT n, lead FROM forms GROUP BY ALL HAVING count(*) > 1 AND sum(docs) >= 3 AND n > 3),
tokens AS (SELECT f.n, f.lead, form, docs, unnest(string_split(form, ' ')) AS word, generate_subscripts(string_split(form, ' '), 1) AS spot FROM forms f JOIN mixed m ON f.n = m.n AND f.lead = m.lead),
{_sets("near", "(SELECT * FROM tokens WHERE spot > 3)", "n, lead")},
{_sets("far", "near", "n, lead, last")},
proposed AS (SELECT DISTINCT n, lead, form, docs, unnest(sets) AS kept FROM (SELECT n, lead, form, docs, sets FROM near UNION ALL SELECT n, lead, form, docs, sets FROM far)),
bound AS (SELECT n, lead, kept FROM proposed GROUP BY ALL HAVING sum(docs) >= 3 AND count(*) > 1),
members AS (SELECT p.n, p.lead, p.form, p.kept FROM proposed p JOIN bound b ON p.n = b.n AND p.lead = b.lead AND p.kept = b.kept),
covered AS (SELECT n, lead, kept FROM (SELECT DISTINCT m.n, m.lead, m.kept, p.doc_id, p.text FROM members m JOIN per_doc p ON p.n = m.n AND p.lead = m.lead AND p.form = m.form) GROUP BY ALL HAVING count(*) >= 3),
gone AS (SELECT form FROM exact UNION SELECT form FROM members m JOIN covered c ON m.n = c.n AND m.lead = c.lead AND m.kept = c.kept),
flagged AS (SELECT *, form <> '' AND form IN (SELECT form FROM gone) AS drop FROM masked)
SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (drop) AS INT) AS n_dropped, length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '')) AS kept_chars,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '')) AS kept_sha256 FROM flagged GROUP BY doc_id, row_id"""

_WORD = r"[^\x20\x09-\x0D]+"
_MEASURES = {"word_length": ("word_chars", "n_words", 3000), "symbols": ("n_symbols", "n_words", 50), "dup_lines": ("n_dup_lines", "n_lines", 500)}
_SHARE = {m: f"(1000 * {part} // greatest({whole}, 1))" for m, (part, whole, _) in _MEASURES.items()}
_LOW = "value - value % CAST(pow(2, greatest(length(bin(value)) - 7, 0)) AS BIGINT)"


def _level(name: str, keys: str) -> str:
    by = f"{keys}, m" if keys else "m"
    return f"""{name}_b AS (SELECT {by}, low, sum(n) AS n FROM fine GROUP BY ALL),
{name}_c AS (SELECT {by}, low, sum(n) OVER (PARTITION BY {by} ORDER BY low) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM {name}_b),
{name} AS (SELECT {by}, any_value(total) AS total, min(low) FILTER (4 * upto >= total) AS q1, min(low) FILTER (4 * upto >= 3 * total) AS q3 FROM {name}_c GROUP BY ALL)"""


OP13 = rf"""WITH raw AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
wins AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS win FROM raw WHERE len(w) >= 5),
twice AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) AS t(k) GROUP BY rid),
told AS (SELECT rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls, coalesce(n, 0) AS n_repeat_words FROM raw LEFT JOIN cover USING (rid)),
f AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM told),
long AS ({" UNION ALL ".join(f"SELECT rid, lang, source, base_failed, '{m}' AS m, {v} AS value FROM f" for m, v in _SHARE.items())}),
fine AS (SELECT lang, source, m, {_LOW} AS low, count(*) AS n FROM long WHERE NOT base_failed GROUP BY ALL),
{_level("own", "lang, source")},
{_level("wide", "lang")},
{_level("whole", "")},
judged AS (SELECT l.rid, bool_and(value <= q3 + reach AND (l.m <> 'word_length' OR value >= q1 - reach)) AS inside FROM (SELECT l.rid, l.m, l.value,
    CASE WHEN o.total >= 100 THEN o.q1 WHEN v.total >= 100 THEN v.q1 ELSE a.q1 END AS q1, CASE WHEN o.total >= 100 THEN o.q3 WHEN v.total >= 100 THEN v.q3 ELSE a.q3 END AS q3,
    greatest(3 * (CASE WHEN o.total >= 100 THEN o.q3 - o.q1 WHEN v.total >= 100 THEN v.q3 - v.q1 ELSE a.q3 - a.q1 END), CASE l.m {" ".join(f"WHEN '{m}' THEN {least}" for m, (_, _, least) in _MEASURES.items())} END) AS reach
  FROM long l LEFT JOIN own o ON o.m = l.m AND o.lang IS NOT DISTINCT FROM l.lang AND o.source IS NOT DISTINCT FROM l.source
  LEFT JOIN wide v ON v.m = l.m AND v.lang IS NOT DISTINCT FROM l.lang LEFT JOIN whole a ON a.m = l.m) l GROUP BY l.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, true) AS kept FROM f LEFT JOIN judged USING (rid)"""

_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC32 = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({{0}}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: {_BIT})), 4294967295)"
_FORCED = {0: 2, 1: 2, 2: 3, 3: 2}
_NAME = {2: "user", 3: "assistant"}


def _moves() -> str:
    """Edits of a row after up to two inserts, as (state, letters, cost, state after, rows in front, role, first letter needed)."""
    rows = []
    for q in range(4):
        at, front = q, ""
        for k in range(3):
            kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
            ins = "I" * k
            rows.append(f"({q}, '{ins}D', {3 * k + 4}, {at}, '{front}', NULL, NULL)")
            rows.append(f"({q}, '{ins}R', {3 * k + 3}, {_FORCED[at]}, '{front}', '{_NAME[_FORCED[at]]}', NULL)")
            rows += [f"({q}, '{ins}K', {3 * k}, {to}, '{front}', NULL, '{first}')" for (first, state), to in kept.items() if state == at]
            at = _FORCED[at]
            front += f"~{_NAME[at]}:"
    return ", ".join(rows)


#: A forward search that keeps, for each state, the cheapest edits and of these the least letters.
OP11 = rf"""WITH RECURSIVE moves(q, letters, paid, q2, front, new_role, needs) AS (VALUES {_moves()}),
ends(q, letters, paid, front) AS (VALUES (0, '', 0, ''), (3, '', 0, ''), (2, 'I', 3, '~assistant:'), (1, 'II', 6, '~user:~assistant:')),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, (VALUES (1), (2)) AS t(copy) WHERE hit <> 0 AND (copy = 1 OR hit = 3)),
o AS (SELECT *, row_number() OVER own AS i, lag(substr(role, 1, 1)) OVER own || substr(role, 1, 1) AS two
  FROM r WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM n),
dp(conv_id, i, q, cost, audit, said) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '', '' FROM f
  UNION ALL SELECT f.conv_id, f.i, q2, CAST(min(lpad(CAST(cost + paid + more AS VARCHAR), 9, '0') || audit || letters)[1:9] AS INT), min(lpad(CAST(cost + paid + more AS VARCHAR), 9, '0') || audit || letters)[10:],
    arg_min(said || replace(front, '~', chr(10)) || CASE WHEN right(letters, 1) = 'D' THEN '' ELSE chr(10) || coalesce(new_role, role) || ':' || text END, lpad(CAST(cost + paid + more AS VARCHAR), 9, '0') || audit || letters)
  FROM dp JOIN (SELECT *, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS cut FROM f) f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
  JOIN moves m ON m.q = dp.q AND (needs IS NULL OR needs = substr(role, 1, 1)) AND (right(letters, 1) = 'D' OR fault NOT IN ('blank', 'duplicate')),
  LATERAL (SELECT CASE WHEN right(letters, 1) = 'D' THEN 0 ELSE cut END AS more) GROUP BY f.conv_id, f.i, q2),
done AS (SELECT dp.conv_id, min(lpad(CAST(cost + paid AS VARCHAR), 9, '0') || audit || letters) AS best, arg_min(said || replace(front, '~', chr(10)), lpad(CAST(cost + paid AS VARCHAR), 9, '0') || audit || letters) AS said
  FROM dp JOIN (SELECT conv_id, max(i) AS rows FROM f GROUP BY ALL) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.rows = dp.i JOIN ends e ON e.q = dp.q GROUP BY dp.conv_id),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best[1:9], '0') AS BIGINT) AS cost, coalesce(best[10:], '') AS audit, sha256(coalesce(said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id"""
