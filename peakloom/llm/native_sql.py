"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import math

from peakloom.llm import filter_audit, license_scan, line_dedup, mixing, near_dedup, quality_rules, spelling

_W = r"[^\x20\x09-\x0D]+"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def line_dedup_sql() -> str:
    return f"""
WITH ln AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
bad AS (SELECT trim(line, {_TRIM}) AS k FROM ln WHERE trim(line, {_TRIM}) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}),
marked AS (SELECT ln.*, bad.k IS NOT NULL AS hit FROM ln LEFT JOIN bad ON trim(line, {_TRIM}) = bad.k),
per AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_boilerplate, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit) AS cleaned FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n_boilerplate > 0 THEN coalesce(cleaned, '') ELSE text END AS text, d.lang, d.source, d.n_chars,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_boilerplate, 0)::BIGINT AS n_boilerplate, coalesce(n_boilerplate, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN per USING (doc_id)"""


def mixing_sql() -> str:
    seed, more = mixing.SEED, mixing.SEED + 1
    return f"""
WITH sizes AS (SELECT coalesce(source, '') AS s, sum(greatest(coalesce(length(text), 0), 1))::BIGINT AS n FROM documents GROUP BY 1),
rates AS (SELECT s, pow(n::DOUBLE, {mixing.ALPHA}) / sum(pow(n::DOUBLE, {mixing.ALPHA})) OVER () * sum(n) OVER () / n AS r FROM sizes),
terms AS (SELECT s, r, unnest(range(0, ceil(r + 12 * sqrt(r) + 20)::BIGINT + 1)) AS k FROM rates),
cdf AS (SELECT s, sum(exp(k * ln(r) - r - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
drawn AS (SELECT d.*, (('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT doc_id, count(*) AS n FROM drawn JOIN cdf ON coalesce(source, '') = cdf.s AND cdf.c < u GROUP BY doc_id),
copies AS (SELECT doc_id, unnest(range(1, n + 1))::INT AS copy FROM counted)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, copy, md5('{more}|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || copy) AS shuffle_key FROM documents d JOIN copies USING (doc_id)"""


def quality_sql() -> str:
    q = quality_rules
    k = range(len(q.RULES))
    ctes = [
        f"f AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls, coalesce(text, '') AS t FROM documents)",
        "g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM f))",
        "rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY 1)",
        rf"""x AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^{q.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^{q.MARKS}]+', '', 'g'))::BIGINT AS n_marks, length(regexp_replace(t, '[^{q.TERMINALS}]+', '', 'g'))::BIGINT AS n_terminals, length(regexp_replace(t, '[^{q.CAPITALS}]+', '', 'g'))::BIGINT AS n_upper FROM f LEFT JOIN rep USING (doc_id))""",
    ]
    votes = []
    for i, (_, top, bottom, good, bad) in enumerate(q.RULES):
        v = f"{top}::DOUBLE" + (f" / nullif({bottom}, 0)" if bottom else "")
        inside = lambda lo, hi, v=v: f"({v} >= {lo}" + (f" AND {v} <= {hi})" if hi < math.inf else ")")
        votes.append(f"CASE WHEN n_words = 0 THEN 0 WHEN {inside(*good)} THEN 1 WHEN NOT {inside(*bad)} THEN -1 ELSE 0 END AS v{i}")
    ctes.append(f"v AS MATERIALIZED (SELECT *, {', '.join(votes)} FROM x)")
    failed = f"(n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words)"
    ctes.append(f"p AS MATERIALIZED (SELECT {', '.join(f'v{i}' for i in k)}, count(*) AS c FROM v WHERE NOT {failed} GROUP BY ALL)")
    ctes.append(f"m0 AS (SELECT {q.START_PRIOR}::DOUBLE AS pr, {', '.join(f'{q.START_GOOD}::DOUBLE AS g{i}, {q.START_BAD}::DOUBLE AS b{i}' for i in k)})")
    z = "ln(pr / (1 - pr)) + " + " + ".join(f"CASE v{i} WHEN 1 THEN ln(g{i} / (1 - b{i})) WHEN -1 THEN ln((1 - g{i}) / b{i}) ELSE 0 END" for i in k)
    post = f"1 / (1 + exp(-({z})))"
    some = lambda what, when: f"coalesce(sum({what}) FILTER ({when}), 0)"
    for n in range(q.ITERATIONS):
        new = ", ".join(f"({some('q * c', f'v{i} = 1')} + {q.PSEUDO * q.START_GOOD}) / ({some('q * c', f'v{i} <> 0')} + {q.PSEUDO}) AS g{i}, ({some('(1 - q) * c', f'v{i} = -1')} + {q.PSEUDO * q.START_BAD}) / ({some('(1 - q) * c', f'v{i} <> 0')} + {q.PSEUDO}) AS b{i}" for i in k)
        ctes.append(f"m{n + 1} AS MATERIALIZED (SELECT (coalesce(sum(q * c), 0) + {q.PSEUDO * q.START_PRIOR}) / (coalesce(sum(c), 0) + {q.PSEUDO}) AS pr, {new} FROM (SELECT p.*, {post} AS q FROM p, m{n}))")
    return f"WITH {', '.join(ctes)} SELECT doc_id, {', '.join(q.FEATURES[:5])}, {failed} AS base_failed, NOT {failed} AND {post} >= 0.5 AS kept FROM v, m{q.ITERATIONS}"


def license_sql() -> str:
    s = license_scan

    def canonical(text: str) -> str:
        out = f"chr(10) || lower(coalesce({text}, '')) || chr(10)"
        for pattern, by in ((s.COPYRIGHT_LINE, ""), (s.PUNCTUATION, " "), (s.BLANKS, "\n"), *s.SPELLINGS):
            out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
        return f"trim({out}, ' ' || chr(10))"

    known = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in s.LICENSES)
    longer = ", ".join(f"({_quoted(k)}, {_quoted(d)})" for k, d in s.DIGESTS)
    return f"""
WITH known AS (SELECT min(k) AS license_id, digest FROM (SELECT k, sha256(replace({canonical('t')}, chr(10), ' ')) AS digest FROM (VALUES {known}) x(k, t) UNION ALL SELECT * FROM (VALUES {longer}) y(k, digest)) GROUP BY digest),
c AS (SELECT doc_id, {canonical('text')} AS c FROM documents),
ln AS (SELECT doc_id, license_id FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS l FROM c) JOIN known ON sha256(l) = digest),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids, count(*) AS n FROM ln GROUP BY doc_id)
SELECT c.doc_id, known.license_id, coalesce(ids, '') AS notice_ids, coalesce(n, 0)::BIGINT AS n_notices FROM c LEFT JOIN known ON sha256(replace(c, chr(10), ' ')) = digest LEFT JOIN n USING (doc_id)"""


def near_dedup_sql() -> str:
    n = near_dedup
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({lower}, ''), '{_W}') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= {n.SHINGLE} THEN list_transform(range(1, len(w) - {n.SHINGLE - 2}), lambda i: array_to_string(w[i:i + {n.SHINGLE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {n.PERCENT} * (p.n + q.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(b, w.doc_id)) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = w.doc_id"""


def spelling_sql() -> str:
    s = spelling
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    data = "list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)"
    return f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all({lower}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)) AS h FROM (SELECT doc_id, run, count(*) AS c FROM r WHERE length(run) >= {s.MIN_LENGTH} GROUP BY ALL)),
k AS MATERIALIZED (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda x, b: xor(x >> 8, t.t[(xor(x, b) % 256 + 1)::INT]))) AS h FROM d, t),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % {s.SLIP} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM k) WHERE length(word) >= {s.MIN_LENGTH} GROUP BY word HAVING sum(c) >= {s.MIN_COUNT}),
e AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS form, b.n FROM e a JOIN e b ON a.k = b.k AND a.i = b.i AND a.word <> b.word UNION SELECT e.word, w.word, w.n FROM e JOIN w ON e.k = w.word UNION SELECT w.word, e.word, e.n FROM e JOIN w ON e.k = w.word),
best AS (SELECT word, count(*) AS n_near, min((-n, form)) AS b FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b[1] >= {s.RATIO} * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= {s.RATIO} * w.n THEN -b[1] END AS form_n FROM w LEFT JOIN best USING (word)),
walk(word, last, next) AS (SELECT word, word, form FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT f.word, f.form, walk.last AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL"""


def audit_sql() -> str:
    a = filter_audit
    letters = ", ".join(f"(SELECT unnest(string_split('{','.join(a.FILTERS)}', ',')) AS f) {x}" for x in a.FILTERS.lower())
    before = " OR ".join(f"(fails_{x} AND strpos(o, '{x}') < step)" for x in a.FILTERS)
    own = "CASE f " + " ".join(f"WHEN '{x}' THEN fails_{x}" for x in a.FILTERS) + " END"
    total = " + ".join(f"fails_{x}::INT" for x in a.FILTERS)
    return f"""
WITH x AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
c AS (SELECT t, min(doc_id) AS least FROM x GROUP BY t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, len(w) < {a.MIN_WORDS} AS fails_A, 100 * len(list_distinct(w)) < {a.DISTINCT_PERCENT} * len(w) AS fails_B, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {a.CAPITAL_PERCENT} * length(t) AS fails_C,
  regexp_matches(t, '[{a.SYMBOLS}]') AS fails_D, coalesce(x.doc_id > least, false) AS fails_E, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM x JOIN c USING (t) LEFT JOIN l ON l.doc_id = x.doc_id),
g AS MATERIALIZED (SELECT *, {total} AS fails, count(*) AS n FROM (SELECT * FROM m) GROUP BY ALL),
o AS (SELECT {' || '.join(f'{x}.f' for x in a.FILTERS.lower())} AS o FROM {letters} WHERE len(list_distinct([{', '.join(f'{x}.f' for x in a.FILTERS.lower())}])) = {len(a.FILTERS)}),
s AS (SELECT o, step::INT AS step, o[step::INT] AS f FROM o, range(1, {len(a.FILTERS) + 1}) r(step)),
q AS (SELECT part, o, step, f, fails, n, good, toxic, {own} AS own, ({before}) AS before FROM g, s),
r AS (SELECT part, o, step, f, sum(CASE WHEN NOT own AND NOT before THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT before THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN own AND before THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN own AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN own AND NOT before AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT before AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM q GROUP BY ALL)
SELECT part, o AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
