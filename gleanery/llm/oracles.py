"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACE = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
#: Words more than a window has, within which op3's proximity matches lie.
SLOP = 4
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL: dict[str, str] = {}

SQL["op3_positional_index"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_LOW.format("text"))} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_ALNUM.format(_LOW.format("text"))} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k + 1 : k + least(10, len(w))], ' ') AS g
       FROM (SELECT item, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item, dw.n, k FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1),
v AS (SELECT n, list_sort(list_distinct(string_split(g, ' '))) AS terms, list_distinct(list(item)) AS items, row_number() OVER () AS v FROM iw GROUP BY 1, 2),
-- the term of a window that fewest document words are, and all its terms around each place of that
q AS (SELECT word, count(*) AS often FROM (SELECT unnest(w) AS word FROM d) GROUP BY 1),
vt AS (SELECT v, n, len(terms) AS need, unnest(terms) AS word FROM v),
x AS (SELECT v, n, need, arg_min(vt.word, (coalesce(often, 0), vt.word)) AS word, min(coalesce(often, 0)) AS least FROM vt LEFT JOIN q USING (word) GROUP BY 1, 2, 3 HAVING least > 0),
y AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
z AS (SELECT DISTINCT v, doc_id, b AS begin FROM (SELECT x.v, n, need, doc_id, w, unnest(range(greatest(1, p - n - {SLOP} + 1), p + 1)) AS b FROM x JOIN y USING (word)) JOIN v USING (v)
      WHERE list_has_all(w[b : b + v.n + {SLOP} - 1], terms)),
o AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM (SELECT doc_id, unnest(items) AS item FROM z JOIN v USING (v)) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
"""

SQL["op6_curriculum"] = f"""
WITH s AS (SELECT doc_id, source, len({_SPACE.format("coalesce(text, '')")})::BIGINT AS size, ('0x' || substr(md5(doc_id::VARCHAR || '|mix'), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM p),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM c WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, (SELECT coalesce(first(level ORDER BY ratio, rank), 0) FROM l WHERE level <= ratio) * weight)::DOUBLE AS target FROM l),
o AS (SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
e AS (SELECT o.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, target - whole * source_size AS rest, size > 0 AND before + size <= target - whole * source_size AS fits FROM e),
g AS (SELECT *, rest - coalesce(max(CASE WHEN fits THEN before + size END) OVER (PARTITION BY source), 0) AS gap FROM f),
n AS (SELECT doc_id AS chosen FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), h, doc_id) AS k FROM g WHERE NOT fits AND size > 0 AND whole < 3 AND abs(size - gap) < gap) WHERE k = 1),
k AS (SELECT g.*, CASE WHEN size > 0 THEN whole + (fits OR chosen IS NOT NULL)::BIGINT ELSE 0 END::BIGINT AS n_takes, [-0.5, 0.0, 0.5][(rank - 1) % 3 + 1]::DOUBLE AS slope,
             least((before + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS share
      FROM g LEFT JOIN n ON doc_id = chosen JOIN r ON g.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * n_takes AS taken, n_takes,
       CASE WHEN n_takes > 0 THEN CASE WHEN slope = 0 THEN share ELSE (sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * share, 0)) - (1 - slope)) / (2 * slope) END END AS first_position
FROM k
"""

SQL["op7_line_bitmaps"] = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, k, lines[k] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM t)),
y AS (SELECT *, {_LOW.format(f"trim(line, {_WHITE})")} AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM y WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
z AS (SELECT doc_id, k, line, coalesce(doc_id <> owner, false) AS gone FROM y LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256, coalesce(any_value(runs), '') AS kept_runs
FROM z LEFT JOIN (SELECT doc_id, string_agg(first || '+' || n, ',' ORDER BY first) AS runs
     FROM (SELECT doc_id, min(k) - 1 AS first, count(*) AS n FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM z WHERE NOT gone) GROUP BY doc_id, run)
     GROUP BY 1) USING (doc_id) GROUP BY 1
"""

SQL["op8_one_permutation"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACE.format(_LOW.format("text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, least(len(w), 1)))) AS k FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

_ESCAPED = "regexp_replace({}, '<(\\\\*)\\|', '<\\1\\\\|', 'g')"
SQL["op9_chat_templates"] = f"""
WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length('<|im_start|>') + length(replace(replace({_ESCAPED.format("role")}, '%', '%25'), chr(10), '%0A')) + 1 + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1) AS chars
      FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g
"""


def _licenses() -> str:
    import re

    from gleanery.llm.licenses import K, MERGE, MIN_SCORE, PHRASES, TEMPLATES

    grams, n = [], 0
    for label in sorted(TEMPLATES):
        for text in TEMPLATES[label]:
            own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
            grams += [f"('{label}', {n}, {k}, {len(own)}, '{' '.join(own[k : k + K])}')" for k in range(len(own) - K + 1)]
            n += 1
    places = []
    for phrase in PHRASES:
        own = phrase.split(" ")
        places.append(f"list_filter(range(0, len(w) - {len(own) - 1}), lambda i: w[i + 1 : i + {len(own)}] = {own})")
    bases = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for p, label in zip(places, PHRASES.values(), strict=True))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM.format(_LOW.format("text"))} AS w FROM documents),
b AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, flatten([{', '.join(places)}]) AS places, list_sort(list_filter([{bases}], lambda x: x IS NOT NULL)) AS base FROM d),
t(label, template, t_pos, t_words, g) AS (VALUES {', '.join(grams)}),
k AS (SELECT r, p, array_to_string(w[p + 1 : p + {K}], ' ') AS g FROM (SELECT r, w, unnest(range(0, len(w) - {K - 1})) AS p FROM d)),
h AS (SELECT r, label, template, t_words, p - t_pos AS diagonal, t_pos FROM k JOIN t USING (g)),
l AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER w > {MERGE}, true)::INTEGER AS new FROM (SELECT DISTINCT r, template, diagonal FROM h) WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
s AS (SELECT r, template, diagonal, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM l),
c AS (SELECT r, label, template, span, count(DISTINCT p) / max(t_words)::DOUBLE AS score FROM (SELECT h.*, s.span, unnest(range(t_pos, t_pos + {K})) AS p FROM h JOIN s USING (r, template, diagonal)) GROUP BY 1, 2, 3, 4),
f AS (SELECT r, max(score) AS best, list(DISTINCT label) FILTER (score >= {MIN_SCORE}) AS more FROM c GROUP BY 1)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word, array_to_string(base, ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels, coalesce(best, 0)::DOUBLE AS score
FROM b LEFT JOIN f USING (r)
"""


SQL["op10_license_diagonals"] = _licenses()
