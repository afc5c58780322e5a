"""SQL that outlines Python files line by line, to compare the chunker with.

Definitions are found by their first words, their ends by indentation outside of triple-quoted strings.  Files
that do not parse are told by what SQL can see: brackets and quotes that do not match, heads without a body,
conflict marks, lines of bare words, statements of the old language and
reserved words as names.  ``@SELECTED@`` stands for the scan predicate.
"""

PYTHON = r"""WITH f AS (SELECT path, any_value(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(content::VARCHAR, '^\\xEF\\xBB\\xBF', ''), '\\x0D(\\x0A)?', '\\x0A', 'g'), '\\x09', chr(9), 'g'), '\x22', chr(34)), '\x27', chr(39)), '\x5C', chr(92))) AS text FROM files WHERE path IS NOT NULL AND lower(regexp_extract(path, '(\.[^./]+)$', 1)) = '.py' AND @SELECTED@ GROUP BY path),
a AS (SELECT path, i, ls[i] AS line, len(ls) AS n FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split(regexp_replace(text, '\\x0A$', ''), '\x0A') AS ls FROM f))),
h AS (SELECT path, coalesce(min(CASE WHEN regexp_matches(line, '^\s*[^#\s]') THEN i END), max(n)) - 1 AS dropped, max(n) AS n FROM a GROUP BY path),
l AS (SELECT a.path, a.i - h.dropped AS i, a.line, h.n - h.dropped AS n, regexp_matches(line, '^\s*[^#\s]') AS code, length(regexp_extract(line, '^( *)', 1)) AS pad,
  (length(line) - length(replace(replace(line, repeat(chr(34), 3), ''), '''''''', ''))) // 3 AS quotes FROM a JOIN h ON h.path = a.path AND a.i > h.dropped),
w AS (SELECT path FROM l GROUP BY path HAVING max(n) BETWEEN 3 AND 10000 AND count(CASE WHEN code THEN 1 END) / max(n) > 0.1),
q AS (SELECT l.*, (sum(quotes) OVER (PARTITION BY l.path ORDER BY i) - quotes) % 2 = 1 AS quoted FROM l JOIN w ON w.path = l.path),
e AS (SELECT *, CASE WHEN NOT quoted THEN regexp_extract(line, '^ *(?:async +)?(def|class) +\w+', 1) ELSE '' END AS kind, regexp_extract(line, '^ *(?:async +)?(?:def|class) +(\w+)', 1) AS name FROM q),
s AS (SELECT x.path, x.i, x.pad, x.kind, x.name, any_value(x.n) AS n, min(y.i) AS stop FROM e x LEFT JOIN e y ON y.path = x.path AND y.i > x.i AND y.code AND NOT y.quoted AND y.pad <= x.pad AND NOT regexp_matches(y.line, '^ *[\)\]\}]') WHERE x.kind <> '' GROUP BY x.path, x.i, x.pad, x.kind, x.name),
t AS (SELECT s.*, (SELECT max(y.i) FROM e y WHERE y.path = s.path AND y.i >= s.i AND y.i < coalesce(s.stop, s.n + 1) AND (y.code OR y.quoted)) AS last FROM s),
p AS (SELECT t.path, t.i, t.last, t.kind, t.name, max(CASE WHEN u.kind = 'class' THEN 1 ELSE 0 END) AS in_class, max_by(u.kind, u.i) AS parent_kind, max_by(u.name, u.i) AS parent, max(u.i) AS parent_at, any_value(t.pad) AS pad FROM t LEFT JOIN t u ON u.path = t.path AND u.i < t.i AND u.last >= t.i AND u.pad < t.pad GROUP BY t.path, t.i, t.last, t.kind, t.name),
z AS (SELECT path, i, pad, quotes, line AS raw, regexp_replace(regexp_replace(regexp_replace(line, repeat(chr(34), 3) || '.*$', '', 'g'), '"([^"\\]|\\.)*"|''([^''\\]|\\.)*''', '0', 'g'), '#.*$', '') AS line FROM e WHERE code AND NOT quoted),
bad AS (SELECT path FROM (SELECT *, lead(pad) OVER c AS next_pad FROM z WINDOW c AS (PARTITION BY path ORDER BY i)) WHERE regexp_matches(line, '^ *(async +)?(def|class|if|elif|else|for|while|try|except|finally|with)\b[^()]*(\(.*\))?[^()]*:\s*$') AND coalesce(next_pad, -1) <= pad OR regexp_matches(line, '^(<{7}|={7}|>{7})') OR regexp_matches(line, '^ *(print|exec) +[^ =(,.]') OR regexp_matches(line, '^ *(async +)?(def|class) +\w+[^():]*(\(.*\))?[^():]*$') OR regexp_matches(line, '^ *(async|await|class|def|if|for|while|None|True|False|import|from|return|lambda) *=[^=]') OR regexp_matches(line, '^ *[A-Za-z_]+ [A-Za-z_]+ [A-Za-z_]+\s*$') AND NOT regexp_matches(line, '^ *(from|import|return|raise|if|elif|while|assert|del|with|for|not|yield|global|nonlocal|async|await|else|in|is|and|or|lambda)\b')
  UNION SELECT path FROM z GROUP BY path HAVING sum(len(line) - len(replace(line, '(', ''))) <> sum(len(line) - len(replace(line, ')', ''))) OR sum(len(line) - len(replace(line, '[', ''))) <> sum(len(line) - len(replace(line, ']', ''))) OR sum(len(line) - len(replace(line, '{', ''))) <> sum(len(line) - len(replace(line, '}', '')))
  UNION SELECT path FROM e GROUP BY path HAVING sum(quotes) % 2 = 1),
m AS (SELECT p.*, (SELECT min(y.pad) FROM e y WHERE y.path = p.path AND y.i > p.parent_at AND y.i <= p.i AND y.code AND NOT y.quoted AND y.pad > 0) AS body_pad FROM p)
SELECT path AS file_path, CASE WHEN kind = 'def' AND parent_kind = 'class' THEN parent || '::' || name ELSE name END AS symbol_name, CASE WHEN kind = 'class' THEN 'class' WHEN parent_kind = 'class' THEN 'method' ELSE 'function' END AS chunk_type, i::int AS start_line, last::int AS end_line
FROM m WHERE path NOT IN (SELECT path FROM bad) AND (kind = 'class' OR (last - i >= 3 AND (coalesce(in_class, 0) = 0 OR parent_kind = 'class' AND pad = body_pad)))"""
