"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quarry.llm.licenses import PHRASES, TEMPLATES, block_length, words_of
from quarry.llm.urls import DAMPING, RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1(window: int = 20) -> str:
    """Every window's digest and its first place; words under a later one go."""
    return f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS l FROM documents),
 s AS (SELECT doc_id, l, unnest(range(1, len(l) - {window} + 2)) AS i FROM w WHERE len(l) >= {window}), h AS (SELECT doc_id, i, sha256(array_to_string(l[i : i + {window - 1}], ' ')) AS h FROM s),
 a AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM h),
 g AS (SELECT DISTINCT doc_id, i + o AS p FROM a CROSS JOIN range(0, {window}) r(o) WHERE n > 1),
 p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS word FROM w),
 k AS (SELECT p.doc_id, p.p, p.word, g.p IS NULL AS kept FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p),
 r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT kept) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (kept), '') AS said FROM k GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id"""


def op3(threshold: tuple[int, int] = (9, 10)) -> str:
    """Places of phrases in each word list; each run of words as long as a template's blocks against it."""
    split = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    norm = lambda c: f"list_filter(string_split_regex(translate(coalesce({c}, ''), '{_UP}', '{_LOW}'), '{split}'), lambda x: x <> '')"
    starts = [(f"list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {j}] = {chr(39)}{x}{chr(39)}' for j, x in enumerate(p.split()))})", label) for p, label in PHRASES]
    names = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM m WHERE len(s{i}) > 0" for i, (_, label) in enumerate(starts))
    rows = ", ".join(f"('{label}', [{', '.join(repr(x) for x in sorted(set(words_of(t))))}], {block_length(len(words_of(t)))})" for label, t in TEMPLATES)
    enough = f"len(words) * {threshold[0]}"
    return f"""WITH d AS (SELECT doc_id, {norm('text')} AS w FROM documents), m AS (SELECT doc_id, w, {', '.join(f'{s} AS s{i}' for i, (s, _) in enumerate(starts))} FROM d),
 c AS (SELECT doc_id, len(w) AS n, list_concat(list_concat(s0, s1), s2) AS s FROM m), t(label, words, block) AS (VALUES {rows}),
 u AS (SELECT doc_id, w, list_distinct(w) AS own FROM d), may AS (SELECT doc_id, w, label, words, block FROM u CROSS JOIN t WHERE len(list_intersect(own, words)) * {threshold[1]} >= {enough}),
 runs AS (SELECT doc_id, label, words, w[i : i + block - 1] AS b FROM (SELECT *, unnest(range(1, greatest(1, len(w) - block + 1) + 1)) AS i FROM may) x),
 hit AS (SELECT doc_id, label, len(list_intersect(list_distinct(b), words)) / len(words) AS score FROM runs WHERE len(list_intersect(list_distinct(b), words)) * {threshold[1]} >= {enough}),
 bl AS ({names}), base AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS l FROM bl GROUP BY doc_id),
 al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT doc_id, label FROM bl UNION SELECT doc_id, label FROM hit) x GROUP BY doc_id), sc AS (SELECT doc_id, max(score) AS s FROM hit GROUP BY doc_id)
 SELECT c.doc_id, n AS n_words, len(c.s) AS n_base, list_min(c.s) - 1 AS first_word, list_max(c.s) - 1 AS last_word, coalesce(base.l, '') AS base_labels, coalesce(al.l, '') AS labels, coalesce(sc.s, 0.0) AS score
 FROM c LEFT JOIN base ON c.doc_id = base.doc_id LEFT JOIN al ON c.doc_id = al.doc_id LEFT JOIN sc ON c.doc_id = sc.doc_id"""


def op6() -> str:
    """Rules by length; a fixed number of rounds of both ranks."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    pick = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h, p)}'" for v, h, p in ordered) + " END"
    hosts = lambda c: f"translate(regexp_extract({c}, '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}')"
    link = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']?\\s*((?:https?:)?//[^\\s\"''<>]+)"
    return f"""WITH RECURSIVE p AS (SELECT page_id, coalesce({hosts('url')}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
 j AS (SELECT page_id, host, path, {pick(lambda v, h, q: h + q)} AS rule, {pick(lambda v, h, q: v)} AS v FROM p),
 links AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, {hosts('u')} AS dst FROM (SELECT host, CASE WHEN starts_with(v, '//') THEN 'http:' || v ELSE v END AS u FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS v FROM p) z) x) y WHERE src <> dst AND src <> '' AND dst <> ''),
 o AS (SELECT src, count(*) AS k FROM links GROUP BY src), n AS (SELECT dst, count(*) AS k FROM links GROUP BY dst),
 edges AS (SELECT links.src, links.dst, 1 / o.k AS good, 0.0 AS bad FROM links JOIN o ON links.src = o.src UNION ALL SELECT links.dst, links.src, 0.0, 1 / n.k FROM links JOIN n ON links.dst = n.dst),
 c AS (SELECT host, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS b FROM j WHERE host <> '' GROUP BY host),
 seeds AS (SELECT host, CASE WHEN a > b THEN 1 / sum(CASE WHEN a > b THEN 1.0 ELSE 0.0 END) OVER () ELSE 0.0 END AS trust, CASE WHEN b > a THEN 1 / sum(CASE WHEN b > a THEN 1.0 ELSE 0.0 END) OVER () ELSE 0.0 END AS distrust FROM c WHERE a <> b),
 r AS (SELECT host, CAST(trust AS DOUBLE) AS trust, CAST(distrust AS DOUBLE) AS distrust, 0 AS i FROM seeds UNION ALL
 SELECT host, sum(trust), sum(distrust), max(i) + 1 FROM (SELECT e.dst AS host, {DAMPING!r} * n.trust * e.good AS trust, {DAMPING!r} * n.distrust * e.bad AS distrust, n.i FROM r n JOIN edges e ON n.host = e.src
 UNION ALL SELECT s.host, {1 - DAMPING!r} * s.trust, {1 - DAMPING!r} * s.distrust, k.i FROM seeds s JOIN (SELECT DISTINCT i FROM r) k ON true) x GROUP BY host HAVING max(i) < 80),
 e AS (SELECT * FROM r WHERE i = 80), z AS (SELECT host, coalesce(trust / nullif((SELECT sum(trust) FROM e), 0), 0) AS trust, coalesce(distrust / nullif((SELECT sum(distrust) FROM e), 0), 0) AS distrust FROM e)
 SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN coalesce(z.distrust, 0) > coalesce(z.trust, 0) * (1 + 1e-12) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(round(z.trust, 9), 0.0) AS trust, coalesce(round(z.distrust, 9), 0.0) AS distrust FROM j LEFT JOIN z ON j.host = z.host"""


OP7 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL),
 c AS (SELECT vec_id, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM v), s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM c q JOIN c ON q.i = c.i WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY q.vec_id, c.vec_id)
 SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) x WHERE n <= 5"""


OP10 = """WITH x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(24 + length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n')) + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))) AS BIGINT) AS formatted_chars FROM x GROUP BY conv_id"""


OP12 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
 c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
 f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""


#: Costs-to-go from the last turn to the first, then the walk; crc32 by a table of 256 sums.
OP13 = """WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)) x),
 raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM conversations),
 k AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 20 AS c FROM raw CROSS JOIN tab),
 h AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT * FROM k WHERE c <> 0 UNION ALL SELECT * FROM k WHERE c = 3) x),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS ini, regexp_replace(text, '[ \\x09-\\x0D]+$', '') AS bare FROM h),
 f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o), g AS (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS m, fault IN ('blank', 'duplicate') AS must, lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS after FROM f),
 z AS (SELECT DISTINCT conv_id, n FROM g),
 back AS (SELECT conv_id, n + 1 AS i, [0, 4, 2, 0] AS c FROM z UNION ALL
 SELECT conv_id, i, [least(b[1], 2 + least(b[3], 2 + b[4])), least(b[2], 2 + least(b[3], 2 + b[4])), least(b[3], 2 + b[4]), least(b[4], 2 + b[3])] FROM (SELECT g.conv_id, g.i, CASE WHEN must THEN list_transform(c, lambda x: x + 3) ELSE
 [least(3 + c[1], 2 + m + c[3], CASE ini WHEN 's' THEN m + c[2] WHEN 'u' THEN m + c[3] ELSE 1000000000 END), least(3 + c[2], 2 + m + c[3], CASE ini WHEN 'u' THEN m + c[3] ELSE 1000000000 END), least(3 + c[3], 2 + m + c[4], CASE ini WHEN 'a' THEN m + c[4] ELSE 1000000000 END), least(3 + c[4], 2 + m + c[3], CASE ini WHEN 'u' THEN m + c[3] ELSE 1000000000 END)] END AS b FROM back JOIN g ON g.conv_id = back.conv_id AND g.i = back.i - 1) y),
 costs AS (SELECT * FROM back),
 w AS (SELECT conv_id, CAST(1 AS BIGINT) AS i, 0 AS s, '' AS audit, CAST(NULL AS VARCHAR) AS said, n FROM z UNION ALL
 SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE nxt END, audit || e,
 CASE e WHEN 'D' THEN said ELSE coalesce(said || chr(10), '') || CASE e WHEN 'K' THEN role WHEN 'I' THEN gives ELSE gives END || ':' || CASE e WHEN 'I' THEN '' ELSE text END END, n
 FROM (SELECT *, CASE WHEN i <= n AND 3 + d[s + 1] = c[s + 1] THEN 'D' WHEN 2 + c[nxt + 1] = c[s + 1] THEN 'I' WHEN NOT must AND kept IS NOT NULL AND m + d[kept + 1] = c[s + 1] THEN 'K' ELSE 'R' END AS e
 FROM (SELECT w.*, CASE WHEN s = 2 THEN 3 ELSE 2 END AS nxt, CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END AS gives, CASE WHEN ini = 's' AND s = 0 THEN 1 WHEN ini = 'u' AND s IN (0, 1, 3) THEN 2 WHEN ini = 'a' AND s = 2 THEN 3 END AS kept, role, text, must, m, b.c AS c, a.c AS d
 FROM w JOIN costs b ON b.conv_id = w.conv_id AND b.i = w.i LEFT JOIN costs a ON a.conv_id = w.conv_id AND a.i = w.i + 1 LEFT JOIN g ON g.conv_id = w.conv_id AND g.i = w.i WHERE w.i <= w.n OR b.c[w.s + 1] > 0) x) y),
 done AS (SELECT conv_id, audit, said FROM w WHERE i = n + 1 AND [0, 4, 2, 0][s + 1] = 0),
 t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (after IS NOT NULL AND ini || after NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
 SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(costs.c[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON c.conv_id = t.conv_id LEFT JOIN done ON c.conv_id = done.conv_id LEFT JOIN costs ON c.conv_id = costs.conv_id AND costs.i = 1"""
