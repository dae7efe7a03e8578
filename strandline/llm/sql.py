"""SQL of this subpackage's queries, for DuckDB."""

from __future__ import annotations

#: Of each conversation: what its formatted examples hold, from the raw turns; lengths of the template's marks and of
#: the escapes (backslashes and control strings) are counted as characters.
OP7 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), sized AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    sum(length('<s>[INST] ' || ' [/INST].' || '</s>.') + length(role) + length(text)
      + length(regexp_replace(role || text, '[^\\]', '', 'g'))
      + len(regexp_extract_all(role, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))
      + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))) OVER w AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR pos = n_turns)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id, n_turns
"""

#: The measures and base rules of every document, failures by host, the beta prior of their rates, and the verdicts.
OP1 = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), g AS (
  SELECT doc_id, i, w[i : i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1
), rep AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id
), m AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM t LEFT JOIN rep USING (doc_id)
), j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 100 * n_symbols > 3 * word_chars AS fs, 100 * n_dup_lines > 40 * n_lines AS fd FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (fs)::DOUBLE AS s, count(*) FILTER (fd)::DOUBLE AS d, count(*) FILTER (base_failed OR fs OR fd)::DOUBLE AS a FROM j GROUP BY source
), r AS (SELECT rule, source, n, k, (k + 0.5) / (n + 1) AS rate FROM (UNPIVOT h ON s, d, a INTO NAME rule VALUE k)),
p AS (SELECT rule, avg(n) AS mean_n, avg(rate) AS m, coalesce(var_samp(rate), 0) - avg(rate * (1 - rate) / n) AS extra FROM r GROUP BY rule),
q AS (SELECT rule, m, CASE WHEN extra > 1e-12 THEN greatest(1, m * (1 - m) / extra - 1) ELSE greatest(1, mean_n) END AS strength FROM p),
x AS (SELECT source, max((k + m * strength) / (n + strength)) FILTER (rule = 's') AS s, max((k + m * strength) / (n + strength)) FILTER (rule = 'd') AS d,
  max((k + m * strength) / (n + strength)) FILTER (rule = 'a') AS a FROM r JOIN q USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR a > 0.5 OR fs AND s > 0.01 OR fd AND d > 0.01) AS kept, round(a, 9) AS host_rate
FROM j JOIN x ON j.source IS NOT DISTINCT FROM x.source
"""

#: Shingles of four words as lists, pairs that share any, the similarity of their sets, and components over the links.
OP2 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i : i + 3] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM t WHERE len(w) > 0)
), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, hash(g) AS k FROM s),
f AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM h a JOIN h b ON a.k = b.k AND a.doc_id < b.doc_id WHERE a.k IN (FROM f) GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN z x ON x.doc_id = u JOIN z y ON y.doc_id = v WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(id, other) AS (SELECT u, v FROM e UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.other),
c AS (SELECT id, min(other) AS low FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN c ON id = d.doc_id
"""

#: All pairs of one label by cosine, and components over the links.
OP8 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), e AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), r(id, other) AS (SELECT u, w FROM e UNION SELECT r.id, e.w FROM r JOIN e ON e.u = r.other),
c AS (SELECT id, min(other) AS low FROM r GROUP BY id), n AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON u = vec_id LEFT JOIN c ON id = vec_id
"""

_KEY = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_SECRETS = (
    ("assign", _KEY + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("provider", "gh[opsur]_[A-Za-z0-9]+|xox[abprs]-[A-Za-z0-9-]+", 0, 24),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
_FOUND = " UNION ALL ".join(
    f"SELECT id, {k} AS k, '{kind}' AS kind, {least} AS least, unnest(range(len(regexp_extract_all(text, '{p}')))) AS i, unnest(regexp_split_to_array(text, '{p}')) AS gap, "
    f"unnest(regexp_extract_all(text, '{p}')) AS hit, unnest(regexp_extract_all(text, '{p}', {g})) AS checked FROM t"
    for k, (kind, p, g, least) in enumerate(_SECRETS)
)

#: Matches of every rule; a match starts after all gaps and matches before it.
OP11 = f"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_FOUND}),
s AS (SELECT id, k, kind, least, hit, checked, sum(length(gap) + length(hit)) OVER (PARTITION BY id, k ORDER BY i) - length(hit) AS a FROM f WHERE hit IS NOT NULL),
x AS (SELECT id, k, a, kind || ':' || a::BIGINT || ':' || (a + length(hit))::BIGINT AS span FROM s WHERE length(checked) >= least),
g AS (
  SELECT id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, (kind, *_) in enumerate(_SECRETS))},
    string_agg(span, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM x GROUP BY id
)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in _SECRETS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (id)
"""

#: Cuts from the digest of the id; the parts by position, put between the sentinels.
OP12 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT doc_id, text, length(text) AS n, [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT for k in [0, 1, 2, 3]] AS h FROM t),
c AS (SELECT doc_id, text, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

#: Crc32 bit by bit, conversations with the beginnings of others, digests of all prefixes, and sums over all ancestors.
OP13 = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), b AS (
  SELECT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS bytes FROM (SELECT DISTINCT conv_id FROM t)
), c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, x:
    list_reduce(list_prepend(xor(s, x), range(8)), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 6 AS h FROM b
), heads AS (
  SELECT c.conv_id, t.p, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.p <= c.h
), k AS (SELECT conv_id, count(*) AS k FROM heads GROUP BY conv_id),
r AS (
  FROM heads UNION ALL
  SELECT conv_id, p - h + coalesce(k, 0), role, text FROM t JOIN c USING (conv_id) LEFT JOIN k USING (conv_id) WHERE p > h
), x AS (
  SELECT conv_id, p AS d, length(text) AS size, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY p)) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), n AS (SELECT d, path, min(conv_id) AS id, count(*) AS n, max(size) AS size FROM x GROUP BY d, path),
up AS (SELECT n.d, n.path, x.d AS above_d, x.path AS above FROM n JOIN x ON x.conv_id = n.id AND x.d <= n.d),
kids AS (SELECT above_d AS d, above AS path, count(*) AS n_children FROM up WHERE above_d = d - 1 GROUP BY ALL),
sums AS (
  SELECT above_d AS d, above AS path, sum((n - 1) * size) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM up JOIN n USING (d, path) LEFT JOIN kids USING (d, path) GROUP BY ALL
), ends AS (
  SELECT d, path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM x WHERE d = (SELECT max(y.d) FROM x y WHERE y.conv_id = x.conv_id) GROUP BY ALL
)
SELECT n.id AS conv_id, n.d AS depth, p.id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN sums USING (d, path) LEFT JOIN kids USING (d, path) LEFT JOIN ends USING (d, path)
  LEFT JOIN up ON up.d = n.d AND up.path = n.path AND above_d = n.d - 1 LEFT JOIN n p ON p.d = above_d AND p.path = above
"""

ORACLE = {"op1_host_rules": OP1, "op2_near_copies": OP2, "op7_chat_examples": OP7, "op8_close_vectors": OP8, "op11_secret_index": OP11, "op12_fill_in_middle": OP12, "op13_prefix_trie": OP13}
