"""DuckDB SQL of the training-data queries that SQL can express, written from
their contracts (whole word sequences, no hashes, no filters)."""

WINDOWED_WORDS = r"[^\x20\x09-\x0D]+"
BENCHMARK_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WINDOWED_WORDS}') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 4), ' ') AS sh
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
common AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.rid <> y.rid GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach ON reach.a = d.rid JOIN d o ON o.rid = reach.b LEFT JOIN n ON n.rid = d.rid
GROUP BY d.rid, d.doc_id"""

DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WINDOWED_WORDS}') AS w FROM documents),
p AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 34), ' ') AS phrase
      FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT phrase FROM p GROUP BY phrase HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS pos FROM p JOIN twice USING (phrase)),
kept AS (SELECT d.rid, array_to_string(list(w[x.pos] ORDER BY x.pos), ' ') AS t
         FROM d, unnest(range(1, len(d.w) + 1)) AS x(pos)
         WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = d.rid AND gone.pos = x.pos) GROUP BY d.rid),
lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN lost USING (rid)"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{BENCHMARK_WORDS}') AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                      regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{BENCHMARK_WORDS}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, win)),
words AS (SELECT rid, count(DISTINCT pos) AS c FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS c, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(words.c, 0) AS n_hit, coalesce(items.c, 0) AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(words.c, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""

_WORDED = r"[^\x20\x09-\x0D]"
_GAPS = r"[\x20\x09-\x0D]+"

LINE_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{WINDOWED_WORDS}') AS w FROM d),
l AS (
  SELECT rid, source, t, ln, trim(regexp_replace(translate(ln, '{_UPPER}0123456789', '{_UPPER.lower()}0000000000'), '{_GAPS}', ' ', 'g'), ' ') AS norm,
         len(regexp_extract_all(ln, '{WINDOWED_WORDS}')) AS n
  FROM (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS ln FROM d) WHERE regexp_matches(ln, '{_WORDED}')),
hosts AS (SELECT source, count(DISTINCT t) AS all_docs FROM d GROUP BY source),
often AS (
  SELECT c.source, c.norm FROM (SELECT source, norm, count(DISTINCT t) AS docs FROM l GROUP BY source, norm) c
  JOIN hosts h ON h.source IS NOT DISTINCT FROM c.source WHERE c.docs > 10 AND 100 * c.docs > h.all_docs),
lost AS (SELECT l.rid, count(*) AS c, sum(l.n) AS n FROM l JOIN often o ON o.source IS NOT DISTINCT FROM l.source AND o.norm = l.norm GROUP BY l.rid),
dup AS (SELECT rid, count(*) - count(DISTINCT ln) AS n FROM l GROUP BY rid),
p AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (
  SELECT rid, count(DISTINCT pos) AS n
  FROM (SELECT p.rid, unnest(range(p.i, p.i + 3)) AS pos FROM p JOIN (SELECT rid, win FROM p GROUP BY rid, win HAVING count(*) > 1) USING (rid, win))
  GROUP BY rid),
base AS (
  SELECT d.rid, d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost.c, 0) AS BIGINT) AS n_removed_lines, CAST(len(w.w) - coalesce(lost.n, 0) AS BIGINT) AS n_left_words
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_left_words >= 30 * n_words AS kept,
       n_removed_lines, n_left_words
FROM base"""

#: CRC-32 of the decimal id, bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: CAST(z AS BIGINT))), lambda v, w: xor(v >> 1, 3988292384 * (v & 1)))))"""

TRIE = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
c AS (SELECT c, c - c % 5 AS b, {_CRC} % 9 AS h FROM n),
turns AS (
  SELECT c.c, t.pos AS d, t.r, t.x FROM c JOIN t ON t.c = c.b AND t.pos <= c.h
  UNION ALL
  SELECT c.c, t.pos - c.h + least(c.h, coalesce(n.n, 0)) AS d, t.r, t.x FROM c JOIN t ON t.c = c.c AND t.pos > c.h LEFT JOIN n ON n.c = c.b),
seqs AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY d) AS l FROM turns GROUP BY c),
p AS (SELECT c, d, l[1:d] AS k, len(l) AS size
      FROM (SELECT c.c, coalesce(l, []) AS l, unnest(range(0, coalesce(len(l), 0) + 1)) AS d FROM c LEFT JOIN seqs ON seqs.c = c.c)),
node AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN d = size THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM p GROUP BY d, k),
up AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a AS d, k[1:a] AS k, sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(k[d].x) END) AS saved, sum(leaf) AS leaves
  FROM (SELECT node.d, node.k, n_convs, CASE WHEN up.n IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, node.d + 1)) AS a
        FROM node LEFT JOIN up ON up.d = node.d AND up.k = node.k)
  GROUP BY ALL)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, node.n_convs, CAST(coalesce(up.n, 0) AS BIGINT) AS n_children,
       CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN below ON below.d = node.d AND below.k = node.k LEFT JOIN up ON up.d = node.d AND up.k = node.k
LEFT JOIN node parent ON parent.d = node.d - 1 AND parent.k = node.k[1:node.d - 1] AND node.d > 0"""
