"""SQL twins of the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op4_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""

ORACLE["op10_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5('7:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE)
           / 4503599627370496 AS u,
         0.1::DOUBLE + 0.9::DOUBLE * length(regexp_replace(coalesce(text, ''), '[#$%&*!|0-9]', '', 'g'))
           / greatest(length(coalesce(text, '')), 1) AS q FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, sum(sum(size)) OVER ()::DOUBLE AS total,
             CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS w
      FROM d GROUP BY source),
rounds AS (
  SELECT 0 AS r, source, source_size, total, w, FALSE AS capped FROM s
  UNION ALL
  SELECT r + 1, source, source_size, total, w, capped OR share > 3 * source_size FROM (
    SELECT *, w * (total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ())
              / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0) AS share FROM rounds) x WHERE r < 40),
t AS (SELECT source, source_size, CASE WHEN capped THEN 3 * source_size ELSE
             w * (total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ())
             / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0) END AS target
      FROM (SELECT * FROM rounds WHERE r = 40) x),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, d.doc_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
       (size * (epochs + CASE WHEN before + size / 2.0 < target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
"""

ORACLE["op7_line_dedup"] = """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d),
c AS (SELECT doc_id, i, length(ls[i]) AS n, sum(length(ls[i])) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
reach AS (SELECT a.doc_id, a.i AS a, b.i AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 20),
w AS (SELECT doc_id, a, min(b) AS b FROM reach GROUP BY doc_id, a UNION SELECT doc_id, max(a) AS a, b FROM reach GROUP BY doc_id, b),
k AS (SELECT w.doc_id, a, b, row_number() OVER (PARTITION BY list_slice(ls, a, b) ORDER BY w.doc_id, a) AS k
      FROM w JOIN d ON w.doc_id = d.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS i FROM k WHERE k > 1),
n AS (SELECT doc_id, count(*) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(ls[l.i], chr(10) ORDER BY l.i) AS rest
         FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i WHERE gone.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_deleted,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(rest, '') END AS text
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8: byte by byte, each followed by its eight shifts (-1)."""
    place = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    steps = f"flatten(list_transform({place}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END)"
    return f"xor({fold}, 4294967295::BIGINT)"


ORACLE["op11_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
                  md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, (SELECT {crc32("c.s")} FROM (SELECT conv_id::VARCHAR AS s) c) % 4 AS h FROM t),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(p.ts, 1, h), []), list_slice(h.ts, h + 1, len(h.ts))) AS q
      FROM h LEFT JOIN t p ON p.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, d, list_slice(q, 1, d) AS p, len(q) = d AS is_end FROM (SELECT *, unnest(range(0, len(q) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '') AS ends,
             (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].x, '[^\\x20\\x09-\\x0D]+')) END AS saved
      FROM m GROUP BY p, d),
k AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.p = k.p AND n.d = k.d),
s AS (SELECT list_slice(p, 1, u) AS p, u AS d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON f.p = s.p AND f.d = s.d LEFT JOIN n up ON up.d = f.d - 1 AND up.p = list_slice(f.p, 1, f.d - 1)
"""

ORACLE["op12_minhash"] = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT i, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS g FROM d),
n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
c AS (SELECT a.i AS a, b.i AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.i != b.i GROUP BY a.i, b.i),
l AS (SELECT a, b FROM c JOIN n x ON x.i = a JOIN n y ON y.i = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
r AS (SELECT i, doc_id AS root FROM d UNION SELECT l.b AS i, r.root FROM r JOIN l ON l.a = r.i)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM d JOIN r ON r.i = d.i LEFT JOIN n ON n.i = d.i GROUP BY d.i, d.doc_id, n.n
"""

ORACLE["op13_spelling"] = f"""
WITH RECURSIVE o AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS w FROM documents),
g AS (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS s, count(*) AS k FROM o WHERE length(w) >= 7 GROUP BY 1, 2),
h AS (SELECT w, k, {crc32("s")} AS h FROM g),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word,
             sum(k)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(k) >= 2 AND length(word) >= 7),
e AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
m AS (SELECT word, substr(word, 1, i::INT - 1) || '?' || substr(word, i::INT + 1) AS m, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS c FROM e),
p AS (SELECT a.word, b.word AS other FROM m a JOIN m b ON a.m = b.m AND a.word != b.word
      UNION SELECT m.word, v.word AS other FROM m JOIN v ON m.c = v.word
      UNION SELECT v.word, m.word AS other FROM m JOIN v ON m.c = v.word),
b AS (SELECT p.word, count(*) AS n_near, first(other ORDER BY v.n DESC, other) AS best, max(v.n) AS best_n
      FROM p JOIN v ON v.word = p.other GROUP BY p.word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form,
             CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
r AS (SELECT word, word AS root, form AS next FROM f
      UNION ALL SELECT r.word, f.word AS root, f.form AS next FROM r JOIN f ON f.word = r.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL
"""
