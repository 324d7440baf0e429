"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWER_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+')"
_NORMAL = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERMS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


def _crc32(column: str) -> str:
    """CRC-32 of a decimal id: a fold over its bits."""
    bits = "list_reduce(range(0, 8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(c, ascii(x)))"
    return (f"xor(list_reduce(string_split(CAST({column} AS VARCHAR), ''), lambda c, x: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)")


ORACLE_SQL = {
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
        FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 12)) AS i)),
first AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p
         FROM win JOIN first USING (g) WHERE doc_id > least),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS k, string_agg(x, ' ' ORDER BY p) AS t
         FROM word WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = word.doc_id AND g.p = word.p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS src, doc_id AS dst FROM n
          UNION SELECT r.src, e.b FROM reach r JOIN edge e ON e.a = r.dst),
comp AS (SELECT src, min(dst) AS c FROM reach GROUP BY src)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON src = d.doc_id""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
b AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, w[i:i + 9] AS g
       FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i) WHERE len(w) > 0),
ls AS (SELECT DISTINCT len(g) AS l FROM bw),
dw AS (SELECT doc_id, i, l, w[i:i + l - 1] AS g
       FROM d, ls, LATERAL (SELECT unnest(generate_series(1, len(w) - l + 1)) AS i)),
hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (g)),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (
          SELECT DISTINCT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
         FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op11_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY doc_id, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, s),
x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // l))))) AS BIGINT) AS score
      FROM q JOIN tf USING (t) JOIN w USING (t) JOIN n USING (doc_id), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
      FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_merkle": f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS h, {_leaf("(n_chars + changed)")} AS now,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos
  FROM (SELECT *, CASE WHEN {_crc32("doc_id")} % 7 = 0 THEN 1 ELSE 0 END AS changed FROM documents)),
node AS (SELECT CAST(0 AS BIGINT) AS lvl, lang, CAST(pos AS BIGINT) AS pos, h FROM leaf
  UNION ALL
  SELECT lvl + 1, lang, p, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT lvl, lang, pos, pos // 2 AS p, h, max(pos) OVER (PARTITION BY lang) AS top FROM node) WHERE top > 0 GROUP BY lvl, lang, p),
sub AS (SELECT lang, arg_max(h, lvl) AS subroot, max(lvl) AS height,
               CAST(row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS BIGINT) AS pos FROM node GROUP BY lang),
up AS (SELECT CAST(0 AS BIGINT) AS lvl, pos, subroot AS h FROM sub
  UNION ALL
  SELECT lvl + 1, p, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT lvl, pos, pos // 2 AS p, h, max(pos) OVER () AS top FROM up) WHERE top > 0 GROUP BY lvl, p),
top AS (SELECT arg_max(h, lvl) AS root, max(lvl) AS height FROM up),
step AS (
  SELECT l.doc_id, k AS lvl, CASE WHEN s.h IS NULL THEN 'N' WHEN (l.pos >> k) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END AS s
  FROM (SELECT leaf.doc_id, leaf.lang, CAST(leaf.pos AS BIGINT) AS pos, unnest(range(sub.height)) AS k
        FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang) l
  LEFT JOIN node s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = l.k AND s.pos = xor(l.pos >> l.k, CAST(1 AS BIGINT))
  UNION ALL
  SELECT l.doc_id, 1000 + k, CASE WHEN s.h IS NULL THEN 'N' WHEN (l.pos >> k) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END
  FROM (SELECT leaf.doc_id, sub.pos, unnest(range(top.height)) AS k
        FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang, top) l
  LEFT JOIN up s ON s.lvl = l.k AND s.pos = xor(l.pos >> l.k, CAST(1 AS BIGINT))),
proof AS (SELECT doc_id, list(s ORDER BY lvl) AS steps FROM step GROUP BY doc_id),
done AS (
  SELECT leaf.doc_id, leaf.h AS leaf, sub.subroot, top.root, sha256(coalesce(array_to_string(list_transform(steps, lambda x: substr(x, 2)), ''), '')) AS proof_sha256,
         CASE WHEN steps IS NULL THEN now ELSE list_reduce(steps, lambda a, x: sha256(CASE substr(x, 1, 1) WHEN 'L' THEN substr(x, 2) || a
              WHEN 'R' THEN a || substr(x, 2) ELSE a END), now) END AS folded_root
  FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN proof ON proof.doc_id = leaf.doc_id, top)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done""",
}
