"""DuckDB form of the Merkle manifest (op11)."""


def _field(value: str) -> str:
    return f"coalesce(concat(strlen(CAST({value} AS VARCHAR)), ':', {value}), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of a decimal number's characters, without the final complement's effect on the lowest bit
CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

SIBLINGS = """SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
  coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {nodes} a JOIN {nodes} b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL"""

MANIFEST_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {_leaf('text')} AS leaf,
  CASE WHEN {CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS own FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
nodes AS (SELECT tree, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
subroots AS (SELECT tree, h AS subroot FROM nodes WHERE n = 1),
top AS (SELECT 0 AS tree, 0 AS lvl, tree AS pos, subroot AS h, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
low_sib AS ({SIBLINGS.format(nodes='nodes')}), top_sib AS ({SIBLINGS.format(nodes='top')}),
fold AS (SELECT doc_id, tree, 0 AS lvl, pos, own, '' AS proof FROM leaves
  UNION ALL SELECT doc_id, f.tree, f.lvl + 1, f.pos // 3, sha256(l || own || r), proof || l || r FROM fold f JOIN low_sib s ON s.tree = f.tree AND s.lvl = f.lvl AND s.pos = f.pos),
low AS (SELECT doc_id, tree, own, proof FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1),
rise AS (SELECT doc_id, 0 AS lvl, tree AS pos, own, proof FROM low
  UNION ALL SELECT doc_id, f.lvl + 1, f.pos // 3, sha256(l || own || r), proof || l || r FROM rise f JOIN top_sib s ON s.lvl = f.lvl AND s.pos = f.pos),
whole AS (SELECT doc_id, own, proof FROM rise QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, whole.own AS folded_root, whole.own = root AS verified
FROM leaves JOIN subroots USING (tree) JOIN whole USING (doc_id) CROSS JOIN (SELECT h AS root FROM top WHERE n = 1)"""
