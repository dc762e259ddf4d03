"""SQL (DuckDB) of the training-data queries that SQL can express."""

_FIELDS = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)")
#: Unsigned CRC-32 of a text's ASCII bytes, bit by bit (3988292384 is the reversed polynomial).
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ord({0}[i:i])::BIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)")


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"COALESCE(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in (*_FIELDS, text)) + ")"


def _tree(name: str, leaves: str, group: str) -> str:
    """Every node of the trees of ``leaves`` (group, pos, h, total): level by level, with the hash of its run."""
    return f"""{name} AS (
  SELECT 0 AS k, {group}, pos, total, h FROM {leaves}
  UNION ALL
  SELECT k + 1, {group}, pos // 3, (total + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE total > 1
  GROUP BY k, {group}, pos // 3, total)"""


def _siblings(name: str, tree: str, group: str) -> str:
    """Per node what stands left and right of it in its run."""
    return f"""{name} AS (
  SELECT k, {group}, pos,
    COALESCE(string_agg(h, '') OVER (PARTITION BY k, {group}, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    COALESCE(string_agg(h, '') OVER (PARTITION BY k, {group}, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {tree} WHERE total > 1)"""


#: ``pos`` by doc_id (ties by leaf), sources null first and by their bytes; paths are folded level by level.
MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
    {_leaf("(CASE WHEN doc_id IS NOT NULL AND " + _CRC.format("CAST(doc_id AS VARCHAR)") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS altered
  FROM documents),
leaves AS (
  SELECT *, leaf AS h, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS total,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM d),
{_tree('nodes', 'leaves', 'g')},
tops AS (SELECT 0 AS t, g AS pos, h, count(*) OVER () AS total FROM nodes WHERE total = 1),
{_tree('upper', 'tops', 't')},
{_siblings('near', 'nodes', 'g')},
{_siblings('near_upper', 'upper', 't')},
walk AS (
  SELECT 0 AS k, doc_id, g, pos, pos AS here, leaf, altered AS f, '' AS p FROM leaves
  UNION ALL
  SELECT w.k + 1, doc_id, w.g, w.pos, here // 3, leaf, sha256(l || f || r), p || l || r
  FROM walk w JOIN near n ON n.k = w.k AND n.g = w.g AND n.pos = w.here),
own AS (SELECT doc_id, g, leaf, f, p FROM walk QUALIFY row_number() OVER (PARTITION BY g, pos ORDER BY k DESC) = 1),
climb AS (
  SELECT 0 AS k, 0 AS t, g AS here, g, row_number() OVER () AS i, doc_id, leaf, f, p FROM own
  UNION ALL
  SELECT c.k + 1, c.t, here // 3, g, i, doc_id, leaf, sha256(l || f || r), p || l || r
  FROM climb c JOIN near_upper n ON n.k = c.k AND n.t = c.t AND n.pos = c.here),
done AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY i ORDER BY k DESC) = 1)
SELECT doc_id, leaf, tops.h AS subroot, upper.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = upper.h AS verified
FROM done JOIN tops ON tops.pos = done.g JOIN upper ON upper.total = 1
"""

WARC_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS payload FROM pages),
q AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
        MIN(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""
