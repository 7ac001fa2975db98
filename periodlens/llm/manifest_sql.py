"""The manifest of ``documents`` for an SQL engine (DuckDB), with the levels of the trees written out."""

from __future__ import annotations

#: Levels of a source's tree and of the tree over sources: enough for 16^6 documents of 16^3 sources.
SOURCE_LEVELS = 6
TOP_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars")


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*[_field(f) for f in FIELDS], _field(text)]) + ")"


# The reflected polynomial and the mask of CRC-32.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT)"""


def _levels(name: str, count: int) -> str:
    """``name``0 has the leaves of trees (tree, idx, m, digest); the levels above it follow."""
    return "".join(
        f"""{name}{k} AS (SELECT tree, idx // 16 AS idx, (m + 15) // 16 AS m, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
        FROM {name}{k - 1} WHERE m > 1 GROUP BY tree, idx // 16, (m + 15) // 16),
        """
        for k in range(1, count + 1)
    )


def _climb(name: str, nodes: str, count: int) -> str:
    """``name``0 has a row's place, proof and folded digest; each step adds the siblings of one level."""
    return "".join(
        f"""{name}{k} AS (SELECT d.rid, d.tree, d.idx // 16 AS idx, (d.m + 15) // 16 AS m,
          d.proof || coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (WHERE n.idx <> d.idx), '') AS proof,
          CASE WHEN d.m > 1 THEN sha256(string_agg(CASE WHEN n.idx = d.idx THEN d.fold ELSE n.digest END, '' ORDER BY n.idx)) ELSE d.fold END AS fold
        FROM {name}{k - 1} d LEFT JOIN {nodes}{k - 1} n ON d.m > 1 AND n.tree = d.tree AND n.idx // 16 = d.idx // 16
        GROUP BY d.rid, d.tree, d.idx, d.m, d.proof, d.fold),
        """
        for k in range(1, count + 1)
    )


def _roots(name: str, count: int) -> str:
    return " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE m = 1" for k in range(count + 1))


def documents_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(text, '{upper}', '{upper.lower()}')"
    return f"""
WITH hashed AS (SELECT doc_id, source, {_leaf('text')} AS leaf,
    CASE WHEN {CRC32} % 5 = 0 THEN {_leaf(lowered)} ELSE {_leaf('text')} END AS claimed FROM documents),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS m FROM hashed),
n0 AS (SELECT tree, idx, m, leaf AS digest FROM placed),
{_levels('n', SOURCE_LEVELS)}
subroots AS ({_roots('n', SOURCE_LEVELS)}),
t0 AS (SELECT 0 AS tree, tree AS idx, count(*) OVER () AS m, digest FROM subroots),
{_levels('t', TOP_LEVELS)}
root AS ({_roots('t', TOP_LEVELS)}),
q0 AS (SELECT rid, tree, idx, m, '' AS proof, claimed AS fold FROM placed),
{_climb('q', 'n', SOURCE_LEVELS)}
s0 AS (SELECT q.rid, 0 AS tree, q.tree AS idx, t.m, q.proof, q.fold FROM q{SOURCE_LEVELS} q JOIN t0 t ON t.idx = q.tree),
{_climb('s', 't', TOP_LEVELS)}
done AS (SELECT rid, proof, fold FROM s{TOP_LEVELS})
SELECT p.doc_id, p.leaf, u.digest AS subroot, r.digest AS root, sha256(d.proof) AS proof_sha256, d.fold AS folded_root,
  d.fold = r.digest AS verified
FROM placed p JOIN subroots u ON u.tree = p.tree JOIN done d ON d.rid = p.rid, root r
"""
