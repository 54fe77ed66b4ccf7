"""SQL counterparts of this subpackage's queries that SQL can express."""

from __future__ import annotations

from scorelake.plans.spelling import NONE_SQL, trim_sql

_VALUES = " UNION ALL ".join(
    [f"SELECT upper({trim_sql('ligand_id')}) AS l, '{c}' || nullif(regexp_replace(lower({trim_sql(c)}), '[\\s\\-_:]', '', 'g'), '') AS k FROM ligands WHERE lower({trim_sql(c)}) NOT IN ({NONE_SQL})" for c in ("split_group_id", "source_molecule_id", "document_id")]
    + [f"SELECT upper({trim_sql('ligand_id')}), 'scaffold' || {trim_sql('scaffold_smiles')} FROM ligands WHERE lower({trim_sql('scaffold_smiles')}) NOT IN ({NONE_SQL})"]
)

SQL = {
    "p4_found": """WITH c AS (SELECT pool_id, conformer_id, max(pocket_features) AS f FROM conformers WHERE pocket_features IS NOT NULL AND len(pocket_features) > 0 AND pool_id IS NOT NULL AND conformer_id IS NOT NULL GROUP BY ALL),
 e AS (SELECT pool_id, conformer_id, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM c), s AS (SELECT pool_id, i, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY ALL), z AS (SELECT e.pool_id, conformer_id, i, CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0 END AS v FROM e JOIN s USING (pool_id, i))
 SELECT DISTINCT conformer_id_a, conformer_id_b FROM (SELECT a.pool_id, a.conformer_id AS conformer_id_a, b.conformer_id AS conformer_id_b FROM z a JOIN z b ON a.pool_id = b.pool_id AND a.i = b.i AND a.conformer_id < b.conformer_id GROUP BY ALL HAVING round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) <= 1.0)""",
    "p5_found": f"""WITH RECURSIVE e AS (SELECT DISTINCT l, k FROM ({_VALUES}) WHERE k IS NOT NULL AND l IS NOT NULL), n AS (SELECT DISTINCT a.l AS a, b.l AS b FROM e a JOIN e b USING (k)), r AS (SELECT DISTINCT l, l AS g FROM e UNION SELECT n.b, r.g FROM r JOIN n ON n.a = r.l)
 SELECT min(g) AS anchor_ligand_id, l AS ligand_id FROM r GROUP BY l HAVING min(g) <> l""",
}
