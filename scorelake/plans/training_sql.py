"""SQL counterparts of the general training-data queries."""

from __future__ import annotations

from scorelake.plans.spelling import NONE_SQL, folded_sql, trim_sql


def _number(c: str) -> str:
    t = f"lower({trim_sql(c)})"
    return f"CASE WHEN {t} NOT IN ({NONE_SQL}) THEN TRY_CAST(replace({t}, ',', '.') AS DOUBLE) END"


def _tail_lower(c: str) -> str:
    tail = f"split_part(lower({trim_sql(c)}), '_', -1)"
    return f"concat(upper(left({trim_sql(c)}, length({trim_sql(c)}) - length({tail}))), {tail})"


def _hex(c: str) -> str:
    return f"nullif(regexp_replace({folded_sql(c)}, '^(?:[a-z]+-?[0-9]*\\s*[:=]|0x)\\s*', ''), '')"


def _dataset(name: str, table: str, key: str, fields: dict[str, tuple[str, bool]]) -> str:
    values = ", ".join(f"{e} AS {f}" for f, (e, _) in fields.items())

    def side(t: str) -> str:
        return f"(SELECT * EXCLUDE (n) FROM (SELECT {key} AS record_key, {values}, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC NULLS LAST) AS n FROM {t}) WHERE n = 1)"

    tests = []
    for f, (_, numeric) in fields.items():
        test = f"a.{f} IS DISTINCT FROM b.{f}"
        if numeric:
            test = f"(CASE WHEN a.{f} IS NOT NULL AND b.{f} IS NOT NULL THEN abs(a.{f} - b.{f}) > 1e-6 * (1 + 1e-6) ELSE {test} END)"
        tests.append(f"SELECT '{name}' AS dataset, record_key, 'differs' AS finding, '{f}' AS field_name FROM a JOIN b USING (record_key) WHERE {test}")
    return (
        f"WITH a AS {side(table)}, b AS {side(table + '_mirror')} SELECT '{name}' AS dataset, record_key, 'missing_in_mirror' AS finding, '' AS field_name FROM a ANTI JOIN b USING (record_key)"
        f" UNION ALL SELECT '{name}', record_key, 'missing_in_primary', '' FROM b ANTI JOIN a USING (record_key) UNION ALL " + " UNION ALL ".join(tests)
    )


SCORES = _dataset(
    "scores",
    "seed_scores",
    f"concat_ws('|', upper({trim_sql('target_id')}), lower({trim_sql('seed_id')}), upper({trim_sql('ligand_id')}), {_tail_lower('receptor_id')})",
    {"gpu_score": (_number("gpu_score"), True), "status": (folded_sql("status"), False), "scored_at": ("scored_at", False)},
)
RECEPTORS = _dataset(
    "receptors",
    "receptors",
    _tail_lower("conformer_id"),
    {"receptor_pdbqt_sha256": (_hex("receptor_pdbqt_sha256"), False), "chain": (folded_sql("chain"), False)}
    | {f: (_number(f), True) for f in ("residue_count", "receptor_atom_count", "hydrogen_like_atom_count", "charge_min", "charge_max")}
    | {"status": (folded_sql("status"), False), "validation_role": (folded_sql("validation_role"), False)},
)
_MARKS = "concat(chr(65279), chr(8203), ' ', chr(9), chr(10), chr(13))"
_TEXT = f"trim(json_extract_string(v, '$'), {_MARKS})"
_PART = "struct_pack(v := {v}, path := {path}, element := {element}, owner := {owner}, field := {field}, ordinal := {ordinal})"
_MEMBER = _PART.format(v="json_extract(v, '$.\"' || k || '\"')", path="CASE WHEN path = '' THEN k ELSE path || '.' || k END", element="element", owner="path", field="k", ordinal="CAST(NULL AS BIGINT)")
_ELEMENT = _PART.format(v="json_extract(v, '$[' || i || ']')", path="path || '[' || i || ']'", element="path || '[' || i || ']'", owner="owner", field="field", ordinal="i")
_OPENED = _PART.format(v=f"CAST({_TEXT} AS JSON)", path="path", element="element", owner="owner", field="field", ordinal="ordinal")
# Every value of a record with its place; texts that hold JSON are opened where they stand.
_PLACES = f"""WITH RECURSIVE places(record_id, v, path, element, owner, field, ordinal) AS (SELECT DISTINCT record_id, to_json(record), '', '', '', '', CAST(NULL AS BIGINT) FROM run_records WHERE record IS NOT NULL
 UNION ALL SELECT record_id, p.v, p.path, p.element, p.owner, p.field, p.ordinal FROM (SELECT record_id, unnest(CASE json_type(v) WHEN 'OBJECT' THEN [{_MEMBER} for k in json_keys(v)] WHEN 'ARRAY' THEN [{_ELEMENT} for i in range(CAST(json_array_length(v) AS BIGINT))]
 WHEN 'VARCHAR' THEN CASE WHEN left({_TEXT}, 1) IN ('{{', '[') AND json_valid({_TEXT}) THEN [{_OPENED}] ELSE [] END ELSE [] END) AS p FROM places)), objects AS (SELECT * FROM places WHERE json_type(v) = 'OBJECT')"""
SQL = {
    "p1_found": f"SELECT * FROM ({SCORES}) UNION ALL SELECT * FROM ({RECEPTORS})",
    "p3_found": f"{_PLACES} SELECT DISTINCT record_id, path AS node_path, element AS parent_path FROM objects WHERE json_type(v, '$.sha256') = 'VARCHAR' AND {trim_sql("json_extract_string(v, '$.sha256')")} <> ''",
    "p3_places": f"{_PLACES} SELECT DISTINCT record_id, path AS node_path, element AS parent_path, owner AS owner_path, field, CAST(ordinal AS INTEGER) AS ordinal FROM objects",
    "p3_kinds": f"{_PLACES} SELECT regexp_replace(path, '\\[[0-9]+\\]', '', 'g') AS kind, count(DISTINCT (record_id, path)) AS occurrences, count(DISTINCT record_id) AS records FROM objects GROUP BY ALL",
}
