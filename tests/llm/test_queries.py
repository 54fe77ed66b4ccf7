"""The registered queries run on the smallest tables; those with SQL give its rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from scorelake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, folder, rows, name):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, folder)
    assert rows(df) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall())


@pytest.fixture(scope="module")
def got(spark, folder):
    """The rows of a registered query over the smallest tables, read once."""
    kept = {}

    def rows_of(name):
        if name not in kept:
            kept[name] = queries.QUERIES[name](spark, folder).collect()
        return kept[name]

    return rows_of


def test_subsets_are_filled_with_different_shapes(spark, folder, got):
    conformers = spark.read.parquet(f"{folder}/conformers.parquet").where("pocket_features IS NOT NULL")
    usable = {r.pool_id: r.n for r in conformers.groupBy("pool_id").agg(F.countDistinct("conformer_id").alias("n")).collect()}
    sizes = {r.request_id: r.subset_size for r in spark.read.parquet(f"{folder}/selection_requests.parquet").collect()}
    chosen = {}
    for r in got("p4_subset"):
        chosen.setdefault((r.request_id, r.pool_id), []).append(r)
    assert set(chosen) == {(q, p) for q in sizes for p in usable}
    for (request, pool), own in chosen.items():
        assert len(own) == len({r.conformer_id for r in own}) == min(sizes[request], usable[pool])
        assert len({(r.shape, r.source_type, r["rank"]) for r in own}) == len(own)


def test_splits_keep_linked_sets_whole(spark, folder, got):
    split = {r.ligand_id: r.split_name for r in got("p5_splits")}
    ids = {r[0] for r in spark.read.parquet(f"{folder}/ligands.parquet").select(F.upper(F.trim("ligand_id"))).distinct().collect() if r[0]}
    assert len(split) == len(got("p5_splits")) and set(split) == ids
    assert all(split[r.ligand_id] == split[r.anchor_ligand_id] for r in got("p5_found"))
    report = {r.split_name: r for r in got("p5_report")}
    assert sum(r.records for r in report.values()) == len(split) and sum(r.record_share for r in report.values()) == pytest.approx(1)
    assert {n: sum(v == n for v in split.values()) for n in report} == {n: r.records for n, r in report.items()}


def test_mixtures_keep_caps_and_shares(spark, folder, got):
    caps = {(r.mix_id, r.source): r for r in got("p7_shares")}
    uses, order, tokens = {}, {}, {}
    for r in got("p7_mixture"):
        uses[r.mix_id, r.source, r.doc_id] = uses.get((r.mix_id, r.source, r.doc_id), 0) + 1
        order.setdefault(r.mix_id, []).append((r.position, r.training_time))
        tokens[r.mix_id, r.source] = tokens.get((r.mix_id, r.source), 0) + r.n_tokens
    assert all(n <= caps[m, s].max_repeats for (m, s, _), n in uses.items())
    for own in order.values():
        own.sort()
        assert [p for p, _ in own] == list(range(len(own))) and all(a[1] <= b[1] for a, b in zip(own, own[1:]))
    for mix in order:
        rows = [r for (m, _), r in caps.items() if m == mix]
        assert sum(r.actual_share for r in rows) == pytest.approx(1)
        able = sum(r.target_share for r in rows if r.available_tokens)
        for r in rows:
            assert r.mixed_tokens == tokens.get((mix, r.source), 0)
            assert r.actual_share == pytest.approx(r.target_share / able if r.available_tokens else 0, abs=0.05)


def test_rates_count_the_found_documents(spark, folder, got):
    rates = got("p8_rates")
    assert sum(r.cut_texts for r in rates) == len(got("p8_found")) > 0
    assert sum(r.texts for r in rates) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.cut_rate == pytest.approx(r.cut_texts / r.texts) and r.cut_at_limit <= r.cut_texts for r in rates)


def test_ids_restore_the_texts(spark, folder, got):
    from scorelake.llm import tokens

    encoding, _, _ = tokens._encoder(tokens.TOKENIZERS, tokens.VOCABULARY)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: encoding.decode(r.ids) for r in got("p6_ids")} == {i: t or "" for i, t in texts.items()}
