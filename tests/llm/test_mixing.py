from __future__ import annotations

from scorelake.llm import mixing

DOCS = "doc_id long, text string, source string, position int, before int"


def sizes(spark, counts):
    rows = [(i, s, n) for i, (s, n) in enumerate(counts)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "mix_id string, source string, target_share double, max_repeats int")


def test_shares_repeats_and_order(spark):
    made = sizes(spark, [("big", 100 + i % 7) for i in range(600)] + [("small", 90 + i % 5) for i in range(40)] + [("other", 10)] * 5)
    planned = mixing.plan(made, targets(spark, ("m", "BIG ", 0.7, 1), ("m", "small", 0.2, 3), ("m", "void", 0.1, 5)))
    mixed = mixing.mix(made, planned)
    rows = mixed.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    assert [r.training_time for r in rows] == sorted(r.training_time for r in rows)
    uses = {}
    for r in rows:
        uses[r.source, r.doc_id] = uses.get((r.source, r.doc_id), 0) + 1
        assert r.repeat_no <= (1 if r.source == "big" else 3)
    assert max(n for (s, _), n in uses.items() if s == "small") == 3 and {s for s, _ in uses} == {"big", "small"}
    share = {r.source: r for r in mixing.shares(mixed, planned).collect()}
    assert abs(share["big"].actual_share - 0.7 / 0.9) < 0.01 and abs(share["small"].actual_share - 0.2 / 0.9) < 0.01
    assert share["void"].actual_share == 0 and share["void"].documents == 0
    early = [r for r in rows if r.training_time < 0.2]
    late = [r for r in rows if r.training_time > 0.8]
    part = lambda x: sum(r.n_tokens for r in x if r.source == "small") / sum(r.n_tokens for r in x)
    assert part(early) < 0.2 / 0.9 < part(late)


def test_budget_that_a_source_cant_meet(spark):
    made = sizes(spark, [("a", 100)] * 50 + [("b", 100)] * 2)
    planned = mixing.plan(made, targets(spark, ("m", "a", 0.5, 1), ("m", "b", 0.5, 2)), 4000)
    share = {r.source: r for r in mixing.shares(mixing.mix(made, planned), planned).collect()}
    assert share["b"].mixed_tokens == 400 and share["a"].mixed_tokens == 2000 and share["b"].most_repeats == 2


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "hello there", " A ", 0, 0), (2, None, "a", 0, 0), (3, "", "a", 0, 0), (4, "text", None, 0, 0), (None, "x y", "a", 0, 0)], DOCS)
    made = mixing.sized_documents(docs)
    assert {(r.doc_id, r.source, r.n_tokens) for r in made.collect()} >= {(1, "a", 2), (2, "a", 0), (3, "a", 0)}
    planned = mixing.plan(made, targets(spark, ("m", "a", 1.0, 2), ("m", "a", None, None), ("n", None, 0.0, 0)))
    assert {r.doc_id for r in mixing.mix(made, planned).collect()} == {1, None}
    assert mixing.mix(made.limit(0), mixing.plan(made.limit(0), targets(spark, ("m", "a", 1.0, 2)))).count() == 0
