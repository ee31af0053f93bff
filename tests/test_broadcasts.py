"""Tables whose files are small but whose rows are many are not sent to the driver."""

from engramlake import session
from engramlake.operators import entity as B
from engramlake.operators import memory as M


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "MOST_BROADCAST", 1, raising=False)
    rows = [(i % 2, f"Customer#{i}") for i in range(40)]
    entities = session.materialise(spark.createDataFrame(rows, "world_id int, entity string"), "entities")
    values = session.materialise(
        spark.createDataFrame([(w, n, [n[9:] + ".5"]) for w, n in rows if w == 0], "world_id int, entity string, variants array<string>"), "values"
    )
    entries = session.materialise(
        spark.createDataFrame([(w, i, f"{n} | {i}.5") for i, (w, n) in enumerate(rows)], "world_id int, entry_id int, content string"), "entries"
    )
    out = M.detect_stored_entities(entities, values, entries)
    assert "SortMergeJoin" in plan(out) and "BroadcastHashJoin" not in plan(out)
    # Customer#1 is also in the texts of Customer#11, and so on; only world 0 has values
    assert {r.entity for r in out.where("stored").collect()} == {n for w, n in rows if w == 0}
    assert out.count() == 40


def test_few_rows_are_left_to_spark(spark):
    small = session.materialise(spark.range(10), "small")
    assert "BroadcastHashJoin" in plan(spark.range(5).join(session.sized(small), "id"))


def test_the_catalogue_is_sent_to_the_entities(spark):
    wide = session.materialise(spark.createDataFrame([(1, "a", 2.0, "x")], "world_id int, entity string, n double, s string"), "wide")
    catalogue = spark.createDataFrame([("n", "float", "$", "number"), ("s", "enum", "", "kind")], "attr string, dtype string, unit string, label string")
    long = B.entity_long(wide, catalogue, ["world_id", "entity"])
    assert "BuildRight" in plan(long) and "BuildLeft" not in plan(long)
    assert "BuildLeft" not in plan(M.value_variants(long, catalogue))
    assert sorted((r.attr, r.dtype, r.num, r.str) for r in long.collect()) == [("n", "float", 2.0, None), ("s", "enum", None, "x")]
