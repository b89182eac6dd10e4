"""The versioned model store: saves that break off, slices given twice, writers that collide."""

import pytest

from onefold.sources import store
from onefold.spec import TermSpec

SPEC = TermSpec("y", ("x",), (), True)


def summary(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "n long")


def totals(spark, folder):
    return sorted(r["n"] for r in store.load_table(spark, folder, "summary").collect())


def test_versions_grow_and_survive_a_broken_save(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "m")
    assert store.newest(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        store.load_spec(spark, folder)
    assert store.save_model(folder, SPEC, slices=["a"], summary=summary(spark, 1), levels=summary(spark, 7)) == 1
    assert store.save_model(folder, SPEC, base=1, grown=["summary"], slices=["b"], summary=summary(spark, 2)) == 2
    assert totals(spark, folder) == [1, 2] and store.has_table(spark, folder, "levels")
    store.write_parts(folder, summary=summary(spark, 99))  # never named by a manifest row
    assert totals(spark, folder) == [1, 2]
    assert store.known_slices(spark, folder, ["a", "b", "c"]) == {"a", "b"}
    assert store.known_slices(spark, folder, []) == set()
    monkeypatch.setattr(store, "MAX_PARTS", 2)
    assert store.save_model(folder, SPEC, base=2, grown=["summary"], slices=["c"], summary=summary(spark, 3)) == 3
    now = store.newest(spark, folder)
    assert len(now["tables"]["summary"]) == len(now["tables"]["ledger"]) == 1
    assert totals(spark, folder) == [1, 2, 3] and store.known_slices(spark, folder, "abc") == set("abc")
    # Not an extension: tables that are not given are gone.
    assert store.save_model(folder, SPEC, summary=summary(spark, 5)) == 4
    assert totals(spark, folder) == [5] and not store.has_table(spark, folder, "levels") and store.load_spec(spark, folder) == SPEC


def test_colliding_writers(spark, tmp_path):
    folder = str(tmp_path / "m")
    store.save_model(folder, SPEC, summary=summary(spark, 1))
    store.append_summary(summary(spark, 2), folder)
    with pytest.raises(store.Conflict, match="no longer the newest"):
        store.save_model(folder, SPEC, base=1, grown=["summary"], summary=summary(spark, 3))
    row = spark.read.text(f"{folder}/manifest").orderBy("value").tail(1)
    spark.createDataFrame(row).coalesce(1).write.mode("append").text(f"{folder}/manifest")
    with pytest.raises(store.Conflict, match="two saves"):
        store.newest(spark, folder)
    with pytest.raises(ValueError, match="unknown table"):
        store.load_table(spark, folder, "other")
