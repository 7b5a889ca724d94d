"""The shared folder and the texts that workers hold."""

import os

import pyarrow as pa
import pytest

from larkspur.llm import common as C
from tests.llm.helpers import SF, docs, rows


def test_materialize_and_clear(spark):
    d = docs(spark, [(1, "a", None), (None, None, "s")])
    kept = C.materialize(d, "t")
    assert rows(kept) == rows(d) and kept.schema == d.schema and rows(C.materialize(docs(spark, []), "t")) == []
    where = C._own_dir(spark).removeprefix("file://")
    assert os.path.isdir(where)
    C.clear(spark)
    assert not os.path.exists(where)


def test_shared_dir_is_the_session_s(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert C.shared_dir(spark) == C.shared_dir(spark) == (before or C.shared_dir(spark)).rstrip("/")


def test_spread(spark):
    d = C.load(spark, SF, "documents", spread=True)
    assert d.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows(d.select("doc_id")) == rows(C.load(spark, SF, "documents").select("doc_id"))


def test_slices_cover_all():
    texts = pa.array(["aa", None, "", "b" * 50, "ccc", None])
    for most in (1, 4, 10, 1000):
        got = list(C.slices(texts, most))
        assert [x for _, _, t in got for x in t] == texts.to_pylist()
        assert [i for i, _, _ in got] == [0, *[j for _, j, _ in got]][:-1]
    assert list(C.slices(pa.array([], pa.string()))) == []


def test_one_cache_at_a_time():
    a, b = {1: 1}, {2: 2}
    C.claim(a)
    C.claim(b)
    assert a == {} and b == {2: 2}
    C.claim(b)
    assert b == {2: 2}


def test_finished_leaves_only_its_result(spark):
    C.clear(spark)
    d = docs(spark, [(1, "a", None), (2, "b", None)])
    kept = C.finished(spark, lambda: C.materialize(d, "step").where("doc_id = 1"), "done")
    where = C._own_dir(spark).removeprefix("file://")
    assert [x.split("-")[0] for x in os.listdir(where)] == ["done"] and rows(kept) == [(1, "a", None)]
    outer = C.finished(spark, lambda: C.finished(spark, lambda: C.materialize(d, "a"), "b"), "c")
    assert sorted(x.split("-")[0] for x in os.listdir(where)) == ["c", "done"] and outer.count() == 2
    with pytest.raises(ZeroDivisionError):
        C.finished(spark, lambda: C.materialize(d, "lost") and 1 / 0, "never")
    C.release(kept, outer, d)
    assert os.listdir(where) == []


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    monkeypatch.setattr(C, "_local", {})
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            C.shared_dir(spark)


def test_identifiers_are_integers(spark):
    for kind in ("byte", "short", "int", "long"):
        assert docs(spark, [], f"doc_id {kind}").select(C.integer(docs(spark, [], f"doc_id {kind}"), "doc_id")).count() == 0
    with pytest.raises(TypeError):
        C.integer(docs(spark, [], "doc_id string"), "doc_id")


def test_one_of_alike_rows_in_any_order(spark):
    data = [(1, {"a": 1}, "x"), (1, {"a": 2}, None), (2, None, None)]
    d = docs(spark, data, "k long, m map<string, int>, `a.b` string")
    for x in (d, d.repartition(3)):
        assert sorted((r[0], r[1]) for r in C.one_of(x, d.columns, ["k"]).collect()) == [(1, {"a": 1}), (2, None)]
    assert d.select(C.row_hash(d, d.columns)).distinct().count() == 3
