"""Where tables between stages may lie."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from merceris.llm.common import _SHUFFLES_GO, shared_folder, stored


def test_a_cluster_needs_a_shared_folder():
    set_to: dict[str, str] = {}
    fake = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder, set=set_to.__setitem__), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(fake("yarn", "hdfs://x/y/")).startswith("hdfs://x/y/merceris-")
    assert shared_folder(fake("local[2]", None)).startswith("file://")
    with pytest.raises(ValueError):
        shared_folder(fake("yarn", None))


@pytest.mark.parametrize("set_to", [None, "false", "true"])
def test_stored_tables_leave_the_session_as_it_was(spark, set_to):
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.unset(_SHUFFLES_GO) if set_to is None else spark.conf.set(_SHUFFLES_GO, set_to)
    grouped = spark.range(100).selectExpr("id % 7 as k", "id").groupBy("k").sum("id").toDF("k", "total")
    again = stored(stored(grouped).join(grouped, ["k", "total"]))  # the second write needs the first one's shuffle anew
    assert spark.conf.get(_SHUFFLES_GO, None) == set_to
    assert sorted(map(tuple, again.collect())) == sorted((k, sum(range(k, 100, 7))) for k in range(7))
    with pytest.raises(Exception):
        stored(spark.range(3).selectExpr("raise_error('x') as e"))
    assert spark.conf.get(_SHUFFLES_GO, None) == set_to
    spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)
