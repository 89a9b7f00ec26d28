"""Every named query against its checking SQL, on the smallest tables."""

import sys

import pytest
from check_oracles import compare, connect
from conftest import SMALL

from siftlake.plans import PLANS


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, con, name):
    problem, rows = compare(spark, con, PLANS[name], SMALL)
    assert problem is None
    if PLANS[name].sql is None:
        assert rows > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    first = entry.entry(spark)
    assert first.columns[:3] == ["origin", "family", "rule_id"] and not first.isEmpty()


#: Functions without which an operator is not run, whatever a query says that it covers.
CORE = {
    "A1": ("siftlake.sources.readers", "read_corpus"), "A15": ("siftlake.sources.artifacts", "read_pickle_references"), "D2": ("siftlake.operators.rule_table", "scan_rules"),
    "E9": ("siftlake.operators.advisories", "affected_references"), "L5": ("siftlake.streaming.streams", "stream_debounce"), "L7": ("siftlake.streaming.streams", "stream_answers"),
    "L10": ("siftlake.streaming.streams", "start_append"), "L12": ("siftlake.streaming.streams", "LateRows"), "L13": ("siftlake.streaming.streams", "start_append"),
}


@pytest.mark.parametrize("code", sorted(CORE))
def test_covered_operators_are_called(spark, monkeypatch, code):
    """One of the queries that cover an operator stops when its function is taken away."""
    module, name = CORE[code]
    home = sys.modules[module]
    original, called = getattr(home, name), []

    class Called(Exception):
        pass

    def gone(*args, **kwargs):
        called.append(name)
        raise Called

    monkeypatch.setattr(home, name, gone)
    for plans in [m for n, m in sys.modules.items() if n.startswith("siftlake.plans")]:
        if getattr(plans, name, None) is original:
            monkeypatch.setattr(plans, name, gone)
    for p in [p for p in PLANS.values() if code in p.covers]:
        try:
            p.run(spark, SMALL)
        except Called:
            return
    raise AssertionError(f"no query calls {name} for {code}")
