"""Components against a plain union-find."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skarn.llm._shared import ship
from skarn.llm.components import connected


def brute(links):
    root = {}
    for u, v in links:
        if u is not None and v is not None and u != v:
            root.setdefault(u, u), root.setdefault(v, v)
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    return sorted((k, find(k)) for k in root)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-9, 20)), st.integers(-9, 20)), max_size=25))
def test_random_links(spark, links):
    ship(spark)
    df = spark.createDataFrame(links, "u long, v long").repartition(4)
    assert sorted(tuple(r) for r in connected(df).collect()) == brute(links)


def test_a_path_and_a_star(spark):
    ship(spark)
    links = [(k + 1, k) for k in range(40)] + [(100, 100 + k) for k in range(1, 40)]
    df = spark.createDataFrame(links, "u long, v long").repartition(8)
    assert sorted(tuple(r) for r in connected(df).collect()) == brute(links)
