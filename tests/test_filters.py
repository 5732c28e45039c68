import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skerry.functions.filters import columns_of, compile_filter, map_of

ROWS = [(1, "a", 10, True), (2, "b", 9, False), (3, None, None, None), (4, "10", 100, True), (5, "", 0, None)]


def match(spec, row):
    """Two-valued evaluation in plain Python."""
    def leaf(key, op, v):
        x = row.get(key)
        if x is None:
            return op in ("$ne", "$nin")
        eq = lambda y: x == y if type(x) is type(y) else str(x) == str(y)
        if op == "$in":
            return any(eq(y) for y in v)
        if op == "$nin":
            return not any(eq(y) for y in v)
        if op in ("$eq", "$ne"):
            return eq(v) == (op == "$eq")
        a, b = (x, v) if isinstance(x, int) and isinstance(v, int) else (str(x), str(v))
        return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}.get(op, False)

    out = True
    for k, c in spec.items():
        if k == "$and":
            out &= all(match(x, row) for x in c)
        elif k == "$or":
            out &= not c or any(match(x, row) for x in c)
        elif isinstance(c, dict):
            out &= all(leaf(k, op, v) for op, v in c.items())
        else:
            out &= leaf(k, "$eq", c)
    return out


value = {"s": st.sampled_from(["a", "b", "10", ""]), "n": st.sampled_from([0, 9, 10, 100, 7])}


def leaf(key):
    v = value[key]
    one = st.one_of(*(st.fixed_dictionaries({op: v}) for op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$like")))
    return st.one_of(v, one, *(st.fixed_dictionaries({op: st.lists(v, max_size=2)}) for op in ("$in", "$nin")))


flat = st.one_of(*(st.fixed_dictionaries({k: leaf(k)}) for k in value), st.just({}), st.fixed_dictionaries({"none": st.fixed_dictionaries({"$ne": st.just(1)})}))
specs = st.recursive(flat, lambda x: st.one_of(*(st.fixed_dictionaries({op: st.lists(x, max_size=3)}) for op in ("$and", "$or"))), max_leaves=5)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(spec=specs)
def test_against_python(spark, spec):
    df = spark.createDataFrame(ROWS, "id int, s string, n int, b boolean")
    got = {r.id for r in df.where(compile_filter(spec, columns_of(df))).collect()}
    assert got == {r[0] for r in ROWS if match(spec, dict(zip(("id", "s", "n", "b"), r)))}


def test_edges(spark):
    df = spark.createDataFrame(ROWS, "id int, s string, n int, b boolean")
    ids = lambda spec, **k: {r.id for r in df.where(compile_filter(spec, columns_of(df), **k)).collect()}
    assert ids(None) == ids("{}") == {1, 2, 3, 4, 5}
    assert ids({"b": True}) == {1, 4}
    assert ids({"n": {"$gt": 9}}) == {1, 4}
    assert ids({"n": {"$gt": 9}}, string_compare=True) == set()
    with pytest.raises(ValueError):
        compile_filter({"s": {"$in": "a"}}, columns_of(df))
    m = spark.createDataFrame([(1, {"k": "10"}), (2, {})], "id int, m map<string,string>")
    assert [r.id for r in m.where(compile_filter({"k": {"$ne": "10"}}, map_of(m.m))).collect()] == [2]
