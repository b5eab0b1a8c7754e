import pytest

from metricloom import errors as E
from metricloom.__main__ import main
from metricloom.plans.graph import JoinGraph
from metricloom.plans.model import Aggregation, EntityType, JoinType, parse_model
from metricloom.plans.request import MAX_LIMIT, Request
from metricloom.plans.resolve import boolean, classify, number
from metricloom.plans.state import StateManager

SMALL = """
name: shop
unknown_key: 1
entities:
  - {name: orders, table: public.orders, primary_key: id, dimensions: [{name: status, type: string, sql: status}], measures: [{name: total, agg: sum, sql: amount * 1.05}]}
metrics: [{name: revenue, measure: total, dimensions: [status]}]
"""


def test_defaults_and_unknown_keys():
    m = parse_model(SMALL)
    assert m.entities[0].entity_type is EntityType.FACT and m.joins == () and m.entities[0].rls_policies == ()
    assert m.entities[0].measures[0].agg is Aggregation.SUM


@pytest.mark.parametrize("old, new, error", [
    ("name: shop", "name: 123_bad", E.ValidationError),
    ("name: shop", "name: Shop", E.ValidationError),
    ("primary_key: id", "primary_key: my-id", E.ValidationError),
    ("primary_key: id, ", "", E.YamlError),
    ("sql: status", "sql: orders.status", E.ValidationError),
    ("type: string", "type: text", E.YamlError),
    ("agg: sum", "agg: median", E.YamlError),
    ("[{name: status, type: string, sql: status}]", "not a list", E.YamlError),
    ("entities:", "entities: [", E.YamlError),
])
def test_bad_models(old, new, error):
    with pytest.raises(error):
        parse_model(SMALL.replace(old, new))


@pytest.mark.parametrize("sql", ["a.b.c", "amount * 1.05", "amount"])
def test_sql_that_passes(sql):
    assert parse_model(SMALL.replace("amount * 1.05", sql)).entities[0].measures[0].sql == sql


def test_all_aggregations():
    for a in ("sum", "count", "average", "min", "max", "count_distinct"):
        assert parse_model(SMALL.replace("agg: sum", f"agg: {a}")).entities[0].measures[0].agg.value == a


def test_state_is_replaced_as_a_whole(tmp_path):
    s = StateManager()
    s.load_yaml(SMALL)
    before = s.snapshot()
    assert before.graph is before.graph
    (tmp_path / "b.yml").write_text(SMALL.replace("name: shop", "name: b"))
    (tmp_path / "c.yaml").write_text(SMALL.replace("agg: sum", "agg: nope"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "note.txt").write_text("x")
    with pytest.raises(E.YamlError):
        s.load_dir(tmp_path)
    assert s.snapshot() is before and len(s.all_models()) == 1
    (tmp_path / "c.yaml").unlink()
    s.load_dir(tmp_path)
    assert s.stats().models == 2 and s.default_model().name == "shop" and s.snapshot().graph is not before.graph
    assert len(before.models) == 1 and s.get_model("b") and s.get_model("z") is None
    with pytest.raises(E.IoError):
        s.load_dir(tmp_path / "missing")


def _entity(name, more=""):
    return f"  - {{name: {name}, table: {name}, primary_key: id, dimensions: [], measures: []{more}}}\n"


def test_graph_paths():
    text = "name: g\nentities:\n" + "".join(_entity(n) for n in "abcde") + "metrics: []\njoins:\n"
    text += "  - {left_entity: a, left_column: x, right_entity: b, right_column: y}\n  - {left_entity: b, left_column: p, right_entity: c, right_column: q, join_type: inner}\n"
    text += "  - {left_entity: a, left_column: m, right_entity: d, right_column: n, join_type: full}\n  - {left_entity: a, left_column: second, right_entity: b, right_column: second}\n"
    g = JoinGraph([parse_model(text)])
    assert [(h.left, h.right, h.type) for h in g.path("a", "c")] == [("a", "b", JoinType.LEFT), ("b", "c", JoinType.INNER)]
    assert g.path("a", "b")[0].left_column == "x"
    back = g.path("c", "d")
    assert [(h.left_column, h.right_column) for h in back] == [("q", "p"), ("y", "x"), ("m", "n")] and back[-1].type is JoinType.FULL
    assert g.path("a", "a") == []
    with pytest.raises(E.UnreachablePath):
        g.path("a", "e")
    with pytest.raises(E.TableNotFound):
        g.path("a", "z")
    with pytest.raises(E.MissingNode):
        JoinGraph([parse_model(text.replace("right_entity: c", "right_entity: zz"))])


def test_classification():
    m = parse_model("name: g\nentities:\n" + _entity("f") + _entity("d", ", entity_type: dimension") + _entity("h") + "metrics: []\n")
    f, d, h = m.entities
    assert classify([d])[0] == "pure_dimension" and classify([f, d]) == ("single_fact", ["f"]) and classify([h, d, f]) == ("multi_fact", ["h", "f"])


def test_safe_literals():
    assert [number(x) for x in (" 42 ", "-1", "1.5", "1e3", "inf", "nan", "x", "1_0", "", "99999999999999999999")] == [42, -1, 1.5, 1000.0, None, None, None, None, None, 1e20]
    assert [boolean(x) for x in (" TRUE", "false", "1", "")] == [True, False, None, None]


def test_rest_bodies():
    r = Request.from_rest({"metrics": ["m"], "dimensions": ["a"], "filters": [{"dimension": "a", "operator": "eq", "value": "x"}], "time_range": {"granularity": "day"}, "limit": 5})
    assert (r.metric_name, r.dimensions, r.time_granularity, r.limit) == ("m", ("a",), "day", 5)
    for body in ({"metrics": []}, {"metrics": ["a", "b"]}, {"metrics": [" "]}, {"metrics": ["a"], "limit": 0}, {"metrics": ["a"], "limit": MAX_LIMIT + 1}, {"metrics": ["a"], "x": 1},
                 {"metrics": ["a"], "time_range": {"start": "2020-01-01"}}, {"metrics": ["a"], "time_range": {"y": 1}}, {}):
        with pytest.raises(E.CallerError):
            Request.from_rest(body)
    for text in ("{", "[]", "{}", '{"metric_name": 1}', '{"metric_name": "a", "limit": -1}', '{"metric_name": "a", "filters": [{"dimension": "a", "operator": "like", "value": "x"}]}'):
        with pytest.raises(E.BadRequestJson):
            Request.from_json(text)


def test_command_line(tmp_path, capsys):
    (tmp_path / "a.yml").write_text(SMALL)
    assert main(["validate", str(tmp_path)]) == 0 and "PASS a.yml" in capsys.readouterr().out
    assert main(["compile", str(tmp_path)]) == 0 and "1 models, 1 entities, 1 metrics" in capsys.readouterr().out
    (tmp_path / "b.yml").write_text("name: 1x\n")
    assert main(["validate", str(tmp_path)]) == 1 and "FAIL b.yml" in capsys.readouterr().err
    assert main(["compile", str(tmp_path / "none")]) == 1
