"""Protocols by aliases: the automaton and the join of pieces against a plain loop, many aliases, odd rows."""

import random

import pytest

from tidewell.operators import views as V
from tidewell.sources import files as L

CALLS, ALIASES = "id long, procedure_name string, tag string", "alias string, alias_tag string, priority int"


def by_loop(calls, aliases, tags):
    out = {}
    for i, name, tag in calls:
        hits = [(p, t) for a, t, p in aliases if None not in (a, t, p) and name is not None and a in name.lower()]
        out[i] = tag if tag in tags else min(hits)[1] if hits else tag
    return out


@pytest.mark.parametrize("most", [V.MOST_ALIASES, 0])
@pytest.mark.parametrize("empty", [False, True])
def test_first_alias_against_a_loop(spark, monkeypatch, most, empty):
    monkeypatch.setattr(V, "MOST_ALIASES", most)
    rng = random.Random(3)
    word = lambda lo, hi: "".join(rng.choices("abñ", k=rng.randint(lo, hi)))
    aliases = [(word(1, 5), f"t{rng.randint(0, 9)}", rng.randint(0, 50)) for _ in range(60)] + [(None, "x", 0), ("a", None, 0), ("b", "y", None)] + [("", "cualquiera", 99)] * empty
    calls = [(i, word(0, 7).upper(), rng.choice(["t1", "otro", None])) for i in range(400)] + [(400, None, "otro"), (401, None, None), (402, "", None)]
    got = V.resolve_protocol(spark.createDataFrame(calls, CALLS), spark.createDataFrame(aliases, ALIASES), ["t1"])
    assert {r.id: r.protocol for r in got.collect()} == by_loop(calls, aliases, ["t1"])


@pytest.mark.parametrize("most", [V.MOST_ALIASES, 0])
def test_ten_thousand_aliases_without_a_nested_loop(spark, monkeypatch, most):
    monkeypatch.setattr(V, "MOST_ALIASES", most)
    aliases = spark.range(10_000).selectExpr("'procedimiento ' || id || ';' as alias", "'tag-' || id as alias_tag", "cast(id as int) as priority")
    calls = spark.range(5_000).selectExpr("id", "'Un Procedimiento ' || (id * 7 % 12000) || '; y más' as procedure_name", "'crudo' as tag")
    got = V.resolve_protocol(calls, aliases, ["hernia"])
    assert {r.id: r.protocol for r in got.collect()} == {i: f"tag-{i * 7 % 12000}" if i * 7 % 12000 < 10_000 else "crudo" for i in range(5_000)}
    plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("most", [V.MOST_ALIASES, 0])
def test_no_aliases(spark, monkeypatch, most):
    monkeypatch.setattr(V, "MOST_ALIASES", most - 1 if most == 0 else most)
    got = V.resolve_protocol(spark.createDataFrame([(1, "hernia", "a"), (2, None, None)], CALLS), spark.createDataFrame([], ALIASES), ["z"])
    assert {r.id: r.protocol for r in got.collect()} == {1: "a", 2: None}


def test_survey_goes_through_json(spark):
    rows = spark.sql("select 1 as id, map('dolor', '7', 'ánimo', 'a\"b') as survey union all select 2, map() union all select 3, null")
    encoded = L.encode_columns(rows)
    assert dict(encoded.dtypes)["survey"] == "string"
    assert {r.id: r.survey for r in L.decode_columns(encoded).collect()} == {1: {"dolor": "7", "ánimo": 'a"b'}, 2: {}, 3: None}
