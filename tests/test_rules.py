"""Hand-computed values of the rules and text functions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from touchline import dims
from touchline.functions import rules, text
from touchline.operators import windows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_defence_bonus_tiers(spark):
    df = spark.createDataFrame([(x,) for x in (6.99, 7.0, 7.24, 7.25, 7.5, 7.99, 8.0, 9.0, (6.4 + 8.1 + 7.8 + 7.2) / 4)], "m double")
    assert [r[0] for r in df.select(rules.defence_bonus(F.col("m"))).collect()] == [0, 1, 1, 2, 3, 4, 5, 5, 2]


def test_goal_and_clean_sheet_bonus(spark):
    p = lambda *x: F.array(*map(F.lit, x))
    assert [value(spark, rules.goal_bonus(p(*x))) for x in (("CB",), ("AM", "CM"), ("W",), ("AM", "FW"), ("ST",))] == [3.0, 2.5, 2.5, 2.0, 2.0]
    assert value(spark, rules.cs_bonus_primary(p("WB", "CB"))) == 0.5 and value(spark, rules.cs_bonus_best(p("WB", "CB"))) == 1.0
    assert value(spark, rules.cs_bonus_best(F.array().cast("array<string>"))) == 0.0


def test_context_falls_back_from_odds_to_model_to_difficulty(spark):
    none = F.lit(None).cast("double")
    run = lambda odds, model, d: tuple(value(spark, c) for c in rules.match_context(*odds, model, d))
    assert run((F.lit(2.0), F.lit(4.0), F.lit(1.0)), (none, none, none), F.lit(1)) == (0.5, 0.25, 0.28)
    assert run((none, none, none), (F.lit(0.4), F.lit(0.3), F.lit(0.3)), F.lit(1)) == (0.4, 0.3, 0.3)
    assert run((none, none, none), (none, none, none), none) == (0.411, 0.381, 0.28)


def test_rates_blend_over_the_first_matches(spark):
    assert value(spark, rules.per_match(F.lit(2), F.lit(1), F.lit(2), F.lit(10))) == pytest.approx(1.0 * 0.5 + 0.1 * 0.5)
    assert value(spark, rules.per_match(F.lit(None).cast("int"), F.lit(5), F.lit(0), F.lit(10))) == 0.5
    assert value(spark, rules.per_match(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0), F.lit(0))) == 0.0


def test_start_chance(spark):
    assert value(spark, rules.start_chance(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(3))) == 0.5
    full = 1 / (1 + math.exp(-(-2.46 + 3.67 + 0.89)))
    assert value(spark, rules.start_chance(F.lit(10), F.lit(900), F.lit(0), F.lit(0), F.lit(11))) == pytest.approx(full)
    model = F.lit(0.8)
    assert value(spark, rules.chosen_start(model, F.lit(50.0), F.lit("suggested"), F.lit(True))) == pytest.approx(0.6 * 0.5 + 0.4 * 0.8)
    assert value(spark, rules.chosen_start(model, F.lit(50.0), F.lit("manual"), F.lit(True))) == 0.5
    assert value(spark, rules.chosen_start(model, F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(False))) == 0.0


def test_expected_points_of_each_group(spark):
    for group, w in dims.WEIGHTS.items():
        w = dict(zip(dims.WEIGHT_NAMES, w, strict=True))
        got = rules.expected_points(F.lit(group), F.lit(7.0), (F.lit(0.5), F.lit(0.25), F.lit(0.25)), F.lit(1.0), F.lit(2.0), F.lit(0.3), F.lit(0.2), F.lit(1.5), F.lit(0.4))
        want = w["intercept"] + 7 * w["rating"] + 0.5 * w["win_prob"] + 0.25 * w["opp_win_prob"] + 0.25 * w["draw_prob"] + 0.5 * w["cs_win"] + 0.25 * w["cs_opp_win"]
        want += 0.6 * w["xg_goal_bonus"] + 0.2 * w["assist"] + 1.5 * w["chance_created"] + 0.4 * w["big_chance"]
        assert value(spark, got["expected"]) == pytest.approx(want)
    assert value(spark, rules.total_score(F.lit(0.5), F.lit(7.0), F.lit(False))) == 15.0
    assert value(spark, rules.total_score(F.lit(0.5), F.lit(7.0), F.lit(True))) == -999.0
    assert value(spark, rules.effective(F.lit(20.0), F.lit(-1.5), F.lit(0.5))) == 8.75


def test_points_of_a_keeper_sent_off(spark):
    zero = dict.fromkeys("goals pens assists won conceded missed saved own second yellow".split(), F.lit(0))
    c = zero | {"rating": F.lit(7.0), "red": F.lit(1), "gk": F.lit(True), "saves": F.lit(6), "ga_on": F.lit(0), "ga": F.lit(1), "minutes": F.lit(70), "goal_bonus": F.lit(3.0), "cs_bonus": F.lit(1.5)}
    assert value(spark, rules.points(c)) == 7.0 - 3 + 1
    assert value(spark, rules.points(c | {"red": F.lit(0)})) == 7.0 + 1 + 1.5
    assert value(spark, rules.points(c | {"minutes": F.lit(0)})) is None


def test_names(spark):
    n = text.normal_name
    assert [value(spark, n(F.lit(s))) for s in ("  José-María Ødegaard ", "ÁÉÍ", "x'y", "")] == ["jose maria degaard", "aei", "x y", ""]
    assert value(spark, text.normal_name_compatible(F.lit("ﬁn-Zoë"))) == "fin zoe"
    assert value(spark, text.name_similarity(F.lit("nico paz"), F.lit("nicolas paz"))) == pytest.approx(0.6 + 0.4 * 0.95)
    assert value(spark, text.name_similarity(F.lit("santana alisson"), F.lit("alisson santana"))) == 1.0
    assert value(spark, text.club_similarity(F.lit("polissya zhytomyr"), F.lit("polissya"))) == 0.95
    assert value(spark, text.similarity(F.lit(""), F.lit("a"))) == 0.0


def test_normal_names_of_all_characters_without_python(spark):
    import re
    import sys
    import unicodedata

    every = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    rows = [(i, "x" + "y".join(every[i : i + 500]) + "z\u0301\u0323Q") for i in range(0, len(every), 500)]
    df = spark.createDataFrame([*rows, (-1, None)], "i int, s string").select("i", text.normal_name(F.col("s")).alias("n"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()

    def plain(s):
        s = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", s))
        # lower case of ASCII only: no other character has one that is a letter or digit of ASCII but the dotted I, which is gone
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", "".join(c.lower() if c.isascii() else c for c in s), flags=re.ASCII), flags=re.ASCII).strip(" ")

    got = {r.i: r.n for r in df.collect()}
    assert got.pop(-1) is None
    for i, s in rows:
        assert got[i] == plain(s), i


def test_guessed_positions(spark):
    got = lambda label, group: value(spark, text.guess_positions(F.lit(label), F.lit(group)))
    assert got("Right Wing-Back", "DEF") == ["RB", "WB"] and got("LB", "DEF") == ["LB"] and got("Centre", "DEF") == ["CB"]
    assert got("CDM", "MID") == ["DM"] and got("Left Winger", "MID") == ["W"] and got("x", "MID") == ["CM"]
    assert got("SS", "FWD") == ["FW"] and got("any", "GK") == ["GK"] and got("Striker", "FWD") == ["ST"]


def test_tail_of_a_short_list(spark):
    assert value(spark, windows.tail(F.array(F.lit(1), F.lit(2)), 5)) == [1, 2]
    assert value(spark, windows.tail(F.sequence(F.lit(1), F.lit(9)), 5)) == [5, 6, 7, 8, 9]
    assert value(spark, rules.half_up(F.lit(2.5))) == 3
