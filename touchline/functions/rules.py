"""Game rules as column expressions: bonuses, tiers, match context, start chance, expected points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import dims


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding of halves upwards, as in the application's displays."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def lookup(key: Column, table: dict, default=None) -> Column:
    """CASE over a small fixed table."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def has_any(positions: Column, *names: str) -> Column:
    return F.arrays_overlap(positions, F.array(*map(F.lit, names)))


def goal_bonus(positions: Column) -> Column:
    return F.when(has_any(positions, "ST", "FW"), 2.0).when(has_any(positions, "AM", "W"), 2.5).otherwise(3.0)


def _clean_sheet(p: Column) -> Column:
    return F.when(p == "GK", 1.5).when(p.isin("RB", "CB", "LB"), 1.0).when(p.isin("WB", "DM"), 0.5).otherwise(0.0)


def cs_bonus_primary(positions: Column) -> Column:
    """By the first position, as line-ups are scored."""
    return _clean_sheet(F.get(positions, F.lit(0)))


def cs_bonus_best(positions: Column) -> Column:
    """The best of all positions, as ground truth is counted."""
    return F.coalesce(F.array_max(F.transform(positions, _clean_sheet)), F.lit(0.0))


def implied(odds: Column) -> Column:
    return F.when(odds > 1, 1 / odds)


def difficulty(opp_pos: Column, teams: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(opp_pos / teams * 5)))


def match_context(own: Column, opp: Column, draw: Column, model: tuple[Column, Column, Column], diff: Column) -> tuple[Column, Column, Column]:
    """(win, opponent's win, draw): odds, else the strength model, else the average at this difficulty."""
    d = F.least(F.lit(5), F.greatest(F.lit(1), half_up(F.coalesce(diff, F.lit(3)).cast("double"))))
    return (
        F.coalesce(implied(own), model[0], lookup(d, dims.WIN_BY_DIFFICULTY)),
        F.coalesce(implied(opp), model[2], lookup(d, dims.LOSS_BY_DIFFICULTY)),
        F.coalesce(implied(draw), model[1], F.lit(dims.DEFAULT_DRAW)),
    )


def confidence(played: Column) -> Column:
    return F.least(F.lit(1.0), played / F.lit(4.0))


def blend(current: Column, prior: Column, weight: Column) -> Column:
    """Weighted mean of two values; either alone where the other is null."""
    return F.when(current.isNull(), prior).when(prior.isNull(), current).otherwise(current * weight + prior * (1 - weight))


def rate(total: Column, played: Column) -> Column:
    return F.when((played > 0) & total.isNotNull(), F.try_divide(total.cast("double"), played.cast("double")))


def per_match(cur: Column, prior: Column, played: Column, prior_played: Column) -> Column:
    return F.coalesce(blend(rate(cur, played), rate(prior, prior_played), confidence(played)), F.lit(0.0))


def start_chance(played: Column, minutes: Column, prior_played: Column, prior_minutes: Column, round_: Column) -> Column:
    """Chance of starting from this and last season's share of minutes."""
    team = F.greatest(played, F.coalesce(round_ - 1, F.lit(0)))
    now = F.when(team > 0, F.least(F.lit(1.0), F.try_divide(minutes.cast("double"), team * 90.0)))
    last = F.when(prior_minutes > 0, F.least(F.lit(1.0), prior_minutes / F.lit(dims.PRIOR_SEASON_GAMES * 90.0)))
    share = F.coalesce(blend(now, last, F.least(F.lit(1.0), team / F.lit(6.0))), F.lit(0.0))
    average = lambda m, n: F.when((n > 0) & (m > 0), F.try_divide(m.cast("double"), n.cast("double")))
    mean = F.coalesce(blend(average(minutes, played), average(prior_minutes, prior_played), confidence(played)), F.lit(0.0))
    s = dims.START
    z = s["intercept"] + s["share"] * share + s["avg_minutes"] * mean / 90.0
    none = (played == 0) & (prior_played == 0) & (minutes == 0) & (prior_minutes == 0)
    return F.when(none, s["unknown"]).otherwise(1 / (1 + F.exp(-z)))


def chosen_start(model: Column, pct: Column, source: Column, has_fixture: Column) -> Column:
    """A set percentage, mixed with the model where it was only suggested; none without a fixture."""
    b = dims.START["suggested_blend"]
    set_ = F.when(source == "suggested", (1 - b) * pct / 100.0 + b * model).otherwise(pct / 100.0)
    return F.when(~has_fixture, 0.0).when(pct.isNull(), model).otherwise(set_)


def weight(group: Column, name: str) -> Column:
    i = dims.WEIGHT_NAMES.index(name)
    return lookup(group, {g: w[i] for g, w in dims.WEIGHTS.items()}, dims.WEIGHTS["MID"][i])


def expected_points(group: Column, rating: Column, context: tuple[Column, Column, Column], cs: Column, goal: Column, xg: Column, assists: Column, chances: Column, big: Column) -> dict[str, Column]:
    """quality, context, attack and their sum with the intercept."""
    w = lambda name: weight(group, name)
    win, loss, draw = context
    quality = w("rating") * (rating - 6.0)
    ctx = w("win_prob") * win + w("opp_win_prob") * loss + w("draw_prob") * draw + cs * (w("cs_win") * win + w("cs_opp_win") * loss)
    attack = w("xg_goal_bonus") * xg * goal + w("assist") * assists + w("chance_created") * chances + w("big_chance") * big
    return {"quality": quality, "context": ctx, "attack": attack, "expected": w("intercept") + w("rating") * 6.0 + quality + ctx + attack}


def total_score(start: Column, expected: Column, blocked: Column) -> Column:
    return F.when(blocked, -999.0).otherwise(F.greatest(F.lit(0.0), dims.UNITS_PER_POINT * start * (expected - dims.REPLACEMENT)))


def effective(total: Column, malus: Column, start: Column) -> Column:
    return F.when(malus == 0, total).otherwise(F.greatest(F.lit(0.0), total + malus * dims.UNITS_PER_POINT * start))


def defence_bonus(mean: Column) -> Column:
    return F.when(mean < 7, 0).otherwise(F.least(F.lit(5), F.floor((mean - 7) / 0.25 + 1e-9) + 1)).cast("long")


def score_tier(total: Column) -> Column:
    return F.when(total >= 31, "top").when(total >= 18, "good").when(total >= 6, "fair").otherwise("low")


def rating_tier(r: Column) -> Column:
    return F.when(r >= 8, "A").when(r >= 7.5, "B").when(r >= 7, "C").when(r >= 6.5, "D").otherwise("E")


def points(c: dict[str, Column]) -> Column:
    """Ground-truth points of an appearance; null if not played.

    Keys: rating, goals, pens, assists, won, conceded, missed, saved, own, red, second, yellow, gk, saves, ga_on, ga, minutes, goal_bonus, cs_bonus.
    """
    z = lambda name: F.coalesce(c[name], F.lit(0))
    sent = (z("red") == 1) | (z("second") == 1)
    base = F.coalesce(c["rating"], F.lit(6.0))
    out = base + F.greatest(F.lit(0), z("goals") - z("pens")) * c["goal_bonus"] + z("pens") * 2 + z("assists")
    out = out + z("won") - z("conceded") - z("missed") * 2 + z("saved") * 3 - z("own") * 2
    out = out - F.when(sent, F.when(c["gk"], 3.0).otherwise(2.0)).when(z("yellow") == 1, 0.5).otherwise(0.0)
    keeper = F.when(z("saves") >= 6, 1.0).when(z("saves") >= 3, 0.5).otherwise(0.0) - z("ga_on")
    clean = (c["minutes"] >= 60) & (z("ga_on") == 0) & (~sent | (z("ga") == 0))
    out = out + F.when(c["gk"], keeper).otherwise(0.0) + F.when(clean, c["cs_bonus"]).otherwise(0.0)
    return F.when(c["minutes"] > 0, out)


def log_loss(p: Column) -> Column:
    return -F.ln(F.greatest(F.lit(1e-9), p))


def softmax3(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    top = F.greatest(a, b, c)
    ea, eb, ec = F.exp(a - top), F.exp(b - top), F.exp(c - top)
    return ea / (ea + eb + ec), eb / (ea + eb + ec), ec / (ea + eb + ec)


def strength(elo_diff: Column, lam_h: Column, lam_a: Column) -> tuple[Column, Column, Column]:
    x = (elo_diff, lam_h - lam_a, lam_h + lam_a)
    logit = [F.lit(b) + sum((F.lit(w) * v for w, v in zip(ws, x, strict=True)), F.lit(0.0)) for b, ws in zip(dims.STRENGTH_INTERCEPT, dims.STRENGTH_COEF, strict=True)]
    return softmax3(*logit)


def season_rating(current: Column, prior: Column, played: Column) -> Column:
    """This season's rating blended with the last one's by matches played; 6 without either."""
    return F.coalesce(blend(current, prior, confidence(played)), F.lit(6.0))


def form_rating(season: Column, form: Column) -> Column:
    """Six tenths season and four tenths recent form, where there is any."""
    return F.coalesce(season * 0.6 + form * 0.4, season)


def logit(p: Column, edge: float = 1e-9) -> Column:
    q = F.least(F.lit(1 - edge), F.greatest(F.lit(edge), p))
    return F.ln(q / (1 - q))


def share_of(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """A part's share of a whole, 1 at most."""
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(part.cast("double"), whole.cast("double"))), F.lit(empty))


def gap_share(gap: Column, most: int = 10) -> Column:
    """How long ago, as a share of ``most``; unknown is longest."""
    return F.least(F.coalesce(gap, F.lit(most)), F.lit(most)) / F.lit(float(most))


def clean_sheet_chance(lam: Column) -> Column:
    return F.exp(-lam)


def to_step(x: Column, step: int = 5) -> Column:
    """To the nearest multiple, halves upwards."""
    return half_up(x / float(step)) * step


def to_even_step(x: Column, step: int = 5) -> Column:
    """To the nearest multiple, halves to even ones."""
    return F.rint(x / float(step)) * step


def axis_share(value: Column, top: float) -> Column:
    """A value on a radar axis."""
    return F.least(F.lit(1.0), value / top)


def age_label(seconds: Column) -> Column:
    """just now, minutes, hours, or days ago."""
    at = lambda size, mark: F.concat(F.floor(seconds / size).cast("string"), F.lit(mark))
    return F.when(seconds < 60, "just now").when(seconds < 3600, at(60, "m ago")).when(seconds < 86400, at(3600, "h ago")).otherwise(at(86400, "d ago"))


def any_stat(*values: Column) -> Column:
    """Whether a card is shown: some value isn't zero."""
    out = F.lit(False)
    for v in values:
        out = out | (F.coalesce(v, F.lit(0)) != 0)
    return out


def suggested_start(starts: Column, minutes: Column) -> Column:
    """From the last five matches, half by starts and half by minutes, in steps of five percent."""
    return to_step((starts / 5.0 * 0.5 + minutes / 450.0 * 0.5) * 100) / 100
