"""Small fixed dimensions: positions, formations, malus, weights, freshness tiers, coefficients.

Fixed values: all tables here must equal the game's rules and the published model.
"""

from __future__ import annotations

POSITION_GROUP = {"GK": "GK", "RB": "DEF", "CB": "DEF", "LB": "DEF", "WB": "DEF", "DM": "MID", "CM": "MID", "W": "MID", "AM": "MID", "FW": "FWD", "ST": "FWD"}
GROUP_ORDER = {"GK": 0, "DEF": 1, "MID": 2, "FWD": 3}

#: Outfield slots of each formation; a slot lists the native positions it takes.
FORMATIONS = {
    "3-4-3": "CB CB CB WB DM/CM CM WB W/FW FW/ST W/FW",
    "3-4-1-2": "CB CB CB WB DM/CM CM WB AM FW/ST FW/ST",
    "3-4-2-1": "CB CB CB WB/W DM DM/CM WB AM AM/FW FW/ST",
    "3-5-2": "CB CB CB WB/W DM DM/CM CM WB FW/ST FW/ST",
    "3-5-1-1": "CB CB CB DM DM CM WB/W AM/FW WB/W FW/ST",
    "4-3-3": "RB CB CB LB DM/CM CM DM W/FW FW/ST W/FW",
    "4-3-1-2": "RB CB CB LB DM/CM DM CM AM FW/ST FW/ST",
    "4-4-2": "RB CB CB LB WB/W DM/CM CM WB FW/ST FW/ST",
    "4-1-4-1": "RB CB CB LB DM WB/W CM/AM AM W FW/ST",
    "4-4-1-1": "RB CB CB LB WB/W DM CM WB/W AM/FW FW/ST",
    "4-2-3-1": "RB CB CB LB DM DM/CM W/AM AM W/FW FW/ST",
    "4-3-2-1": "RB CB CB LB DM/CM DM CM AM/FW FW/ST AM/FW",
}
SLOTS = {name: [s.split("/") for s in text.split()] for name, text in FORMATIONS.items()}

#: Malus of a native position in a slot; pairs not listed don't fit.
MALUS = {
    "GK": {"GK": 0.0},
    "LB": {"LB": 0.0, "RB": -1.5, "CB": -1.5, "WB": -3.0},
    "RB": {"RB": 0.0, "LB": -1.5, "CB": -1.5, "WB": -3.0},
    "CB": {"CB": 0.0, "LB": -1.5, "RB": -1.5, "DM": -3.0},
    "WB": {"WB": 0.0, "LB": -3.0, "RB": -3.0, "DM": -1.5, "CM": -1.5},
    "DM": {"DM": 0.0, "CM": -1.5, "WB": -3.0, "CB": -3.0},
    "CM": {"CM": 0.0, "DM": -1.5, "AM": -3.0},
    "AM": {"AM": 0.0, "CM": -3.0, "W": -3.0, "FW": -3.0},
    "W": {"W": 0.0, "AM": -1.5, "FW": -3.0},
    "FW": {"FW": 0.0, "W": -3.0, "AM": -3.0, "ST": -1.5},
    "ST": {"ST": 0.0, "FW": -1.5, "W": -3.0},
}
BACK_LINE = ("RB", "CB", "LB")

UNITS_PER_POINT = 15.0
REPLACEMENT = 5.0
START = {"intercept": -2.46, "share": 3.67, "avg_minutes": 0.89, "unknown": 0.5, "suggested_blend": 0.4}
WEIGHT_NAMES = "intercept rating win_prob opp_win_prob draw_prob xg_goal_bonus assist chance_created big_chance cs_win cs_opp_win".split()
WEIGHTS = {
    "GK": (6.465, 0.03, 1.03, -1.33, 1.906, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "DEF": (6.735, 0.058, 0.518, -0.578, 0.6, 0.42, 0.0, 0.168, 0.166, 0.482, -0.475),
    "MID": (6.202, 0.144, 0.995, -0.796, -0.726, 0.549, 0.095, 0.16, 0.181, 0.0, 0.0),
    "FWD": (6.275, 0.169, 1.149, -0.901, -1.115, 0.39, 0.0, 0.126, 0.201, 0.0, 0.0),
}
WIN_BY_DIFFICULTY = {1: 0.244, 2: 0.348, 3: 0.411, 4: 0.448, 5: 0.503}
LOSS_BY_DIFFICULTY = {1: 0.587, 2: 0.455, 3: 0.381, 4: 0.342, 5: 0.296}
DEFAULT_DRAW = 0.28
PRIOR_SEASON_GAMES = 34

#: Elo and form of the strength model, and its softmax of home win, draw, away win.
ELO_STEP, HOME_ELO, SEASON_KEEP, FORM_HALF_LIFE, DEFAULT_MU, MU_WINDOW = 18.0, 55.0, 0.7, 8.0, 1.35, 400
STRENGTH_INTERCEPT = (0.01872, 0.19235, -0.21108)
STRENGTH_COEF = ((0.00268, 0.80874, 0.01737), (9e-05, -0.07452, -0.12172), (-0.00276, -0.73422, 0.10435))

#: Leagues: name, country, country code, and the id of the tournament that goes with it.
LEAGUES = {
    47: ("Premier League", "England", "GB-ENG", 2),
    55: ("Serie A", "Italy", "IT", 1),
    40: ("First Division A", "Belgium", "BE", 13),
    441: ("Ukrainian Premier League", "Ukraine", "UA", 15),
    87: ("LaLiga", "Spain", "ES", 5),
}

_H, _D = 3_600_000, 86_400_000
#: Freshness tiers: milliseconds fresh, milliseconds stale.
TIERS = {
    "teams": (24 * _H, 7 * _D), "players": (2 * _H, 24 * _H), "ratings": (2 * _H, 24 * _H), "odds": (15 * 60_000, 2 * _H), "season": (24 * _H, 30 * _D),
    "fixtures": (30 * 60_000, 6 * _H), "injuries": (2 * _H, 12 * _H), "positions": (_H, 24 * _H), "player_team": (6 * _H, 24 * _H), "cards": (7 * _D, 30 * _D),
}
FORCE_EVERY_MS = 30_000

#: Stat lists of the season feed: list name, column, whether its total is the sub-value.
STAT_LISTS = (
    ("goals", "goals", False), ("goal_assist", "assists", False), ("mins_played", "minutes_played", False), ("expected_goals", "expected_goals", False),
    ("ontarget_scoring_att", "shots", True), ("total_att_assist", "chances_created", False), ("big_chance_created", "big_chances_created", True),
    ("big_chance_missed", "big_chances_missed", True), ("total_tackle", "tackles", True), ("interception", "interceptions", True),
    ("effective_clearance", "clearances", True), ("outfielder_block", "blocked_shots", True), ("poss_won_att_3rd", "possession_won_final_3rd", True),
    ("clean_sheet", "clean_sheets", False), ("_save_percentage", "save_percentage", False), ("saves", "saves", True), ("_goals_prevented", "goals_prevented", False),
    ("goals_conceded", "goals_conceded", True), ("fouls", "fouls_committed", True),
)
YELLOW_BAN = 5
