"""The taxonomy of market keys: class, period, family, label, filter groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of markets, and labels and families of player markets.
BASE_LABELS = {"h2h": "Moneyline", "spreads": "Spread", "totals": "Total", "team_totals": "Team total", "alternate_spreads": "Alt spread", "alternate_totals": "Alt total"}
PROPS = {
    "player_pass_yds": ("Passing yards", "passing"), "player_pass_tds": ("Passing TDs", "passing"), "player_pass_completions": ("Completions", "passing"), "player_pass_attempts": ("Pass attempts", "passing"),
    "player_pass_interceptions": ("Interceptions", "passing"), "player_pass_longest_completion": ("Longest completion", "passing"), "player_rush_yds": ("Rushing yards", "rushing"), "player_rush_attempts": ("Rush attempts", "rushing"),
    "player_rush_longest": ("Longest rush", "rushing"), "player_reception_yds": ("Receiving yards", "receiving"), "player_receptions": ("Receptions", "receiving"), "player_reception_longest": ("Longest reception", "receiving"),
    "player_rush_reception_yds": ("Rush + rec yards", "rushing"), "player_anytime_td": ("Anytime TD", "touchdown"), "player_1st_td": ("First TD", "touchdown"), "player_last_td": ("Last TD", "touchdown"),
    "player_kicking_points": ("Kicking points", "kicking"), "player_field_goals": ("Field goals", "kicking"), "player_tackles_assists": ("Tackles + assists", "defense"), "player_sacks": ("Sacks", "defense"), "player_defensive_interceptions": ("Def. interceptions", "defense"),
}
ONE_SIDED = ("player_anytime_td", "player_1st_td", "player_last_td")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def describe(key: Column) -> Column:
    """struct<label, bet_class, period, family, two_sided> of a market key; never fails."""
    k = F.coalesce(key, F.lit(""))
    prop = k.startswith("player_")
    suffix = F.regexp_extract(k, r"_(h1|h2|q[1-4])$", 1)
    base = F.when(prop, k).otherwise(F.regexp_replace(k, r"_(h1|h2|q[1-4])$", ""))
    period = F.when(prop | (suffix == ""), "full").when(suffix == "h1", "1H").when(suffix == "h2", "2H").otherwise(F.upper(suffix))
    kind = F.when(prop, "prop").when(base.startswith("alternate_"), "alt").when(base == "team_totals", "team").when(period != "full", "period").otherwise("game")
    spoken = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1000)))
    plain = F.coalesce(_lookup(BASE_LABELS, base), F.when(kind == "alt", base).otherwise(spoken(F.regexp_replace(base, "_", " "))))
    player = F.coalesce(_lookup({p: label for p, (label, _) in PROPS.items()}, k), spoken(F.regexp_replace(F.regexp_replace(k, "player_", ""), "_", " ")))
    label = F.when(k == "", "Unknown").when(prop, player).when(kind == "period", F.concat_ws(" ", period, F.lower(plain))).otherwise(plain)
    family = F.when(prop, _lookup({p: fam for p, (_, fam) in PROPS.items()}, k))
    return F.struct(label.alias("label"), kind.alias("bet_class"), period.alias("period"), family.alias("family"), (~k.isin(*ONE_SIDED)).alias("two_sided"))


def filter_groups(key: Column) -> Column:
    """Names of all overlapping groups that a market belongs to."""
    d = describe(key)
    k = F.coalesce(key, F.lit(""))
    tests = {
        "all": F.lit(True), "moneyline": k.startswith("h2h"), "spread": k.contains("spreads"), "total": k.contains("totals") & (d["bet_class"] != "team"), "team_total": d["bet_class"] == "team",
        "first_half": d["period"] == "1H", "second_half": d["period"] == "2H", "quarters": d["period"].startswith("Q"), "alternates": d["bet_class"] == "alt", "props": d["bet_class"] == "prop",
        **{f: d["family"] == f for f in ("passing", "rushing", "receiving", "touchdown", "kicking")},
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]))
