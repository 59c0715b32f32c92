"""Column expressions over names, statuses and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generational suffixes of names.
SUFFIXES = "jr|sr|ii|iii|iv|v"
# Wording of reports to one vocabulary.
GAME_STATUS = {"out": "Out", "o": "Out", "ir": "Out", "pup": "Out", "sus": "Out", "inactive": "Out", "doubtful": "Doubtful", "d": "Doubtful", "questionable": "Questionable", "q": "Questionable"}


def normal_name(name: Column) -> Column:
    """One spelling of a name for matching: no apostrophes or suffixes, leading initials joined, accents kept."""
    s = F.lower(F.trim(name))
    s = F.regexp_replace(s, "['`’]", "")
    s = F.trim(F.regexp_replace(s, r"[.\-,\s]+", " "))
    s = F.regexp_replace(s, rf"^((?:.*? )?.*?)(?: (?:{SUFFIXES}))+$", "$1")
    return F.regexp_replace(s, r"^(\p{L}) (\p{L})(?= |$)", "$1$2")


def game_status(raw: Column) -> Column:
    """Out, Doubtful or Questionable; other words unchanged, null and blank null."""
    low = F.lower(F.trim(raw))
    known = F.create_map(*[F.lit(x) for pair in GAME_STATUS.items() for x in pair])[low]
    return F.when(low != "", F.coalesce(known, F.trim(raw)))


def practice_status(raw: Column) -> Column:
    """DNP, LP or FP by the words that stand in a report; null where none does."""
    low = F.lower(raw)
    return F.when(low.rlike("did not|dnp"), "DNP").when(low.rlike("limited|\\blp\\b"), "LP").when(low.rlike("full|\\bfp\\b"), "FP")


def price_text(price: Column) -> Column:
    return F.when(price > 0, F.concat(F.lit("+"), price.cast("string"))).otherwise(price.cast("string"))


def side_label(market: Column, side: Column, line: Column, home: Column, away: Column) -> Column:
    """The bet in words."""
    team = F.when(side == "home", home).when(side == "away", away)
    number = F.regexp_replace(F.format_number(F.abs(line), 1), r"\.0$", "")
    signed = F.when(line > 0, F.concat(F.lit("+"), number)).when(line < 0, F.concat(F.lit("-"), number)).otherwise(F.lit("PK"))
    return F.when(market.startswith("h2h"), F.concat_ws(" ", team, F.lit("to win"))).when(team.isNotNull(), F.concat_ws(" ", team, signed)).otherwise(F.concat_ws(" ", F.initcap(side), number))


def content_tokens(text: Column) -> Column:
    """Distinct lower-case words of four letters or digits and more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]{4,}"), 0))


def grounded(claim: Column, evidence: Column) -> Column:
    """True if a claim shares a word with its evidence."""
    return F.size(F.array_intersect(content_tokens(claim), content_tokens(evidence))) > 0
