"""All registered queries of the market and research operators."""

from __future__ import annotations

from . import board, ledger, market, matrix, practice, research, review, serving


def queries() -> dict:
    return market.QUERIES | research.QUERIES | serving.QUERIES | board.QUERIES | review.QUERIES | ledger.QUERIES | matrix.QUERIES | practice.QUERIES


def oracle_sql() -> dict[str, str]:
    return market.ORACLES | research.ORACLES | serving.ORACLES | board.ORACLES | review.ORACLES | ledger.ORACLES | matrix.ORACLES | practice.ORACLES
