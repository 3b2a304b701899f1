"""Valuation, return, leverage and growth ratios as Spark expressions.

Every ratio is NULL when an input is missing or not finite or a denominator is
zero; nothing is imputed apart from the documented default tax rate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valsieve import settings as S
from valsieve.functions.cleaning import INFINITY, as_col, nan_to_null, safe_div


def compatible_cap(market_cap, consistent) -> Column:
    """Market cap, only where quote and statement currencies agree."""
    return F.when(F.coalesce(as_col(consistent), F.lit(True)), as_col(market_cap))


def pe(market_cap, net_income) -> Column:
    return F.when(nan_to_null(net_income) > 0, safe_div(market_cap, net_income))


def enterprise_value(market_cap, total_debt, cash) -> Column:
    return nan_to_null(market_cap) + nan_to_null(total_debt) - nan_to_null(cash)


def ev_ebit(market_cap, total_debt, cash, ebit) -> Column:
    return F.when(
        nan_to_null(ebit) > 0,
        safe_div(enterprise_value(market_cap, total_debt, cash), ebit),
    )


def fcf_yield(free_cash_flow, market_cap) -> Column:
    return safe_div(free_cash_flow, market_cap)


def invested_capital(total_debt, equity) -> Column:
    """Debt plus equity when positive; cash is deliberately not netted."""
    total = nan_to_null(total_debt) + nan_to_null(equity)
    return F.when(total > 0, total)


def tax_rate(rate) -> Column:
    rate = nan_to_null(rate)
    return F.when(rate.isNull(), F.lit(S.DEFAULT_TAX_RATE)).otherwise(
        F.least(F.greatest(rate, F.lit(0.0)), F.lit(S.MAX_TAX_RATE))
    )


def roic(ebit, total_debt, equity, rate, total_debt_start, equity_start) -> Column:
    """After-tax EBIT over the mean of opening and closing capital."""
    closing = invested_capital(total_debt, equity)
    opening = invested_capital(total_debt_start, equity_start)
    mean_capital = F.coalesce((opening + closing) / 2, closing)
    return safe_div(nan_to_null(ebit) * (1 - tax_rate(rate)), mean_capital)


def operating_margin(ebit, revenue) -> Column:
    return safe_div(ebit, revenue)


def net_debt_ebitda(total_debt, cash, ebitda) -> Column:
    net_debt = nan_to_null(total_debt) - nan_to_null(cash)
    return F.when(
        nan_to_null(ebitda) > 0,
        F.when(net_debt <= 0, F.lit(0.0)).otherwise(safe_div(net_debt, ebitda)),
    )


def interest_coverage(ebit, interest) -> Column:
    """EBIT over absolute interest; no interest at all is +infinity."""
    cost = F.abs(nan_to_null(interest))
    return F.when(
        nan_to_null(ebit).isNotNull(),
        F.when(cost == 0, F.lit(INFINITY)).otherwise(safe_div(ebit, cost)),
    )


def revenue_cagr(start, end, years) -> Column:
    start, end, years = nan_to_null(start), nan_to_null(end), nan_to_null(years)
    growing = F.pow(end / start, F.lit(1.0) / years) - 1
    return F.when(
        (start > 0) & (years > 0),
        F.when(end <= 0, F.lit(-1.0)).otherwise(growing),
    )


def earnings_yield(ev_to_ebit) -> Column:
    return F.try_divide(F.lit(1.0), as_col(ev_to_ebit))


def net_cash_share(cash, total_debt, market_cap) -> Column:
    return safe_div(nan_to_null(cash) - nan_to_null(total_debt), market_cap)


def roic_reliable(value) -> Column:
    """A huge ROIC only says the capital base is tiny."""
    return F.coalesce(nan_to_null(value) <= S.MAX_RELIABLE_ROIC, F.lit(False))


def currency_consistent(quote, statements) -> Column:
    quote, statements = F.upper(F.trim(as_col(quote))), F.upper(F.trim(as_col(statements)))
    return F.coalesce((quote != "") & (quote == statements), F.lit(False))


def comparable_region(country) -> Column:
    country = F.trim(as_col(country))
    chain = None
    for region, countries in S.COMPARABLE_REGIONS.items():
        hit = country.isin(countries)
        chain = F.when(hit, F.lit(region)) if chain is None else chain.when(hit, F.lit(region))
    return chain.otherwise(F.lit(S.OTHER_REGION))


def convert_to_eur(market_cap, rate) -> Column:
    """No rate, no EUR value."""
    return nan_to_null(market_cap) * nan_to_null(rate)


def effective_tax_rate(provision, pretax) -> Column:
    """Provision over pre-tax income; out of range falls back to the default."""
    rate = safe_div(provision, pretax)
    return F.when(rate.between(0.0, S.MAX_TAX_RATE), rate).otherwise(F.lit(S.DEFAULT_TAX_RATE))


