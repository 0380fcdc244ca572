"""Business constants of the go-to-market models, in one frozen object.

Every pipeline takes an optional ``Assumptions``; the defaults reproduce the
reference models exactly.  Change a value by building a new object
(``dataclasses.replace(DEFAULT, ltv_months=36)``), never by mutation.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# ---------------------------------------------------------------------------
# These must equal the reference for results to match.
#   monthly subscription price ........ 500.0 (per account per month)
#   transaction take rate ............. 0.05 of predicted monthly sales
#   LTV horizon ....................... 24 months
#   year offset of raw dates .......... 2000 years (0024-05-01 means 2024-05-01)
#   currency text cleanup ............. remove 'US$', then remove ' ', U+00A0 and
#                                       TAB, then turn ',' into '.'; parse as
#                                       decimal(38, 2) or null
#   expense month text format ......... 'Mon-YY' (Spark pattern 'MMM-yy')
#   channels .......................... 'inbound' (has a form submission), 'outbound'
#   stage categories .................. 'closed_won' (name ilike '%closed won%'),
#                                       'closed_lost' (ilike '%closed lost%'), 'open'
#   funnel stages, first match wins ... closed_won, closed_lost, opportunity_open,
#                                       meeting_booked, contacted, new_lead
#   missing loss reason label ......... 'Unknown / Not Specified'
#   speed-to-lead buckets (days) ...... <= 0 'same_day', = 1 'next_day',
#                                       2..7 '2_to_7_days', else '8_plus_days'
#   predicted sales tiers ............. null 'unknown', < 5000 'tier_1_under_5k',
#                                       < 15000 'tier_2_5k_to_15k',
#                                       < 30000 'tier_3_15k_to_30k', else 'tier_4_30k_plus'
#   reconciliation tolerance .......... 0.01
# ---------------------------------------------------------------------------

INBOUND = "inbound"
OUTBOUND = "outbound"
CHANNELS = (INBOUND, OUTBOUND)

CLOSED_WON = "closed_won"
CLOSED_LOST = "closed_lost"
OPEN = "open"
STAGE_CATEGORIES = (CLOSED_WON, CLOSED_LOST, OPEN)

FUNNEL_STAGES = (
    "new_lead",
    "contacted",
    "meeting_booked",
    "opportunity_open",
    "closed_won",
    "closed_lost",
)

UNKNOWN_LOSS_REASON = "Unknown / Not Specified"

SPEED_BUCKETS = ("same_day", "next_day", "2_to_7_days", "8_plus_days")
SALES_TIER_UNKNOWN = "unknown"
SALES_TIER_LABELS = (
    "tier_1_under_5k",
    "tier_2_5k_to_15k",
    "tier_3_15k_to_30k",
    "tier_4_30k_plus",
)
SALES_TIER_EDGES = (5000, 15000, 30000)

CURRENCY_PREFIX = "US$"
CURRENCY_DROP_CHARS = (" ", "\u00a0", "\t")
CURRENCY_DECIMAL_COMMA = ","
MONTH_TEXT_FORMAT = "MMM-yy"


@dataclass(frozen=True)
class Assumptions:
    """Knobs of the revenue and LTV model (defaults = the reference)."""

    monthly_subscription: Decimal = Decimal("500.0")
    take_rate: Decimal = Decimal("0.05")
    ltv_months: int = 24
    year_offset: int = 2000
    reconcile_tolerance: Decimal = Decimal("0.01")
    currency_precision: int = 38
    currency_scale: int = 2
    # Money produced by arithmetic on parsed currency keeps 4 decimals
    # (decimal(38,2) * 0.05 needs scale 4); fixed so both engines agree.
    money_precision: int = 38
    money_scale: int = 4

    @property
    def money_type(self) -> str:
        return f"decimal({self.money_precision},{self.money_scale})"

    @property
    def currency_type(self) -> str:
        return f"decimal({self.currency_precision},{self.currency_scale})"


DEFAULT = Assumptions()
