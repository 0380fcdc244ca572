"""The model graph: every model of the project as a lazy DataFrame.

``Models(raw)`` wires the staging, intermediate, mart and insight functions
together the way the reference's ``ref()`` calls do.  Nothing runs until an
action; each attribute is built once per ``Models`` object.  Upstream models
can be replaced by stored tables (``Models(raw, overrides={...})``), which is
how :mod:`funnelworks.plans.build` makes downstream marts read the written
funnel instead of recomputing it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from funnelworks.config import DEFAULT, Assumptions
from funnelworks.operators.frames import HOT_KEY_ROWS
from funnelworks.plans import insights, intermediate, marts, staging
from funnelworks.sources.fixtures import RawSources

STAGING = ["stg_leads", "stg_opportunities", "stg_expenses_advertising", "stg_expenses_salary"]
INTERMEDIATE = ["int_lead_opportunity_joined", "int_monthly_expenses"]
MARTS = [
    "fct_lead_funnel",
    "fct_account_ltv",
    "fct_channel_economics",
    "fct_funnel_stage_conversion",
    "fct_loss_reason_analysis",
    "fct_activity_efficiency",
    "fct_unit_economics",
]
ANALYSES = ["speed_to_lead", "predicted_sales_tier"]


class Models:
    def __init__(
        self,
        raw: RawSources,
        assumptions: Assumptions = DEFAULT,
        join_strategy: str = "split",
        overrides: dict[str, DataFrame] | None = None,
        hot_key_rows: int | None = HOT_KEY_ROWS,
    ):
        self.raw = raw
        self.a = assumptions
        self.join_strategy = join_strategy
        self.hot_key_rows = hot_key_rows
        self._overrides = dict(overrides or {})

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def with_overrides(self, **tables: DataFrame) -> "Models":
        """Same inputs and settings, with some models replaced by given frames
        (typically stored tables)."""
        return Models(
            self.raw, self.a, self.join_strategy, {**self._overrides, **tables}, self.hot_key_rows
        )

    def _get(self, name: str, build) -> DataFrame:
        return self._overrides[name] if name in self._overrides else build()

    # staging -----------------------------------------------------------
    @cached_property
    def stg_leads(self) -> DataFrame:
        return self._get("stg_leads", lambda: staging.stg_leads(self.raw.leads, self.a))

    @cached_property
    def stg_opportunities(self) -> DataFrame:
        return self._get("stg_opportunities", lambda: staging.stg_opportunities(self.raw.opportunities, self.a))

    @cached_property
    def stg_expenses_advertising(self) -> DataFrame:
        return self._get(
            "stg_expenses_advertising",
            lambda: staging.stg_expenses_advertising(self.raw.expenses_advertising, self.a),
        )

    @cached_property
    def stg_expenses_salary(self) -> DataFrame:
        return self._get(
            "stg_expenses_salary", lambda: staging.stg_expenses_salary(self.raw.expenses_salary, self.a)
        )

    # intermediate ------------------------------------------------------
    @cached_property
    def int_lead_opportunity_joined(self) -> DataFrame:
        return self._get(
            "int_lead_opportunity_joined",
            lambda: intermediate.lead_opportunity_joined(
                self.stg_leads, self.stg_opportunities, self.a, self.join_strategy, self.hot_key_rows
            ),
        )

    @cached_property
    def int_monthly_expenses(self) -> DataFrame:
        return self._get(
            "int_monthly_expenses",
            lambda: intermediate.monthly_expenses(self.stg_expenses_advertising, self.stg_expenses_salary, self.a),
        )

    # marts -------------------------------------------------------------
    @cached_property
    def fct_lead_funnel(self) -> DataFrame:
        return self._get("fct_lead_funnel", lambda: marts.lead_funnel(self.int_lead_opportunity_joined, self.a))

    @cached_property
    def funnel_rollup(self) -> DataFrame:
        """Counts and sums behind four of the marts; no model of its own."""
        return self._get("funnel_rollup", lambda: marts.funnel_rollup(self.fct_lead_funnel))

    def over_rollup(self) -> "Models":
        """The same models, with the marts that can be added up from
        ``funnel_rollup`` read from it.  Pays when the rollup is stored."""
        q, rollup = marts.rollup_measures(), self.funnel_rollup
        return self.with_overrides(
            fct_channel_economics=marts.channel_economics(rollup, self.int_monthly_expenses, self.a, q),
            fct_funnel_stage_conversion=marts.funnel_stage_conversion(rollup, q),
            fct_loss_reason_analysis=marts.loss_reason_analysis(rollup, q),
            fct_activity_efficiency=marts.activity_efficiency(rollup, q),
        )

    @cached_property
    def fct_account_ltv(self) -> DataFrame:
        return self._get("fct_account_ltv", lambda: marts.account_ltv(self.fct_lead_funnel))

    @cached_property
    def fct_channel_economics(self) -> DataFrame:
        return self._get(
            "fct_channel_economics",
            lambda: marts.channel_economics(self.fct_lead_funnel, self.int_monthly_expenses, self.a),
        )

    @cached_property
    def fct_funnel_stage_conversion(self) -> DataFrame:
        return self._get("fct_funnel_stage_conversion", lambda: marts.funnel_stage_conversion(self.fct_lead_funnel))

    @cached_property
    def fct_loss_reason_analysis(self) -> DataFrame:
        return self._get("fct_loss_reason_analysis", lambda: marts.loss_reason_analysis(self.fct_lead_funnel))

    @cached_property
    def fct_activity_efficiency(self) -> DataFrame:
        return self._get("fct_activity_efficiency", lambda: marts.activity_efficiency(self.fct_lead_funnel))

    @cached_property
    def fct_unit_economics(self) -> DataFrame:
        return self._get(
            "fct_unit_economics",
            lambda: marts.unit_economics(self.fct_channel_economics, self.fct_account_ltv),
        )

    # analyses ----------------------------------------------------------
    @cached_property
    def speed_to_lead(self) -> DataFrame:
        return insights.speed_to_lead(self.fct_lead_funnel)

    @cached_property
    def predicted_sales_tier(self) -> DataFrame:
        return insights.predicted_sales_tier(self.fct_lead_funnel)
