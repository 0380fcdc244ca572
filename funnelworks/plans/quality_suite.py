"""The project's 40 declared data tests as one Spark job (P16).

``run_checks(models)`` returns one row per test: model, test, column_name,
violations.  Declared expectations that the models knowingly violate (the
source ``form_submission_date`` is null for every outbound lead, the source
opportunity ids carry duplicates that staging removes, leads without any
date have no created date) are reported as counts, not raised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from funnelworks import config
from funnelworks.operators import quality as Q
from funnelworks.plans.project import Models

CHANNELS = list(config.CHANNELS)


def _union(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of many frames as a balanced tree: each union is analyzed
    once over its inputs, so planning grows n log n instead of n squared."""
    frames = list(frames)
    while len(frames) > 1:
        frames = [
            frames[i].unionByName(frames[i + 1]) if i + 1 < len(frames) else frames[i]
            for i in range(0, len(frames), 2)
        ]
    return frames[0]


def unique_checks(m: Models) -> list[DataFrame]:
    return [
        Q.unique_check(m.raw.leads, "leads", "lead_id"),
        Q.unique_check(m.raw.opportunities, "opportunities", "opportunity_id"),
        Q.unique_check(m.stg_leads, "stg_leads", "lead_id"),
        Q.unique_check(m.stg_opportunities, "stg_opportunities", "opportunity_id"),
        Q.unique_check(m.int_lead_opportunity_joined, "int_lead_opportunity_joined", "lead_id"),
        Q.unique_check(m.fct_lead_funnel, "fct_lead_funnel", "lead_id"),
    ]


#: (model, its frame, not_null columns, accepted_values) of every tested model.
PROFILES = [
    ("leads", lambda m: m.raw.leads, ["lead_id", "form_submission_date"], {}),
    ("opportunities", lambda m: m.raw.opportunities, ["opportunity_id"], {}),
    ("stg_leads", lambda m: m.stg_leads, ["lead_id", "lead_created_date"], {"channel": CHANNELS}),
    (
        "stg_opportunities",
        lambda m: m.stg_opportunities,
        ["opportunity_id"],
        {"stage_category": list(config.STAGE_CATEGORIES)},
    ),
    ("stg_expenses_advertising", lambda m: m.stg_expenses_advertising, ["expense_month"], {}),
    ("stg_expenses_salary", lambda m: m.stg_expenses_salary, ["expense_month"], {}),
    ("int_lead_opportunity_joined", lambda m: m.int_lead_opportunity_joined, ["lead_id"], {"channel": CHANNELS}),
    (
        "int_monthly_expenses",
        lambda m: m.int_monthly_expenses,
        ["expense_month", "channel", "total_cost", "advertising_cost", "people_cost"],
        {"channel": CHANNELS},
    ),
    (
        "fct_lead_funnel",
        lambda m: m.fct_lead_funnel,
        ["lead_id"],
        {"channel": CHANNELS, "current_funnel_stage": list(config.FUNNEL_STAGES)},
    ),
    ("fct_account_ltv", lambda m: m.fct_account_ltv, ["account_id"], {"channel": CHANNELS}),
    ("fct_channel_economics", lambda m: m.fct_channel_economics, ["lead_created_month"], {"channel": CHANNELS}),
    (
        "fct_funnel_stage_conversion",
        lambda m: m.fct_funnel_stage_conversion,
        ["lead_created_month"],
        {"channel": CHANNELS},
    ),
    ("fct_unit_economics", lambda m: m.fct_unit_economics, ["lead_created_month"], {"channel": CHANNELS}),
]


def observed(name: str, df: DataFrame) -> Q.Profile | None:
    """The not_null and accepted_values checks of model ``name``, to be counted
    while ``df``, its rows, are written; None if it has none."""
    for model, _, not_null, accepted in PROFILES:
        if model == name:
            return Q.observed_profile(df, model, not_null, accepted)
    return None


def written(
    name: str, df: DataFrame, write: Callable[[DataFrame], DataFrame], summaries: dict[str, DataFrame]
) -> DataFrame:
    """Write model ``name`` by ``write``, which returns the stored rows.  Its
    not_null and accepted_values checks are counted on the way, and their
    summary goes to ``summaries``, for :func:`run_checks`."""
    profile = observed(name, df)
    if profile is None:
        return write(df)
    table = write(profile.df)
    summaries[name] = profile.summary(table)
    return table


def _profiles(
    m: Models, not_null: bool, accepted: bool, done: dict[str, DataFrame] | None = None
) -> list[DataFrame]:
    """Summaries of the models' profiles; ``done``: those known already."""
    done, out = done or {}, []
    for model, frame, nn, acc in PROFILES:
        nn = nn if not_null else []
        acc = acc if accepted else {}
        if model in done:
            out.append(done[model])
        elif nn or acc:
            out.append(Q.profile_checks(frame(m), model, not_null=nn, accepted=acc))
    return out


def not_null_checks(m: Models) -> list[DataFrame]:
    return _profiles(m, not_null=True, accepted=False)


def accepted_values_checks(m: Models) -> list[DataFrame]:
    return _profiles(m, not_null=False, accepted=True)


def relationship_checks(m: Models) -> list[DataFrame]:
    return [
        Q.relationship_check(
            m.int_lead_opportunity_joined, "int_lead_opportunity_joined", "opportunity_id",
            m.stg_opportunities, "opportunity_id",
        )
    ]


def unique_combination_checks(m: Models) -> list[DataFrame]:
    return [Q.unique_combination_check(m.int_monthly_expenses, "int_monthly_expenses", ["expense_month", "channel"])]


def reconcile_advertising(m: Models) -> DataFrame:
    return Q.reconcile(
        m.stg_expenses_advertising, "advertising_spend", m.int_monthly_expenses, "advertising_cost",
        tolerance=m.a.reconcile_tolerance, name="assert_advertising_spend_matches_source",
    )


def reconcile_inbound(m: Models) -> DataFrame:
    return Q.reconcile(
        m.stg_expenses_salary, "inbound_team_cost", m.int_monthly_expenses, "people_cost",
        where=f"channel = '{config.INBOUND}'",
        tolerance=m.a.reconcile_tolerance, name="assert_inbound_salary_matches_source",
    )


def reconcile_outbound(m: Models) -> DataFrame:
    return Q.reconcile(
        m.stg_expenses_salary, "outbound_team_cost", m.int_monthly_expenses, "people_cost",
        where=f"channel = '{config.OUTBOUND}'",
        tolerance=m.a.reconcile_tolerance, name="assert_outbound_salary_matches_source",
    )


def reconcile_checks(m: Models) -> list[DataFrame]:
    return [
        Q.reconcile_summary(reconcile_advertising(m), "int_monthly_expenses", "advertising_cost"),
        Q.reconcile_summary(reconcile_inbound(m), "int_monthly_expenses", "people_cost"),
        Q.reconcile_summary(reconcile_outbound(m), "int_monthly_expenses", "people_cost"),
    ]


def run_checks(m: Models, done: dict[str, DataFrame] | None = None) -> DataFrame:
    """All 40 declared tests: one summary row each.  ``done``: summaries of the
    not_null and accepted_values checks of models that were counted while
    their tables were written (:func:`observed`)."""
    return _union(
        unique_checks(m)
        + _profiles(m, not_null=True, accepted=True, done=done)
        + relationship_checks(m)
        + unique_combination_checks(m)
        + reconcile_checks(m)
    )


def union_checks(frames: list[DataFrame]) -> DataFrame:
    return _union(frames)
