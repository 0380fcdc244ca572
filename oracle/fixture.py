"""DuckDB CTEs that derive the four raw inputs from ``orders`` (FIXTURES.md section 2).

Written independently of the Spark mapping, from the rule table; column
types are cast to the declared raw schemas.
"""

NB = "chr(160)"
TAB = "chr(9)"


def _ts(days: str, hour: str) -> str:
    return f"(bd + to_days(CAST({days} AS INTEGER)) + to_hours(CAST({hour} AS INTEGER)))"


def _low(d: str) -> str:
    return f"CAST({d} - INTERVAL 24000 MONTH AS DATE)"


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


FIXTURE_CTES = f"""
fx_orders AS (
    SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderkey // 5 AS j,
           CAST(CAST(o_orderdate AS DATE) + INTERVAL 336 MONTH AS DATE) AS bd,
           (o_orderkey * 7919 + o_custkey * 104729) % 4000000 AS cents
    FROM orders
),
raw_leads AS (
    SELECT
        'L' || {_s('k')} AS lead_id,
        CASE WHEN k % 5 = 0 THEN 'O' || {_s('k')} END AS converted_opportunity_id,
        CASE WHEN k % 3 = 0 THEN {_low('bd')} END AS form_submission_date,
        CASE WHEN k % 10 < 7 THEN {_ts('k % 11', 'k % 24')} END AS first_sales_call_date,
        CASE WHEN k % 4 = 1 THEN {_ts('k % 5', 'k % 13')} END AS first_text_sent_date,
        CASE WHEN k % 5 < 2 THEN {_ts('12 + k % 9', '9')} END AS first_meeting_booked_date,
        CASE WHEN k % 10 < 7 THEN {_ts('13 + k % 20', '8')} END AS last_sales_call_date,
        CASE WHEN k % 29 <> 0 THEN {_ts('15 + k % 30', '17')} END AS last_sales_activity_date,
        CASE WHEN k % 6 < 4 THEN {_ts('14 + k % 25', '11')} END AS last_sales_email_date,
        CAST(CASE WHEN k % 13 <> 0 THEN k % 17 END AS INTEGER) AS sales_call_count,
        CAST(CASE WHEN k % 11 <> 0 THEN k % 7 END AS INTEGER) AS sales_text_count,
        CAST(CASE WHEN k % 19 <> 0 THEN k % 5 END AS INTEGER) AS sales_email_count,
        CASE
            WHEN k % 12 = 0 THEN NULL
            WHEN k % 12 = 1 THEN 'n/a'
            WHEN k % 12 = 2 THEN 'US$ 1.234,56'
            WHEN cents >= 100000 THEN 'US$' || {NB} || {_s('cents // 100000')} || {NB}
                 || {_pad('(cents // 100) % 1000', 3)} || ',' || {_pad('cents % 100', 2)}
            ELSE 'US$ ' || {_s('cents // 100')} || ',' || {_pad('cents % 100', 2)} || {TAB}
        END AS predicted_sales_with_owner,
        CASE k % 4 WHEN 0 THEN '["MarketA"]' WHEN 1 THEN '["MarketA", "MarketB"]' WHEN 2 THEN '[]' END
            AS marketplaces_used,
        CASE k % 3 WHEN 0 THEN '["Direct"]' WHEN 1 THEN '["OrderX"]' END AS online_ordering_used,
        CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN '["Pizza"]' WHEN k % 9 = 2 THEN '["Pizza", "Italian"]'
             ELSE '["Thai", "Vegan", "Bar"]' END AS cuisine_types,
        CAST(CASE WHEN k % 31 <> 0 THEN 1 + k % 4 END AS INTEGER) AS location_count,
        CASE WHEN k % 8 <> 0 THEN k % 7 < 2 END AS connected_with_decision_maker,
        CASE st WHEN 'F' THEN 'Converted' WHEN 'O' THEN 'Working' ELSE 'New' END AS status
    FROM fx_orders
),
fx_opp_rows AS (
    SELECT o.*, d.dup
    FROM fx_orders o
    JOIN (SELECT 0 AS dup UNION ALL SELECT 1) d ON d.dup = 0 OR o.k % 250 = 0
    WHERE o.k % 5 = 0 AND o.k % 85 <> 0
),
fx_opp AS (
    SELECT *, (j + dup) % 4 AS s FROM fx_opp_rows
),
raw_opportunities AS (
    SELECT
        'O' || {_s('k')} AS opportunity_id,
        CASE WHEN k % 35 <> 0 THEN 'A' || {_s('c')} END AS account_id,
        CASE s WHEN 0 THEN 'Closed Won' WHEN 1 THEN 'Closed Lost' WHEN 2 THEN 'CLOSED LOST - no response'
               ELSE 'Demo Set' END AS stage_name,
        CASE WHEN s IN (1, 2) THEN
            CASE j % 7 WHEN 0 THEN 'Price' WHEN 1 THEN 'Timing' WHEN 2 THEN 'Competitor' WHEN 3 THEN 'Price'
                       WHEN 4 THEN 'No Decision' WHEN 5 THEN 'Unknown / Not Specified' END
        END AS lost_reason_c,
        CASE WHEN s IN (1, 2) AND j % 2 = 0 THEN 'note ' || {_s('j')} END AS closed_lost_notes_c,
        CASE j % 3 WHEN 0 THEN 'Commission fees' WHEN 1 THEN 'Low traffic' END AS business_issue_c,
        CASE j % 4 WHEN 0 THEN 'Google' WHEN 1 THEN 'Referral' WHEN 2 THEN 'Facebook' END
            AS how_did_you_hear_about_us_c,
        CASE WHEN s = 0 THEN TRUE WHEN s IN (1, 2) THEN j % 6 < 4 END AS demo_held,
        CASE WHEN j % 23 <> 0 THEN {_low('(bd + to_days(CAST(20 + j % 6 AS INTEGER)))')} END AS demo_set_date,
        CASE WHEN s <> 3 THEN {_ts('24 + j % 8', '10 + j % 9')} END AS demo_time,
        CASE WHEN NOT (dup = 1 AND k % 500 = 0) THEN {_ts('18 + j % 5 + 10 * dup', '12')} END AS created_date,
        CASE WHEN s <> 3 THEN {_low('(bd + to_days(CAST(30 + j % 60 AS INTEGER)))')} END AS close_date,
        CASE WHEN j % 5 <> 0 THEN {_ts('22 + j % 9', '15')} END AS last_sales_call_date_time
    FROM fx_opp
),
fx_months AS (
    SELECT strftime(m, '%b-%y') AS month, S, year(m) * 12 + month(m) AS mi
    FROM (SELECT CAST(date_trunc('month', bd) AS DATE) AS m, CAST(sum(k) AS BIGINT) AS S
          FROM fx_orders GROUP BY 1)
),
raw_expenses_advertising AS (
    SELECT month,
           'US$ ' || {_s('a // 100000')} || {NB} || {_pad('(a // 100) % 1000', 3)} || ',' || {_pad('a % 100', 2)}
               AS advertising
    FROM (SELECT month, 5000000 + (S * 31) % 2000000 AS a FROM fx_months WHERE mi % 17 <> 5)
),
raw_expenses_salary AS (
    SELECT month,
           'US$ ' || {_s('o // 100')} || ',' || {_pad('o % 100', 2)} AS outbound_sales_team,
           'US$ ' || {_s('i // 100')} || ',' || {_pad('i % 100', 2)} AS inbound_sales_team
    FROM (SELECT month, 3800000 + (S * 17) % 1200000 AS o, 2000000 + (S * 13) % 900000 AS i
          FROM fx_months WHERE mi % 17 <> 5 AND mi % 19 <> 7)
)"""
