"""DuckDB SQL for the queries, written apart from the Spark code.

Amounts are summed as decimals. ``rnd`` rounds a double by its shortest decimal
text, half away from zero, which is how Spark rounds.
"""

from __future__ import annotations


def rnd(expression: str, digits: int) -> str:
    text = f"CAST(({expression}) AS VARCHAR)"
    return f"CAST(round(CAST({text} AS DECIMAL(38,20)), {digits}) AS DOUBLE)"


def dec(expression: str) -> str:
    return f"CAST({expression} AS DECIMAL(38,8))"


def dsum(expression: str, digits: int | None = None) -> str:
    total = f"sum({dec(expression)})"
    return f"CAST({total if digits is None else f'round({total}, {digits})'} AS DOUBLE)"


RATE = "CASE tier WHEN 'bronze' THEN 0.01 WHEN 'silver' THEN 0.02 WHEN 'gold' THEN 0.03 " \
       "WHEN 'platinum' THEN 0.05 WHEN 'diamond' THEN 0.08 END::DOUBLE"


def rank(tier: str) -> str:
    return (f"(CASE {tier} WHEN 'bronze' THEN 1 WHEN 'silver' THEN 2 WHEN 'gold' THEN 3 "
            f"WHEN 'platinum' THEN 4 WHEN 'diamond' THEN 5 END)")


def tier_of(spend: str) -> str:
    return (f"CASE WHEN {spend} >= 50000 THEN 'diamond' WHEN {spend} >= 25000 THEN 'platinum' "
            f"WHEN {spend} >= 10000 THEN 'gold' WHEN {spend} >= 2500 THEN 'silver' ELSE 'bronze' END")


TX_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

VIEWS = {
    "users": ([], """
        SELECT c_custkey AS user_id, n_name AS country, c_acctbal,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'bronze' WHEN 'BUILDING' THEN 'silver'
                    WHEN 'FURNITURE' THEN 'gold' WHEN 'HOUSEHOLD' THEN 'platinum'
                    WHEN 'MACHINERY' THEN 'diamond' END AS tier
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""),
    "suspect_users": (["users"], """
        SELECT user_id, country, CASE WHEN c_acctbal < 0 THEN 'wood' ELSE tier END AS tier FROM users"""),
    "assets": ([], f"""
        SELECT p_type AS symbol, {dsum('p_retailprice')} / count(*) AS base_price, count(*) AS num_items
        FROM part GROUP BY p_type"""),
    "lines": ([], """
        SELECT l.*, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS date, p_type AS symbol, p_retailprice
        FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""),
    "transactions": (["lines"], f"""
        SELECT {TX_ID} AS tx_id, user_id, symbol,
               CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS tx_type,
               l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice AS total_value,
               CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)), 2) AS DOUBLE)
                   AS fee,
               date
        FROM lines"""),
    "suspect_transactions": (["lines"], f"""
        SELECT {TX_ID} AS tx_id, CASE WHEN l_linenumber <> 7 THEN user_id END AS user_id, symbol,
               CASE WHEN l_returnflag = 'R' THEN 'sell' WHEN l_returnflag = 'A' THEN 'buy'
                    WHEN l_linestatus = 'O' THEN 'hold' END AS tx_type,
               CASE WHEN l_discount > 0 THEN l_quantity END AS quantity,
               CASE WHEN l_tax = 0.08 THEN -(l_extendedprice / l_quantity)
                    ELSE l_extendedprice / l_quantity END AS price,
               date
        FROM lines"""),
    "prices": (["lines"], """
        SELECT symbol, date, max(p_retailprice) AS close FROM lines
        WHERE l_linestatus = 'O' GROUP BY symbol, date"""),
    "daily": (["transactions"], f"""
        SELECT user_id, symbol, date,
               sum(CASE WHEN tx_type = 'buy' THEN {dec('quantity')} ELSE -{dec('quantity')} END) AS dq,
               sum(CASE WHEN tx_type = 'buy' THEN {dec('total_value')} ELSE -{dec('total_value')} END) AS dc,
               sum({dec('fee')}) AS df,
               sum(CASE WHEN tx_type = 'sell' THEN {dec('total_value')} ELSE 0 END) AS ds,
               count(tx_id) AS num_trades
        FROM transactions GROUP BY user_id, symbol, date"""),
    "totals": (["daily"], """
        SELECT user_id, symbol, date, num_trades, CAST(sum(dq) OVER w AS DOUBLE) AS held,
               CAST(sum(dc) OVER w AS DOUBLE) AS cost, CAST(sum(df) OVER w AS DOUBLE) AS fees,
               CAST(sum(ds) OVER w AS DOUBLE) AS sold
        FROM daily WINDOW w AS (PARTITION BY user_id, symbol ORDER BY date
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "valued": (["totals", "prices"], """
        SELECT *, CASE WHEN held > 0 THEN mv - cost ELSE 0.0 END AS up,
               sold - (sold / greatest(mv + sold, 1.0)) * cost AS rp
        FROM (SELECT t.*, close, CASE WHEN held > 0 THEN held * close ELSE 0.0 END AS mv,
                     CASE WHEN held > 0 THEN cost / held ELSE 0.0 END AS acb
              FROM totals t JOIN prices p ON t.symbol = p.symbol AND t.date = p.date)"""),
    "snapshot": (["valued"], f"""
        SELECT md5(concat_ws(chr(31), user_id, symbol, date)) AS snapshot_id, user_id, symbol, date,
               {rnd('held', 8)} AS quantity_held, {rnd('acb', 4)} AS avg_cost_basis,
               {rnd('close', 4)} AS market_price, {rnd('mv', 2)} AS market_value,
               {rnd('up', 2)} AS unrealized_pnl,
               {rnd('CASE WHEN cost > 0 AND held > 0 THEN up / cost * 100 ELSE 0.0 END', 2)}
                   AS unrealized_pnl_pct,
               {rnd('rp', 2)} AS realized_pnl, {rnd('fees', 2)} AS total_fees_paid, num_trades
        FROM valued WHERE {rnd('held', 8)} > 0"""),
    "rewards": (["users"], f"""
        SELECT event_id AS reward_id, e.user_id, tier AS tier_at_time, value AS spend_amount,
               CASE event_type WHEN 'purchase' THEN 'cashback' ELSE 'staking' END AS reward_type,
               CASE event_type WHEN 'purchase' THEN {rnd(f'value * {RATE}', 4)}
                    ELSE {rnd('value * 0.08::DOUBLE / 365', 6)} END AS reward_amount,
               CAST(ts AS DATE) AS date
        FROM events e LEFT JOIN users u ON e.user_id = u.user_id
        WHERE event_type IN ('purchase', 'signup')"""),
    "spend": ([], f"""
        SELECT event_id AS tx_id, user_id, 'buy' AS tx_type, {rnd('value * 100', 2)} AS total_value, ts,
               CAST(ts AS DATE) AS date
        FROM events WHERE event_type = 'click'"""),
    "cashback": (["rewards"], f"""
        SELECT user_id, date, {dsum('reward_amount', 4)} AS cashback_earned,
               {dsum('spend_amount', 2)} AS cashback_spend, count(reward_id) AS cashback_count
        FROM rewards WHERE reward_type = 'cashback' GROUP BY user_id, date"""),
    "staking": (["rewards"], f"""
        SELECT user_id, date, {dsum('reward_amount', 6)} AS staking_earned,
               {dsum('spend_amount', 2)} AS staked_value, count(reward_id) AS staking_count
        FROM rewards WHERE reward_type = 'staking' GROUP BY user_id, date"""),
    "daily_rewards": (["cashback", "staking"], f"""
        SELECT *, CAST(round({dec('cashback_earned')} + {dec('staking_earned')}, 4) AS DOUBLE)
                   AS total_reward_value
        FROM (SELECT user_id, date, coalesce(cashback_earned, 0.0) AS cashback_earned,
                     coalesce(cashback_spend, 0.0) AS cashback_spend,
                     coalesce(cashback_count, 0) AS cashback_count,
                     coalesce(staking_earned, 0.0) AS staking_earned,
                     coalesce(staked_value, 0.0) AS staked_value,
                     coalesce(staking_count, 0) AS staking_count
              FROM cashback FULL OUTER JOIN staking USING (user_id, date))"""),
    "buys": (["spend"], f"""
        SELECT user_id, date, {dsum('total_value', 2)} AS daily_buy_spend
        FROM spend WHERE tx_type = 'buy' GROUP BY user_id, date"""),
}


def trailing(value: str, days: int, digits: int) -> str:
    return (f"CAST(round(sum({dec(value)}) OVER (PARTITION BY user_id ORDER BY date "
            f"RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND CURRENT ROW), {digits}) AS DOUBLE)")


VIEWS["rolled"] = (["buys"], f"""
        SELECT *, {trailing('daily_buy_spend', 30, 2)} AS rolling_30d_spend FROM buys""")
VIEWS["enriched"] = (["daily_rewards", "rolled", "users"], f"""
        SELECT *, {tier_of('rolling_30d_spend')} AS suggested_tier FROM (
            SELECT r.*, coalesce(s.daily_buy_spend, 0.0) AS daily_buy_spend,
                   coalesce(s.rolling_30d_spend, 0.0) AS rolling_30d_spend, tier AS user_tier, country
            FROM daily_rewards r
            LEFT JOIN rolled s ON r.user_id = s.user_id AND r.date = s.date
            LEFT JOIN users u ON r.user_id = u.user_id)""")
VIEWS["summary"] = (["enriched"], f"""
        SELECT md5(concat_ws(chr(31), user_id, date)) AS reward_summary_id,
               user_id, user_tier, country, date, cashback_earned, cashback_spend, cashback_count,
               staking_earned, staked_value, staking_count, total_reward_value, daily_buy_spend,
               rolling_30d_spend, {trailing('total_reward_value', 30, 4)} AS rolling_30d_rewards,
               suggested_tier,
               coalesce({rank('suggested_tier')} > {rank('user_tier')}, false) AS tier_upgrade_eligible
        FROM enriched""")


def needed(names: list[str]) -> list[str]:
    found: list[str] = []
    for name in names:
        found += [n for n in needed(VIEWS[name][0]) + [name] if n not in found]
    return list(dict.fromkeys(found))


def sql(names: str, body: str) -> str:
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in needed(names.split())]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


def dense(columns: str, keys: str) -> str:
    """Positions and prices on every day up to the last one, grouped."""
    last = ("(SELECT CAST(max(date) AS TIMESTAMP) FROM "
            "(SELECT max(date) AS date FROM totals UNION ALL SELECT max(date) FROM prices))")
    days = f"unnest(generate_series(CAST(date AS TIMESTAMP), coalesce(until - INTERVAL 1 DAY, {last}), INTERVAL 1 DAY)) AS day"
    return f"""
        , spans AS (SELECT *, lead(date) OVER (PARTITION BY user_id, symbol ORDER BY date) AS until FROM totals),
        quotes AS (SELECT *, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS until FROM prices),
        held_days AS (SELECT user_id, symbol, held, cost, {days} FROM spans WHERE held > 0),
        quoted_days AS (SELECT symbol, close, {days} FROM quotes)
        SELECT {columns}, count(*) AS holders, {dsum('held')} AS quantity_held,
               {dsum('held * close', 2)} AS market_value, {dsum('held * close - cost', 2)} AS unrealized_pnl
        FROM held_days JOIN quoted_days USING (symbol, day) GROUP BY {keys}"""


def counted(name: str, table: str, floor: int) -> str:
    return check(f"row_count_{table}", table, f"(SELECT count(*) FROM {name})", floor, "Count", True)


def check(name: str, table: str, value: str, bound: int, label: str, floor: bool = False) -> str:
    good = f"v >= {bound}" if floor else f"v <= {bound}"
    least = f" || ' (min: {bound:,})'" if floor else ""
    return (f"SELECT '{name}' AS \"check\", '{table}' AS \"table\", "
            f"CASE WHEN {good} THEN 'PASS' ELSE 'FAIL' END AS status, v AS value, "
            f"CAST({bound} AS BIGINT) AS threshold, '{label}: ' || format('{{:,}}', v){least} AS details "
            f"FROM (SELECT CAST({value} AS BIGINT) AS v)")


def failed(name: str, table: str, details: str) -> str:
    text = details.replace("'", "''")
    return (f"SELECT '{name}' AS \"check\", '{table}' AS \"table\", 'FAIL' AS status, "
            f"CAST(NULL AS BIGINT) AS value, CAST(NULL AS BIGINT) AS threshold, '{text}' AS details")


def nulls(source: str, table: str, *columns: str) -> list[str]:
    return [check(f"null_{table}.{c}", table, f"(SELECT count(*) FROM {source} WHERE {c} IS NULL)", 0, "Nulls")
            for c in columns]


def bad(name: str, table: str, source: str, where: str, label: str) -> str:
    return check(name, table, f"(SELECT count(*) FROM {source} WHERE {where})", 0, label)


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


TX_NULLS = nulls("suspect_transactions", "raw_transactions",
                 "tx_id", "user_id", "symbol", "tx_type", "quantity", "price")
TX_RANGE = bad("range_positive_price_quantity", "raw_transactions", "suspect_transactions",
               "price <= 0 OR quantity <= 0", "Invalid price/quantity")
ENUMS = [
    bad("valid_tx_types", "raw_transactions", "suspect_transactions", "tx_type NOT IN ('buy', 'sell')",
        "Invalid tx_type values"),
    bad("valid_user_tiers", "dim_user", "suspect_users",
        "tier NOT IN ('bronze', 'silver', 'gold', 'platinum', 'diamond')", "Invalid tiers"),
]


def orphan_row(name: str, key: str, dim: str, dim_name: str, label: str) -> str:
    return check(name, f"fact_portfolio_daily → {dim_name}",
                 f"(SELECT count(DISTINCT {key}) FROM snapshot WHERE {key} NOT IN (SELECT {key} FROM {dim}))",
                 0, label)


REPORT = union([
    counted("suspect_users", "dim_user", 100), counted("assets", "dim_asset", 5),
    failed("row_count_dim_date", "dim_date", "Table not loaded"),
    counted("snapshot", "fact_portfolio_daily", 1000), counted("summary", "fact_reward_daily", 500),
    counted("suspect_transactions", "raw_transactions", 10000), counted("prices", "raw_prices", 1000),
    counted("rewards", "raw_rewards", 5000),
    *nulls("snapshot", "fact_portfolio_daily", "user_id", "symbol", "date", "quantity_held", "market_value"),
    *nulls("summary", "fact_reward_daily", "user_id", "date", "total_reward_value"),
    *nulls("suspect_users", "dim_user", "user_id", "tier"), *TX_NULLS,
    bad("range_positive_holdings", "fact_portfolio_daily", "snapshot", "quantity_held <= 0",
        "Negative/zero holdings"),
    bad("range_non_negative_market_value", "fact_portfolio_daily", "snapshot", "market_value < 0",
        "Negative market values"),
    bad("range_non_negative_rewards", "fact_reward_daily", "summary", "total_reward_value < 0",
        "Negative reward values"),
    TX_RANGE, *ENUMS,
    orphan_row("ref_integrity_portfolio_users", "user_id", "users", "dim_user", "Orphan user_ids"),
    orphan_row("ref_integrity_portfolio_assets", "symbol", "assets", "dim_asset", "Orphan symbols"),
])
REPORT_VIEWS = "suspect_users assets snapshot summary suspect_transactions prices rewards users"


def age(source: str, table: str) -> str:
    return check(f"freshness_{table}", table,
                 f"(SELECT date_diff('day', max(date), DATE '2024-01-31') FROM {source})", 1, "Age in days")


def consistency(measure: str, fact: str, raw: str) -> str:
    return (f"SELECT 'consistency_{measure}' AS \"check\", 'fact_reward_daily → raw_rewards' AS \"table\", "
            f"CASE WHEN abs(f - r) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status, "
            f"f AS fact_total, r AS raw_total "
            f"FROM (SELECT (SELECT CAST({fact} AS DOUBLE) FROM summary) AS f, "
            f"(SELECT CAST({raw} AS DOUBLE) FROM rewards) AS r)")


def candles(source: str, minutes: int, having: str = "") -> str:
    return f"""
        SELECT symbol, w AS window_start, w + INTERVAL {minutes} MINUTE AS window_end,
               arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
               arg_max(value, (ts, event_id)) AS close, {dsum('value')} AS volume, count(*) AS num_ticks
        FROM (SELECT event_type AS symbol, value, ts, event_id,
                     time_bucket(INTERVAL {minutes} MINUTE, ts, TIMESTAMP '1970-01-01') AS w FROM {source})
        {having} GROUP BY symbol, w"""


def closed(minutes: int, source: str = "events") -> str:
    return (f"WHERE w + INTERVAL {minutes} MINUTE <= "
            f"(SELECT max(ts) - INTERVAL 30 SECOND FROM {source})")


ORACLES: dict[str, str] = {
    "scan_table": "SELECT * FROM lineitem",
    "scan_partition_pruned": sql(
        "rewards", "SELECT * FROM rewards WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-19'"),
    "filter_by_type":
        "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase'",
    "distinct_keys": sql("transactions", "SELECT DISTINCT user_id, symbol FROM transactions"),
    "dim_date": """
        SELECT d AS date_id, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
               CAST(day(d) AS INTEGER) AS day, CAST(quarter(d) AS INTEGER) AS quarter,
               dayname(d) AS day_of_week,
               CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend
        FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE)
                     AS d FROM orders)""",
    "dim_asset": sql("assets", "SELECT symbol, base_price, num_items FROM assets"),
    "decode_props": """
        SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, NOT json_valid(props) AS malformed
        FROM events""",
    "stream_source_rows": f"""
        SELECT event_type, count(*) AS num_rows, {dsum('value')} AS total_value FROM events
        GROUP BY event_type""",

    "signed_transactions": sql("transactions", """
        SELECT tx_id, user_id, symbol, date, tx_type,
               CASE WHEN tx_type = 'buy' THEN quantity ELSE -quantity END AS signed_quantity,
               CASE WHEN tx_type = 'buy' THEN total_value ELSE -total_value END AS signed_cost, fee
        FROM transactions"""),
    "daily_position_delta": sql("daily", """
        SELECT user_id, symbol, date, CAST(dq AS DOUBLE) AS daily_net_quantity,
               CAST(dc AS DOUBLE) AS daily_net_cost, CAST(df AS DOUBLE) AS daily_fees, num_trades,
               CAST(ds AS DOUBLE) AS daily_sell_value FROM daily"""),
    "holdings_priced": sql("totals prices", """
        SELECT t.user_id, t.symbol, t.date, held AS quantity_held, cost AS total_cost_basis,
               close AS market_price
        FROM totals t JOIN prices p ON t.symbol = p.symbol AND t.date = p.date"""),
    "avg_cost_basis": sql("totals", """
        SELECT user_id, symbol, date, CASE WHEN held > 0 THEN cost / held ELSE 0.0 END AS avg_cost_basis
        FROM totals"""),
    "market_value": sql("valued", "SELECT user_id, symbol, date, mv AS market_value FROM valued"),
    "unrealized_pnl": sql("valued", """
        SELECT user_id, symbol, date, up AS unrealized_pnl,
               CASE WHEN cost > 0 AND held > 0 THEN up / cost * 100 ELSE 0.0 END AS unrealized_pnl_pct
        FROM valued"""),
    "realized_pnl": sql("valued", "SELECT user_id, symbol, date, rp AS realized_pnl FROM valued"),
    "portfolio_snapshot": sql("snapshot", "SELECT * FROM snapshot"),
    "surrogate_key": sql("transactions", """
        SELECT DISTINCT user_id, symbol, date, md5(concat_ws(chr(31), user_id, symbol, date)) AS snapshot_id
        FROM transactions"""),
    "latest_snapshot": sql(
        "snapshot", "SELECT * FROM snapshot WHERE date = (SELECT max(date) FROM snapshot)"),
    "latest_position": sql("snapshot", """
        SELECT * FROM snapshot WHERE date <= DATE '2000-12-31'
        QUALIFY row_number() OVER (PARTITION BY user_id, symbol ORDER BY date DESC) = 1"""),
    "top_portfolios": sql("snapshot", f"""
        SELECT user_id, date, {dsum('market_value', 2)} AS total_value FROM snapshot
        WHERE date = (SELECT max(date) FROM snapshot) GROUP BY user_id, date
        ORDER BY total_value DESC, user_id LIMIT 5"""),
    "snapshot_stats": sql("snapshot", """
        SELECT count(*) AS row_count, count(DISTINCT user_id) AS unique_users,
               count(DISTINCT symbol) AS unique_assets, min(date) AS first_date, max(date) AS last_date
        FROM snapshot"""),
    "dense_daily_snapshot": sql("totals prices", dense("symbol, CAST(day AS DATE) AS date", "symbol, day")),
    "dense_position_days": sql("totals prices", dense(
        "user_id, symbol, CAST(min(day) AS DATE) AS first_date, CAST(max(day) AS DATE) AS last_date", "user_id, symbol")),
    "exact_sum_small_amounts": sql("transactions", """
        SELECT symbol, CAST(sum(CAST(total_value AS DECIMAL(18,2))) * 100 AS BIGINT) AS steps
        FROM transactions GROUP BY symbol"""),
    "asset_correlation": sql("prices", """
        , returns AS (SELECT symbol, date, close / before - 1 AS r FROM (
              SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS before FROM prices)
              WHERE before IS NOT NULL)
        SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, count(*) AS common_days,
               round(corr(a.r, b.r), 6) AS correlation
        FROM returns a JOIN returns b ON a.date = b.date AND a.symbol < b.symbol GROUP BY ALL"""),
    "ohlcv_batch": candles("events", 5),

    "daily_cashback": sql("cashback", "SELECT * FROM cashback"),
    "daily_staking": sql("staking", "SELECT * FROM staking"),
    "daily_rewards": sql("daily_rewards", "SELECT * FROM daily_rewards"),
    "daily_buy_spend": sql("buys", "SELECT * FROM buys"),
    "rolling_spend": sql("rolled", "SELECT * FROM rolled"),
    "rolling_spend_7d": sql(
        "buys", f"SELECT *, {trailing('daily_buy_spend', 7, 2)} AS rolling_7d_spend FROM buys"),
    "lifetime_spend": sql("buys", f"""
        SELECT *, CAST(round(sum({dec('daily_buy_spend')}) OVER (PARTITION BY user_id), 2) AS DOUBLE)
            AS lifetime_spend FROM buys"""),
    "rolling_rewards": sql("daily_rewards", f"""
        SELECT user_id, date, total_reward_value, {trailing('total_reward_value', 30, 4)}
            AS rolling_30d_rewards FROM daily_rewards"""),
    "lifetime_rewards": sql("daily_rewards", f"""
        SELECT user_id, date, total_reward_value,
               CAST(round(sum({dec('total_reward_value')}) OVER (PARTITION BY user_id), 4) AS DOUBLE)
                   AS lifetime_rewards FROM daily_rewards"""),
    "reward_spend_enriched": sql("enriched", """
        SELECT user_id, date, total_reward_value, daily_buy_spend, rolling_30d_spend FROM enriched"""),
    "reward_with_user": sql("daily_rewards users", """
        SELECT r.user_id, date, total_reward_value, tier AS user_tier, country
        FROM daily_rewards r LEFT JOIN (SELECT * FROM users WHERE c_acctbal >= 0) u ON r.user_id = u.user_id"""),
    "suggested_tier": sql(
        "rolled", f"SELECT *, {tier_of('rolling_30d_spend')} AS suggested_tier FROM rolled"),
    "tier_upgrade": sql("summary", """
        SELECT user_id, date, user_tier, suggested_tier, tier_upgrade_eligible FROM summary"""),
    "tier_upgrade_lexical": sql("summary", """
        SELECT user_id, date, user_tier, suggested_tier,
               coalesce(suggested_tier > user_tier, false) AS tier_upgrade_eligible FROM summary"""),
    "reward_summary": sql("summary", "SELECT * FROM summary"),
    "reward_summary_by_reward_day": sql("daily_rewards buys users", f"""
        , shown AS (
            SELECT r.user_id, r.date, tier,
                   coalesce((SELECT CAST(round(sum({dec('daily_buy_spend')}), 2) AS DOUBLE) FROM buys b
                             WHERE b.user_id = r.user_id
                               AND b.date BETWEEN r.date - INTERVAL 7 DAY AND r.date), 0.0) AS rolling_spend,
                   {trailing('total_reward_value', 7, 4).replace('PARTITION BY user_id ORDER BY date',
                                                                 'PARTITION BY r.user_id ORDER BY r.date')}
                       AS rolling_rewards
            FROM daily_rewards r LEFT JOIN users u ON r.user_id = u.user_id)
        SELECT user_id, date, rolling_spend, rolling_rewards, {tier_of('rolling_spend')} AS suggested_tier,
               coalesce({rank(f"({tier_of('rolling_spend')})")} > {rank('tier')}, false)
                   AS tier_upgrade_eligible FROM shown"""),
    "reward_by_tier": sql("summary", f"""
        SELECT user_tier, {dsum('cashback_earned', 2)} AS total_cashback,
               {dsum('staking_earned', 2)} AS total_staking, count(DISTINCT user_id) AS unique_users
        FROM summary GROUP BY user_tier ORDER BY user_tier"""),
    "upgrade_eligible_users": sql("summary", """
        SELECT count(DISTINCT user_id) AS eligible_users FROM summary WHERE tier_upgrade_eligible"""),

    "price_lookup_default": sql("transactions prices assets", """
        SELECT tx_id, t.symbol, t.date, quantity, coalesce(close, base_price) AS price
        FROM transactions t LEFT JOIN prices p ON t.symbol = p.symbol AND t.date = p.date
        LEFT JOIN assets a ON t.symbol = a.symbol"""),
    "trade_valuation": sql("transactions prices assets", f"""
        SELECT *, {rnd('total_value * 0.001::DOUBLE', 2)} AS fee FROM (
            SELECT *, {rnd('price * quantity', 2)} AS total_value FROM (
                SELECT tx_id, t.symbol, t.date, quantity, coalesce(close, base_price) AS price
                FROM transactions t LEFT JOIN prices p ON t.symbol = p.symbol AND t.date = p.date
                LEFT JOIN assets a ON t.symbol = a.symbol))"""),
    "cashback_accrual": sql("users", f"""
        SELECT event_id AS reward_id, e.user_id, value AS spend_amount, tier, {RATE} AS cashback_rate,
               {rnd(f'value * {RATE}', 4)} AS reward_amount
        FROM events e LEFT JOIN users u ON e.user_id = u.user_id WHERE event_type = 'purchase'"""),
    "staking_accrual": f"""
        SELECT *, {rnd('staked_value * (apy / 365)', 6)} AS reward_amount FROM (
            SELECT event_id AS reward_id, user_id, value AS staked_value,
                   CAST(json_extract(props, '$.k') AS INTEGER) / 1000 AS apy
            FROM events WHERE event_type = 'signup')""",

    "dq_row_counts": sql("transactions prices rewards users assets", union([
        counted("transactions", "raw_transactions", 10000), counted("prices", "raw_prices", 1000),
        counted("rewards", "raw_rewards", 5000), counted("users", "dim_user", 100),
        counted("assets", "dim_asset", 5)])),
    "dq_null_checks": sql("suspect_transactions suspect_users", union([
        *TX_NULLS, *nulls("suspect_users", "dim_user", "user_id"),
        failed("null_dim_user.tier", "dim_user", "Column 'tier' not found")])),
    "dq_range_checks": sql("suspect_transactions", TX_RANGE),
    "dq_enum_checks": sql("suspect_transactions suspect_users", union(ENUMS)),
    "dq_orphan_users": sql("transactions users", """
        SELECT DISTINCT user_id FROM transactions
        WHERE user_id NOT IN (SELECT user_id FROM users WHERE c_acctbal >= 0)"""),
    "dq_orphan_assets": sql("transactions assets", f"""
        SELECT DISTINCT symbol FROM transactions WHERE symbol NOT IN (
            SELECT symbol FROM assets
            WHERE base_price >= (SELECT {dsum('p_retailprice')} / count(p_retailprice) FROM part))"""),
    "dq_report": sql(REPORT_VIEWS, REPORT),
    "dq_summary": sql(REPORT_VIEWS, f"""
        SELECT count(*) AS total_checks, count(*) FILTER (status = 'PASS') AS passed,
               count(*) FILTER (status = 'FAIL') AS failed,
               round(100.0 * count(*) FILTER (status = 'PASS') / count(*), 1) AS pass_rate
        FROM ({REPORT})"""),
    "dq_freshness": sql("transactions prices rewards", union([
        age("transactions", "raw_transactions"), age("prices", "raw_prices"), age("rewards", "raw_rewards"),
        failed("freshness_dim_user", "dim_user", "Column 'date' not found")])),
    "dq_cross_table": sql("summary rewards", union([
        consistency("cashback_earned", f"sum({dec('cashback_earned')})",
                    f"sum({dec('reward_amount')}) FILTER (reward_type = 'cashback')"),
        consistency("cashback_count", "sum(cashback_count)", "count(*) FILTER (reward_type = 'cashback')"),
        consistency("staking_earned", f"sum({dec('staking_earned')})",
                    f"sum({dec('reward_amount')}) FILTER (reward_type = 'staking')"),
        consistency("staking_count", "sum(staking_count)", "count(*) FILTER (reward_type = 'staking')"),
        consistency("cashback_only_spend", f"sum({dec('cashback_spend')})", f"sum({dec('spend_amount')})")])),
    "stage_transactions": sql("suspect_transactions", """
        SELECT tx_id, user_id, tx_type, quantity, price, concat_ws(',',
            CASE WHEN tx_id IS NULL OR user_id IS NULL OR symbol IS NULL THEN 'missing_key' END,
            CASE WHEN tx_type IS NULL THEN 'missing_tx_type' END,
            CASE WHEN tx_type NOT IN ('buy', 'sell') THEN 'invalid_tx_type' END,
            CASE WHEN quantity IS NULL OR price IS NULL THEN 'missing_amount' END,
            CASE WHEN quantity <= 0 OR price <= 0 THEN 'non_positive_amount' END) AS reasons
        FROM suspect_transactions"""),

    "roundtrip_partitioned": sql("rewards", "SELECT * FROM rewards"),
    "incremental_new_dates": sql("transactions prices", """
        SELECT DISTINCT date FROM transactions WHERE date NOT IN (SELECT date FROM prices)"""),
    "compact_rows": sql("prices", "SELECT * FROM prices"),
    "clustered_layout": sql(
        "transactions", "SELECT tx_id, user_id, symbol, date, total_value FROM transactions"),

    "merge_batch_realtime": sql("totals", """
        SELECT user_id, symbol, held AS quantity_held, cost AS total_cost_basis, date AS updated_on FROM totals
        QUALIFY row_number() OVER (PARTITION BY user_id, symbol ORDER BY date DESC) = 1"""),
    "reconciliation": sql("transactions", f"""
        , b AS (SELECT user_id, date, {dsum('total_value')} AS v FROM transactions
                WHERE date <= DATE '2000-12-31' GROUP BY ALL),
        r AS (SELECT user_id, date, {dsum('total_value')} AS v FROM transactions
              WHERE tx_type = 'buy' GROUP BY ALL)
        SELECT user_id, date, b.v AS batch_value, r.v AS rt_value,
               CASE WHEN r.v IS NULL THEN 'batch_only' WHEN b.v IS NULL THEN 'rt_only'
                    WHEN abs(b.v - r.v) <= 0.01 THEN 'match' ELSE 'mismatch' END AS status
        FROM b FULL OUTER JOIN r USING (user_id, date)"""),
    "latest_view_upsert": """
        SELECT * FROM (
            SELECT user_id, event_id, event_type, value, ts FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        WHERE ts >= TIMESTAMP '2024-01-29'""",

    "stream_to_raw": "SELECT *, CAST(ts AS DATE) AS date FROM events",
    "stream_ohlcv_1m": candles("events", 1, closed(1)),
    "stream_ohlcv_5m": candles("events", 5, closed(5)),
    "stream_late_data": f"""
        WITH arriving AS (
            SELECT *, date_diff('day', TIMESTAMP '2024-01-01',
                                CASE event_type WHEN 'error' THEN ts + INTERVAL 10 DAY ELSE ts END) // 10 AS third
            FROM events),
        watermark AS (
            SELECT n, (SELECT max(ts) - INTERVAL 30 SECOND FROM arriving WHERE third < n) AS w
            FROM (SELECT unnest([0, 1, 2, 3]) AS n)),
        counted AS (
            SELECT a.* FROM arriving a JOIN watermark ON third = n
            WHERE w IS NULL
               OR time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') + INTERVAL 5 MINUTE > w)
        {candles('counted', 5, closed(5, 'arriving'))}""",
    "stream_dedup": "SELECT event_id, ts, user_id, event_type, value FROM events",
    "stream_reward_tier": sql("buys", f"""
        , spread AS (
            SELECT user_id, date + CAST(age AS INTEGER) AS day, age, daily_buy_spend
            FROM buys, (SELECT unnest(generate_series(0, 31)) AS age)),
        rolled_days AS (
            SELECT user_id, day,
                   coalesce(CAST(sum({dec('daily_buy_spend')}) FILTER (age <= 30) AS DOUBLE), 0.0) AS rolling_spend
            FROM spread GROUP BY user_id, day)
        SELECT user_id, day AS date, rolling_spend, {tier_of('rolling_spend')} AS tier FROM rolled_days
        WHERE CAST(day + 1 AS TIMESTAMP) <=
              (SELECT max(ts) - INTERVAL 30 SECOND FROM events WHERE event_type = 'click')"""),
    "live_pnl": sql("totals prices", f"""
        , held AS (SELECT * FROM totals
                   QUALIFY row_number() OVER (PARTITION BY user_id, symbol ORDER BY date DESC) = 1),
        quote AS (SELECT symbol, close AS price FROM prices
                  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
        SELECT user_id, h.symbol, held AS quantity_held, {rnd('cost', 2)} AS total_cost_basis, price,
               {rnd('CASE WHEN held > 0 THEN held * price ELSE 0.0 END', 2)} AS market_value,
               {rnd('CASE WHEN held > 0 THEN held * price - cost ELSE 0.0 END', 2)} AS unrealized_pnl
        FROM held h JOIN quote q ON h.symbol = q.symbol"""),
}
ORACLES["cumulative_holdings"] = ORACLES["cumulative_incremental"] = sql("totals", """
        SELECT user_id, symbol, date, held AS quantity_held, cost AS total_cost_basis,
               fees AS total_fees_paid, sold AS cumulative_sell_value, num_trades FROM totals""")
MONTHLY = ("CAST(o_orderdate AS DATE) AS date", "CAST(date_trunc('month', o_orderdate) AS DATE) AS date")
ORACLES["incremental_after_late_trades"] = sql("snapshot", "SELECT * FROM snapshot").replace(*MONTHLY)
ORACLES["realtime_raw_complete"] = "SELECT event_id, ts, user_id, event_type, value FROM events"
ORACLES["daily_prices_from_ticks"] = """
    SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close
    FROM events GROUP BY event_type, CAST(ts AS DATE)"""
ORACLES["stream_ohlcv_updates"] = ORACLES["ohlcv_batch"]
ORACLES["reconcile_positions"] = sql("lines", f"""
    , signed AS (SELECT user_id, symbol, l_linenumber,
                        CASE WHEN l_returnflag = 'R' THEN -{dec('l_quantity')} ELSE {dec('l_quantity')} END AS q FROM lines),
    sides AS (SELECT user_id, symbol, CAST(sum(q) AS DOUBLE) AS batch_value,
                     CAST(sum(q) FILTER (WHERE l_linenumber <> 6) AS DOUBLE) AS rt_value
              FROM signed GROUP BY user_id, symbol)
    SELECT user_id, symbol, batch_value, rt_value,
           CASE WHEN rt_value IS NULL THEN 'batch_only' WHEN abs(batch_value - rt_value) <= 0.01 THEN 'match'
                ELSE 'mismatch' END AS status FROM sides""")
ORACLES["stream_reward_tier_now"] = sql("buys", f"""
    , last AS (SELECT user_id, max(date) AS today FROM buys GROUP BY user_id),
    now AS (SELECT user_id, today AS date, CAST(sum({dec('daily_buy_spend')}) AS DOUBLE) AS rolling_spend
            FROM buys JOIN last USING (user_id) WHERE date >= today - 30 GROUP BY user_id, today)
    SELECT user_id, date, rolling_spend, {tier_of('rolling_spend')} AS tier FROM now""")
# A day counts up to 30 days after it, as seen from the user's last purchase or from the stream's last moment less 30 s.
ORACLES["stream_reward_tier_after_pauses"] = sql("spend", f"""
    , paused AS (SELECT user_id, total_value, ts + to_days(CAST(floor(datediff('day', DATE '1970-01-01', date) / 20) AS INTEGER) * 45) AS ts
                 FROM spend),
    days AS (SELECT user_id, CAST(ts AS DATE) AS date, total_value FROM paused),
    seen AS (SELECT CAST(max(ts) - INTERVAL 30 SECOND AS DATE) AS mark FROM paused),
    last AS (SELECT user_id, greatest(max(date), (SELECT mark FROM seen)) AS today FROM days GROUP BY user_id),
    now AS (SELECT user_id, coalesce(CAST(sum({dec('total_value')}) FILTER (WHERE date >= today - 30) AS DOUBLE), 0) AS rolling_spend
            FROM days JOIN last USING (user_id) GROUP BY user_id)
    SELECT user_id, rolling_spend, {tier_of('rolling_spend')} AS tier FROM now""")
ORACLES["merge_of_one_user"] = sql("totals transactions", """
    SELECT user_id, symbol, held AS quantity_held, cost AS total_cost_basis, date AS updated_on FROM totals
    WHERE user_id = (SELECT user_id FROM transactions GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)
    QUALIFY row_number() OVER (PARTITION BY user_id, symbol ORDER BY date DESC) = 1""")
ORACLES["curve_layout"] = sql("transactions", "SELECT tx_id, user_id, symbol, date, total_value FROM transactions")
ORACLES["compact_small_files"] = sql("prices", "SELECT symbol, date, close FROM prices")
ORACLES["fingerprint_check"] = sql("cashback", """
    SELECT 'fingerprint_cashback' AS "check", 'FAIL' AS status,
           count(DISTINCT date) FILTER (WHERE user_id = (SELECT min(user_id) FROM cashback)) AS value FROM cashback""")
ORACLES["trades_once"] = sql("transactions", "SELECT * EXCLUDE (tx_id) FROM (SELECT DISTINCT * FROM transactions)")
ORACLES["correlation_by_runs"] = ORACLES["asset_correlation"]
ORACLES["messages_of_candles"] = f"SELECT symbol AS key, * FROM ({ORACLES['ohlcv_batch']})"
