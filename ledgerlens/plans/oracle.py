"""DuckDB SQL for every query in ``catalog.QUERIES`` (the correctness oracle).

The SQL is written independently of the Spark code: plain CTEs over the registered parquet
views. Only the rule lists (keywords, aliases, code rules) are shared, rendered as CASE text.
Oracle hygiene: money as DECIMAL(28,2) summed exactly, then DOUBLE; unique tie-breakers
before every LIMIT; NULLS FIRST where Spark's ascending default puts nulls first.
"""

from __future__ import annotations

from collections.abc import Sequence

from ledgerlens import defaults as D
from ledgerlens.functions.rules import rule_groups
from ledgerlens.plans.star import SEARCH_REGEX, SEARCH_TEXT, SELECTED_CATEGORIES, SELECTED_MONTHS
from ledgerlens.sources import testdata as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def sql_first_group_match(expr: str, groups) -> str:
    branches = []
    for patterns, value in groups:
        cond = " OR ".join(f"contains({expr}, {q(p)})" for p in patterns)
        branches.append(f"WHEN {cond} THEN {q(value)}")
    return "CASE " + " ".join(branches) + " END"


def sql_first_match(expr: str, rules) -> str:
    return sql_first_group_match(expr, rule_groups(rules))


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


# Written out here on purpose, not imported from the Spark code.
LONG_YEAR_FORMATS = [
    "%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d %b %Y", "%d-%b-%Y", "%d %B %Y",
    "%b %d, %Y", "%B %d, %Y", "%b %d %Y", "%B %d %Y", "%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y",
]
SHORT_YEAR_FORMATS = ["%d/%m/%y", "%d-%m-%y", "%d.%m.%y", "%d %b %y", "%d-%b-%y", "%m/%d/%y", "%m-%d-%y"]
TRAILING_TIME = r"(\s+|T)\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(\s*[AaPp][Mm])?(\s*(Z|[+-]\d{2}:?\d{2}))?$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def sql_date(expr: str) -> str:
    text = f"regexp_replace({sql_strip(expr)}, '{TRAILING_TIME}', '')"

    def tries(formats):
        return ", ".join(f"try_strptime({text}, {q(f)})" for f in formats)

    return (f"CAST(CASE WHEN regexp_matches({text}, '[0-9]{{4}}') THEN COALESCE({tries(LONG_YEAR_FORMATS)}) "
            f"ELSE COALESCE({tries(SHORT_YEAR_FORMATS)}) END AS DATE)")


def sql_number(expr: str) -> str:
    """Unrounded number of a money cell, null when it holds none."""
    t = sql_strip(expr)
    return f"CASE WHEN regexp_full_match({t}, '{NUMBER}') THEN TRY_CAST({t} AS DECIMAL(38,10)) END"


def sql_merchant(expr: str) -> str:
    m = f"upper({expr})"
    m = f"regexp_replace({m}, '{D.TERMINAL_SUFFIX_RE}', '')"
    m = f"regexp_replace({m}, '{D.GRAB_PREFIX_RE}', '{D.GRAB_PREFIX_REPLACEMENT}')"
    for old, new in D.LITERAL_REWRITES:
        m = f"replace({m}, {q(old)}, {q(new)})"
    m = f"regexp_replace({m}, '{D.COUNTRY_SUFFIX_RE}', '')"
    m = f"regexp_replace({m}, '{D.LEADING_DIGITS_RE}', '')"
    m = f"regexp_replace({m}, '{D.REFERENCE_TAIL_RE}', '', 'g')"
    for token in D.NOISE_TOKENS:
        m = f"replace({m}, {q(token)}, '')"
    collapsed = f"regexp_replace({m}, '{D.WHITESPACE_RUN_RE}', ' ', 'g')"
    name = f"substr({sql_strip(collapsed)}, 1, {D.MERCHANT_MAX_CHARS})"
    return f"COALESCE({sql_first_match('nm', D.MERCHANT_ALIASES)}, nm)".replace("nm", f"({name})")


def sql_list(values: Sequence[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def raw_statements_cte() -> str:
    templates = sql_list(T.DESCRIPTION_TEMPLATES)
    codes = sql_list(T.CODE_CYCLE)
    aliases, amounts = sql_list([a for a, _ in D.MERCHANT_ALIASES]), sql_list(T.ODD_AMOUNTS)
    forms = ["%m-%d-%Y", "%m.%d.%Y", "%m/%d/%y", "%m-%d-%y", "%-d-%b-%y", "%-d %b %y", "%b %-d %Y", "%B %-d %Y"]
    odd_dates = " ".join(f"WHEN l_linenumber = 7 AND l_orderkey % 11 = {i} THEN strftime(sd, {q(f)})" for i, f in enumerate(forms))
    return f"""
li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_returnflag, l_shipdate,
         CAST(l_shipdate AS DATE) AS sd
  FROM lineitem
),
stmt0 AS (
  SELECT l_orderkey % 50 AS account_id,
    CASE WHEN l_linenumber = 2 AND l_orderkey % 41 = 7 THEN {q(T.BAD_DATE)}
         WHEN l_linenumber = 2 AND l_orderkey % 41 = 8 THEN {q(T.IMPOSSIBLE_DATE)}
         {odd_dates}
         WHEN l_linenumber <= 3 THEN strftime(sd, '%Y-%m-%d')
         WHEN l_linenumber <= 5 THEN strftime(sd, '%d/%m/%Y')
         WHEN l_linenumber = 6 THEN strftime(sd, '%d %b %Y')
         ELSE strftime(sd, '%d-%m-%Y') END AS raw_date,
    CASE WHEN l_partkey % 16 = 15 THEN ''
         ELSE CASE WHEN l_linenumber = 3 AND l_orderkey % 61 = 5
                     THEN 'STALL ' || translate(CAST(l_orderkey AS VARCHAR), '0123456789', {q(T.LETTERS)})
                   WHEN l_linenumber = 3 AND l_orderkey % 61 = 6 THEN {aliases}[l_partkey % {len(D.MERCHANT_ALIASES)} + 1]
                   ELSE {templates}[l_partkey % 16 + 1] END || {q(T.TERMINAL)} || upper(strftime(sd, '%d%b')) || {q(T.CARD_TAIL)}
    END AS raw_desc,
    CASE WHEN l_linenumber = 4 AND l_orderkey % 37 < {len(T.ODD_AMOUNTS)} THEN {amounts}[l_orderkey % 37 + 1]
         ELSE printf('%.2f', l_extendedprice) END AS price,
    CASE WHEN l_returnflag = 'R' THEN '' ELSE price END AS raw_wd,
    CASE WHEN l_returnflag = 'R' THEN price ELSE '' END AS raw_dep,
    {codes}[l_suppkey % 8 + 1] AS raw_code,
    l_shipdate AS s1, l_orderkey AS s2, l_linenumber AS s3, l_partkey AS s4, l_suppkey AS s5, l_extendedprice AS s6
  FROM li
),
stmt AS (SELECT * FROM stmt0 UNION ALL SELECT * FROM stmt0 WHERE s3 = 1)"""


def clean_ctes(src: str = "stmt", prefix: str = "") -> str:
    """parsed -> clean -> dedup -> cat, all names prefixed with ``prefix``."""
    kw = sql_first_match("lower(d.description)", D.MERCHANT_KEYWORDS)
    p = prefix
    return f"""
{p}parsed AS MATERIALIZED (
  SELECT *,
    NULLIF(upper({sql_strip('raw_code')}), '') AS transaction_code,
    {sql_date('raw_date')} AS transaction_date,
    {sql_number('raw_dep')} AS dep, {sql_number('raw_wd')} AS wd,
    COALESCE(dep, 0) - COALESCE(wd, 0) AS net,
    (dep IS NULL AND {sql_strip('raw_dep')} <> '') OR (wd IS NULL AND {sql_strip('raw_wd')} <> '') AS bad_amount,
    CAST(COALESCE(dep, 0) - COALESCE(wd, 0) AS DECIMAL(28,2)) AS amount,
    CASE WHEN upper({sql_strip('raw_desc')}) = '' THEN {q(D.UNKNOWN_PAYEE)} ELSE upper({sql_strip('raw_desc')}) END AS description
  FROM {src}
),
{p}clean AS (
  SELECT transaction_date, strftime(transaction_date, '%Y-%m') AS year_month, amount, description, transaction_code,
         {sql_merchant('description')} AS merchant_name,
         substr(sha256(strftime(transaction_date, '%Y-%m-%d') || '|' || CAST(amount AS VARCHAR) || '|' || description), 1, 16) AS transaction_hash,
         s1, s2, s3, s4, s5, s6
  FROM {p}parsed WHERE transaction_date IS NOT NULL AND net <> 0
),
{p}dedup AS (
  SELECT * FROM {p}clean
  QUALIFY row_number() OVER (PARTITION BY transaction_hash ORDER BY s1, s2, s3, s4, s5, s6) = 1
),
{p}cat0 AS (
  SELECT d.*, k.category AS code_cat, {kw} AS kw
  FROM {p}dedup d LEFT JOIN codes k ON d.transaction_code = k.code
),
{p}cat AS MATERIALIZED (
  SELECT *,
    CASE WHEN transaction_code IN {in_list(D.CASH_CODES)} THEN {q(D.CASH_CATEGORY)}
         WHEN transaction_code IN {in_list(D.BIDIRECTIONAL_CODES)} THEN
              CASE WHEN amount > 0 THEN {q(D.INCOME_CATEGORY)} ELSE {q(D.OUTBOUND_CATEGORY)} END
         WHEN code_cat IS NOT NULL AND transaction_code NOT IN {in_list(D.GENERIC_CODES)} THEN code_cat
         WHEN kw IS NOT NULL THEN kw
         WHEN code_cat IS NOT NULL THEN code_cat
         ELSE {q(D.UNCATEGORISED)} END AS row_category,
    CASE WHEN code_cat IS NOT NULL THEN transaction_code END AS code_fk,
    {{'s1': s1, 's2': s2, 's3': s3, 's4': s4, 's5': s5, 's6': s6}} AS seq
  FROM {p}cat0
)"""


def codes_cte() -> str:
    values = ", ".join(f"({q(c)}, {q(d)})" for c, d in T.FIXTURE_CODES)
    cat = sql_first_group_match("lower(description)", D.CODE_RULES)
    return f"""
codes AS (
  SELECT upper(code) AS code, description, COALESCE({cat}, {q(D.UNCATEGORISED)}) AS category
  FROM (VALUES {values}) t(code, description)
)"""


def categories_cte() -> str:
    values = ", ".join(f"({q(n)})" for n in D.SEEDED_CATEGORIES)
    return f"categories AS (SELECT name FROM (VALUES {values}) t(name))"


def star_sql(tail: str) -> str:
    """Full CTE chain up to the view, followed by ``tail`` (a SELECT over the CTEs)."""
    return f"""WITH {raw_statements_cte()},
{codes_cte()},
{categories_cte()},
{clean_ctes()},
merchants AS (SELECT merchant_name AS merchant, arg_min(row_category, seq) AS category FROM cat GROUP BY merchant_name),
transactions AS (
  SELECT transaction_hash, transaction_date, year_month, amount, description, merchant_name AS merchant,
         code_fk AS transaction_code FROM cat
),
v AS (
  SELECT t.transaction_hash, t.transaction_date, t.amount, t.description, t.transaction_code,
         k.description AS code_description, t.merchant, m.category,
         strftime(t.transaction_date, '%Y-%m') AS month, CAST(day(t.transaction_date) AS INTEGER) AS day,
         t.amount < 0 AS is_expense
  FROM transactions t JOIN merchants m ON t.merchant = m.merchant
  JOIN categories c ON m.category = c.name
  LEFT JOIN codes k ON t.transaction_code = k.code
),
expenses AS (
  SELECT * FROM v WHERE amount < 0 AND category NOT IN {in_list(D.TRANSFER_TYPE_CATEGORIES)}
)
{tail}"""


VIEW_COLS = ("transaction_hash, transaction_date, CAST(amount AS DOUBLE) AS amount, description, transaction_code, "
             "code_description, merchant, category, month, day, is_expense")


def display(src: str) -> str:
    return (f"SELECT strftime(transaction_date, '%Y-%m-%d') AS \"Date\", CAST(amount AS DOUBLE) AS \"Amount (SGD)\", "
            f"transaction_code AS \"Code\", merchant AS \"Merchant\", category AS \"Category\", "
            f"description AS \"Description\" FROM {src}")


def _half_even_share(num_cents: str, den_cents: str) -> str:
    # round_half_even(num / den * 100, 1) from integer cents
    n = f"({num_cents} * 1000)"
    d = f"{den_cents}"
    qq = f"({n} // {d})"
    r = f"({n} - {qq} * {d})"
    return (f"CASE WHEN {d} = 0 THEN NULL ELSE ({qq} + CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {qq} % 2 = 1) "
            f"THEN 1 ELSE 0 END) / 10.0 END")


def _mean_half_up(total: str, n: str) -> str:
    c = f"CAST({total} * 100 AS BIGINT)"
    qq = f"((abs({c}) * 2 + {n}) // ({n} * 2))"
    return f"CASE WHEN {n} > 0 THEN (CASE WHEN {c} < 0 THEN -{qq} ELSE {qq} END) / 100.0 END"


def _two_loads_sql(tail: str) -> str:
    return f"""WITH {raw_statements_cte()},
{codes_cte()},
{clean_ctes('stmt', 'b2_')},
stmt1 AS (SELECT * FROM stmt WHERE s1 >= TIMESTAMP {q(T.FIRST_LOAD_BEFORE + ' 00:00:00')}),
{clean_ctes('stmt1', 'b1_')},
tx1 AS MATERIALIZED (SELECT transaction_hash, year_month, amount, merchant_name AS merchant FROM b1_cat),
m1 AS MATERIALIZED (SELECT merchant_name AS merchant, arg_min(row_category, seq) AS category FROM b1_cat GROUP BY merchant_name),
tx2 AS MATERIALIZED (
  SELECT transaction_hash, year_month, amount, merchant_name AS merchant FROM b2_cat b
  WHERE NOT EXISTS (SELECT 1 FROM tx1 WHERE tx1.transaction_hash = b.transaction_hash AND tx1.year_month = b.year_month)
),
m2 AS MATERIALIZED (
  SELECT merchant_name AS merchant, arg_min(row_category, seq) AS category FROM b2_cat b
  WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.merchant = b.merchant_name) GROUP BY merchant_name
)
{tail}"""


def events_sql(tail: str) -> str:
    """Events shaped as statement rows, cleaned (prefix e_), then ``tail``."""
    return f"""WITH ev AS (
  SELECT strftime(ts, '%Y-%m-%d') AS raw_date, {sql_list(T.DESCRIPTION_TEMPLATES)}[user_id % 16 + 1] || ' ' || upper(event_type) AS raw_desc,
         CASE WHEN event_type = 'signup' THEN '' ELSE printf('%.2f', value) END AS raw_wd,
         CASE WHEN event_type = 'signup' THEN printf('%.2f', value) ELSE '' END AS raw_dep,
         '' AS raw_code, ts AS s1, event_id AS s2, 0 AS s3, 0 AS s4, 0 AS s5, 0 AS s6
  FROM events
),
{codes_cte()},
{clean_ctes('ev', 'e_')},
e_merchants AS (SELECT merchant_name AS merchant, arg_min(row_category, seq) AS category FROM e_cat GROUP BY merchant_name)
{tail}"""


def oracle_queries() -> dict[str, str]:
    S: dict[str, str] = {}
    S["clean_transactions"] = star_sql(
        "SELECT transaction_date, year_month, CAST(amount AS DOUBLE) AS amount, description, transaction_code, "
        "merchant_name, transaction_hash FROM clean")
    S["parse_mixed_dates"] = f"""WITH {raw_statements_cte()}
SELECT raw_date AS date_text, {sql_date('raw_date')} AS transaction_date, count(*) AS n FROM stmt GROUP BY 1, 2"""
    S["merchant_normalise"] = star_sql("SELECT description, merchant_name, count(*) AS n FROM clean GROUP BY 1, 2")
    S["transaction_hash"] = star_sql(
        "SELECT transaction_date, CAST(amount AS DOUBLE) AS amount, description, transaction_hash FROM clean")
    S["dedup_batch"] = star_sql(
        "SELECT transaction_hash, transaction_date, CAST(amount AS DOUBLE) AS amount, description, transaction_code, "
        "merchant_name FROM dedup")
    kw = sql_first_match("lower(description)", D.MERCHANT_KEYWORDS)
    S["keyword_category"] = star_sql(
        f"SELECT description, {kw} AS keyword_category, n FROM (SELECT description, count(*) AS n FROM clean GROUP BY 1)")
    doc_cat = sql_first_group_match("lower(text)", D.CODE_RULES)
    doc_codes = (f"doc_codes AS (SELECT upper('D' || CAST(doc_id AS VARCHAR)) AS code, text AS description, "
                 f"COALESCE({doc_cat}, {q(D.UNCATEGORISED)}) AS category FROM documents)")
    S["code_classification"] = f"WITH {doc_codes} SELECT code, category FROM doc_codes"
    S["codes_per_category"] = (f"WITH {doc_codes}, {categories_cte()} SELECT d.category, count(*) AS cnt "
                               f"FROM doc_codes d JOIN categories c ON d.category = c.name GROUP BY 1")
    S["code_listing"] = (f"WITH {doc_codes}, {categories_cte()} SELECT code, description, d.category FROM doc_codes d "
                         f"JOIN categories c ON d.category = c.name ORDER BY d.category, code LIMIT 20")
    S["row_category"] = star_sql("SELECT transaction_hash, code_fk AS transaction_code, row_category FROM cat")
    S["merchant_dimension"] = star_sql("SELECT merchant, category FROM merchants")
    S["incremental_load"] = _two_loads_sql(
        "SELECT t.transaction_hash, t.merchant, m.category, t.load_no, CAST(t.amount AS DOUBLE) AS amount FROM "
        "(SELECT *, 1 AS load_no FROM tx1 UNION ALL SELECT *, 2 AS load_no FROM tx2) t "
        "JOIN (SELECT * FROM m1 UNION ALL SELECT * FROM m2) m ON t.merchant = m.merchant")
    S["load_counters"] = _two_loads_sql(
        """, c AS (SELECT count(*) AS raw_rows, count(*) FILTER (WHERE transaction_date IS NULL) AS bad_dates,
             count(*) FILTER (WHERE transaction_date IS NOT NULL AND net = 0) AS zero_amounts,
             count(*) FILTER (WHERE transaction_date IS NOT NULL AND bad_amount) AS rejected_amounts FROM b2_parsed)
SELECT raw_rows, bad_dates, zero_amounts, rejected_amounts, (SELECT count(*) FROM b2_cat) AS batch_rows,
       (SELECT count(*) FROM tx1) AS first_load_inserted, (SELECT count(*) FROM tx2) AS second_load_inserted,
       raw_rows - bad_dates - zero_amounts - (SELECT count(*) FROM b2_cat) AS in_batch_duplicates,
       (SELECT count(*) FROM b2_cat) - (SELECT count(*) FROM tx2) AS second_load_skipped
FROM c""")
    months = in_list(SELECTED_MONTHS)
    cats = in_list(SELECTED_CATEGORIES)
    S["full_view"] = star_sql(f"SELECT {VIEW_COLS} FROM v")
    S["month_scoped"] = star_sql(f"SELECT {VIEW_COLS} FROM v WHERE month IN {months}")
    S["expense_view"] = star_sql(
        f"SELECT {VIEW_COLS} FROM v WHERE month IN {months} AND amount < 0 "
        f"AND category NOT IN {in_list(D.TRANSFER_TYPE_CATEGORIES)}")
    S["full_log_view"] = star_sql(display(f"(SELECT * FROM v WHERE month IN {months} AND category IN {cats} AND amount < 0)"))
    needle = q(SEARCH_TEXT.lower())
    S["search_log"] = star_sql(display(
        f"(SELECT * FROM v WHERE coalesce(contains(lower(merchant), {needle}), false) "
        f"OR coalesce(contains(lower(description), {needle}), false))"))
    S["spend_by_category"] = star_sql(
        "SELECT category, CAST(abs(sum(amount)) AS DOUBLE) AS spent FROM expenses GROUP BY 1")
    S["monthly_trend"] = star_sql(
        "SELECT month, category, CAST(abs(sum(amount)) AS DOUBLE) AS spent FROM expenses GROUP BY 1, 2")
    S["daily_spend"] = star_sql(
        "SELECT day, category, CAST(abs(sum(amount)) AS DOUBLE) AS spent FROM expenses GROUP BY 1, 2")
    S["top_merchants"] = star_sql(
        "SELECT merchant, category, CAST(abs(sum(amount)) AS DOUBLE) AS total, count(amount) AS txns FROM expenses "
        "GROUP BY 1, 2 ORDER BY abs(sum(amount)) DESC, merchant ASC LIMIT 12")
    share = (", per AS (SELECT category, abs(sum(amount)) AS spent FROM expenses GROUP BY 1), "
             "tot AS (SELECT CAST(sum(CAST(spent * 100 AS BIGINT)) AS BIGINT) AS total_c FROM per), "
             "sh AS (SELECT category, CAST(spent AS DOUBLE) AS spent, COALESCE("
             + _half_even_share("CAST(spent * 100 AS BIGINT)", "(SELECT total_c FROM tot)") + ", 0.0) AS share_pct FROM per)")
    S["category_share"] = star_sql(share + " SELECT category, spent, share_pct FROM sh")
    S["share_axis"] = star_sql(share + " SELECT max(share_pct) * 1.25 AS axis_max FROM sh")
    S["kpis"] = star_sql(
        """, ms AS (SELECT COALESCE(sum(amount) FILTER (WHERE amount > 0), 0) AS i,
                          COALESCE(sum(amount) FILTER (WHERE amount < 0), 0) AS o FROM v)
SELECT CAST(i AS DOUBLE) AS total_income, CAST(abs(o) AS DOUBLE) AS total_spent, CAST(i + o AS DOUBLE) AS net_flow,
       (SELECT count(DISTINCT merchant) FROM expenses) AS unique_merchants FROM ms""")
    S["income_vs_spend"] = star_sql(
        "SELECT month, CAST(sum(amount) AS DOUBLE) AS value, 'Income' AS type FROM v WHERE amount > 0 GROUP BY 1 "
        "UNION ALL SELECT month, CAST(abs(sum(amount)) AS DOUBLE) AS value, 'Spend' AS type FROM v WHERE amount < 0 GROUP BY 1")
    budgets = ", ".join(f"({q(c)}, CAST({lim} AS DOUBLE))" for c, lim in T.FIXTURE_BUDGETS)
    variance = (f", b AS (SELECT * FROM (VALUES {budgets}) t(category, monthly_limit)), "
                "sp AS (SELECT category, CAST(abs(sum(amount)) AS DOUBLE) AS spent FROM expenses GROUP BY 1), "
                "mg AS (SELECT COALESCE(b.category, sp.category) AS category, COALESCE(b.monthly_limit, 0.0) AS monthly_limit, "
                "COALESCE(sp.spent, 0.0) AS spent FROM b FULL OUTER JOIN sp ON b.category IS NOT DISTINCT FROM sp.category), "
                "var AS (SELECT category, monthly_limit, spent, monthly_limit - spent AS remaining, "
                "spent / (CASE WHEN monthly_limit = 0 THEN 1.0 ELSE monthly_limit END) * 100 AS utilisation_pct "
                "FROM mg WHERE monthly_limit > 0 OR spent > 0)")
    S["budget_variance"] = star_sql(variance + " SELECT * FROM var")
    S["budget_long"] = star_sql(
        variance + " SELECT category, 'Actual Spend' AS \"Metric\", spent AS \"Amount\" FROM var "
        "UNION ALL SELECT category, 'Budget Limit' AS \"Metric\", monthly_limit AS \"Amount\" FROM var")
    S["default_budgets"] = star_sql(
        f"SELECT DISTINCT category, 0.0::DOUBLE AS monthly_limit FROM v WHERE category NOT IN {in_list(D.EXCLUDE_FROM_SPEND)}")
    S["uncategorised_review"] = star_sql(
        f"SELECT merchant, count(amount) AS \"Count\", CAST(sum(amount) AS DOUBLE) AS \"Total_SGD\" FROM v "
        f"WHERE category = {q(D.UNCATEGORISED)} GROUP BY 1")
    S["uncategorised_totals"] = star_sql(
        f"SELECT count(*) AS uncategorised_rows, CAST(COALESCE(sum(amount), 0) AS DOUBLE) AS uncategorised_total "
        f"FROM v WHERE category = {q(D.UNCATEGORISED)}")
    S["category_summary"] = star_sql(
        "SELECT category, count(*) AS n, CAST(round(sum(amount), 2) AS DOUBLE) AS total FROM v GROUP BY 1")
    S["load_stats"] = star_sql(
        f""", a AS (SELECT count(*) AS total, count(*) FILTER (WHERE transaction_code IS NOT NULL) AS coded,
                  count(DISTINCT merchant) AS merchants,
                  count(*) FILTER (WHERE category = {q(D.UNCATEGORISED)}) AS uncategorised FROM v)
SELECT total, coded, merchants, uncategorised, (coded * 100) // greatest(total, 1) AS coded_pct,
       (uncategorised * 100) // greatest(total, 1) AS uncategorised_pct FROM a""")
    S["code_coverage"] = star_sql(
        "SELECT count(*) FILTER (WHERE transaction_code IS NOT NULL) / greatest(count(*), 1) * 100 AS coverage_pct, "
        "count(*) AS \"rows\" FROM v")

    def by_code(category: str, avg: bool = False, order_limit: str = "") -> str:
        extra = f", {_mean_half_up('sum(amount)', 'count(*)')} AS avg_amt" if avg else ""
        return star_sql(
            f"SELECT transaction_code, count(*) AS n, CAST(round(sum(amount), 2) AS DOUBLE) AS total{extra}, "
            f"COALESCE(transaction_code, '(none)') AS code_label FROM v WHERE category = {q(category)} "
            f"GROUP BY transaction_code {order_limit}")

    S["transfers_by_code"] = by_code("Transfers", True, "ORDER BY n DESC, transaction_code ASC NULLS FIRST LIMIT 20")
    S["transfers_preview"] = star_sql(
        "SELECT substr(description, 1, 40) AS desc_preview, transaction_code, CAST(amount AS DOUBLE) AS amount, "
        "transaction_hash FROM v WHERE category = 'Transfers' ORDER BY amount, transaction_hash LIMIT 25")
    S["paynow_by_code"] = by_code(D.OUTBOUND_CATEGORY)
    S["income_by_code"] = by_code(D.INCOME_CATEGORY)
    S["uncategorised_patterns"] = star_sql(
        f"SELECT transaction_code, substr(description, 1, 35) AS desc_prefix, count(*) AS n, "
        f"CAST(round(sum(amount), 2) AS DOUBLE) AS total FROM v WHERE category = {q(D.UNCATEGORISED)} "
        f"GROUP BY 1, 2 ORDER BY n DESC, sum(amount) ASC, transaction_code ASC NULLS FIRST, desc_prefix ASC LIMIT 30")
    mc = (", mc AS (SELECT m.merchant, COALESCE(p.txn_count, 0) AS txn_count FROM merchants m LEFT JOIN "
          "(SELECT merchant, count(*) AS txn_count FROM transactions GROUP BY 1) p ON m.merchant = p.merchant)")
    S["singleton_merchants"] = star_sql(mc + " SELECT merchant, txn_count FROM mc WHERE txn_count = 1 ORDER BY merchant LIMIT 30")
    S["singleton_merchant_count"] = star_sql(mc + " SELECT count(*) AS n_singletons FROM mc WHERE txn_count = 1")
    S["distinct_dates"] = star_sql(
        "SELECT DISTINCT strftime(transaction_date, '%Y-%m-%d') AS transaction_date FROM transactions "
        "ORDER BY 1 LIMIT 10")
    S["uncoded_by_category"] = star_sql(
        "SELECT category, count(*) AS no_code_count FROM v WHERE transaction_code IS NULL GROUP BY 1")
    S["filter_options"] = star_sql(
        "SELECT DISTINCT 'month' AS kind, month AS value FROM v "
        "UNION ALL SELECT DISTINCT 'category' AS kind, category AS value FROM v WHERE category IS NOT NULL")
    def pct(c: str) -> str:
        return f'CAST({c} AS DOUBLE) * 100.0 / CAST(greatest("rows", 1) AS DOUBLE)'

    S["quality_ratios"] = star_sql(
        f""", per AS (SELECT category, count(*) AS n, count(DISTINCT merchant) AS m FROM v GROUP BY 1),
a AS (SELECT sum(n) AS "rows", sum(m) AS merchants,
             COALESCE(sum(n) FILTER (WHERE category = 'Transfers'), 0) AS tr,
             COALESCE(sum(n) FILTER (WHERE category = {q(D.UNCATEGORISED)}), 0) AS un,
             COALESCE(max(n) FILTER (WHERE category <> {q(D.INCOME_CATEGORY)}), 0) AS top FROM per)
SELECT CAST("rows" AS BIGINT) AS "rows", CAST(merchants AS BIGINT) AS merchants,
       {pct('tr')} AS transfers_pct, {pct('un')} AS uncategorised_pct, {pct('top')} AS largest_category_pct,
       {pct('tr')} < 15 AS transfers_ok, {pct('un')} < 10 AS uncategorised_ok,
       {pct('top')} <= 30 AS largest_category_ok, merchants < "rows" AS merchants_ok FROM a""")
    S["referential_check"] = star_sql(
        """SELECT 'transaction_merchant' AS "check", count(*) AS violations FROM transactions t
             WHERE NOT EXISTS (SELECT 1 FROM merchants m WHERE m.merchant = t.merchant)
UNION ALL SELECT 'merchant_category', count(*) FROM merchants m WHERE NOT EXISTS (SELECT 1 FROM categories c WHERE c.name = m.category)
UNION ALL SELECT 'code_category', count(*) FROM codes k WHERE NOT EXISTS (SELECT 1 FROM categories c WHERE c.name = k.category)
UNION ALL SELECT 'transaction_code', count(*) FROM transactions t WHERE t.transaction_code IS NOT NULL
             AND NOT EXISTS (SELECT 1 FROM codes k WHERE k.code = t.transaction_code)""")

    def dupes(table: str, key: str, name: str) -> str:
        return (f"SELECT {q(name)} AS \"check\", count(*) AS duplicate_keys FROM "
                f"(SELECT {key} FROM {table} GROUP BY {key} HAVING count(*) > 1)")

    S["uniqueness_check"] = star_sql(" UNION ALL ".join([
        dupes("transactions", "transaction_hash", "transaction_hash"),
        dupes("merchants", "merchant", "merchant_name"),
        dupes("categories", "name", "category_name"),
        dupes("codes", "code", "code"),
    ]))
    t_cols = ["transaction_hash", "transaction_date", "amount", "description", "merchant"]
    m_cols = ["merchant", "category"]
    parts = [f"SELECT 'transactions' AS \"table\", {q(c)} AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls "
             f"FROM transactions" for c in t_cols]
    parts += [f"SELECT 'merchants', {q(c)}, count(*) FILTER (WHERE {c} IS NULL) FROM merchants" for c in m_cols]
    S["null_check"] = star_sql(" UNION ALL ".join(parts))
    pattern = q(SEARCH_REGEX)
    S["search_log_regex"] = star_sql(display(
        f"(SELECT * FROM v WHERE coalesce(regexp_matches(merchant, {pattern}, 'i'), false) "
        f"OR coalesce(regexp_matches(description, {pattern}, 'i'), false))"))
    S["rule_table_match"] = S["keyword_category"]
    S["statement_files"] = S["clean_transactions"]
    S["bank_layouts"] = S["clean_transactions"]
    one_line = "trim(regexp_replace(text, '[^!-~]+', ' ', 'g'))"
    S["code_list_file"] = (f"SELECT upper('D' || CAST(doc_id AS VARCHAR)) AS code, COALESCE("
                           f"{sql_first_group_match('lower(line)', D.CODE_RULES)}, {q(D.UNCATEGORISED)}) AS category "
                           f"FROM (SELECT doc_id, {one_line} AS line FROM documents) WHERE length(line) > 0")
    S["warehouse_view"] = S["full_view"]
    S["warehouse_reports"] = star_sql(
        """, c AS (SELECT count(*) AS raw_rows, count(*) FILTER (WHERE transaction_date IS NULL) AS bad_dates,
             count(*) FILTER (WHERE transaction_date IS NOT NULL AND net = 0) AS zero_amounts,
             count(*) FILTER (WHERE transaction_date IS NOT NULL AND bad_amount) AS rejected_amounts FROM parsed),
d AS (SELECT *, (SELECT count(*) FROM cat) AS batch_rows, (SELECT count(*) FROM merchants) AS m FROM c),
e AS (SELECT *, raw_rows - bad_dates - zero_amounts - batch_rows AS in_batch_duplicates FROM d)
SELECT CAST(n AS BIGINT) AS load_no, raw_rows, bad_dates, zero_amounts, rejected_amounts, batch_rows, in_batch_duplicates,
       CASE WHEN n = 2 THEN 0 ELSE batch_rows END AS inserted, CASE WHEN n = 2 THEN batch_rows ELSE 0 END AS skipped,
       CASE WHEN n = 2 THEN 0 ELSE m END AS new_merchants, CAST("""
        + str(len(T.FIXTURE_BUDGETS)) + " AS BIGINT) AS budgets FROM e, (VALUES (1), (2), (3)) t(n)")
    S["display_labels"] = star_sql(
        share + " SELECT category, 'SGD ' || format('{:,}', CAST(round_even(spent, 0) AS BIGINT)) AS spent_label, "
        "printf('%.1f%%', share_pct) AS share_label FROM sh")
    damaged = """, md AS (SELECT merchant, CASE WHEN merchant LIKE 'G%' THEN 'No such category' ELSE category END AS category
             FROM merchants WHERE merchant NOT LIKE 'S%'),
kd AS (SELECT code, description, CASE WHEN code = 'AWL' THEN 'No such category' ELSE category END AS category FROM codes WHERE code <> 'MST'),
t0 AS (SELECT * REPLACE (CASE WHEN day(transaction_date) <> 2 THEN description END AS description) FROM transactions),
td AS (SELECT * FROM t0 UNION ALL SELECT * FROM t0 WHERE day(transaction_date) = 1)
"""
    for name in ("referential_check", "uniqueness_check", "null_check"):
        head, tail = S[name][: len(star_sql(""))], S[name][len(star_sql("")):]
        for table, other in (("transactions", "td"), ("merchants", "md"), ("codes", "kd")):
            tail = tail.replace(f"FROM {table}", f"FROM {other}")
        S[f"{name}_damaged"] = head + damaged + tail
    S["stream_ingest"] = events_sql(
        "SELECT c.transaction_hash, c.merchant_name AS merchant, m.category, CAST(c.amount AS DOUBLE) AS amount "
        "FROM e_cat c JOIN e_merchants m ON c.merchant_name = m.merchant")
    S["stream_dedup"] = events_sql(
        "SELECT transaction_hash, transaction_date, CAST(amount AS DOUBLE) AS amount, description FROM e_dedup")
    S["stream_monthly"] = events_sql(
        "SELECT d.year_month AS month, m.category, CAST(abs(sum(d.amount)) AS DOUBLE) AS spent, count(*) AS txns "
        "FROM e_dedup d JOIN e_merchants m ON d.merchant_name = m.merchant WHERE d.amount < 0 GROUP BY 1, 2")
    S["stream_spend_ledger"] = S["stream_monthly"]
    S["stream_daily"] = events_sql(
        "SELECT CAST(d.s1 AS DATE) AS day, m.category, CAST(-sum(d.amount) AS DOUBLE) AS spent, count(*) AS txns "
        "FROM e_dedup d JOIN e_merchants m ON d.merchant_name = m.merchant WHERE d.amount < 0 "
        "AND date_trunc('day', d.s1) + INTERVAL 3 DAY <= (SELECT max(s1) FROM e_clean) GROUP BY 1, 2")
    S.update(_beyond())
    return S


def _beyond() -> dict[str, str]:
    """Running totals, series, outliers, merchant groups and comparisons: plain windows, all pairs."""
    S: dict[str, str] = {}
    S["running_month_spend"] = star_sql(
        "SELECT month, transaction_date, transaction_hash, CAST(-amount AS DOUBLE) AS spent, CAST(sum(-amount) OVER "
        "(PARTITION BY month ORDER BY transaction_date, transaction_hash ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent_so_far FROM expenses")
    S["running_day_spend"] = star_sql(
        ", d AS (SELECT month, transaction_date, -sum(amount) AS spent FROM expenses GROUP BY 1, 2) "
        "SELECT month, transaction_date, CAST(spent AS DOUBLE) AS spent, CAST(sum(spent) OVER "
        "(PARTITION BY month ORDER BY transaction_date) AS DOUBLE) AS spent_so_far FROM d")
    S["unusual_amounts"] = star_sql(
        """, r AS (SELECT transaction_hash, merchant, transaction_date, amount, CAST(amount * 100 AS HUGEINT) AS c FROM v),
p AS (SELECT *, count(*) OVER w AS prior_count, sum(c) OVER w AS s, sum(c * c) OVER w AS q FROM r
      WINDOW w AS (PARTITION BY merchant ORDER BY transaction_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
m AS (SELECT *, CAST(s AS DOUBLE) / nullif(prior_count, 0) AS mean,
             sqrt(greatest(CAST(q AS DOUBLE) / nullif(prior_count, 0) - (CAST(s AS DOUBLE) / nullif(prior_count, 0)) * (CAST(s AS DOUBLE) / nullif(prior_count, 0)), 0.0)) AS std FROM p)
SELECT transaction_hash, merchant, transaction_date, CAST(amount AS DOUBLE) AS amount, prior_count, mean / 100.0 AS prior_mean,
       CASE WHEN prior_count > 0 THEN std / 100.0 END AS prior_std,
       coalesce(prior_count >= 5 AND abs(CAST(c AS DOUBLE) - mean) > 2.0 * std, false) AS unusual FROM m""")
    S["recurring_payments"] = star_sql(
        """, r AS (SELECT merchant, transaction_date, amount, CAST(CAST(abs(amount) * 100 AS BIGINT) AS VARCHAR) AS t FROM expenses),
b AS (SELECT *, substr(t, 1, 2) || repeat('0', greatest(length(t) - 2, 0)) AS band FROM r),
d AS (SELECT merchant, band, transaction_date, count(*) AS n, sum(amount) AS s FROM b GROUP BY 1, 2, 3),
g AS (SELECT *, date_diff('day', lag(transaction_date) OVER (PARTITION BY merchant, band ORDER BY transaction_date), transaction_date) AS gap FROM d),
a AS (SELECT merchant, band, count(*) AS days, CAST(sum(n) AS BIGINT) AS payments, abs(sum(s)) AS spent, min(transaction_date) AS first_date,
             max(transaction_date) AS last_date, quantile_cont(gap, 0.5) AS median_gap FROM g GROUP BY 1, 2 HAVING count(*) >= 3),
cad(cadence, len, tol, months) AS (VALUES ('weekly', 7, 1, 0), ('fortnightly', 14, 2, 0), ('monthly', 30, 4, 1), ('quarterly', 91, 8, 3), ('yearly', 365, 15, 12)),
c AS (SELECT a.*, cadence, len, tol, months FROM a LEFT JOIN cad ON abs(median_gap - len) <= tol),
k AS (SELECT c.merchant, c.band, count(*) FILTER (WHERE gap IS NOT NULL AND abs(gap - len) <= tol) AS kept FROM c JOIN g USING (merchant, band) GROUP BY 1, 2),
x AS (SELECT c.*, CASE WHEN cadence IS NULL THEN 0.0 ELSE CAST(kept AS DOUBLE) / (days - 1) END AS regular_share FROM c JOIN k USING (merchant, band))
SELECT merchant, CAST(band AS DOUBLE) / 100.0 AS band_from, days, payments, CAST(spent AS DOUBLE) AS spent, first_date, last_date,
       CAST(median_gap AS DOUBLE) AS median_gap, cadence, CAST(regular_share AS DOUBLE) AS regular_share,
       cadence IS NOT NULL AND regular_share >= 0.8 AS recurring,
       CASE WHEN cadence IS NOT NULL AND regular_share >= 0.8 THEN
            CAST(CASE WHEN months > 0 THEN last_date + to_months(months) ELSE last_date + to_days(len) END AS DATE) END AS next_due FROM x""")
    # Every pair of skeletons by its edit distance, components by following links to the end.
    groups = """, sk AS (SELECT merchant, regexp_replace(upper(merchant), '[^\\p{L}]', '', 'g') AS letters FROM merchants),
cl AS (SELECT merchant, letters, CASE WHEN letters = '' THEN merchant ELSE letters END AS cls FROM sk),
one AS (SELECT DISTINCT cls, length(letters) AS n FROM cl),
ed AS (SELECT a.cls AS x, b.cls AS y FROM one a JOIN one b ON a.cls <> b.cls AND abs(a.n - b.n) <= 2 AND least(a.n, b.n) >= 5
       AND levenshtein(a.cls, b.cls) <= CASE WHEN least(a.n, b.n) >= 16 THEN 2 ELSE 1 END),
reach AS (SELECT cls AS x, cls AS y FROM one UNION SELECT reach.x, ed.y FROM reach JOIN ed ON reach.y = ed.x),
low AS (SELECT x, min(y) AS label FROM reach GROUP BY 1),
gr AS (SELECT label, min(merchant) AS merchant_group, count(*) AS group_size FROM cl JOIN low ON cls = x GROUP BY 1),
mg AS (SELECT merchant, merchant_group, group_size FROM cl JOIN low ON cls = x JOIN gr USING (label))
"""
    recursive = star_sql("").replace("WITH", "WITH RECURSIVE", 1)
    S["merchant_groups"] = recursive + groups + "SELECT merchant, merchant_group, group_size FROM mg"
    S["spend_by_merchant_group"] = recursive + groups + (
        "SELECT merchant_group, CAST(abs(sum(s)) AS DOUBLE) AS spent, CAST(sum(n) AS BIGINT) AS txns, count(*) AS names FROM "
        "(SELECT merchant, sum(amount) AS s, count(*) AS n FROM expenses GROUP BY 1) JOIN mg USING (merchant) GROUP BY 1")
    raised = "CAST(CASE WHEN length(description) % 3 = 0 THEN amount + 1 ELSE amount END AS DECIMAL(28,2))"
    S["compare_statements"] = star_sql(
        f""", f AS (SELECT transaction_date, description, amount FROM clean WHERE year(transaction_date) < 1998),
t AS (SELECT transaction_date, description, {raised} AS amount FROM clean WHERE year(transaction_date) > 1992),
gone AS (SELECT transaction_date, description, amount, count(*) AS n FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM t) GROUP BY 1, 2, 3),
new AS (SELECT transaction_date, description, amount, count(*) AS n FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM f) GROUP BY 1, 2, 3),
g1 AS (SELECT transaction_date, description, min(amount) AS a, sum(n) AS n FROM gone GROUP BY 1, 2 HAVING count(*) = 1),
n1 AS (SELECT transaction_date, description, min(amount) AS b, sum(n) AS n FROM new GROUP BY 1, 2 HAVING count(*) = 1),
ch AS (SELECT transaction_date, description, a, b, least(g1.n, n1.n) AS k FROM g1 JOIN n1 USING (transaction_date, description))
SELECT transaction_date, description, 'changed' AS change, CAST(a AS DOUBLE) AS amount_before, CAST(b AS DOUBLE) AS amount_after, CAST(k AS BIGINT) AS n FROM ch
UNION ALL SELECT transaction_date, description, 'removed', CAST(amount AS DOUBLE), NULL, CAST(n - coalesce(k, 0) AS BIGINT) FROM gone LEFT JOIN ch USING (transaction_date, description) WHERE n > coalesce(k, 0)
UNION ALL SELECT transaction_date, description, 'added', NULL, CAST(amount AS DOUBLE), CAST(n - coalesce(k, 0) AS BIGINT) FROM new LEFT JOIN ch USING (transaction_date, description) WHERE n > coalesce(k, 0)""")
    S["manual_override"] = star_sql(
        "SELECT transaction_hash, merchant, CASE WHEN merchant LIKE 'N%' THEN 'Side Business' ELSE category END AS category, month, "
        "CAST(amount AS DOUBLE) AS amount FROM v")
    chosen = f"month IN {in_list(SELECTED_MONTHS)} AND category IN {in_list(SELECTED_CATEGORIES)} AND amount < 0"
    S["export_log"] = star_sql(display(f"(SELECT * FROM v WHERE {chosen})"))
    year = "(SELECT category, abs(sum(amount)) AS s FROM v WHERE amount < 0 AND month LIKE '{}-%' GROUP BY 1)"
    S["compare_categories"] = star_sql(
        f"SELECT category, CAST(coalesce(a.s, 0) AS DOUBLE) AS spent_before, CAST(coalesce(b.s, 0) AS DOUBLE) AS spent_after, "
        f"CAST(coalesce(b.s, 0) - coalesce(a.s, 0) AS DOUBLE) AS change FROM {year.format(1996)} a FULL JOIN {year.format(1997)} b USING (category)")
    return S
