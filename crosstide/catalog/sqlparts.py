"""Shared SQL pieces of the check queries (the same derived tables, written for DuckDB)."""

from __future__ import annotations

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, body: str, *needs: str) -> None:
    PARTS[name] = (needs, body.strip())


def with_parts(select: str, *names: str) -> str:
    """``WITH`` the named parts and everything they need, then ``select``."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in PARTS[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return select.strip()
    body = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    select = select.strip()
    if select.upper().startswith("WITH "):
        return f"WITH {body},\n{select[5:]}"
    return f"WITH {body}\n{select}"


part(
    "base",
    """
SELECT n_name, r_name, l_linestatus, CAST(l_suppkey AS VARCHAR) AS supp, CAST(l_shipdate AS DATE) AS date,
       CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
       CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL""",
)
_priced = """
SELECT {name} AS ticker, date,
       CAST(CAST(SUM(cents) AS BIGINT) AS DOUBLE) / CAST(100 AS DOUBLE) / CAST(CAST(SUM(qty) AS BIGINT) AS DOUBLE) AS close,
       CAST(SUM(qty) AS BIGINT) AS volume
FROM base GROUP BY ALL"""
part("bars", _priced.format(name="n_name"), "base")
part("region_bars", _priced.format(name="r_name"), "base")
part("member_bars", _priced.format(name="r_name || '-' || l_linestatus"), "base")
part("market_bars", _priced.format(name="'MARKET'"), "base")
part("supplier_bars", _priced.format(name="supp"), "base")
part("nr_bars", "SELECT * FROM bars UNION ALL SELECT * FROM region_bars", "bars", "region_bars")
part("nm_bars", "SELECT * FROM bars UNION ALL SELECT * FROM market_bars", "bars", "market_bars")
part(
    "all_bars",
    "SELECT * FROM bars UNION ALL SELECT * FROM region_bars UNION ALL SELECT * FROM market_bars",
    "bars",
    "region_bars",
    "market_bars",
)
part(
    "edges",
    """
SELECT p.n_name AS parent, c.n_name AS child,
       CASE WHEN p.n_regionkey = c.n_regionkey
            THEN CAST(0.5 AS DOUBLE) + CAST(c.n_nationkey // 5 AS DOUBLE) / CAST(10 AS DOUBLE)
            ELSE CAST(0.3 AS DOUBLE) + CAST(c.n_nationkey * 3 % 7 AS DOUBLE) / CAST(10 AS DOUBLE) END AS weight,
       CAST(p.n_nationkey * 100 + c.n_nationkey AS BIGINT) AS position
FROM nation p JOIN nation c
  ON c.n_regionkey = p.n_regionkey OR c.n_regionkey = (p.n_regionkey + 1) % 5
WHERE p.n_nationkey < 5 AND c.n_nationkey >= 5""",
)
part(
    "themes",
    """
SELECT lower(r_name) AS theme, n_name AS ticker, r_name AS benchmark, 'Basket ' || r_name AS theme_label
FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
part(
    "trades",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS accession_number, n_name AS ticker,
       CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS filed_date,
       CAST(o_orderdate AS DATE) AS transaction_date, c_name AS insider_name, c_mktsegment AS insider_title,
       o_orderpriority = '1-URGENT' AS is_officer, o_orderpriority = '2-HIGH' AS is_director,
       CASE o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'S' ELSE 'A' END AS transaction_code,
       o_totalprice AS total_value,
       CASE WHEN o_orderstatus = 'F' THEN o_orderpriority <> '5-LOW' END AS is_open_market
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
part(
    "event_trades",
    """
SELECT CAST(event_id AS VARCHAR) AS accession_number, CAST(user_id AS VARCHAR) AS ticker,
       CAST(ts AS DATE) AS filed_date, CAST(ts AS DATE) - CAST(event_id % 5 AS INTEGER) AS transaction_date,
       props AS insider_name, event_type AS insider_title, value > 20 AS is_officer,
       CASE event_type WHEN 'purchase' THEN 'P' WHEN 'error' THEN 'S' ELSE 'A' END AS transaction_code,
       value AS total_value, CASE WHEN event_type = 'purchase' THEN TRUE END AS is_open_market
FROM events""",
)
part(
    "estimates",
    """
SELECT ticker, transaction_date AS date, COUNT(*) FILTER (WHERE transaction_code = 'P') AS analysts_up,
       COUNT(*) FILTER (WHERE transaction_code = 'S') AS analysts_down
FROM trades GROUP BY 1, 2""",
    "trades",
)


def ret_sql(n: int, c: str = "close") -> str:
    return f"(({c}) - lag({c}, {n}) OVER w) / nullif(lag({c}, {n}) OVER w, 0)"


W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def r8s(expr: str, digits: int = 8) -> str:
    return f"ROUND({expr}, {digits}) + CAST(0 AS DOUBLE)"
