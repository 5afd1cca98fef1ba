"""The same questions in ANSI SQL, for DuckDB on the raw test tables."""

from __future__ import annotations

from stopwise.config import CORRELATED, ERROR_PERCENTILES, FEATURES, TARGET_QUANTILES, TIME_RANGES, WEEKDAYS, WEIGHT_CLASSES
from stopwise.functions import normal
from stopwise.plans.catalog import PREVIEWS, RULE_VERSION, WANTED

T = "service_time_in_minutes"
MEASURES = ["total_boxes", "total_articles", "total_weight_g", "avg_article_weight_g", "max_article_weight_g", "min_article_weight_g"]


def r(expression: str, digits: int = 4) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


# Named building blocks; each query lists the ones it needs, dependencies included.
BLOCKS: dict[str, tuple[list[str], str]] = {}


def block(name: str, needs: str, sql: str) -> None:
    BLOCKS[name] = (needs.split(), sql)


block(
    "svc_orders",
    "",
    """SELECT CAST(o_orderkey AS VARCHAR) AS web_order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
              CAST(c_nationkey AS VARCHAR) AS warehouse_id, o_orderdate + to_hours(o_orderkey % 24) AS order_time,
              CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 6 END AS DOUBLE) AS floor,
              CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey % 3 = 0 END AS has_elevator,
              CASE WHEN o_orderkey % 17 = 0 THEN NULL
                   ELSE c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') END AS is_business
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 101 <> 0""",
)
block(
    "svc_articles",
    "",
    """SELECT CAST(l_orderkey AS VARCHAR) AS web_order_id, CAST(l_partkey AS VARCHAR) AS article_id,
              CAST(l_suppkey % 4 AS VARCHAR) AS box_id,
              CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE CAST(l_quantity * 100 AS DOUBLE) END AS article_weight_in_g
       FROM lineitem""",
)
block(
    "svc_times",
    "",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS web_order_id, CONCAT('D', CAST(o_orderkey % 25 AS VARCHAR)) AS driver_id,
               CAST(o_custkey AS VARCHAR) AS customer_id, CONCAT('T', CAST(o_orderkey % 400 AS VARCHAR)) AS trip_id,
               o_orderdate AS order_datetime,
               CAST(CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN -1
                         WHEN o_orderkey % 53 = 0 THEN 60 + o_orderkey % 7
                         ELSE 3 + o_totalprice / 100000 + 0.8 * (o_custkey % 6) END AS DOUBLE) AS {T}
        FROM orders""",
)
block(
    "svc_mapping",
    "",
    """SELECT CONCAT('D', CAST(o_orderkey % 25 AS VARCHAR)) AS driver_id, CAST(o_orderkey AS VARCHAR) AS web_order_id
       FROM orders WHERE o_orderkey % 31 <> 0
       UNION ALL
       SELECT CONCAT('D', CAST(o_orderkey % 25 AS VARCHAR)), CAST(o_orderkey AS VARCHAR)
       FROM orders WHERE o_orderkey % 47 = 0""",
)
block(
    "svc_requests",
    "",
    """SELECT CONCAT('b', CAST(CASE WHEN (event_id // 1000) % 5 = 0 THEN 1000000 + event_id // 150
                                   ELSE event_id // 60 END AS VARCHAR)) AS request_id,
              event_id AS position, CONCAT('D', CAST(user_id % 25 AS VARCHAR)) AS driver_id,
              CASE WHEN event_id % 9 = 0 THEN CONCAT('X', CAST(event_id AS VARCHAR))
                   ELSE CAST(event_id AS VARCHAR) END AS web_order_id, ts AS requested_at
       FROM events""",
)
block(
    "svc_logs",
    "",
    """SELECT event_id AS id, ts AS "timestamp", CAST(event_id % 500 AS VARCHAR) AS web_order_id,
              CONCAT('D', CAST(user_id % 25 AS VARCHAR)) AS driver_id, value AS predicted_service_time,
              CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS model_version,
              CONCAT('r', CAST(event_id % 100 AS VARCHAR)) AS request_id
       FROM events""",
)
block(
    "timed_visits",
    "svc_times",
    f"""SELECT web_order_id AS visit_id, CASE WHEN k % 37 = 5 THEN NULL WHEN k % 3 = 0 THEN '7' ELSE CAST(k % 600 AS VARCHAR) END AS web_order_id,
              CASE WHEN k % 41 <> 9 THEN TIMESTAMP '2024-01-01' + to_seconds(k * 7919 % 2592000) END AS visited_at, {T}
       FROM (SELECT *, CAST(web_order_id AS BIGINT) AS k FROM svc_times)""",
)
block(
    "latest_said",
    "svc_logs",
    """SELECT web_order_id, "timestamp" AS at, MAX({'p': predicted_service_time, 'v': model_version}) AS said FROM svc_logs
       WHERE web_order_id IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY 1, 2""",
)
block(
    "as_of",
    "timed_visits latest_said",
    f"""SELECT v.visit_id, v.web_order_id, v.visited_at, v.{T}, p.said.p AS predicted, p.said.v AS model_version, p.at AS predicted_at
        FROM timed_visits v ASOF LEFT JOIN latest_said p ON v.web_order_id = p.web_order_id AND v.visited_at >= p.at""",
)
block(
    "article_totals",
    "svc_articles",
    """SELECT web_order_id, COUNT(DISTINCT box_id) AS total_boxes, COUNT(article_id) AS total_articles,
              COALESCE(SUM(article_weight_in_g), 0) AS total_weight_g, AVG(article_weight_in_g) AS avg_article_weight_g,
              MAX(article_weight_in_g) AS max_article_weight_g, MIN(article_weight_in_g) AS min_article_weight_g
       FROM svc_articles WHERE web_order_id IS NOT NULL GROUP BY web_order_id""",
)
block(
    "with_orders",
    "svc_times svc_orders",
    """SELECT s.*, o.customer_id AS customer_id_order, o.warehouse_id, o.order_time, o.floor, o.has_elevator, o.is_business
       FROM svc_times s LEFT JOIN svc_orders o ON s.web_order_id = o.web_order_id""",
)
block(
    "crowd_times",
    "svc_times",
    """SELECT * REPLACE (CASE WHEN CAST(web_order_id AS BIGINT) % 3 = 0 THEN '1'
                              WHEN CAST(web_order_id AS BIGINT) % 101 <> 5 THEN web_order_id END AS web_order_id) FROM svc_times""",
)
block(
    "crowd_orders",
    "svc_orders",
    """SELECT * REPLACE (CASE WHEN CAST(web_order_id AS BIGINT) % 103 <> 7 THEN web_order_id END AS web_order_id) FROM svc_orders
       UNION ALL
       SELECT * REPLACE (floor + 1 AS floor) FROM svc_orders
       WHERE CAST(web_order_id AS BIGINT) % 53 = 0 OR web_order_id = '1'""",
)
block(
    "explored",
    "with_orders article_totals",
    f"""SELECT w.*, {', '.join('a.' + m for m in MEASURES)}
        FROM with_orders w LEFT JOIN article_totals a ON w.web_order_id = a.web_order_id""",
)


def timed(source: str) -> str:
    return f"""SELECT *, CAST(EXTRACT(hour FROM order_time) AS INTEGER) AS order_hour,
               CAST(isodow(order_time) - 1 AS INTEGER) AS order_day_of_week,
               CAST(EXTRACT(month FROM order_time) AS INTEGER) AS order_month,
               COALESCE(CAST(isodow(order_time) - 1 >= 5 AS INTEGER), 0) AS is_weekend FROM {source}"""


def filled(source: str) -> str:
    fills = ", ".join(f"COALESCE({m}, 0) AS {m}" for m in MEASURES)
    return f"""SELECT * REPLACE (COALESCE(floor, 0) AS floor, COALESCE(has_elevator, FALSE) AS has_elevator,
               COALESCE(is_business, FALSE) AS is_business, {fills}) FROM {source}"""


def derived(source: str) -> str:
    return f"""SELECT * REPLACE (CAST(has_elevator AS INTEGER) AS has_elevator, CAST(is_business AS INTEGER) AS is_business),
               CASE WHEN total_boxes > 0 THEN total_weight_g / total_boxes ELSE 0.0 END AS weight_per_box,
               floor * CAST(has_elevator AS INTEGER) AS floor_elevator_interaction,
               CAST(is_business AS INTEGER) * floor AS business_floor_interaction FROM {source}"""


block("timed", "explored", timed("explored"))
block("timed_orders", "with_orders", timed("with_orders"))
block("filled", "explored", filled("explored"))
block("filled_timed", "timed", filled("timed"))
block("derived", "filled_timed", derived("filled_timed"))
block(
    "joined",
    "explored svc_mapping",
    """SELECT e.* FROM explored e LEFT JOIN svc_mapping m
       ON e.driver_id = m.driver_id AND e.web_order_id = m.web_order_id""",
)
block("positive", "joined", f"SELECT * FROM joined WHERE {T} IS NOT NULL AND {T} > 0")


def bounds(source: str) -> str:
    return f"""SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
               FROM (SELECT quantile_cont({T}, 0.25) AS q1, quantile_cont({T}, 0.75) AS q3 FROM {source})"""


block("limits", "positive", bounds("positive"))
block("visit_limits", "svc_times", bounds("svc_times"))
block("positive_visits", "svc_times", f"SELECT * FROM svc_times WHERE {T} > 0")
block("positive_visit_limits", "positive_visits", bounds("positive_visits"))
block("explored_limits", "explored", bounds("explored"))
block("filled_positive", "positive", filled("positive"))
block(
    "cleaned",
    "filled_positive limits",
    f"SELECT * FROM filled_positive WHERE {T} BETWEEN (SELECT lower FROM limits) AND (SELECT upper FROM limits)",
)
block("cleaned_timed", "cleaned", timed("cleaned"))
block("processed", "cleaned_timed", derived("cleaned_timed"))
block(
    "parts",
    "processed",
    """SELECT *, CASE WHEN b < 200 THEN 'test' WHEN b < 300 THEN 'val' ELSE 'train' END AS split
       FROM (SELECT *, CAST('0x' || substr(md5('42:' || web_order_id), 1, 8) AS BIGINT) % 1000 AS b FROM processed)""",
)
block(
    "rule",
    "parts",
    f"SELECT floor, has_elevator, AVG({T}) AS cell_mean FROM parts WHERE split = 'train' GROUP BY floor, has_elevator",
)
block("default_mean", "parts", f"SELECT AVG({T}) AS m FROM parts WHERE split = 'train'")
block(
    "predicted",
    "parts rule default_mean",
    """SELECT p.*, COALESCE(c.cell_mean, (SELECT m FROM default_mean)) AS predicted FROM parts p
       LEFT JOIN rule c ON p.floor = c.floor AND p.has_elevator = c.has_elevator""",
)
block("errors", "predicted", f"SELECT *, {T} - predicted AS residual, abs({T} - predicted) AS abs_error FROM predicted")
block(
    "ranged",
    "errors",
    f"""SELECT * FROM (SELECT *, CASE WHEN {T} > 0 AND {T} <= 5 THEN 0 WHEN {T} > 5 AND {T} <= 10 THEN 1
               WHEN {T} > 10 AND {T} <= 15 THEN 2 WHEN {T} > 15 AND {T} <= 20 THEN 3 WHEN {T} > 20 AND {T} <= 25 THEN 4
               WHEN {T} > 25 AND {T} <= 30 THEN 5 WHEN {T} > 30 THEN 6 END AS range_no FROM errors)
        WHERE range_no IS NOT NULL""",
)


def listed(labels: list[str], index: str, name: str) -> str:
    rows = ", ".join(f"({i}, '{text}')" for i, text in enumerate(labels))
    return f"SELECT CAST(i AS INTEGER) AS {index}, t AS {name} FROM (VALUES {rows}) v(i, t)"


block("ranges", "", listed(TIME_RANGES, "range_no", "time_range"))
R2 = f"""CASE WHEN var_pop({T}) = 0 THEN CASE WHEN SUM(residual * residual) = 0 THEN 1.0 ELSE 0.0 END
         ELSE 1 - SUM(residual * residual) / (var_pop({T}) * COUNT(*)) END"""
METRICS = f"sqrt(AVG(residual * residual)) AS rmse, AVG(abs_error) AS mae, {R2} AS r2"
METRICS_LIST = ["sqrt(AVG(residual * residual)) AS rmse", "AVG(abs_error) AS mae", f"{R2} AS r2"]
block("by_split", "errors", f"SELECT split, COUNT(*) AS row_count, {METRICS} FROM errors GROUP BY split")
block(
    "by_range",
    "ranged ranges",
    f"""SELECT g.range_no, g.time_range, COALESCE(f.n, 0) AS row_count, f.mae,
               CASE WHEN COALESCE(f.n, 0) <= 1 THEN 0.0 ELSE f.r2 END AS r2
        FROM ranges g LEFT JOIN (SELECT range_no, COUNT(*) AS n, {METRICS} FROM ranged GROUP BY range_no) f
        ON g.range_no = f.range_no""",
)
block(
    "firsts",
    "processed",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY web_order_id ORDER BY order_datetime NULLS FIRST,
               driver_id NULLS FIRST, {T} NULLS FIRST) AS place FROM processed) WHERE place = 1""",
)
block(
    "found",
    "svc_requests firsts",
    f"""SELECT q.request_id, q.position, q.driver_id, q.web_order_id, q.requested_at,
               {', '.join(f'CAST(f.{name} AS DOUBLE) AS {name}' for name in FEATURES)}
        FROM svc_requests q JOIN firsts f ON q.web_order_id = f.web_order_id""",
)
block("batch_sizes", "svc_requests", "SELECT request_id, COUNT(*) AS requested FROM svc_requests GROUP BY request_id")
block(
    "scored_all",
    "found rule default_mean",
    f"""SELECT f.*, COALESCE(c.cell_mean, (SELECT m FROM default_mean)) AS predicted_service_time,
               '{RULE_VERSION}' AS model_version
        FROM found f LEFT JOIN rule c ON f.floor = c.floor AND f.has_elevator = c.has_elevator""",
)
block("scored", "scored_all", "SELECT * FROM scored_all")
block(
    "simple_rule", "parts", f"SELECT floor, AVG({T}) AS cell_mean FROM parts WHERE split = 'train' GROUP BY floor"
)
LOG_ID = "sha256(request_id || ':' || CAST(position AS VARCHAR))"


def query(blocks: str, sql: str) -> str:
    """Prefix a statement with the blocks it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in BLOCKS[name][0]:
                visit(other)
            ordered.append(name)

    for name in blocks.split():
        visit(name)
    if not ordered:
        return sql
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({BLOCKS[name][1]})" for name in ordered) + "\n" + sql


RAW = {
    "orders": ("svc_orders", ["web_order_id", "customer_id", "warehouse_id", "order_time", "floor", "has_elevator", "is_business"]),
    "articles": ("svc_articles", ["web_order_id", "article_id", "box_id", "article_weight_in_g"]),
    "service_times": ("svc_times", ["web_order_id", "driver_id", "customer_id", "trip_id", "order_datetime", T]),
    "driver_mapping": ("svc_mapping", ["driver_id", "web_order_id"]),
}
ALL_RAW = " ".join(source for source, _ in RAW.values())
TYPES = {
    "order_time": "timestamp_ntz", "order_datetime": "timestamp_ntz", "floor": "double", T: "double",
    "article_weight_in_g": "double", "has_elevator": "boolean", "is_business": "boolean",
}


def _column_counts() -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, COUNT(*) AS row_count, {i} AS position, '{column}' AS column_name, "
        f"COUNT(*) FILTER ({column} IS NULL) AS missing_count FROM {source}"
        for table, (source, columns) in RAW.items()
        for i, column in enumerate(columns)
    )


def _structure() -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, COUNT(*) AS row_count, {i} AS position, '{column}' AS column_name, "
        f"'{TYPES.get(column, 'string')}' AS data_type FROM {source}"
        for table, (source, columns) in RAW.items()
        for i, column in enumerate(columns)
    )


def _duplicates(table: str, source: str, columns: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, CAST((SELECT COUNT(*) FROM {source}) - "
        f"(SELECT COUNT(*) FROM (SELECT DISTINCT {columns} FROM {source})) AS BIGINT) AS duplicates"
    )


def _describe(source: str, columns: list[str], exact_ends: bool = False) -> str:
    def end(function: str, column: str) -> str:
        value = f"{function}(CAST({column} AS DOUBLE))"
        return value if exact_ends else r(value)

    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT({c}) AS count, {r(f'AVG(CAST({c} AS DOUBLE))')} AS mean,
            {r(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std, {end('MIN', c)} AS min,
            {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS q25, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS q50,
            {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS q75, {end('MAX', c)} AS max FROM {source}"""
        for c in columns
    )


def _stats_by(source: str, group: str, having: str = "") -> str:
    return f"""SELECT {group}, {r(f'AVG({T})')} AS mean, {r(f'quantile_cont({T}, 0.5)')} AS median, COUNT({T}) AS count
               FROM {source} WHERE {group} IS NOT NULL GROUP BY {group} {having}"""


def _hist(source: str, value: str, bins: int = 50) -> str:
    return f"""SELECT CAST(b.bin AS INTEGER) AS bin, {r('s.low + b.bin * ((s.high - s.low) / 50)')} AS lower_edge,
               {r('s.low + (b.bin + 1) * ((s.high - s.low) / 50)')} AS upper_edge, COALESCE(c.n, 0) AS count
        FROM range(0, {bins}) b(bin) CROSS JOIN (SELECT MIN({value}) AS low, MAX({value}) AS high FROM {source}) s
        LEFT JOIN (SELECT least(CAST(floor((v - low) * {bins}.0 / (high - low)) AS INTEGER), {bins - 1}) AS bin, COUNT(*) AS n
                   FROM (SELECT {value} AS v FROM {source} WHERE {value} IS NOT NULL)
                   CROSS JOIN (SELECT MIN({value}) AS low, MAX({value}) AS high FROM {source}) GROUP BY 1) c ON b.bin = c.bin"""


def _bucket(value: str, low: str, high: str, count: int) -> str:
    return f"""CASE WHEN {value} IS NOT NULL THEN
               least(CAST(floor(COALESCE(({value} - {low}) * {float(count)} / NULLIF({high} - {low}, 0), 0)) AS INTEGER), {count - 1}) END"""


def _boxplot(source: str, value: str, by: str = "") -> str:
    keys, group = (f"{by},", f"GROUP BY {by}") if by else ("", "")
    join = f"USING ({by})" if by else "ON TRUE"
    return f"""SELECT {keys} COUNT(*) AS count, {r('MAX(q1)')} AS q1, {r('MAX(median)')} AS median, {r('MAX(q3)')} AS q3,
               {r('least(MIN(v) FILTER (inside), MAX(q1))')} AS whisker_low,
               {r('greatest(MAX(v) FILTER (inside), MAX(q3))')} AS whisker_high, COUNT(*) FILTER (NOT inside) AS outliers
        FROM (SELECT *, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
              FROM (SELECT {keys} {value} AS v FROM {source} WHERE {value} IS NOT NULL) d
              JOIN (SELECT {keys} quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
                           quantile_cont({value}, 0.75) AS q3 FROM {source} {group}) q {join}) {group}"""


def _correlations() -> str:
    def number(name: str) -> str:
        return f"CAST(CAST({name} AS INTEGER) AS DOUBLE)" if name in ("has_elevator", "is_business") else f"CAST({name} AS DOUBLE)"

    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {f'CASE WHEN var_pop({number(a)}) > 0 THEN 1.0 END' if a == b else f'corr({number(a)}, {number(b)})'} AS correlation FROM timed"
        for a in CORRELATED
        for b in CORRELATED
    )


block("matrix", "timed", _correlations())


def _horner(x: str, coefficients: list[float]) -> str:
    value = f"CAST({coefficients[-1]!r} AS DOUBLE)"
    for constant in reversed(coefficients[:-1]):
        value = f"({value} * {x} + CAST({constant!r} AS DOUBLE))"
    return value


def _inverse_normal(p: str) -> str:
    q = f"({p} - 0.5)"
    centre, root = f"(0.180625 - {q} * {q})", f"sqrt(-ln(least({p}, 1 - {p})))"
    middle, tail = f"({root} - 1.6)", f"({root} - 5.0)"
    far = (
        f"CASE WHEN {root} <= 5 THEN {_horner(middle, normal.MIDDLE_NUM)} / {_horner(middle, normal.MIDDLE_DEN)} "
        f"ELSE {_horner(tail, normal.TAIL_NUM)} / {_horner(tail, normal.TAIL_DEN)} END"
    )
    near = f"{q} * {_horner(centre, normal.CENTRE_NUM)} / {_horner(centre, normal.CENTRE_DEN)}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {near} WHEN {q} < 0 THEN -({far}) ELSE {far} END"


block(
    "qq",
    "errors",
    f"""SELECT rank, residual AS ordered_value, {_inverse_normal('p')} AS theoretical FROM (
          SELECT rank, residual, CASE WHEN rank = n THEN pow(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - pow(0.5, 1.0 / n)
                 ELSE (CAST(rank AS DOUBLE) - 0.3175) / (CAST(n AS DOUBLE) + 0.365) END AS p
          FROM (SELECT residual, row_number() OVER (ORDER BY residual) AS rank, COUNT(*) OVER () AS n FROM errors))""",
)


def _by_measure() -> str:
    parts = []
    for name in ("total_weight_g", "total_boxes", "total_articles"):
        value = f"CAST({name} AS DOUBLE)"
        bucket = _bucket("m", "low", "high", 20)
        parts.append(
            f"""SELECT '{name}' AS measure, bucket, {r(f'AVG({T})')} AS mean, {r(f'quantile_cont({T}, 0.5)')} AS median, COUNT({T}) AS count
                FROM (SELECT {T}, {bucket} AS bucket FROM (SELECT {T}, {value} AS m FROM explored)
                      CROSS JOIN (SELECT MIN({value}) AS low, MAX({value}) AS high FROM explored))
                WHERE {T} IS NOT NULL AND bucket IS NOT NULL GROUP BY bucket"""
        )
    return " UNION ALL ".join(parts)


def _feature_errors() -> str:
    parts = []
    for name in FEATURES:
        value = f"CAST({name} AS DOUBLE)"
        parts.append(
            f"""SELECT '{name}' AS feature, {_bucket('m', 'low', 'high', 20)} AS bucket, COUNT(*) AS count,
                       {r('AVG(abs_error)')} AS mean_abs_error, {r('MAX(overall)')} AS overall_mae
                FROM (SELECT abs_error, {value} AS m FROM errors)
                CROSS JOIN (SELECT MIN({value}) AS low, MAX({value}) AS high, AVG(abs_error) AS overall FROM errors)
                WHERE m IS NOT NULL GROUP BY 1, 2"""
        )
    return " UNION ALL ".join(parts)


def _drift() -> str:
    parts = []
    for name in FEATURES:
        value = f"CAST({name} AS DOUBLE)"
        bucket = f"greatest({_bucket('m', 'low', 'high', 10)}, 0)"
        span = f"CROSS JOIN (SELECT MIN({value}) AS low, MAX({value}) AS high FROM processed)"

        def shares(source: str) -> str:
            return f"""(SELECT b, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER () AS share FROM (SELECT {bucket} AS b
                        FROM (SELECT {value} AS m FROM {source} WHERE {name} IS NOT NULL) {span}) GROUP BY b)"""

        parts.append(
            f"""SELECT '{name}' AS feature, {r('SUM((q - p) * ln(q / p))')} AS psi FROM (
                  SELECT greatest(COALESCE(x.share, 0), 0.0001) AS p, greatest(COALESCE(y.share, 0), 0.0001) AS q
                  FROM range(0, 10) g(b) LEFT JOIN {shares('processed')} x ON g.b = x.b LEFT JOIN {shares('scored')} y ON g.b = y.b)"""
        )
    return " UNION ALL ".join(parts)


def _distance() -> str:
    parts = []
    for name in FEATURES:
        value = f"CAST({name} AS DOUBLE)"
        parts.append(
            f"""SELECT '{name}' AS feature, MAX(gap) AS gap_, arg_min(v, (-gap, v)) AS v_, MAX(na) AS na, MAX(nb) AS nb FROM (
                  SELECT v, abs(SUM(a) OVER w / SUM(a) OVER () - SUM(b) OVER w / SUM(b) OVER ()) AS gap, SUM(a) OVER () AS na, SUM(b) OVER () AS nb
                  FROM (SELECT v, SUM(a) AS a, SUM(b) AS b FROM (SELECT {value} AS v, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM processed UNION ALL
                        SELECT {value}, 0.0, 1.0 FROM scored) WHERE v IS NOT NULL GROUP BY v) WINDOW w AS (ORDER BY v))"""
        )
    return f"""SELECT feature, {r('gap_', 6)} AS distance, {r('v_', 6)} AS value, CAST(na AS BIGINT) AS training_count, CAST(nb AS BIGINT) AS recent_count
               FROM ({' UNION ALL '.join(parts)}) WHERE na + nb > 0"""


def _hexagons() -> str:
    return f"""WITH placed AS (SELECT *, ({T} - xl) / xw AS ix, (predicted - yl) / yw AS iy FROM errors CROSS JOIN (
                 SELECT MIN({T}) AS xl, COALESCE(NULLIF(MAX({T}) - MIN({T}), 0), 1) / 50 AS xw, MIN(predicted) AS yl,
                        COALESCE(NULLIF(MAX(predicted) - MIN(predicted), 0), 1) / 28 AS yw FROM errors)),
               near AS (SELECT *, pow(ix - floor(ix + 0.5), 2) + 3 * pow(iy - floor(iy + 0.5), 2) <= pow(ix - floor(ix) - 0.5, 2) + 3 * pow(iy - floor(iy) - 0.5, 2) AS first FROM placed),
               halves AS (SELECT xl, xw, yl, yw, CAST(CASE WHEN first THEN 2 * floor(ix + 0.5) ELSE 2 * floor(ix) + 1 END AS BIGINT) AS x_half,
                                 CAST(CASE WHEN first THEN 2 * floor(iy + 0.5) ELSE 2 * floor(iy) + 1 END AS BIGINT) AS y_half FROM near)
               SELECT x_half, y_half, {r('MAX(xl + x_half * (xw / 2))')} AS x_centre, {r('MAX(yl + y_half * (yw / 2))')} AS y_centre, COUNT(*) AS count FROM halves GROUP BY x_half, y_half"""


def _values(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"({a}, {b})" for a, b in pairs)


DELIVERED = """SELECT *, least(3, floor((extract(day FROM "timestamp") - 1) / 8) + CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END) AS delivery FROM svc_logs"""


def all_sql() -> dict[str, str]:
    measures = ", ".join(MEASURES)
    counts = "CAST(total_boxes AS DOUBLE) AS total_boxes, CAST(total_articles AS DOUBLE) AS total_articles"
    parts_of_time = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("order_hour", "order_day_of_week", "order_month"))
    rounded_measures = f"* REPLACE ({r('avg_article_weight_g')} AS avg_article_weight_g, {counts})"
    rounded_derived = f"""* REPLACE ({r('avg_article_weight_g')} AS avg_article_weight_g, {r('weight_per_box')} AS weight_per_box,
                          {counts}, {parts_of_time})"""
    keys = "web_order_id, driver_id"
    sql: dict[str, str] = {}

    for table, (source, columns) in RAW.items():
        sql[f"scan_{table}"] = query(source, f"SELECT {', '.join(columns)} FROM {source}")
    sql["data_summary"] = query(ALL_RAW, _column_counts())
    sql["missing_values"] = query(
        ALL_RAW,
        f"""SELECT table_name, column_name, missing_count, {r('missing_count / row_count * 100')} AS missing_pct
            FROM ({_column_counts()}) WHERE missing_count > 0""",
    )
    sql["duplicate_counts"] = query(
        ALL_RAW,
        " UNION ALL ".join(
            [
                _duplicates("orders", "svc_orders", "web_order_id"),
                _duplicates("service_times", "svc_times", "web_order_id"),
                _duplicates("driver_mapping", "svc_mapping", "driver_id, web_order_id"),
                _duplicates("articles", "svc_articles", "web_order_id"),
            ]
        ),
    )
    sql["table_structure"] = query(ALL_RAW, _structure())
    sql["table_preview"] = query("svc_orders", "SELECT * FROM svc_orders ORDER BY web_order_id LIMIT 5")
    for name, order in PREVIEWS.items():
        sql[f"preview_{name}"] = query(RAW[name][0], f"SELECT * FROM {RAW[name][0]} ORDER BY {', '.join(f'{c} NULLS FIRST' for c in order)} LIMIT 5")
    sql["nonpositive_targets"] = query("svc_times", f"SELECT COUNT(*) AS nonpositive FROM svc_times WHERE {T} <= 0")
    stages = [
        ("start", "SELECT COUNT(*) FROM svc_times"),
        ("orders_joined", "SELECT COUNT(*) FROM with_orders"),
        ("articles_joined", "SELECT COUNT(*) FROM explored"),
        ("mapping_joined", "SELECT COUNT(*) FROM joined"),
        ("target_known", f"SELECT COUNT({T}) FROM joined"),
        ("target_positive", "SELECT COUNT(*) FROM positive"),
        ("outliers_removed", "SELECT COUNT(*) FROM parts"),
        ("train", "SELECT COUNT(*) FROM parts WHERE split = 'train'"),
        ("val", "SELECT COUNT(*) FROM parts WHERE split = 'val'"),
        ("test", "SELECT COUNT(*) FROM parts WHERE split = 'test'"),
    ]
    sql["row_funnel"] = query(
        "parts",
        " UNION ALL ".join(
            f"""SELECT CAST({i} AS INTEGER) AS stage_no, '{name}' AS stage, ({count}) AS row_count,
                (SELECT {r('lower')} FROM limits) AS lower_bound, (SELECT {r('upper')} FROM limits) AS upper_bound"""
            for i, (name, count) in enumerate(stages)
        ),
    )

    sql["clean_target"] = query("positive_visits", f"SELECT {keys}, {T} FROM positive_visits")
    sql["fill_missing"] = query(
        "filled", f"SELECT {rounded_measures} FROM (SELECT {keys}, floor, has_elevator, is_business, {measures} FROM filled)"
    )
    sql["time_features"] = query(
        "timed_orders", f"SELECT {keys}, order_time, {parts_of_time}, is_weekend FROM timed_orders"
    )
    sql["interaction_features"] = query(
        "derived",
        f"""SELECT {keys}, {r('weight_per_box')} AS weight_per_box, floor_elevator_interaction, business_floor_interaction,
            has_elevator, is_business FROM derived""",
    )
    sql["feature_matrix"] = query(
        "processed", f"SELECT {rounded_derived} FROM (SELECT {keys}, {', '.join(FEATURES)}, {T} FROM processed)"
    )
    sql["join_orders"] = query("with_orders", "SELECT * FROM with_orders")
    sql["join_articles"] = query(
        "svc_times article_totals",
        f"""SELECT {rounded_measures} FROM (SELECT s.*, {', '.join('a.' + m for m in MEASURES)} FROM svc_times s
            LEFT JOIN article_totals a ON s.web_order_id = a.web_order_id)""",
    )
    mapped = """FROM svc_times s LEFT JOIN svc_mapping m ON s.driver_id = m.driver_id
                AND s.web_order_id = m.web_order_id"""
    sql["join_mapping"] = query("svc_times svc_mapping", f"SELECT s.* {mapped}")
    sql["mapping_check"] = query(
        "svc_times svc_mapping",
        f"""SELECT CASE WHEN m.web_order_id IS NULL THEN 'left_only' ELSE 'both' END AS mapping_check,
            COUNT(*) AS row_count {mapped} GROUP BY 1""",
    )
    sql["join_datasets_hot"] = query(
        "crowd_times crowd_orders article_totals svc_mapping",
        f"""SELECT s.web_order_id, s.driver_id, s.{T}, o.floor, CAST(a.total_articles AS DOUBLE) AS total_articles
            FROM crowd_times s LEFT JOIN article_totals a ON s.web_order_id = a.web_order_id
            LEFT JOIN svc_mapping m ON s.driver_id = m.driver_id AND s.web_order_id = m.web_order_id
            LEFT JOIN crowd_orders o ON s.web_order_id = o.web_order_id""",
    )
    order = ", ".join(f"{c} NULLS FIRST" for c in ("order_datetime", "driver_id", T, "customer_id", "trip_id"))
    sql["first_per_order_hot"] = query(
        "crowd_times",
        f"""SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY web_order_id ORDER BY {order}) AS place
            FROM crowd_times WHERE web_order_id IS NOT NULL) WHERE place = 1""",
    )
    sql["duplicate_counts_hot"] = query(
        "crowd_times crowd_orders svc_mapping svc_articles",
        " UNION ALL ".join(
            [
                _duplicates("orders", "crowd_orders", "web_order_id"),
                _duplicates("service_times", "crowd_times", "web_order_id"),
                _duplicates("driver_mapping", "svc_mapping", "driver_id, web_order_id"),
                _duplicates("articles", "svc_articles", "web_order_id"),
            ]
        ),
    )
    sql["join_datasets"] = query("joined", f"SELECT {rounded_measures} FROM joined")
    sql["aggregate_articles"] = query("article_totals", f"SELECT {rounded_measures} FROM article_totals")
    sql["remove_outliers"] = query(
        "positive_visits positive_visit_limits",
        f"""SELECT {keys}, {T} FROM positive_visits
            WHERE {T} BETWEEN (SELECT lower FROM positive_visit_limits) AND (SELECT upper FROM positive_visit_limits)""",
    )
    outside = f"({T} < (SELECT lower FROM explored_limits) OR {T} > (SELECT upper FROM explored_limits))"
    sql["detect_outliers"] = query(
        "explored explored_limits",
        f"""SELECT COUNT(*) AS row_count, COUNT(*) FILTER ({outside}) AS outlier_count,
                   (SELECT {r('lower')} FROM explored_limits) AS lower_bound, (SELECT {r('upper')} FROM explored_limits) AS upper_bound,
                   {r(f'COUNT(*) FILTER ({outside}) / COUNT(*) * 100')} AS outlier_pct,
                   COUNT(*) - COUNT(*) FILTER ({outside}) AS kept_count FROM explored""",
    )
    sql["clean_data"] = query("cleaned", f"SELECT {rounded_measures} FROM cleaned")
    sql["create_features"] = query("derived", f"SELECT {rounded_derived} FROM derived")
    sql["processed_dataset"] = query("processed", f"SELECT {rounded_derived} FROM processed")
    sql["load_processed"] = sql["processed_dataset"]
    sql["load_target"] = query("processed", f"SELECT {T} FROM processed")
    sql["impute_median"] = query(
        "with_orders",
        f"SELECT {keys}, {r('COALESCE(floor, (SELECT quantile_cont(floor, 0.5) FROM with_orders))')} AS floor FROM with_orders",
    )

    sql["describe_target"] = query("svc_times", _describe("svc_times", [T], exact_ends=True))
    sql["describe_numeric"] = query("explored", _describe("explored", [T, "floor", *MEASURES]))
    sql["describe_features"] = query("processed", _describe("processed", [*FEATURES, T]))
    sql["target_quantiles"] = query(
        "svc_times",
        " UNION ALL ".join(
            f"SELECT CAST({q} AS DOUBLE) AS probability, {r(f'quantile_cont({T}, {q})')} AS value FROM svc_times"
            for q in TARGET_QUANTILES
        ),
    )
    sql["stats_by_hour"] = query("timed_orders", _stats_by("timed_orders", "order_hour"))
    days = listed(WEEKDAYS, "order_day_of_week", "weekday")
    sql["stats_by_weekday"] = query(
        "timed_orders",
        f"SELECT s.*, d.weekday FROM ({_stats_by('timed_orders', 'order_day_of_week')}) s JOIN ({days}) d USING (order_day_of_week)",
    )
    sql["stats_by_elevator"] = query("with_orders", _stats_by("with_orders", "has_elevator"))
    sql["stats_by_business"] = query("with_orders", _stats_by("with_orders", "is_business"))
    sql["stats_by_floor"] = query("with_orders", _stats_by("with_orders", "floor", f"HAVING COUNT({T}) >= 10"))
    sql["floor_elevator_mean"] = query(
        "with_orders",
        f"""SELECT has_elevator, floor, {r(f'AVG({T})')} AS mean FROM with_orders
            WHERE has_elevator IS NOT NULL AND floor IS NOT NULL GROUP BY has_elevator, floor""",
    )
    sql["value_counts"] = query(
        "with_orders",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count,
                {r('COUNT(*) / SUM(COUNT(*)) OVER ()')} AS proportion FROM with_orders WHERE {c} IS NOT NULL GROUP BY {c}"""
            for c in ("has_elevator", "is_business")
        ),
    )
    sql["top_floors"] = query(
        "with_orders",
        """SELECT floor, COUNT(*) AS count FROM with_orders WHERE floor IS NOT NULL
           GROUP BY floor ORDER BY count DESC, floor LIMIT 10""",
    )
    sql["weight_class_stats"] = query(
        "explored",
        f"""SELECT l.class_no, l.weight_class, {r('m.mean')} AS mean FROM ({listed(WEIGHT_CLASSES, 'class_no', 'weight_class')}) l
            LEFT JOIN (SELECT CAST(greatest(least(ceil((total_weight_g - low) / ((high - low) / 5.0)) - 1, 4), 0) AS INTEGER) AS class_no,
                              AVG({T}) AS mean
                       FROM explored CROSS JOIN (SELECT MIN(total_weight_g) AS low, MAX(total_weight_g) AS high FROM explored)
                       WHERE total_weight_g IS NOT NULL GROUP BY 1) m USING (class_no)""",
    )
    sql["correlation_matrix"] = query("matrix", f"SELECT column_a, column_b, {r('correlation')} AS correlation FROM matrix")
    of_target = f"SELECT column_b AS feature, correlation FROM matrix WHERE column_a = '{T}'"
    others = f"{of_target} AND column_b <> '{T}'"
    sql["target_correlations"] = query("matrix", f"SELECT feature, {r('correlation')} AS correlation FROM ({of_target})")
    sql["top_correlations"] = query(
        "matrix",
        f"""SELECT feature, {r('correlation')} AS correlation, CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction
            FROM (SELECT * FROM ({others}) ORDER BY abs(correlation) DESC, feature LIMIT 10)""",
    )
    sql["top5_correlations"] = query(
        "matrix",
        f"SELECT feature, {r('correlation')} AS correlation FROM (SELECT * FROM ({others}) ORDER BY correlation DESC, feature LIMIT 5)",
    )
    sql["target_by_measure"] = query("explored", _by_measure())
    time_columns = ["order_hour", "order_day_of_week", "order_month", "is_weekend"]
    frame_columns = [
        "web_order_id", "driver_id", "customer_id", "trip_id", "order_datetime", T, "customer_id_order", "warehouse_id",
        "order_time", "floor", "has_elevator", "is_business", *MEASURES, *time_columns,
    ]
    missing = " + ".join(f"COUNT(*) FILTER ({c} IS NULL)" for c in frame_columns)
    sql["eda_summary"] = query(
        "timed explored_limits",
        f"""SELECT COUNT(*) AS row_count, CAST({len(frame_columns)} AS INTEGER) AS column_count, {missing} AS missing_total,
                   COUNT(*) FILTER ({outside}) AS outlier_count, {r(f'AVG({T})')} AS mean, {r(f'stddev_samp({T})')} AS std,
                   MIN({T}) AS min, MAX({T}) AS max, {r(f'COUNT(*) FILTER ({outside}) / COUNT(*) * 100')} AS outlier_pct,
                   {r(f'quantile_cont({T}, 0.5)')} AS median FROM timed""",
    )

    sql["target_hist"] = query("svc_times", _hist("svc_times", T))
    sql["log_target_hist"] = query("positive_visits", _hist("positive_visits", f"ln(1 + {T})"))
    kept = f"""(SELECT * FROM svc_times WHERE {T} BETWEEN (SELECT lower FROM visit_limits) AND (SELECT upper FROM visit_limits))"""
    sql["inlier_target_hist"] = query("svc_times visit_limits", _hist(kept, T))
    sql["residual_hist"] = query("errors", _hist("errors", "residual"))
    sql["boxplot_target"] = query("svc_times", _boxplot("svc_times", T))
    sql["boxplot_error_by_range"] = query(
        "ranged ranges",
        f"""SELECT g.range_no, g.time_range, COALESCE(b.count, 0) AS count, b.q1, b.median, b.q3, b.whisker_low, b.whisker_high,
                   COALESCE(b.outliers, 0) AS outliers
            FROM ranges g LEFT JOIN ({_boxplot('ranged', 'abs_error', 'range_no')}) b USING (range_no)""",
    )
    ecdf = """SELECT v AS value, n AS count, CAST(SUM(n) OVER (ORDER BY v) AS BIGINT) AS upto,
              CAST(SUM(n) OVER (ORDER BY v) AS DOUBLE) / SUM(n) OVER () AS share FROM (SELECT {value} AS v, COUNT(*) AS n
              FROM {source} WHERE {value} IS NOT NULL GROUP BY 1)"""
    sql["target_ecdf"] = query(
        "svc_times",
        f"SELECT value, count, upto, {r('share', 8)} AS cumulative FROM ({ecdf.format(value=T, source='svc_times')})",
    )
    sql["error_ecdf"] = query(
        "errors",
        f"""SELECT {r('value')} AS value, count, upto, {r('share * 100')} AS cumulative
            FROM ({ecdf.format(value='abs_error', source='errors')})""",
    )
    sql["hexagon_density"] = query("errors", f"SELECT * FROM ({_hexagons()})")
    sql["density_grid"] = query(
        "errors",
        f"""SELECT {_bucket(T, 'xl', 'xh', 50)} AS {T}_cell, {_bucket('predicted', 'yl', 'yh', 50)} AS predicted_cell, COUNT(*) AS count
            FROM errors CROSS JOIN (SELECT MIN({T}) AS xl, MAX({T}) AS xh, MIN(predicted) AS yl, MAX(predicted) AS yh FROM errors)
            GROUP BY 1, 2""",
    )
    sql["qq_residuals"] = query(
        "qq", f"SELECT rank, {r('theoretical')} AS theoretical, {r('ordered_value')} AS ordered_value FROM qq"
    )
    sql["qq_line"] = query(
        "qq",
        f"""SELECT {r('regr_slope(ordered_value, theoretical)')} AS slope, {r('regr_intercept(ordered_value, theoretical)')} AS intercept,
            {r('corr(ordered_value, theoretical)')} AS correlation FROM qq""",
    )

    sql["split_counts"] = query("parts", "SELECT split, COUNT(*) AS row_count FROM parts GROUP BY split")
    sql["split_rows"] = query("parts", f"SELECT {keys}, split FROM parts")
    sql["sample_5pct"] = query(
        "processed",
        f"""SELECT {keys}, {T} FROM (SELECT *, row_number() OVER (ORDER BY digest, {keys}, {T}) AS place, COUNT(*) OVER () AS n
              FROM (SELECT {keys}, {T}, md5('42:' || web_order_id || ':' || driver_id || ':' ||
                    CAST(CAST(floor({T} * 1000000) AS BIGINT) AS VARCHAR)) AS digest FROM processed))
            WHERE place <= floor(n * 0.05)""",
    )
    sql["residuals"] = query(
        "errors",
        f"SELECT {keys}, split, {T}, {r('predicted')} AS predicted, {r('residual')} AS residual, {r('abs_error')} AS abs_error FROM errors",
    )
    metric_columns = f"{r('rmse')} AS rmse, {r('mae')} AS mae, {r('r2')} AS r2"
    sql["evaluate_by_split"] = query("by_split", f"SELECT split, row_count, {metric_columns} FROM by_split")
    whole = ", ".join(
        f"{r(f'MAX({m}) FILTER (split = {chr(39)}{part}{chr(39)})')} AS {part}_{m}"
        for part in ("train", "val", "test")
        for m in ("rmse", "mae", "r2")
    )
    sql["combined_metrics"] = query("by_split", f"SELECT {whole} FROM by_split")
    verdict = "CASE WHEN r2 > 0.8 THEN 'EXCELLENT' WHEN r2 > 0.6 THEN 'GOOD' WHEN r2 > 0.4 THEN 'FAIR' ELSE 'POOR' END AS rating"
    sql["model_rating"] = query("by_split", f"SELECT split, {r('r2')} AS r2, {verdict} FROM by_split")
    sql["mae_by_range"] = query("by_range", f"SELECT range_no, time_range, {r('mae')} AS mae FROM by_range")
    sql["count_by_range"] = query("by_range", "SELECT range_no, time_range, row_count FROM by_range")
    sql["r2_by_range"] = query("by_range", f"SELECT range_no, time_range, {r('r2')} AS r2 FROM by_range")
    sql["feature_vs_error"] = query("errors", _feature_errors())
    sql["residuals_by_prediction"] = query(
        "errors",
        f"""SELECT {_bucket('predicted', 'low', 'high', 20)} AS bucket, COUNT(*) AS count, {r('AVG(residual)')} AS mean_residual,
                   {r('stddev_samp(residual)')} AS std_residual, {r('AVG(abs_error)')} AS mean_abs_error
            FROM errors CROSS JOIN (SELECT MIN(predicted) AS low, MAX(predicted) AS high FROM errors) GROUP BY 1""",
    )
    sql["error_percentiles"] = query(
        "errors",
        " UNION ALL ".join(
            f"SELECT CAST({p} AS INTEGER) AS percentile, {r(f'quantile_cont(abs_error, {p / 100})')} AS abs_error FROM errors"
            for p in ERROR_PERCENTILES
        ),
    )
    sql["evaluation_summary"] = query(
        "errors",
        f"""SELECT row_count, {metric_columns}, {r('max_error')} AS max_error, {r('median_error')} AS median_error,
                   {r('p90_error')} AS p90_error, {verdict}
            FROM (SELECT COUNT(*) AS row_count, {METRICS}, MAX(abs_error) AS max_error, quantile_cont(abs_error, 0.5) AS median_error,
                  quantile_cont(abs_error, 0.9) AS p90_error FROM errors)""",
    )

    sql["first_per_order"] = query("firsts", f"SELECT {keys}, order_datetime, {T}, floor FROM firsts")
    place = "request_id, position, driver_id, web_order_id"
    sql["feature_lookup"] = query(
        "found", f"SELECT {rounded_derived} FROM (SELECT {place}, {', '.join(FEATURES)} FROM found)"
    )
    sql["lookup_rejects"] = query(
        "svc_requests firsts",
        f"SELECT {place} FROM svc_requests q WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.web_order_id = q.web_order_id)",
    )
    sql["score_batch_rule"] = query(
        "scored", f"SELECT {place}, {r('predicted_service_time')} AS predicted_service_time, model_version FROM scored"
    )
    sql["batch_response"] = query(
        "batch_sizes found scored",
        """SELECT b.request_id, b.requested, COALESCE(k.known, 0) AS known,
                  CASE WHEN b.requested > 100 THEN 'batch too large' WHEN COALESCE(k.known, 0) = 0 THEN 'no valid orders'
                       ELSE 'ok' END AS status, CAST(s.page AS DOUBLE) AS page, s.predictions, CAST(s.total_count AS DOUBLE) AS total_count, s."timestamp"
           FROM batch_sizes b LEFT JOIN (SELECT request_id, COUNT(*) AS known FROM found GROUP BY request_id) k
             ON b.request_id = k.request_id
           LEFT JOIN (SELECT request_id, position // 100 AS page, COUNT(*) AS total_count, MAX(requested_at) AS "timestamp",
                        string_agg(position || ':' || web_order_id || ':' || CAST(round(predicted_service_time * 10000) AS BIGINT), ',' ORDER BY position) AS predictions
                      FROM scored GROUP BY request_id, position // 100) s
             ON b.request_id = s.request_id""",
    )
    sql["feature_log_rows"] = query(
        "scored",
        f"""SELECT {rounded_derived} FROM (SELECT {LOG_ID} AS id, requested_at AS "timestamp", web_order_id, driver_id, model_version,
            {', '.join(FEATURES)} FROM scored)""",
    )
    log_columns = f"""{LOG_ID} AS id, requested_at AS "timestamp", web_order_id, driver_id,
                      {r('predicted_service_time')} AS predicted_service_time, model_version, request_id"""
    sql["prediction_log_rows"] = query("scored", f"SELECT {log_columns}, CAST(requested_at AS DATE) AS log_date FROM scored")
    sql["get_features"] = query(
        "scored",
        f"""SELECT {LOG_ID} AS id, requested_at AS "timestamp", web_order_id, driver_id, model_version FROM scored
            WHERE driver_id = 'D7' ORDER BY requested_at DESC, id DESC LIMIT 100""",
    )
    sql["get_predictions"] = query(
        "svc_logs", """SELECT * FROM svc_logs WHERE driver_id = 'D3' ORDER BY "timestamp" DESC, id DESC LIMIT 100"""
    )
    sql["prediction_statistics"] = query(
        "svc_logs",
        f"""SELECT 'all' AS level, CAST(NULL AS VARCHAR) AS model_version, COUNT(*) AS predictions,
                   {r('AVG(predicted_service_time)')} AS avg_prediction FROM svc_logs
            UNION ALL
            SELECT 'version', model_version, COUNT(*), {r('AVG(predicted_service_time)')} FROM svc_logs GROUP BY model_version""",
    )
    sql["log_retention"] = query(
        "scored",
        """SELECT CAST(requested_at AS DATE) AS log_date, COUNT(*) AS row_count FROM scored
           WHERE CAST(requested_at AS DATE) >= DATE '2024-01-31' - 14 GROUP BY 1""",
    )
    sql["compare_versions"] = query(
        "scored simple_rule default_mean",
        f"""SELECT COUNT(*) AS row_count, {r('AVG(gap)')} AS mean_difference, {r('AVG(abs(gap))')} AS mean_abs_difference,
                   {r('MAX(abs(gap))')} AS max_abs_difference
            FROM (SELECT s.predicted_service_time - COALESCE(c.cell_mean, (SELECT m FROM default_mean)) AS gap
                  FROM scored s LEFT JOIN simple_rule c ON s.floor = c.floor)""",
    )
    sql["monitor_accuracy"] = query(
        "svc_logs positive_visits",
        f"""SELECT model_version, COUNT(*) AS row_count, {r('sqrt(AVG(residual * residual))')} AS rmse,
                   {r('AVG(abs(residual))')} AS mae, {r(R2)} AS r2
            FROM (SELECT l.model_version, t.{T}, t.{T} - l.predicted_service_time AS residual FROM svc_logs l
                  JOIN (SELECT web_order_id, AVG({T}) AS {T} FROM positive_visits GROUP BY web_order_id) t
                    ON l.web_order_id = t.web_order_id) GROUP BY model_version""",
    )
    wanted = "web_order_id IN (" + ", ".join(f"'{i}'" for i in WANTED) + ")"
    sql["batch_totals"] = query(
        "scored_all",
        """SELECT request_id, COUNT(*) AS total_count, COUNT(DISTINCT position // 100) AS pages, COUNT(*) AS listed, MAX(requested_at) AS "timestamp"
           FROM scored_all GROUP BY request_id""",
    )
    sql["log_of_orders"] = query("svc_logs", f"SELECT * REPLACE (CAST(id AS VARCHAR) AS id) FROM svc_logs WHERE {wanted}")
    looked = [f"CAST({c} AS DOUBLE)" for c in FEATURES]
    sql["order_features"] = query(
        "firsts",
        "SELECT web_order_id, " + ", ".join(f"{r(v) if c in ('avg_article_weight_g', 'weight_per_box') else v} AS {c}" for c, v in zip(FEATURES, looked)) + f" FROM firsts WHERE {wanted}",
    )
    sql["predictions_as_of"] = query("as_of", "SELECT * FROM as_of")
    sql["accuracy_as_of"] = query(
        "as_of",
        f"""SELECT model_version, COUNT(*) AS row_count, {r('sqrt(AVG(residual * residual))')} AS rmse, {r('AVG(abs(residual))')} AS mae, {r(R2)} AS r2
            FROM (SELECT *, {T} - predicted AS residual FROM as_of WHERE {T} > 0 AND predicted IS NOT NULL) GROUP BY model_version""",
    )
    sql["feature_distance"] = query("processed scored", _distance())
    sql["cross_validate_rule"] = query(
        "processed",
        f"""SELECT fold, COUNT(*) AS row_count, {", ".join(f"{r(v.rsplit(' AS ', 1)[0])} AS {v.rsplit(' AS ', 1)[1]}" for v in METRICS_LIST)} FROM (
              SELECT e.*, {T} - predicted AS residual, abs({T} - predicted) AS abs_error FROM (
                SELECT p.fold, p.{T}, COALESCE((SELECT AVG(q.{T}) FROM folded q WHERE q.fold <> p.fold AND q.floor = p.floor AND q.has_elevator = p.has_elevator),
                       (SELECT AVG(q.{T}) FROM folded q WHERE q.fold <> p.fold)) AS predicted FROM folded p) e) GROUP BY fold""".replace(
            " folded ", " (SELECT *, CAST(CAST('0x' || substr(md5('fold-42:' || web_order_id), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM processed) "
        ),
    )
    sql["feature_drift"] = query("processed scored", _drift())
    sql["run_metrics"] = query(
        "by_split",
        f"""SELECT '{RULE_VERSION}' AS model_version, 'rule' AS model_type, """
        + ", ".join(
            f"{r(f'MAX({m}) FILTER (split = {chr(39)}{part}{chr(39)})')} AS {name}_{m}"
            for part, name in (("train", "training"), ("test", "testing"))
            for m in ("rmse", "mae", "r2")
        )
        + " FROM by_split",
    )
    sql["stream_scores"] = query("scored_all", f"SELECT {log_columns} FROM scored_all")
    sql["stream_statistics"] = query(
        "svc_logs",
        f"""SELECT date_trunc('hour', "timestamp") AS window_start, date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS window_end,
                   model_version, COUNT(*) AS predictions, {r('AVG(predicted_service_time)', 8)} AS avg_prediction
            FROM svc_logs GROUP BY 1, 2, 3""",
    )
    sql["stream_windows"] = query(
        "svc_logs",
        f"""SELECT window_start, window_end, model_version, COUNT(*) AS predictions, {r('AVG(predicted_service_time)', 8)} AS avg_prediction,
                   CAST(COUNT(*) FILTER (window_end <= seen - INTERVAL 1 DAY) AS BIGINT) AS late,
                   window_end <= (SELECT MAX("timestamp") - INTERVAL 1 DAY FROM svc_logs) AS closed
            FROM (SELECT d.*, date_trunc('hour', d."timestamp") AS window_start, date_trunc('hour', d."timestamp") + INTERVAL 1 HOUR AS window_end,
                         (SELECT MAX(e.latest) FROM (SELECT delivery, MAX("timestamp") AS latest FROM delivered GROUP BY delivery) e WHERE e.delivery < d.delivery) AS seen
                  FROM delivered d) GROUP BY 1, 2, 3""".replace(
            "FROM delivered", f"FROM ({DELIVERED})"
        ),
    )
    sql["join_bucketed"], sql["join_bucketed_hot"] = sql["join_datasets"], sql["join_datasets_hot"]
    return sql
