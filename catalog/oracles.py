"""Plain SQL (DuckDB) for the registered queries, written the naive way:
full cross joins and unlimited windows, independent of the Spark plans."""

from __future__ import annotations

from catalog import settings as S
from rebuy.config import HybridConfig, metadata_levels
from rebuy.sources.star_schema import event_shift_days

RATE = "DECIMAL(18,12)"


def strength(column: str = "points") -> str:
    """What totals are ranked by: relative differences below 1e-10 are noise of summation."""
    return f"round(CASE WHEN {column} > 0 THEN ln({column}) END, 10) DESC NULLS LAST"


def shares(score: str) -> str:
    """Scores relative to a best one, to 11 digits."""
    return f"CAST(floor(({score}) * CAST(1e11 AS DOUBLE) + 0.5) AS BIGINT)"


def points(score: str) -> str:
    """Scores in whole billionths."""
    return f"CAST(floor(({score}) * CAST(1e9 AS DOUBLE) + 0.5) AS BIGINT)"



class Sql:
    """A growing list of named CTEs."""

    def __init__(self) -> None:
        self.parts: dict[str, str] = {}

    def add(self, name: str, body: str) -> str:
        self.parts.setdefault(name, body)
        return name

    def select(self, body: str) -> str:
        ctes = ",\n".join(f"{name} AS (\n{text}\n)" for name, text in self.parts.items())
        return f"WITH {ctes}\n{body}"


def tables(q: Sql, variant: str, cutoff: str = S.CUTOFF) -> None:
    style = variant == "style"
    item = "p_name" if style else "CAST(l_partkey AS VARCHAR)"
    part = "JOIN part ON l_partkey = p_partkey" if style else ""
    q.add(
        "tx",
        f"""SELECT o_custkey AS customer_id, {item} AS item_id, o_orderkey AS bill_id, l_quantity AS quantity,
        l_extendedprice / l_quantity AS price, CAST(s_nationkey AS BIGINT) AS location, o_orderdate AS updated_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey {part}""",
    )
    k = "json_extract_string(props, '$.k')"
    ev_item = "p_name" if style else k
    ev_part = f"JOIN part ON CAST(p_partkey AS VARCHAR) = {k}" if style else ""
    q.add(
        "ev",
        f"""SELECT user_id AS customer_id, {ev_item} AS item_id,
        CASE event_type WHEN 'view' THEN 'view_item' WHEN 'click' THEN 'add_to_cart' ELSE event_type END AS event_type,
        floor(value / 50) AS quantity, ts - INTERVAL {event_shift_days(cutoff)} DAY AS event_date
        FROM events {ev_part}""",
    )
    if style:
        q.add(
            "items",
            """SELECT p_name AS item_id, CAST(NULL AS VARCHAR) AS category_l1, split_part(p_name, ' ', 1) AS category_l2,
            split_part(p_name, ' ', 2) AS category_l3, split_part(p_name, ' ', 1) AS brand,
            CAST(sum(CAST(p_retailprice AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS price FROM part GROUP BY p_name""",
        )
    else:
        q.add(
            "items",
            """SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_type AS category_l1, split_part(p_name, ' ', 1) AS category_l2,
            split_part(p_name, ' ', 2) AS category_l3, p_brand AS brand, p_retailprice AS price FROM part""",
        )


def age(column: str, anchor: str) -> str:
    return f"greatest((epoch_us(TIMESTAMP '{anchor}') - epoch_us({column})) // 86400000000, 0)"


def decay(column: str, cfg: HybridConfig) -> str:
    return f"(1 + ln(greatest(quantity, 1))) * exp(-CAST({age(column, cfg.cutoff)} AS DOUBLE) / {float(cfg.half_life_days)})"


VALID = "item_id IS NOT NULL AND item_id NOT IN ('', '(not set)')"


def signals(q: Sql, cfg: HybridConfig, p: str = "") -> None:
    q.add(
        f"{p}bought",
        f"""SELECT customer_id, item_id, 'purchase' AS signal, updated_date AS signal_date,
        {'CAST(8.0 AS DOUBLE) * ' + decay('updated_date', cfg)} AS points
        FROM tx WHERE updated_date < TIMESTAMP '{cfg.cutoff}' AND {VALID}""",
    )
    q.add(
        f"{p}browsed",
        f"""SELECT customer_id, item_id, event_type AS signal, event_date AS signal_date,
        {"CAST(CASE WHEN event_type = 'add_to_cart' THEN 3.0 ELSE 1.0 END AS DOUBLE) * " + decay('event_date', cfg)} AS points
        FROM ev WHERE event_date >= TIMESTAMP '{cfg.event_start}' AND event_date < TIMESTAMP '{cfg.cutoff}'
        AND event_type IN ('view_item', 'add_to_cart') AND {VALID}""",
    )
    q.add(f"{p}signals", f"SELECT * FROM {p}bought UNION ALL SELECT * FROM {p}browsed")


def popularity(q: Sql, cfg: HybridConfig, p: str = "") -> None:
    signals(q, cfg, p)
    q.add(f"{p}totals", f"SELECT item_id, sum(points) AS points, count(*) AS n FROM {p}signals GROUP BY item_id")
    q.add(
        f"{p}popular",
        f"""SELECT item_id, points, n, rnk, CAST(points AS DOUBLE) / CAST(max(points) OVER () AS DOUBLE) AS score
        FROM (SELECT *, row_number() OVER (ORDER BY {strength()}, n DESC, item_id) AS rnk FROM {p}totals)
        WHERE rnk <= {cfg.global_limit}""",
    )


def history(q: Sql, cfg: HybridConfig, p: str = "", targets: str | None = None) -> None:
    signals(q, cfg, p)
    only = f"WHERE customer_id IN (SELECT customer_id FROM {targets})" if targets else ""
    q.add(
        f"{p}pairs",
        f"SELECT customer_id, item_id, sum(points) AS points, max(signal_date) AS last_date FROM {p}signals GROUP BY ALL",
    )
    q.add(
        f"{p}history",
        f"""SELECT customer_id, item_id, rnk, CAST(points AS DOUBLE) / CAST(max(points) OVER (PARTITION BY customer_id) AS DOUBLE) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY {strength()}, last_date DESC, item_id) AS rnk FROM {p}pairs {only})
        WHERE rnk <= {cfg.max_user_items}""",
    )


def neighbors(q: Sql, cutoff: str, max_basket: int, n: int, p: str = "") -> None:
    q.add(
        f"{p}lines",
        f"SELECT DISTINCT bill_id, item_id FROM tx WHERE updated_date < TIMESTAMP '{cutoff}'",
    )
    q.add(f"{p}bills", f"SELECT bill_id, count(*) AS n FROM {p}lines GROUP BY bill_id HAVING count(*) BETWEEN 2 AND {max_basket}")
    q.add(
        f"{p}weights",
        f"""SELECT a.item_id, b.item_id AS neighbor_id, sum(CAST(1 AS DOUBLE) / (n - 1)) AS points
        FROM {p}bills JOIN {p}lines a USING (bill_id) JOIN {p}lines b USING (bill_id)
        WHERE a.item_id <> b.item_id GROUP BY 1, 2""",
    )
    q.add(
        f"{p}near",
        f"""SELECT item_id, neighbor_id, rnk, points AS weight, CAST(points AS DOUBLE) / CAST(max(points) OVER (PARTITION BY item_id) AS DOUBLE) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {strength()}, neighbor_id) AS rnk FROM {p}weights)
        WHERE rnk <= {n}""",
    )


def groups(q: Sql, level: str, p: str = "") -> None:
    rows = " UNION ALL ".join(
        f"SELECT item_id, '{name}:' || coalesce({name}, 'unknown') AS grp FROM items" for name in metadata_levels(level)
    )
    q.add(f"{p}groups", rows)


def group_tops(q: Sql, cfg: HybridConfig, p: str = "") -> None:
    popularity(q, cfg, p)
    groups(q, cfg.category_level, p)
    q.add(
        f"{p}gtops",
        f"""SELECT grp, item_id, rnk, CAST(points AS DOUBLE) / CAST(max(points) OVER (PARTITION BY grp) AS DOUBLE) AS score
        FROM (SELECT grp, item_id, points, row_number() OVER (PARTITION BY grp ORDER BY {strength()}, item_id) AS rnk
              FROM {p}totals JOIN {p}groups USING (item_id))
        WHERE rnk <= {cfg.max_category_items}""",
    )


def targets_validate(q: Sql, cfg: HybridConfig, p: str = "") -> None:
    q.add(
        f"{p}targets",
        f"SELECT DISTINCT customer_id FROM tx WHERE updated_date >= TIMESTAMP '{cfg.cutoff}' AND updated_date < TIMESTAMP '{cfg.valid_end}'",
    )


def locations(q: Sql, cfg: HybridConfig, p: str = "") -> None:
    targets_validate(q, cfg, p)
    q.add(
        f"{p}homes",
        f"""SELECT customer_id, location FROM (
          SELECT customer_id, location, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, max(updated_date) DESC, location) AS r
          FROM tx WHERE updated_date < TIMESTAMP '{cfg.cutoff}' AND customer_id IN (SELECT customer_id FROM {p}targets)
          GROUP BY customer_id, location) WHERE r = 1""",
    )
    q.add(
        f"{p}ltops",
        f"""SELECT location, item_id, rnk, CAST(points AS DOUBLE) / CAST(max(points) OVER (PARTITION BY location) AS DOUBLE) AS score
        FROM (SELECT location, item_id, points, row_number() OVER (PARTITION BY location ORDER BY {strength()}, item_id) AS rnk
              FROM (SELECT location, item_id, sum({'CAST(8.0 AS DOUBLE) * ' + decay('updated_date', cfg)}) AS points
                    FROM tx WHERE updated_date < TIMESTAMP '{cfg.cutoff}' GROUP BY 1, 2))
        WHERE rnk <= {cfg.max_location_items}""",
    )


def hybrid(q: Sql, cfg: HybridConfig, p: str = "", name: str = "recs", base: str | None = None, targets: str | None = None) -> str:
    """CTE ``{p}{name}``: every popular item is crossed with every target before ranking.

    ``base`` names the prefix of the learnt tables when several weightings share them.
    """
    b = p if base is None else base
    if targets is None:
        targets_validate(q, cfg, b)
        targets = f"{b}targets"
    popularity(q, cfg, b)
    history(q, cfg, b, targets)
    seeds = f"{b}history WHERE rnk <= {cfg.max_seeds}"
    rows = [
        f"SELECT customer_id, item_id, 'r' AS kind, score AS value FROM {b}history",
        f"SELECT t.customer_id, g.item_id, 'g', g.score FROM {targets} t CROSS JOIN {b}popular g",
    ]
    if cfg.copurchase_weight:
        neighbors(q, cfg.cutoff, cfg.max_basket_items, cfg.max_neighbors, b)
        rows.append(
            f"""SELECT s.customer_id, n.neighbor_id, 'c', s.score * n.score
            FROM (SELECT * FROM {seeds}) s JOIN {b}near n ON s.item_id = n.item_id"""
        )
    if cfg.category_weight:
        group_tops(q, cfg, b)
        rows.append(
            f"""SELECT f.customer_id, t.item_id, 'm', f.score * t.score
            FROM (SELECT customer_id, grp, score FROM (
                    SELECT customer_id, grp, score, row_number() OVER (PARTITION BY customer_id, grp ORDER BY rnk) AS r
                    FROM (SELECT * FROM {seeds}) s JOIN {b}groups USING (item_id)) WHERE r = 1) f
            JOIN {b}gtops t USING (grp)"""
        )
    if cfg.location_weight:
        locations(q, cfg, b)
        rows.append(f"SELECT customer_id, item_id, 'l', score FROM {b}homes JOIN {b}ltops USING (location)")
    sums = ", ".join(
        f"coalesce(CAST(sum(CASE WHEN kind = '{kind}' THEN {shares('value')} END) AS DOUBLE) / CAST(1e11 AS DOUBLE), 0) AS {kind}" for kind in "cml"
    )
    plain = ", ".join(f"coalesce(max(CASE WHEN kind = '{kind}' THEN value END), 0) AS {kind}" for kind in "rg")
    q.add(f"{p}{name}_ev", f"SELECT customer_id, item_id, {plain}, {sums} FROM ({' UNION ALL '.join(rows)}) GROUP BY 1, 2")
    w = {
        "r": cfg.repeat_weight,
        "c": cfg.copurchase_weight,
        "m": cfg.category_weight,
        "l": cfg.location_weight,
        "g": cfg.global_weight,
    }
    score = " + ".join(f"CAST({float(weight)} AS DOUBLE) * {kind}" for kind, weight in w.items())
    return q.add(
        f"{p}{name}",
        f"""SELECT customer_id, item_id, rnk, CAST(s AS DOUBLE) / CAST(1e11 AS DOUBLE) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY s DESC, g DESC, item_id DESC) AS rnk
          FROM (SELECT customer_id, item_id, g, {shares(score)} AS s FROM {p}{name}_ev))
        WHERE rnk <= {cfg.k}""",
    )


def truth(q: Sql, cfg: HybridConfig, p: str = "") -> None:
    q.add(
        f"{p}truth",
        f"SELECT DISTINCT customer_id, item_id FROM tx WHERE updated_date >= TIMESTAMP '{cfg.cutoff}' AND updated_date < TIMESTAMP '{cfg.valid_end}'",
    )


def customer_metrics(q: Sql, recs: str, k: int, p: str = "", name: str = "cust", truth_name: str | None = None) -> str:
    t = truth_name or f"{p}truth"
    q.add(f"{p}{name}_sizes", f"SELECT customer_id, count(*) AS n_true FROM {t} GROUP BY 1")
    q.add(f"{p}{name}_preds", f"SELECT customer_id, item_id, rnk FROM {recs} WHERE rnk <= {k}")
    q.add(
        f"{p}{name}_hits",
        f"""SELECT customer_id, rnk, row_number() OVER (PARTITION BY customer_id ORDER BY rnk) AS j
        FROM {p}{name}_preds JOIN {t} USING (customer_id, item_id)""",
    )
    return q.add(
        f"{p}{name}",
        f"""SELECT s.customer_id, n_true, coalesce(n_pred, 0) AS n_pred, coalesce(hits, 0) AS hits,
          coalesce(n_pred, 0) + n_true - coalesce(hits, 0) AS n_union,
          CAST(CAST(coalesce(hits, 0) AS DOUBLE) / (coalesce(n_pred, 0) + n_true - coalesce(hits, 0)) AS {RATE}) AS iou,
          CAST(coalesce(CAST(1 AS DOUBLE) / first_rank, 0) AS {RATE}) AS rr,
          CAST(coalesce(CAST(total AS DOUBLE), 0) / least(n_true, {k}) AS {RATE}) AS ap
        FROM {p}{name}_sizes s
        LEFT JOIN (SELECT customer_id, count(*) AS n_pred FROM {p}{name}_preds GROUP BY 1) USING (customer_id)
        LEFT JOIN (SELECT customer_id, count(*) AS hits, min(rnk) AS first_rank,
                          sum(CAST(CAST(j AS DOUBLE) / rnk AS {RATE})) AS total
                   FROM {p}{name}_hits GROUP BY 1) USING (customer_id)""",
    )


def metric_select(k: int) -> str:
    def share(a: str, b: str) -> str:
        return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 6)"

    return f"""count(n_true) AS users_evaluated, CAST({k} AS BIGINT) AS k, CAST(coalesce(sum(hits), 0) AS BIGINT) AS total_correct,
      {share('sum(hits)', f'(count(n_true) * {k})')} AS precision_at_10_micro,
      {share('sum(iou)', 'count(n_true)')} AS mean_iou, {share('sum(hits)', 'sum(n_union)')} AS global_iou,
      {share('sum(rr)', 'count(n_true)')} AS mean_reciprocal_rank_first_hit, {share('sum(ap)', 'count(n_true)')} AS map_at_k"""


def overlap(q: Sql, cfg: HybridConfig) -> None:
    truth(q, cfg)
    q.add("prior_p", f"SELECT DISTINCT customer_id, item_id FROM tx WHERE updated_date < TIMESTAMP '{cfg.cutoff}'")
    q.add(
        "prior_e",
        f"SELECT DISTINCT customer_id, item_id FROM ev WHERE event_date >= TIMESTAMP '{cfg.event_start}' AND event_date < TIMESTAMP '{cfg.cutoff}'",
    )
    q.add("prior_a", "SELECT * FROM prior_p UNION SELECT * FROM prior_e")
    q.add(
        "overlap",
        """SELECT customer_id, count(*) AS target_n, count(p.item_id) AS repeat_purchase, count(e.item_id) AS prior_event,
          count(a.item_id) AS prior_any, max(CASE WHEN customer_id IN (SELECT customer_id FROM prior_a) THEN 1 ELSE 0 END) AS seen
        FROM truth t LEFT JOIN prior_p p USING (customer_id, item_id) LEFT JOIN prior_e e USING (customer_id, item_id)
        LEFT JOIN prior_a a USING (customer_id, item_id) GROUP BY customer_id""",
    )
    q.add(
        "segments",
        """SELECT 'all' AS segment, * FROM overlap UNION ALL
        SELECT CASE WHEN seen = 1 THEN 'seen' ELSE 'cold' END AS segment, * FROM overlap""",
    )


# --- ranker -----------------------------------------------------------------------------------


def sample(q: Sql, start: str, end: str, n: int, seed: int, p: str = "") -> None:
    q.add(
        f"{p}users",
        f"""SELECT customer_id FROM (SELECT DISTINCT customer_id FROM tx
          WHERE updated_date >= TIMESTAMP '{start}' AND updated_date < TIMESTAMP '{end}')
        ORDER BY md5(CAST(customer_id AS VARCHAR) || ':{seed}'), customer_id LIMIT {n}""",
    )


def candidates(q: Sql, r, cutoff: str, p: str = "") -> None:
    q.add(f"{p}prior", f"SELECT * FROM tx WHERE updated_date < TIMESTAMP '{cutoff}'")
    q.add(
        f"{p}c_hist",
        f"""SELECT customer_id, item_id, rnk FROM (
          SELECT customer_id, item_id, row_number() OVER (PARTITION BY customer_id ORDER BY s DESC, last_date DESC, item_id) AS rnk
          FROM (SELECT customer_id, item_id, {points('count(*) * CAST(2.0 AS DOUBLE) + ln(sum(greatest(quantity, 1)))')} AS s,
                       max(updated_date) AS last_date
                FROM {p}prior WHERE customer_id IN (SELECT customer_id FROM {p}users) GROUP BY 1, 2))
        WHERE rnk <= {r.user_candidates}""",
    )
    q.add(
        f"{p}c_glob",
        f"""SELECT customer_id, item_id FROM {p}users CROSS JOIN
        (SELECT item_id FROM {p}prior GROUP BY item_id ORDER BY count(*) DESC, item_id LIMIT {r.global_candidates})""",
    )
    groups(q, "brand,category_l3", f"{p}k_")
    q.add(
        f"{p}c_gtop",
        f"""SELECT grp, item_id FROM (
          SELECT grp, item_id, row_number() OVER (PARTITION BY grp ORDER BY n DESC, item_id) AS r
          FROM (SELECT item_id, count(*) AS n FROM {p}prior GROUP BY 1) JOIN {p}k_groups USING (item_id))
        WHERE r <= {r.group_candidates}""",
    )
    q.add(
        f"{p}c_group",
        f"""SELECT DISTINCT customer_id, item_id FROM (
          SELECT customer_id, grp, row_number() OVER (PARTITION BY customer_id, split_part(grp, ':', 1) ORDER BY count(*) DESC, grp) AS r
          FROM {p}c_hist JOIN {p}k_groups USING (item_id) GROUP BY customer_id, grp)
        JOIN {p}c_gtop USING (grp) WHERE r <= 2""",
    )
    neighbors(q, cutoff, 12, r.copurchase_neighbors, f"{p}c_")
    q.add(
        f"{p}c_near_of",
        f"""SELECT DISTINCT customer_id, neighbor_id AS item_id FROM {p}c_hist h JOIN {p}c_near n ON h.item_id = n.item_id
        WHERE h.rnk <= {r.copurchase_seeds}""",
    )
    q.add(
        f"{p}cands",
        f"""SELECT customer_id, item_id, CAST(max(h) AS DOUBLE) AS source_user_hist, CAST(max(g) AS DOUBLE) AS source_global,
          CAST(max(m) AS DOUBLE) AS source_group, CAST(max(c) AS DOUBLE) AS source_copurchase
        FROM (SELECT customer_id, item_id, 1 AS h, 0 AS g, 0 AS m, 0 AS c FROM {p}c_hist
          UNION ALL SELECT customer_id, item_id, 0, 1, 0, 0 FROM {p}c_glob
          UNION ALL SELECT customer_id, item_id, 0, 0, 1, 0 FROM {p}c_group
          UNION ALL SELECT customer_id, item_id, 0, 0, 0, 1 FROM {p}c_near_of) GROUP BY 1, 2""",
    )


def _avg(column: str) -> str:
    return f"CAST(sum({points(column)}) AS DOUBLE) / count({column}) / CAST(1e9 AS DOUBLE)"


def features(q: Sql, r, cutoff: str, end: str, event_start: str, p: str = "") -> None:
    candidates(q, r, cutoff, p)
    old = age("updated_date", cutoff)
    q.add(f"{p}aged", f"SELECT *, CAST({old} AS DOUBLE) AS days FROM {p}prior")
    q.add(f"{p}mine", f"SELECT * FROM {p}aged WHERE customer_id IN (SELECT customer_id FROM {p}users)")
    q.add(
        f"{p}f_user",
        f"""SELECT *, user_txns_30d / (user_txns_90d + 1.0) AS user_velocity, user_txns / (user_days_since_last + 1.0) AS user_recency_x_freq
        FROM (SELECT customer_id, CAST(count(*) AS DOUBLE) AS user_txns, CAST(count(DISTINCT item_id) AS DOUBLE) AS user_items,
          {_avg('price')} AS user_avg_price, min(days) AS user_days_since_last,
          CAST(count(*) FILTER (days <= 30) AS DOUBLE) AS user_txns_30d, CAST(count(*) FILTER (days <= 90) AS DOUBLE) AS user_txns_90d
          FROM {p}mine GROUP BY 1)""",
    )
    q.add(
        f"{p}f_item",
        f"""SELECT *, item_txns_30d / (item_txns_90d + 1.0) AS item_trend_ratio,
          item_buyers / greatest((SELECT count(*) FROM {p}users), 1) AS item_penetration, ln(item_buyers + 1.0) AS item_log_buyers
        FROM (SELECT item_id, CAST(count(*) AS DOUBLE) AS item_txns, CAST(count(DISTINCT customer_id) AS DOUBLE) AS item_buyers,
          {_avg('price')} AS item_avg_price, CAST(count(*) FILTER (days <= 7) AS DOUBLE) AS item_txns_7d,
          CAST(count(*) FILTER (days <= 30) AS DOUBLE) AS item_txns_30d, CAST(count(*) FILTER (days <= 90) AS DOUBLE) AS item_txns_90d
          FROM {p}aged GROUP BY 1)""",
    )
    q.add(
        f"{p}f_ui",
        f"""SELECT customer_id, item_id, CAST(count(*) AS DOUBLE) AS ui_txns, CAST(sum(quantity) AS DOUBLE) AS ui_qty,
          min(days) AS ui_days_since_last FROM {p}mine GROUP BY 1, 2""",
    )
    q.add(
        f"{p}f_event",
        f"""SELECT customer_id, item_id, CAST(count(*) FILTER (event_type = 'view_item') AS DOUBLE) AS event_views,
          CAST(count(*) FILTER (event_type = 'add_to_cart') AS DOUBLE) AS event_carts
        FROM ev WHERE event_date >= TIMESTAMP '{event_start}' AND event_date < TIMESTAMP '{cutoff}'
          AND customer_id IN (SELECT customer_id FROM {p}users) GROUP BY 1, 2""",
    )
    q.add(
        f"{p}r_truth",
        f"""SELECT DISTINCT customer_id, item_id FROM tx WHERE updated_date >= TIMESTAMP '{cutoff}' AND updated_date < TIMESTAMP '{end}'
        AND customer_id IN (SELECT customer_id FROM {p}users)""",
    )
    zeros = (
        "user_txns user_items user_txns_30d user_txns_90d user_velocity user_recency_x_freq item_txns item_buyers "
        "item_txns_7d item_txns_30d item_txns_90d item_trend_ratio item_penetration item_log_buyers ui_txns ui_qty "
        "event_views event_carts"
    ).split()
    zeroed = ", ".join(f"coalesce({name}, 0) AS {name}" for name in zeros)
    q.add(
        f"{p}frame",
        f"""SELECT *, ui_txns / (user_txns + 1.0) AS purchase_share, item_avg_price / (user_avg_price + 1.0) AS price_ratio,
          ui_txns / (ui_days_since_last + 1.0) AS ui_recency_x_freq
        FROM (SELECT c.customer_id, c.item_id, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS label, {zeroed},
          coalesce(user_avg_price, m.price, 0) AS user_avg_price, coalesce(item_avg_price, m.price, 0) AS item_avg_price,
          coalesce(user_days_since_last, 9999) AS user_days_since_last, coalesce(ui_days_since_last, 9999) AS ui_days_since_last,
          source_user_hist, source_global, source_group, source_copurchase
        FROM {p}cands c LEFT JOIN {p}r_truth t USING (customer_id, item_id) LEFT JOIN {p}f_user USING (customer_id)
        LEFT JOIN {p}f_item USING (item_id) LEFT JOIN {p}f_ui USING (customer_id, item_id)
        LEFT JOIN {p}f_event USING (customer_id, item_id) LEFT JOIN items m USING (item_id))""",
    )


# --- latent factors and list blending --------------------------------------------------------------


def head_items(q: Sql, cutoff: str, n: int) -> None:
    q.add(
        "heads",
        f"""SELECT item_id, n, rnk - 1 AS item_idx FROM (
          SELECT item_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rnk
          FROM tx WHERE updated_date < TIMESTAMP '{cutoff}' GROUP BY item_id) WHERE rnk <= {n}""",
    )


def blend_lists(q: Sql) -> None:
    """CTEs base_list and model_list: two hybrid lists of different weighting."""
    tables(q, "style")
    truth(q, S.BLEND_BASE)
    hybrid(q, S.BLEND_BASE, "b_", "base_list")
    hybrid(q, S.BLEND_MODEL, "b_", "model_list")


def rrf_variant(q: Sql, weight: float, k: int) -> str:
    return f"""SELECT customer_id, item_id, row_number() OVER (PARTITION BY customer_id ORDER BY s DESC, coalesce(br, 1000000 + mr)) AS rnk
      FROM (SELECT customer_id, item_id, max(br) AS br, max(mr) AS mr,
              {points(f'coalesce(CAST(1 AS DOUBLE) / max(br), 0) + coalesce(CAST({weight} AS DOUBLE) / max(mr), 0)')} AS s
            FROM (SELECT customer_id, item_id, rnk AS br, NULL AS mr FROM b_base_list
                  UNION ALL SELECT customer_id, item_id, NULL, rnk FROM b_model_list) GROUP BY 1, 2)
      QUALIFY rnk <= {k}"""


def keep_variant(q: Sql, keep: int, k: int) -> str:
    return f"""SELECT customer_id, item_id, row_number() OVER (PARTITION BY customer_id ORDER BY place) AS rnk
      FROM (SELECT customer_id, item_id, min(place) AS place FROM (
              SELECT customer_id, item_id, CASE WHEN rnk <= {keep} THEN rnk ELSE 2000000 + rnk END AS place FROM b_base_list
              UNION ALL SELECT customer_id, item_id, 1000000 + rnk FROM b_model_list) GROUP BY 1, 2)
      QUALIFY rnk <= {k}"""


def oracle_variant(q: Sql, k: int) -> str:
    return f"""SELECT customer_id, item_id,
        row_number() OVER (PARTITION BY customer_id ORDER BY (t.item_id IS NULL), place) AS rnk
      FROM (SELECT customer_id, item_id, min(place) AS place FROM (
              SELECT customer_id, item_id, rnk AS place FROM b_base_list
              UNION ALL SELECT customer_id, item_id, 1000000 + rnk FROM b_model_list) GROUP BY 1, 2) u
      LEFT JOIN truth t USING (customer_id, item_id)
      QUALIFY rnk <= {k}"""
