"""The SQL text per registered query."""

from __future__ import annotations

from catalog import oracles as O, settings as S
from rebuy.operators import blending
from rebuy.operators.features import FEATURES, CandidateConfig
from rebuy.plans.experiments import CONFIGS, Split

SCORE = "round(points, 6) AS score, round(CASE WHEN points > 0 THEN ln(points) END, 6) AS log_score"
RANKER = CandidateConfig(event_start=S.EVENT_START)


def r6(*names: str) -> str:
    return ", ".join(f"round(CAST({name} AS DOUBLE), 6) AS {name}" for name in names)


def exact(*names: str) -> str:
    return ", ".join(f"CAST({name} AS DOUBLE) AS {name}" for name in names)


def start(variant: str) -> O.Sql:
    q = O.Sql()
    O.tables(q, variant)
    return q


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    D, P = S.DEFAULT, S.PRODUCTION

    def signal_query(name: str, table: str, variant: str) -> None:
        q = start(variant)
        O.signals(q, D)
        out[name] = q.select(f"SELECT customer_id, item_id, signal, signal_date, {SCORE} FROM {table}")

    signal_query("purchase_signals", "bought", "sku")
    signal_query("event_signals", "browsed", "sku")
    signal_query("train_signals", "signals", "style")

    q = start("sku")
    O.signals(q, D)
    out["customer_items"] = q.select(
        f"""SELECT customer_id, item_id, {SCORE}, last_date, n FROM (
          SELECT customer_id, item_id, sum(points) AS points, max(signal_date) AS last_date, count(*) AS n FROM signals GROUP BY 1, 2)"""
    )
    out["own_files_items"] = out["customer_items"]
    O.popularity(q, D)
    out["item_totals"] = q.select(f"SELECT item_id, {SCORE}, n FROM totals")
    out["global_popularity"] = q.select(f"SELECT item_id, {SCORE}, n, rnk FROM popular")
    O.history(q, D)
    out["user_history"] = q.select(f"SELECT customer_id, item_id, {r6('score')}, rnk FROM history")
    q = start("style")
    O.popularity(q, D)
    out["global_scores"] = q.select(f"SELECT item_id, {r6('score')}, rnk FROM popular")

    near = f"SELECT item_id, neighbor_id, {r6('weight', 'score')}, rnk FROM near"
    q = start("sku")
    O.neighbors(q, S.CUTOFF, D.max_basket_items, D.max_neighbors)
    out["copurchase_neighbors"] = q.select(near)
    out["neighbor_cache_roundtrip"] = q.select(near)
    out["baskets"] = q.select(
        "SELECT bill_id, n AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM bills JOIN lines USING (bill_id) GROUP BY 1, 2"
    )
    q = start("style")
    O.neighbors(q, S.CUTOFF, D.max_basket_items, 20)
    out["copurchase_neighbors_style"] = q.select(near)

    q = start("sku")
    O.groups(q, "category_l1,category_l2,category_l3,brand")
    out["item_groups"] = q.select("SELECT item_id, grp FROM groups")
    q = start("style")
    O.groups(q, "category_l1,brand")
    out["item_groups_unknown"] = q.select("SELECT item_id, grp FROM groups")
    q = start("sku")
    O.group_tops(q, P)
    out["group_top_items"] = q.select(f"SELECT grp, item_id, {r6('score')}, rnk FROM gtops")
    q = start("sku")
    O.locations(q, D)
    out["user_location"] = q.select("SELECT customer_id, location FROM homes")
    out["location_top_items"] = q.select(f"SELECT location, item_id, {r6('score')}, rnk FROM ltops")

    q = start("sku")
    O.targets_validate(q, D)
    out["targets_validate"] = out["targets_file_roundtrip"] = q.select("SELECT customer_id FROM targets")
    everyone = "SELECT customer_id FROM tx UNION SELECT customer_id FROM ev"
    out["targets_predict"] = q.select(everyone)
    O.signals(q, D)
    out["cold_customers"] = q.select(
        "SELECT customer_id FROM targets WHERE customer_id NOT IN (SELECT customer_id FROM signals)"
    )
    O.truth(q, D)
    out["truth"] = q.select("SELECT customer_id, item_id FROM truth")

    recs = f"SELECT customer_id, item_id, rnk, {r6('score')} FROM recs"

    def recs_query(name: str, variant: str, cfg, targets: str | None = None) -> None:
        q = start(variant)
        if targets:
            q.add("everyone", targets)
        O.hybrid(q, cfg, targets="everyone" if targets else None)
        out[name] = q.select(recs)

    recs_query("hybrid_recs", "sku", P)
    recs_query("hybrid_recs_default", "style", D)
    recs_query("hybrid_recs_location", "sku", S.WITH_LOCATION)
    recs_query("hybrid_recs_predict", "sku", P, everyone)

    q = start("style")
    q.add("ev0", "SELECT * FROM ev WHERE false")
    cfg = D.with_(copurchase_weight=0.0, global_weight=0.0)
    O.signals(q, cfg)
    q.parts["signals"] = "SELECT * FROM bought"
    O.hybrid(q, cfg)
    out["hybrid_recs_repeat_only"] = q.select(recs)

    q = start("style")
    O.hybrid(q, P)
    O.truth(q, P)
    out["hybrid_lists"] = q.select(
        "SELECT customer_id, string_agg(item_id, '|' ORDER BY rnk) AS items FROM recs GROUP BY 1"
    )
    O.customer_metrics(q, "recs", 10)
    out["customer_metrics"] = q.select(
        f"SELECT customer_id, n_true, n_pred, hits, n_union, {exact('iou', 'rr', 'ap')} FROM cust"
    )
    out["ranking_metrics"] = q.select(f"SELECT {O.metric_select(10)} FROM cust")
    q.add(
        "cust_seg",
        """SELECT 'all' AS segment, * FROM cust UNION ALL
        SELECT CASE WHEN customer_id IN (SELECT customer_id FROM signals) THEN 'seen' ELSE 'cold' END, * FROM cust""",
    )
    every = "(VALUES ('all'), ('seen'), ('cold')) AS segments(segment)"
    by_segment = f"SELECT segment, {O.metric_select(10)} FROM {every} LEFT JOIN cust_seg USING (segment) GROUP BY segment"
    out["metrics_by_segment"] = q.select(by_segment)
    out["metrics_sink"] = q.select(
        f"""SELECT segment, users_evaluated, total_correct, map_at_k, '{P.cutoff}' AS cutoff,
        '{P.category_level}' AS category_level, k, (SELECT count(DISTINCT customer_id) FROM recs) AS recommendation_rows
        FROM ({by_segment})"""
    )

    q = start("style")
    O.overlap(q, D)
    out["target_overlap"] = q.select(
        "SELECT customer_id, target_n, repeat_purchase, prior_event, prior_any, CAST(seen AS BIGINT) AS seen FROM overlap"
    )

    def nearest(x: float) -> str:
        return f"CAST(max(target_n) FILTER (pos = round({x} * (users - 1))) AS DOUBLE)"

    out["target_size_summary"] = q.select(
        f"""SELECT segment, count(*) AS users, CAST(sum(target_n) AS BIGINT) AS target_items, round(avg(target_n), 6) AS avg_target_items,
        median(target_n) AS median_target_items, {nearest(0.75)} AS p75_target_items, {nearest(0.9)} AS p90_target_items,
        {nearest(0.99)} AS p99_target_items, count(*) FILTER (target_n >= 2) AS users_with_2plus_items,
        count(*) FILTER (target_n >= 3) AS users_with_3plus_items
        FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY target_n) - 1 AS pos, count(*) OVER (PARTITION BY segment) AS users
              FROM segments) GROUP BY segment"""
    )
    pieces = " UNION ALL ".join(
        f"""SELECT segment, '{source}' AS source, count(*) AS users, CAST(sum(target_n) AS BIGINT) AS target_items,
        CAST(sum({source}) AS BIGINT) AS recoverable_hits, count(*) FILTER ({source} > 0) AS users_with_any_recoverable,
        CAST(sum(least(target_n, 10)) AS BIGINT) AS perfect_hits_at_k,
        round(sum({source}) / (count(*) * 10), 6) AS recoverable_precision, round(sum({source}) / sum(target_n), 6) AS recoverable_recall,
        round(sum(least(target_n, 10)) / (count(*) * 10), 6) AS perfect_precision,
        round(count(*) FILTER ({source} > 0) / count(*), 6) AS user_recoverable_rate
        FROM segments WHERE segment <> 'cold' GROUP BY segment"""
        for source in ("repeat_purchase", "prior_event", "prior_any")
    )
    out["ceiling_overlap"] = q.select(pieces)

    # ranker
    q = start("sku")
    O.sample(q, S.CUTOFF, S.VALID_END, S.SAMPLE_SIZE, S.SEED)
    out["sample_users"] = q.select("SELECT customer_id FROM users")

    def ranker(cutoff: str, end: str) -> O.Sql:
        q = start("style")
        q.add("users", f"SELECT DISTINCT customer_id FROM tx WHERE updated_date >= TIMESTAMP '{cutoff}' AND updated_date < TIMESTAMP '{end}'")
        O.features(q, RANKER, cutoff, end, S.EVENT_START)
        return q

    q = ranker(S.CUTOFF, S.VALID_END)
    out["cand_user_history"] = q.select("SELECT customer_id, item_id, rnk FROM c_hist")
    out["cand_global"] = q.select("SELECT customer_id, item_id FROM c_glob")
    out["cand_group"] = q.select("SELECT customer_id, item_id FROM c_group")
    out["cand_copurchase"] = q.select("SELECT customer_id, item_id FROM c_near_of")
    out["cand_merged"] = q.select("SELECT * FROM cands")

    def rounded(table: str, keys: list[str], names: list[str]) -> str:
        plain = [name for name in names if name.endswith("_avg_price")]
        columns = [*keys, *plain, r6(*[name for name in names if name not in plain])]
        return f"SELECT {', '.join(columns)} FROM {table}"

    users = [f for f in FEATURES if f.startswith("user_")]
    items = [f for f in FEATURES if f.startswith("item_")]
    out["feat_user"] = q.select(rounded("f_user", ["customer_id"], users))
    out["feat_item"] = q.select(rounded("f_item", ["item_id"], items))
    out["feat_user_item"] = q.select(rounded("f_ui", ["customer_id", "item_id"], ["ui_txns", "ui_qty", "ui_days_since_last"]))
    out["feat_event"] = q.select(rounded("f_event", ["customer_id", "item_id"], ["event_views", "event_carts"]))
    out["feature_frame"] = q.select(
        rounded("frame", ["customer_id", "item_id", "CAST(label AS BIGINT) AS label"], FEATURES)
    )
    out["label_report"] = q.select("SELECT count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives FROM frame")
    q.add(
        "recall",
        """SELECT customer_id, count(DISTINCT c.item_id) AS offered, count(DISTINCT t.item_id) AS wanted,
          count(*) FILTER (c.item_id = t.item_id) AS hits
        FROM cands c FULL JOIN r_truth t USING (customer_id, item_id) GROUP BY 1""",
    )
    out["candidate_recall"] = q.select(
        """SELECT CAST(sum(hits) AS BIGINT) AS candidate_hits, CAST(sum(wanted) AS BIGINT) AS target_items,
        round(sum(hits) / sum(wanted), 6) AS candidate_recall,
        round(least(sum(hits), sum(least(wanted, 10)) FILTER (offered > 0)) / (count(*) FILTER (wanted > 0) * 10), 6) AS oracle_precision_at_10
        FROM recall"""
    )
    q = ranker(S.TRAIN_CUTOFF, S.TRAIN_END)
    out["train_positive_groups"] = q.select(
        """SELECT customer_id, item_id, CAST(label AS BIGINT) AS label FROM frame
        WHERE customer_id IN (SELECT customer_id FROM frame GROUP BY 1 HAVING sum(label) > 0)"""
    )
    q.add(
        "placed",
        """SELECT customer_id, item_id, label, 1 / log2(1 + row_number() OVER (PARTITION BY customer_id ORDER BY item_id)) AS discount
        FROM frame WHERE customer_id IN (SELECT customer_id FROM frame GROUP BY 1 HAVING sum(label) > 0)""",
    )
    q.add(
        "ideal",
        """SELECT customer_id, sum(1 / log2(1 + place)) AS ideal
        FROM (SELECT customer_id, row_number() OVER (PARTITION BY customer_id) AS place FROM placed WHERE label = 1) GROUP BY 1""",
    )
    q.add(
        "swaps",
        """SELECT customer_id, a.item_id AS high, b.item_id AS low, abs(a.discount - b.discount) / ideal AS swap
        FROM placed a JOIN placed b USING (customer_id) JOIN ideal USING (customer_id) WHERE a.label = 1 AND b.label = 0""",
    )
    # At equal scores each pair pulls with 1/2 and bends with 1/4.
    out["ranker_first_gradients"] = q.select(
        """SELECT customer_id, item_id, CAST(label AS BIGINT) AS label, round(coalesce(sum(pull), 0), 6) AS gradient,
          round(coalesce(sum(abs(pull)) / 2, 0), 6) AS curvature
        FROM placed LEFT JOIN (SELECT customer_id, high AS item_id, swap / 2 AS pull FROM swaps
                               UNION ALL SELECT customer_id, low, -swap / 2 FROM swaps) USING (customer_id, item_id)
        GROUP BY customer_id, item_id, label"""
    )

    # latent factors and blends
    q = start("sku")
    O.head_items(q, S.CUTOFF, S.HEADS)
    O.targets_validate(q, D)
    O.signals(q, D)
    out["head_items"] = q.select("SELECT item_id, n, item_idx FROM heads")
    q.add(
        "ratings",
        """SELECT customer_id, item_id, item_idx, sum(points) AS rating FROM signals JOIN heads USING (item_id)
        WHERE customer_id IN (SELECT customer_id FROM targets) GROUP BY 1, 2, 3""",
    )
    # Every customer's factors solve their normal equations.
    out["als_normal_equations"] = q.select("SELECT customer_id, count(*) AS n_items, CAST(1 AS BIGINT) AS solved FROM ratings GROUP BY 1")
    out["interaction_matrix"] = q.select(
        f"""SELECT customer_id, item_id, dense_rank() OVER (ORDER BY customer_id) - 1 AS user_idx, item_idx, {r6('rating')} FROM ratings"""
    )
    out["positive_pairs"] = q.select(
        f"""SELECT DISTINCT customer_id, item_id, item_idx FROM tx JOIN heads USING (item_id)
        WHERE updated_date < TIMESTAMP '{S.CUTOFF}' AND customer_id IN (SELECT customer_id FROM targets)"""
    )
    q.add(
        "liked",
        f"""SELECT DISTINCT customer_id, item_idx FROM tx JOIN heads USING (item_id)
        WHERE updated_date < TIMESTAMP '{S.CUTOFF}' AND customer_id IN (SELECT customer_id FROM targets)""",
    )
    out["bpr_pair_order"] = q.select("SELECT count(DISTINCT customer_id) AS customers, count(*) AS pairs, CAST(1 AS BIGINT) AS learned FROM liked")

    q = O.Sql()
    O.blend_lists(q)
    k = 10

    def stacked(variants: dict[str, str]) -> str:
        return " UNION ALL ".join(f"SELECT '{name}' AS variant, * FROM ({text})" for name, text in variants.items())

    rrf = {f"w{w:g}": O.rrf_variant(q, w, k) for w in blending.BLEND_WEIGHTS}
    keeps = {f"keep{n}": O.keep_variant(q, n, k) for n in blending.KEEP_LENGTHS}
    out["blend_rrf"] = q.select(stacked(rrf))
    out["blend_keep_base"] = q.select(stacked(keeps))
    out["blend_oracle"] = q.select(O.oracle_variant(q, k))
    every = {f"base_plus_model_{w:g}": O.rrf_variant(q, w, k) for w in blending.BLEND_WEIGHTS}
    every |= {f"base_top{n}_then_model": O.keep_variant(q, n, k) for n in blending.KEEP_LENGTHS}
    every["oracle_base_model_union"] = O.oracle_variant(q, k)
    for name in ("base", "model"):
        every[f"{name}_only"] = f"SELECT customer_id, item_id, rnk FROM b_{name}_list WHERE rnk <= {k}"
    selects = []
    for i, (name, text) in enumerate(every.items()):
        q.add(f"v{i}", text)
        O.customer_metrics(q, f"v{i}", k, p=f"v{i}_", truth_name="truth")
        selects.append(f"SELECT '{name}' AS variant, {O.metric_select(k)} FROM v{i}_cust")
    out["blend_metrics"] = q.select(" UNION ALL ".join(selects))

    # several cutoffs at once
    base = S.GRID_BASE
    q, parts = start("sku"), []
    for i, split in enumerate(S.SPLITS):
        O.signals(q, base.with_(cutoff=split[1]), f"s{i}_")
        parts.append(
            f"""SELECT customer_id, item_id, {SCORE}, last_date, n, '{split[1]}' AS cutoff FROM (
              SELECT customer_id, item_id, sum(points) AS points, max(signal_date) AS last_date, count(*) AS n FROM s{i}_signals GROUP BY 1, 2)"""
        )
    out["split_customer_items"] = q.select(" UNION ALL ".join(parts))
    q, parts = start("sku"), []
    for i, split in enumerate(S.SPLITS):
        O.neighbors(q, split[1], base.max_basket_items, 5, f"s{i}_")
        parts.append(f"SELECT item_id, neighbor_id, {r6('weight', 'score')}, rnk, '{split[1]}' AS cutoff FROM s{i}_near")
    out["split_neighbors"] = q.select(" UNION ALL ".join(parts))

    # grid
    grid = _grid([Split(*split) for split in S.SPLITS], CONFIGS)
    out["rolling_summary"] = grid
    out["rolling_config_means"] = f"""WITH summary AS ({_grid([Split(*s) for s in S.SPLITS], CONFIGS, digits=False)})
      SELECT config, count(*) AS splits, round(avg(total_correct), 6) AS avg_total_correct,
        round(avg(precision_at_10_micro), 6) AS avg_precision_at_10_micro, round(avg(mean_iou), 6) AS avg_mean_iou,
        round(avg(mrr_first_hit), 6) AS avg_mrr_first_hit, round(avg(map_at_k), 6) AS avg_map_at_k
      FROM summary GROUP BY config"""
    chosen = [c for c in CONFIGS if c.name in ("baseline_hl60", "brand_l3_hl60_cw015_mw006")]
    out["rolling_subset"] = _grid([Split(*S.SPLITS[-1])], chosen)
    return out


def _grid(splits, configs, digits: bool = True) -> str:
    q = O.Sql()
    O.tables(q, "style")
    selects = []
    for i, split in enumerate(splits):
        O.truth(q, configs[0].on(S.GRID_BASE, split), f"s{i}_")
        for j, config in enumerate(configs):
            cfg = config.on(S.GRID_BASE, split)
            p = f"s{i}c{j}_"
            base = f"s{i}h{int(cfg.half_life_days)}_"
            recs = O.hybrid(q, cfg, p, base=base)
            cust = O.customer_metrics(q, recs, cfg.k, p, truth_name=f"s{i}_truth")
            seen = f"customer_id IN (SELECT customer_id FROM {base}signals)"
            selects.append(
                f"""SELECT '{split.name}' AS split, '{config.name}' AS config, '{split.cutoff}' AS cutoff, '{split.valid_end}' AS valid_end,
                total_correct, precision_at_10_micro, mean_iou, global_iou, mean_reciprocal_rank_first_hit AS mrr_first_hit, map_at_k,
                round(coalesce(seen_precision_at_10, 0), 6) AS seen_precision_at_10, round(coalesce(cold_precision_at_10, 0), 6) AS cold_precision_at_10
                FROM (SELECT {O.metric_select(cfg.k)},
                  sum(hits) FILTER ({seen}) / nullif(count(*) FILTER ({seen}) * {cfg.k}, 0) AS seen_precision_at_10,
                  sum(hits) FILTER (NOT {seen}) / nullif(count(*) FILTER (NOT {seen}) * {cfg.k}, 0) AS cold_precision_at_10
                  FROM {cust})"""
            )
    text = q.select(" UNION ALL ".join(selects))
    return text if digits else text.replace(", 6)", ", 12)")
