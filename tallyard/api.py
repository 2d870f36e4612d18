"""Every operator under one name, by kind: sources and sinks, scalars, joins, aggregations, windows, ratings, pricing,
strategies, models, streams."""

from tallyard.functions.pricing import caps, ev_gate, harville_ordered, harville_pair, harville_trio, kelly, regime_prob, round_ticket, synthetic_odds, value_stake  # noqa: F401
from tallyard.functions.scalars import (  # noqa: F401
    alpha_delta, calendar, clean_combo, closing_speed, contest_key, contest_no, course_multiplier, distance_regime, dmy_to_iso, drop_overseas, early_speed, first_digits, going_multiplier, header_fields,
    holdout_guard, implied_prob, incident_rows, interact, is_turf, legacy_ids, match_pool, money, numeric_features, parse_margin, parse_name_code, parse_positions, relevance, require, sanitise_keys,
    season_bounds, season_label, targets, time_split, to_float, to_int, train_bounds, url_param,
)
from tallyard.operators.history import (  # noqa: F401
    carry_down, counter, days_since, drawdown, equity, handler_rate, lag_deltas, min_field, pressure, prior_rate, prior_wins, public_rank, rank_in_contest, rolling_mean, share, softmax,
)
from tallyard.operators.market import (  # noqa: F401
    bootstrap_ci, break_even, compounding_ledger, diagnostic_means, diagnostic_report, flat_ledger, pooled, ranking_diagnostics, regime_report, season_summary, settle_actual, settle_synthetic, sweep_odds_delta,
    sweep_odds_place, tier_ledger,
)
from tallyard.operators import buckets  # noqa: F401
from tallyard.operators.boosting import BoostedRanker, candidate_splits, fit_boosted_ranker, quantile_cuts  # noqa: F401
from tallyard.operators.ledger import Stake, fold, ledger, plain, season_ledger  # noqa: F401
from tallyard.operators.models import attribution, fit_isotonic, fit_logistics, fit_meta, fit_platt, fit_ranker, importance, isotonic_blocks, load_model, ndcg, permutation_importance, save_model, walk_forward  # noqa: F401
from tallyard.operators.ratings import FEATURES, contest_features, contest_levels, daily_pagerank, dominance_edges, glicko, history_features, legacy_chain, margin_elo, pagerank, pairwise_elo, rating_fold, ratings_by_contest, ratings_by_period, snapshot_pagerank, snapshot_features, yearly_snapshots  # noqa: F401
from tallyard.operators.relational import (  # noqa: F401
    arg_max, as_of, assign_folds, attach, bettable_flag, bottom_n, brier, combos, completeness_audit, counts, covers, dedupe, distinct_count, join_odds, join_payouts, log_loss, lookup, null_audit, orphans, overlap,
    pairs, pending, season_counts, settle_bets, summary, top_n, top_peak, union_ragged,
)
from tallyard.operators.strategies import SPECS, Spec, regime_desk, run_strategy, strategy_seasons, tickets  # noqa: F401
from tallyard.sources.ingest import ingest  # noqa: F401
from tallyard.sources.storage import (  # noqa: F401
    append_meetings, assert_unique, catalogue, entries_of, file_key_map, file_number, last_of, list_columns, materialise_features, read_csv_wide, read_headed_csv, read_lines, read_positional_csv, read_sql, replace_partition, write_csv, write_table,
)
from tallyard.streaming.streams import closing, rating_state, stream_history, stream_ingest, stream_ratings  # noqa: F401
