"""Fixed schemas of the tables that are read and written. The names of the columns are part of the formats."""

from __future__ import annotations

CHECKPOINT = (
    "sector int, target string, score double, label string, download_status string, tspan_days double, median_dt_days double, "
    "bls_period double, bls_t0 double, bls_duration double, bls_depth double, bls_power double, polarity_flipped boolean, "
    "score_dip double, score_bump double, score_used double, score_injected double, score_delta_injected double, w_nan_frac double, "
    "w_std double, min_abs_phase double, morph_v_score double, morph_asymmetry double, morph_secondary_dip double, morph_depth_cv double, "
    "morph_duty_cycle double, morph_grazing_ratio double, morph_grazing_flag boolean, morph_n_flags int, morph_is_strong_fp boolean, "
    "morph_flags string"
)
CATALOG = "pl_name string, tic_id bigint, pl_orbper double, disc_facility string, pl_trandep double, pl_rade double, sy_tmag double, hostname string"
OBJECTS = "tidstr string, tfopwg_disp string"
OBSERVATIONS = "target_name string, obs_id string, obs_title string, dataURL string, t_exptime double, provenance_name string, sequence_number int"
CANDIDATES = "tic_id bigint, sector int, score double, bls_period double, bls_t0 double, bls_duration double"
CONFIG = "window_len int, candidate_threshold double, likely_threshold double, high_confidence_threshold double, use_focal_loss boolean, focal_gamma double, focal_alpha double"
#: Values of a configuration where the file has none.
CONFIG_DEFAULTS = {
    "window_len": 301, "candidate_threshold": 0.86, "likely_threshold": 0.88, "high_confidence_threshold": 0.895,
    "use_focal_loss": False, "focal_gamma": 2.0, "focal_alpha": 0.25,
}
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
