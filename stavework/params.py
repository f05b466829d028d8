"""Thresholds, passed to operators as values so that a sweep can make any of them a column.

Fixed values: they decide results, so they must equal the published ones.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class VoteParams:
    strike_share_inverse: int = 3  # a slot is kept when strikes * 3 > bars
    min_slot_support: int = 2
    density_floor: float = 0.6
    hybrid_delta: float = 0.04
    medoid_min_strokes: int = 2
    period2_margin: float = 0.10
    period2_min_pairs: int = 3
    period2_min_strikes: int = 2
    uncertain_below: float = 0.45
    uncertain_below_sixteenth: float = 0.53
    explained_below: float = 0.6
    chance_alpha: float = 0.05
    chance_shuffles: int = 1000
    full_vote_density: float = 0.6
    min_vote_bars: int = 4
    member_agree: float = 0.35


@dataclass(frozen=True)
class SignalParams:
    source_min_ratio: float = 0.05
    section_min_ratio: float = 0.10
    odd_sixteenth_share: float = 0.25
    sixteenth_min_ms: float = 105.0
    grid_fit_tolerance: float = 0.15
    mute_centroid: float = 0.85
    mute_zcr: float = 0.65
    rest_ratio_min: float = 0.05
    rest_low_share_min: float = 0.005
    bass_stem_max: float = 0.05
    own_low_share_min: float = 0.40
    merge_ms: float = 60.0
    sparse_share: float = 0.4
    min_gain: float = 1.0
    fit_tolerance: float = 0.05
    silent_bar_share: float = 0.25
    riff_entropy_max: float = 0.82
    riff_single_pc_min: float = 0.45
    pitch_change_min: float = 0.26
    riff_agree_min: float = 0.70
    riff_support_min: float = 0.75
    riff_named_min: float = 0.6
    note_skip_in_s: float = 0.020
    note_skip_out_s: float = 0.010
    note_voiced_min: float = 0.5
    ring_section_db: float = 5.0
    ring_min_gap_slots: float = 1.5


@dataclass(frozen=True)
class GridParams:
    gap_half_window: int = 8
    gap_factor: float = 1.6
    near_tie: float = 0.75
    downbeat_tolerance: float = 0.07
    min_section_bars: int = 4
    vocal_below_median_db: float = 12.0
    vocal_audible_db: float = -60.0
    vocal_run_min_bars: int = 4
    vocal_edge_move_bars: int = 3
    instrumental_below: float = 0.25
    edge_instrumental_below: float = 0.5
    chorus_min_vocal: float = 0.5
    split_share: float = 0.6
    low_margin_db: float = 1.5
    phrase_min_changes: int = 4
    phrase_min_share: float = 0.75


@dataclass(frozen=True)
class HarmonyParams:
    tonic_min_share: float = 0.2
    final_chord_bonus: float = 0.10
    section_end_weight: float = 0.15
    key_tie_margin: float = 0.05
    pair_tie: float = 0.02
    key_hedge_margin: float = 0.05
    mode_tie_margin: float = 0.05
    min_chord_events: int = 4
    set_veto_margin: float = 0.10
    power_mode_margin: float = 0.2
    power_min_share: float = 0.2
    fill_min_energy: float = 0.2
    fill_min_match: float = 0.32
    fill_min_margin: float = 0.05
    bridge_novel_chords: float = 0.5
    bridge_min_vocal: float = 0.5
    fragment_bars: int = 8
    chord_match_distance: float = 0.35
    passing_share: float = 0.02
    min_diagram_chords: int = 3
    no_shape_cost: float = 5.0
    capo_fret_penalty: float = 0.2
    max_passes: int = 20


VOTE = VoteParams()
SIGNAL = SignalParams()
GRID = GridParams()
HARMONY = HarmonyParams()

EPS_OVERLAP = 1e-6  # chords against bars
EPS_DIAGNOSTIC = 1e-9  # the all-N bar diagnostic
