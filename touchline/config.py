"""Thresholds of the engine as plain values; they become literals when a plan is built, so Catalyst folds them.

Lengths are in pixels of a frame 640 wide unless the name says otherwise, times in seconds, angles in degrees.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    # ball kinematics (fixed values that results depend on)
    contact_min_speed_px_s: float = 30.0
    contact_dir_change_deg: float = 50.0
    contact_stop_ratio: float = 0.4
    contact_speed_spike_ratio: float = 2.0
    contact_merge_sec: float = 0.3
    contact_gap_sec: float = 0.5
    max_candidates: int = 600
    max_candidates_per_min: int = 40
    candidate_fair_window_sec: float = 30.0
    # alternating ball positions (fixed values)
    pingpong_min_step_px: float = 40.0
    pingpong_min_turn_deg: float = 165.0
    pingpong_return_frac: float = 0.35
    pingpong_max_gap_sec: float = 0.6
    pingpong_min_alternations: int = 2
    # review windows (fixed values)
    hotspot_pad_before_sec: float = 2.0
    hotspot_pad_after_sec: float = 2.0
    hotspot_gap_merge_sec: float = 5.0
    hotspot_min_zone_sec: float = 3.0
    possession_leave_px: float = 120.0
    possession_max_extend_sec: float = 6.0
    # identity and review (fixed values)
    orbital_base_px: float = 80.0
    orbital_growth_px_s: float = 60.0
    orbital_max_gap_sec: float = 8.0
    orbital_floor: float = 0.5
    orbital_falloff: float = 0.5
    max_review: int = 80
    crowd_max_review: int = 40
    # players (fixed values)
    contact_max_player_dist_px: float = 80.0
    contact_max_player_dist_m: float = 8.0
    contact_metric_override_px: float = 25.0
    contact_ball_proxy_half_px: float = 8.0
    contact_ball_iou_soft: float = 0.25
    player_min_height_px: float = 16.0
    player_min_aspect: float = 1.8
    player_human_min_aspect: float = 1.3
    player_human_max_aspect: float = 5.5
    sideline_min_feet_grass: float = 0.18
    scene_min_grass: float = 0.12
    crowd_radius_px: float = 90.0
    crowd_min_players: int = 4
    ambiguous_gap_heights: float = 0.8
    # kits (fixed values, in units of the hue-weighted colour distance)
    team_max_dist: float = 60.0
    other_team_dist: float = 115.0
    opponent_margin: float = 20.0
    # intervals and valuation (fixed values)
    range_merge_sec: float = 0.5
    goal_shot_window_sec: float = 12.0

    def for_frame_width(self, width: int) -> "Config":
        """Lengths and speeds in pixels scale with the frame; times, ratios and angles don't."""
        scaled = {f.name: getattr(self, f.name) * width / 640 for f in fields(self) if f.name.endswith(("_px", "_px_s"))}
        return replace(self, **scaled)


DEFAULT = Config()
