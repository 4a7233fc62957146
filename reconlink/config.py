"""Every tunable the operators take, as one immutable argument."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Thresholds:
    # Defaults of the reconciliation rules.
    time_tolerance_minutes: int = 30
    time_light_minutes: int = 30
    stage2_days: int = 1
    stage3_days: int = 7
    min_agreeing_keys: int = 2
    # limits that cut work are off unless asked for
    person_stage_limit: int | None = None
    person_stage_limit_no_birth: int | None = None
    min_mention_chars: int = 100
    unit_semantic: float = 0.6
    unit_accept: float = 0.75
    unit_low_lexical_factor: float = 0.1
    unit_green: float = 0.85
    unit_yellow: float = 0.75
    unit_window_sizes: tuple[int, int] = (1, 6)
    unit_window_cap: int | None = None
    category_window_sizes: tuple[int, int] = (4, 10)
    category_window_cap: int | None = None
    category_semantic: float = 0.20
    acronym_boost: float = 0.35
    rare_token_boost: float = 0.15
    generic_penalty: float = -0.15
    category_top_k: int | None = None
    category_min_score: float = 0.5
    category_max_chars: int | None = None
    category_fuzzy_window: int | None = None
    similar_min_score: float = 0.5
    similar_limit: int | None = None
    org_semantic: float = 0.6
    surname_ratio: float = 0.90
    first_name_ratio: float = 0.85
    patronymic_ratio: float = 0.85
    anchor_min_chars: int = 10
    anchor_start_similarity: float = 0.60
    anchor_weak_similarity: float = 0.85
    min_slice_chars: int = 300
    slice_fallback_elements: int | None = None
    birth_window: int = 60
    birth_year_window: int = 80

    def with_(self, **changes) -> "Thresholds":
        return replace(self, **changes)


DEFAULTS = Thresholds()
