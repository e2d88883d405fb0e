"""Tunable values of retrieval and ranking.

Edit costs are whole numbers of twentieths (0.05), so distances, ties and the
cutoff test are exact; :data:`COST_UNIT` converts back to the usual scale.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

COST_UNIT = 20
SHORTCUT_SCORE = 1000.0
MAX_PMI = 4.0
RECENCY_HALF_LIFE = 80.0
# Half-lives after which a session's word is no candidate any more.
SESSION_MEMORY = 16
TONE_HALF_LIFE = 12.0
REGISTER_THRESHOLD = 0.25
REGISTER_MIN_MASS = 0.5
TAG_TOLERANCE = 0.005
ADOPT_MARGIN = 0.002


@dataclass(frozen=True)
class EditCosts:
    insert_vowel: int = 5
    insert_sign: int = 7
    insert_consonant: int = 20
    delete: int = 22
    substitute_neighbour: int = 10
    substitute_vowel: int = 11
    substitute: int = 20
    transpose: int = 12


@dataclass(frozen=True)
class Weights:
    skeleton: float = 3.0
    suffix: float = 1.0
    prefix: float = 2.0
    edit: float = 1.5
    freq: float = 0.6
    context: float = 1.0
    user: float = 1.0
    morph: float = 1.0
    recency: float = 1.0

    def as_dict(self) -> dict[str, float]:
        return asdict(self)


@dataclass(frozen=True)
class Settings:
    min_input_len: int = 3
    per_source_cap: int | None = 2000  # None: no cap
    cutoff_base: int = 20  # twentieths
    cutoff_per_char: int = 6  # twentieths per input character
    typo_tolerance: bool = True
    fuzzy_min_skeleton: int = 3
    min_delete_skeleton: int = 3
    short_prefix_min_skeleton: int = 4
    weights: Weights = field(default_factory=Weights)
    costs: EditCosts = field(default_factory=EditCosts)

    @property
    def fuzzy_bucket_cap(self) -> int | None:
        return None if self.per_source_cap is None else -(-self.per_source_cap // 4)
