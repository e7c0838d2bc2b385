"""Settings of an analysis, validated."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Enum


class PairOrder(Enum):
    """Orders of pairs; all but the first are descending, ties in file order."""

    FILE_ID = "file-id"
    SIMILARITY = "similarity"
    TOTAL_OVERLAP = "total-overlap"
    LONGEST_FRAGMENT = "longest-fragment"


class FragmentOrder(Enum):
    """Orders of a pair's fragments; ties in file order."""

    KGRAMS_ASCENDING = "kgrams-ascending"
    KGRAMS_DESCENDING = "kgrams-descending"
    FILE_ORDER = "file-order"


class InvalidConfig(ValueError):
    """A setting is out of its range."""


@dataclass(frozen=True)
class EngineConfig:
    """What an analysis does. ``language`` None is detected; of the two caps the lower counts."""

    name: str | None = None
    kgram_length: int = 23
    kgrams_in_window: int = 17
    language: str | None = None
    max_fingerprint_count: int | None = None
    max_fingerprint_percentage: float | None = None
    template: tuple[str, ...] = field(default=())
    include_comments: bool = False
    min_fragment_length: int = 1
    sort_by: PairOrder = PairOrder.SIMILARITY
    fragment_sort_by: FragmentOrder = FragmentOrder.FILE_ORDER
    compare: bool = False
    include_analysis_data: bool = False

    def __post_init__(self) -> None:
        for name in ("kgram_length", "kgrams_in_window", "min_fragment_length"):
            if getattr(self, name) < 1:
                raise InvalidConfig(f"{name} must be at least 1")
        if self.max_fingerprint_count is not None and self.max_fingerprint_count < 1:
            raise InvalidConfig("max_fingerprint_count must be at least 1")
        share = self.max_fingerprint_percentage
        if share is not None and not 0 <= share <= 1:
            raise InvalidConfig("max_fingerprint_percentage must be between 0 and 1")

    def file_cap(self, n_files: int) -> int | None:
        """Files that may share a fingerprint before it is ignored; never below 1, None for no cap."""
        caps = []
        if self.max_fingerprint_count is not None:
            caps.append(self.max_fingerprint_count)
        if self.max_fingerprint_percentage is not None:
            caps.append(math.floor(n_files * self.max_fingerprint_percentage + 0.5))
        return max(1, min(caps)) if caps else None
