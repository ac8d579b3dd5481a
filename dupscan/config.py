"""Settings of a detection."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum


class DetectionMode(str, Enum):
    """fast: equal windows (Type-1, Type-2); balanced: similar files too (Type-3); precise: as balanced, with the
    finer defaults of `DetectionConfig.precise`."""

    FAST = "fast"
    BALANCED = "balanced"
    PRECISE = "precise"


class CloneType(str, Enum):
    TYPE1, TYPE2, TYPE3, TYPE4 = "Type-1", "Type-2", "Type-3", "Type-4"

    def __str__(self) -> str:
        return self.value


@dataclass(frozen=True)
class DetectionConfig:
    """min_tokens: window length; min_lines: least lines of an instance; similarity_threshold: least Jaccard similarity of
    Type-3; ignore_comments and ignore_whitespace: False keeps such tokens in windows; mask: match identifiers and literals
    by kind; whole_units: regions of Python code do not reach across top-level definitions; on_error: 'fail' or 'skip' for files that cannot be read or lexed."""

    mode: DetectionMode = DetectionMode.BALANCED
    min_tokens: int = 50
    min_lines: int = 5
    similarity_threshold: float = 0.85
    ignore_comments: bool = True
    ignore_whitespace: bool = True
    mask: bool = True
    whole_units: bool = True
    on_error: str = "fail"

    def __post_init__(self) -> None:
        object.__setattr__(self, "mode", DetectionMode(self.mode))
        if self.min_tokens < 1:
            raise ValueError("min_tokens must be 1 or more")
        if self.min_lines < 0:
            raise ValueError("min_lines must not be negative")
        if not 0 <= self.similarity_threshold <= 1:
            raise ValueError("similarity_threshold must lie in 0..1")
        if self.on_error not in ("fail", "skip"):
            raise ValueError("on_error must be 'fail' or 'skip'")

    @property
    def finds_similar(self) -> bool:
        """Whether similar files (Type-3) are part of a report."""
        return self.mode is not DetectionMode.FAST

    @classmethod
    def fast(cls) -> DetectionConfig:
        return cls(mode=DetectionMode.FAST)

    @classmethod
    def balanced(cls) -> DetectionConfig:
        return cls()

    @classmethod
    def precise(cls) -> DetectionConfig:
        return cls(mode=DetectionMode.PRECISE, min_tokens=30, similarity_threshold=0.8)

    def with_(self, **changes) -> DetectionConfig:
        return replace(self, **changes)
