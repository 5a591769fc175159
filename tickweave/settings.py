"""Window, grace and retention settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Durations in seconds; ``window`` must be a multiple of ``slide``."""

    window: int = 24 * 3600
    slide: int = 30 * 60
    grace: int = 5 * 60
    bar_short: int = 60
    bar_long: int = 600
    bar_grace: int = 30
    retention: int = 72 * 3600
    shards: int = 1
    #: Rows of arrival order handled by one task when stream time is computed.
    seq_block: int = 50_000

    def __post_init__(self) -> None:
        if self.window % self.slide:
            raise ValueError("window must be a multiple of slide")

    @property
    def panes(self) -> int:
        return self.window // self.slide
