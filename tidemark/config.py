"""Settings of one telemetry store."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("classic", "centralized")


@dataclass(frozen=True)
class StoreConfig:
    """Settings that steer a collection run.

    ``mode`` is compared without regard to case.  ``execution_threshold=None``
    means the default of 2.  ``maximum_size_mb=None`` sets no limit to the size, and
    ``data_cleanup_throttle=None`` removes everything that has expired in one go.
    """

    collection_active: bool = False
    collection_interval: int = 60
    mode: str = "classic"
    classic_database: str | None = None
    execution_threshold: int | None = 2
    maximum_size_mb: int | None = None
    data_cleanup_active: bool = False
    data_cleanup_threshold: int = 30
    data_cleanup_throttle: int | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "mode", self.mode.lower())
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, got {self.mode!r}")
        if self.execution_threshold is None:
            object.__setattr__(self, "execution_threshold", 2)
        if self.execution_threshold < 0:
            raise ValueError("execution_threshold must not be negative")
        if self.data_cleanup_threshold < 0:
            raise ValueError("data_cleanup_threshold must not be negative")
        if self.collection_interval <= 0:
            raise ValueError("collection_interval must be positive")
        if self.maximum_size_mb is not None and self.maximum_size_mb < 0:
            raise ValueError("maximum_size_mb must not be negative")
        if self.data_cleanup_throttle is not None and self.data_cleanup_throttle < 0:
            raise ValueError("data_cleanup_throttle must not be negative")
        if self.mode == "classic" and self.collection_active and not self.classic_database:
            raise ValueError("classic mode needs classic_database")

    def trigger(self) -> dict[str, str]:
        """Arguments of ``DataStreamWriter.trigger`` that match the collection interval."""
        return {"processingTime": f"{self.collection_interval} seconds"}
