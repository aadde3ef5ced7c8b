"""Settings of a run, checked when they are made."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from lodestack.errors import ConfigError

#: Bounds (least, most) of the numeric settings; None is open.
BOUNDS = {
    "max_pages": (1, None), "max_depth": (0, None), "requests_per_second": (0.01, None), "host_concurrency": (1, None), "global_concurrency": (1, None),
    "crawl_delay": (0, None), "max_retries": (0, 20), "retry_base": (0, None), "retry_cap": (0, None), "breaker_threshold": (1, None), "breaker_reset": (0, None),
    "snapshot_max_bytes": (1, None), "timeout": (0.1, None),
}
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@dataclass(frozen=True)
class Settings:
    database_url: str = "postgresql+asyncpg://localhost/listings"
    user_agent: str = "lodestack/0.1"
    log_level: str = "INFO"
    max_pages: int = 200
    max_depth: int = 2
    requests_per_second: float = 1.0
    host_concurrency: int = 2
    global_concurrency: int = 8
    crawl_delay: float = 1.0
    max_retries: int = 4
    retry_base: float = 0.5
    retry_cap: float = 30.0
    breaker_threshold: int = 8
    breaker_reset: float = 60.0
    snapshot_max_bytes: int = 4 * 1024 * 1024
    timeout: float = 20.0
    respect_robots: bool = True
    archive: bool = True

    def __post_init__(self):
        for name, (least, most) in BOUNDS.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or (least is not None and value < least) or (most is not None and value > most):
                raise ConfigError(f"{name}={value!r} is out of bounds")
        if not self.user_agent.strip():
            raise ConfigError("user_agent must not be blank")
        if self.log_level.upper() not in LOG_LEVELS:
            raise ConfigError(f"no log level {self.log_level!r}")
        object.__setattr__(self, "log_level", self.log_level.upper())

    @property
    def sync_database_url(self) -> str:
        """The database url without its asynchronous driver."""
        return re.sub(r"^(\w+)\+(asyncpg|aiosqlite)", r"\1", self.database_url)

    @classmethod
    def from_mapping(cls, values: dict) -> Settings:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)


def request_params(**params: object) -> dict[str, object]:
    """Query parameters without those that say nothing: None, empty lists and empty texts."""
    return {k: v for k, v in params.items() if v is not None and v != "" and v != [] and v != ()}
