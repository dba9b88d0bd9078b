"""Collection settings, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Limits of a collection run. A lease has to outlast a whole chain of requests with their time-outs and pauses."""

    sources: tuple[str, ...]
    workers: int = 4
    tasks: int = 60_000
    global_delay: float = 0.5
    source_delay: float = 3.0
    timeout: float = 30.0
    redirects: int = 5
    lease: float = 600.0
    max_attempts: int = 5
    known: tuple[str, ...] | None = None

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "int" and (not isinstance(value, int) or isinstance(value, bool) or value < 1):
                raise ValueError(f"{f.name} must be a positive integer")
            if f.type == "float" and (not isinstance(value, (int, float)) or isinstance(value, bool) or not 0 <= value < 86_400):
                raise ValueError(f"{f.name} must be seconds within a day")
        if not self.sources or len(set(self.sources)) != len(self.sources):
            raise ValueError("sources must be given once each")
        if self.known is not None and (unknown := set(self.sources) - set(self.known)):
            raise ValueError(f"unknown sources: {sorted(unknown)}")
        if self.lease <= (self.redirects + 1) * (self.timeout + max(self.global_delay, self.source_delay)):
            raise ValueError("the lease is shorter than a chain of requests may take")
