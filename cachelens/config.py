"""Settings of a fleet that influence results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    role: str = "cache"
    peer: str = "127.0.0.1:23456"
    bootstrap_peers: tuple[str, ...] = ()
    peer_eviction_timeout_s: float = 10.0
    health_check_timeout_s: float = 3.0
    health_check_interval_s: float = 1.0
    health_check_peers: int = 3
    sync_timeout_s: float = 3.0
    sync_interval_s: float = 1.0
    sync_peers: int = 3
    weight: int = 1
    bucket: str = "data"
    endpoint: str = "http://localhost:9000"
    region: str = "us-east-1"
    access_key_id: str = ""
    secret_access_key: str = ""
    cache_mem_bytes: int = 64 << 20
    cache_disk_bytes: int = 1 << 30
    cache_dir: str | None = None
    api_prefix: str = "/api"
    tls: bool = False
    report_interval_s: float = 1.0
    log_rotation: str = "never"

    def __post_init__(self) -> None:
        if self.role not in ("agent", "cache"):
            raise ValueError(f"unknown role: {self.role}")
        if self.log_rotation not in ("minutely", "hourly", "daily", "never"):
            raise ValueError(f"unknown rotation: {self.log_rotation}")
        if self.weight < 0:
            raise ValueError("weight must not be negative")
