"""Constants, configuration and dimensions of the cache model."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Limits and defaults of the cache protocol and engine.
MEMORY_LIMIT_BYTES = 64 << 20
MAX_KEY_BYTES = 256
MAX_VALUE_BYTES = 1 << 20
MAX_COMMAND_ARGS = 1024
MAX_BULK_BYTES = 8 << 20
SSD_VALUE_MIN_BYTES = 32 << 10
SSD_MAX_BYTES = 2 << 30
PROMOTION_HITS = 3
DEMOTION_PRESSURE = 0.90
TTL_CLEANUP_PER_TICK = 128
TIER_WORK_PER_TICK = 64
FRAGMENTATION_THRESHOLD = 0.25

# Owners with their miss cost and default time to live in milliseconds.
OWNER_MISS_COST = {"default": 1.0, "premium": 2.0, "vector": 8.0, "prompt": 2.0, "rag": 3.0, "rerank": 4.0, "response": 5.0}
OWNER_TTL_MS = {"rerank": 300_000, "response": 3_600_000, "prompt": 86_400_000, "vector": 604_800_000, "rag": 21_600_000}
DEFAULT_TTL_MS = 3_600_000
TYPE_MISS_COST = {"embedding": 8.0, "rerank_buffer": 3.0, "response": 4.0, "prompt": 2.0, "rag_chunk": 2.5}

# Bases and prime of the 64-bit and 32-bit FNV-1a hashes; content uses a basis of its own.
CONTENT_BASIS = 1469598103934665603
FNV64_BASIS = 14695981039346656037
FNV64_PRIME = 1099511628211
FNV32_BASIS = 2166136261
FNV32_PRIME = 16777619


@dataclass(frozen=True)
class PolicyParams:
    w_miss: float = 1.0
    w_reuse: float = 1.0
    w_mem: float = 1.0
    w_risk: float = 1.0
    admit_threshold: float = 0.0
    evict_pressure: float = 0.8
    max_evictions_per_second: int = 10_000
    max_admissions_per_second: int = 10_000
    owner_cap_bytes: int = 0
    version: str = "defaults-v1"


#: Bounds of each parameter.
PARAM_BOUNDS = {
    "w_miss": (0.0, 1000.0),
    "w_reuse": (0.0, 1000.0),
    "w_mem": (0.0, 1000.0),
    "w_risk": (0.0, 1000.0),
    "admit_threshold": (-1e9, 1e9),
    "evict_pressure": (0.1, 1.0),
    "max_evictions_per_second": (1, 1_000_000),
    "max_admissions_per_second": (1, 1_000_000),
    "owner_cap_bytes": (0, 1 << 40),
}


@dataclass(frozen=True)
class CacheConfig:
    memory_limit_bytes: int = MEMORY_LIMIT_BYTES
    max_key_bytes: int = MAX_KEY_BYTES
    max_value_bytes: int = MAX_VALUE_BYTES
    ssd_enabled: bool = False
    ssd_value_min_bytes: int = SSD_VALUE_MIN_BYTES
    ssd_max_bytes: int = SSD_MAX_BYTES
    promotion_hits: int = PROMOTION_HITS
    demotion_pressure: float = DEMOTION_PRESSURE
    ssd_read_mb_per_s: float = 256.0
    ssd_write_mb_per_s: float = 256.0
    ttl_cleanup_per_tick: int = TTL_CLEANUP_PER_TICK
    tier_work_per_tick: int = TIER_WORK_PER_TICK
    policy: str = "cost"
    params: PolicyParams = PolicyParams()


# Start-up options, and what of the configuration each sets.
OPTIONS = {
    "--memory": ("memory_limit_bytes", int),
    "--policy": ("policy", str),
    "--ssd-value-min-bytes": ("ssd_value_min_bytes", int),
    "--ssd-max-bytes": ("ssd_max_bytes", int),
    "--promotion-hits": ("promotion_hits", int),
    "--demotion-pressure": ("demotion_pressure", float),
    "--ssd-read-mb-s": ("ssd_read_mb_per_s", float),
    "--ssd-write-mb-s": ("ssd_write_mb_per_s", float),
}
OTHER_OPTIONS = ("--port", "--params", "--data-dir", "--fsync")


def configured(args: list[str], first: CacheConfig | None = None) -> tuple[CacheConfig, dict[str, str]]:
    """The configuration that start-up options ask for, and the options that are not part of it (port, params, data-dir, fsync).

    The last of a kind counts. Unknown words, and an option whose value is missing, are passed over.
    """
    changes, others = {}, {}
    words = iter(args)
    for word in words:
        if word == "--ssd-enabled":
            changes["ssd_enabled"] = True
        elif word in OPTIONS or word in OTHER_OPTIONS:
            value = next(words, None)
            if value is None:
                break
            if word in OPTIONS:
                name, kind = OPTIONS[word]
                changes[name] = kind(value)
            else:
                others[word.removeprefix("--")] = value
    return replace(first or CacheConfig(), **changes), others
