"""Job parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any

# Names of the strategies, conflict resolutions and reasons.
STRATEGIES = ("by-extension", "by-date", "by-size", "hybrid")
RESOLUTIONS = ("rename", "skip", "overwrite", "ask")
REASON_DUPLICATE = "duplicate"
REASON_CLASSIFY = "classify"
REASON_FOLDER = "organize_folder"


@dataclass(frozen=True)
class JobConfig:
    """Parameters of one run; unknown keys of a mapping are ignored, unknown values refused."""

    # The defaults below.
    # Category -> subcategory -> extensions; a category given here replaces the default one.
    classification_rules: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    strategy: str = "by-extension"
    conflict_resolution: str = "rename"
    follow_symlinks: bool = False
    ignore_hidden: bool = True
    ignore_patterns: tuple[str, ...] = (
        "**/.devAI/**",
        "**/.git/**",
        "**/node_modules/**",
        "**/__pycache__/**",
    )
    recursive_globs: bool = False
    detect_duplicates: bool = True
    isolate_duplicates: bool = True
    compat_skip_copies: bool = False
    compat_nested: bool = False
    hash_algorithm: str = "sha256"
    hash_block_size: int = 65536
    verify_integrity: bool = False
    log_directory: str = ".devAI"
    directory_prefix: str = "all_"
    duplicates_folder: str = "Duplicates"
    folders_folder: str = "Folders"
    use_metadata: bool = False
    perceptual_dedup: bool = False
    perceptual_threshold: int = 5
    use_magic: bool = False
    watch_interval: float = 1.0
    watch_auto_organize: bool = True
    # Seconds without an event after which a file is complete, and by which an event may be late.
    watch_settle: float = 2.0
    watch_delay: float = 0.0
    # Days after which a path that had no event is forgotten; none means never.
    watch_memory_days: int | None = None
    # Upper bounds in MB of the classes below Over1GB.
    size_bounds_mb: tuple[float, float, float, float] = (1, 10, 100, 1000)
    space_factor: float = 0.1

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {self.strategy}")
        if self.conflict_resolution not in RESOLUTIONS:
            raise ValueError(f"unknown conflict resolution: {self.conflict_resolution}")
        if self.perceptual_threshold < 0:
            raise ValueError("perceptual_threshold must not be negative")

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> JobConfig:
        known = {f.name for f in fields(cls)}
        kept = {key: value for key, value in values.items() if key in known}
        for key in ("ignore_patterns", "size_bounds_mb"):
            if key in kept:
                kept[key] = tuple(kept[key])
        return cls(**kept)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def managed_name(self, name: str) -> str:
        return self.directory_prefix + name
