"""Settings of the engine; a plain value that closures can carry to executors."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # Fixed values, which results depend on.
    text_weight: float = 0.6
    space_weight: float = 0.4
    max_cost: float = 0.55
    near_miss_margin: float = 0.4
    move_threshold: float = 0.03
    cascade_size: int = 3
    numeric_tolerance: float = 1e-4
    tag_overlap: float = 0.3
    least_anchors: int = 2
    zone_margin: float = 0.02
    border_margin: float = 0.03
    run_gap: float = 3.0
    run_baseline: float = 0.5
    space_gap: float = 0.5
    bubble_padding: float = 0.6
    least_words: int = 20
    ocr_least_conf: float = 0.0
    explain_iou: float = 0.10
    text_confirm: float = 0.6
    near_padding: float = 0.02
    conf_cap: float = 0.45
    conf_base: float = 0.15
    conf_scale: float = 0.35
    diff_threshold: float = 0.25
    least_area: int = 150
    most_area: float = 0.25
    ssim: bool = True
    ssim_window: int = 7
    blur_sigma: float = 1.0
    opened: int = 3
    dilated: int = 9
    k1: float = 1.5
    b: float = 0.75
    delta_boost: float = 1.5
    top_k: int = 8
    match_floor: float = 60.0
    support_floor: float = 45.0
    sentence_window: int = 200
    ladder_dpi: tuple = (200, 150, 120)
    jpeg_quality: int = 70
    # Memory only: pixels of a tile's side.
    tile: int = 512


DEFAULT = Settings()


def from_mapping(values: dict[str, str], prefix: str = "") -> Settings:
    """Settings from strings such as environment variables, read once on the driver; names are upper-cased fields."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    read = {bool: lambda v: v.strip().lower() in ("1", "true", "yes", "on"), tuple: lambda v: tuple(int(x) for x in v.split(","))}
    kinds = {n: read.get(k, k) for n, k in kinds.items()}
    found = {n: kinds[n](values[prefix + n.upper()]) for n in kinds if prefix + n.upper() in values}
    return replace(DEFAULT, **found)
