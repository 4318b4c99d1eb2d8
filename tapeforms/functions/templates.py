"""The library of named chart shapes."""

from __future__ import annotations

import math

# Name, direction, and relative close levels at evenly spaced control points.
TEMPLATES: dict[str, tuple[str, tuple[float, ...]]] = {
    "double_bottom": ("LONG", (1.00, 0.62, 0.80, 0.60, 1.00)),
    "triple_bottom": ("LONG", (1.00, 0.60, 0.85, 0.60, 0.85, 0.60, 1.00)),
    "inverse_head_shoulders": ("LONG", (1.00, 0.82, 0.98, 0.68, 0.98, 0.82, 1.08)),
    "rounding_bottom": ("LONG", (1.00, 0.70, 0.50, 0.42, 0.50, 0.70, 1.00)),
    "cup_with_handle": ("LONG", (1.00, 0.62, 0.46, 0.52, 0.74, 0.96, 1.00, 0.90, 0.97)),
    "v_reversal": ("LONG", (1.00, 0.70, 0.45, 0.70, 1.00)),
    "double_top": ("SHORT", (1.00, 1.38, 1.20, 1.40, 1.00)),
    "triple_top": ("SHORT", (1.00, 1.40, 1.15, 1.40, 1.15, 1.40, 1.00)),
    "head_shoulders": ("SHORT", (1.00, 1.18, 1.02, 1.32, 1.02, 1.18, 0.92)),
    "spike_top": ("SHORT", (1.00, 1.30, 1.55, 1.30, 1.00)),
    "bull_flag": ("LONG", (0.55, 0.85, 1.05, 1.00, 0.97)),
    "high_tight_flag": ("LONG", (0.30, 0.68, 1.00, 1.05, 1.02, 1.05)),
    "ascending_triangle": ("LONG", (0.50, 1.00, 0.72, 1.00, 0.86, 1.00, 0.95)),
    "falling_wedge": ("LONG", (1.00, 0.62, 0.84, 0.56, 0.76, 0.62, 0.72)),
    "ascending": ("LONG", (0.80, 0.86, 0.92, 0.97, 1.03)),
    "bear_flag": ("SHORT", (1.45, 1.15, 0.95, 1.00, 1.03)),
    "descending_triangle": ("SHORT", (1.00, 0.50, 0.84, 0.50, 0.70, 0.50, 0.60)),
    "rising_wedge": ("SHORT", (1.00, 1.38, 1.16, 1.44, 1.24, 1.38, 1.28)),
}
FLAT = 1e-12


def template_vector(anchors: tuple[float, ...], window: int, zscore: bool = True) -> list[float]:
    """The log returns of the shape drawn over window + 1 bars by linear interpolation, normalised like a window of bars."""
    last = len(anchors) - 1
    path = []
    for i in range(window + 1):
        x = i * last / window
        j = min(int(x), last - 1)
        path.append(anchors[j] + (anchors[j + 1] - anchors[j]) * (x - j))
    returns = [math.log(b / a) for a, b in zip(path, path[1:], strict=False)]
    mean = math.fsum(returns) / window
    spread = math.sqrt(math.fsum((r - mean) ** 2 for r in returns) / window)
    if spread <= FLAT:
        raise ValueError("a flat sketch has no shape")
    return [(r - mean) / spread for r in returns] if zscore else returns


def chosen(names: tuple[str, ...]) -> list[tuple[str, str, tuple[float, ...]]]:
    if not names:
        raise ValueError("no template is enabled")
    missing = [n for n in names if n not in TEMPLATES]
    if missing:
        raise KeyError(f"unknown templates {missing}")
    return [(n, *TEMPLATES[n]) for n in names]
