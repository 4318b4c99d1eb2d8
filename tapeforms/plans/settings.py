"""The settings of an experiment, their coercion, and the hash that identifies it."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from dataclasses import dataclass
from typing import Any

from tapeforms.functions.candles import CANDLES
from tapeforms.functions.templates import TEMPLATES

# The names of the settings, their defaults, and which count in the identity of an experiment, since hashes of other
# installations have to be met. First those of every experiment, then those of each signal source.
SHARED = ("signal_source", "symbols", "timeframe", "horizon", "min_history_bars", "enable_shorts", "cost_bps", "split_date", "query_stride")
OF_SOURCE = {
    "knn_shape": ("window", "k", "dedup_gap", "p_threshold", "t_multiplier", "min_matches", "features", "normalization"),
    "template": ("window", "normalization", "template_patterns", "template_threshold"),
    "candles": ("candle_patterns", "candle_trend_lookback"),
}
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


@dataclass(frozen=True)
class Settings:
    """Names and defaults, see above."""

    signal_source: str = "knn_shape"
    symbols: tuple[str, ...] = ("QQQ",)
    timeframe: str = "1Min"
    window: int = 30
    horizon: int = 15
    k: int = 50
    dedup_gap: int = 15
    p_threshold: float = 0.65
    t_multiplier: float = 1.5
    min_matches: int = 20
    min_history_bars: int = 35000
    features: str = "close"
    normalization: str = "logret_zscore"
    template_patterns: tuple[str, ...] = tuple(TEMPLATES)
    template_threshold: float = 3.5
    candle_patterns: tuple[str, ...] = tuple(CANDLES)
    candle_trend_lookback: int = 10
    enable_shorts: bool = False
    cost_bps: float = 5.0
    split_date: str = "2022-12-31"
    query_stride: int = 1
    position_size: float = 0.05
    force_flat_minutes_before_close: int = 5
    seed: int = 42
    warehouse: str = "warehouse"
    db_path: str = ""
    reports_dir: str = "reports"
    block_size: int = 1024
    candidate_chunk: int = 65536

    def identity(self) -> dict[str, Any]:
        """The fields that make two runs the same experiment; what the active source does not read is left out."""
        if self.signal_source not in OF_SOURCE:
            raise KeyError(f"unknown signal source {self.signal_source!r}")
        return {name: getattr(self, name) for name in (*SHARED, *OF_SOURCE[self.signal_source])}

    def identity_json(self) -> str:
        return json.dumps(self.identity(), sort_keys=True, separators=(",", ":"))

    @property
    def hash(self) -> str:
        return hashlib.sha256(self.identity_json().encode()).hexdigest()[:12]


def coerced(name: str, value: Any) -> Any:
    """value as the type of the field's default; an unknown name is an error."""
    fields = {f.name: f.default for f in dataclasses.fields(Settings)}
    if name not in fields:
        raise KeyError(f"unknown setting {name!r}")
    default = fields[name]
    if isinstance(default, tuple):
        items = [x.strip() for x in value.split(",")] if isinstance(value, str) else [str(x) for x in value]
        return tuple(x.upper() if name == "symbols" else x for x in items if x)
    if isinstance(default, bool):
        text = str(value).strip().lower()
        if text not in TRUE + FALSE:
            raise ValueError(f"{name}: {value!r} is neither true nor false")
        return text in TRUE
    return type(default)(value)


def settings(values: dict[str, Any] | None = None, overrides: list[str] | None = None) -> Settings:
    """Settings from a mapping, as read from a YAML file, and overrides "name=value"."""
    out = {k: coerced(k, v) for k, v in (values or {}).items()}
    for item in overrides or []:
        name, _, value = item.partition("=")
        out[name.strip()] = coerced(name.strip(), value)
    return Settings(**out)


def _plain(line: str) -> str:
    """The line without its comment: a # at its start or behind a space, outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and (i == 0 or line[i - 1] in " [,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def _items(text: str) -> list[str]:
    """The items of a text that commas separate outside quotes, unquoted."""
    return [x.strip().strip("'\"") for x in re.findall(r"""\s*("[^"]*"|'[^']*'|[^,]+)""", text) if x.strip()]


def from_yaml(path: str, overrides: list[str] | None = None) -> Settings:
    """Settings from a file of "name: value" lines, "- item" lists and [lists] over any number of lines; comments and blank lines are left out. Nested mappings are an error."""
    values: dict[str, Any] = {}
    key, listed = None, ""
    with open(path, encoding="utf-8") as lines:
        for raw in lines:
            line = _plain(raw.rstrip("\n")).rstrip()
            if listed:
                listed += " " + line.strip()
            elif not line.strip() or line == "---":
                continue
            elif line.lstrip().startswith("- ") and key:
                values[key] = [*(values[key] or []), *_items(line.lstrip()[2:])]
                continue
            elif line[0].isspace():
                raise ValueError(f"{path}: {line.strip()!r} is nested")
            else:
                key, _, value = (x.strip() for x in line.partition(":"))
                values[key] = value.strip("'\"") or None
                listed = value if value.startswith("[") else ""
            if listed.endswith("]"):
                values[key], listed = _items(listed[1:-1]), ""
    if listed:
        raise ValueError(f"{path}: the list of {key} doesn't end")
    return settings({k: v for k, v in values.items() if v is not None}, overrides)
