"""Stage parameters: dataclasses with the detector's defaults, read from YAML, overridden by `stage.name=value`."""

from __future__ import annotations

import ast
from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace

import yaml

SENSORS = tuple(f"sensor_{i}" for i in range(1, 7))


@dataclass(frozen=True)
class Base:
    sensor_freq: float = 1024
    sensation_freq: float = 1024
    description: str = ""
    sensor_map: dict = field(default_factory=lambda: {"accelerometer": ["sensor_1", "sensor_2"], "piezoelectric_large": ["sensor_3", "sensor_6"], "other": ["sensor_4", "sensor_5"]})
    sensor_selection: Sequence[str] = ("piezoelectric_large",)

    @property
    def sensors(self) -> list[str]:
        """Selected sensors in order; a selection names a type, or its left or right one."""
        chosen = []
        for name in self.sensor_selection:
            if name in self.sensor_map:
                chosen += self.sensor_map[name]
            else:
                kind, _, side = name.rpartition("_")
                chosen.append(self.sensor_map[kind][("left", "right").index(side)])
        return sorted(chosen)

    @property
    def all_types(self) -> bool:
        return len(self.sensor_selection) == len(self.sensor_map)

    def samples(self, seconds: float) -> int:
        return round(seconds * self.sensor_freq)


@dataclass(frozen=True)
class Preprocess(Base):
    resolve_debounce: bool = True
    debounce_thresh: float = 97.65625  # ms

    @property
    def debounce_samples(self) -> int:
        return int(self.debounce_thresh * self.sensation_freq / 1000)


@dataclass(frozen=True)
class Segment(Base):
    percentile_threshold: dict = field(default_factory=lambda: dict.fromkeys(SENSORS, 0.0))
    imu_modalities: Sequence[str] = ("imu_acceleration", "imu_rotation", "sensors")
    num_common_sensors_imu: int = 2
    imu_acceleration_threshold: float = 0.2
    imu_rotation_threshold: float = 4.0
    maternal_dilation_forward: float = 2.0
    maternal_dilation_backward: float = 5.0
    imu_dilation: float = 4.0
    fm_dilation: float = 3.0
    fm_min_sn: float | Sequence[float] = 40
    fm_signal_cutoff: float = 1e-4
    remove_imu: bool = True

    def factor(self, sensor: str) -> float:
        return float(self.fm_min_sn) if isinstance(self.fm_min_sn, (int, float)) else float(self.fm_min_sn[int(sensor[-1]) - 1])


@dataclass(frozen=True)
class Fusion(Base):
    desired_scheme: Sequence = ("type", 1)


@dataclass(frozen=True)
class Features(Base):
    freq_bands: Sequence = ((1, 2), (2, 5), (5, 10), (10, 20), (20, 30))
    freq_mode_threshold: float = 1
    feature_sets: Sequence[str] = ("crafted",)
    add_imu_features: bool = True


STAGES = {"load": Base, "preprocess": Preprocess, "segment": Segment, "fusion": Fusion, "extract_det": Base, "extract_feat": Features}


def build(stage: str, values: dict) -> Base:
    known = {f.name for f in fields(STAGES[stage])}
    if strange := set(values) - known:
        raise ValueError(f"{stage} has no parameter {', '.join(sorted(strange))}")
    return STAGES[stage](**values)


def read(path: str, overrides: Sequence[str] = ()) -> dict[str, Base]:
    """Stages of a YAML file's data_pipeline, or their defaults; overrides like `segment.fm_dilation=2`."""
    with open(path) as f:
        given = (yaml.safe_load(f) or {}).get("data_pipeline", {})
    return override({s: build(s, given.get(s) or {}) for s in STAGES}, overrides)


def override(stages: dict[str, Base], overrides: Sequence[str]) -> dict[str, Base]:
    out = dict(stages)
    for text in overrides:
        where, _, value = text.partition("=")
        stage, _, name = where.partition(".")
        if name not in {f.name for f in fields(out[stage])}:
            raise ValueError(f"{stage} has no parameter {name}")
        out[stage] = replace(out[stage], **{name: ast.literal_eval(value)})
    return out
