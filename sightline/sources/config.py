"""Settings from YAML files, and checks of a dataset description."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from sightline.operators.tracker import Settings
from sightline.plans.pipeline import Options


def _load(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        value = yaml.safe_load(f) or {}
    if not isinstance(value, dict):
        raise ValueError(f"{path} must hold names with values")
    return value


def read_options(path: str) -> Options:
    """Pipeline options of a YAML file, tracking settings under ``tracking``; unknown names and values out of range are errors."""
    value = _load(path)
    tracking = value.pop("tracking", None) or {}
    for kind, given in ((Options, value), (Settings, tracking)):
        if unknown := set(given) - {f.name for f in fields(kind)}:
            raise ValueError(f"{path}: unknown settings {', '.join(sorted(map(str, unknown)))}")
    out = Options(tracking=Settings(**tracking), **value)
    if out.ocr_every < 1 or out.min_reads < 1 or out.cooldown_us < 0 or out.max_edits not in (0, 1, 2) or not 0 <= out.min_confidence <= 1:
        raise ValueError(f"{path}: a setting is out of range")
    return out


@dataclass(frozen=True)
class Training:
    """What a training run that reads an exported tree is told; ``extra`` goes through to it as it is."""

    model: str = "yolov8s.pt"
    epochs: int = 100
    batch: int = 16
    imgsz: int = 640
    close_mosaic: int = 10
    flipud: float = 0.0
    fliplr: float = 0.0
    mosaic: float = 1.0
    seed: int = 0
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        wrong = [n for n in ("epochs", "batch") if getattr(self, n) < 1] + [n for n in ("flipud", "fliplr", "mosaic") if not 0 <= getattr(self, n) <= 1]
        if self.imgsz < 32 or self.imgsz % 32:
            wrong.append("imgsz (a multiple of 32)")
        if self.close_mosaic > self.epochs:
            wrong.append("close_mosaic (more than epochs)")
        if wrong:
            raise ValueError(f"settings out of range: {', '.join(wrong)}")


def read_training(path: str) -> Training:
    """Training settings of a YAML file; unknown names and values out of range are errors."""
    value = _load(path)
    if unknown := set(value) - {f.name for f in fields(Training)}:
        raise ValueError(f"{path}: unknown settings {', '.join(sorted(map(str, unknown)))}; what is meant for the trainer itself goes under extra")
    return Training(**value)


def dataset_problems(path: str) -> list[str]:
    """What is missing in a dataset description: its keys path, train, val and names, and the folders it names."""
    if not os.path.exists(path):
        return [f"{path} is missing"]
    value = _load(path)
    out = [f"key {k} is missing" for k in ("path", "train", "val", "names") if k not in value]
    root = value.get("path") or os.path.dirname(path)
    out += [f"folder {value[k]} is missing" for k in ("train", "val", "test") if value.get(k) and not os.path.isdir(os.path.join(root, value[k]))]
    return out
