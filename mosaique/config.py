"""Models, resolution tiers and feature modes."""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelConfig:
    """A vision transformer. Means and deviations of pixels are those of ImageNet."""

    hidden: int
    layers: int
    heads: int
    intermediate: int
    patch: int = 16
    registers: int = 4
    height: int = 518
    width: int = 518
    mean: tuple[float, float, float] = (0.485, 0.456, 0.406)
    std: tuple[float, float, float] = (0.229, 0.224, 0.225)

    @property
    def patches(self) -> int:
        return (self.height // self.patch) * (self.width // self.patch)

    @property
    def tokens(self) -> int:
        return 1 + self.registers + self.patches

    @property
    def output_dim(self) -> int:
        return self.tokens * self.hidden


PRESETS = {
    "small": ModelConfig(384, 12, 6, 1536),
    "base": ModelConfig(768, 12, 12, 3072),
    "large": ModelConfig(1024, 24, 16, 4096),
    "huge": ModelConfig(1280, 32, 20, 5120),
}
#: Parts of model file names and the length of their class token.
DIM_BY_NAME = [("vits16", 384), ("vitb16", 768), ("vitl16", 1024), ("vith16", 1280)]


@dataclass(frozen=True)
class ModelInfo:
    name: str
    backend: str
    config: ModelConfig
    quantization: str | None = None


@dataclass(frozen=True)
class Settings:
    """full: keep all tokens instead of the class token. tier: `fast`, `ultra` or `high`."""

    full: bool = False
    tier: str = "fast"
    model: ModelConfig = field(default=PRESETS["small"])
    model_id: str = "default"

    @staticmethod
    def from_environment() -> Settings:
        """From MOSAIQUE_FEATURE_MODE and MOSAIQUE_TIER; words that mean nothing give the defaults."""
        tier = os.environ.get("MOSAIQUE_TIER", "").strip().lower()
        return Settings(os.environ.get("MOSAIQUE_FEATURE_MODE", "").strip().lower() == "full", tier if tier in ("high", "ultra") else "fast")

    @property
    def feature_length(self) -> int:
        return self.model.output_dim if self.full else self.model.hidden


def input_side(tier: str, config: ModelConfig = PRESETS["small"]) -> int:
    return {"high": config.width, "ultra": 224}.get(tier, 256)


def chunk_size(width: int) -> int:
    """Images that are embedded together, by the width of the model's input."""
    return 512 if width <= 224 else 256 if width <= 256 else 64


def chunk_size_column(width: Column) -> Column:
    return F.when(width <= 224, 512).when(width <= 256, 256).otherwise(64)


def input_side_column(tier: Column, side: Column) -> Column:
    tier = F.lower(tier)
    return F.when(tier == "high", side).when(tier == "ultra", F.lit(224)).otherwise(F.lit(256))


def output_dim_column(height: Column, width: Column, patch: Column, registers: Column, hidden: Column) -> Column:
    """Length of all tokens' output; sides are cut to whole patches."""
    return (F.lit(1) + registers + F.floor(height / patch) * F.floor(width / patch)) * hidden


def expected_length(path: Column, full: bool = False) -> Column:
    """The vector length that a model file's name tells; null if it does not, or if all tokens are kept."""
    if full:
        return F.lit(None).cast("int")
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    out = F.when(F.lit(False), F.lit(0))
    for part, dim in DIM_BY_NAME:
        out = out.when(F.contains(name, F.lit(part)), dim)
    return out.cast("int")


def find_model(explicit: str | None, folders: list[str], names: list[str], variable: str = "MOSAIQUE_MODEL") -> str | None:
    """A model file: the one asked for, else that of an environment variable, else the first of some names in some
    folders."""
    for path in (explicit, os.environ.get(variable)):
        if path:
            if not os.path.isfile(path):
                raise FileNotFoundError(path)
            return path
    return next((p for f in folders for n in names if os.path.isfile(p := os.path.join(f, n))), None)


#: The files that a backend looks for, and the variable that names one.
MODEL_FILES = {"onnx": (["model.onnx", "model_q4.onnx"], "MOSAIQUE_ONNX_MODEL"), "numpy": (["model.safetensors"], "MOSAIQUE_NUMPY_MODEL")}


def model_for(backend: str, explicit: str | None = None) -> str | None:
    """The model file of a backend: the one asked for, that of its variable, or one in MOSAIQUE_MODELS, in models beside
    the running script or in models here."""
    names, variable = MODEL_FILES[backend]
    folders = [os.environ.get("MOSAIQUE_MODELS", ""), os.path.join(os.path.dirname(os.path.abspath(sys.argv[0])), "models"), "models"]
    return find_model(explicit, [f for f in folders if f], names, variable)


def settings_for(backend: str, path: str | None, tier: str = "fast", full: bool = False) -> Settings:
    """Settings of a model file: its size by its name, small if that tells nothing; a tier sets the side of the images
    that the numpy backend takes. An ONNX file has its own."""
    name = os.path.basename(path or "").lower()
    hidden = next((dim for part, dim in DIM_BY_NAME if part in name), PRESETS["small"].hidden)
    model = next(m for m in PRESETS.values() if m.hidden == hidden)
    if backend == "numpy":
        side = input_side(tier, model)
        model = replace(model, height=side, width=side)
    return Settings(full, tier, model, f"{backend}:{os.path.basename(path)}" if path else "default")
