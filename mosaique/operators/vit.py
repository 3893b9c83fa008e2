"""A vision transformer in numpy, and its weights from safetensors files. For small models and for tests of others."""

from __future__ import annotations

import json
import math
import struct
from pathlib import Path

import numpy as np

from ..config import ModelConfig, ModelInfo
from . import media

#: Base of the rotary frequencies, and what is added to variances.
ROPE_BASE, EPSILON = 100.0, 1e-5
#: Names of tensors in published files; {i} is a layer. The first that is there is taken.
NAMES = {
    "patch.weight": ["embeddings.patch_embeddings.weight", "patch_embed.proj.weight"],
    "patch.bias": ["embeddings.patch_embeddings.bias", "patch_embed.proj.bias"],
    "cls": ["embeddings.cls_token", "cls_token"],
    "registers": ["embeddings.register_tokens", "reg_token", "storage_tokens"],
    "norm.weight": ["norm.weight", "layernorm.weight"],
    "norm.bias": ["norm.bias", "layernorm.bias"],
}
LAYER_NAMES = {
    "norm1": ["layer.{i}.norm1", "blocks.{i}.norm1", "model.layer.{i}.norm1"],
    "norm2": ["layer.{i}.norm2", "blocks.{i}.norm2", "model.layer.{i}.norm2"],
    "q": ["layer.{i}.attention.q_proj", "model.layer.{i}.attention.q_proj"],
    "k": ["layer.{i}.attention.k_proj", "model.layer.{i}.attention.k_proj"],
    "v": ["layer.{i}.attention.v_proj", "model.layer.{i}.attention.v_proj"],
    "qkv": ["blocks.{i}.attn.qkv"],
    "out": ["layer.{i}.attention.o_proj", "blocks.{i}.attn.proj", "model.layer.{i}.attention.o_proj"],
    "up": ["layer.{i}.mlp.up_proj", "blocks.{i}.mlp.fc1", "layer.{i}.mlp.fc1", "model.layer.{i}.mlp.up_proj"],
    "gate": ["layer.{i}.mlp.gate_proj", "blocks.{i}.mlp.fc1_g", "model.layer.{i}.mlp.gate_proj"],
    "down": ["layer.{i}.mlp.down_proj", "blocks.{i}.mlp.fc2", "layer.{i}.mlp.fc2", "model.layer.{i}.mlp.down_proj"],
    "scale1": ["layer.{i}.layer_scale1.lambda1", "blocks.{i}.gamma_1", "blocks.{i}.ls1.gamma", "model.layer.{i}.layer_scale1.lambda1"],
    "scale2": ["layer.{i}.layer_scale2.lambda1", "blocks.{i}.gamma_2", "blocks.{i}.ls2.gamma", "model.layer.{i}.layer_scale2.lambda1"],
}
_KINDS = {"F32": "<f4", "F16": "<f2", "F64": "<f8"}


def read_safetensors(path: str) -> dict[str, np.ndarray]:
    """Tensors by name, as single precision."""
    data = Path(path).read_bytes()
    size = struct.unpack_from("<Q", data)[0]
    out = {}
    for name, what in json.loads(data[8 : 8 + size]).items():
        if name == "__metadata__":
            continue
        start, end = (8 + size + x for x in what["data_offsets"])
        raw = data[start:end]
        if what["dtype"] == "BF16":
            values = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
        else:
            values = np.frombuffer(raw, _KINDS[what["dtype"]]).astype(np.float32)
        out[name] = values.reshape(what["shape"])
    return out


def write_safetensors(path: str, tensors: dict[str, np.ndarray]) -> None:
    head, parts, at = {}, [], 0
    for name, t in tensors.items():
        raw = np.ascontiguousarray(t, dtype="<f4").tobytes()
        head[name] = {"dtype": "F32", "shape": list(t.shape), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    Path(path).write_bytes(struct.pack("<Q", len(text)) + text + b"".join(parts))


def _erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[np.float64])(x)


class VisionTransformer:
    """Weights by the short names of NAMES and LAYER_NAMES. A missing key bias is zero; without a gate the
    feed-forward part is a GELU of two layers, with one it is gated by SiLU."""

    def __init__(self, tensors: dict[str, np.ndarray], config: ModelConfig):
        self.config = config
        find = lambda names: next((tensors[n] for n in names if n in tensors), None)
        self.top = {k: find(v) for k, v in NAMES.items()}
        missing = [k for k, v in self.top.items() if v is None and (k != "registers" or config.registers)]
        if missing:
            raise ValueError(f"weights are missing: {missing}")
        self.layers = []
        for i in range(config.layers):
            layer: dict[str, np.ndarray | None] = {}
            for short, names in LAYER_NAMES.items():
                at = [n.format(i=i) for n in names]
                if short.startswith("scale"):
                    layer[short] = find(at)
                else:
                    layer[f"{short}.w"], layer[f"{short}.b"] = find([f"{n}.weight" for n in at]), find([f"{n}.bias" for n in at])
            if layer["qkv.w"] is not None:
                layer["q.w"], layer["k.w"], layer["v.w"] = np.split(layer["qkv.w"], 3)
                if layer["qkv.b"] is not None:
                    layer["q.b"], layer["k.b"], layer["v.b"] = np.split(layer["qkv.b"], 3)
            if missing := [f"{short}.w" for short in ("norm1", "norm2", "q", "k", "v", "out", "up", "down") if layer[f"{short}.w"] is None]:
                raise ValueError(f"weights of layer {i} are missing: {missing}")
            self.layers.append(layer)
        self.turns = self._turns()

    def _turns(self) -> np.ndarray:
        """Unit complex numbers (tokens, head / 2) by which queries and keys turn: none for the class token and the
        registers, by the centres of rows and columns between -1 and 1 for patches."""
        c = self.config
        half = c.hidden // c.heads // 2
        rows, columns = c.height // c.patch, c.width // c.patch
        centre = lambda n: (2 * np.arange(n) + 1) / n - 1
        speed = 2 * np.pi * ROPE_BASE ** (-np.arange(half // 2) * 2 / half)
        y = np.repeat(centre(rows), columns)[:, None] * speed
        x = np.tile(centre(columns), rows)[:, None] * speed
        still = np.zeros((1 + c.registers, half))
        return np.exp(1j * np.concatenate([still, np.concatenate([y, x], axis=1)]))

    @staticmethod
    def _linear(x: np.ndarray, w: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        out = x @ w.T
        return out if b is None else out + b

    @staticmethod
    def _norm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        centred = x - x.mean(axis=-1, keepdims=True)
        return centred / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + EPSILON) * w + b

    def _turned(self, x: np.ndarray) -> np.ndarray:
        half = x.shape[-1] // 2
        z = (x[..., :half] + 1j * x[..., half:]) * self.turns
        return np.concatenate([z.real, z.imag], axis=-1)

    def _attention(self, x: np.ndarray, layer: dict) -> np.ndarray:
        n, tokens, hidden = x.shape
        heads = lambda name: self._linear(x, layer[f"{name}.w"], layer[f"{name}.b"]).reshape(n, tokens, self.config.heads, -1).transpose(0, 2, 1, 3)
        q, k, v = self._turned(heads("q")), self._turned(heads("k")), heads("v")
        scores = q @ k.transpose(0, 1, 3, 2) / math.sqrt(q.shape[-1])
        scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
        mixed = (scores / scores.sum(axis=-1, keepdims=True)) @ v
        return self._linear(mixed.transpose(0, 2, 1, 3).reshape(n, tokens, hidden), layer["out.w"], layer["out.b"])

    def _feed_forward(self, x: np.ndarray, layer: dict) -> np.ndarray:
        up = self._linear(x, layer["up.w"], layer["up.b"])
        if layer["gate.w"] is not None:
            gate = self._linear(x, layer["gate.w"], layer["gate.b"])
            up = up / (1 + np.exp(-up)) * gate
        else:
            up = up * 0.5 * (1 + _erf(up / math.sqrt(2)))
        return self._linear(up, layer["down.w"], layer["down.b"])

    def forward(self, images: np.ndarray) -> np.ndarray:
        """All tokens (n, tokens, hidden) of images (n, 3, height, width): class token, registers, patches."""
        c, n = self.config, len(images)
        rows, columns = c.height // c.patch, c.width // c.patch
        cut = images[:, :, : rows * c.patch, : columns * c.patch].reshape(n, 3, rows, c.patch, columns, c.patch)
        flat = cut.transpose(0, 2, 4, 1, 3, 5).reshape(n, rows * columns, -1).astype(np.float64)
        patches = self._linear(flat, self.top["patch.weight"].reshape(c.hidden, -1), self.top["patch.bias"])
        fixed = [self.top["cls"].reshape(1, 1, c.hidden)]
        if c.registers:
            registers = self.top["registers"]
            fixed.append(np.zeros((1, c.registers, c.hidden)) if registers is None else registers.reshape(1, c.registers, c.hidden))
        x = np.concatenate([*(np.repeat(f, n, axis=0) for f in fixed), patches], axis=1)
        for layer in self.layers:
            part = self._attention(self._norm(x, layer["norm1.w"], layer["norm1.b"]), layer)
            x = x + (part if layer["scale1"] is None else part * layer["scale1"].ravel())
            part = self._feed_forward(self._norm(x, layer["norm2.w"], layer["norm2.b"]), layer)
            x = x + (part if layer["scale2"] is None else part * layer["scale2"].ravel())
        return self._norm(x, self.top["norm.weight"], self.top["norm.bias"])


class NumpyBackend:
    """A backend (see embed.Backend) that runs VisionTransformer on a safetensors file."""

    def __init__(self, config: ModelConfig):
        self.config, self.model, self.path = config, None, None

    def load(self, path: str | None) -> None:
        if not path:
            raise ValueError("a model file is needed")
        self.model, self.path = VisionTransformer(read_safetensors(path), self.config), path

    def extract(self, images: list[bytes]) -> np.ndarray:
        tensors = np.stack([media.preprocess(media.decode(x), self.config) for x in images])
        return self.model.forward(tensors).reshape(len(images), -1).astype(np.float32)

    def info(self) -> ModelInfo:
        return ModelInfo(self.path or "", "numpy", self.config, "F32")
