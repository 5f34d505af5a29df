"""Models that tasks call: their configuration, their files, and their life in a Python worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

DEVICES, PRECISIONS = ("cpu", "cuda"), ("fp32", "fp16")


@dataclass(frozen=True)
class ModelConfig:
    """Checked when it is made: half precision needs a GPU, a batch has 1 to 64 windows."""

    device: str = "cpu"
    precision: str = "fp32"
    batch: int = 16

    def __post_init__(self) -> None:
        if self.device not in DEVICES or self.precision not in PRECISIONS:
            raise ValueError("unknown device or precision")
        if self.precision == "fp16" and self.device != "cuda":
            raise ValueError("half precision needs a GPU")
        if type(self.batch) is not int or not 1 <= self.batch <= 64:
            raise ValueError("a batch has 1 to 64 windows")


def checked_file(path: str, sha256: str) -> str:
    """The path, if the file has the hash; a model is never read from any other."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    if h.hexdigest() != sha256:
        raise ValueError("the file is not the one of this hash")
    return path


_LOADED: dict[str, object] = {}


def call(name: str, load: Callable[[], Callable], batch):
    """Calls the model that this worker keeps under the name, loaded at the first call. One that fails is dropped, and the
    next call loads it again."""
    if name not in _LOADED:
        _LOADED[name] = load()
    try:
        return _LOADED[name](batch)
    except Exception:
        _LOADED.pop(name, None)
        raise
