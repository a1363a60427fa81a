"""Files of a trained adapter, read without loading it."""

from __future__ import annotations

import json
import struct
from pathlib import Path

from newsloom.functions.anchors import PromptSpec
from newsloom.operators.windows import Geometry

CONFIG, SETUP, WEIGHTS = "segmentation_config.json", "adapter_config.json", "adapter_model.safetensors"
#: Matrices that must both have learnt the break token's row.
ROWS = ("embed_tokens", "lm_head")
_TRAINED = {"window_tokens", "stride_tokens", "edge_guard_lo", "max_seq_len"}


def resolve(adapter: str, revision: str | None = None) -> Path:
    """The local folder of an adapter.  Nothing is fetched: a name that is no folder is an error."""
    path = Path(adapter)
    if path.is_dir():
        return path
    raise FileNotFoundError(f"{adapter} is no local folder" + (f" (revision {revision})" if revision else "") + ", and adapters aren't fetched here")


def geometry(folder: str | Path, **overrides: float) -> Geometry:
    """The geometry that an adapter was trained with; only what inference may choose can be overridden."""
    if fixed := _TRAINED & set(overrides):
        raise ValueError(f"{sorted(fixed)} are properties of the training and can't be overridden")
    path = Path(folder) / CONFIG
    if not path.exists():
        raise FileNotFoundError(f"{folder} has no {CONFIG}; window geometry isn't guessed")
    saved = json.loads(path.read_text(encoding="utf-8"))
    known = {k: saved[k] for k in ("window_tokens", "stride_tokens", "edge_guard_lo")}
    return Geometry(**known, max_seq_len=saved.get("max_seq_len", 4096), **overrides)


def prompt(folder: str | Path, **overrides: object) -> PromptSpec:
    """The anchor widths that an adapter was trained with; 12 and 8 where it doesn't say."""
    path = Path(folder) / CONFIG
    saved = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    widths = {k: saved.get(k, default) for k, default in (("anchor_pre_words", 12), ("anchor_post_words", 8))}
    return PromptSpec(**(widths | overrides))


def tensor_names(path: str | Path) -> list[str]:
    """Names in a safetensors file: its header is a little-endian length and that much JSON."""
    with open(path, "rb") as file:
        (size,) = struct.unpack("<Q", file.read(8))
        return [name for name in json.loads(file.read(size)) if name != "__metadata__"]


def verify(folder: str | Path) -> list[str]:
    """What is wrong with an adapter that would give wrong output rather than an error."""
    folder = Path(folder)
    if not (folder / SETUP).exists():
        return [f"missing {SETUP}"]
    setup, found = json.loads((folder / SETUP).read_text(encoding="utf-8")), []
    if not (folder / CONFIG).exists():
        found.append(f"missing {CONFIG}: window geometry is unknown")
    base = str(setup.get("base_model_name_or_path", ""))
    if base.startswith("/"):
        found.append(f"base_model_name_or_path is an absolute path ({'machine-local' if Path(base).is_dir() else 'not here'}): {base}")
    learnt = setup.get("trainable_token_indices") or {}
    found += [f"trainable_token_indices lacks {row}" for row in ROWS if row not in learnt]
    if not (folder / WEIGHTS).exists():
        return [*found, f"missing {WEIGHTS}"]
    names = tensor_names(folder / WEIGHTS)
    return found + [f"weights have no trained token rows of {row}" for row in ROWS if not any(f"{row}.token_adapter.trainable_tokens_delta" in n for n in names)]
