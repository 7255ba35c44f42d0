"""Layered configuration: defaults, one file, stage presets, explicit values."""

from __future__ import annotations

import configparser
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Option:
    default: Any
    kind: type = str
    choices: tuple = ()


OPTIONS = {
    "output_format": Option("srt", str, ("all", "txt", "vtt", "srt", "tsv", "json", "aud")),
    "vad_onset": Option(0.5, float), "vad_offset": Option(0.363, float), "chunk_size": Option(30, int),
    "align_padding": Option(0.04, float), "align_release": Option(0.64, float), "align_merge_distance": Option(0.08, float),
    "interpolate_method": Option("nearest", str, ("nearest", "linear", "ignore")),
    "max_line_width": Option(18, int), "max_line_count": Option(2, int), "batch_size": Option(15, int), "language": Option(None, str), "retime": Option(None, str),
}


def coerce(key: str, value: str, options: dict[str, Option] = OPTIONS) -> Any:
    """A config file's text as the option's type; 'None' is None. Unknown keys, types and choices are ValueErrors."""
    if key not in options:
        raise ValueError(f"unknown option {key!r}")
    o = options[key]
    if value == "None":
        return None
    if o.kind is bool:
        if value not in ("True", "False"):
            raise ValueError(f"{key}: True or False")
        return value == "True"
    try:
        out = o.kind(value)
    except ValueError as e:
        raise ValueError(f"{key}: {value!r} is no {o.kind.__name__}") from e
    if o.choices and out not in o.choices:
        raise ValueError(f"{key}: {value!r} is not among {', '.join(o.choices)}")
    return out


def read_file(path: str | Path, options: dict[str, Option] = OPTIONS) -> dict[str, Any]:
    parser = configparser.ConfigParser()
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    return {k: coerce(k, v, options) for s in parser.sections() for k, v in parser.items(s)}


def config_path(name: str, folder: str | Path) -> Path:
    """A file inside the folder, by name with or without .cfg; a name that leads outside is refused."""
    root = Path(folder).resolve()
    out = (root / (name if name.endswith(".cfg") else f"{name}.cfg")).resolve()
    if root not in out.parents:
        raise ValueError(f"{name!r} leads out of {root}")
    return out


def write_default(path: str | Path, options: dict[str, Option] = OPTIONS) -> bool:
    """Write the defaults as a file; never over an existing one."""
    path = Path(path)
    if path.exists():
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("[captions]\n" + "".join(f"{k} = {o.default}\n" for k, o in options.items()), encoding="utf-8")
    return True


def resolve(explicit: dict[str, Any], file: dict[str, Any] | None = None, presets: list[dict[str, Any]] | None = None, options: dict[str, Option] = OPTIONS) -> dict[str, Any]:
    """defaults < file < presets in order < explicit."""
    out = {k: o.default for k, o in options.items()} | (file or {})
    for p in presets or []:
        out |= p
    out |= explicit
    if unknown := sorted(out.keys() - options.keys()):
        raise ValueError(f"unknown options {unknown}")
    return out


def layered(defaults: DataFrame, *layers: DataFrame) -> DataFrame:
    """Tables of (key, value): each later layer's value, where it has the key, counts; keys of the first table only."""
    out = defaults.select("key", F.col("value").alias("v0"))
    for n, layer in enumerate(layers, 1):
        out = out.join(layer.select("key", F.col("value").alias(f"v{n}")), "key", "left")
    return out.select("key", F.coalesce(*[F.col(f"v{n}") for n in range(len(layers), -1, -1)]).alias("value"))


#: Characters that may stand for one another, with a bias on their log-probability.
PARTICLES: dict[str, list[tuple[str, float]]] = {
    "啊": [("吖", 0.0), ("呀", 0.0)], "吖": [("吖", 0.0), ("呀", 0.0)], "呀": [("吖", 0.0), ("呀", 0.0)],
    "咯": [("喇", 0.0), ("啦", 0.0), ("囉", 0.0)], "喇": [("喇", 0.0), ("啦", 0.0)], "啦": [("喇", 0.0), ("啦", 0.0)],
    "咋": [("咋", 0.0), ("啫", 0.0)], "啫": [("咋", 0.0), ("啫", 0.0)], "咁": [("咁", 0.0), ("噉", 0.8)],
}
#: Model profiles by short name: how a model's text is normalised (functions/profiles.py) and which characters its alignment
#: may exchange. A profile may also have split_chars.
PROFILES: dict[str, dict[str, Any]] = {
    "default": {"convert_script": False, "variants": False, "spot_checks": {}},
    "Qwen3-ASR": {"convert_script": True, "variants": True, "spot_checks": PARTICLES},
    "Qwen3-ASR-0.6B": {"convert_script": True, "variants": True, "spot_checks": PARTICLES},
}


def profile(name: str, profiles: dict[str, dict[str, Any]] | None = None) -> dict[str, Any]:
    """A known profile by its name or the last part of a path; else the default one."""
    table = PROFILES if profiles is None else profiles
    return table.get(name) or table.get(name.rpartition("/")[2]) or PROFILES["default"]
