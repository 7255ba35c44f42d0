"""captionlake: time-aligned caption and transcript analytics on Spark DataFrames."""

from __future__ import annotations

import importlib

_EXPORTS = {
    "align": "captionlake.operators.align", "assign_labels": "captionlake.operators.intervals:dominant_label", "word_labels": "captionlake.operators.intervals", "load_audio": "captionlake.sources.media",
    "read_subtitles": "captionlake.sources.subtitles", "write_subtitles": "captionlake.sources.subtitles", "transcribe": "captionlake.plans.pipeline", "captions": "captionlake.plans.pipeline",
}
__all__ = list(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    module, _, attribute = _EXPORTS[name].partition(":")
    return getattr(importlib.import_module(module), attribute or name)
