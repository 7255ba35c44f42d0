"""What follows from the model that wrote a text: script conversion, variants, marks and interchangeable characters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from captionlake.functions import steps, text
from captionlake.sources import config


def _tables(profiles: list[dict[str, Any]], script: steps.LongestMatch | None, variants: dict[str, str] | None) -> None:
    for flag, table in (("convert_script", script), ("variants", variants)):
        if table is None and any(p.get(flag) for p in profiles):
            raise ValueError(f"a profile asks for {flag}, but its table is not given")


def normalise(value: Column, profile: dict[str, Any], script: steps.LongestMatch | None = None, variants: dict[str, str] | None = None) -> Column:
    """A text as its profile asks: first the script by the longest entries, then single characters; null stays null.

    A profile that asks for a table that is not given is a ValueError; the default profile changes nothing.
    """
    _tables([profile], script, variants)
    value = steps.python_step(script)(value) if profile.get("convert_script") else value
    return text.translate_chars(value, variants) if profile.get("variants") else value


def normalise_by(value: Column, model: Column, profiles: dict[str, dict[str, Any]], script: steps.LongestMatch | None = None, variants: dict[str, str] | None = None) -> Column:
    """Each row's text as the profile of its own model asks; the profile is found as config.profile finds it, a null model's is the default."""
    _tables([*profiles.values(), config.PROFILES["default"]], script, variants)
    short = F.element_at(F.split(model, "/"), -1)

    def asks(flag: str) -> Column:
        wanted = [name for name, p in profiles.items() if p.get(flag)]
        return F.coalesce(F.when(model.isin(*profiles), model.isin(*wanted)).otherwise(short.isin(*wanted)), F.lit(False))

    if any(p.get("convert_script") for p in profiles.values()):
        # Other rows reach the conversion as null, so that their texts are not moved to Python.
        value = F.when(asks("convert_script"), steps.python_step(script)(F.when(asks("convert_script"), value))).otherwise(value)
    if any(p.get("variants") for p in profiles.values()):
        value = F.when(asks("variants"), text.translate_chars(value, variants)).otherwise(value)
    return value
