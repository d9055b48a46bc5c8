"""Typed settings with defaults and descriptions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import SparkSession

PREFIX = "noticeloom."


def setting(default, text: str):
    return field(default=default, metadata={"description": text})


@dataclass(frozen=True)
class Config:
    most_edits: int = setting(2, "most edits between a text and a dictionary's term")
    edit_share: float = setting(0.2, "edits must be fewer than this share of the text's length")
    distance: str = setting("ocr", "how texts and terms are compared: ocr (by substitution costs) or plain")
    files_per_trigger: int = setting(5, "files that a stream takes at once")
    overlap_share: float = setting(0.8, "common area from which two boxes are readings of one text")
    sure: int = setting(80, "least confidence of times")
    compat: bool = setting(False, "keep known deviations of older results")
    dry_run: bool = setting(False, "write nothing")

    @classmethod
    def load(cls, spark: SparkSession, stored: dict | None = None) -> Config:
        """Defaults, then stored values, then settings of the session named noticeloom.<field>."""
        values = dict(stored or {})
        for f in fields(cls):
            given = spark.conf.get(PREFIX + f.name, None)
            if given is not None:
                values[f.name] = given
        kinds = {f.name: type(f.default) for f in fields(cls)}
        unknown = set(values) - set(kinds)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        cast = lambda k, v: (str(v).lower() in ("true", "1") if k is bool else k(v))
        return cls(**{n: cast(kinds[n], v) for n, v in values.items()})

    def dump(self) -> str:
        """Values with descriptions, as JSON."""
        about = {f.name: f.metadata["description"] for f in fields(self)}
        return json.dumps({k: {"value": v, "description": about[k]} for k, v in asdict(self).items()}, indent=1)
