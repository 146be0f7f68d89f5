"""Settings with environment overrides."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, fields, replace

from . import constants as K

PREFIX = "TESSERINE_"


@dataclass(frozen=True)
class Config:
    min_tokens: int = K.MIN_TOKENS
    corpus_min_tokens: int = K.CORPUS_MIN_TOKENS
    label_floor: float = K.LABEL_FLOOR
    archive_days: int = K.ARCHIVE_DAYS
    temperature: float = 1.0
    extractor: str = "visible"
    batch_size: int = 10

    def updated(self, **values: object) -> Config:
        return replace(self, **values)

    @classmethod
    def from_env(cls) -> Config:
        """Defaults with PREFIX + name overrides; a bad value keeps the default."""
        got = {}
        for f in fields(cls):
            raw = os.environ.get(PREFIX + f.name.upper())
            if raw is None:
                continue
            try:
                got[f.name] = type(f.default)(raw)
            except ValueError:
                logging.getLogger("tesserine").warning("%s: %r is no %s", f.name, raw, type(f.default).__name__)
        return cls(**got)
