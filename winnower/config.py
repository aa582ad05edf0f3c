"""Parameters and errors of the near-duplicate engine."""

from __future__ import annotations

from dataclasses import dataclass


class DedupError(Exception):
    """Base of the engine's errors."""


class IoError(DedupError):
    """Input that can't be read or ends too early."""


class InvalidFormat(DedupError):
    """Data that isn't laid out as it should be."""


class JsonError(DedupError):
    """A line that isn't JSON."""


class MissingField(DedupError):
    """A document without its text as a string."""

    def __init__(self, field: str):
        super().__init__(f"missing or non-string field: {field}")
        self.field = field


class ConfigError(DedupError):
    """Parameters that are missing or don't go together."""


@dataclass(frozen=True)
class MinHashConfig:
    """``num_buckets`` bands of ``band_size`` hashes each, over character n-grams of ``ngram_size``."""

    ngram_size: int = 5
    num_buckets: int = 40
    band_size: int = 20

    @property
    def total_hashes(self) -> int:
        return self.num_buckets * self.band_size


UNIQUE, DUPLICATE = " ", "D"
INDEX_SPLITS = 256
