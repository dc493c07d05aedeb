"""Errors of the engine."""


class TessellaError(Exception):
    """Base of all errors raised here."""


class ConfigError(TessellaError):
    """A setting is missing or contradicts another."""


class FingerprintMismatch(TessellaError):
    """An index was built with another embedding space or text assembly."""


class DimensionMismatch(TessellaError):
    """Vectors of different lengths were compared."""


class IndexMissing(TessellaError):
    """There is no index yet: run a sync first."""


class EvalError(TessellaError):
    """An evaluation can't run, as it has no queries."""


class SourceError(TessellaError):
    """A remote source failed, after retries."""


class StoreConflict(TessellaError):
    """Another writer has changed the store meanwhile."""
