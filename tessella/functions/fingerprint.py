"""Fingerprints of embedding spaces and text assembly, and their guard."""

from __future__ import annotations

import warnings

from ..errors import ConfigError, FingerprintMismatch
from .text import BODY_MAX, COMMENT_QUOTA, PER_COMMENT_MAX, TITLE_REPEATS

ASSEMBLY = ("tr=", "body=", "cq=", "cc=")


def full(base: str, title_repeats: int = TITLE_REPEATS, body_max: int = BODY_MAX) -> str:
    """An embedder's fingerprint with the parameters of the text that it embeds."""
    return f"{base}|tr={title_repeats}|body={body_max}|cq={COMMENT_QUOTA}|cc={PER_COMMENT_MAX}"


def segment(fp: str, key: str) -> str:
    return next((s[len(key) :] for s in fp.split("|") if s.startswith(key)), "")


def space(fp: str) -> tuple[str, str]:
    """Model and length: vectors of equal spaces can be compared."""
    return fp.split("|")[0], segment(fp, "len=")


def ensure(stored: str | None, current: str) -> str:
    """The fingerprint to store, or an error where the index can't be used with the current settings.

    None stored: the current one. Another space: FingerprintMismatch. Stored without assembly
    parameters: the current one, as texts are alike. Another assembly: ConfigError. Another
    implementation of the same space: a warning, and the stored one stays.
    """
    if stored is None:
        return current
    if space(stored) != space(current):
        raise FingerprintMismatch(f"the index has {stored}, the settings give {current}")
    if not segment(stored, "tr="):
        return current
    if any(segment(stored, k) != segment(current, k) for k in ASSEMBLY):
        raise ConfigError("the text assembly has changed: rebuild the index")
    if stored != current:
        warnings.warn(f"another implementation of the same embedding space: {stored} -> {current}", stacklevel=2)
    return stored
