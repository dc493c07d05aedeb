"""Quality rules by compression bands.

A text that repeats itself compresses far better than prose of its length, and noise compresses
far worse. Both ends are rejected, with limits by length, since a short text never compresses
much. The whole document is judged, and every fixed chunk of it from the first to its end (the
last chunk ends where the text ends), so a repetitive or random stretch in a longer document
shows although the whole looks normal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, per_row, utf8

LEVEL = 3
CHUNK_BYTES = 4096
#: At most this share of the chunks may lie outside the band. None: on sf0.1, chunks of all 560 long texts labelled
#: good have ratios from 2.07 to 2.26, those of the 23 labelled bad for repetition 34 and more.
MAX_BAD_CHUNKS = 0.0
#: From a length in bytes on: the least and the greatest ratio (bytes over compressed bytes).
BANDS = (
    (0, 0.0, math.inf),
    (64, 0.80, 1.45),
    (128, 0.95, 2.20),
    (256, 1.15, 2.40),
    (512, 1.25, 2.60),
    (1024, 1.35, 2.80),
    (2048, 1.45, 3.00),
    (4096, 1.50, 3.20),
    (8192, 1.55, 3.40),
    (32768, 1.60, 3.60),
)
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, verdict string"
)


def limits(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    """The band of the greatest starting length that is not over ``n_bytes``."""
    return next((lo, hi) for start, lo, hi in reversed(bands) if n_bytes >= start)


def repeat_words(codes: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more; exact, by joint codes."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    joint, size = codes[:n], distinct
    for k in range(1, window):
        if size * distinct >= 1 << 62:  # number the prefixes anew before the code overflows
            _, joint = np.unique(joint, return_inverse=True)
            size = int(joint.max()) + 1
        joint, size = joint * distinct + codes[k : n + k], size * distinct
    order = np.argsort(joint, kind="stable")
    same = joint[order[1:]] == joint[order[:-1]]
    if not same.any():
        return 0
    often = np.zeros(n, bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    starts = np.flatnonzero(often)
    marks = np.zeros(len(codes) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the white space of the contract
    if not words:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, SPACES))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(codes, len(seen)) if len(seen) < len(words) else 0,
    )


def band_verdict(raw: bytes, compress, bands=BANDS, chunk: int = CHUNK_BYTES, max_bad: float = MAX_BAD_CHUNKS) -> tuple[str, float, int, int]:
    """'kept', 'repetitive', 'incompressible' or 'chunks'; the ratio; chunks, and chunks outside their band."""
    n = len(raw)
    if not n:
        return "kept", 0.0, 0, 0
    ratio = n / len(compress(raw))
    lo, hi = limits(n, bands)
    whole = "repetitive" if ratio > hi else "incompressible" if ratio < lo else "kept"
    ends = [*range(chunk, n + 1, chunk), *([n] if n > chunk and n % chunk else [])]
    n_chunks, bad = len(ends), 0
    lo, hi = limits(chunk, bands)
    for end in ends:
        r = chunk / len(compress(raw[end - chunk : end]))
        bad += not lo <= r <= hi
    if whole == "kept" and n_chunks and bad > max_bad * n_chunks:
        whole = "chunks"
    return whole, ratio, n_chunks, bad


def judge(docs: DataFrame, level: int = LEVEL, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, max_bad_chunks: float = MAX_BAD_CHUNKS) -> DataFrame:
    """The base counts and the band's verdict for every document; ``docs`` needs doc_id and text.

    Null and empty texts have no words, so they fail the base rule. A null doc_id stays null;
    repeated rows are judged each. Other columns are left out, whatever their names.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        for doc_id, text in rows:
            n_words, chars, symbols, dup, rep = base_counts(text)
            failed = n_words < MIN_WORDS or 100 * rep > MAX_REPEAT_PERCENT * n_words
            verdict, ratio, n_chunks, bad = band_verdict(utf8(text), compress, bands, chunk_bytes, max_bad_chunks)
            yield doc_id, n_words, chars, symbols, dup, rep, failed, not failed and verdict == "kept", ratio, n_chunks, bad, verdict

    return per_row(docs, ["doc_id", "text"], SCHEMA, run)


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop("ratio")


