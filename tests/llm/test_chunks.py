"""Junk stretches anywhere in a text from one chunk on."""

import base64
import random

import zstandard

from tessella.llm import compression_bands

CHUNK = compression_bands.CHUNK_BYTES


def _verdict(raw):
    return compression_bands.band_verdict(raw, zstandard.ZstdCompressor(level=compression_bands.LEVEL).compress)


def _prose(rng, n):
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(900)]
    return " ".join(rng.choices(words, k=n)).encode()[:n]


def test_junk_in_a_tail_or_a_short_text_is_found():
    rng = random.Random(41)
    noise = base64.b64encode(rng.randbytes(CHUNK))[: CHUNK - 1]
    for n in (CHUNK, 2 * CHUNK, 6 * CHUNK):
        prose = _prose(rng, n)
        for junk in (noise, (b"buy now " * CHUNK)[: CHUNK - 1]):
            verdict, _, n_chunks, bad = _verdict(prose + junk)
            assert verdict != "kept" and n_chunks == n // CHUNK + 1 and bad >= 1, n
        assert _verdict(prose)[0] == "kept"


def test_chunks_cover_the_text():
    rng = random.Random(42)
    for n, want in ((CHUNK - 1, 0), (CHUNK, 1), (CHUNK + 1, 2), (2 * CHUNK - 1, 2), (2 * CHUNK, 2), (2 * CHUNK + 1, 3)):
        assert _verdict(_prose(rng, n))[2:] == (want, 0)


def test_labelled_clean_texts_stay(spark, sf):
    sf = sf.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    clean = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id")
    assert compression_bands.judge(clean).where("n_bad_chunks > 0").count() == 0
