"""Whole results against plain versions: toxicity scores, quality scores, compression verdicts, media."""

import bisect
import hashlib
import math
import random
import time

import helpers
import numpy as np
import pytest
import zstandard

from tessella.llm import compression_bands, flac, gam_quality, toxicity
from tessella.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")


def distance_row(a, b):
    """Edits (insert, delete, substitute, swap) from ``b`` to every prefix of ``a``."""
    before2, before = None, list(range(len(b) + 1))
    ends = [before[-1]]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before2[j - 2] + 1)
            row.append(best)
        before2, before = before, row
        ends.append(row[-1])
    return ends


def plain_match(token, terms):
    hits = []
    for k, (text, stem) in enumerate(terms):
        budget = toxicity.edits_for(len(text))
        if not stem and abs(len(token) - len(text)) > budget:
            continue
        ends = distance_row(token, text)
        e = min(ends[1:]) if stem else ends[-1]
        if e <= budget:
            hits.append((e, k))
    return min(hits, default=None)


def plain_score(text, terms, weights, fuzzy, cache):
    low = (text or "").lower()
    tokens = [(m.group(), m.start(), m.end()) for m in toxicity.TOKEN.finditer(low)]
    score = 0.0
    for i, (token, start, end) in enumerate(tokens):
        if token not in cache:
            plain = token if token.isalpha() else token.translate(toxicity.LEET)
            cache[token] = (plain, plain_match(plain, terms) if plain.isalpha() else None)
        plain, hit = cache[token]
        if hit is None:
            continue
        kind = toxicity.kind_of(hit[0], plain, *terms[hit[1]])
        p = weights[hit[1]] if kind == "exact" else fuzzy.get((hit[1], kind), fuzzy[-1, ""])
        near = [t for t, _, _ in tokens[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1]]
        score = max(score, p * helpers.plain_factor(low, start, end, near))
    return score


def test_op2_equals_a_plain_version(spark, sf, docs, labels):
    terms, fuzzy = toxicity.fit(docs, labels)
    names = sorted(terms)
    weights, cache = [terms[t] for t in names], {}
    assert names
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op2_toxicity"](spark, sf.replace("0.001", "0.01")).collect()
    assert len(got) == len(texts)
    rng, some = random.Random(81), {r.doc_id for r in got if r.n_hits}
    some |= set(rng.sample(sorted(texts), 60))
    for r in got:
        if r.doc_id in some:
            assert r.score == pytest.approx(plain_score(texts[r.doc_id], names, weights, fuzzy, cache)), r.doc_id
            assert r.predicted == (r.score >= 0.7)
    assert all(r.score == 0 for r in got if not r.n_hits)


def test_quotations_of_any_length():
    m = toxicity.Matcher(toxicity.Lexicon({("moron", False): 0.9}))
    s = lambda t: toxicity.score_text(t, m, {(-1, ""): 0.0})[0]
    for n in (1, 79, 81, 500):
        filler = "x" * n
        for text in (f'he "you moron {filler} there" went', f"„du moron {filler}“ ging", f"«toi moron {filler}» va", f"“you moron {filler}” go"):
            assert s(text) == pytest.approx(0.27), (n, text)
        assert s(f'"gone" moron {filler}') == s(f'"open moron {filler}\n" next line') == s(f"„zu“ moron {filler} “x”") == pytest.approx(0.9)
    rng = random.Random(82)
    for _ in range(400):
        text = "".join(rng.choices(["moron", " ", '"', "„", "“", "”", "«", "»", "\n", "word ", "'", " said "], k=rng.randint(1, 25)))
        tokens = list(toxicity.TOKEN.finditer(text))
        marks = toxicity.Quotations(text)
        for t in tokens:
            assert toxicity.context_factor(marks, t.start(), t.end(), []) == helpers.plain_factor(text, t.start(), t.end(), []), (text, t)


def test_many_hits_take_time_in_proportion():
    m = toxicity.Matcher(toxicity.Lexicon({("moron", False): 0.9}))
    took = []
    for n in (4000, 32000):
        began = time.perf_counter()
        assert toxicity.score_text("moron " * n, m, {(-1, ""): 0.0})[1] == n
        took.append(time.perf_counter() - began)
    assert took[1] < 25 * took[0]


def test_one_label_of_several_holds(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(0, "a"), (2, "b")], "doc_id long, text string")
    got = {r.text: r.label for r in toxicity.training_sample(docs, labels, "toxic", 10).collect()}
    assert got == {t: v for i, t, v in ((0, "a", 1), (2, "b", 0)) if not toxicity.held_out(i)}


def test_op10_equals_a_plain_version(spark, sf, docs, labels):
    model = gam_quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(model.pairs) > 0
    for r in QUERIES["op10_gam_quality"](spark, sf.replace("0.001", "0.01")).collect():
        x = gam_quality.features(texts[r.doc_id])
        total = model.intercept + sum(t[bisect.bisect_right(e.tolist(), v)] for v, e, t in zip(x, model.edges, model.tables, strict=True))
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[bisect.bisect_right(model.coarse[a].tolist(), x[a]), bisect.bisect_right(model.coarse[b].tolist(), x[b])]
        want = 1 / (1 + math.exp(-min(30, max(-30, total))))
        assert r.score == pytest.approx(want, abs=1e-12) and r.predicted == (r.score >= 0.5)


def test_op6_verdicts_equal_a_plain_version(spark, docs):
    def ratio(b):
        return len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))

    def fits(b):
        lo, hi = [(lo, hi) for n, lo, hi in compression_bands.BANDS if len(b) >= n][-1]
        return lo <= ratio(b) <= hi

    texts = {r.doc_id: r.text for r in docs.collect()}
    size = compression_bands.CHUNK_BYTES
    for r in compression_bands.judge(docs).collect():
        raw = texts[r.doc_id].encode()
        chunks = [raw[k : k + size] for k in range(0, len(raw) - size + 1, size)]
        if len(raw) > size and len(raw) % size:
            chunks.append(raw[-size:])
        good = not raw or fits(raw) and all(map(fits, chunks))
        assert r.kept == (good and not r.base_failed), r.doc_id


def plain_features(payload):
    x = [b - 128 for b in payload]
    return f"peak={max(map(abs, x))} energy={sum(v * v for v in x)} crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))} steps={sum(abs(b - a) for a, b in zip(x, x[1:], strict=False))}"


def test_op5_media_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    media = {r.doc_id: r.media for r in flac.encode(docs).collect()}
    for r in QUERIES["op5_flac_media"](spark, sf).collect():
        raw = media[r.doc_id]
        assert (r.media_bytes, r.media_sha256, r.error) == (len(raw), hashlib.sha256(raw).hexdigest(), None)
    for r in QUERIES["op5_flac_media"](spark, sf).limit(30).collect():
        text = docs.where(docs.doc_id == r.doc_id).first().text
        assert r.feature == plain_features(flac.payload_of(text)[1]) and r.n_blocks == -(-r.payload_bytes // flac.BLOCK)


def test_damaged_and_missing_media_have_rows(spark):
    good = flac.encode_streams([flac.payload_of("some words " * 200)[1]])[0]
    bad, cut = bytearray(good), good[: len(good) // 2]
    bad[-40] ^= 1
    df = spark.createDataFrame([(1, 2200, good), (2, 2200, bytes(bad)), (3, None, None), (4, 1, b""), (5, 1, cut), (6, 2200, good)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in flac.digests(df).collect()}
    assert got[1].error is None and got[1].payload_sha256 == got[6].payload_sha256 is not None
    assert all(got[i].error and got[i].payload_sha256 is None for i in (2, 3, 4, 5))
    assert got[3].error == "no media" and got[3].media_sha256 is None and got[2].media_sha256
    blocks = flac.decode_blocks(df).collect()
    assert {r.doc_id for r in blocks if r.error} == {2, 3, 4, 5} and sum(r.doc_id == 1 for r in blocks) == 5
    assert flac.seek(flac.decode_blocks(df), 0, 1).count() == 2


def test_long_streams_are_coded_in_parts(monkeypatch):
    rng = np.random.default_rng(83)
    pay = [flac.payload_of(helpers.prose(random.Random(84), 4000))[1], rng.bytes(64 * 200), bytes(64)]
    whole = flac.encode_streams(pay)
    monkeypatch.setattr(flac, "FRAMES", 3)
    assert flac.encode_streams(pay) == whole
    for p, (_, pcm, starts) in zip(pay, flac.decode_streams(whole), strict=True):
        assert (pcm[0].astype(np.int8).view(np.uint8) ^ 0x80).tobytes() == p and starts == list(range(0, len(p), flac.BLOCK))
