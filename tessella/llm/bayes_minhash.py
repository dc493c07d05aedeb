"""Near-duplicate detection by MinHash with sequential Bayesian verification.

Texts with the same shingle set fall into one class, and classes' representatives are banded.
Candidates from shared buckets are verified in steps: signatures are compared a batch at a time,
and a pair is dropped as soon as the posterior probability that it is similar enough falls under
the miss probability; survivors are confirmed on their full shingle sets.

No bucket's pairs are all emitted. First each member meets its bucket's smallest one. What then
still spans several components is cut into blocks, and pairs of blocks are compared inside tasks,
where only pairs of a common bucket across components count, the likeliest first, and a pair whose
components have been joined meanwhile needs no test; the links found come out as a forest. Members
of a group's largest component never meet each other, so they travel once for each block of the
others. Buckets that overlap, as those of one family of copies do, are worked off as one group,
unless chance has chained buckets into a group far larger than any of them: that decides where a
pair is compared, never whether.

Aggregates are written before rows are joined with them, so that no aggregation shares a stage
with a join and adaptive execution can split the rows of a hot key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, per_row, written

WORDS = 5
PERCENT = 85
HASHES = 192
BATCH = 16
#: The greatest posterior probability of similarity at which a pair is dropped, and of sharing no band at the threshold.
MISS = 1e-6
#: Members of a block, about; and chained buckets form one group up to so many times the largest of them.
BLOCK, CHAIN = 256, 3
KEPT_WORDS = 400_000

_RNG = np.random.default_rng(20240229)
XORS = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
FACTORS = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text with A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """The full set: distinct windows of five words, or the whole sequence if it is shorter."""
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(WORDS)), strict=False))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(n, WORDS)
    out = w[: n - size + 1] + np.uint64(size)
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * MIX + w[k : n - size + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(hashes: np.ndarray) -> np.ndarray:
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 512):
        best = np.minimum(best, ((low[k : k + 512, None] ^ XORS) * FACTORS).min(axis=0))
    return best


def shares_no_band(percent: int, bands: int, rows: int) -> float:
    """The probability that a pair at the threshold meets in no bucket."""
    return (1 - (percent / 100) ** rows) ** bands


@lru_cache(maxsize=4)
def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows: the longest bands that miss a pair at the threshold with at most MISS; 32 of 6 at 85 (2.6e-7), 38 of 5 at 80 (2.8e-7)."""
    return next((HASHES // rows, rows) for rows in range(HASHES, 0, -1) if rows == 1 or shares_no_band(percent, HASHES // rows, rows) <= MISS)


def band_keys(sig: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    bands, rows = bands_for(percent)
    key = np.arange(1, bands + 1, dtype=np.uint64) * MIX
    for col in sig[: bands * rows].reshape(bands, rows).T.astype(np.uint64):
        key = (key ^ (key >> np.uint64(31)) ^ col) * MIX
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set hash (s1, s2) and band keys; empty texts have no set hash."""

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        import xxhash

        hashes = WordHashes()
        for doc_id, text in rows:
            own = shingle_hashes(words_of(text), hashes)
            if not len(own):
                yield doc_id, 0, None, None, None
                continue
            digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
            sig = signature(own)
            yield doc_id, len(own), int(digest[0]), int(digest[1]), band_keys(sig, percent).tolist()

    return per_row(docs, ["doc_id", "text"], "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>", run)


@lru_cache(maxsize=4)
def posterior_limits(percent: int, miss: float) -> list[int]:
    """After each batch, the fewest matches that keep a pair.

    Under a uniform prior, similarity after m of n matches is Beta(m + 1, n - m + 1), and the
    chance that it reaches t is that of at most m successes in n + 1 trials at t.
    """
    t = percent / 100
    keep = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                keep.append(m)
                break
    return keep


def surviving(a: np.ndarray, b: np.ndarray, percent: int = PERCENT, miss: float = MISS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature tables that no batch drops, and their matches."""
    rows = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for step, least in enumerate(posterior_limits(percent, miss)):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (a[rows, part] == b[rows, part]).sum(1)
        stay = matches >= least
        rows, matches = rows[stay], matches[stay]
        if not len(rows):
            break
    return rows, matches


def similar(one: np.ndarray, two: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two full sets, as sorted hashes, share enough."""
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def _table(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, HASHES)


def full_sets(texts: DataFrame) -> DataFrame:
    """rep, n_shingles, sig, hashes (the full set, sorted) of texts (doc_id, text)."""

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        hashes = WordHashes()
        for doc_id, text in rows:
            own = shingle_hashes(words_of(text), hashes)
            yield doc_id, len(own), signature(own).astype("<u2").tobytes(), own.astype("<u8").tobytes()

    return per_row(texts, ["doc_id", "text"], "rep long, n_shingles long, sig binary, hashes binary", run)


def verify(pairs: DataFrame, full: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose signatures survive the sequential test and whose full sets are similar enough."""
    own = full.select("rep", "sig", "hashes")
    both = pairs.join(own.toDF("a", "sig_a", "set_a"), "a").join(own.toDF("b", "sig_b", "set_b"), "b")

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for a, b, sig_a, sig_b, set_a, set_b in rows:
            if len(surviving(_table([sig_a]), _table([sig_b]), percent)[0]) and similar(np.frombuffer(set_a, "<u8"), np.frombuffer(set_b, "<u8"), percent):
                yield a, b

    return per_row(both, ["a", "b", "sig_a", "sig_b", "set_a", "set_b"], "a long, b long", run)


def components(links: DataFrame) -> DataFrame:
    """Every linked node with the smallest node of its component: node, component.

    Alternates large and small stars until every node has one edge, to a node that has none
    onwards; the edges are written after each turn, and neither edges nor nodes reach the driver.
    The least neighbours are written before edges are joined with them, so that adaptive execution
    can split the edges of a hot node; after a large star no node has many edges to smaller ones.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    while True:
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))
        onwards = ends.groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.max(F.col("to").isNull()).alias("is_end")).where("lo <> hi OR lo IS NOT NULL AND is_end")
        if onwards.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "stars",
        )


def _similar_sizes(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _open_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, rep, component of the groups that span several components."""
    of = components(links)
    labelled = written(members.join(of, members.rep == of.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), "labelled")
    spans = [F.count("*").alias("n_members"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("first")]
    spanning = written(labelled.groupBy("key").agg(*spans).where("lo <> hi").drop("lo", "hi"), "open-keys")
    buckets = written(labelled.join(spanning, "key"), "open-buckets")
    chained = written(components(buckets.select(F.col("first").alias("a"), F.col("rep").alias("b"))), "chained")
    grouped = written(buckets.join(chained.select(F.col("node").alias("rep"), F.col("component").alias("chain")), "rep"), "grouped")
    largest = written(grouped.groupBy("chain").agg(F.max("n_members").alias("most")), "largest-buckets")
    counted = written(chained.groupBy(F.col("component").alias("chain")).agg(F.count("*").alias("n_chain")), "chain-sizes")
    sizes = written(largest.join(counted, "chain"), "chains")
    judged = grouped.join(sizes, "chain").withColumn("as_one", F.col("n_chain") <= CHAIN * F.col("most"))
    group = F.when(F.col("as_one"), F.concat(F.lit("c"), "chain")).otherwise(F.concat(F.lit("b"), "key"))
    return written(judged.select(group.alias("key"), "rep", "component").distinct(), "groups")


def across(groups: DataFrame, full: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links across components within the groups (key, rep, component), found block against block inside tasks, as a forest over each pair of blocks.

    Each group's largest component has blocks of its own, which meet the blocks of the other
    components alone; those meet all.
    """
    bands, width = bands_for(percent)
    sizes = written(groups.groupBy("key", "component").agg(F.count("*").alias("n")), "component-sizes")
    of_key = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n_all"))
    of_key = written(of_key.select("key", F.col("most.component").alias("major"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("n_major"), F.ceil((F.col("n_all") - F.col("most.n")) / BLOCK).cast("int").alias("n_minor")), "group-sizes")
    is_major = F.col("component") == F.col("major")
    spread = (
        groups.join(of_key, "key")
        .withColumn("chunk", F.when(is_major, F.col("n_minor") + F.pmod(F.xxhash64("rep"), F.col("n_major"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("n_minor"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_minor") - 1 + F.when(is_major, 0).otherwise(F.col("n_major")))))
        .select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "rep", "component")
    )
    rows = spread.join(full, "rep")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("rep", ignore_index=True)
        rep, comp, size, part = (pdf[c].to_numpy() for c in ("rep", "component", "n_shingles", "chunk"))
        sig, sets = _table(pdf["sig"]), [np.frombuffer(h, "<u8") for h in pdf["hashes"]]
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        right = np.flatnonzero(part == hi)
        found: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(part == lo).tolist():
            js = right[right > i] if lo == hi else right
            js = js[(comp[js] != comp[i]) & (100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i]))]
            if len(js):
                kept, matches = surviving(np.broadcast_to(sig[i], (len(js), HASHES)), sig[js], percent)
                meet = (sig[js[kept], : bands * width] == sig[i, : bands * width]).reshape(-1, bands, width).all(2).any(1)
                kept, matches = kept[meet], matches[meet]
                found += zip((-matches).tolist(), [i] * len(kept), js[kept].tolist(), strict=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        forest = []
        for _, i, j in sorted(found):
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b and similar(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
                forest.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pd.DataFrame(forest, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept.

    Texts whose full sets have a Jaccard similarity of at least ``percent`` per cent are linked.

    ``docs`` needs doc_id and text. Null and empty texts, and texts without words, have no
    shingles, link with nothing and are kept. Rows of one doc_id count as one document; where their
    texts differ, the class of each is its own and the least text stands for the id. A row
    without doc_id belongs to its class and is not kept. Other columns are left out.
    """
    sigs = written(signatures(docs, percent), "signatures")
    sets = sigs.where("n_shingles > 0")
    classes = written(sets.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    same = sets.join(classes, ["s1", "s2"])
    nodes = written(same.where("doc_id = rep").select("rep", "n_shingles", "bands"), "nodes")
    banded = nodes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    shared = written(banded.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rep", "n_shingles")).alias("first")).where("n > 1"), "shared-keys")
    members = written(banded.join(shared, "key").select("key", "rep", "n_shingles", F.col("first.rep").alias("center"), F.col("first.n_shingles").alias("n_center")), "members")
    texts = docs.select("doc_id", "text").join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    full = written(full_sets(texts), "full-sets")

    star = members.where("rep <> center").where(_similar_sizes(F.col("n_shingles"), F.col("n_center"), percent)).select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(verify(star, full, percent), "links")
    groups = _open_groups(members.select("key", "rep"), links)
    links = written(links.unionByName(across(groups, full, percent)).distinct(), "links")
    of = components(links)
    member_of = same.select("doc_id", "n_shingles", "rep").join(of, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    empty = sigs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return member_of.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op9_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
