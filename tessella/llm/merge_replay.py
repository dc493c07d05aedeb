"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

A merge never crosses a pre-token, so a block of the corpus is encoded through its distinct
pre-tokens: an inverted index maps each applicable merge to the positions where its pair stands,
merges are applied in rank order, at all their positions at once, and only the neighbours of a
merged pair enter the index anew. Blocks are independent, so nothing is shuffled or broadcast
and a lost task is replayed alone.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, per_row
from .pretokens import default_vocabulary, ranks, splitter

#: Characters of text in a block, and pre-tokens kept from block to block.
BLOCK_CHARS = 2_000_000
KEPT_WORDS = 400_000


def encode_word(word: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """One pre-token by the definition: the lowest rank first, the leftmost first."""
    parts = [word[k : k + 1] for k in range(len(word))]
    while len(parts) > 1:
        best, at = min((rank_of.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [rank_of[x] for x in parts]


def replay(words: list[bytes], rank_of: dict[bytes, int], token_of: dict[int, bytes]) -> list[bytes]:
    """Ids of each word, as little-endian 32-bit bytes, by one pass over the merges in rank order.

    ``index`` maps a merge (the id that a pair becomes) to positions of the pair's left token.
    Positions of all words lie in one line; ``left`` and ``right`` link the tokens of a word.
    A pair that arises with a lower rank than the merge at hand breaks the order for its word,
    which is then encoded by the definition.
    """
    token: list[int] = []
    right: list[int] = []
    left: list[int] = []
    starts: list[int] = []
    single = [rank_of[bytes([b])] for b in range(256)]
    index: dict[int, list[int]] = {}
    pairs: dict[tuple[int, int], int | None] = {}
    irregular: set[int] = set()

    def merge_of(a: int, b: int) -> int | None:
        try:
            return pairs[a, b]
        except KeyError:
            m = pairs[a, b] = rank_of.get(token_of[a] + token_of[b])
            return m

    for w in words:
        at = len(token)
        starts.append(at)
        ids = [single[b] for b in w]
        token += ids
        n = len(ids)
        left += range(at - 1, at + n - 1)
        right += range(at + 1, at + n + 1)
        if n:
            left[at], right[at + n - 1] = -1, -1
        for k in range(n - 1):
            m = merge_of(ids[k], ids[k + 1])
            if m is not None:
                index.setdefault(m, []).append(at + k)
    starts.append(len(token))

    heap = list(index)
    heapq.heapify(heap)
    while heap:
        merge = heapq.heappop(heap)
        for p in sorted(index.pop(merge)):
            q = right[p]
            if token[p] < 0 or q < 0 or pairs[token[p], token[q]] != merge:
                continue
            token[p], token[q] = merge, -1
            after = right[p] = right[q]
            before = left[p]
            if after >= 0:
                left[after] = p
                m = merge_of(merge, token[after])
                if m is not None:
                    if m < merge:
                        irregular.add(p)
                    elif m in index:
                        index[m].append(p)
                    else:
                        index[m] = [p]
                        heapq.heappush(heap, m)
            if before >= 0:
                m = merge_of(token[before], merge)
                if m is not None:
                    if m < merge:
                        irregular.add(p)
                    elif m in index:
                        index[m].append(before)
                    else:
                        index[m] = [before]
                        heapq.heappush(heap, m)

    out = [array("I", [t for t in token[a:b] if t >= 0]).tobytes() for a, b in zip(starts, starts[1:], strict=False)]
    if irregular:
        import bisect

        for k in {bisect.bisect_right(starts, p) - 1 for p in irregular}:
            out[k] = array("I", encode_word(words[k], rank_of)).tobytes()
    return out


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Ids of every whole text: columns doc_id, ids (binary, little-endian unsigned 32-bit).

    Null and empty texts give no ids. Ids, keys and repeated rows pass as they are, and other
    columns are left out. A pre-token that is itself a token is that token.
    """
    own_path, own_pattern = default_vocabulary()
    path, pattern = path or own_path, pattern or own_pattern

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        rank_of, split = ranks(path), splitter(pattern).findall
        token_of = {r: t for t, r in rank_of.items()}
        kept: dict[str, bytes] = {}

        def flush(block: list[tuple]) -> Iterator[tuple]:
            cut = [split(text or "") for _, text in block]
            new = [w for w in {w for words in cut for w in words} if w not in kept]
            if len(kept) + len(new) > KEPT_WORDS:
                new = list({w for words in cut for w in words})
                kept.clear()
            raw = [w.encode() for w in new]
            long = [k for k, w in enumerate(raw) if w not in rank_of]
            kept.update((w, array("I", [rank_of[r]]).tobytes()) for w, r in zip(new, raw, strict=True) if r in rank_of)
            kept.update(zip([new[k] for k in long], replay([raw[k] for k in long], rank_of, token_of), strict=True))
            for (doc_id, _), words in zip(block, cut, strict=True):
                yield doc_id, b"".join(map(kept.__getitem__, words))

        block: list[tuple] = []
        size = 0
        for row in rows:
            block.append(row)
            size += len(row[1] or "") + 16
            if size >= block_chars:
                yield from flush(block)
                block, size = [], 0
        yield from flush(block)

    return per_row(docs, ["doc_id", "text"], "doc_id long, ids binary", run)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds the bytes that ``ids`` stand for: columns doc_id, ids, decoded."""
    path = path or default_vocabulary()[0]

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        token_of = {r: t for t, r in ranks(path).items()}
        for doc_id, ids in rows:
            yield doc_id, ids, b"".join(map(token_of.__getitem__, array("I", ids or b"")))

    return per_row(encoded, ["doc_id", "ids"], "doc_id long, ids binary, decoded binary", run)


def op8_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(documents(spark, sf_dir))).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
