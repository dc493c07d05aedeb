"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens, whose nodes hold characters and tokens of
their subtree. An edit re-encodes only the pre-tokens that it touches and those whose match
could have looked at it, up to the first old boundary that the new cut meets again; then the sums
on the paths above those leaves are updated. Later counts, and counts of any character range's
leaves, need no further encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, per_row
from .pretokens import default_vocabulary, encoding, splitter

#: A match looks at this many characters beyond its end at most: one after a run, two within a contraction.
LOOKAHEAD = 2
#: Pre-tokens beyond an edit that are cut anew at first; doubled until the cuts meet.
STEP = 8
KEPT_WORDS = 400_000


class TokenCounts(dict):
    """Tokens of each pre-token; learns missing ones, within a bound."""

    def __init__(self, path: str, pattern: str, most: int = KEPT_WORDS):
        super().__init__()
        self.encode, self.most = encoding(path, pattern).encode_ordinary, most

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


class TokenTree:
    """The pre-tokens of one text under a segment tree of character and token sums."""

    def __init__(self, text: str, split, counts: TokenCounts):
        self.split, self.counts = split, counts
        self.slots: list[str] = split.findall(text) or [""]
        self.reencoded = 0
        n = len(self.slots)
        level = np.zeros((2, n), np.int64)
        level[0] = np.fromiter(map(len, self.slots), np.int64, n)
        if text:
            level[1] = np.fromiter(map(counts.__getitem__, self.slots), np.int64, n)
        self.levels = [level]
        while level.shape[1] > 1:
            if level.shape[1] % 2:
                level = np.concatenate([level, np.zeros((2, 1), np.int64)], axis=1)
                self.levels[-1] = level
            level = level[:, 0::2] + level[:, 1::2]
            self.levels.append(level)

    @property
    def n_chars(self) -> int:
        return int(self.levels[-1][0, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.levels[-1][1, 0])

    def text(self) -> str:
        return "".join(self.slots)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where that leaf begins; beyond the end, the last leaf with text."""
        at = min(at, self.n_chars - 1)
        node, begin = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            first = int(level[0, node])
            if at >= begin + first:
                begin += first
                node += 1
        return node, begin

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.slots[leaf] = text
        new = (len(text), tokens)
        self.levels[0][0, leaf], self.levels[0][1, leaf] = new
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            leaf //= 2
            level[0, leaf] = below[0, 2 * leaf] + below[0, 2 * leaf + 1]
            level[1, leaf] = below[1, 2 * leaf] + below[1, 2 * leaf + 1]

    def edit(self, start: int, length: int, new: str) -> None:
        """Replace ``length`` characters from ``start`` by ``new``; places beyond the text are its end."""
        total = self.n_chars
        start = max(0, min(start, total))
        end = max(start, min(start + length, total))
        if not total:
            first, begin, last, last_end = 0, 0, 0, 0
        else:
            first, begin = self.find(max(0, start - LOOKAHEAD))
            last, at = self.find(end)
            last_end = at + len(self.slots[last])
        old = "".join(self.slots[first : last + 1])
        head, tail = old[: start - begin], old[end - begin :]
        edited = len(head) + len(new)  # in the window, the text from here on is old
        window, upto, step = head + new + tail, last + 1, STEP
        leaves = [(len(head) + len(new) + len(tail) - (last_end - begin) + o, k) for o, k in self._bounds(first, last + 1) if begin + o >= end]
        while True:
            ahead = min(len(self.slots), upto + step)
            at = len(window)
            for k in range(upto, ahead):
                leaves.append((at, k))
                at += len(self.slots[k])
            window += "".join(self.slots[upto:ahead])
            upto, step = ahead, 2 * step
            whole = upto == len(self.slots)
            meets = {o: k for o, k in reversed(leaves) if o >= edited and k > first}
            words: list[str] = []
            done = 0
            stop = None
            for m in self.split.finditer(window):
                if m.start() in meets:
                    stop = meets[m.start()]
                    break
                if not whole and m.end() + LOOKAHEAD > len(window):
                    break
                words.append(m.group())
                done = m.end()
            else:
                if whole:
                    stop = len(self.slots)
            if stop is not None:
                break
        self.reencoded += done
        self._put(first, "".join(words), sum(map(self.counts.__getitem__, words)))
        for k in range(first + 1, stop):
            if self.slots[k]:
                self._put(k, "", 0)

    def _bounds(self, first: int, stop: int) -> Iterator[tuple[int, int]]:
        at = 0
        for k in range(first, stop):
            yield at, k
            at += len(self.slots[k])


#: What the cleaning edits mask, as pattern and mask.
MASKS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
    (r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])", "<IP>"),
    (r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "<PHONE>"),
    (r"(?<![0-9])[0-9]{16}(?![0-9])", "<CARD>"),
)
_MASK = re.compile("|".join(f"({p})" for p, _ in MASKS))


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Masks for personal data, and the removal of every line that an earlier line equals; last place first."""
    edits = [(m.start(), m.end() - m.start(), MASKS[m.lastindex - 1][1]) for m in _MASK.finditer(text)]
    seen: set[str] = set()
    at = 0
    gone: list[tuple[int, int]] = []
    for line in text.split("\n"):
        if line.strip() and line in seen:
            gone.append((at - 1, len(line) + 1))
        seen.add(line)
        at += len(line) + 1
    if gone:
        ends = [(a, a + n) for a, n in gone]
        edits = [e for e in edits if not any(a <= e[0] < b for a, b in ends)] + [(a, n, "") for a, n in gone]
    return sorted(edits, reverse=True)


def count(docs: DataFrame, edits_of=cleaning_edits, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Tokens of every document before and after its edits.

    ``edits_of`` maps a text to edits (start, length, new text), applied one after another, each to
    the text that the ones before have left. Null texts count as empty; repeated rows are counted
    each; other columns are left out, whatever their names.
    """
    own_path, own_pattern = default_vocabulary()
    path, pattern = path or own_path, pattern or own_pattern

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        split, counts = splitter(pattern), TokenCounts(path, pattern)
        for doc_id, text in rows:
            tree = TokenTree(text or "", split, counts)
            before, edits = tree.n_tokens, edits_of(text or "")
            for start, length, new in edits:
                tree.edit(start, length, new)
            yield doc_id, before, tree.n_tokens, len(edits), tree.n_chars, tree.reencoded

    schema = "doc_id long, n_tokens long, n_tokens_edited long, n_edits long, n_chars_edited long, n_chars_reencoded long"
    return per_row(docs, ["doc_id", "text"], schema, run)


def op1_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(documents(spark, sf_dir))
