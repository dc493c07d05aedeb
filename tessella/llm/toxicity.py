"""Toxicity by Levenshtein automata over a learnt lexicon, with scores by context.

The lexicon holds whole words and word stems whose documents are labelled toxic far more often
than chance allows. Levenshtein automata are intersected with the lexicon's trie: a state is a
set of (trie node, edits so far), made deterministic as tokens ask for it, so a token costs one
dictionary look-up a character and most die after a few. A hit counts in full in plain speech and
little where its context window quotes it: quotation marks around it, or a reporting word near.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, documents, held_out, held_out_col, per_row

#: Labelled rows that the lexicon is learnt from, at most; taken by a hash of doc_id.
MAX_ROWS = 12_000
MIN_TOXIC, MIN_SHARE = 6, 0.9
STEM_LENGTHS = range(4, 9)
MIN_STEM_TOXIC, MIN_STEM_SHARE, MIN_STEM_WORDS = 6, 0.95, 3
#: A stem is lengthened while it keeps this share of its toxic documents.
STEM_KEEPS = 0.97
#: Toxic documents must have a term after this many distinct words for each of them: words of copied documents stand after the same ones.
MIN_CONTEXT_SHARE = 0.15
#: Edits allowed from these term lengths on.
EDITS = ((5, 1), (10, 2))
WINDOW = 6
QUOTED, REPORTED = 0.3, 0.6
THRESHOLD = 0.7
KEPT_TOKENS = 300_000

TOKEN = re.compile(r"\w[\w@$]*\w|\w")
LEET = str.maketrans("013457@$", "oieastas")
#: Single marks quote only the word right between them, as they are apostrophes too.
OPENING, CLOSING = "'‘‚‹", "'’‘›"
#: Words that report speech, in the corpus' languages.
REPORTING = frozenset("said says called quote quoted quoting wrote term word phrase sagte nannte zitat zitiert wort begriff dit appelé cité citation mot terme dijo llamó citado cita palabra término".split())

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_hits int, n_fuzzy int, n_quoted int"


def edits_for(length: int, rule=EDITS) -> int:
    return max([k for n, k in rule if length >= n], default=0)


class Lexicon:
    """Terms in a trie, and its product with Levenshtein automata, made deterministic on demand."""

    def __init__(self, terms: dict[tuple[str, bool], float], rule=EDITS, most_states: int = 20_000):
        """``terms``: (text, whether it is a stem) to weight."""
        self.terms = sorted(terms)
        self.weights = [terms[t] for t in self.terms]
        self.most_states = most_states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        #: Most edits of any term below a node.
        self.allowed: list[int] = [0]
        for k, (text, _) in enumerate(self.terms):
            node, budget = 0, edits_for(len(text), rule)
            self.allowed[0] = max(self.allowed[0], budget)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], budget)
            self.ends[node].append(k)
        self.budgets = [edits_for(len(t), rule) for t, _ in self.terms]
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.best: list[tuple[tuple[int, int], ...]] = []
        self.stems: list[tuple[tuple[int, int], ...]] = []
        self.start = self._state({(0, 0, "")})

    def _closed(self, items: set) -> frozenset:
        """With deletions of lexicon characters; a node keeps its fewest edits."""
        least: dict[tuple[int, str], int] = {}
        todo = list(items)
        while todo:
            node, e, pend = todo.pop()
            if e > self.allowed[node] or least.get((node, pend), 99) <= e:
                continue
            least[node, pend] = e
            if not pend:
                todo += [(child, e + 1, "") for child in self.children[node].values()]
        return frozenset((n, e, p) for (n, p), e in least.items())

    def _state(self, items: set) -> int:
        closed = self._closed(items)
        if not closed:
            return -1
        if closed not in self.ids:
            self.ids[closed] = len(self.sets)
            self.sets.append(closed)
            self.next.append({})
            hits = sorted({(e, k) for n, e, p in closed if not p for k in self.ends[n] if e <= self.budgets[k]})
            self.best.append(tuple(hits))
            self.stems.append(tuple((e, k) for e, k in hits if self.terms[k][1]))
        return self.ids[closed]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e, pend in self.sets[state]:
            if pend:  # the second half of two swapped characters
                if c == pend[0]:
                    out.add((int(pend[1:]), e, ""))
                continue
            for x, child in self.children[node].items():
                if x == c:
                    out.add((child, e, ""))
                else:
                    out.add((child, e + 1, ""))
                    if c in self.children[child]:
                        out.add((node, e + 1, f"{x}{self.children[child][c]}"))
            out.add((node, e + 1, ""))
        return self._state(out)

    def match(self, token: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term that the token spells, or that begins it if a stem."""
        if len(self.sets) > self.most_states:
            self._reset()
        state, found = self.start, None
        for c in token:
            follow = self.next[state]
            if c not in follow:
                follow[c] = self._step(state, c)
            state = follow[c]
            if state < 0:
                return found
            for hit in self.stems[state][:1]:
                found = min(found or hit, hit)
        for hit in self.best[state][:1]:
            found = min(found or hit, hit)
        return found


def kind_of(edits: int, token: str, term: str, stem: bool) -> str:
    """How a token differs from its term: 'exact', or fuzzy by its length and edits."""
    if not edits:
        return "exact"
    return f"stem{edits}" if stem else f"longer{edits}" if len(token) > len(term) else f"shorter{edits}" if len(token) < len(term) else f"alike{edits}"


class Matcher(dict):
    """Token to (term, kind) or None, learning within a bound."""

    def __init__(self, lexicon: Lexicon, most: int = KEPT_TOKENS):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, token: str):
        plain = token if token.isalpha() else token.translate(LEET)
        hit = self.lexicon.match(plain) if plain.isalpha() else None
        out = hit and (hit[1], kind_of(hit[0], plain, *self.lexicon.terms[hit[1]]))
        if len(self) >= self.most:
            self.clear()
        if len(token) <= 64:
            self[token] = out
        return out


QUOTE = re.compile("[\"“„”«»\n]")


class Quotations:
    """Where a text's quotations are, line by line, from one pass over its marks."""

    def __init__(self, text: str):
        self.text = text
        self.at: list[int] = []
        self.open: list[bool] = []
        #: Whether a closing mark comes in the same line, from this mark on.
        self.closing: list[bool] = []
        plain = low = high = angle = 0
        for m in QUOTE.finditer(text):
            c = m.group()
            if c == "\n":
                plain = low = high = angle = 0
            elif c == '"':
                plain ^= 1
            elif c == "„":
                low += 1
            elif c == "“":  # ends a quotation that began low, else begins one
                low, high = (low - 1, high) if low else (low, high + 1)
            elif c == "”":
                low, high = (low, high - 1) if high else (max(0, low - 1), high)
            else:
                angle = max(0, angle + (1 if c == "«" else -1))
            self.at.append(m.start())
            self.open.append(bool(plain or low or high or angle))
            self.closing.append(c in '"“”»')
        for k in range(len(self.at) - 2, -1, -1):
            self.closing[k] = self.closing[k] or text[self.at[k]] != "\n" and self.closing[k + 1]

    def around(self, start: int, end: int) -> bool:
        """Whether a place is quoted: by single marks right beside it, or in a quotation of its line that began before and ends after it."""
        text, a, b = self.text, start, end
        while a and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        if a and b < len(text) and text[a - 1] in OPENING and text[b] in CLOSING:
            return True
        before, after = bisect_left(self.at, start) - 1, bisect_left(self.at, end)
        return before >= 0 and self.open[before] and after < len(self.at) and self.closing[after]


def context_factor(quotations: Quotations, start: int, end: int, near: list[str]) -> float:
    """1 for plain use; less inside quotation marks, or beside a word that reports speech."""
    factor = QUOTED if quotations.around(start, end) else 1.0
    return factor * REPORTED if any(w in REPORTING for w in near) else factor


def score_text(text: str | None, matcher: Matcher, fuzzy: dict[tuple[int, str], float]) -> tuple[float, int, int, int]:
    """Score, hits, fuzzy hits, quoted hits of a whole text; null and empty texts score 0."""
    low = (text or "").lower()
    if not any(map(matcher.__getitem__, set(TOKEN.findall(low)))):
        return 0.0, 0, 0, 0
    tokens, quotations = list(TOKEN.finditer(low)), Quotations(low)
    clean, hits, n_fuzzy, quoted = 1.0, 0, 0, 0
    for i, m in enumerate(tokens):
        hit = matcher[m.group()]
        if hit is None:
            continue
        term, kind = hit
        p = matcher.lexicon.weights[term] if kind == "exact" else fuzzy.get((term, kind), fuzzy[-1, ""])
        factor = context_factor(quotations, m.start(), m.end(), [t.group() for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]])
        hits, n_fuzzy, quoted = hits + 1, n_fuzzy + (kind != "exact"), quoted + (factor < 1)
        clean = min(clean, 1 - p * factor)  # the plainest hit decides: many quotations stay quotations
    return 1 - clean, hits, n_fuzzy, quoted


#: Labelled documents that a misspelling's prior weight counts as.
PRIOR_DOCS = 2


def unseen(weight: float, length: int, edits: int) -> float:
    """The weight of a misspelling that no labelled document has: its term's, for the share of the letters that stand."""
    return weight * (1 - edits / length)


def priors(terms: dict[tuple[str, bool], float]) -> dict[tuple[int, str], float]:
    """The weights of all unseen misspellings by (term, kind), whatever the number of labels."""
    return {
        (k, f"{kind}{edits}"): unseen(terms[text, stem], len(text), edits)
        for k, (text, stem) in enumerate(sorted(terms))
        for edits in range(1, edits_for(len(text)) + 1)
        for kind in (("stem",) if stem else ("longer", "shorter", "alike"))
    }


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """Texts and labels of at most ``max_rows`` labelled rows that aren't held out, by a hash of doc_id. Of several labels, the greatest holds."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out_col("doc_id")).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # ids and labels alone, so at most 16 bytes a row
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")


def _counted(sample: DataFrame, terms_of) -> DataFrame:
    """Toxic and clean documents of every term: term, toxic, clean."""

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[tuple]:
            for term in seen[0].keys() | seen[1].keys():
                yield term, seen[1][term], seen[0][term]

        for text, label in rows:
            seen[1 if label else 0].update(terms_of(text))
            if len(seen[0]) > 400_000:
                yield from out()
                seen[0].clear()
                seen[1].clear()
        yield from out()

    return per_row(sample, ["text", "label"], "term string, toxic long, clean long", run).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _terms(text: str | None) -> set[str]:
    words = {w for w in TOKEN.findall((text or "").lower()) if w.isalpha()}
    return words | {f"{w[:n]}*" for w in words for n in STEM_LENGTHS if n < len(w)}


def _contexts(sample: DataFrame, wanted: set[str]) -> dict[str, int]:
    """How many distinct words come before each of the wanted terms (a stem ends in *) in toxic documents."""

    def pairs(text: str | None) -> set[str]:
        words = TOKEN.findall((text or "").lower())
        out = set()
        for before, w in zip(["", *words], words, strict=False):
            for term in (w, *(f"{w[:n]}*" for n in STEM_LENGTHS if n < len(w))):
                if term in wanted:
                    out.add(f"{term} {before}")
        return out

    pairs_of = _counted(sample.where("label <> 0"), pairs)
    return {r.term: r.n for r in pairs_of.groupBy(F.substring_index("term", " ", 1).alias("term")).agg(F.count("*").alias("n")).collect()}  # at most the wanted terms


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[dict[tuple[str, bool], float], dict[tuple[int, str], float]]:
    """The lexicon's terms with weights, and the weights of misspellings by (term, kind); (-1, "") has any other's.

    Clean labelled documents with a term's misspelling lower its weight, toxic ones raise it.
    Without toxic documents among the labelled rows, there are no terms and every score is 0.
    """
    sample = training_sample(docs, labels, "toxic", max_rows).repartition(24).persist()
    try:
        counts = _counted(sample, _terms)
        enough = (F.col("toxic") >= MIN_TOXIC) & (F.col("toxic") >= MIN_SHARE * (F.col("toxic") + F.col("clean")))
        rows = counts.where(enough).orderBy(F.desc("toxic"), "term").collect()  # terms of at most max_rows texts
        contexts = _contexts(sample, {r.term for r in rows})
        rows = [r for r in rows if contexts[r.term] >= max(MIN_TOXIC, MIN_CONTEXT_SHARE * r.toxic)]
        words = {r.term: (r.toxic, r.clean) for r in rows if not r.term.endswith("*")}
        found: dict[tuple[str, bool], float] = {}
        stems = sorted((r for r in rows if r.term.endswith("*")), key=lambda r: (len(r.term), r.term))
        taken: set[str] = set()
        under = Counter(w[:n] for w in words for n in STEM_LENGTHS if n < len(w))
        of_stem = {r.term[:-1]: (r.toxic, r.clean) for r in stems}
        for stem in list(of_stem):
            if any(stem[:n] in taken for n in STEM_LENGTHS):
                continue
            while longer := [x for x in of_stem if len(x) == len(stem) + 1 and x.startswith(stem) and of_stem[x][0] >= STEM_KEEPS * of_stem[stem][0]]:
                stem = longer[0]  # as specific as it can be without losing documents
            toxic, clean = of_stem[stem]
            if stem not in taken and toxic >= MIN_STEM_TOXIC and toxic >= MIN_STEM_SHARE * (toxic + clean) and under[stem] >= MIN_STEM_WORDS:
                taken.add(stem)
                found[stem, True] = (toxic + 0.5) / (toxic + clean + 1)
        for word, (toxic, clean) in words.items():
            if not any(word[:n] in taken for n in STEM_LENGTHS):
                found[word, False] = (toxic + 0.5) / (toxic + clean + 1)
        if not found:
            return {}, {(-1, ""): 0.0}

        held: list[Matcher] = []

        def misspelt(text: str | None) -> set[str]:
            if not held:
                held.append(Matcher(Lexicon(found)))
            hits = {h for h in map(held[0].__getitem__, set(TOKEN.findall((text or "").lower()))) if h}
            return set() if any(kind == "exact" for _, kind in hits) else {f"{term} {kind}" for term, kind in hits}

        fuzzy = {(-1, ""): 0.0, **priors(found)}
        for r in _counted(sample, misspelt).collect():  # at most six kinds a term
            term, kind = r.term.split()
            prior = fuzzy[int(term), kind]
            fuzzy[int(term), kind] = (r.toxic + PRIOR_DOCS * prior) / (r.toxic + r.clean + PRIOR_DOCS)
        return found, fuzzy
    finally:
        sample.unpersist()


def score(docs: DataFrame, terms: dict, fuzzy: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Score and verdict for every document; ``docs`` needs doc_id and text.

    Null and empty texts score 0. Repeated rows are scored each. Other columns are left out. The
    lexicon travels with the task: its terms come from at most MAX_ROWS texts.
    """

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        matcher = Matcher(Lexicon(terms))
        for doc_id, text in rows:
            s, hits, n_fuzzy, quoted = score_text(text, matcher, fuzzy)
            yield doc_id, doc_id is not None and held_out(doc_id), s, int(s >= threshold), hits, n_fuzzy, quoted

    return per_row(docs, ["doc_id", "text"], SCHEMA, run)


def keep_clean(docs: DataFrame, terms: dict, fuzzy: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under the threshold; nothing is shuffled."""
    at = docs.columns.index("text")
    bound_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(Lexicon(terms))
        for b in batches:
            yield b.filter(pa.array([score_text(t, matcher, fuzzy)[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, *fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
