"""Plain versions that operators are held against."""

import random
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    out, cur = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out + ([cur] if cur else [])


def plain_components(docs, percent=85):
    """doc_id to the smallest linked doc_id, by comparing all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = words((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def plain_boilerplate(docs, sites=5, share=2 / 3):
    """Lines on many sites, over texts that aren't made of such lines; docs are (doc_id, text, source)."""
    home, lines = {}, {}
    for _, text, source in docs:
        if text is not None:
            home[text] = min(home.get(text, source or ""), source or "")
            lines[text] = {x.strip(" ") for x in text.split("\n")} - {""}

    def spread(of):
        at = defaultdict(set)
        for text in of:
            for line in lines[text]:
                at[line].add(home[text])
        return {line for line, where in at.items() if len(where) >= sites}

    wide = spread(lines)
    own = [t for t, ls in lines.items() if sum(len(x) for x in ls & wide) <= share * sum(map(len, ls))]
    return wide & spread(own)


def plain_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    often = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(often)


def prose(rng, n):
    return " ".join("".join(rng.choice(("th", "er", "on", "an", "re", "st")) for _ in range(rng.randint(1, 3))) for _ in range(n))


def family(rng, n, size=120, edits=6):
    """Near copies of one text, some of them far from the others."""
    base = prose(rng, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"x{rng.random()}"
        out.append(" ".join(w))
    return out


def is_entity(match):
    """False for numbers in a card's form that no issuer gives: of another first digit, or that fail Luhn's check."""
    digits = "".join(c for c in match if c.isdigit())
    if set(match) - set("0123456789 -") or len(digits) not in (15, 16):
        return True
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1])))
    head = int(digits[:4])
    issued = digits[0] == "4" or 5100 <= head <= 5599 or 2221 <= head <= 2720 or 3528 <= head <= 3589 or head // 100 in (34, 37, 62, 65) and (head // 100 != 62 or head // 10 == 622) or head == 6011 or 6440 <= head <= 6499
    return issued and total % 10 == 0


def edge_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    long = prose(random.Random(1), 30_000)
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, long, "en", "b", len(long)),
        (4, long, "en", "b", len(long)),
        (5, "same words here and there again", "en", "c", 5),
        (6, "same words here and there again", "en", "d", 5),
        (7, "one", None, "d", 3),
        (8, "x" * 5000, "en", None, 5000),
        (None, "no id here at all", "en", "a", 1),
    ]


def plain_factor(text, start, end, near):
    """The weight of a hit's context, by scanning its line anew."""
    from tessella.llm import toxicity as T

    line_start = text.rfind("\n", 0, start) + 1
    line_end = text.find("\n", end) if "\n" in text[end:] else len(text)
    open_, low, high, angle = 0, 0, 0, 0
    for c in text[line_start:start]:
        if c == '"':
            open_ = 1 - open_
        elif c == "„":
            low += 1
        elif c == "“" and low:
            low -= 1
        elif c == "“":
            high += 1
        elif c == "”" and high:
            high -= 1
        elif c == "”":
            low = max(0, low - 1)
        elif c in "«»":
            angle = max(0, angle + (1 if c == "«" else -1))
    before, after = text[:start].rstrip(), text[end:].lstrip()
    single = before[-1:] in tuple("'‘‚‹") and after[:1] in tuple("'’‘›")
    inside = bool(open_ or low or high or angle) and any(c in '"“”»' for c in text[end:line_end])
    factor = T.QUOTED if single or inside else 1.0
    return factor * T.REPORTED if any(w in T.REPORTING for w in near) else factor
