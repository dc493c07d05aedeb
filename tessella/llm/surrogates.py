"""Personal data replaced by keyed surrogates, in DataFrame and SQL functions alone.

Each entity (an e-mail address, phone number, card, ...) has a canonical form, shared by all its
spellings. Its surrogate is the value of a keyed permutation of all forms of the same type and
shape: digits become digits, letters become letters of their class and case, separators stay. So
the same entity gets the same surrogate everywhere without any join, two entities can't get the
same one, and none is its own. Valid card numbers stay valid and of their issuer's range, private
addresses stay private, addresses of one mail domain keep sharing one. Names are permuted word by
word, without regard to title or place, so every spelling of a person shares the surname; titles
and final vowels, which mark gender, stay, and so do script and length.

What a permutation can't rule out is that a surrogate is the value of another entity of the
corpus. The corpus' distinct entities are checked for that; those few take the first further
attempt that is neither a real value nor anyone's surrogate. Where a shape's space is too full for
that, they keep the permutation's value: distinct, but another entity's real form.

Expressions are built as SQL text, and parsed at once: as Column objects, their some thousand
nodes take seconds to build.
"""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, written

KEY = "tessella"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_CARD = r"(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9A-Za-z-])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_LOCAL_PHONE = r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
#: A number of the North American plan has ten digits after +1; others end before an entity that begins there.
_PLAN_PHONE = r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])"
_GROUP = r"[ .-]?\(?[0-9]{2,4}\)?"
_FREE_PHONE = rf"\+[0-9]{{1,3}}{_GROUP}(?![ -]{_IP}){_GROUP}(?:(?![ -](?:{_IP}|{_CARD}(?! ?[0-9])|{_SSN}|{_LOCAL_PHONE}(?![0-9A-Za-z]))){_GROUP}){{0,2}}"
_TITLE = r"(?:Mrs|Mr|Ms|Miss|Dr|Herr|Frau|Mme|Sra|Sr|Г-жа|Г-н)\.?"
#: A name's word, with inner apostrophes and hyphens but without a possessive's.
_WORD = r"\p{Lu}['’]?\p{L}[\p{L}\p{M}]*+(?:['’-](?!s(?!\p{L}))\p{L}[\p{L}\p{M}]*+)*+"
_INITIALS = r"(?:\p{Lu}\. ?)*"
#: Type and pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])",
    "secret": r"(?<=[=: \"'])(?<=(?i:password|passwd|secret|token|api_key) ?[=:] ?[\"']?)[A-Za-z0-9_/+-]{8,}",
    "ip": rf"(?<![0-9.]){_IP}",
    "card": rf"(?<![0-9A-Za-z.+-]){_CARD}",
    "ssn": rf"(?<![0-9A-Za-z-]){_SSN}",
    "phone": rf"(?<![0-9A-Za-z+])(?:{_PLAN_PHONE}|{_FREE_PHONE}|{_LOCAL_PHONE})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE} ){{1,3}}{_INITIALS}{_WORD}(?: {_INITIALS}{_WORD}){{0,2}}",
}
_KINDS = list(PATTERNS)
_AT = _KINDS.index("secret")
#: All patterns; the second group is a secret, known by what stands before it.
ANY = "({})|({})|({})".format("|".join(PATTERNS[k] for k in _KINDS[:_AT]), PATTERNS["secret"], "|".join(PATTERNS[k] for k in _KINDS[_AT + 1 :]))
#: What every title holds.
TITLE_PARTS = ("Mr", "Ms", "Miss", "Dr", "Herr", "Frau", "Mme", "Sr", "Г-")
#: The first digits of issued cards.
ISSUED = "^(?:4|5[1-5]|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)|3[47]|35(?:2[89]|[3-8])|6(?:011|22|4[4-9]|5))"
DIGITS, LETTERS, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
VOWELS = ("aeiou", "аеёиіїєоуыэюя", "αεηιουω")
#: The classes within which a name's letters change: vowels, consonants and letters with marks of each script.
WORD_CLASSES = (*VOWELS, "bcdfghjklmnpqrstvwxyz", "бвгґджзйклмнпрстфхцчшщ", "βγδζθκλμνξπρστφχψ", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ", "çćčďđğłñńňřśşšťźżž", "άέήίόύώ", "".join(map(chr, range(0x561, 0x587))))
#: Address space: first octets that are public as a whole, and the special second octets of others.
PUBLIC = tuple(n for n in range(1, 224) if n not in (10, 100, 127, 169, 172, 192))
SPECIAL = {100: (64, 127), 169: (254, 254), 172: (16, 31), 192: (168, 168)}
#: Rounds of a permutation before its middle, and further attempts at a value that isn't taken.
ROUNDS, ATTEMPTS = 3, 4
LETTER_RUN, DIGIT = r"[\p{L}\p{M}]+", "[0-9]"
MARK, SECRET_MARK = "\x01", "\x02"


def _bare(pattern: str) -> str:
    """A pattern without the conditions on what stands around its match."""
    while re.match(r"\(\?<[!=]", pattern):
        depth, at, in_class = 0, 0, False
        for at, c in enumerate(pattern):
            in_class = c == "[" or in_class and c != "]"
            depth += (c == "(" and not in_class) - (c == ")" and not in_class)
            if depth == 0:
                break
        pattern = pattern[at + 1 :]
    return re.sub(r"\(\?![^()]*\)$", "", pattern)


_names = count()


def _let(value: str, fn) -> str:
    """``fn`` of a value that is computed once, though it is used often."""
    return f"element_at({_each(f'array({value})', fn)}, 1)"


def _each(values: str, fn) -> str:
    x = f"x{next(_names)}"
    return f"transform({values}, {x} -> {fn(x)})"


def _each_at(values: str, fn) -> str:
    x = f"x{next(_names)}"
    return f"transform({values}, ({x}, i{x}) -> {fn(x, f'i{x}')})"


def _those(values: str, fn) -> str:
    x = f"x{next(_names)}"
    return f"filter({values}, {x} -> {fn(x)})"


def _case(*cases: tuple[str, str], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in cases) + f" ELSE {other} END"


def _text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _chars(s: str) -> str:
    return _those(f"split({s}, '')", lambda c: f"{c} <> ''")


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _luhn_sum(digits: str) -> str:
    """Luhn's sum of a digit string, where every second digit from the right, but not the last, is doubled."""
    weight = lambda v, i, n: f"IF(({n} - {i}) % 2 = 0, {v} * 2 - IF({v} > 4, 9, 0), {v})"
    return _let(f"length({digits})", lambda n: f"aggregate({_each_at(_chars(digits), lambda c, i: weight(f'CAST({c} AS INT)', i, n))}, 0, (a, d) -> a + d)")


def type_of(mention: str, secret: str) -> str:
    """The type of a mention by its form, so that it doesn't change with what stands around; else 'secret' if it is one.

    Null for what is no entity: numbers in a card's form that no issuer's range has, or that
    Luhn's check rejects.
    """
    fits = {k: f"{mention} RLIKE {_text(f'^(?:{_bare(p)})$')}" for k, p in PATTERNS.items()}
    fits["card"] += " AND " + _let(_digits(mention), lambda d: f"{d} RLIKE {_text(ISSUED)} AND pmod({_luhn_sum(d)}, 10) = 0")
    return _case(*[(fits[k], f"'{k}'") for k in PATTERNS if k != "secret"], (secret, "'secret'"))


def _name_part(mention: str) -> str:
    return f"regexp_replace({mention}, {_text(f'^(?:{_TITLE} )+')}, '')"


def canonical(kind: str, mention: str) -> str:
    """What all spellings of an entity share: a number of the North American plan has ten digits, a name no title."""
    phone = _case((f"{mention} RLIKE {_text(f'^(?:{_bare(_PLAN_PHONE)})$')}", f"substring({_digits(mention)}, 2, 10)"), (f"startswith({mention}, '+')", f"concat('+', {_digits(mention)})"), other=_digits(mention))
    return _case((f"{kind} = 'phone'", phone), (f"{kind} IN ('card', 'ssn')", _digits(mention)), (f"{kind} = 'email'", f"lower({mention})"), (f"{kind} = 'name'", f"lower({_name_part(mention)})"), other=mention)


def atoms(kind: str, canon: str) -> str:
    """The parts of a canonical form that have surrogates of their own: (kind, canon) of an address' domain, a name's words, or of the whole."""
    atom = lambda k, c: f"named_struct('kind', {k}, 'canon', {c})"
    words = _each(f"regexp_extract_all({canon}, {_text(LETTER_RUN)}, 0)", lambda w: atom("'word'", w))
    return _case((f"{kind} = 'email'", f"array({atom(repr('host'), f'substring_index({canon}, {repr(chr(64))}, -1)')})"), (f"{kind} = 'name'", words), other=f"array({atom(kind, canon)})")


def _label(key: str, *parts: str) -> str:
    return f"concat_ws('|', {_text(key)}, {', '.join(parts)})"


def permuted(values: str, sizes: str, label: str) -> str:
    """The values (each below its size) under a permutation, keyed by ``label``, of all such arrays that has no fixed point.

    Places of even and odd index shift in turn by a digest of the others; then one place shifts by
    a step that isn't 0, and the first shifts are undone. This is a conjugate of a shift, so it is
    one to one for sizes of any kind and leaves no array as it is, unless all sizes are 1.
    """
    byte = lambda digest, i: f"CAST(conv(substr({digest}, {i} % 64 * 2 + 1, 2), 16, 10) AS INT)"
    s, j, x = (f"{c}{next(_names)}" for c in "sjx")

    def turn(head: str, lead: str) -> str:
        def shifted(t: str) -> str:  # digest, side
            step = lambda i: f"IF({j} < {ROUNDS}, 1, -1) * {byte(f'{t}.digest', i)}"
            middle = _each_at(s, lambda v, i: f"IF({i} = {lead}, pmod({v} + 1 + {byte(f'{t}.digest', '0')} % (get({sizes}, {i}) - 1), get({sizes}, {i})), {v})")
            side = _each_at(s, lambda v, i: f"IF({i} % 2 = {t}.side, pmod({v} + {step(i)}, get({sizes}, {i})), {v})")
            return f"IF({j} = {ROUNDS}, {middle}, {side})"

        others = lambda d: f"IF({j} = {ROUNDS}, 'middle', array_join(filter({s}, ({x}, i{x}) -> i{x} % 2 <> {d} % 2), ','))"
        seeded = lambda d: f"named_struct('side', {d} % 2, 'digest', sha2(concat_ws('|', {head}, {d}, {others(d)}), 512))"
        return _let(f"least({j}, {2 * ROUNDS} - {j})", lambda d: _let(seeded(d), shifted))

    lead = f"CAST(array_position({_each(sizes, lambda n: f'{n} > 1')}, true) AS INT) - 1"
    whole = lambda head, first: f"aggregate(sequence(0, {2 * ROUNDS}), {values}, ({s}, {j}) -> {turn(head, first)})"
    return _let(f"concat_ws('|', {label}, array_join({sizes}, ','))", lambda head: _let(lead, lambda first: whole(head, first)))


def _permuted_pairs(pairs: str, label: str) -> str:
    """``permuted`` of an array of structs (v, n); both arrays are taken out once."""
    return _let(f"named_struct('v', {pairs}.v, 'n', {pairs}.n)", lambda x: permuted(f"{x}.v", f"{x}.n", label))


def _respelt(canon: str, alphabet_of, label: str) -> str:
    """A string whose characters are permuted within their alphabets; ``alphabet_of`` (character, place) is null for those that stay."""
    item = lambda c, i: _let(f"coalesce({alphabet_of(c, i)}, {c})", lambda a: f"named_struct('at', {i}, 'a', {a}, 'v', instr({a}, {c}) - 1, 'n', length({a}))")

    def joined(items: str) -> str:
        def spelt(some: str) -> str:
            x = f"x{next(_names)}"
            made = _permuted_pairs(some, label)
            new = f"zip_with({some}, {made}, ({x}, v{x}) -> named_struct('at', {x}.at, 'c', substr({x}.a, v{x} + 1, 1)))"
            stay = _each(_those(items, lambda y: f"{y}.n = 1"), lambda y: f"named_struct('at', {y}.at, 'c', {y}.a)")
            return f"IF(size({some}) = 0, {canon}, array_join(sort_array(concat({new}, {stay})).c, ''))"

        return _let(_those(items, lambda y: f"{y}.n > 1"), spelt)

    return _let(_each_at(_chars(canon), item), joined)


def _alphabet(kind: str, c: str, i: str, n: str) -> str:
    """What the character at place ``i`` of ``n`` may become; null if it stays.

    A card's first four digits stay, a phone number's country and whether its area and exchange
    begin with 2 to 9. A secret's hexadecimal letters stay hexadecimal, so that secrets of such
    digits do. A name's vowels become vowels and its consonants consonants of their script, and a
    final vowel stays.
    """
    final = lambda a: f"IF({i} = {n} - 1 AND {n} > 1, NULL, {_text(a)})"
    word = _case(*[(f"contains({_text(a)}, {c})", final(a) if a in VOWELS else _text(a)) for a in WORD_CLASSES])
    area = f"greatest({n} - 10, 0)"
    return _case(
        (f"{kind} = 'word'", word),
        (f"{kind} = 'hex'", _text(HEX)),
        (f"{kind} IN ('card', 'key') AND {i} < 4 OR {kind} = 'phone' AND {i} < {area}", "NULL"),
        (f"{kind} = 'phone' AND {c} RLIKE '[0-9]' AND {i} IN ({area}, {area} + 3)", f"IF({c} < '2', '01', '23456789')"),
        (f"{kind} = 'secret' AND {c} RLIKE '[a-f]'", _text(LETTERS[:6])),
        (f"{kind} = 'secret' AND {c} RLIKE '[g-z]'", _text(LETTERS[6:])),
        (f"{c} RLIKE '[0-9]'", _text(DIGITS)),
        (f"{c} RLIKE '[a-z]'", _text(LETTERS)),
        (f"{c} RLIKE '[A-Z]'", _text(UPPER)),
    )


def _spelt(kind: str, canon: str, label: str) -> str:
    """The surrogate of an atom that is no address of the net.

    A domain's last part stays; a card's last digit becomes Luhn's check digit. A word of letters
    that no class has becomes Latin letters of a digest.
    """
    top = f"substring_index({canon}, '.', -1)"
    base = _case((f"{kind} = 'host'", f"substr({canon}, 1, length({canon}) - length({top}))"), (f"{kind} = 'card'", f"substr({canon}, 1, length({canon}) - 1)"), other=canon)
    zero = lambda x: f"concat({x}, '0')"
    ended = lambda x: _case((f"{kind} = 'host'", f"concat({x}, {top})"), (f"{kind} = 'card'", f"concat({x}, pmod(10 - pmod({_luhn_sum(zero(x))}, 10), 10))"), other=x)
    made = _let(f"named_struct('b', {base}, 'n', length({base}))", lambda x: _let(_respelt(f"{x}.b", lambda c, i: _alphabet(kind, c, i, f"{x}.n"), label), ended))
    known = "".join(WORD_CLASSES)
    digest = f"translate(sha2(concat_ws('|', {label}, {canon}), 256), '{DIGITS}', 'ghijklmnop')"
    return _case((f"{kind} = 'word' AND NOT {canon} RLIKE {_text(f'[{known}].*[{known}]|^[{known}]')}", digest), other=made)


def _ip(canon: str, label: str) -> str:
    """A public address for a public one, a private or reserved one of the same range for others; 0 and 255 stay among themselves."""
    pair = lambda v, n: f"named_struct('v', CAST({v} AS INT), 'n', CAST({n} AS INT))"
    plain = lambda x: f"IF({x} IN (0, 255), {pair(f'{x} / 255', '2')}, {pair(f'{x} - 1', '254')})"
    back = lambda v, n: f"IF({n} = 2, {v} * 255, {v} + 1)"
    public = f"array({', '.join(map(str, PUBLIC))})"

    def made(o: str) -> str:  # octets, lo and hi of the first one's special range
        a, b, width = f"{o}.x[0]", f"{o}.x[1]", f"({o}.hi - {o}.lo + 1)"
        inside = f"{b} BETWEEN {o}.lo AND {o}.hi"
        first = f"IF(array_contains({public}, {a}), {pair(f'array_position({public}, {a}) - 1', str(len(PUBLIC)))}, {pair('0', '1')})"
        second = _case((f"{o}.lo IS NULL", plain(b)), (inside, pair(f"{b} - {o}.lo", width)), other=pair(f"IF({b} < {o}.lo, {b}, {b} - {width})", f"256 - {width}"))

        def placed(items: str) -> str:
            def joined(v: str) -> str:
                one = f"IF({items}.n[0] > 1, get({public}, {v}[0]), {a})"
                two = _case((f"{o}.lo IS NULL", back(f"{v}[1]", f"{items}.n[1]")), (inside, f"{o}.lo + {v}[1]"), other=f"IF({v}[1] < {o}.lo, {v}[1], {v}[1] + {width})")
                return f"concat_ws('.', {one}, {two}, {back(f'{v}[2]', f'{items}.n[2]')}, {back(f'{v}[3]', f'{items}.n[3]')})"

            return _let(_permuted_pairs(items, label), joined)

        return _let(f"array({first}, {second}, {plain(f'{o}.x[2]')}, {plain(f'{o}.x[3]')})", placed)

    def ranged(x: str) -> str:
        lo, hi = (_case(*[(f"{x}[0] = {first}", str(ends[k])) for first, ends in SPECIAL.items()]) for k in (0, 1))
        return _let(f"named_struct('x', {x}, 'lo', {lo}, 'hi', {hi})", made)

    return _let(_each(f"split({canon}, '[.]')", lambda x: f"CAST({x} AS INT)"), ranged)


def surrogate(kind: str, canon: str, attempt: str, key: str = KEY) -> str:
    """The surrogate of an atom's canonical form, in canonical form."""
    return _let(_label(key, kind, attempt), lambda label: f"IF({kind} = 'ip', {_ip(canon, label)}, {_spelt(kind, canon, label)})")


def composed(kind: str, canon: str, attempt_of, key: str = KEY) -> str:
    """The surrogate of a whole canonical form; ``attempt_of`` gives an atom's (kind, canon) attempt."""
    part = lambda k, c: _let(_label(key, f"'{k}'", attempt_of(f"'{k}'", c)), lambda label: _spelt(f"'{k}'", c, label))

    def mail(x: str) -> str:
        local = _let(_label(key, "'local'", f"{x}.domain"), lambda label: _spelt("'local'", f"{x}.local", label))
        return f"concat({local}, '@', {part('host', f'{x}.domain')})"

    runs = f"regexp_extract_all({canon}, {_text(f'{LETTER_RUN}|[^{LETTER_RUN[1:]}')}, 0)"
    words = _each(runs, lambda w: f"IF({w} RLIKE {_text(f'^{LETTER_RUN}')}, {part('word', w)}, {w})")
    halves = f"named_struct('local', substring_index({canon}, '@', 1), 'domain', substring_index({canon}, '@', -1))"
    return _case((f"{kind} = 'email'", _let(halves, mail)), (f"{kind} = 'name'", f"array_join({words}, '')"), other=surrogate(kind, canon, attempt_of(kind, canon), key))


def laid(kind: str, mention: str, made: str) -> str:
    """A canonical surrogate in a mention's own format: its separators, its case, its title."""
    cased = lambda own: f"array_join(zip_with({_chars(own)}, {_chars(made)}, (c, m) -> IF(c <> lower(c), upper(m), m)), '')"

    def numbered(m: str) -> str:
        lead = f"(length({_digits(mention)}) - length({m}))"  # a country's digits that the canonical form has not
        nth = lambda i: f"(length({_digits(f'substr({mention}, 1, {i} + 1)')}) - {lead})"
        return f"array_join({_each_at(_chars(mention), lambda c, i: f'IF({c} RLIKE {_text(DIGIT)} AND {nth(i)} > 0, substr({m}, {nth(i)}, 1), {c})')}, '')"

    named = _let(_name_part(mention), lambda own: f"concat(substr({mention}, 1, length({mention}) - length({own})), {cased(own)})")
    return _case((f"{kind} IN ('phone', 'card', 'ssn')", _let(_digits(made), numbered)), (f"{kind} = 'email'", cased(mention)), (f"{kind} = 'name'", named), other=made)


def hint(text: str) -> str:
    """Whether a text may have entities: digits, an at sign, a secret's name, a title. Most texts have none, and cheap searches tell."""
    holds = lambda *parts: " OR ".join(f"contains({text}, {_text(p)})" for p in parts)
    secret = f"({holds('=', ':')}) AND {text} RLIKE '(?i)password|passwd|secret|token|api_key'"
    title = f"({holds(*TITLE_PARTS)}) AND {text} RLIKE {_text(_TITLE + ' .')}"
    return f"({text} RLIKE '[0-9@]' OR {secret} OR {title})"


def pieces(text: str) -> str:
    """A text cut at its matches: what stands between them at even indices, and each match, with the second mark and the secret it is, at odd ones.

    One pass marks all matches; only texts that have the marks themselves are scanned thrice.
    """
    once = f"split(regexp_replace({text}, {_text(ANY)}, {_text(f'{MARK}$1$3{SECRET_MARK}$2{MARK}')}), {_text(MARK)}, -1)"
    group = lambda k: f"regexp_extract_all({text}, {_text(ANY)}, {k})"
    found = f"zip_with({group(0)}, {group(2)}, (m, s) -> concat(IF(s = '', m, ''), {_text(SECRET_MARK)}, s))"
    apart = _let(found, lambda ms: f"slice(flatten(zip_with(split({text}, {_text(ANY)}, -1), {ms}, (gap, m) -> array(gap, coalesce(m, '')))), 1, 2 * size({ms}) + 1)")
    return f"IF({text} RLIKE {_text(f'[{MARK}{SECRET_MARK}]')}, {apart}, {once})"


def _typed(piece: str, fn) -> str:
    """``fn`` (kind, mention) of a match's piece."""
    secret = f"substring_index({piece}, {_text(SECRET_MARK)}, -1)"
    mention = f"named_struct('m', concat(substring_index({piece}, {_text(SECRET_MARK)}, 1), {secret}), 's', {secret} <> '')"
    return _let(mention, lambda x: _let(type_of(f"{x}.m", f"{x}.s"), lambda kind: fn(kind, f"{x}.m")))


def entities(text: str) -> str:
    """The distinct atoms of a text: kind, canon."""
    of = lambda p: _typed(p, lambda kind, m: f"IF({kind} IS NULL, NULL, {_let(canonical(kind, m), lambda c: atoms(kind, c))})")
    matches = f"array_distinct(filter({pieces(text)}, (p, i) -> i % 2 = 1))"
    return f"IF({hint(text)}, array_distinct(flatten(filter({_each(matches, of)}, a -> a IS NOT NULL))), NULL)"


def attempts(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The atoms whose surrogate isn't the first attempt's: entity, attempt.

    Checked are all distinct atoms of the corpus: one moves on if its surrogate is a real value,
    or that of a smaller atom, which permutations rule out. It moves to the first attempt that is
    neither a real value nor another's surrogate, and stays where ATTEMPTS give none.
    """
    found = docs.select(F.explode(F.expr(entities("text"))).alias("e")).select("e.kind", "e.canon").distinct()
    real = written(found.withColumn("made", F.expr(surrogate("kind", "canon", "0", key))), "entities")
    values = real.select("kind", "made", "canon").unionByName(real.select("kind", F.col("canon").alias("made"), F.lit(None).cast("string").alias("canon")))
    twice = values.groupBy("kind", "made").agg(F.min("canon").alias("first"), F.count("canon").alias("n"), F.count("*").alias("n_all")).where("n > 1 OR n = 1 AND n_all > 1")
    clash = real.join(twice, ["kind", "made"]).where((F.col("n_all") > F.col("n")) | (F.col("canon") != F.col("first")))
    pending = written(clash.select("kind", "canon"), "clashes")
    spark = docs.sparkSession
    placed = spark.createDataFrame([], "kind string, canon string, made string, attempt int")
    taken = real.select("kind", "made").unionByName(real.select("kind", F.col("canon").alias("made")))
    for attempt in range(1, ATTEMPTS + 1):
        if pending.isEmpty():
            break
        tried = pending.withColumn("made", F.expr(surrogate("kind", "canon", str(attempt), key)))
        alone = tried.join(tried.groupBy("kind", "made").agg(F.min("canon").alias("canon")), ["kind", "made", "canon"], "left_semi")
        free = alone.join(taken.unionByName(placed.select("kind", "made")), ["kind", "made"], "left_anti")
        placed = written(placed.unionByName(free.select("kind", "canon", "made", F.lit(attempt).alias("attempt"))), "surrogates")
        pending = written(pending.join(placed, ["kind", "canon"], "left_anti"), "clashes")
    return placed.select(F.concat_ws("\x1f", "kind", "canon").alias("entity"), "attempt")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with every entity in text replaced, and n_entities added.

    ``docs`` needs doc_id and text. Null texts stay null and have no entities; texts without
    entities stay as they are; repeated rows are treated alike, and so are rows without doc_id. An
    empty table gives an empty one. Further columns pass as they are, except one named n_entities,
    which is replaced.
    """
    later = written(attempts(docs, key), "attempts")
    docs = docs.drop("n_entities")
    if later.isEmpty():
        return _replaced(docs, None, key)
    of_doc = docs.select("doc_id", F.explode(F.expr(entities("text"))).alias("e")).select("doc_id", F.concat_ws("\x1f", "e.kind", "e.canon").alias("entity"))
    per_doc = of_doc.join(later, "entity").distinct().groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias("_later")).withColumnRenamed("doc_id", "_later_id")
    joined = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_later_id")), "left")
    return _replaced(joined, "_later", key).drop("_later", "_later_id")


def _replaced(docs: DataFrame, later: str | None, key: str) -> DataFrame:
    def attempt_of(kind: str, canon: str) -> str:
        return "0" if later is None else f"coalesce(try_element_at({later}, concat_ws('\x1f', {kind}, {canon})), 0)"

    def new(kind: str, mention: str) -> str:
        made = _let(canonical(kind, mention), lambda canon: composed(kind, canon, attempt_of, key))
        return f"IF({kind} IS NULL, {stays(mention)}, named_struct('text', {_let(made, lambda m: laid(kind, mention, m))}, 'n', 1))"

    stays = lambda t: f"named_struct('text', {t}, 'n', 0)"
    cut = _each_at(pieces("text"), lambda p, i: f"IF({i} % 2 = 0, {stays(p)}, {_typed(p, new)})")
    return (
        docs.withColumn("_pieces", F.expr(f"IF({hint('text')}, {cut}, array({stays('text')}))"))
        .withColumn("n_entities", F.expr("aggregate(_pieces, 0L, (n, x) -> n + x.n)"))
        .withColumn("text", F.expr("IF(n_entities > 0, array_join(_pieces.text, ''), text)"))
        .drop("_pieces")
    )


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(documents(spark, sf_dir)).select("doc_id", "n_entities", "text")
