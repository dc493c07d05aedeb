"""Surrogates: distinct by construction, alike for all spellings, and of their type; against values planted here."""

import ipaddress
import random
from itertools import product
from string import ascii_lowercase

import helpers
import pytest

from tessella.llm import surrogates

RANGES = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10")]
SCHEMA = "doc_id long, text string"


def made(spark, texts, **kw):
    return [r.text for r in surrogates.replace(spark.createDataFrame(list(enumerate(texts)), SCHEMA), **kw).orderBy("doc_id").collect()]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_a_full_space_is_permuted(spark, n):
    """All local parts of n letters of one host: no free value is left, and none may stay or meet another."""
    locals_ = ["".join(x) for x in product(ascii_lowercase, repeat=n)]
    got = made(spark, [f"{x}@full.example.com" for x in locals_])
    hosts = {g.split("@")[1] for g in got}
    assert len(hosts) == 1 and hosts != {"full.example.com"}
    assert sorted(g.split("@")[0] for g in got) == locals_
    assert all(g.split("@")[0] != x for g, x in zip(got, locals_, strict=True))


def test_hosts_stay_distinct(spark):
    hosts = [f"{a}{b}.org" for a, b in product(ascii_lowercase, repeat=2)]
    got = [g.split("@")[1] for g in made(spark, [f"me@{h}" for h in hosts])]
    assert len(set(got)) == len(hosts) and all(g != h and g.endswith(".org") for g, h in zip(got, hosts, strict=True))


def test_spellings_of_a_name_corefer(spark):
    got = made(spark, ["Mr John Smith", "Mr Smith", "Mr. Smith", "Dr Smith", "Mrs Smith-Jones", "Mr Jones", "Mr SMITH", "Mr J. Smith", "Frau Dr. Smith", "then Mr Smith's hat", "Dr Ann John"])
    smith, john = got[1].split()[1], got[0].split()[1]
    assert len(smith) == 5 and smith not in ("Smith", john)
    assert got[0] == f"Mr {john} {smith}" and got[2:4] == [f"Mr. {smith}", f"Dr {smith}"]
    assert got[4] == f"Mrs {smith}-{got[5].split()[1]}" and got[6] == f"Mr {smith.upper()}"
    assert got[7].startswith("Mr ") and got[7].endswith(f". {smith}") and got[7][3] != "J"
    assert got[8] == f"Frau Dr. {smith}" and got[9] == f"then Mr {smith}'s hat" and got[10].endswith(f" {john}")


def test_names_keep_length_script_and_gender(spark):
    texts = ["Ms O'Brien", "Mr Li", "Mr McDonald", "Г-жа Иванова", "Mme Hélène", "Sra María", "Dr Παπαδοπουλου"]
    for text, got in zip(texts, made(spark, texts), strict=True):
        assert len(got) == len(text) and got.split()[0] == text.split()[0] and got != text
        name, new = text.split()[1], got.split()[1]
        assert [c.isupper() for c in name] == [c.isupper() for c in new]
        assert all(("А" <= a <= "ӿ") == ("А" <= b <= "ӿ") and ("Ͱ" <= a <= "Ͽ") == ("Ͱ" <= b <= "Ͽ") for a, b in zip(name, new, strict=True))
        if name[-1] in "aа":
            assert new[-1] == name[-1]


def test_addresses_keep_their_range(spark):
    rng = random.Random(61)
    ips = ["10.0.0.1", "127.0.0.1", "192.168.0.7", "172.16.3.4", "172.31.9.9", "172.32.9.9", "169.254.1.2", "100.64.0.9", "100.128.0.9", "192.169.1.1", "224.0.0.1", "0.0.0.0", "255.255.255.255"]
    ips += [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(300)]
    ips = sorted(set(ips))
    got = made(spark, [f"at {x} ok" for x in ips])
    new = [g.split()[1] for g in got]
    assert len(set(new)) == len(ips)
    for a, b in zip(ips, new, strict=True):
        x, y = ipaddress.ip_address(a), ipaddress.ip_address(b)
        assert a != b and x.is_loopback == y.is_loopback and x.is_link_local == y.is_link_local and x.is_multicast == y.is_multicast, (a, b)
        own = [n for n in RANGES if x in n or y in n]
        assert all(x in n and y in n for n in own), (a, b)


def test_numbers_that_only_look_like_cards_stay(spark):
    rng = random.Random(62)
    numbers = ["4111111111111111", "4111111111111112", "5500 0000 0000 0004", "378282246310005", "2675131828899234", "1088042642134698"] + [str(rng.randrange(10**15, 10**16)) for _ in range(200)]
    got = made(spark, [f"is {x} so" for x in numbers])
    for x, g in zip(numbers, got, strict=True):
        assert (g == f"is {x} so") != helpers.is_entity(x), x
        if helpers.is_entity(x):
            assert helpers.is_entity(g[3:-3]) and g[3:7] == x[:4]
    assert made(spark, ["password=4111111111111112"])[0] != "password=4111111111111112"


def test_phones_of_one_plan_corefer(spark):
    got = made(spark, ["+1 (826) 555-4081", "(826) 555-4081", "+18265554081", "826.555.4081", "+49 30 1234 5678"])
    assert len({"".join(c for c in g if c.isdigit())[-10:] for g in got[:4]}) == 1 and got[4].startswith("+49 ") and len(got[4]) == 16


def test_marks_in_a_text_change_nothing(spark):
    plain = "to ann@x.org, token=abcdefgh1 and 8.8.8.8"
    got = made(spark, [plain, f"\x01{plain}\x02\x01"])
    assert got[1] == f"\x01{got[0]}\x02\x01" and got[0] != plain


def test_permutations_are_one_to_one(spark):
    """Every array of small sizes, counted out."""
    for sizes in ([2], [26], [2, 3], [1, 4, 1, 3], [5, 2, 2, 3]):
        rows = [(list(v),) for v in product(*map(range, sizes))]
        df = spark.createDataFrame(rows, "v array<int>")
        got = df.selectExpr("v", f"{surrogates.permuted('v', 'array(' + ', '.join(map(str, sizes)) + ')', repr('label'))} AS p").collect()
        assert len({tuple(r.p) for r in got}) == len(rows) and all(r.p != r.v and all(0 <= x < n for x, n in zip(r.p, sizes, strict=True)) for r in got), sizes


def test_clashes_with_real_values_move_on(spark):
    """An entity whose surrogate is another's real value takes a further attempt; the other's own surrogate is no one else's."""
    first = made(spark, ["ssn 123-45-6789 x"])[0].split()[1]
    got = [g.split()[1] for g in made(spark, ["ssn 123-45-6789 x", f"ssn {first} x"])]
    assert first not in got and len(set(got)) == 2


def test_very_long_mentions(spark):
    text = "token=" + "aB3" * 10_000
    got = made(spark, [text, "x" * 50_000 + "@example.com"])
    assert len(got[0]) == len(text) and got[0] != text and len(got[1]) == 50_012
