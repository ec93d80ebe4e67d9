"""Whatever a pattern of personal information finds passes the gate in front of it."""

import random
import re
from re import _constants as C
from re import _parser

import pytest

from tracelake.llm import pii

PEOPLE = pii.People(["Orlin Lane"])
CATEGORIES = {C.CATEGORY_DIGIT: "0123456789", C.CATEGORY_WORD: "aZ0яЖ_", C.CATEGORY_SPACE: " \t\n", C.CATEGORY_NOT_WORD: " ,.", C.CATEGORY_NOT_SPACE: "aZ0.", C.CATEGORY_NOT_DIGIT: "aZ ."}


def example(parsed, rng, fold):
    """A text that fulfils a parsed pattern but for its look-arounds; in any case where ``fold``."""

    def cased(c):
        return rng.choice([c, c.lower(), c.upper()]) if fold else c

    def one(op, av):
        if op is C.LITERAL:
            return cased(chr(av))
        if op is C.IN:
            if av[0][0] is C.NEGATE:
                return rng.choice("aя")
            kind, x = rng.choice(av)
            return cased(chr(x) if kind is C.LITERAL else chr(rng.randint(*x)) if kind is C.RANGE else rng.choice(CATEGORIES[x]))
        if op is C.BRANCH:
            return example(rng.choice(av[1]), rng, fold)
        if op is C.SUBPATTERN:
            return example(av[3], rng, (fold or av[1] & re.I) and not av[2] & re.I)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            return "".join(example(av[2], rng, fold) for _ in range(rng.randint(av[0], min(av[1], av[0] + 4))))
        return ""  # look-arounds and anchors

    return "".join(one(op, av) for op, av in parsed)


def examples(pattern, n=4000):
    rng, parsed = random.Random(3), _parser.parse(pattern.pattern, pattern.flags)
    found = [t for t in (example(parsed, rng, bool(parsed.state.flags & re.I)) for _ in range(n)) if pattern.search(t)]
    assert len(found) > n / 50
    return found


@pytest.mark.parametrize("gate,pattern", pii._ADDRESSES)
def test_addresses(gate, pattern):
    assert [t for t in examples(pattern) if not gate.search(t)] == []


def test_keys():
    assert [t for t in examples(pii._KEYED, 20_000) if not any(k in pii._low(t) for k in pii._KEY_GATE)] == []
    assert all(any(k in pii._low(t) for k in pii._KEY_GATE) for t in ("NıE 1234567", "ſſn 666666", "NİF 123456"))


@pytest.mark.parametrize("pattern", [pii._SHAPED, pii._PHONE])
def test_digits(pattern):
    enough = [m.group() for m in map(pattern.search, examples(pattern, 20_000)) if sum(c.isdigit() for c in m.group()) >= 9]
    assert enough and [t for t in enough if not pii._DIGIT_RUN.search(t)] == []


FOUND = [
    ("at 221B Baker Street now", "at [ADDRESS] now"),
    ("at 12 Baker street.", "at [ADDRESS]."),
    ("NIE: X1234567L", "NIE: [ID_NUMBER]"),
    ("NIF:12345678", "NIF:[ID_NUMBER]"),
    ("Reisepass: C01234567", "Reisepass: [ID_NUMBER]"),
    ("030 12345 ext 1", "[PHONE]"),
    *((f"x_y {lo}эт{hi} corp.org", "[EMAIL]") for lo, hi in ("[]", "{}", "<>", "()", ("( ", " )"), ("[ ", "]"))),
    ("x_y (ЭТ) corp.org", "[EMAIL]"),
    ("это не (этот) адрес", "это не (этот) адрес"),
]


@pytest.mark.parametrize("text,want", FOUND)
def test_found_behind_gates(text, want):
    assert pii.redact(text, pii.detect(text, PEOPLE)) == want
