"""Planted strings in sensitive context: random ones are novel, identifiers, paths and repeated values aren't."""

import random
import string

from cityloom.llm.secrets import IDENTIFIERS, Novelty, base_spans, novel_spans

FRAMES = ["Authorization: Bearer {}\n", "private key = {} # rotate monthly\n", "the signature was {} as sent\n", "credential {} for the worker\n"]


def found(text: str, start: int, end: int) -> bool:
    return any(s < end and start < e for s, _, e in novel_spans(text, base_spans(text), Novelty()))


def placed(value: str, rng: random.Random, before: str = "") -> tuple[str, int, int]:
    words = lambda n: " ".join(rng.choices(IDENTIFIERS.split(), k=n))
    head, tail = rng.choice(FRAMES).split("{}")
    lead = words(30) + " " + before + "\n" + head
    return lead + value + tail + words(30), len(lead), len(lead) + len(value)


def test_random_strings_are_novel():
    rng = random.Random(1)
    signs = string.ascii_letters + string.digits
    values = ["a1Z" + "".join(rng.choices(signs, k=rng.randint(17, 45))) for _ in range(300)]
    assert sum(found(*placed(v, rng)) for v in values) >= 0.98 * len(values)


def test_long_random_strings_are_novel():
    rng = random.Random(3)
    for signs in ("0123456789ABCDEF", string.ascii_letters + string.digits + "+/"):
        values = ["A1" + "".join(rng.choices(signs, k=rng.randint(64, 200))) for _ in range(100)]
        held = [placed(v, rng) for v in values]
        # sixteen digits in a row are a base span, beside which nothing is added
        assert all(found(t, a, b) or any(s < b and a < e for s, _, e in base_spans(t)) for t, a, b in held)


def test_known_strings_are_not():
    rng = random.Random(2)
    known = [w for w in IDENTIFIERS.split() if w.isalpha() and w.islower() and 6 <= len(w) <= 14 and len(set(w)) > 1]
    names = ["_".join(rng.sample(known, 3)) + str(rng.randint(1, 9)) for _ in range(150)]
    paths = ["/" + "/".join(rng.sample(known, 4)) + "/v2" for _ in range(150)]
    # some short names stay as large as random strings (README gives the rates)
    assert sum(found(*placed(v, rng)) for v in names) <= 0.25 * 150 and sum(found(*placed(v, rng)) for v in paths) <= 0.1 * 150
    value = "a1Z" + "".join(rng.choices(string.ascii_letters + string.digits, k=30))
    assert not found(*placed(value, rng, before=value))
