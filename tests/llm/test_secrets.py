"""Random strings that have no digit, or lie beside a base span."""

import random
import string

from repograph.llm import secrets


def test_letter_only_keys_are_found():
    rng, model = random.Random(3), secrets.default_model()
    keys = ["".join(rng.choices(string.ascii_letters, k=24)) for _ in range(200)]
    assert sum(secrets.find(f"see {k} here", model)[1] == [("markov", 4, 28)] for k in keys) >= 190
    ordinary = [s for s, label in secrets.labelled_samples(2000, seed=4242) if not label]
    assert not any(k == "markov" for s in ordinary for k, _, _ in secrets.find(s, model)[1])


def test_tail_of_a_hex_run_is_found():
    head, tail = "deadbeef" * 3, "_Qx7ZpLw9TkVb3RmYc8HdNf2"
    base, spans = secrets.find(f"{head}{tail} end", secrets.default_model())
    assert base == [("hex", 0, 24)] and spans == [("hex", 0, 24), ("markov", 24, 24 + len(tail))]
