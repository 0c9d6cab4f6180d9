"""Placeholders and runs excuse windows, not whole strings."""

import random
import re
import string

import pytest

from hardwood.llm import secrets
from test_secrets import entropy

TOKEN = "wJa7rXUtn9FEMIbK7MDENGz1bPxRfiCY3Qm8Kp2Z"


def want(text):
    """first and end of the windows of high entropy without a placeholder or run."""
    need = next(b for p, b in secrets.CLASSES.values() if re.search(p, text))
    hot = [i for i in range(len(text) - 19) if entropy(text[i : i + 20]) >= need - 1e-12]
    hot = [i for i in hot if not re.search(secrets.PLACEHOLDER + r"|(.)\1{7}", text[i : i + 20])]
    return f"entropy:{hot[0]}:{hot[-1] + 20}" if hot else ""


@pytest.mark.parametrize("text, found", [
    ("b3Blb" + "A" * 9 + TOKEN, True), (TOKEN + "=" * 8 + TOKEN[::-1], True), (TOKEN[:12] + "xxxx" + TOKEN, True), (TOKEN + "/dummy/" + TOKEN, True),
    ("your_example_api_key_goes_here9", False), ("sk_live_9xxxxxxxxxxxxxxxxxxxxxxx", False), (TOKEN[:12] + "EXAMPLE" + TOKEN[12:20], False),
])
def test_tokens_beside_runs_and_placeholders(make, text, found):
    got = secrets.scan(make([(1, text)])).first()
    assert got.spans == want(text) and bool(got.spans) == found


def test_random_strings(make):
    r, rows = random.Random(7), []
    odd = ["example", "XXXX", "xxxxxx", "dummy", "A" * 7, "A" * 8, "A" * 12, "=" * 9, "changeme", ""]
    for i in range(300):
        parts = ["".join(r.choices(string.ascii_letters[i % 20 :] + "0189", k=r.randrange(25))) + r.choice(odd) for _ in range(r.randrange(1, 5))]
        rows.append((i, "9" + "".join(parts) + "z9z9z"))
    rows = [x for x in rows if len(x[1]) >= 20 and not re.search(r"[0-9a-f]{24}|AKIA", x[1])]
    got = {x.doc_id: x.spans for x in secrets.scan(make(rows)).collect()}
    assert got == {i: "" if re.search(secrets.ALLOWED, t) else want(t) for i, t in rows}
    assert sum(map(bool, got.values())) > 20


def test_many_separators_in_a_row(make):
    rows = [(1, "A" + "/" * 5_000 + "!"), (2, "A" + "-a=_" * 5_000 + "12345"), (3, "A" + "/-" * 40 + "12345")]
    assert secrets.scan(make(rows)).count() == 3
    assert re.search(secrets.ALLOWED, "some-long--words_=joined/1234") and not re.search(secrets.ALLOWED, "some-long-words12345")
