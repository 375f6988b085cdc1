"""Part quotations of benchmark items, by length: recall is whole from PIECE + STEP - 1 characters on."""

import random

import pytest

pytest.importorskip("motionlake.llm")

from motionlake.llm import decontaminate as D  # noqa: E402


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "in", "ou", "re", "an", "st", "le"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.mark.parametrize("length,least", [(D.PIECE + D.STEP - 1, 1.0), (D.PIECE + 4, 0.9), (160, 1.0), (220, 1.0)])
def test_recall_by_length(length, least):
    rng = random.Random(length)
    items = [(k, D.normal(prose(rng, rng.randrange(25, 70)))) for k in range(60)]
    searched = D.Items(items, D.EDIT_SHARE)
    found = asked = 0
    for i, text in items * 2:
        if len(text) < length:
            continue
        at = rng.randrange(len(text) - length + 1)
        doc = f"{D.normal(prose(rng, 40))} {text[at : at + length]} {D.normal(prose(rng, 40))}"
        asked += 1
        found += any(r[0] == i for r in searched.regions(doc))
    assert asked > 10 and found / asked >= least
    assert not any(searched.regions(D.normal(prose(rng, 400))) for _ in range(5))


def test_141_characters_of_an_item_of_159():
    rng = random.Random(9)
    item = D.normal(prose(rng, 60))[:159].strip()
    searched = D.Items([(1, item)], D.EDIT_SHARE)
    (r,) = searched.regions("aa bb cc dd " + item[9:150] + " ee ff gg hh")
    assert r[0] == 1 and r[2] - r[1] >= D.PIECE
