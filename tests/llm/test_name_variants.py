"""Names of common words only: they are linked by how rare the words are together, at any size."""

import numpy as np
import pytest

from crateflow.llm import name_variants


def word(rng, first="bdfklprstvz", length=4):
    return "".join(rng.choice(list(first if k == 0 else "bdfgklmnprstvz")) + rng.choice(list("aeiou")) for k in range(length))


@pytest.mark.parametrize("size", [1, 8])
def test_the_same_shares_link_at_every_size(spark, size):
    rng = np.random.default_rng(4)
    names = {f"Michael {word(rng).title()}" for _ in range(12 * size)} | {f"{word(rng).title()} Gegifapok" for _ in range(12 * size)} | {f"{word(rng).title()} {word(rng).title()}" for _ in range(450 * size)}
    names |= {f"{word(rng).title()} {word(rng).title()} official" for _ in range(10)}
    asked = ["Michael Gegifapok", "M. Gegifapok", "Michael Gegifapok official"]
    rows = [(n, None) for n in sorted(names)] + [(a, None) for a in asked] + [(asked[0], None)] * 20
    got = {r.name: r.entity for r in name_variants.linked(spark.createDataFrame(rows, "artist string, title string")).collect()}
    assert len({got[a] for a in asked}) == 1
    assert len(set(got.values())) > 0.9 * len(names)
