"""Names that share a band but can't be similar are told apart before they are scored."""

import numpy as np

from crateflow.llm import name_variants


def spelled(rng, base):
    """Typos, initials, nicknames, abbreviations and words left out."""
    first, last = base
    kind = rng.integers(0, 9)
    k = int(rng.integers(0, len(last)))
    return [
        [first, last[:k] + "x" + last[k + 1 :]], [first, last[:k] + last[k + 1 :]], [first[0] + ".", last], [last[:3] + ".", first], [first, last, "band"],
        [name_variants.NICKNAMES.get(first, first).split()[0], last], [first + last], ["x" + last[1:], first], [first[:k] + last[k:], last],
    ][kind]


def test_no_pair_that_scores_is_dropped_and_most_others_are(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(4))
    base = [(str(rng.choice(["michael", "william", "margaret", "jose", word()])), word()) for _ in range(60)]
    found = [list(b) for b in base] + [spelled(rng, b) for b in base for _ in range(4)]
    counts = np.full(name_variants.SLOTS, 3, np.int64)
    counts[name_variants.slot("band")] = 50
    rows = [(i, [name_variants.code(t.rstrip(".")) for t in f], name_variants.whole(f)) for i, f in enumerate(found)]
    df = spark.createDataFrame(rows, "id int, codes array<bigint>, whole bigint")
    got = {(r.a, r.b) for r in df.alias("x").join(df.alias("y")).where("x.id < y.id").where(name_variants.possible("x", "y")).selectExpr("x.id as a", "y.id as b").collect()}
    linked = {(i, j) for i in range(len(found)) for j in range(i + 1, len(found)) if name_variants.score(found[i], found[j], counts, 20_000) > 0}
    assert len(linked) > 300 and linked <= got
    assert len(got) < 0.2 * len(found) * (len(found) - 1) / 2
