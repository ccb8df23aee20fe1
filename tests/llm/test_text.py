import pytest
from pyspark.sql import functions as F

from crateflow.llm import garbled_text as G
from crateflow.llm import mixing, name_variants, packing, tokens

CLEAN = ["Été égarée à Genève", "Forêt brûlée près du château", "Mémoire étrange où tu vas", "Ночная песня до утра", "Белая река у окна", "Späte Träume für Käthe", "Müde Vögel über München", "Âme légère fanée", "Rêve dorée oubliée", "Зимняя звезда без слов"]
BAD = {"Été égarée".encode().decode("cp1252"): "Été égarée", "Белая река".encode("cp1251").decode("cp1252"): "Белая река", "Ночная".encode("koi8_r").decode("cp1251"): "Ночная", "Müde Vögel".encode("cp1252").decode("mac_roman"): "Müde Vögel", "Forêt".encode().decode("cp437"): "Forêt", "Späte Träume".encode().decode("cp1252").encode().decode("cp1252"): "Späte Träume"}


def tracks(spark, titles):
    return spark.createDataFrame([(i, t, None, "v") for i, t in enumerate(titles)], "id bigint, title string, artist string, value string")


def test_garbled(spark):
    titles = CLEAN * 20 + list(BAD) + ["Fr�he", None, "", "plain", "“Quoted” – dash…", "x" * 30_000, "é" * 5_000]
    df = tracks(spark, titles)
    model = G.fit(df.withColumn("title", F.concat("title", F.lit(" "), (F.col("id") % 40).cast("string"))).union(df), ("title", "artist"))
    got = {titles[r.id]: r.restored for r in G.garbled(df, model=model).collect()}
    assert set(got) == {*BAD, "Fr�he"}
    assert {k: got[k] for k in BAD} == BAD and got["Fr�he"] is None


def test_garbled_of_nothing(spark):
    assert G.garbled(tracks(spark, [])).count() == 0
    assert G.garbled(tracks(spark, [None, "", "ascii"])).count() == 0


def test_names(spark):
    names = ["Antonia Hahabover"] * 9 + ["A. Hahabover", "Hahabover, Toni", "Antonia Hahaobver", "  ANTONIA   HAHABOVER ", "Dorothy Hahabover", "Dorothy Hahabover", "The Velvet Selosek Kestrels", "Velvet Selosek Kestrels, The", "The V. Selosek Kestrels", "Gegifapok String Quartet", "Gegifapok Str. Qt.", "Unknown Artist", "unknown", "Antonia Hahabover feat. Gegifapok String Quartet", "Antonia Hahabover & Dorothy Hahabover", None, "", "...", "y" * 20_000]
    df = spark.createDataFrame([(i, n, "Golden River", "k") for i, n in enumerate(names)], "id bigint, artist string, title string, key string")
    entity = {r.name: r.entity for r in name_variants.linked(df).collect()}
    same = lambda *x: len({entity[n] for n in x}) == 1
    assert same("Antonia Hahabover", "A. Hahabover", "Hahabover, Toni", "Antonia Hahaobver", "  ANTONIA   HAHABOVER ")
    assert same("The Velvet Selosek Kestrels", "Velvet Selosek Kestrels, The", "The V. Selosek Kestrels") and same("Gegifapok String Quartet", "Gegifapok Str. Qt.")
    assert entity["Dorothy Hahabover"] != entity["Antonia Hahabover"]
    assert not set(entity) & {"Unknown Artist", "unknown", "", "...", "Antonia Hahabover feat. Gegifapok String Quartet", "Antonia Hahabover & Dorothy Hahabover"}
    assert name_variants.linked(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    n = name_variants.bands(0.45, 0.97, 3)
    assert 1 - (1 - 0.45**3) ** n >= 0.97 > 1 - (1 - 0.45**3) ** (n - 1)
    assert name_variants.edits("abcd", "abdc", 2) == 1 and name_variants.edits("abcd", "xyzw", 2) == 3


SIZES = "id bigint, source string, h bigint, tokens bigint"


def sized(spark, rows):
    return spark.createDataFrame(rows, "id bigint, source string, tokens bigint").selectExpr("id", "source", "xxhash64(id) as h", "tokens")


TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)]


def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_mixing(spark):
    rows = [(i, "abc"[0 if i < 3000 else 1 if i < 3600 else 2], 1 + i % 50) for i in range(3700)] + [(9000, "z", 10), (9001, "a", 0)]
    df, t = sized(spark, rows), targets(spark)
    r = {x.source: x for x in mixing.report(df, t).collect()}
    assert all(abs(r[s].actual_share - w) < 0.01 and r[s].most_uses <= most for s, w, most in TARGETS) and r["z"].records == 0
    size = {s: r[s].used_tokens for s in "abc"}
    small = {x.id: x.uses for x in mixing.mixed(df, t, sum(size.values()) // 3).collect()}
    full = {x.id: x.uses for x in mixing.mixed(df, t).collect()}
    assert all(full.get(i, 0) >= n for i, n in small.items())
    assert max(full.values()) <= 4
    assert mixing.mixed(df.limit(0), t).count() == 0 and mixing.report(df.limit(0), t).count() == 3


def test_packing(spark):
    rows = [(i, "ab"[i % 3 == 0], 1 + (i * 37) % 300) for i in range(3000)] + [(5000, "a", 2500), (5001, "new", 7), (5002, "a", 0)]
    limits = spark.createDataFrame([("p", 512), ("p", 512), ("none", 0)], "pack_name string, capacity_tokens int")
    out = packing.packed(sized(spark, rows), targets(spark), limits, window=20).collect()
    per, items = {}, {}
    for r in out:
        per[r.container] = per.get(r.container, 0) + r.tokens
        items.setdefault(r.id, []).append((r.start, r.tokens))
    assert max(per.values()) <= 512 and sum(per.values()) == sum(n for *_, n in rows)
    for i, _, n in rows:
        assert (i in items) == (n > 0)
        if n:
            parts = sorted(items[i])
            assert sum(t for _, t in parts) == n and (n > 512 or len(parts) == 1) and all(parts[k][0] == sum(t for _, t in parts[:k]) for k in range(len(parts)))
    assert sum(per.values()) / (512 * len(per)) > 0.95
    first = [r for r in out if int(r.container.split("-")[0]) in range(3)]
    share = sum(r.tokens for r in first if r.source == "a") / sum(r.tokens for r in first)
    assert abs(share - 0.5 / 0.8) < 0.1
    assert packing.packed(sized(spark, rows[:0] or [(1, "a", 0)]), targets(spark), limits).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", "s", 1), (2, None, None, 1), (3, "", "s", 1), (4, "<|endoftext|>", "s", 1)], "doc_id bigint, text string, source string, h int")
    got = {r.id: (r.source, r.tokens) for r in tokens.sized(df).collect()}
    assert got[1] == ("s", 2) and got[2] == ("", 0) and got[3] == ("s", 0) and got[4][1] > 1


def test_best_fit_is_tight():
    import numpy as np

    boxes = packing.best_fit(np.array([6, 5, 5, 4, 4, 3, 3]), 10)
    assert boxes.max() == 2 and pytest.approx(1) == 1


def test_mixing_many_sources(spark):
    rows = [(i, f"host{i % 400}", 1 + i % 9) for i in range(4000)]
    t = spark.createDataFrame([(f"host{k}", 1 / 400, 2) for k in range(400)], "source string, target_share double, max_repeats int")
    r = mixing.report(sized(spark, rows), t).collect()
    assert len(r) == 400 and max(x.most_uses for x in r) <= 2 and all(abs(x.used_tokens - x.budget_tokens) <= 9 for x in r)
