"""Stuffed pages: what repeats unnaturally, lists links or lists foreign nouns, and what a house says itself."""

import numpy as np
import pytest

from crateflow.llm import stuffed_pages as S

SCHEMA = "doc_id bigint, text string, agenda_item string, speaker string, share int, id string, t int, marks string"
PROSE = ["The minister has failed to explain the cost of the new survey before the recess, and the House would like to know why.", "It is plain that the opposition has never said what the harbour levy would cost the town in the end."]
FORMULAS = ["I remind members to address the Chair.", "La parole est au rapporteur.", "Division off. Lock the doors."]
HOUSE = [
    *(f"{f} " * 20 for f in FORMULAS),
    "\n".join(f"{i}. Harbour Levy Bill (continued)" for i in range(9)),
    "\n".join(f"Petition {i}: Harbour Levy Bill, presented by Mr. Vidozo; {i}7 signatures." for i in range(12)),
    " ".join(f"Never again: the minister has failed to explain the cost of the survey before the {x}." for x in ("recess", "town", "end", "House", "levy")),
    " ".join(f"It is plain that the opposition has never said what it would cost (see www.a{i}.example/p/{i})." for i in range(6)),
    PROSE[0] + " " + "car insurance " * 2,
]
SPAM = [
    "car insurance " * 30,
    "\n".join(f"https://a{i}.example/p/{i}" for i in range(20)),
    "#cheapboots #bestboots #buyboots #saleboots #bootsnearme #outletboots",
    "\n".join(f"Login boots\nSitemap hotel deals\nShop Vidozo {i}" for i in range(9)),
    "ch3ap b00ts b3st b00ts s.a.l.e.b.o.o.t.s buy b00ts " * 4,
    "\n".join(f'<a href="https://a{i}.example/x">sunglasses top rated</a>' for i in range(6)),
    "<br>".join(f'<a href="a{i}.shop.example/">{x}</a>' for i, x in enumerate(("abri de jardin pas cher", "bottes promo", "coque avis", "bottes pas cher", "abri de jardin"))),
    "abri de jardin. Abri de jardin. ABRI DE JARDIN. " * 20,
    "Hon. Vidozo: ABRI DE JARDIN abri de jardin " * 30,
    "[boots](https://a.example/p/1) click here\n\n[hotel deals](b.example/) >>>\n\n[boots](www.c.example/q) online",
    "\n".join(f"Harbour Levy Bill 200{i} video https://h{i}.example/x" for i in range(8)),
    "Looking for cheap boots? Cheap boots from the cheap boots store. Our cheap boots are the cheap boots for everyone who wants cheap boots. " * 3,
    " | ".join(f"Harbour Levy Bill 200{i} full text h{i}.example" for i in range(8)) + "\n" + PROSE[0],
    "cheap boots hotel deals",
]
NOTHING = [None, "", "  ", "\n\t", "12 34", "House"]


def corpus(spark):
    texts = PROSE * 30 + FORMULAS * 12 + NOTHING + HOUSE + SPAM
    rows = [(i, t, "Harbour Levy Bill", "Mr. Vidozo", 1, "x", 2, "y") for i, t in enumerate(texts)]
    first = len(texts) - len(SPAM)
    return spark.createDataFrame(rows, SCHEMA), {first + i for i in range(len(SPAM))}, texts


@pytest.mark.parametrize("most", [S.MOST_WORDS, 0])
def test_pages_are_told_from_the_house_by_broadcast_and_by_join(spark, most):
    df, wanted, texts = corpus(spark)
    got = {r.doc_id for r in S.stuffed_pages(df.union(df.where("doc_id > 62")), most=most).collect()}
    assert [texts[i] for i in sorted(got ^ wanted)] == []


def test_stuffed_pages_of_nothing_and_of_nulls(spark):
    df = corpus(spark)[0]
    assert S.stuffed_pages(df.limit(0)).count() == 0
    assert S.stuffed_pages(df.selectExpr("doc_id", "cast(null as string) text", "cast(null as string) agenda_item", "cast(null as string) speaker")).count() == 0


def test_a_page_of_a_few_keywords_is_reported(spark):
    prose = "The committee has heard the minister on the budget and we are of the view that it should be adopted."
    rows = [(i, prose, "Budget", "Weber") for i in range(20)]
    rows += [(50, "cheap replica watches", None, None), (51, "leather handbag outlet deals sale", None, None), (52, "The budget, adopted.", None, None), (53, "Weber, minister.", None, None), (54, " ", None, None)]
    got = {r.doc_id for r in S.stuffed_pages(spark.createDataFrame(rows, "doc_id bigint, text string, agenda_item string, speaker string")).collect()}
    assert got == {50, 51}


def regular(text, lags=S.LAGS):
    return S.Page(text, S.Tokens()).regular(lags).mean()


def test_recurrence_gaps_and_autocorrelation():
    rng = np.random.default_rng(1)
    plain = " ".join(f"w{x}x" for x in rng.integers(0, 4000, 2000))
    assert regular(plain) < 0.02
    assert regular("boots " * 40) == 1.0 and regular("cheap boots hotel deals " * 40) == 1.0
    assert regular("a b c d e f g h k m n o p q r s t v w x z aa bb cc dd ee ff gg hh jj " * 9) == 0.0
    # regular in parts: only those
    mixed = plain + " " + "boots sale " * 100
    assert 0.07 < regular(mixed) < 0.12


def test_long_texts_are_read_whole():
    tokens = S.Tokens()
    head = "\n".join(PROSE * 2000)
    tail = "\n".join(f"https://a{i}.example/p/{i}" for i in range(30_000))
    assert S.stuffed_share(head + "\n" + tail, tokens, lambda t: False) > 0.5
    assert S.stuffed_share(head, tokens, lambda t: False) == 0.0
    assert S.stuffed_share("long word " * 40_000, tokens, lambda t: False) == 1.0


def test_words_undo_obfuscation():
    assert S.words("ch3ap") == ["cheap"] and S.words("s.a.l.e.b.o.o.t.s") == ["saleboots"] and S.words("l'article") == ["l", "article"] and S.words("1,234 (5)") == []
    assert S.is_link("https://x.example/a?b=1") and S.is_link("(www.x.test)") and S.is_link("x-y.shop.example/p/1") and not S.is_link("c.h.e.a.p") and not S.is_link("Nr.") and not S.is_link("3.5")
