"""Decontamination against brute force: every place, every item length, names, numbers, units, shared windows."""

import random
import re

from veldmark.llm import decontamination as d

from .helpers import odd_texts, passage, table, words

UNIT = re.compile(rf"(?i:{d.UNITS})\Z")


def marked(text):
    """(template token, value) of each token."""
    out = []
    for w in words((text or "").translate({ord(c): None for c in d.PUNCTUATION})):
        if w[0].isupper() and w[1:2].islower():
            t = d.NAME
        elif re.match(r"[^\w]{0,3}[0-9]", w):
            t = d.NUMBER
        elif out and out[-1][0] == d.NUMBER and UNIT.match(w):
            t = d.UNIT
        else:
            t = w.lower()
        out.append((t, w.lower()))
    return out


def brute(texts, items):
    """(doc, item): n_windows, exact and consistent, over all places of all pairs."""
    out = {}
    for i, a in enumerate(map(marked, items)):
        width = min(d.WINDOW, len(a))
        said = {q for q in range(len(a) - width + 1) if len({t for t, _ in a[q : q + width] if d.MARK not in t}) >= d.LEAST_WORDS}
        told = {q for q in range(len(a) - width + 1) if len({v for _, v in a[q : q + width]}) >= d.LEAST_WORDS}
        for k, b in enumerate(map(marked, texts)):
            total, exact, consistent = 0, False, False
            if not {v for _, v in a} & {v for _, v in b}:
                continue
            if a and not said and not told:
                if [v for _, v in a] == [v for _, v in b]:
                    out[k, i] = (1, True, True)
                continue
            for shift in range(-len(a) + 1, len(b)) if a else ():
                at = [x for x in range(len(a)) if 0 <= x + shift < len(b)]
                same_t = {x for x in at if a[x][0] == b[x + shift][0]}
                same_v = {x for x in at if a[x][1] == b[x + shift][1]}
                run = []
                for x in [*at, None]:
                    if x is not None and x in same_t | same_v and (not run or run[-1] == x - 1):
                        run.append(x)
                        continue
                    full = lambda q, s: set(range(q, q + width)) <= set(run) & s
                    value = {q for q in told if full(q, same_v)}
                    found = {q for q in said if full(q, same_t)} | value
                    if found:
                        pairs = {(a[y][1], b[y + shift][1]) for y in run if d.MARK in a[y][0]}
                        good = len(pairs) == len({v for v, _ in pairs})
                        total, consistent = total + len(found), consistent or good
                        exact = exact or all(y in same_v for y in run) or (not good and bool(value))
                    run = [x] if x is not None and x in same_t | same_v else []
            if total:
                out[k, i] = (total, exact, consistent)
    return out


def found(spark, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_windows, r.exact, r.consistent) for r in d.leaks(table(spark, texts), bench, inconsistent=True).collect()}


def test_every_length_at_every_place(spark):
    items = [" ".join(f"i{n}w{k}" for k in range(n)) for n in range(1, 31)]
    texts = []
    for n, item in enumerate(items, 1):
        for before in range(8):
            texts.append(" ".join([f"b{k}" for k in range(before)] + [item] + ["c"] * (before % 3)))
        if n > 8:
            texts.append(" ".join(["b", *item.split()[1:9], "c"]))
            texts.append(" ".join(["b", *item.split()[1:8], "c"]))
    got = found(spark, texts, items)
    assert got == brute(texts, items)
    assert {i for _, i in got} == set(range(30))


def test_other_parameters(spark):
    walk = "Sara walks 3 km to the old school every single day"
    items = [
        walk, "What is the capital of France?", "12 + 15 = 27", "Tom has 5 apples", "yes", "Why?", "ha ha ha ha ha ha ha ha ha ha", "Add 3 plums to 3 pears and give 3 more to the man by the well",
        "Der Mann aus Berlin kauft 4 Kilo Obst und 2 Liter Milch am Markt", None, "", " .!? ",
    ]
    texts = [
        walk, f"well {walk}", walk.replace("Sara", "Tom").replace("3 km", "5 miles"), f"once more: {walk.replace('Sara', 'Ann').replace('3', '44')} again", walk.lower(), walk.upper(), "So what is the capital of France? I asked.", "what is the capital of Spain", "WHAT IS THE CAPITAL OF FRANCE",
        "then 12 + 15 = 27 holds", "12 + 16 = 28", "Ann has 7 apples", "we know Ann has 7 apples now", "yes", "yes indeed", "Why", "ha ha ha ha ha ha ha ha ha ha", "ha ha ha ha ha ha ha ha ha",
        "Add 4 plums to 4 pears and give 4 more to the man by the well", "Add 4 plums to 5 pears and give 6 more to the man by the well", "Add 4 plums to 3 pears and give 3 more to the man by the well", "der mann aus berlin kauft 4 kilo obst und 2 liter milch am markt",
        "Der Mann aus Hamburg kauft 7 Kilo Obst und 9 Liter Milch am Markt", "nothing of the kind", *odd_texts(),
    ]
    got = found(spark, texts, items)
    assert got == brute(texts, items)
    assert {k for k, i in got if i == 0} == {0, 1, 2, 3, 4, 5}
    assert got[2, 0][1:] == (False, True) and got[4, 0][1] and got[18, 7][1:] == (False, True) and got[19, 7][1:] == (False, False) and got[20, 7][2] is False
    assert (14, 4) not in got and (13, 4) in got and (17, 6) not in got


def test_random_texts(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "a", "of", "to", "in", "Tom", "Ann", "Rome", "7", "12", "$3", "km", "kg", "Old", "old", "man", "x.y", "—"])
    items = [" ".join(word() for _ in range(rng.randint(3, 25))) for _ in range(12)]
    texts = []
    for _ in range(60):
        cut = rng.choice(items).split()
        a = rng.randrange(len(cut))
        piece = cut[a : a + rng.randint(1, 20)]
        if piece and rng.random() < 0.5:
            piece[rng.randrange(len(piece))] = word()
        texts.append(" ".join([word() for _ in range(rng.randint(0, 9))] + piece + [word() for _ in range(rng.randint(0, 9))]))
    want, got = brute(texts, items), found(spark, texts, items)
    assert got.items() <= want.items()
    # a pair that isn't reported has its windows owned by an item with a smaller id, which is
    for k, i in set(want) - set(got):
        assert any(j < i for kk, j in got if kk == k)


def test_shared_windows_cost_each_document_once(spark):
    head = "answer the next question with one single letter please"
    items = [f"{head} {passage(300 + i, 12)}" for i in range(40)]
    texts = [f"{head} {passage(400 + i, 30)}" for i in range(20)] + [items[17], f"x {passage(325, 12)} y"]
    got = found(spark, texts, items)
    assert {k: i for k, i in got if k < 20} == dict.fromkeys(range(20), 0)
    assert sorted(i for k, i in got if k == 20) == [0, 17] and [i for k, i in got if k == 21] == [25]
    bench = spark.createDataFrame([*enumerate(items), (3, items[3]), (99, items[3]), (None, items[3])], "item_id long, text string")
    known = d.representatives(bench).collect()
    assert {r.representative for r in known if r.item_id == 17} == {0, 17} and {r.representative for r in known if r.item_id in (99, None)} == {0, 3}


def test_equal_rows_and_clashing_columns(spark):
    item = passage(1, 12)
    docs = table(spark, [item, item, None]).unionByName(table(spark, [item, "", passage(2, 9)]))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string")
    for c in ("k1", "k2", "m", "keys", "item", "laid", "item_id"):
        docs = docs.selectExpr("*", f"'x' as {c}")
        bench = bench.selectExpr("*", f"'x' as {c}") if c != "item_id" else bench
    rows = d.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.n_windows, r.exact) for r in rows) == [(0, 1, 5, True), (1, 1, 5, True)]
    assert sorted(((r.doc_id, r.text) for r in d.remove_leaks(docs, bench).collect()), key=str) == sorted([(1, ""), (2, None), (2, passage(2, 9))], key=str)


def test_very_long_item_in_a_very_long_text(spark):
    item = passage(7, 3000)
    got = found(spark, [f"{passage(8, 20_000)} {item} {passage(9, 500)}", f"{item} {item}"], [item])
    assert got == {(0, 0): (2993, True, True), (1, 0): (5986, True, True)}


def test_every_item_is_found_inside_text_where_one_word_is_enough(spark):
    rng = random.Random(11)
    items = [(i, " ".join(f"t{rng.randrange(99_999)}x" for _ in range(i))) for i in range(1, 31)] + [(31, "Who wrote Hamlet?"), (32, "Explain photosynthesis briefly."), (33, "2 + 2")]
    docs = [(i, f"some words before {t} and some after it") for i, t in items] + [(99, "nothing of all that here")]
    given = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.leaks(*given, least_words=1).where("exact").collect()}
    assert got == {(i, i) for i, _ in items}
    usual = {(r.doc_id, r.item_id) for r in d.leaks(*given).where("exact").collect()}
    assert usual == {(i, i) for i in range(4, 31)}
