"""Operators against brute force on small tables with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldmark.llm import decontamination, jaccard_join, preference_format, quality_classifier, quality_rules, repeats, secret_scan, source_mixing, storage, substring_dedup, token_counts, warc_archive
from veldmark.llm.storage import Workspace

from .helpers import SCHEMA, odd_texts, passage, table, words


def near_copies(seed=5):
    rng = random.Random(seed)
    out = []
    for g in range(6):
        base = passage(50 + g, rng.choice([6, 9, 14, 40, 120])).split()
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            out.append(" ".join(w))
    hot = passage(99, 60)
    out += [f"{hot} {passage(200 + i, 12 + i % 9)}" for i in range(25)]
    return out


def test_substring_dedup(spark):
    texts = odd_texts() + near_copies()
    got = {r.doc_id: r for r in substring_dedup.remove_repeated_windows(table(spark, texts)).collect()}
    count = collections.Counter(tuple(w[i : i + 35]) for w in map(words, texts) for i in range(len(w) - 34))
    for d, t in enumerate(texts):
        w = words(t)
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert got[d].kept_text == (kept if gone else None)


def test_anchor_occurrences_bound_window_counts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 4, 400).astype(np.uint64)  # few words: many windows repeat
    from veldmark.llm.hashing import mix

    h = mix(h)
    at, g = substring_dedup._anchors(h, np.array([0, 400]), 35)
    anchors = collections.Counter(g[list({int(a) for a in at if a >= 0})].tolist())
    windows = collections.defaultdict(list)
    for i in range(366):
        windows[h[i : i + 35].tobytes()].append(i)
    for starts in windows.values():
        assert anchors[int(g[at[starts[0]]])] >= len(starts)


def test_count_min_never_underestimates():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 5000, 4000).astype(np.uint32)
    truth = collections.Counter(keys.tolist())
    flag = repeats.seen_twice(keys, None, len(keys), False)
    assert all(f for k, f in zip(keys.tolist(), flag, strict=True) if truth[k] > 1)


def brute_components(texts, k=5, percent=75):
    fold = {i: i + 32 for i in range(65, 91)}
    sets = []
    for t in texts:
        w = words((t or "").translate(fold))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_join(spark):
    texts = odd_texts() + near_copies() + ["THE Same five words here", "the same five words here", "a b c d", "A B C D", "a b c"]
    linked = jaccard_join.link_documents(table(spark, texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.salted_least(linked, F.col("doc_id"), "component_id").collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    kept = sorted(r.doc_id for r in jaccard_join.keep_one_of_each(table(spark, texts)).collect())
    want = brute_components(texts)
    assert kept == [i for i, (_, c) in enumerate(want) if c == i]


@pytest.mark.parametrize("boundary", [1, 30, 10**6])
def test_jaccard_join_with_any_boundary_and_lists_in_pieces(spark, boundary, monkeypatch):
    monkeypatch.setattr(storage, "HOT_ROWS", 3)
    rng = random.Random(boundary)
    base = passage(17, 70).split()
    texts = near_copies(9) + ["a b c d", "A B C D", "a b c", passage(31, 9), passage(31, 9) + " x"]
    for _ in range(30):  # many near copies of one text, some of which link through others only
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(999)}"
        texts.append(" ".join(w))
    linked = jaccard_join.link_documents(table(spark, texts), boundary=boundary)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.salted_least(linked, F.col("doc_id"), "component_id").collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_boundary_by_cost(spark):
    rows = [(8, 0)] * 50 + [(12, 1)] * 5 + [(900, 20)] * 3 + [(5000, 0)] * 1000
    df = spark.createDataFrame(rows, "n long, spare int")
    assert jaccard_join.boundary_by_cost(df) >= 5000  # large sets that can spare nothing are cheaper light
    assert 12 <= jaccard_join.boundary_by_cost(df.where("n < 5000")) < 900
    assert jaccard_join.boundary_by_cost(df.where("n = 900")) == 1 and jaccard_join.boundary_by_cost(df.limit(0)) == 1


def test_quality_rules(spark):
    texts = odd_texts() + near_copies()
    got = {r.doc_id: r for r in quality_rules.score_quality(table(spark, texts)).collect()}
    for d, t in enumerate(texts):
        w = words(t)
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(again), failed)
        assert not (failed and r.kept)
    assert quality_rules.keep_good(table(spark, texts)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_expectation_maximisation_finds_bad_patterns():
    p = quality_rules.fit({"111111111": 900, "001111111": 10, "000111111": 60, "110100101": 70, "1111111?1": 100})
    assert p["111111111"] > 0.95 and p["000111111"] < 0.5 and p["110100101"] < 0.5


SECRET = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in SECRET.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_scan(spark):
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(8)]
    plain = [" ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ing"]) for _ in range(9)) for _ in range(30)) for _ in range(30)]
    texts = [*odd_texts(), "secret: token: abcdefgh", "é API_KEY = 'abc.def-123' x", *plain, *(f"see {k} here" for k in keys)]
    rows = {r.doc_id: r for r in secret_scan.find_secrets(table(spark, texts)).collect()}
    for d, t in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in rows[d].base] == base_spans(t or "")
    added = {texts[d][s.start : s.end] for d, r in rows.items() for s in r.all_spans if s.kind == 3}
    assert len(added & set(keys)) >= 6 and added <= set(keys)
    clean = {r.doc_id: r.text for r in secret_scan.redact(table(spark, texts)).collect()}
    for d, t in enumerate(texts):
        want, at = "", 0
        for s in rows[d].all_spans:
            if s.start >= at:
                want += (t or "")[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert clean[d] == (want + t[at:] if t is not None and rows[d].all_spans else t)


def test_source_mixing(spark):
    rng = random.Random(4)
    rows = [(i, passage(i, rng.randint(0, 40)) if i % 9 else None, "en", rng.choice(["a", "b", "c", "d", None]), 0) for i in range(400)] + [(5000, passage(3, 900), "en", "e", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = source_mixing.copies_of(docs).collect()
    size = {r[0]: len(words(r[1])) for r in rows}
    per = collections.Counter()
    for r in rows:
        per[r[3]] += size[r[0]]
    names = [*sorted(n for n in per if n is not None), None]
    weight = {n: 1 + i % 3 for i, n in enumerate(names)}
    left, free, target = sum(per.values()), set(names), {}
    while True:
        level = left / sum(weight[n] for n in free)
        full = [n for n in free if level * weight[n] > 3 * per[n]]
        if not full:
            target |= {n: level * weight[n] for n in free}
            break
        for n in full:
            target[n] = 3 * per[n]
            left -= target[n]
            free.discard(n)
    taken = collections.Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == per[r.source] and 0 <= r.copies <= 3
        assert abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.copies * r["size"]
    assert len(got) == len(rows)
    assert all(abs(taken[n] - target[n]) <= 0.03 * target[n] + 20 for n in names if n != "e")
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, source_mixing.copies_of(docs).collect()), key=str)


def test_decontamination(spark):
    items = [passage(70 + i, 20) for i in range(4)] + ["We saw that in Paris a train leaves at 15 km from the old station and stops after 30 minutes near Berlin then goes on", "too short"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    other = items[4].replace("Paris", "Rome").replace("15", "99").replace("30", "12").replace("Berlin", "Oslo")
    texts = [*odd_texts(), f"{passage(8, 30)} {items[0].upper()}, {passage(9, 10)}", items[1], other, items[4], " ".join(items[2].split()[4:17]), " ".join(items[3].split()[:7]), "too short"]
    n = len(odd_texts())
    found = {(r.doc_id, r.item_id): r.exact for r in decontamination.leaks(table(spark, texts), bench).collect()}
    # the last document is a short item and nothing else
    assert found == {(n, 0): True, (n + 1, 1): True, (n + 2, 4): False, (n + 3, 4): True, (n + 4, 2): True, (n + 6, 5): True}
    assert sorted(r.doc_id for r in decontamination.remove_leaks(table(spark, texts), bench).collect()) == [*range(n), n + 5]


def test_every_common_window_is_found(spark):
    rng = random.Random(11)
    item, short = [f"q{i}" for i in range(20)], [f"s{i}" for i in range(6)]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(short)), (2, " ".join(item[:5]) + " z")], "item_id long, text string")
    texts, want = [], {}
    for before in range(7):
        for n in range(6, 13):
            at = rng.randrange(len(item) - n)
            want |= {(len(texts), 0): n - 7} if n >= 8 else {}
            texts.append(" ".join([f"b{i}" for i in range(before)] + item[at : at + n] + ["c"] * 3))
        want[len(texts), 1] = 1
        texts.append(" ".join([f"b{i}" for i in range(before)] + short + ["c"] * (before % 2)))
        texts.append(" ".join([f"b{i}" for i in range(before)] + short[:5]))
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontamination.leaks(table(spark, texts), bench).collect()}
    assert got == want


def test_inconsistent_slots_are_no_leak(spark):
    item = "add 3 apples to 3 pears and then give 3 plums to the old man near the well"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item.replace("3", "8"), item.replace("3 apples", "5 apples")]
    assert [(r.doc_id, r.exact) for r in decontamination.leaks(table(spark, texts), bench).collect()] == [(0, False)]


def test_runs_are_judged_by_their_own_slots(spark):
    item = "add 3 apples to 3 pears and then give 3 plums to the old man near the well"
    bench = spark.createDataFrame([(1, item), (2, "we walk with 4 dogs over that long green hill today until 4 ends")], "item_id long, text string")
    texts = [item.replace("3 apples", "5 apples"), "add 5 apples to 7 pears and then give 9 plums to the", "we walk with 4 dogs over that long green hill but later 9 others", "nothing of this kind"]
    docs = table(spark, texts)
    got = {(r.doc_id, r.item_id): (r.exact, r.consistent) for r in decontamination.leaks(docs, bench, inconsistent=True).collect()}
    assert got == {(0, 1): (True, False), (1, 1): (False, False), (2, 2): (True, True)}
    assert sorted(r.doc_id for r in decontamination.remove_leaks(docs, bench).collect()) == [1, 3]


def test_warc_round_trip(spark):
    rng = random.Random(1)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, "u", rng.choice(["", None, "x" * rng.randint(0, 300), "é" * rng.randint(0, 300) + fake + "WARC/1.0\r\n" * rng.randint(0, 3) + "tail" * rng.randint(0, 40), fake * 3, "same" * 50])) for i in range(150)]
    first = collections.defaultdict(list)
    for i, _, h in rows:
        first[h or ""].append(i)
    for split, compression in (("128m", "gzip"), ("3000", "none")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            path = Workspace(spark, "test").path("archive")
            warc_archive.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path, compression=compression)
            got = {r.page_id: r for r in warc_archive.archive_report(spark, path).collect()}
            bodies = {r.record: bytes(r.body) for r in warc_archive.read_archive(spark, path).collect() if r.kind == "response"}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len(got) == len(rows)
        for i, _, h in rows:
            data, least = (h or "").encode(), min(first[h or ""])
            again = len(data) >= 100 and i != least
            assert tuple(got[i]) == (i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least if again else None, True)
            if not again:
                assert bodies[f"<urn:page:{i}>"] == data


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    texts = odd_texts()
    rows = token_counts.count_tokens(table(spark, texts), rule=rule, splitter="\nw").collect()
    with open(token_counts.VOCABULARY, "rb") as f:
        encoder, lengths = token_counts._encoder(f.read())
    per = collections.defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
    for d, t in enumerate(texts):
        parts = sorted(per[d], key=lambda r: r.section)
        ids = encoder.encode_ordinary(t or "")
        assert sum(r.n_tokens for r in parts) == len(ids) == parts[0].doc_tokens
        assert [r.start for r in parts[1:]] == [r.end for r in parts[:-1]] and parts[0].start == 0 and parts[-1].end == len(t or "")
        data, at, want = (t or "").encode(), 0, collections.Counter()
        section, of = 0, []
        for b in data:
            of.append(section)
            section += b in b"\nw"
        for i in ids:
            own = of[at : at + int(lengths[i])]
            want[{"start": own[0], "end": own[-1], "most": max(sorted(set(own)), key=own.count)}[rule]] += 1
            at += int(lengths[i])
        assert {r.section: r.n_tokens for r in parts if r.n_tokens} == dict(want)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_field_token_counts(spark, rule):
    fields = [("title é", "", "a body of words"), (None, None, None), ("", "x", None), ("un", "believ", "able"), ("\U0001f600", "\U0001f600\U0001f600", " tail")]
    docs = spark.createDataFrame([(i, *f) for i, f in enumerate(fields)], "doc_id long, title string, lead string, body string").withColumn("text0", F.lit("clash"))
    with open(token_counts.VOCABULARY, "rb") as f:
        encoder, lengths = token_counts._encoder(f.read())
    for joiner in ("", "\n"):
        got = {(r.doc_id, r.field): (r.n_tokens, r.start, r.end, r.doc_tokens) for r in token_counts.count_field_tokens(docs, ["title", "lead", "body"], rule=rule, joiner=joiner).collect()}
        assert len(got) == 3 * len(fields)
        for d, f in enumerate(fields):
            parts = [(x or "") + (joiner if i < 2 else "") for i, x in enumerate(f)]
            of = [i for i, p in enumerate(parts) for _ in p.encode()]
            ids, at, want = encoder.encode_ordinary("".join(parts)), 0, collections.Counter()
            for i in ids:
                own = of[at : at + int(lengths[i])]
                want[{"start": own[0], "end": own[-1], "most": max(sorted(set(own)), key=own.count)}[rule]] += 1
                at += int(lengths[i])
            for i, name in enumerate(["title", "lead", "body"]):
                start = sum(map(len, parts[:i]))
                assert got[d, name] == (want[i], start, start + len(parts[i]), len(ids))


def test_preference_format(spark):
    T = lambda *x: [{"role": r, "text": t} for r, t in x]
    u, a, b = ("user", "hi"), ("assistant", "hello"), ("assistant", "go away")
    pairs = spark.createDataFrame([(1, T(u, a), T(u, b)), (2, T(u, a), T(u, a)), (3, None, T(u)), (4, T(u, a, u, b), T(u, a, u, a)), (5, T(u), T(u, a))], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r.pair_id: r for r in preference_format.format_pairs(pairs).collect()}
    assert {k: r.n_shared for k, r in got.items()} == {1: 1, 2: 1, 3: 0, 4: 3, 5: 1}
    r = got[1]
    assert r.prompt == "<|user|>\nhi<|end|>\n" and r.chosen_completion == "<|assistant|>\nhello<|end|>\n"
    assert [r.chosen_completion[s.start : s.end] for s in r.chosen_mask if s.train] == ["hello<|end|>\n"]
    assert got[5].chosen_completion == "" and got[5].chosen_mask == []


def test_pairs_of_a_table(spark):
    said = {
        0: ["u:q", "a:a", "u:r", "a:b", "u:thanks"], 1: ["u:p", "a:c", "u:r", "a:d"], 4: [":"], 5: ["u:x", "a:y"], 6: ["u:x", "a:y"], 7: ["u:x", "a:y"], 8: ["u:alone", "a:alone"], -1: ["a:m"], -2: ["u:l", "a:n"], 10: ["a:1", "a:2"], 11: ["a:3"], 1 << 60: ["a:big"], (1 << 60) + 1: ["a:other"],
    }
    role = {"u": "user", "a": "assistant", "": None}
    turns = [(c, i, role[t[0] if t != ":" else ""], t.partition(":")[2] or None) for c, ts in said.items() for i, t in enumerate(ts)] + [(None, 0, "user", "x"), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for c in ("turns", "places", "own", "other", "id", "k", "at"):
        df = df.withColumn(c, F.lit("clash"))
    got = {r.pair_id: ([t.text for t in r.chosen], [t.text for t in r.rejected]) for r in preference_format.pairs_of(preference_format.conversations(df)).collect()}
    big = 1 << 60
    assert got == {
        0: (["q", "a", "r", "b", "thanks"], ["q", "c", "r", "d"]), 1: (["p", "c", "r", "d"], ["p", "a", "r", "b", "thanks"]), -1: (["m"], ["n"]), -2: (["l", "n"], ["l", "m"]), 10: (["1", "2"], ["1", "3"]), 11: (["3"], ["1", "2"]),
        big: (["big"], ["other"]), big + 1: (["other"], ["big"]),
    }


def test_formatted_pairs_against_brute_force(spark):
    rng = random.Random(12)
    side = lambda: [{"role": rng.choice(["user", "assistant"]), "text": rng.choice(["a", "é", "\U0001f600 b", ""])} for _ in range(rng.randint(0, 7))]
    rows = []
    for i in range(80):
        a = side()
        rows.append((i, a, a[: rng.randint(0, len(a))] + side()))
    long = [{"role": "assistant", "text": "x" * 100_000}] + [{"role": "user", "text": "y"}] * 4000
    rows.append((99, long, [*long, {"role": "assistant", "text": "z"}]))
    pairs = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r.pair_id: r for r in preference_format.format_pairs(pairs).collect()}
    show = lambda t: f"<|{t['role']}|>\n{t['text']}<|end|>\n"
    for i, c, r in rows:
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        n -= bool(n and n == len(c) == len(r))
        assert got[i].n_shared == n and got[i].prompt == "".join(map(show, c[:n]))
        for turns, text, mask in ((c[n:], got[i].chosen_completion, got[i].chosen_mask), (r[n:], got[i].rejected_completion, got[i].rejected_mask)):
            at, want = 0, []
            for t in turns:
                head = at + len(t["role"]) + 5
                end = head + len(t["text"]) + 8
                want += [(at, head, False), (head, end, t["role"] == "assistant")]
                at = end
            assert text == "".join(map(show, turns)) and [tuple(s) for s in mask] == want


def test_quality_classifier(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        w = [rng.choice(["the", "of", "and", "than", "ering", "tion"]) + rng.choice(["a", "b", "c"]) for _ in range(60)]
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "en", "s", 0))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows + [(9000, None, None, None, None), (9001, "", None, None, 0)], SCHEMA)
    lab = spark.createDataFrame(labels + [(3, 1 - labels[3][1], 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.score_documents(docs, lab).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y, _ in labels if got[i].held_out]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.97


def test_dual_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=80) > 0, 1.0, -1.0)
    rows = [(np.arange(5), v) for v in x]
    w = quality_classifier.dual_coordinate_descent(rows, y, np.ones(80), 500, 0)[:5]
    objective = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    best = objective(w)
    assert all(objective(w + 0.05 * rng.normal(size=5)) >= best - 1e-6 for _ in range(200))


def test_repeated_rows_are_mixed_in_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "LEAF", 8)
    monkeypatch.setattr(storage, "HOT_ROWS", 16)
    rows = [(1, "same five words are here", "en", "a", 0)] * 300 + [(i, passage(i, 7), "en", "ab"[i % 2], 0) for i in range(2, 200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = source_mixing.copies_of(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.02 * t + 10 for s, t in target.items())
    salted = source_mixing._salted(source_mixing.Workspace(spark, "test").write(docs.select(F.lit(1).cast("long").alias("k1"), F.lit(2).cast("long").alias("k2")).withColumn("nth", F.monotonically_increasing_id()), "sizes"))
    assert salted.select("salt").distinct().count() == len(rows)
