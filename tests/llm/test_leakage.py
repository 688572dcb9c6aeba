import random

import pytest

from tallyspark.llm import leakage as L

DOCS, ITEMS = "doc_id long, text string, item_id int, lang string", "item_id long, lang string, item_text string, doc_id int, text string"


def brute(items, docs):
    """Every run of every item looked up in every text."""
    found = set()
    for i, lang, text in items:
        n, t = (30 if lang == "zh" else 80), L.letters_and_digits(text)
        runs = {t[k : k + n] for k in range(len(t) - n + 1)}
        for d, body in docs:
            b = L.letters_and_digits(body)
            if any(b[k : k + n] in runs for k in range(len(b) - n + 1)):
                found.add((i, d))
    return found


def run(spark, items, docs):
    i = spark.createDataFrame([(*r, 7, "clash") for r in items], ITEMS)
    d = spark.createDataFrame([(*r, 7, "clash") for r in docs], DOCS)
    return sorted(tuple(r) for r in L.leaked_items(d, i).collect())


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(4)
    stock = words(rng, 12)
    items = [(k, "en", f"{words(rng, 20)} {stock} {words(rng, 20)}") for k in range(25)] + [(100 + k, "zh", "".join(chr(rng.randint(0x4E00, 0x4F00)) for _ in range(90))) for k in range(15)]
    docs = []
    for k in range(250):
        body = [words(rng, rng.randint(0, 60))]
        if k % 3 == 0:
            _, lang, text = rng.choice(items)
            size = rng.randint(10, 60) if lang == "zh" else rng.randint(60, 160)
            at = rng.randint(0, max(0, len(text) - size))
            part = text[at : at + size]
            body.append(rng.choice([part, part.upper(), "-\n".join(part[i : i + 7] for i in range(0, len(part), 7)), "​".join(part)]))
        if k % 7 == 0:
            body.append(stock)
        body.append(words(rng, rng.randint(0, 60)))
        docs.append((k, " ".join(body)))
    got = run(spark, items, docs)
    assert set(got) == brute(items, docs) and len(got) == len(set(got)) > 20


def test_exact_threshold_at_any_offset(spark):
    rng = random.Random(5)
    item = "".join(rng.choices("abcdefghijklmnop", k=300))
    for at in (0, 1, 39, 40, 41, 79, 220):
        assert run(spark, [(1, "en", item)], [(1, "zz" + item[at : at + 80] + "qq")]) == [(1, 1)]
        assert run(spark, [(1, "en", item)], [(1, "zz" + item[at : at + 79] + "QQ!")]) == []


def test_normalisation():
    assert L.letters_and_digits("Ａ-b_C ﬁ ① Straße, ก็ 1.5\n") == "abcfi1strasseก15"
    assert L.letters_and_digits(None) == L.letters_and_digits("") == L.letters_and_digits("?!") == ""


def test_nulls_short_items_repeats_long_and_empty(spark):
    item = "x1" * 60
    assert run(spark, [(1, "en", item), (1, "en", item), (2, "en", "short"), (3, None, item), (None, "en", item), (4, "en", None)], [(1, item), (2, None), (3, ""), (None, item), (4, "y" * 300_000 + item), (5, item)]) == [(i, d) for i in (1, 3) for d in (1, 4, 5)]
    assert run(spark, [], [(1, item)]) == [] and run(spark, [(1, "en", item)], []) == []


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, "en", words(rng, 40)) for k in range(12)]
    docs = [(k, items[k % 12][2]) for k in range(30)]
    whole = run(spark, items, docs)
    monkeypatch.setattr(L, "BLOCK_CHARS", 600)
    assert run(spark, items, docs) == whole and len(whole) == 30


def distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        now = [i + 1]
        for j, b in enumerate(text):
            now.append(min(before[j] + (a != b), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def test_bit_parallel_distance():
    rng = random.Random(7)
    for _ in range(300):
        p, t = "".join(rng.choices("abc", k=rng.randint(0, 90))), "".join(rng.choices("abc", k=rng.randint(0, 70)))
        assert L.myers_distance(p, t) == distance(p, t)


@pytest.mark.parametrize("errors", [1, 2])
def test_error_budget(errors):
    rng = random.Random(8)
    item = "".join(rng.choices("abcdefghijklmnopqrst", k=200))
    matcher = L.LeakMatcher([(1, item, 80)], errors)
    run_ = list(item[50:130])
    for k in range(errors):
        run_[20 + 30 * k] = "z"
    assert matcher.leaked("q" * 50 + "".join(run_) + "q" * 50) == [1]
    for k in range(20):
        run_[3 + 4 * k] = "z"
    assert matcher.leaked("q" * 50 + "".join(run_) + "q" * 50) == []


def prefix_reach(pattern, text, errors):
    """The definition of reach by the full table of distances."""
    d = [[i + j if i == 0 or j == 0 else 0 for j in range(len(text) + 1)] for i in range(len(pattern) + 1)]
    for i in range(1, len(pattern) + 1):
        for j in range(1, len(text) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (pattern[i - 1] != text[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    return [max(i for i in range(len(pattern) + 1) if min(d[i]) <= e) for e in range(errors + 1)]


def test_reach_against_the_full_table():
    rng = random.Random(9)
    for _ in range(600):
        p, t = "".join(rng.choices("ab", k=rng.randint(0, 25))), "".join(rng.choices("abc", k=rng.randint(0, 30)))
        k = rng.randint(0, 4)
        assert L.reach(len(p), L.char_masks(p), t, k) == prefix_reach(p, t, k)


@pytest.mark.parametrize("errors", [0, 1, 3])
def test_planted_edits_against_brute_force(spark, monkeypatch, errors):
    """Every planted run within the budget is found, and nothing that the definition doesn't give."""
    monkeypatch.setattr(L, "RUN", 40)
    rng = random.Random(10 + errors)
    items = [(k, "en", "".join(rng.choices("abcdefgh", k=rng.randint(60, 120)))) for k in range(8)]
    docs, planted = [], set()
    for k in range(60):
        i, _, text = rng.choice(items)
        at, n = rng.randint(0, len(text) - 40), rng.randint(0, 5)
        part = list(text[at : at + 40])
        for _ in range(n):
            where = rng.randrange(len(part))
            part[where : where + 1] = rng.choice([["z"], [], [part[where], "z"]])
        docs.append((k, "".join(rng.choices("abcdefgh", k=50)) + "".join(part) + "".join(rng.choices("abcdefgh", k=50))))
        if n <= errors:
            planted.add((i, k))
    i, d = spark.createDataFrame([(*r, 7, "clash") for r in items], ITEMS), spark.createDataFrame([(*r, 7, "clash") for r in docs], DOCS)
    got = {tuple(r) for r in L.leaked_items(d, i, errors).collect()}
    want = {(i, k) for i, _, text in items for k, body in docs if any(L.myers_distance(text[a : a + 40], body) <= errors for a in range(len(text) - 39))}
    assert got == want and planted <= got and planted


def test_one_id_with_texts_in_several_blocks_is_reported_once(spark, monkeypatch):
    rng = random.Random(11)
    items = [(7, "en", words(rng, 40)) for _ in range(6)]
    docs = [(1, " ".join(t for _, _, t in items)), (1, items[0][2])]
    monkeypatch.setattr(L, "BLOCK_CHARS", 300)
    assert run(spark, items, docs) == [(7, 1)]
