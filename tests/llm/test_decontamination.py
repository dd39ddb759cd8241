import random
import re
import weakref

from lineform.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text, items, window=10):
    words = WORD.findall((text or "").translate(lower))
    hit, seen = set(), set()
    for item, t in items:
        own = WORD.findall((t or "").translate(lower))
        if not own:
            continue
        n = min(window, len(own))
        for i in range(len(own) - n + 1):
            w = own[i : i + n]
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w:
                    hit.update(range(j, j + n))
                    seen.add(str(item))
    return len(words), len(hit), sorted(seen)


def made(n, seed, letters="ab"):
    r = random.Random(seed)
    return [" ".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 9, 10, 14, 40]))) for _ in range(n)]


def test_against_brute_force(spark):
    items = [*enumerate(made(12, 1)), (12, None), (13, "É x_Y-z " * 4), (14, "É x_Y-z " * 4)]
    texts = [*made(60, 2), *made(20, 3, "abc"), None, "", "q É x y Z é x y z É x y z É X y z q", "É X y z É x y z É x q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as items", "2 as n_words")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (10**6, 30):
        out = {r.doc_id: r for r in D.find(docs, bench, block_words=block_words).collect()}
        assert len(out) == len(texts)
        for i, t in enumerate(texts):
            n, hit, seen = brute(t, items)
            got = out[i]
            assert (got.n_words, sum(h.end - h.start for h in got.hits), got.items) == (n, hit, seen), (t, block_words)


def test_cleaned(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Keep, this. {passage}! And " + "more " * 20, "x"), (2, passage.upper(), "y"), (3, None, "z"), (4, "fine", None)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(0, passage)], "item_id long, text string")
    out = {r.doc_id: r.text for r in D.cleaned(docs, bench).collect()}
    assert set(out) == {1, 3, 4} and out[3] is None and out[4] == "fine"
    assert out[1].startswith("Keep, this. ! And more")
    assert D.cleaned(docs.limit(0), bench).count() == 0
    assert D.find(docs, bench.limit(0)).where("size(hits) > 0").count() == 0


def test_blocks_keep_rows_of_repeated_and_null_ids(spark):
    items = [*enumerate(made(12, 1)), (12, "p q r s t u v w x y")]
    rows = [(i % 7 if i % 3 else None, t) for i, t in enumerate([*made(60, 2), *made(10, 3, "abc"), None, "", "Z p q r s t u v w x y " + "fine " * 30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, D.find(docs, bench, block_words=n).collect())) for n in (10**6, 30))
    assert len(many) == len(rows) and one == many
    one, many = (sorted(map(str, D.cleaned(docs, bench, block_words=n).collect())) for n in (10**6, 30))
    assert one == many and any("Z  fine" in t for t in many)


def test_one_block_at_a_time(spark, monkeypatch):
    alive, most = weakref.WeakSet(), []

    class Counted(D.Automaton):
        def __init__(self, *a):
            most.append(len(alive))
            super().__init__(*a)
            alive.add(self)

        def __reduce__(self):
            return (dict, ())

    monkeypatch.setattr(D, "Automaton", Counted)
    bench = spark.createDataFrame([*enumerate(made(12, 1))], "item_id long, text string")
    for a, _ in D.automata(bench, "item_id", "text", 10, 10):
        del a
    assert len(most) > 2 and max(most) == 0
