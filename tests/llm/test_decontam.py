"""Templates: re-parameterised questions are caught, others are left alone; windows against brute force."""

import random

from strophe.llm import decontam

ITEM = "A train leaves Boston at 60 km per hour and another train leaves after 3 hours on the same long track towards Denver, so when will the second one meet the first one on its way"
BENCH = "item_id long, text string"
DOCS = "doc_id long, text string, item_id int, tkey int"


def _run(spark, texts, items):
    docs = spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(texts)], DOCS)
    found = decontam.leaks(docs, spark.createDataFrame(list(enumerate(items)), BENCH))
    return docs, {(r["doc_id"], r["item_id"]) for r in found.collect()}


def test_reparameterised(spark):
    other = ITEM.replace("Boston", "Lyon").replace("60", "85").replace("3 hours", "7 hours").replace("Denver", "Nantes")
    texts = [f"some words before it. {ITEM} and some after", f"before. {other} after", ITEM[:60], "a train leaves and nothing else is said here about the other one at all", None, "", ITEM]
    _, found = _run(spark, texts, [ITEM, "short one", None])
    assert found == {(0, 0), (1, 0), (6, 0)}


def test_slots_must_agree(spark):
    """One value of the item stands for one value of the text."""
    item = "if x is 5 then y is 5 and z is 5 while w is 5 and v is 5 with u is 5 or t is 5 but s is 5 too"
    same = item.replace("5", "9")
    values = iter("123456789")
    mixed = "".join(next(values) if c == "5" else c for c in item)
    _, found = _run(spark, [same, mixed], [item])
    assert found == {(0, 0)}


def test_plain_passages_are_brute_force(spark):
    """Without slots, a leak is as many shared windows as the rule asks for."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "klmnprst" for b in ("a", "o", "u", "ie")]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 40))) for _ in range(20)]
    texts = []
    for _ in range(60):
        it = rng.choice(items).split()
        a = rng.randrange(len(it))
        part = it[a : a + rng.randint(1, 30)]
        texts.append(" ".join([rng.choice(words) for _ in range(rng.randint(0, 20))] + part + [rng.choice(words) for _ in range(5)]))
    want = set()
    for k, t in enumerate(texts):
        tw = t.split()
        for j, i in enumerate(items):
            iw = i.split()
            if len(iw) < 4:
                continue
            n = min(8, len(iw))
            there = {tuple(tw[p : p + n]) for p in range(len(tw) - n + 1)}
            own = [tuple(iw[p : p + n]) for p in range(len(iw) - n + 1)]
            hits = sum(w in there for w in own)
            if hits >= min(6, -(-len(own) * 6 // 10)):
                want.add((k, j))
    _, found = _run(spark, texts, items)
    assert found == want


def test_clean_and_edges(spark):
    docs, _ = _run(spark, [ITEM, "clean words", None, ""], [ITEM])
    bench = spark.createDataFrame([(0, ITEM), (0, ITEM), (None, ITEM)], BENCH)
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == 4
    far = decontam.leaks(docs, bench, broadcast_rows=0)
    assert {(r["doc_id"], r["item_id"]) for r in far.collect()} == {(0, 0), (0, None)}


def test_native(spark):
    docs, _ = _run(spark, [ITEM], [ITEM])
    plan = decontam.leaks(docs, spark.createDataFrame([(0, ITEM)], BENCH))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
