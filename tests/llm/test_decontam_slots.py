"""Templates with slots against brute force, names at the start of sentences, very long texts."""

import math
import random
import re

import pytest

from strophe.llm import decontam


def _found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decontam.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]) for r in out.collect()}


def test_names_at_the_start_of_sentences(spark):
    item = "Tom buys 3 apples and 4 pears daily."
    texts = ["Anna buys 5 apples and 6 pears daily.", "We know that Anna buys 5 apples and 6 pears daily.", "It is so. Anna buys 5 apples and 6 pears daily. More.", "Anna sells 5 apples and 6 pears daily."]
    assert _found(spark, texts, [item]) == {(0, 0), (1, 0), (2, 0)}
    other = "The farmer sold 3 of his brown cows to the miller"
    assert _found(spark, ["they say the farmer sold 8 of his brown cows to the miller"], [other]) == {(0, 0)}


def _typed(text, leading):
    """(template, value) of each token; ``value`` is None for words."""
    out, before = [], None
    for x in re.findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|[.!?\n]+", text):
        start = before is None or before[0] in ".!?\n"
        if x[0] in ".!?\n":
            pass
        elif x[0].isdigit():
            out.append(("#", x))
        elif x != x.lower() and x != x.upper() and (leading or not start):
            out.append(("@", x.lower()))
        elif x in ("km", "kg") and before is not None and before[0].isdigit():
            out.append(("%", x))
        else:
            out.append((x.lower(), None))
        before = x
    return out


def _leaks(text, item, window=8, least=6, share=0.6):
    theirs, own = _typed(text, True), _typed(item, True)
    size = min(window, len(own))
    word = lambda t: t[1] or t[0]
    lines = set()
    for reading in (own, _typed(item, False)):
        for i in range(len(own) - size + 1):
            slots = sum(v is not None for _, v in reading[i : i + size])
            for j in range(len(theirs) - size + 1):
                if [word(t) for t in own[i : i + size]] == [word(t) for t in theirs[j : j + size]] or (slots <= size // 2 and [t for t, _ in reading[i : i + size]] == [t for t, _ in theirs[j : j + size]]):
                    lines.add(j - i)
    found = set()
    for line in lines:
        at = lambda i: theirs[i + line] if 0 <= i + line < len(theirs) else ("", None)  # noqa: B023, E731
        plain = [word(at(i)) == word(own[i]) for i in range(len(own))]
        kind = ["s" if own[i][1] and own[i][0] == at(i)[0] else "w" if own[i][0] == at(i)[0] or plain[i] else "-" for i in range(len(own))]
        places = range(len(own) - size + 1)
        like = [i for i in places if "-" not in kind[i : i + size] and "w" in kind[i : i + size]]
        pairs = {(own[i][1], at(i)[1]) for p in like for i in range(p, p + size) if kind[i] == "s"}
        found |= {i for i in places if all(plain[i : i + size])}
        if len({a for a, _ in pairs}) == len(pairs):
            found |= set(like)
    return len(own) >= 4 and len(found) >= min(least, math.ceil((len(own) - size + 1) * share))


def test_slots_are_brute_force(spark):
    rng = random.Random(21)
    words = [f"{a}{b}" for a in "klmnprst" for b in ("a", "o", "ie")]
    names = [w.capitalize() + "x" for w in words]

    def token():
        return rng.choice([rng.choice(words), rng.choice(words), rng.choice(words), rng.choice(names), str(rng.randint(2, 99)), f"{rng.randint(2, 9)} {rng.choice(('km', 'kg'))}", rng.choice(words) + "."])

    items = [" ".join(token() for _ in range(rng.randint(3, 24))) for _ in range(25)]
    texts = []
    for _ in range(120):
        part = rng.choice(items).split()
        a = rng.randrange(max(1, len(part) // 2))
        part = part[a:]
        new: dict[str, str] = {}
        for k, x in enumerate(part):
            if x[0].isdigit() or x[0].isupper():
                fresh = str(rng.randint(100, 999)) if x[0].isdigit() else rng.choice(names)
                part[k] = new.setdefault(x, fresh) if rng.random() < 0.9 else fresh
        texts.append(" ".join([token() for _ in range(rng.randint(0, 12))] + part + [token() for _ in range(4)]))
    want = {(k, j) for k, t in enumerate(texts) for j, i in enumerate(items) if _leaks(t, i)}
    assert 60 < len(want) < len(texts) * len(items) / 4
    assert _found(spark, texts, items) == want


@pytest.mark.parametrize("unit", ["7,", "a", ".", "Ab ", "word 12. ", "é"])
def test_very_long_texts(spark, unit):
    item = "what is the sum of all the parts in the box"
    text = unit * (1_000_000 // len(unit)) + f" {item} "
    assert _found(spark, [text, text[:-50]], [item]) == {(0, 0)}
