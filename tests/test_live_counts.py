"""An index that keeps the counts of its terms alone follows updates like one that is searched."""

import os
import random

from strophe.operators import search
from strophe.operators.segments import LiveIndex

SONGS = "number long, title string, variants array<struct<label:string,body:array<struct<content:string>>>>"
WORDS = ["the", "Then", "river,", "ΑΣ.Α", "моро", "(old)", "x\x1cy", "-", "song"]


def test_counts_of_terms_without_postings(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    made = lambda numbers: {k: (k, None if k % 7 == 0 else text(2), None if k % 9 == 0 else [("", [(text(rng.randint(0, 5)),)]) for _ in range(2)]) for k in numbers}
    songs = made(range(40))
    df = lambda: spark.createDataFrame(list(songs.values()), SONGS)
    live = LiveIndex.create(df(), str(tmp_path / "live"), searched=False)
    counts = lambda x: sorted((r["term"], r["df"]) for r in x.collect())
    want = lambda: counts(search.vocabulary_of(search.postings(df())))
    assert counts(live.vocabulary) == want()
    songs = {k: v for k, v in (songs | made([3, 5, 50])).items() if k not in (7, 8)}
    assert live.sync(df()) == 1 and live.sync(df()) == 1  # nothing to do
    assert counts(live.vocabulary) == want()
    live.compact()
    songs |= made([8, 9])
    live.sync(df())
    assert counts(live.vocabulary) == want()
    assert sorted(os.listdir(tmp_path / "live")) == ["commits", "gone", "songs", "terms"]
    assert counts(search.term_counts(df(), stopwords=("the",))) == [x for x in want() if x[0] != "the"]
