"""Word-for-word copies of items whose templates are mostly placeholders, and single shared windows."""

from strophe.llm import decontam

NUMBERS = "12 34 56 78 90 11 13 17 19 23"
TITLE = "The Old Man And The Sea By Ernest Hemingway"
NAMES = "when Alice met Bruno near Cairo they asked Doris about Egypt while Frank told Greta that Hamburg was nicer than Istanbul and so on"
SPARSE = "all of the words in this one window " + " ".join(f"Aa{c} Bb{c} {k} Cc{c} Dd{c} {k} of Ee{c}" for k, c in enumerate("klmnop"))


def _found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decontam.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]) for r in out.collect()}


def test_items_without_a_usable_window(spark):
    texts = [f"see here {NUMBERS} and more", f"a book: {TITLE} is here", "other numbers 1 2 3 4 5 6 7 8 9 10", NUMBERS.replace("12", "21").replace("90", "9")]
    assert _found(spark, texts, [NUMBERS, TITLE]) == {(0, 0), (1, 1)}


def test_case_and_the_token_before_do_not_matter(spark):
    short = "The sum of all the parts is what"
    texts = [NAMES.lower(), NAMES.upper(), f"Q: {short}", f"so {NAMES} or not"]
    assert _found(spark, texts, [NAMES, short]) == {(0, 0), (1, 0), (2, 1), (3, 0)}


def test_one_shared_window_is_not_an_item(spark):
    """Most windows of the item are unusable; one shared passage of eight words leaves a document clean."""
    other = SPARSE
    for c in "klmnop":
        other = other.replace(f"Aa{c}", f"Vv{c}").replace(f"Bb{c}", f"Ww{c}").replace(f"Cc{c}", f"Xx{c}").replace(f"Dd{c}", f"Yy{c}").replace(f"Ee{c}", f"Zz{c}")
    texts = ["all of the words in this one window are shared with nothing else after them", SPARSE, other]
    assert _found(spark, texts, [SPARSE]) == {(1, 0), (2, 0)}
