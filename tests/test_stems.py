from plateview.operators import stems

# Published input and output pairs of the algorithm's steps.
KNOWN = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "digitizer": "digit", "radically": "radic", "vileness": "vile", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "sensitivity": "sensit", "triplicate": "triplic", "formative": "form", "electrical": "electr",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust",
    "replacement": "replac", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "dying": "die", "news": "news", "is": "is", "died": "die", "enjoy": "enjoy", "spied": "spi",
    "geology": "geolog", "y": "y",
}


def test_known_stems(spark):
    words = spark.createDataFrame([(w,) for w in KNOWN], "word string")
    got = {r["word"]: r["stem"] for r in stems.stem_words(words).collect()}
    assert got == KNOWN


def test_texts_get_stems_in_order(spark):
    table = spark.createDataFrame([(1, "The waiters were hopping happily!"), (2, "12"), (3, None)], "id long, t string")
    got = {r["id"]: r["cleaned"] for r in stems.stemmed_clean(table, "id", "t", ["the", "were"]).collect()}
    assert got == {1: "waiter hop happili", 2: "", 3: ""}
