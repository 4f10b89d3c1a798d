from plateview.operators import lemmas

# Regular English inflections by rule: the endings are built, the stems are listed.
STEMS = ("walk talk jump call cook help look need open order paint pass play pull push rain reach rest roll sail show sort stay talk test turn visit "
         "wait want wash watch work wonder ask add answer burn clean climb count cover end fill find follow gain hand head hope").split()
Y_STEMS = "carr stud tr cr hurr worr marr repl suppl den rel appl bur cop empt env".split()
E_STEMS = "mov lov us clos danc lik hat bak smil shar shap tast wast serv danc tun".split()


def _examples():
    out = {}
    for s in STEMS:
        es = s.endswith(("s", "sh", "ch", "x"))
        out |= {s: s, s + ("es" if es else "s"): s, s + "ed": s, s + "ing": s}
    for s in Y_STEMS:
        out |= {s + "y": s + "y", s + "ies": s + "y", s + "ied": s + "y"}
    for s in E_STEMS:
        out |= {s + "e": s + "e", s + "es": s + "e", s + "ed": s + "e"}
    return sorted(out.items())


def test_held_out_pairs(spark):
    """Learned from four fifths of the pairs, the rest is right more often than by cutting nothing or a plural s."""
    pairs = _examples()
    train, held = [p for i, p in enumerate(pairs) if i % 5], [p for i, p in enumerate(pairs) if not i % 5]
    rules = lemmas.suffix_rules(spark.createDataFrame(train, "token string, lemma string"))
    found = {r.token: r.lemma for r in lemmas.apply_rules(spark.createDataFrame([(t,) for t, _ in held], "token string"), rules).collect()}
    right = sum(found[t] == x for t, x in held) / len(held)
    naive = sum((t[:-1] if t.endswith("s") else t) == x for t, x in held) / len(held)
    assert right >= 0.85 and right > naive + 0.2


def test_longest_ending_decides(spark):
    pairs = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("pens", "pen"), ("ponies", "pony"), ("babies", "baby"), ("bus", "bus"), ("plus", "plus"),
                                   ("is", "be"), (None, "x"), ("y", None), ("", "z")], "token string, lemma string")
    rules = {r.ending: (r.cut, r.add, r.n) for r in lemmas.suffix_rules(pairs).collect()}
    assert rules["ies"] == (3, "y", 2) and rules["us"] == (0, "", 2) and rules["s"] == (1, "", 3) and "^is" not in rules
    tokens = spark.createDataFrame([(t,) for t in ["skies", "mats", "virus", "tree", "s", "", None]], "token string")
    found = {r.token: r.lemma for r in lemmas.apply_rules(tokens, lemmas.suffix_rules(pairs)).collect()}
    assert found == {"skies": "sky", "mats": "mat", "virus": "virus", "tree": "tree", "s": "s", "": "", None: None}
    one = {r.token: r.lemma for r in lemmas.learned_lemmas(tokens.union(spark.createDataFrame([("is",)], "token string")), pairs).collect()}
    assert one["is"] == "be" and one["mats"] == "mat"


def test_no_examples(spark):
    none = spark.createDataFrame([], "token string, lemma string")
    tokens = spark.createDataFrame([("cats",)], "token string")
    assert [tuple(r) for r in lemmas.apply_rules(tokens, lemmas.suffix_rules(none)).collect()] == [("cats", "cats")]
