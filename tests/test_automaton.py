import random
import time

from plateview.operators import aspects
from plateview.operators import terms as tm
from plateview.operators.automaton import TermAutomaton


def _naive(terms, words):
    out, n = set(), len(words)
    for t in terms:
        own = t.split(" ")
        if any(words[i:i + len(own)] == own for i in range(n - len(own) + 1)):
            out.add(t)
    return out


def test_equals_naive_search():
    rng = random.Random(1)
    for _ in range(300):
        terms = {" ".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12))}
        words = [rng.choice(["a", "b", "c", None]) for _ in range(rng.randint(0, 30))]
        assert TermAutomaton(terms).found(words) == _naive(terms, words)


def test_large_lexicon_is_linear_in_the_text():
    """100,000 terms, one of 20 words; ten times the text takes about ten times as long, however many terms begin with its words."""
    rng = random.Random(2)
    long = " ".join(f"w{i}" for i in range(20))
    terms = {f"w{rng.randrange(300)} w{rng.randrange(300)} w{rng.randrange(10**6)}" for _ in range(100_000)} | {long, "w7 w7"}
    automaton = TermAutomaton(terms)
    text = [f"w{rng.randrange(300)}" for _ in range(20_000)] + long.split(" ")
    assert long in automaton.found(text)

    def seconds(words):
        begin = time.process_time()
        automaton.found(words)
        return time.process_time() - begin

    short = min(seconds(text) for _ in range(3))
    assert min(seconds(text * 10) for _ in range(3)) < 30 * max(short, 0.005)


def test_aspects_by_automaton_equal_those_in_the_row(spark):
    rng = random.Random(3)
    words = ["food", "slow", "service", "the", "of", "menu", "nice", "view", "5"]
    texts = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(40))) for i in range(60)] + [(100, None), (101, ""), (102, "!!")]
    reviews = spark.createDataFrame(texts, "review_id long, text string")
    lexicon = spark.createDataFrame([("food", "food", 0), ("slow service", "service", 1), ("the menu of", "menu", 5), ("service", "service", 1),
                                     ("nice view", "ambience", 2), ("nice view", "menu", 5), ("5", "price", 3)], "term string, aspect string, ord int")
    for mode, longest in ((tm.PHRASES, 3), (tm.NOUNS, 1)):
        prepared = tm.prepare(reviews, mode=mode, longest=longest)
        row = {r.review_id: r.detected for r in aspects.detect_in_row(prepared, lexicon).collect()}
        one = {r.review_id: r.detected for r in aspects.detect_by_automaton(prepared, lexicon, mode == tm.NOUNS).collect()}
        assert {k: v or [] for k, v in row.items()} == {k: v or [] for k, v in one.items()}


def test_long_terms_take_one_pass(spark, tmp_path):
    path = str(tmp_path / "reviews")
    spark.createDataFrame([(1, "I liked the very best fish of the whole wide town. Good.")], "review_id long, text string").write.parquet(path)
    lexicon = spark.createDataFrame([("best fish of the whole wide town", "food", 0), ("town good", "food", 0)], "term string, aspect string, ord int")
    found = aspects.extract_aspects(spark.read.parquet(path), lexicon)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert [d.forms for d in found.first().detected] == [["best fish of the whole wide town"]]


def test_key_phrases(spark):
    """Of 'fast fish soup, fish soup, fish' fish has degree 3 + 2 + 1 over 3 occurrences, soup 5 / 2, fast 3 / 1."""
    texts = [(1, "Fast fish soup, fish soup and fish."), (2, None), (3, ""), (4, "the of"), (5, "one " * 30)]
    found = tm.key_phrases(spark.createDataFrame(texts, "review_id long, text string"), top=2).collect()
    assert sorted(map(tuple, found)) == [(1, 1, "fast fish soup", 7.5, 1), (1, 2, "fish soup", 4.5, 1), (5, 1, " ".join(["one"] * 30), 900.0, 1)]
