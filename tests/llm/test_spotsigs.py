import random
import re

from plateview.llm import spotsigs

WORD = re.compile(r"[^\W_]+")


def _signatures(text):
    """Signatures as words: the anchor, then the next content words."""
    if not text:
        return set()
    words = WORD.findall(text.lower())
    if not words:
        return {text}
    anchors = set(spotsigs.ANCHORS)
    if not any(w in anchors for w in words):
        return {" ".join(words[i:i + 3]) for i in range(len(words))}
    pieces = [["^"]]
    for w in words:
        if w in anchors:
            pieces.append([w])
        else:
            pieces[-1].append(w)
    pieces = [p for p in pieces if len(p) > 1]
    if not pieces:      # anchors alone
        return {" ".join(words[i:i + 3]) for i in range(len(words))}
    out = set()
    for i, p in enumerate(pieces):
        content = [w for q in pieces[i:] for w in q[1:]]
        out.add(p[0] + ":" + " ".join(content[:3]))
    return out


def _case(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "und", "los"] + [f"word{i}" for i in range(30)] + ["Éa", "x1"]
    docs = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "!?"]) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    return docs + [(100, None), (101, ""), (102, "!!"), (103, "The Of"), (106, "the of AND"), (107, "is it not"), (104, "one two three four"), (105, docs[3][1]), (105, docs[3][1])]


def test_signatures_match_a_plain_restatement(spark):
    docs = _case(1)
    rows = {}
    for r in spotsigs.fingerprints(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, sigs string")).collect():
        rows.setdefault(r.doc_id, set()).add((tuple(r.sigs), r.fingerprint))
    assert all(len(v) == 1 for v in rows.values())
    text = dict(docs)
    for i, found in rows.items():
        ((sigs, printed),) = found
        # An anchor alone, without a content word, leaves a text without signatures.
        assert len(sigs) == len(_signatures(text[i])) and len(printed) == 8 * len(sigs)
    ids = list(text)
    for a in ids[:25]:
        for b in ids[:25]:
            x, y = (next(iter(rows[k]))[0] for k in (a, b))
            assert len(set(x) & set(y)) == len(_signatures(text[a]) & _signatures(text[b]))


def test_next_documents_in_any_number_of_ranges(spark):
    docs = _case(2) + [(None, "last one"), (-5, "minus five")]
    order = sorted([d for d in docs if d[0] is not None], key=lambda d: -d[0]) + [(None, "last one")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (5, 1000):
        found = spotsigs.with_next(table, size).collect()
        assert len(found) == len(docs)
        after = {d[0]: order[(i + 1) % len(order)][1] for i, d in enumerate(order)}
        for r in found:
            if r.doc_id != 105:
                assert r.next_text == after[r.doc_id]
    assert spotsigs.with_next(table.limit(0)).collect() == []
    assert [r.next_text for r in spotsigs.with_next(table.filter("doc_id = 3")).collect()] == [docs[3][1]]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    docs = []
    for i in range(10):
        words = [rng.choice(["the", "of", "and"]) if j % 3 == 0 else f"w{rng.randrange(500)}" for j in range(90)]
        docs.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            own = list(words)
            for _ in range(k):
                own[rng.randrange(len(own))] = "changed"
            docs.append((10 * i + k, " ".join(own)))
    docs += [(500, None), (501, ""), (502, docs[0][1])]
    found = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    from brute import joined
    sets = [(i, _signatures(t)) for i, t in docs]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    assert found == joined([i for i, _ in docs], links)


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    plan = spotsigs.with_next(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_nothing_is_inferred_from_the_range_of_an_id(spark):
    docs = spark.createDataFrame([(i, f"word{i} of text") for i in range(60)], "doc_id long, text string")
    found = spotsigs.with_next(docs, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "lambda" in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and "aggregate(" in line]
    assert {r.doc_id: r.next_text for r in found.collect()} == {i: f"word{(i - 1) % 60} of text" for i in range(60)}
