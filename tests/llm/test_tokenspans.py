import hashlib
import os
import random
from collections import Counter

import pytest

from plateview.llm import tokenspans

pytestmark = pytest.mark.skipif(not os.path.isdir(tokenspans.FOLDER), reason="the public tokenizers are not here")


def plain(text, tok):
    """Ids, groups as text and linked id pairs of one text, from whole-text tokens and decoded bytes alone."""
    if not text:
        return [], [], [], "", []
    raw = (" " + text).encode()
    a, b = tok.first.encode(" " + text, add_special_tokens=False).ids, tok.second.encode(text)
    if b"".join(tok.first_bytes[i] for i in a) != raw or b"".join(tok.second_bytes[i] for i in b) != raw:
        return [], [], [], "", []
    ends = []
    for ids, table in ((a, tok.first_bytes), (b, tok.second_bytes)):
        own = [0]
        for i in ids:
            own.append(own[-1] + len(table[i]))
        ends.append(own)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = []
    for low, high in zip(cuts, cuts[1:]):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, own[1:]) if low < e <= high) for ids, own in zip((a, b), ends)))
    links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b)
             if ends[0][i] < ends[1][j + 1] and ends[1][j] < ends[0][i + 1]]
    return a, b, groups, hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def wanted(docs, tok):
    each = [(i, *plain(t, tok)) for i, t in docs]
    count = Counter(pair for row in each for pair in row[5])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest)
                   for i, a, b, groups, digest, links in each), key=str)


def found(spark, docs, **more):
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, pair string")
    return sorted(map(tuple, tokenspans.aligned(table, **more).collect()), key=str)


ODD = ["", None, "héllo 日本 \U0001F600\n\n  a\tb <s> <|endoftext|>", "▁x", "a ▁ b", "日" * 50, "\x00a", "é", " ", "  a", "a  ", "a ",
       "\U0001F600\U0001F601x", "don't 'll x's <unk> <0x41>", "\n a\n  b \n", "a\u0085 b　 c  d", "word " * 3000]


def test_equals_whole_text_alignment(spark):
    tok = tokenspans.Tokenizers.load(tokenspans.FOLDER)
    rng = random.Random(3)
    letters = list("ab cd\n\t  é日本😀🏳️ ñß'’s  \x00\x85　.,!<>|_12")
    docs = list(enumerate(ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(200)]))
    docs += [(None, "no id here"), (7, "twice"), (7, "twice")]
    rows = found(spark, docs)
    assert rows == wanted(docs, tok)
    assert found(spark, docs, block_chars=100) == rows


def test_odd_tables(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert tokenspans.aligned(table).collect() == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_whole_given_table(spark):
    from plateview.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    docs = [(i, t) for i, t in docs]
    rows = QUERIES["op13_token_alignment"](spark, folder).collect()
    short = {i for i, t in docs if len(t or "") < 4000}
    tok = tokenspans.Tokenizers.load(tokenspans.FOLDER)
    counts = {}
    for i, t in docs:
        a, b, groups, digest, _ = plain(t, tok) if i in short else ([], [], [], None, [])
        counts[i] = (len(a), len(b), len(groups), digest)
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id in short:
            assert (r.n_a, r.n_b, r.n_groups, r.groups_sha256) == counts[r.doc_id]
        assert r.n_links == r.n_a + r.n_b - r.n_groups and 0 <= r.n_best <= r.n_links <= r.count_sum


def test_words_are_tokenized_alone(spark):
    tok = tokenspans.Tokenizers.load(tokenspans.FOLDER)
    for text in ODD:
        if text:
            words = tok.words(text)
            assert "".join(" " + w for w in words) == " " + text and all(words)
            assert [i for w in words for i in tok.first.encode(" " + w, add_special_tokens=False).ids] == tok.first.encode(" " + text, add_special_tokens=False).ids
            assert [i for w in words for i in tok.second.encode(w)] == tok.second.encode(text)
