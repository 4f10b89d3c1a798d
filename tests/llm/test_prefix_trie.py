import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from plateview.llm import prefix_trie
from plateview.llm.prefix_trie import Parentheses


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(conversations):
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below = {}
    for k in nodes:
        if k:
            below.setdefault(k[:-1], []).append(k)

    def words(k):
        return len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0

    def total(k):
        leaves, saved = (0, 0) if k in below else (1, 0)
        for b in below.get(k, []):
            x, y = total(b)
            leaves, saved = leaves + x, saved + y
        return leaves, saved + (len(nodes[k]) - 1) * words(k)

    out = []
    for k, members in nodes.items():
        leaves, saved = total(k)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(conversations[c]) == len(k)))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(below.get(k, [])), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    turns = prefix_trie.turn_digests(table)
    return sorted(map(tuple, prefix_trie.prefix_trie(*prefix_trie.with_borrowed_heads(turns), **more).collect()), key=str)


def _conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *rng.sample(range(-200, 0), 8), 1000, 1003, 2021]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "d\te f"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("layer, shard", [(4096, 400_000), (6, 6), (15, 40)])
def test_equals_brute_force(spark, layer, shard):
    rows = _conversations(4, 90) + [(None, 1, "user", "nobody's")] + [(700, t, "user", f"turn {t}") for t in range(40)]
    assert found(spark, rows, layer=layer, shard=shard) == brute(rebuilt(rows))


def test_common_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS", 8)
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(4)] + [(c, 0, "user", "same 0") for c in range(300, 340)]
    got = found(spark, rows, shard=10)
    assert got == brute(rebuilt(rows)) and len(got) <= 8


def test_odd_tables(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []
    alone = next(c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4)      # no base, and its first turns are dropped
    assert found(spark, [(alone, 1, "user", "x")]) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    long = [(40, t, None, "word " * 2000) for t in range(3)]
    assert found(spark, long) == brute(rebuilt(long))


def _random_tree(rng, n):
    bits, depth = [], 0
    while len(bits) < 2 * n:
        left = 2 * n - len(bits)
        if depth < left and (depth == 0 or rng.random() < 0.5):
            bits.append(1)
            depth += 1
        else:
            bits.append(0)
            depth -= 1
    return np.array(bits, np.int8)


@pytest.mark.parametrize("block", [2, 8, 64])
def test_findclose_and_ranks(block):
    rng = random.Random(block)
    for n in (1, 2, 5, 64, 500, 3000):
        for bits in (_random_tree(rng, n), np.array([1] * n + [0] * n, np.int8), np.array([1, 0] * n, np.int8)):
            tree, stack, close = Parentheses(bits, block), [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    close[stack.pop()] = i
            assert tree.findclose(tree.opens).tolist() == [close[i] for i in tree.opens]
            assert tree.rank_open[-1] == n and tree.rank_pair[-1] == sum(close[i] == i + 1 for i in close)
