import random

import pytest
from brute import line_dedup, longest_line_runs

from plateview.llm import line_runs


def test_removal_matches_brute_force(spark):
    rng = random.Random(4)
    lines = [f"line {i}" for i in range(12)] + ["", "  "]
    docs = []
    for i in range(60):
        docs.append((100 - i, "\n".join(rng.choice(lines[: rng.choice([4, 14])]) for _ in range(rng.randint(0, 14)))))
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join(["same"] * 9)), (204, "\n".join(["same"] * 4))]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_removed int")
    found = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_runs.without_repeats(table).collect()}
    assert found == line_dedup(docs)


def test_ranks_order_suffixes_by_their_prefix(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "a\nb\nc\ne"), (3, "b\nc\nd"), (4, "x")], "doc_id long, text string")
    lines = line_runs.line_ids(docs)
    ids = {(r.doc, r.pos): r["rank"] for r in lines.collect()}
    levels = line_runs.suffix_levels(lines)
    assert len(levels) == 2
    for depth, places in ((1, [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2)]),
                          (2, [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1)])):
        ranked = levels[depth // 2].collect()
        assert sorted((r.doc, r.pos) for r in ranked) == places
        ordered = sorted(ranked, key=lambda r: (r["rank"], r.doc))
        prefixes = [tuple(ids[r.doc, r.pos + i] for i in range(depth)) for r in ordered]
        assert prefixes == sorted(prefixes) and len({r["rank"] for r in ranked}) == len(set(prefixes))


@pytest.mark.parametrize("seed", [1, 2])
def test_longest_runs_match_brute_force(spark, seed):
    """Lengths and first places of all runs, copies, nested copies and periods included."""
    rng = random.Random(seed)
    docs = [(i, "\n".join(rng.choice("abcd"[:rng.choice([1, 2, 4])]) for _ in range(rng.randint(1, 25)))) for i in range(30)]
    docs += [(100 + i, docs[rng.randrange(30)][1] + "\n" + docs[rng.randrange(30)][1]) for i in range(8)]
    docs += [(200, "\n".join("xy" * 21)), (201, "\n".join("z" * 40)), (202, "q\n" + "\n".join("z" * 23) + "\nq")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    levels = line_runs.suffix_levels(line_runs.line_ids(table))
    found = {(r.doc, r.pos): (r.n_lines, r["first"].doc, r["first"].pos) for r in line_runs.longest_repeats(levels).collect()}
    want = longest_line_runs(docs)
    assert found == want
    runs = {(r.doc, r.pos): (r.n_lines, r.first_doc, r.first_pos) for r in line_runs.repeated_runs(table).collect()}
    assert runs == {(i, p): w for (i, p), w in want.items() if w[0] >= 3 and not any(want.get((i, p - b), (0,))[0] >= w[0] + b for b in range(1, p + 1))}


def test_long_lines_go_alone(spark):
    long, half, short = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("a", 50), ("b", 25), ("c", 49)))
    docs = [(1, f"{long}\nx\n{half}\n{half}\ny\n{short}"), (2, f"k\n{long}\nl\n{half}\n{half}\nm\n{short}\nn\n{half}"), (3, long), (4, f"{long}\n{long}")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_runs.without_repeats(table).collect()}
    assert found == line_dedup(docs)
    assert found[2] == (9, 3, f"k\nl\nm\n{short}\nn\n{half}") and found[3] == (1, 1, "") and found[1][1] == 0


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    body = "a\nb\nc"
    rows = [(1, body), (1, body), (1, body + "\nd"), (None, body), (2, body)]
    found = [tuple(r) for r in line_runs.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    # Equal rows agree; of the two texts under id 1 the one with the smaller hash is first.
    same = [r for r in found if r[0] == 1 and r[2] == 3]
    assert len({r for r in same}) == 1 and len(found) == 5
    assert sum(r[3] for r in found if r[0] == 1) in (3, 6)
    assert sorted(str(r[1]) for r in found if r[0] != 1) == ["", ""]
    assert line_runs.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
