"""Every corpus query over a whole small table: against its SQL, or against a plain restatement."""

import hashlib
import html as markup
import re

import pytest
from brute import contamination, line_dedup, near_components, secret_base
from compare import compare, database

from plateview.llm import langid
from plateview.llm.oracle import CHECKS
from plateview.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def _rows(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, database(FOLDER), QUERIES[name], CHECKS[name], FOLDER) == ""


def test_source_mix(spark):
    found = QUERIES["op1_source_mix"](spark, FOLDER).collect()
    documents = {i: (len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in _rows(spark, "documents", "doc_id", "text", "source")}
    assert {r.doc_id: r["size"] for r in found} == {i: n for i, (n, _) in documents.items()}
    names = sorted({s for _, s in documents.values()}, key=lambda s: (s is None, s or ""))
    words = {s: sum(n for n, x in documents.values() if x == s) for s in names}
    for s in names:
        own = [r for r in found if documents[r.doc_id][1] == s]
        assert all(r.source_size == words[s] for r in own) and len({r.target for r in own}) == 1
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(20, 0.05 * own[0].target)
        assert all(r.taken <= 3 * r["size"] for r in own)
    assert abs(sum(next(r.target for r in found if documents[r.doc_id][1] == s) for s in names) - sum(words.values())) < 1e-3


def test_spot_signatures(spark):
    documents = sorted(_rows(spark, "documents", "doc_id", "text"), key=lambda d: -d[0])
    found = {r.doc_id: r for r in QUERIES["op2_spot_signatures"](spark, FOLDER).collect()}
    assert len(found) == len(documents)
    edited_of, prints = {}, {}
    for i, (key, text) in enumerate(documents):
        text, after = text or "", documents[(i + 1) % len(documents)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        r = found[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        edited_of[key] = edited
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint

        def parts(p):
            return {p[j:j + 8] for j in range(0, len(p), 8)}

        a, b, c = parts(r.fingerprint), parts(r.edited_fingerprint), parts(found[documents[(i + 1) % len(documents)][0]].fingerprint)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert r.near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
    assert sum(r.near_edited > r.near_next for r in found.values()) > 0.9 * len(found)


def test_language_id(spark):
    truth = dict(_rows(spark, "documents", "doc_id", "lang"))
    found = QUERIES["op3_language_id"](spark, FOLDER).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r.held_out and truth[r.doc_id] is not None]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_main_text(spark):
    def article(page):
        inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
        texts = [" ".join(markup.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        return "\n".join(t for t in texts if t)

    pages = {i: article(h) for i, h in _rows(spark, "pages", "page_id", "html")}
    found = QUERIES["op5_main_text"](spark, FOLDER).collect()
    assert len(found) == len(pages) and all(r.n_chars == len(r.text) for r in found)
    assert sum(r.text == pages[r.page_id] for r in found) >= 0.95 * len(pages)


def test_secret_scan(spark):
    texts = dict(_rows(spark, "documents", "doc_id", "text"))
    found = QUERIES["op10_secret_scan"](spark, FOLDER).collect()
    assert len(found) == len(texts)
    for r in found:
        base = secret_base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(f"{k}:") for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert not base or set(base.split(",")) <= set(r.spans.split(","))
    assert sum(r.n_assign + r.n_access + r.n_hex for r in found) > 0


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        tables.append({r.doc_id: r for r in docs.collect()})
        if i < 4:
            assert docs.columns == columns
    known, lined, single, clean, mixed = tables
    texts = dict(_rows(spark, "documents", "doc_id", "text"))
    lettered = {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert set(known) <= lettered and len(known) >= 0.99 * len(lettered)
    want = {i: t for i, (lines, gone, t) in line_dedup([(i, r.text) for i, r in known.items()]).items() if gone == 0 or gone < lines}
    assert {i: r.text for i, r in lined.items()} == want and all(r.n_chars == len(r.text) for r in lined.values())
    least = near_components([(i, r.text) for i, r in lined.items()])
    assert set(single) == {i for i, j in least.items() if i == j}
    items = _rows(spark, "benchmark", "item_id", "text")
    assert set(clean) == {i for i, r in single.items() if not contamination(r.text, items)[1]}
    assert set(mixed) <= set(clean) and all(0 < r.taken <= 3 * r["size"] for r in mixed.values())
    for s in {r.source for r in clean.values()}:
        own = [r for r in mixed.values() if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(20, 0.12 * own[0].target)     # a source has about ten documents here
    final = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, final.collect())) == sorted(tuple(r) for r in mixed.values())


def test_pipeline_stages_keep_columns_of_any_name(spark):
    """Own columns with names that operators use inside stay as they are in every stage but the last."""
    import corpus_pipeline

    extra = ["n_words", "n_hit", "n_items", "spans", "items", "longest", "gone", "_doc", "_version", "n_lines", "n_removed", "score", "lang_pred",
             "_gone", "component_id", "n_shingles", "k1", "pattern", "size", "taken"]
    rows = [(i, f"line {i}\nshared line of words\nanother shared line\na third shared line\nword{i} more{i} text{i}", "en", "s", 10, *[100 * i + j for j in range(len(extra))])
            for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in extra))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns
        for r in kept.collect():
            assert [r[c] for c in extra] == [100 * r.doc_id + j for j in range(len(extra))]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).columns == ["doc_id", "source", "size", "target", "taken"]


def test_pipeline_stages_on_odd_tables(spark):
    """NULLs, empty texts, repeated rows, an extra column and an empty table pass through every stage."""
    import corpus_pipeline

    rows = [(1, "a b c d e f", "en", "s", 11, 1.0), (1, "a b c d e f", "en", "s", 11, 1.0), (2, None, None, None, None, None),
            (None, "x y z", "en", None, 5, None), (3, "", "en", "s", 0, 2.0), (4, "q " * 500, "de", "t", 1000, 3.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size double")
    for docs in (table, table.limit(0), table.filter("text is null")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER).collect()
            assert len(out) <= len(rows)
    assert langid.UNKNOWN == "und"
