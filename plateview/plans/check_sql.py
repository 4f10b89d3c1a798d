"""For each registered query, plain SQL over the given tables that must return the same rows.

The SQL is a second formulation for another engine: positions and windows instead of arrays,
brute force instead of histograms. It shares only the fixed values with the jobs.
"""

from __future__ import annotations

from plateview.operators import stems
from plateview.plans import inputs
from plateview.schemas import (DEFAULT_ASPECTS, DEFAULT_SYNONYMS, LABEL_NAMES, MAX_FEATURES, MAX_TOKENS, MISSING_MARKERS,
                               NO_ASPECTS_MESSAGE, NOT_DETECTED, SIMILARITY_THRESHOLD, STOP_WORDS)

# --- building blocks ------------------------------------------------------------------

_SPACE = r"[ \t\n\r\f\x0b\x1c-\x1f]"
_BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"[\pL\pN_]{2,}"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _sub(text: str, pattern: str, replacement: str = "' '") -> str:
    return f"regexp_replace({text}, {_q(pattern)}, {replacement}, 'g')"


def _squeeze(text: str) -> str:
    return f"trim({_sub(text, _SPACE + '+')})"


def _light(text: str) -> str:
    for pattern in [r"<[^>]+>", rf"(https?://[^{_BLANK}]+)|(www\.[^{_BLANK}]+)", r"@[\pL\pN_]+", r"[^\x00-\x7F]+"]:
        text = _sub(text, pattern)
    return _squeeze(text)


def _aggressive(text: str) -> str:
    text = f"lower({text})"
    for pattern in [rf"(https?://[^{_BLANK}]+)|(www\.[^{_BLANK}]+)", rf"[^{_BLANK}]*@[^{_BLANK}]*[{_BLANK}]?",
                    r"[^\x00-\x7F]+", r"[^A-Za-z0-9]"]:
        text = _sub(text, pattern)
    return _squeeze(text)


_STOP = "(" + ", ".join(_q(w) for w in STOP_WORDS) + ")"


def _letters(text: str) -> str:
    return f"regexp_extract_all(lower({_sub(text, '[^a-zA-Z]')}), '[a-z]+')"


def _classical(text: str) -> str:
    return f"array_to_string(list_filter({_letters(text)}, lambda t: t NOT IN {_STOP}), ' ')"


def _sentences(cleaned: str) -> str:
    marked = f"regexp_replace({cleaned}, '([.!?]){_SPACE}+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {_q(_WORD)})"


def _case(column: str, choices: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_q(k)} THEN {_q(v) if isinstance(v, str) else v}" for k, v in choices.items()) + " END"


def _with(*parts: str, final: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + final


# --- derived inputs -------------------------------------------------------------------

DOCS = "reviews AS (SELECT doc_id AS review_id, text FROM documents)"

ORDER_ROWS = f"""
order_rows AS (SELECT o_orderkey AS review_id, concat_ws(' ', {_case('o_orderstatus', inputs.STATUS_SENTENCES)},
    {_case('o_orderpriority', inputs.PRIORITY_SENTENCES)},
    (CASE WHEN o_totalprice > 100000 THEN {_q(inputs.DEAR_SENTENCE)} ELSE {_q(inputs.CHEAP_SENTENCE)} END) || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.',
    list_extract({_list(inputs.SEASON_SENTENCES)}, quarter(o_orderdate))) AS text,
  CASE WHEN o_custkey % 97 = 0 THEN 'Like' WHEN o_custkey % 89 <> 0 THEN
    CAST(CAST(3.0 AS DOUBLE) + CAST({_case('o_orderstatus', inputs.STATUS_STARS)} AS DOUBLE) + CAST({_case('o_orderpriority', inputs.PRIORITY_STARS)} AS DOUBLE) AS VARCHAR) END AS stars
  FROM orders)"""
ORDERS = ORDER_ROWS + ", reviews AS (SELECT review_id, text FROM order_rows)"
ORDER_RAW = "raw AS (SELECT review_id, text AS review, stars FROM order_rows)"
DOC_RAW = """
raw AS (SELECT d.doc_id AS review_id, d.text AS review,
  CASE WHEN l.quality IS NULL THEN CASE WHEN d.lang = 'en' THEN 'Like' END
       WHEN l.quality = 0 AND l.toxic = 1 THEN '1'
       WHEN l.quality = 0 THEN CASE WHEN d.n_chars % 2 = 0 THEN '1.5' ELSE '2.5' END
       WHEN l.toxic = 1 THEN '3'
       ELSE list_extract(['3.5', '4.5', '5'], d.n_chars % 3 + 1) END AS stars
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _label(rating: str) -> str:
    return f"CASE WHEN {rating} IN (1, 2) THEN 0 WHEN {rating} = 3 THEN 1 WHEN {rating} IN (4, 5) THEN 2 END"


RATINGS = f"""
rated AS (SELECT review_id, review, CAST(round_even(TRY_CAST(stars AS DOUBLE), 0) AS DOUBLE) AS rating
  FROM raw WHERE stars <> 'Like' AND review IS NOT NULL),
ratings AS (SELECT review_id, review, rating, {_label('rating')} AS label FROM rated
  QUALIFY row_number() OVER (PARTITION BY review ORDER BY review_id) = 1)"""


def _split(source: str, label: str, seed: int, held_out: float, kept: str, out: str, name: str) -> str:
    """Relation ``name`` with a column ``split``: a brute-force ranking of every class."""
    return f"""
{name}_sizes AS (SELECT {label} AS label, count(*) AS n FROM {source} GROUP BY ALL),
{name}_total AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) - ceil(CAST({held_out} AS DOUBLE) * sum(n)) AS BIGINT) AS stay FROM {name}_sizes),
{name}_shares AS (SELECT label, (n * stay) // total AS whole, (n * stay) % total AS part, stay FROM {name}_sizes, {name}_total),
{name}_quota AS (SELECT label, whole + CASE WHEN row_number() OVER (ORDER BY part DESC, label) <= stay - sum(whole) OVER () THEN 1 ELSE 0 END AS quota
  FROM {name}_shares),
{name} AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.{label} ORDER BY md5('{seed}:' || s.review_id) || ':' || s.review_id) <= q.quota
    THEN '{kept}' ELSE '{out}' END AS split FROM {source} s JOIN {name}_quota q ON s.{label} = q.label)"""


TWO_WAY = _split("ratings", "label", 42, 0.2, "train", "test", "divided")
THREE_WAY = ",".join([
    _split("ratings", "label", 42, 0.2, "train", "test", "outer_split"),
    "inner_rows AS (SELECT * EXCLUDE (split) FROM outer_split WHERE split = 'train')",
    _split("inner_rows", "label", 43, 0.1, "train", "validation", "inner_split"),
    "divided AS (SELECT review_id, label, split FROM inner_split UNION ALL SELECT review_id, label, split FROM outer_split WHERE split = 'test')",
])

_PLAIN_WORD = r"'s\b"
_TERM_TOKEN = r"[a-z0-9]+(?:'[a-z0-9]+)*|[^a-z0-9 ]+"


def _masked(source: str, prefix: str = "") -> str:
    """Content words with their positions; NULL where a phrase ends."""
    return f"""
{prefix}cleaned AS (SELECT review_id, {_light('text')} AS cleaned FROM {source}),
{prefix}tokens AS (SELECT review_id, regexp_extract_all({_sub('lower(cleaned)', _PLAIN_WORD)}, {_q(_TERM_TOKEN)}) AS ts FROM {prefix}cleaned),
{prefix}placed AS (SELECT review_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM {prefix}tokens),
{prefix}masked AS (SELECT review_id, pos, CASE WHEN regexp_full_match(t, '[a-z]+') AND t NOT IN {_STOP} THEN t END AS w FROM {prefix}placed),
{prefix}singles AS (SELECT DISTINCT review_id, w AS term FROM {prefix}masked WHERE w IS NOT NULL)"""


PHRASES = """
following AS (SELECT review_id, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM masked WINDOW p AS (PARTITION BY review_id ORDER BY pos)),
phrases AS (SELECT DISTINCT review_id, term FROM (
  SELECT review_id, w AS term FROM following UNION ALL
  SELECT review_id, w || ' ' || w1 FROM following UNION ALL
  SELECT review_id, w || ' ' || w1 || ' ' || w2 FROM following) WHERE term IS NOT NULL)"""

CORPUS_LEXICON = f"""
lexicon AS (SELECT term, list_extract({_list(DEFAULT_ASPECTS)}, CAST((rank - 1) % 7 AS INTEGER) + 1) AS aspect, CAST((rank - 1) % 7 AS INTEGER) AS ord
  FROM (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS rank FROM singles WHERE length(term) >= {inputs.LEXICON_MIN_LENGTH} GROUP BY term)
  WHERE rank <= {inputs.LEXICON_SIZE})"""


def _default_lexicon(chosen: list[str], name: str = "lexicon") -> str:
    owner = {t: a for a, ts in DEFAULT_SYNONYMS.items() if a in chosen for t in ts}
    rows = ", ".join(f"({_q(t)}, {_q(a)}, {chosen.index(a)})" for t, a in owner.items())
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS v(term, aspect, ord))"


DEFAULT_LEXICON = _default_lexicon(DEFAULT_ASPECTS)


def _found(lexicon: str = "lexicon", name: str = "found", terms: str = "phrases") -> str:
    return f"""{name} AS (SELECT review_id, ord, aspect, list_sort(list(DISTINCT term)) AS forms FROM {terms} JOIN {lexicon} USING (term) GROUP BY ALL)"""


def _contexts(mode: str = "sentence", found: str = "found", name: str = "contexts") -> str:
    if mode == "full_review":
        pick = f"{name}_all AS (SELECT *, sentences AS evidence, cleaned AS context FROM {name}_base)"
    else:
        pick = f"""{name}_hits AS (SELECT *, list_filter(sentences, lambda s: len(list_filter(forms, lambda f: contains(lower(s), f))) > 0) AS m FROM {name}_base),
{name}_all AS (SELECT *, CASE WHEN len(m) > 0 THEN m ELSE sentences END AS evidence, array_to_string(CASE WHEN len(m) > 0 THEN m ELSE sentences END, ' ') AS context FROM {name}_hits)"""
    return f"""
{name}_base AS (SELECT f.review_id, f.ord, f.aspect, f.forms, c.cleaned, {_sentences('c.cleaned')} AS sentences FROM {found} f JOIN cleaned c USING (review_id)),
{pick},
{name} AS (SELECT review_id, ord, aspect, forms, evidence, context FROM {name}_all)"""


def _weights(source: str) -> str:
    """Class weights ``w`` and priors ``p`` from a relation with review and label."""
    return f"""
nb_texts AS (SELECT review_id, label, {_words(_light('review'))} AS ts FROM {source}),
nb_tokens AS (SELECT review_id, label, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM nb_texts),
nb_pairs AS (SELECT label, t, lead(t) OVER (PARTITION BY review_id ORDER BY pos) AS nx FROM nb_tokens),
nb_terms AS (SELECT label, t AS term FROM nb_pairs UNION ALL SELECT label, t || ' ' || nx FROM nb_pairs WHERE nx IS NOT NULL),
nb_counts AS (SELECT term, count(*) AS tf, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 2) AS n2
  FROM nb_terms GROUP BY term),
nb_sums AS (SELECT CAST(count(*) AS DOUBLE) AS v, CAST(sum(n0) AS DOUBLE) AS s0, CAST(sum(n1) AS DOUBLE) AS s1, CAST(sum(n2) AS DOUBLE) AS s2 FROM nb_counts),
w AS (SELECT term, tf, ln(CAST(n0 + 1 AS DOUBLE) / (s0 + v)) AS lw0, ln(CAST(n1 + 1 AS DOUBLE) / (s1 + v)) AS lw1, ln(CAST(n2 + 1 AS DOUBLE) / (s2 + v)) AS lw2
  FROM nb_counts, nb_sums),
p AS (SELECT ln(CAST(count(*) FILTER (label = 0) + 1 AS DOUBLE) / (count(*) + 3)) AS p0, ln(CAST(count(*) FILTER (label = 1) + 1 AS DOUBLE) / (count(*) + 3)) AS p1,
  ln(CAST(count(*) FILTER (label = 2) + 1 AS DOUBLE) / (count(*) + 3)) AS p2 FROM {source})"""


def _scored(contexts: str = "contexts", keys: str = "review_id, ord, aspect", name: str = "scored") -> str:
    """``keys, class_id, confidence``: distance to the nearest mention found by looking both ways."""
    return f"""
{name}_t AS (SELECT {keys}, forms, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (SELECT {keys}, forms, {_words('context')} AS ts FROM {contexts})),
{name}_m AS (SELECT {keys}, t, pos, lead(t) OVER o AS nx,
    max(hit) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
    min(hit) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind
  FROM (SELECT *, CASE WHEN list_contains(string_split(array_to_string(forms, ' '), ' '), t) THEN pos END AS hit FROM {name}_t)
  WINDOW o AS (PARTITION BY {keys} ORDER BY pos)),
{name}_w AS (SELECT {keys}, t, nx, CASE WHEN before IS NULL AND behind IS NULL THEN CAST(1 AS DOUBLE)
    ELSE CAST(1 AS DOUBLE) / (1 + least(coalesce(pos - before, 1000000000), coalesce(behind - pos, 1000000000))) END AS wt FROM {name}_m),
{name}_g AS (SELECT {keys}, t AS term, wt FROM {name}_w UNION ALL SELECT {keys}, t || ' ' || nx, wt FROM {name}_w WHERE nx IS NOT NULL),
{name}_s AS (SELECT {keys}, sum(wt) AS total, sum(wt * lw0) AS s0, sum(wt * lw1) AS s1, sum(wt * lw2) AS s2 FROM {name}_g JOIN w USING (term) GROUP BY ALL),
{name}_z AS (SELECT c.*, round((p0 + coalesce(s0, 0)) / (1 + coalesce(total, 0)), 9) AS z0, round((p1 + coalesce(s1, 0)) / (1 + coalesce(total, 0)), 9) AS z1,
    round((p2 + coalesce(s2, 0)) / (1 + coalesce(total, 0)), 9) AS z2 FROM {contexts} c LEFT JOIN {name}_s USING ({keys}), p),
{name} AS (SELECT *, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS class_id,
    round(1 / (exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))), 4) AS confidence FROM {name}_z)"""


def _class_name(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in LABEL_NAMES.items()) + " END"


def _capital(column: str) -> str:
    return f"upper(left({column}, 1)) || lower(substr({column}, 2))"


DOC_TERMS = [DOCS, _masked("reviews"), PHRASES]
DOC_FOUND = [*DOC_TERMS, CORPUS_LEXICON, _found()]
ORDER_TERMS = [ORDERS, _masked("reviews"), PHRASES]
ORDER_FOUND = [*ORDER_TERMS, DEFAULT_LEXICON, _found()]
DOC_SCORED = [*DOC_FOUND, _contexts(), DOC_RAW, RATINGS, _weights("ratings"), _scored()]
ORDER_SCORED = [*ORDER_FOUND, _contexts(), ORDER_RAW, RATINGS, _weights("ratings"), _scored()]

TOKEN_VECTORS = """
spots AS (SELECT DISTINCT term AS token, CAST('0x' || substr(md5(term), 1, 7) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id FROM singles),
vectors AS (SELECT token, CAST(embedding AS DOUBLE[]) AS vec FROM spots JOIN embeddings USING (vec_id)),
lengths AS (SELECT token, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS norm FROM vectors)"""
ASPECT_WORDS = "names AS (SELECT ord, min(term) AS aspect FROM lexicon GROUP BY ord)"


def _nearest(terms: str) -> str:
    return f"""
likeness AS (SELECT t.term, n.ord, n.aspect, round(list_cosine_similarity(tv.vec, av.vec), 9) AS score
  FROM (SELECT DISTINCT term FROM {terms}) t JOIN lengths tv ON tv.token = t.term CROSS JOIN names n JOIN lengths av ON av.token = n.aspect WHERE tv.norm > 0 AND av.norm > 0),
nearest AS (SELECT term, ord, aspect, score FROM likeness QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, ord) = 1)"""


DOC_NEAREST = [*DOC_TERMS[:2], CORPUS_LEXICON, TOKEN_VECTORS, ASPECT_WORDS, _nearest("singles")]

LEMMAS = """
bare AS (SELECT DISTINCT term AS token FROM singles),
cuts AS (
  SELECT token, 3 AS cut, regexp_replace(token, 'ies$', 'y') AS lemma FROM bare WHERE regexp_matches(token, '..ies$') UNION ALL
  SELECT token, 2, regexp_replace(token, 'es$', '') FROM bare WHERE regexp_matches(token, '(s|x|z|ch|sh|o)es$') UNION ALL
  SELECT token, 1, regexp_replace(token, 's$', '') FROM bare WHERE regexp_matches(token, '[^su]s$')),
lemmas AS (SELECT token, lemma FROM cuts WHERE length(lemma) >= 3 AND lemma IN (SELECT token FROM bare)
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY cut DESC, lemma DESC) = 1),
lemma_of AS (SELECT token AS raw, coalesce(lemma, token) AS term FROM bare LEFT JOIN lemmas USING (token))"""

FULL_FOUND = [*DOC_TERMS[:2], CORPUS_LEXICON, TOKEN_VECTORS, ASPECT_WORDS, LEMMAS,
              "rest AS (SELECT DISTINCT term FROM lemma_of WHERE term NOT IN (SELECT term FROM lexicon))", _nearest("rest"), f"""
matched AS (SELECT term, ord, aspect FROM lexicon UNION ALL SELECT term, ord, aspect FROM nearest WHERE score >= {SIMILARITY_THRESHOLD}),
dictionary AS (SELECT raw, term, ord, aspect FROM lemma_of JOIN matched USING (term)),
mentions AS (SELECT s.review_id, d.ord, d.aspect, unnest([d.raw, d.term]) AS form FROM singles s JOIN dictionary d ON s.term = d.raw),
found AS (SELECT review_id, ord, aspect, list_sort(list(DISTINCT form)) AS forms FROM mentions GROUP BY ALL)"""]

TEXTS = """texts AS (SELECT 'documents' AS src, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL
  SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages UNION ALL
  SELECT 'conversations', conv_id || ':' || turn, text FROM conversations)"""


def _hash_texts(expression: str) -> str:
    return _with(TEXTS, f"cleaned AS (SELECT src, id, {expression} AS t FROM texts)",
                 final="SELECT src, id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars FROM cleaned")


# --- learned sentence boundaries --------------------------------------------------------

_FEW, _MANY = "CAST(1e-9 AS DOUBLE)", "(1 - CAST(1e-9 AS DOUBLE))"


def _fit(hits: str, misses: str, share: str) -> str:
    share = f"least(greatest({share}, {_FEW}), {_MANY})"
    return f"(({hits}) * ln({share}) + ({misses}) * ln(1 - {share}))"


TYPED = f"""
clean_docs AS (SELECT review_id, {_light('text')} AS cleaned FROM reviews WHERE text IS NOT NULL),
pieces AS (SELECT review_id, unnest(string_split(cleaned, ' ')) AS t, generate_subscripts(string_split(cleaned, ' '), 1) AS pos FROM clean_docs),
bared AS (SELECT *, regexp_replace(lower(t), '^[^a-z0-9]+|[^a-z0-9.]+$', '', 'g') AS bare, regexp_extract(t, '([.!?])["'')\\]}}]*$', 1) AS mark,
  regexp_matches(t, '^[^A-Za-z0-9]*[A-Z]') AS up, regexp_matches(t, '^[^A-Za-z0-9]*[a-z]') AS low FROM pieces),
typed AS (SELECT *, CASE WHEN regexp_full_match(rtrim(bare, '.'), '[a-z]+(?:[.-][a-z]+)*') THEN rtrim(bare, '.') ELSE '' END AS type,
  bare LIKE '%.' AND bare NOT LIKE '%..' AS period FROM bared),
period_counts AS (SELECT type, count(*) FILTER (period) AS n_period, count(*) FILTER (NOT period) AS n_plain FROM typed WHERE type <> '' GROUP BY type),
period_share AS (SELECT CAST(sum(n_period) AS DOUBLE) / CAST(sum(n_period + n_plain) AS DOUBLE) AS share FROM period_counts),
scores AS (SELECT *, ratio * exp(-CAST(letters AS DOUBLE)) * (length(type) - letters + 1) * pow(CAST(letters AS DOUBLE), -CAST(n_plain AS DOUBLE)) AS score FROM (
  SELECT type, n_period, n_plain, length(replace(type, '.', '')) AS letters,
    2 * ({_fit('n_period', 'n_plain', 'CAST(0.99 AS DOUBLE)')} - {_fit('n_period', 'n_plain', 'share')}) AS ratio
  FROM period_counts, period_share WHERE n_period > 0)),
short AS (SELECT type FROM scores WHERE score >= 0.3)"""

STARTERS = f"""
certain AS (SELECT *, mark IN ('!', '?') OR (mark = '.' AND length(type) > 1 AND period AND type NOT IN (SELECT type FROM short)) AS ended FROM typed),
led AS (SELECT type, coalesce(lag(ended) OVER (PARTITION BY review_id ORDER BY pos), false) AS after FROM certain),
start_counts AS (SELECT type, count(*) FILTER (after) AS n_after, count(*) AS n FROM led WHERE type <> '' GROUP BY type),
start_total AS (SELECT CAST(sum(n_after) AS DOUBLE) AS b, CAST(sum(n) AS DOUBLE) AS total FROM start_counts),
start_ratios AS (SELECT type, n_after, n, 2 * ({_fit('n_after', 'b - n_after', 'n_after / b')} + {_fit('n - n_after', 'total - b - (n - n_after)', '(n - n_after) / greatest(total - b, 1)')}
    - {_fit('n_after', 'b - n_after', 'n / total')} - {_fit('n - n_after', 'total - b - (n - n_after)', 'n / total')}) AS ratio
  FROM start_counts, start_total WHERE n_after > 0 AND n_after / b > n / total),
starters AS (SELECT type FROM start_ratios WHERE ratio >= 30 AND type NOT IN (SELECT type FROM short)
  QUALIFY row_number() OVER (ORDER BY round(ratio, 6) DESC, type) <= 1000)"""

LEARNED = """
looked AS (SELECT *, lead(up) OVER w AS n_up, lead(low) OVER w AS n_low, lead(type) OVER w AS n_type FROM typed WINDOW w AS (PARTITION BY review_id ORDER BY pos)),
cuts AS (SELECT review_id, pos, t, CASE WHEN mark IN ('!', '?') THEN true WHEN mark <> '.' THEN false WHEN NOT period OR type = '' THEN NOT n_low
    WHEN length(type) = 1 THEN false WHEN type IN (SELECT type FROM short) THEN n_up AND n_type IN (SELECT type FROM starters) ELSE true END AS cut FROM looked),
parts AS (SELECT review_id, pos, t, coalesce(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY review_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM cuts),
whole_sentences AS (SELECT review_id, part, trim(string_agg(t, ' ' ORDER BY pos)) AS sentence FROM parts GROUP BY review_id, part)"""

RAKE = """
runs AS (SELECT review_id, pos, w, sum(CASE WHEN w IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY review_id ORDER BY pos) AS run FROM masked),
sized AS (SELECT *, count(*) OVER (PARTITION BY review_id, run) AS n FROM runs WHERE w IS NOT NULL),
degrees AS (SELECT review_id, w, CAST(sum(n) AS DOUBLE) / count(*) AS score FROM sized GROUP BY review_id, w),
said AS (SELECT s.review_id, run, string_agg(s.w, ' ' ORDER BY pos) AS phrase, round(sum(d.score), 6) AS score
  FROM sized s JOIN degrees d ON d.review_id = s.review_id AND d.w = s.w GROUP BY s.review_id, run),
rated AS (SELECT review_id, phrase, max(score) AS score, count(*) AS n FROM said GROUP BY review_id, phrase)"""

RULES = """
examples AS (SELECT raw AS token, term AS lemma FROM lemma_of WHERE substr(md5(raw), 1, 1) NOT IN ('0', '1', '2', '3')),
common AS (SELECT token, lemma, max(CASE WHEN left(token, n) = left(lemma, n) THEN n ELSE 0 END) AS same
  FROM (SELECT token, lemma, unnest(range(0, least(length(token), length(lemma)) + 1)) AS n FROM examples) GROUP BY token, lemma),
edits AS (SELECT token, length(token) - same AS cut, substr(lemma, same + 1) AS add FROM common),
ended AS (SELECT cut, add, right('^' || token, n) AS ending FROM (
  SELECT token, cut, add, unnest(range(greatest(cut, 1), least(length(token) + 1, 6) + 1)) AS n FROM edits)),
rules AS (SELECT ending, cut, add, n FROM (SELECT ending, cut, add, count(*) AS n FROM ended GROUP BY ending, cut, add) WHERE n >= 2
  QUALIFY row_number() OVER (PARTITION BY ending ORDER BY n DESC, cut, add DESC) = 1)"""

RULED = """
tried AS (SELECT b.token, r.cut, r.add, b.n FROM (SELECT token, unnest(range(1, least(length(token) + 1, 6) + 1)) AS n FROM bare) b
  JOIN rules r ON r.ending = right('^' || b.token, b.n) QUALIFY row_number() OVER (PARTITION BY b.token ORDER BY b.n DESC) = 1),
ruled AS (SELECT b.token, left(b.token, length(b.token) - cut) || add AS made FROM bare b LEFT JOIN tried t ON t.token = b.token)"""

LONG_TERMS = f"""
item_tokens AS (SELECT regexp_extract_all({_sub("lower(" + _light('text') + ")", _PLAIN_WORD)}, {_q(_TERM_TOKEN)}) AS ts FROM benchmark),
item_runs AS (SELECT trim(unnest(string_split(array_to_string(list_transform(ts, lambda t: CASE WHEN regexp_matches(t, '^[a-z0-9]') THEN t ELSE '|' END), ' '), '|'))) AS run FROM item_tokens),
long_terms AS (SELECT DISTINCT array_to_string(string_split(run, ' ')[1:20], ' ') AS term FROM item_runs WHERE run <> ''),
joined_docs AS (SELECT review_id, ' ' || array_to_string(list_transform(ts, lambda t: CASE WHEN regexp_matches(t, '^[a-z0-9]') THEN t ELSE '|' END), ' ') || ' ' AS j FROM tokens),
long_found AS (SELECT review_id, length(term) % 7 AS ord, list_sort(list(term)) AS forms FROM joined_docs JOIN long_terms ON contains(j, ' ' || term || ' ') GROUP BY ALL)"""


# --- metrics --------------------------------------------------------------------------

def _metric_rows(pairs: str, labels: str | None = None) -> str:
    """``m``: a row per class, from a relation (y_true, y_pred, n)."""
    spine = labels or f"SELECT y_true AS label FROM {pairs} UNION SELECT y_pred FROM {pairs}"
    return f"""
spine AS ({spine}),
m AS (SELECT label, support, predicted, hits,
    CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
    CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f1
  FROM (SELECT label, CAST(coalesce((SELECT sum(n) FROM {pairs} WHERE y_true = label), 0) AS DOUBLE) AS support,
    CAST(coalesce((SELECT sum(n) FROM {pairs} WHERE y_pred = label), 0) AS DOUBLE) AS predicted,
    CAST(coalesce((SELECT sum(n) FROM {pairs} WHERE y_true = label AND y_pred = label), 0) AS DOUBLE) AS hits FROM spine))"""


_HEADLINE = """SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
  CAST(sum(support) AS BIGINT) AS n FROM m"""


def _report(title: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY label) - 1 AS ord, {title} AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT count(*), 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT count(*) + 1, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT count(*) + 2, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM m"""


_LABELS = "SELECT unnest([0, 1, 2]) AS label"

BAYES_TEST = [DOC_RAW, RATINGS, TWO_WAY, "train_rows AS (SELECT * FROM divided WHERE split = 'train')", _weights("train_rows"),
              f"whole AS (SELECT review_id, label AS y_true, CAST([] AS VARCHAR[]) AS forms, {_light('review')} AS context FROM divided WHERE split = 'test')",
              _scored("whole", "review_id")]
BAYES_PAIRS = [*BAYES_TEST, "pairs AS (SELECT y_true, class_id AS y_pred, count(*) AS n FROM scored GROUP BY ALL)"]

_GOLD_LABEL = "CASE WHEN TRY_CAST(stars AS DOUBLE) < 2.5 THEN 'Negative' WHEN TRY_CAST(stars AS DOUBLE) > 3.5 THEN 'Positive' ELSE 'Neutral' END"
GOLD = [ORDER_ROWS, "reviews AS (SELECT min(review_id) AS review_id, text FROM order_rows GROUP BY text)", _masked("reviews"), PHRASES, DEFAULT_LEXICON, _found(),
        _contexts(), ORDER_RAW, RATINGS, _weights("ratings"), _scored(), f"""
gold AS (SELECT text, list_extract({_list(DEFAULT_ASPECTS)}, CAST(review_id % 7 AS INTEGER) + 1) AS aspect, {_GOLD_LABEL} AS y_true FROM order_rows),
pairs AS (SELECT g.y_true, coalesce({_class_name('s.class_id')}, {_q(NOT_DETECTED)}) AS y_pred, count(*) AS n
  FROM gold g JOIN reviews r USING (text) LEFT JOIN scored s ON s.review_id = r.review_id AND s.aspect = g.aspect GROUP BY ALL)"""]


# --- stems ----------------------------------------------------------------------------

def _stem_sql() -> str:
    """The stemming steps as a chain of relations (word, w, shape)."""
    shape = ("list_reduce(list_prepend('', string_split(w, '')), lambda acc, ch: acc || CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') THEN 'v' "
             "WHEN ch = 'y' AND right(acc, 1) = 'c' THEN 'v' ELSE 'c' END)")

    def stem(n): return f"left(w, length(w) - {n})"

    def form(n): return f"left(shape, length(w) - {n})"

    def holds(condition, n):
        return {None: "true", "m>0": f"contains({form(n)}, 'vc')", "m+l>0": f"contains({form(n - 1)}, 'vc')",
                "m>1": f"regexp_matches({form(n)}, 'vc+v+c')",
                "m>1 after s or t": f"(regexp_matches({form(n)}, 'vc+v+c') AND regexp_matches({stem(n)}, '[st]$'))"}[condition]

    def rules(table):
        whens = " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {holds(c, len(s))} THEN {stem(len(s))} || '{r}' ELSE w END" for s, r, c in table)
        return f"CASE {whens} ELSE w END"

    def closed(word, shp):
        return f"((regexp_matches({shp}, 'cvc$') AND NOT regexp_matches({word}, '[wxy]$')) OR {shp} = 'vc')"

    def tidy(n):
        a, b = stem(n), form(n)
        return (f"CASE WHEN NOT contains({b}, 'v') THEN w WHEN regexp_matches({a}, '(at|bl|iz)$') THEN {a} || 'e' "
                f"WHEN regexp_matches({a}, '(bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|zz)$') THEN CASE WHEN regexp_matches({a}, '[lsz]$') THEN {a} ELSE {stem(n + 1)} END "
                f"WHEN regexp_matches({b}, '^c*v+c+v*$') AND {closed(a, b)} THEN {a} || 'e' ELSE {a} END")

    steps = [
        f"CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN {stem(3)} || 'ie' ELSE {rules(stems.STEP_1A)} END",
        f"CASE WHEN ends_with(w, 'ied') THEN {stem(3)} || CASE WHEN length(w) = 4 THEN 'ie' ELSE 'i' END "
        f"WHEN ends_with(w, 'eed') THEN CASE WHEN {holds('m>0', 3)} THEN {stem(1)} ELSE w END WHEN ends_with(w, 'ed') THEN {tidy(2)} WHEN ends_with(w, 'ing') THEN {tidy(3)} ELSE w END",
        f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND ends_with({form(1)}, 'c') THEN {stem(1)} || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, 'alli') AND {holds('m>0', 4)} THEN {stem(2)} ELSE w END",
        rules(stems.STEP_2), rules(stems.STEP_3), rules(stems.STEP_4),
        f"CASE WHEN ends_with(w, 'e') AND ({holds('m>1', 1)} OR (contains({form(1)}, 'vc') AND NOT {closed(stem(1), form(1))})) THEN {stem(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {holds('m>1', 1)} THEN {stem(1)} ELSE w END",
    ]
    chain = ["step0 AS (SELECT word, word AS w FROM words)"]
    for i, step in enumerate(steps):
        chain.append(f"shaped{i} AS (SELECT word, w, {shape} AS shape FROM step{i})")
        chain.append(f"step{i + 1} AS (SELECT word, {step} AS w FROM shaped{i})")
    chain.append(f"stemmed AS (SELECT word, CASE {' '.join(f'WHEN word = {_q(k)} THEN {_q(v)}' for k, v in stems.IRREGULAR.items())} "
                 f"WHEN length(word) <= 2 THEN word ELSE w END AS stem FROM step{len(steps)})")
    return ",\n".join(chain)


# --- the checks -----------------------------------------------------------------------

_FORMS_OUT = "SELECT review_id, aspect, array_to_string(forms, '|') AS surface_forms FROM found"
_CONTEXT_OUT = "SELECT review_id, aspect, CAST(len(evidence) AS BIGINT) AS n_evidence, md5(context) AS context_md5 FROM contexts"
_FLAGSHIP_OUT = f"SELECT review_id, aspect, {_class_name('class_id')} AS label, confidence, CAST(len(evidence) AS BIGINT) AS n_evidence FROM scored"
_QUALITATIVE = f"SELECT review_id, aspect, {_class_name('class_id')} AS predicted_label, confidence, {{0}} AS evidence FROM scored"
_CENTROIDS = """
parts AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
centroids AS (SELECT label AS ord, list(x ORDER BY d) AS vec FROM (SELECT label, d, avg(x) AS x FROM parts GROUP BY ALL) GROUP BY label),
near AS (SELECT e.vec_id, e.label, c.ord, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.vec), 9) AS score FROM embeddings e CROSS JOIN centroids c
  QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.vec), 9) DESC, c.ord) = 1)"""

_TFIDF_TERMS = f"""
raw_tokens AS (SELECT review_id, split, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (SELECT review_id, split, {_words('review')} AS ts FROM divided)),
raw_pairs AS (SELECT review_id, split, t, lead(t) OVER (PARTITION BY review_id ORDER BY pos) AS nx FROM raw_tokens),
grams AS (SELECT review_id, split, t AS term FROM raw_pairs UNION ALL SELECT review_id, split, t || ' ' || nx FROM raw_pairs WHERE nx IS NOT NULL),
vocab AS (SELECT term, CAST(count(*) AS BIGINT) AS tf, count(DISTINCT review_id) AS df FROM grams WHERE split = 'train' GROUP BY term ORDER BY tf DESC, term LIMIT {MAX_FEATURES})"""

_CLASSES = range(3)


def _each(form: str) -> str:
    return ", ".join(form.format(c=c) for c in _CLASSES)


FEATS = """
fitted AS (SELECT term, ln(CAST(1 + (SELECT count(*) FROM divided WHERE split = 'train') AS DOUBLE) / (1 + df)) + 1 AS idf FROM vocab),
weighed AS (SELECT review_id, term, count(*) * any_value(idf) AS x FROM grams JOIN fitted USING (term) GROUP BY review_id, term),
feats AS MATERIALIZED (SELECT d.review_id, split, label, term, x FROM divided d JOIN (
    SELECT review_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY review_id)) AS x FROM weighed
    UNION ALL SELECT review_id, '', CAST(1 AS DOUBLE) FROM divided) f ON f.review_id = d.review_id),
size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM divided WHERE split = 'train')"""


def _step_model(steps: int, strength: float, p: str) -> str:
    """Relation ``{p}model(term, w0, w1, w2)`` after accelerated gradient steps over the training rows of ``feats``."""
    out = [f"""{p}rate AS (SELECT n, 1 / (CAST({strength} AS DOUBLE) * n) AS penalty, 1 / (1 + 1 / (CAST({strength} AS DOUBLE) * n)) AS step FROM size),
{p}m0 AS MATERIALIZED (SELECT term, {_each('CAST(0 AS DOUBLE) AS w{c}')}, {_each('CAST(0 AS DOUBLE) AS v{c}')} FROM (SELECT term FROM vocab UNION ALL SELECT ''))"""]
    for k in range(steps):
        ahead = f"(CAST({k} AS DOUBLE) / {k + 3})"
        out.append(f"""
{p}z{k} AS MATERIALIZED (SELECT review_id, any_value(label) AS label, {_each('sum(x * v{c}) AS z{c}')} FROM feats JOIN {p}m{k} USING (term) WHERE split = 'train' GROUP BY review_id),
{p}r{k} AS MATERIALIZED (SELECT review_id, {_each('exp(z{c} - t) / s - CASE WHEN label = {c} THEN 1 ELSE 0 END AS r{c}')} FROM (
  SELECT *, {' + '.join(f'exp(z{c} - t)' for c in _CLASSES)} AS s FROM (SELECT *, greatest(z0, z1, z2) AS t FROM {p}z{k}))),
{p}g{k} AS MATERIALIZED (SELECT term, {_each('sum(x * r{c}) AS g{c}')} FROM feats JOIN {p}r{k} USING (review_id) WHERE split = 'train' GROUP BY term),
{p}m{k + 1} AS MATERIALIZED (SELECT term, {_each('u{c} AS w{c}')}, {_each(f'u{{c}} + {ahead} * (u{{c}} - w{{c}}) AS v{{c}}')} FROM (
  SELECT m.*, {_each("v{c} - step * (coalesce(g{c}, 0) / n + CASE WHEN term = '' THEN 0 ELSE penalty END * v{c}) AS u{c}")}
  FROM {p}m{k} m LEFT JOIN {p}g{k} USING (term), {p}rate))""")
    return ",".join([*out, f"\n{p}model AS (SELECT term, {_each('w{c}')} FROM {p}m{steps})"])


def _step_pairs(part: str, p: str) -> str:
    """Relation ``{p}pairs(y_true, y_pred, n)`` on a part of the split."""
    return f"""
{p}judged AS (SELECT review_id, any_value(label) AS y_true, {_each('round(sum(x * w{c}), 9) AS z{c}')} FROM feats JOIN {p}model USING (term) WHERE split = '{part}' GROUP BY review_id),
{p}pairs AS (SELECT y_true, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS y_pred, count(*) AS n FROM {p}judged GROUP BY ALL)"""


def _step_headline(strength: float, p: str) -> str:
    rows = _metric_rows(f"{p}pairs").replace("spine AS", f"{p}spine AS").replace("FROM spine", f"FROM {p}spine").replace("\nm AS", f"\n{p}m AS")
    return f"""{rows},
{p}tried AS (SELECT CAST({strength} AS DOUBLE) AS strength, sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM {p}m)"""


_STRENGTHS = {"a": 0.03, "b": 0.3, "c": 3.0}
THREE_PARTS = THREE_WAY.replace("divided AS", "three_parts AS") + """,
divided AS (SELECT t.review_id, t.label, t.split, r.review FROM three_parts t JOIN ratings r ON r.review_id = t.review_id)"""

CHECKS: dict[str, str] = {
    "clean_light": _hash_texts(_light("text")),
    "clean_aggressive": _hash_texts(_aggressive("text")),
    "clean_classical": _hash_texts(_classical("text")),
    "clean_classical_stemmed": _with(
        f"tokens AS (SELECT doc_id, unnest(ts) AS word, generate_subscripts(ts, 1) AS pos FROM (SELECT doc_id, list_filter({_letters('text')}, lambda t: t NOT IN {_STOP}) AS ts FROM documents))",
        "words AS (SELECT DISTINCT word FROM tokens)", _stem_sql(),
        "joined AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS t FROM tokens JOIN stemmed USING (word) GROUP BY doc_id)",
        final="SELECT d.doc_id AS review_id, md5(coalesce(t, '')) AS text_md5 FROM documents d LEFT JOIN joined USING (doc_id)"),
    "stem_vocabulary": _with(f"words AS (SELECT DISTINCT unnest({_letters('text')}) AS word FROM documents)", _stem_sql(),
                             final="SELECT word, stem FROM stemmed"),
    "sentences": _with(f"s AS (SELECT doc_id, {_sentences('cleaned')} AS ss FROM (SELECT doc_id, {_light('text')} AS cleaned FROM documents))",
                       "u AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS i FROM s)",
                       final="SELECT doc_id AS review_id, CAST(i - 1 AS BIGINT) AS sent_idx, md5(sentence) AS sentence_md5 FROM u"),
    "nonblank_turns": f"SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations WHERE length({_squeeze('text')}) > 0",
    "truncated_tokens": _with(f"t AS (SELECT doc_id, {_words('text')} AS ts FROM documents)",
                              final=f"SELECT doc_id AS review_id, CAST(len(ts) AS BIGINT) AS n_tokens, md5(array_to_string(ts[1:{MAX_TOKENS}], ' ')) AS kept_md5 FROM t"),
    "ratings_clean": _with(DOC_RAW, RATINGS, final=f"SELECT review_id, md5(review) AS text_md5, rating, label, {_class_name('label')} AS label_name FROM ratings"),
    "ratings_clean_orders": _with(ORDER_ROWS, ORDER_RAW, RATINGS, final="SELECT review_id, rating, label FROM ratings"),
    "ratings_rejected": _with(DOC_RAW, final=f"""SELECT * FROM (SELECT review_id, stars AS "Rating", CASE WHEN stars = 'Like' THEN 'invalid rating' WHEN review IS NULL OR stars IS NULL THEN 'missing value'
  WHEN TRY_CAST(stars AS DOUBLE) IS NULL THEN 'not a number' WHEN round_even(TRY_CAST(stars AS DOUBLE), 0) NOT IN (1, 2, 3, 4, 5) THEN 'out of range' END AS reason FROM raw) WHERE reason IS NOT NULL"""),
    "rating_label_counts": _with(DOC_RAW, RATINGS, final=f"SELECT {_class_name('label')} AS label_name, count(*) AS n FROM ratings GROUP BY ALL"),
    "dedup_first": "SELECT doc_id AS review_id, md5(text) AS text_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "split_stratified": _with(DOC_RAW, RATINGS, TWO_WAY, final="SELECT review_id, label, split FROM divided"),
    "split_stratified_orders": _with(ORDER_ROWS, ORDER_RAW, RATINGS, TWO_WAY, final="SELECT review_id, label, split FROM divided"),
    "split_three_way": _with(DOC_RAW, RATINGS, THREE_WAY, final="SELECT review_id, label, split FROM divided"),
    "folds_stratified": _with(ORDER_ROWS, ORDER_RAW, RATINGS, """
ranked AS (SELECT review_id, label, count(*) OVER (PARTITION BY label) AS n,
  row_number() OVER (PARTITION BY label ORDER BY md5('42:' || review_id) || ':' || review_id) AS r FROM ratings)""",
                              final="SELECT review_id, label, len(list_filter(range(1, 5), lambda j: r > n * j // 5)) AS fold FROM ranked"),
    "split_sizes": _with(DOC_RAW, RATINGS, THREE_WAY, final="SELECT split, count(*) AS n FROM divided GROUP BY ALL"),
    "split_leaks": _with("labelled AS (SELECT doc_id AS review_id, text, quality FROM documents JOIN labels USING (doc_id))",
                         _split("labelled", "quality", 42, 0.2, "train", "test", "divided"),
                         final="SELECT sha256(text) AS text_key, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM divided GROUP BY text HAVING count(DISTINCT split) > 1"),
    "terms_phrases": _with(*DOC_TERMS, final="SELECT term, count(*) AS n_reviews FROM phrases GROUP BY term"),
    "abbreviation_scores": _with(DOCS, TYPED, final="SELECT type, n_period, n_plain, round(ratio, 6) + CAST(0 AS DOUBLE) AS ratio, round(score, 6) + CAST(0 AS DOUBLE) AS score FROM scores"),
    "sentence_starters": _with(DOCS, TYPED, STARTERS, final="SELECT type, n_after, n, round(ratio, 6) AS ratio FROM start_ratios"),
    "sentences_learned": _with(DOCS, TYPED, STARTERS, LEARNED, final="""SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY part) - 1 AS sent_idx,
  md5(sentence) AS sentence_md5 FROM whole_sentences WHERE sentence <> ''"""),
    "terms_key_phrases": _with(DOCS, _masked("reviews"), RAKE, final="""SELECT review_id, row_number() OVER o AS rank, phrase, score, n FROM rated
  WINDOW o AS (PARTITION BY review_id ORDER BY score DESC, phrase) QUALIFY row_number() OVER o <= 10"""),
    "aspects_phrases": _with(DOCS, _masked("reviews"), LONG_TERMS, final=f"""SELECT review_id, list_extract({_list(DEFAULT_ASPECTS)}, CAST(ord AS INTEGER) + 1) AS aspect,
  array_to_string(forms, '|') AS surface_forms FROM long_found"""),
    "lemma_rules": _with(DOCS, _masked("reviews"), LEMMAS, RULES, final="SELECT ending, cut, add, n FROM rules"),
    "lemmas_learned": _with(DOCS, _masked("reviews"), LEMMAS, RULES, RULED, final="SELECT token, CASE WHEN made <> '' THEN made ELSE token END AS lemma FROM ruled"),
    "terms_nouns": _with(DOCS, _masked("reviews"), LEMMAS, "items AS (SELECT item_id AS review_id, text FROM benchmark)", _masked("items", "b_"),
                         "counted AS (SELECT term AS raw, count(*) AS n_reviews FROM singles GROUP BY term)",
                         final="SELECT l.term AS lemma, count(*) AS n_forms, CAST(sum(n_reviews) AS BIGINT) AS n_mentions FROM lemma_of l JOIN counted USING (raw) WHERE l.term IN (SELECT term FROM b_singles) GROUP BY l.term"),
    "aspects_synonym": _with(*DOC_FOUND, final=_FORMS_OUT),
    "aspects_default": _with(*ORDER_FOUND, final=_FORMS_OUT),
    "aspects_vector": _with(*DOC_NEAREST, final=f"SELECT term, aspect, round(score, 6) AS score FROM nearest WHERE score >= {SIMILARITY_THRESHOLD}"),
    "threshold_sweep": _with(*DOC_NEAREST, final=f"SELECT threshold, aspect, count(*) AS n_terms FROM nearest, (SELECT CAST(unnest({inputs.SWEEP_THRESHOLDS}) AS DOUBLE) AS threshold) WHERE score >= threshold GROUP BY ALL"),
    "aspects_full": _with(*FULL_FOUND, final=_FORMS_OUT),
    "embedding_nearest": _with(_CENTROIDS, final="SELECT vec_id, ord AS nearest, round(score, 6) AS score FROM near"),
    "embedding_headline": _with(_CENTROIDS, "pairs AS (SELECT label AS y_true, ord AS y_pred, count(*) AS n FROM near GROUP BY ALL)", _metric_rows("pairs"), final=_HEADLINE),
    "embedding_softmax": _with("z AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_max(CAST(embedding AS DOUBLE[])) AS top FROM embeddings)",
                               final="SELECT vec_id, CAST(list_position(e, top) - 1 AS INTEGER) AS best, round(1 / list_sum(list_transform(e, lambda x: exp(x - top))), 4) AS confidence FROM z"),
    "phrase_vector_mean": _with("items AS (SELECT item_id AS review_id, text FROM benchmark)", _masked("items"), PHRASES, TOKEN_VECTORS, """
parts AS (SELECT term, unnest(string_split(term, ' ')) AS token, len(string_split(term, ' ')) AS n_words FROM (SELECT DISTINCT term FROM phrases)),
dims AS (SELECT term, n_words, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM parts JOIN vectors USING (token)),
means AS (SELECT term, d, sum(x) / any_value(n_words) AS x FROM dims GROUP BY term, d)""",
                                final="SELECT term, round(sqrt(sum(x * x)), 6) AS norm, round(sum(x), 6) AS total FROM means GROUP BY term HAVING sum(x * x) > 0"),
    "evidence_sentence": _with(*DOC_FOUND, _contexts(), final=_CONTEXT_OUT),
    "context_full": _with(*DOC_FOUND, _contexts("full_review"), final=_CONTEXT_OUT),
    "absa_flagship": _with(*DOC_SCORED, final=_FLAGSHIP_OUT),
    "absa_qualitative": _with(*DOC_SCORED, final=_QUALITATIVE.format("md5(array_to_string(evidence, ' | '))")),
    "absa_orders": _with(*ORDER_SCORED, final=_QUALITATIVE.format("array_to_string(evidence, ' | ')")),
    "absa_formatted": _with(*ORDER_SCORED, "wide AS (SELECT review_id, max(length(aspect)) AS width FROM scored GROUP BY review_id)",
                            f"lines AS (SELECT s.review_id, s.ord, rpad({_capital('aspect')}, CAST(width AS INTEGER), ' ') || ' -> ' || {_class_name('class_id')} || ' (' || CAST(confidence AS VARCHAR) || ')' AS line FROM scored s JOIN wide USING (review_id))",
                            "shown AS (SELECT review_id, string_agg(line, chr(10) ORDER BY ord) AS report FROM lines GROUP BY review_id)",
                            final=f"SELECT r.review_id, coalesce(s.report, {_q(NO_ASPECTS_MESSAGE)}) AS report FROM reviews r LEFT JOIN shown s USING (review_id)"),
    "absa_full": _with(*FULL_FOUND, _contexts(), DOC_RAW, RATINGS, _weights("ratings"), _scored(), final=_FLAGSHIP_OUT),
    "context_compare": _with(*DOC_FOUND, _contexts(), _contexts("full_review", name="full_contexts"), DOC_RAW, RATINGS, _weights("ratings"), _scored(), _scored("full_contexts", name="full_scored"),
                             final=f"""SELECT f.review_id, f.aspect, {_class_name('f.class_id')} AS full_review_label, f.confidence AS full_review_conf, {_class_name('s.class_id')} AS sentence_label,
  s.confidence AS sentence_conf, f.class_id = s.class_id AS agree FROM full_scored f FULL JOIN scored s ON f.review_id = s.review_id AND f.aspect = s.aspect"""),
    "extraction_compare": _with(*ORDER_FOUND, _contexts(), _default_lexicon(["food", "service", "ambience", "price"], "part_lexicon"), _found("part_lexicon", "part_found"),
                                _contexts("full_review", "part_found", "part_contexts"), ORDER_RAW, RATINGS, _weights("ratings"), _scored(), _scored("part_contexts", name="part_scored"),
                                final=f"""SELECT coalesce(a.review_id, b.review_id) AS review_id, coalesce(a.aspect, b.aspect) AS aspect, {_class_name('a.class_id')} AS whole_label, a.confidence AS whole_conf,
  {_class_name('b.class_id')} AS part_label, b.confidence AS part_conf, a.class_id = b.class_id AS agree FROM scored a FULL JOIN part_scored b ON a.review_id = b.review_id AND a.aspect = b.aspect"""),
    "gold_score": _with(*GOLD, _metric_rows("pairs"), final=_HEADLINE),
    "gold_report": _with(*GOLD, _metric_rows("pairs"), final=_report("label")),
    "gold_confusion": _with(*GOLD, "spine AS (SELECT y_true AS label FROM pairs UNION SELECT y_pred FROM pairs)",
                            final="SELECT a.label AS y_true, b.label AS y_pred, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM spine a CROSS JOIN spine b LEFT JOIN pairs ON y_true = a.label AND y_pred = b.label GROUP BY ALL"),
    "confusion_dense": _with(*BAYES_PAIRS, f"spine AS ({_LABELS})",
                             final="SELECT a.label AS y_true, b.label AS y_pred, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM spine a CROSS JOIN spine b LEFT JOIN pairs ON y_true = a.label AND y_pred = b.label GROUP BY ALL"),
    "confusion_wide": _with(*BAYES_PAIRS, f"spine AS ({_LABELS})",
                            final="SELECT label AS y_true, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (y_pred = {c}), 0) AS BIGINT) AS pred_{c}" for c in (0, 1, 2)) + " FROM spine LEFT JOIN pairs ON y_true = label GROUP BY label"),
    "class_report": _with(*BAYES_PAIRS, _metric_rows("pairs", _LABELS), final=_report(_class_name("label"))),
    "f1_present_labels": _with(*BAYES_PAIRS, _metric_rows("pairs"), final=_HEADLINE),
    "vocab_topk": _with(DOC_RAW, RATINGS, TWO_WAY, _TFIDF_TERMS, final="SELECT term, tf, df FROM vocab"),
    "tfidf_weights": _with(DOC_RAW, RATINGS, TWO_WAY, _TFIDF_TERMS, """
fitted AS (SELECT term, ln(CAST(1 + (SELECT count(*) FROM divided WHERE split = 'train') AS DOUBLE) / (1 + df)) + 1 AS idf FROM vocab),
weighed AS (SELECT review_id, term, count(*) * any_value(idf) AS x FROM grams JOIN fitted USING (term) GROUP BY review_id, term)""",
                           final="SELECT review_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY review_id)), 6) AS weight FROM weighed"),
    "steps_report": _with(DOC_RAW, RATINGS, TWO_WAY, _TFIDF_TERMS, FEATS, _step_model(8, 1.0, "one_"), _step_pairs("test", "one_"),
                          _metric_rows("one_pairs", _LABELS), final=_report(_class_name("label"))),
    "steps_sweep": _with(DOC_RAW, RATINGS, THREE_PARTS, _TFIDF_TERMS, FEATS, *[
        part for p, strength in _STRENGTHS.items() for part in (_step_model(4, strength, p), _step_pairs("validation", p), _step_headline(strength, p))],
        final=f"""SELECT strength, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1
  FROM ({' UNION ALL '.join(f'SELECT * FROM {p}tried' for p in _STRENGTHS)}) ORDER BY macro_f1 DESC, strength LIMIT 1"""),
    "scorer_saved": _with(*DOC_FOUND, final="SELECT review_id, aspect, true AS same FROM found"),
    "batch_model": _with(*DOC_FOUND, _contexts(), DOC_RAW, RATINGS, TWO_WAY, _TFIDF_TERMS, FEATS, _step_model(4, 1.0, "fit_"), f"""
said AS (SELECT review_id, ord, aspect, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (SELECT review_id, ord, aspect, {_words('context')} AS ts FROM contexts)),
said_pairs AS (SELECT review_id, ord, aspect, t, lead(t) OVER (PARTITION BY review_id, ord ORDER BY pos) AS nx FROM said),
said_terms AS (SELECT review_id, ord, aspect, t AS term FROM said_pairs UNION ALL SELECT review_id, ord, aspect, t || ' ' || nx FROM said_pairs WHERE nx IS NOT NULL),
said_raw AS (SELECT review_id, ord, aspect, term, count(*) * any_value(idf) AS x FROM said_terms JOIN fitted USING (term) GROUP BY ALL),
said_x AS (SELECT review_id, ord, term, x / sqrt(sum(x * x) OVER (PARTITION BY review_id, ord)) AS x FROM said_raw
  UNION ALL SELECT review_id, ord, '', CAST(1 AS DOUBLE) FROM contexts),
said_z AS (SELECT review_id, ord, {_each('sum(x * w{c}) AS z{c}')} FROM said_x JOIN fit_model USING (term) GROUP BY review_id, ord),
said_p AS (SELECT *, greatest(z0, z1, z2) AS t FROM said_z JOIN contexts USING (review_id, ord))""",
                         final=f"""SELECT review_id, aspect, {_capital(_class_name("CASE WHEN z0 = t THEN 0 WHEN z1 = t THEN 1 ELSE 2 END"))} AS label,
  round(round(1 / (exp(z0 - t) + exp(z1 - t) + exp(z2 - t)), 4), 2) AS confidence FROM said_p"""),
    "nb_weights": _with(DOC_RAW, RATINGS, _weights("ratings"), final="SELECT term, tf, round(lw0, 6) AS lw_0, round(lw1, 6) AS lw_1, round(lw2, 6) AS lw_2 FROM w"),
    "nb_scores": _with(*BAYES_TEST, final=f"SELECT review_id, y_true, class_id, {_class_name('class_id')} AS label, confidence FROM scored"),
    "batch_scoring": _with(*ORDER_FOUND, _contexts(), """
logits AS (SELECT review_id, aspect, CAST(length(context) - length(replace(context, '!', '')) AS DOUBLE) AS z0, length(aspect) / CAST(8 AS DOUBLE) AS z1,
  CAST(length(context) - length(replace(context, '.', '')) AS DOUBLE) AS z2 FROM contexts)""",
                           final=f"""SELECT review_id, aspect, {_class_name('CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END')} AS label,
  round(1 / (exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))), 4) AS confidence FROM logits"""),
    "model_saved": _with(DOC_RAW, RATINGS, TWO_WAY, final="SELECT review_id, TRUE AS same FROM divided WHERE split = 'test'"),
    "ratings_csv": _with(DOC_RAW, final=f"""SELECT review_id, md5(CASE WHEN review NOT IN ({', '.join(map(_q, MISSING_MARKERS))}) THEN review END) AS text_md5, stars AS "Rating" FROM raw"""),
    "gold_csv": _with(ORDER_ROWS, final=f"SELECT md5(text) AS review_md5, list_extract({_list(DEFAULT_ASPECTS)}, CAST(review_id % 7 AS INTEGER) + 1) AS aspect, {_GOLD_LABEL} AS true_label FROM order_rows"),
    "results_json": _with(*ORDER_FOUND, final=_FORMS_OUT),
    "stream_distinct": "SELECT DISTINCT md5(text) AS text_md5 FROM documents",
    "stream_aspects": _with(*DOC_FOUND, _contexts(), final=_CONTEXT_OUT),
    "stream_absa": _with(*ORDER_SCORED, final=f"SELECT review_id, aspect, {_class_name('class_id')} AS label, confidence FROM scored"),
}
