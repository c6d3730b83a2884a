"""The registered queries as SQL over the same tables, written on their own from the definitions."""

from __future__ import annotations

from collections import Counter

from lodestar.queries import BOOLEAN, DEPTH, JUDGED, PRUNE, QUANTUM, SHARDS, STOP, THESAURUS, TOPICS, K

WORDS = r"(\p{L}+|\p{N}+)"


def ln(x: str) -> str:
    """Null where the logarithm isn't a number."""
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) END)"


def lg(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN log2({x}) END)"


def _base(pattern: str = WORDS, text: str = "lower(text)", source: str = "documents", key: str = "doc_id") -> str:
    return f"""
tok AS (SELECT {key} AS docid, regexp_extract_all({text}, '{pattern}') AS ts FROM {source}),
d AS (SELECT docid, ts, len(ts) AS dl FROM tok WHERE len(ts) > 0 AND docid IS NOT NULL),
st AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE AS l, avg(dl)::DOUBLE AS adl FROM d),
p AS (SELECT term, docid, dl, count(*) AS raw, least(count(*), 255) AS tf FROM (SELECT docid, dl, unnest(ts) AS term FROM d) GROUP BY ALL),
dict AS (SELECT term, sum(raw)::BIGINT AS cf, count(*) AS df, max(tf) AS max_tf FROM p GROUP BY term)"""


BASE = _base()
PLAIN = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<\?.*?\?>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
PAGES = _base(text=f"lower({PLAIN})", source="pages", key="page_id")


def _values(topics: dict[int, list[str]]) -> str:
    rows = [f"({k}, '{t}', {n}, {len(ts)})" for k, ts in topics.items() for t, n in Counter(ts).items()]
    return f"q(topic, term, times, qlen) AS (VALUES {', '.join(rows)})"


def _matches(topics: dict[int, list[str]], postings: str = "p", dictionary: str = "dict", stats: str = "st", name: str = "m", joins: str = "", extra: str = "") -> str:
    return f"""{_values(topics)},
{name} AS (SELECT q.topic, q.times, q.qlen::DOUBLE AS qlen, p.term, p.docid, p.dl::DOUBLE AS dl, p.tf::DOUBLE AS tf, t.df::DOUBLE AS df, t.cf::DOUBLE AS cf, st.n, st.l, st.adl{extra}
  FROM q JOIN {postings} p ON p.term = q.term JOIN {dictionary} t ON t.term = q.term {joins} CROSS JOIN {stats} st)"""


def _scored(term: str, doc: str = "0", keys: str = "", source: str = "m", having: str = "", name: str = "s") -> str:
    f = f"({term})"
    return f"""{name} AS (SELECT topic, docid, round(sum(times * CASE WHEN isfinite({f}) THEN {f} ELSE 0 END) + (CASE WHEN isfinite({doc}) THEN {doc} ELSE 0 END), 6) AS rsv
  FROM {source} GROUP BY topic, docid, dl, qlen, n, l, adl{keys} {having})"""


def _top(k: int, source: str = "s", tie: str = "DESC") -> str:
    return f"SELECT topic, rank, docid, rsv FROM (SELECT topic, docid, rsv, row_number() OVER (PARTITION BY topic ORDER BY rsv DESC, docid {tie}) AS rank FROM {source}) WHERE rank <= {k}"


_NORM = lambda b: f"({1 - b} + {b} * dl / adl)"
_IDF = "ln(n / df)"
_BM25 = f"{_IDF} * tf * 1.9 / (tf + 0.9 * {_NORM(0.4)})"
_T04 = f"(tf / {_NORM(0.4)})"
_GAIN = f"tf * {lg('(tf * adl / dl) * (n / cf)')}"
_TAIL = f"0.5 * {lg('2 * pi() * tf * (1 - tf / dl)')}"
_EF = "(cf * dl / l)"
_DFI = f"log2((tf - {_EF}) / sqrt({_EF}) + 1)"
_WHEN = lambda x: f"CASE WHEN tf > {_EF} THEN {x} ELSE 0 END"
_PR, _PO = "(tf / dl)", "((tf + 1) / (dl + 1))"
_IN = "(l / tf)"
_DIV_T = "(tf * log2(1 + adl / dl))"
_BE_T = "(tf * ln(1 + adl / dl))"
_DIV = f"{_DIV_T} * log2((n + 1) / (n * (1 - pow((n - 1) / n, cf)) + 0.5)) * (cf + 1) / (df * ({_DIV_T} + 1))"
_LMDS = ("ln((tf / 2500.0) * (l / cf) + 1)", "qlen * ln(2500.0 / (dl + 2500.0))")
_LESS = lambda x, g=0.5: f"greatest({x} - {g} * pow({x}, {g}), 0)"

#: (per term, per document)
FORMULAS: dict[str, tuple[str, str]] = {
    "bm25": (_BM25, "0"),
    "bm25l": (f"{_IDF} * 1.9 * ({_T04} + 0.5) / (0.9 + {_T04} + 0.5)", "0"),
    "bm25plus": (f"{_IDF} * (1.9 * tf / (0.9 * {_NORM(0.4)} + tf) + 1)", "0"),
    "tflodop": (f"(1 + {ln('1 + ln(tf / ' + _NORM(0.1) + ' + 0.1)')}) * ln((n + 1) / df)", "0"),
    "lmd": ("ln(1 + (tf / 6750.0) * (l / cf)) - qlen * ln(1 + dl / 6750.0)", "0"),
    "lmds": _LMDS,
    "lmjm": ("ln(1 + ((1 - 0.5) / 0.5) * (tf / dl) * (l / cf))", "0"),
    "divergence": (_DIV, "0"),
    "be": (f"(ln(1 + cf / n) + {_BE_T} * ln(1 + n / cf)) / ({_BE_T} + 1)", "0"),
    "dlh13": (f"({_GAIN} + {_TAIL}) / (tf + 0.5) + 10", "0"),
    "dph": (f"pow(1 - tf / dl, 2) / (tf + 1) * ({_GAIN} + {_TAIL})", "0"),
    "dfree": (f"tf * log2({_PO} / {_PR}) * (-tf * log2({_PR} * {_IN}) + (tf + 1) * log2({_PO} * {_IN}) + 0.5 * log2({_PO} / {_PR}))", "0"),
    "dfi": (_WHEN(_DFI), "0"),
    "dfiw": (_WHEN(f"{_DFI} * -log2(tf / dl)"), "0"),
    "dfi_idf": (_WHEN(f"{_DFI} * log2(n / df)"), "0"),
    "dfiw_idf": (_WHEN(f"{_DFI} * (log2(n / df) * -log2(tf / dl))"), "0"),
    "tfidf": (f"tf * {_IDF} * {_IDF} / 100", "0"),
    "kbtfidf": (f"{ln('5.0 * tf - 2.281718171540955')} * {_IDF} * {_IDF} / 100", "0"),
    "termcount": ("1.0", "0"),
    "docid": ("0.0", "n - docid"),
}


def _rank(name: str, topics: dict[int, list[str]] = TOPICS, k: int = K, **kw) -> str:
    term, doc = FORMULAS[name]
    return f"WITH {BASE},\n{_matches(topics)},\n{_scored(term, doc, **kw)}\n{_top(k)}"


def _run(topics: dict[int, list[str]], k: int, name: str = "run", ranker: str = "bm25", tag: str = "") -> str:
    """CTEs that end in a run."""
    term, doc = FORMULAS[ranker]
    return f"{_matches(topics, name='m' + tag).replace('q(topic', f'q{tag}(topic').replace('FROM q JOIN', f'FROM q{tag} q JOIN')},\n{_scored(term, doc, source='m' + tag, name='s' + tag)},\n{name} AS ({_top(k, 's' + tag)})"


_QRELS = """lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
size AS (SELECT doc_id, max(n_chars) AS n_chars FROM documents GROUP BY doc_id),
graded AS (SELECT doc_id AS docid, coalesce(quality, 0) AS q, coalesce(toxic, 0) AS t, greatest(coalesce(n_chars, 1), 1) AS doc_length FROM lab LEFT JOIN size USING (doc_id)),
qrels AS (SELECT topic, subtopic, docid, rel, floor(doc_length * rel / 2) AS rel_chars, doc_length FROM (
  SELECT 1 AS topic, 0 AS subtopic, docid, q + t AS rel, doc_length FROM graded UNION ALL SELECT 1, 1, docid, t, doc_length FROM graded
  UNION ALL SELECT 2, 0, docid, t, doc_length FROM graded UNION ALL SELECT 2, 1, docid, q, doc_length FROM graded)),
best AS (SELECT topic, docid, max(rel) AS rel FROM qrels GROUP BY ALL),
tot AS (SELECT topic, count(*) FILTER (rel > 0) AS relevant, count(*) FILTER (rel <= 0) AS nonrelevant FROM best GROUP BY topic HAVING count(*) FILTER (rel > 0) > 0),
j AS (SELECT run.topic, run.rank, run.docid, b.rel, coalesce((b.rel > 0)::INT, 0) AS hit, coalesce((b.rel <= 0)::INT, 0) AS miss FROM run LEFT JOIN best b USING (topic, docid)),
a AS (SELECT *, sum(hit) OVER up AS found, coalesce(sum(miss) OVER (PARTITION BY topic ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM j WINDOW up AS (PARTITION BY topic ORDER BY rank))"""


def _eval(part: str, where: str, value: str, more: str = "", joins: str = "", run: str | None = None) -> str:
    run = run or f"{BASE},\n{_run(JUDGED, DEPTH)}"
    more = f",\n{more}" if more else ""
    return f"""WITH {run},
{_QRELS}{more},
v AS (SELECT a.topic, {part} FROM a JOIN tot USING (topic) {joins} WHERE {where} GROUP BY a.topic)
SELECT tot.topic::BIGINT AS topic, round(coalesce({value}, 0), 6)::DOUBLE AS value FROM tot LEFT JOIN v USING (topic)"""


def _gain(exponential: bool) -> str:
    return "(pow(2, rel) - 1)" if exponential else "rel"


def _ndcg(exponential: bool) -> str:
    g = _gain(exponential)
    return f"""WITH {BASE},
{_run(JUDGED, DEPTH)},
{_QRELS},
f AS (SELECT topic, docid, max(rel) AS rel FROM qrels WHERE subtopic = 0 GROUP BY ALL),
o AS (SELECT topic, rel, row_number() OVER (PARTITION BY topic ORDER BY rel DESC) AS rank FROM f WHERE rel > 0),
i AS (SELECT topic, sum({g} / log2(rank + 1)) AS ideal FROM o WHERE rank <= 10 GROUP BY topic),
v AS (SELECT run.topic, sum({g} / log2(rank + 1)) AS s FROM run JOIN f USING (topic, docid) WHERE rank <= 10 AND rel > 0 GROUP BY run.topic)
SELECT tot.topic::BIGINT AS topic, round(coalesce(s / ideal, 0), 6)::DOUBLE AS value FROM tot LEFT JOIN v USING (topic) LEFT JOIN i USING (topic)"""


def _intent(value: str, limit: str, bottom: str) -> str:
    """Mean of a metric over the subtopics that have a relevant document."""
    return f"""WITH {BASE},
{_run(JUDGED, DEPTH)},
{_QRELS},
sb AS (SELECT topic, subtopic, docid, max(rel) AS rel FROM qrels GROUP BY ALL),
sr AS (SELECT topic, subtopic, count(*) AS relevant FROM sb WHERE rel > 0 GROUP BY ALL),
sa AS (SELECT sr.topic, sr.subtopic, sr.relevant, run.rank, coalesce((sb.rel > 0)::INT, 0) AS hit FROM sr JOIN run USING (topic) LEFT JOIN sb ON sb.topic = sr.topic AND sb.subtopic = sr.subtopic AND sb.docid = run.docid WHERE {limit}),
sf AS (SELECT *, sum(hit) OVER (PARTITION BY topic, subtopic ORDER BY rank) AS found FROM sa),
sv AS (SELECT topic, subtopic, {value} / {bottom} AS v FROM sf GROUP BY topic, subtopic, relevant),
al AS (SELECT sr.topic, sr.subtopic, round(coalesce(v, 0), 6) AS v FROM sr LEFT JOIN sv USING (topic, subtopic))
SELECT topic::BIGINT AS topic, round(avg(v), 6)::DOUBLE AS value FROM al GROUP BY topic"""


def _flags(condition: str, terms: list[str]) -> str:
    return f"WITH {BASE},\nb AS (SELECT docid, {', '.join(f'bool_or(term = {t!r}) AS {n}' for t, n in zip(terms, 'abcdef'))} FROM p WHERE term IN ({', '.join(map(repr, terms))}) GROUP BY docid)\nSELECT docid FROM b WHERE {condition}"


def _boolean_ranked() -> str:
    leaves = {1: ["the", "of"], 2: ["the", "und"], 3: ["the", "de"], 4: ["the", "of"], 5: ["of", "the", "de", "par", "qui"]}
    assert leaves.keys() == BOOLEAN.keys()
    valid = "1 = topic AND t AND o OR 2 = topic AND (t OR u) OR 3 = topic AND t AND NOT e OR 4 = topic AND t <> o OR 5 = topic AND (o AND t AND NOT e OR r AND i)"
    flags = ", ".join(f"bool_or(term = '{t}') AS {n}" for t, n in (("the", "t"), ("of", "o"), ("und", "u"), ("de", "e"), ("par", "r"), ("qui", "i")))
    return f"WITH {BASE},\n{_matches(leaves)},\n{_scored(_BM25, name='s0')},\nb AS (SELECT docid, {flags} FROM p GROUP BY docid),\ns AS (SELECT s0.* FROM s0 JOIN b USING (docid) WHERE {valid})\n{_top(K)}"


def _strip(x: str) -> str:
    return f"CASE WHEN {x} LIKE '%ies' THEN left({x}, length({x}) - 3) || 'y' WHEN {x} LIKE '%es' THEN left({x}, length({x}) - 2) WHEN {x} LIKE '%s' THEN left({x}, length({x}) - 1) ELSE {x} END"


def _stem(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^\\p{{L}}') AND strlen({x}) > 3 THEN {_strip(x)} ELSE {x} END"


def _soundex(x: str) -> str:
    """First letter and digits: h and w go, equal neighbours fall together, then the rest without a digit goes."""
    letters = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    rest = f"regexp_replace(substr({letters}, 2), '[hw]', '', 'g')"
    digits = f"translate(left({letters}, 1) || {rest}, 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202')"
    for d in "0123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    code = f"left(left({letters}, 1) || regexp_replace(substr({digits}, 2), '0', '', 'g') || '000', 4)"
    return f"CASE WHEN regexp_matches({x}, '^[A-Za-z]') THEN {code} ELSE {x} END"


def _terms(topics: dict[int, list[str]]) -> list[str]:
    return sorted({t for ts in topics.values() for t in ts})


def _asked(terms: list[str]) -> str:
    return f"asked(qterm) AS (VALUES {', '.join(f'({t!r})' for t in terms)})"


def _variants(terms: list[str], stem=_stem) -> str:
    return f"""{_asked(terms)},
vs AS (SELECT qterm, term FROM asked JOIN dict ON {stem('dict.term')} = {stem('asked.qterm')} WHERE left(dict.term, 1) = left({stem('asked.qterm')}, 1) OR dict.term = qterm)"""


def _conflated(variants: str, raw: str = "raw") -> str:
    """Search with counts of all variants of a term added up; ``variants`` are CTEs that end in vs(qterm, term)."""
    return f"""WITH {BASE},
{variants},
cp AS (SELECT qterm AS term, docid, dl, sum({raw})::BIGINT AS raw, least(sum({raw}), 255) AS tf FROM p JOIN vs USING (term) GROUP BY ALL),
cd AS (SELECT term, sum(raw) AS cf, count(*) AS df FROM cp GROUP BY term),
{_matches(TOPICS, 'cp', 'cd')},
{_scored(_BM25)}
{_top(K)}"""


def _similar(variants: str) -> str:
    return f"""{variants},
wt AS (SELECT p.term, docid, tf * ln(n / df) AS w FROM p JOIN dict USING (term) CROSS JOIN st WHERE p.term IN (SELECT term FROM vs UNION SELECT qterm FROM vs)),
nm AS (SELECT term, sqrt(sum(w * w)) AS norm FROM wt GROUP BY term),
dp AS (SELECT vs.qterm, vs.term, sum(a.w * b.w) AS dot FROM vs JOIN wt a ON a.term = vs.qterm JOIN wt b ON b.term = vs.term AND a.docid = b.docid GROUP BY ALL),
sim AS (SELECT vs.qterm, vs.term, round(coalesce(dot / (x.norm * y.norm), 0), 6) AS similarity FROM vs JOIN nm x ON x.term = vs.term JOIN nm y ON y.term = vs.qterm LEFT JOIN dp ON dp.qterm = vs.qterm AND dp.term = vs.term)"""


def _thesaurus() -> str:
    rows = [(t, t) for t in _terms(TOPICS)] + [(t, r) for t, kind, r in THESAURUS if kind == "synonym" and t in _terms(TOPICS)]
    return f"vs(qterm, term) AS (VALUES {', '.join(map(repr, sorted(set(rows))))})"


def _expanded() -> dict[int, list[str]]:
    extra = {t: r for t, kind, r in THESAURUS if kind == "synonym"}
    return {k: [x for t in ts for x in ([t, extra[t]] if t in extra else [t])] for k, ts in TOPICS.items()}


def _divergent(chosen: str, n: int) -> str:
    """CTEs that end in kt(topic, term, kl) for ``chosen`` (topic, docid)."""
    return f"""ct AS (SELECT c.topic, p.term, sum(p.raw) AS c FROM p JOIN {chosen} c USING (docid) GROUP BY ALL),
tt AS (SELECT topic, sum(c) AS total FROM ct GROUP BY topic),
kv AS (SELECT ct.topic, ct.term, round((c / total) * ln((c / total) / (cf / l)), 9) AS kl FROM ct JOIN tt USING (topic) JOIN dict USING (term) CROSS JOIN st WHERE regexp_full_match(ct.term, '\\p{{L}}+')),
kt AS (SELECT topic, term, kl FROM kv QUALIFY row_number() OVER (PARTITION BY topic ORDER BY kl DESC, term) <= {n})"""


_FIVE = "ch AS (SELECT x AS topic, x AS docid FROM range(5) r(x))"


def _feedback_kl() -> str:
    return f"""WITH {BASE},
{_run(JUDGED, 17, 'first')},
{_divergent('first', 5)},
nq AS (SELECT topic, count(*) AS added FROM kt GROUP BY topic),
q2 AS (SELECT q.topic, term, times, qlen + coalesce(added, 0) AS qlen, 1.0 AS w FROM q LEFT JOIN nq USING (topic) UNION ALL SELECT topic, term, 1, 0, kl FROM kt),
m2 AS (SELECT q2.topic, q2.times, q2.w, p.docid, p.dl::DOUBLE AS dl, p.tf::DOUBLE AS tf, dict.df::DOUBLE AS df, n, adl FROM q2 JOIN p USING (term) JOIN dict USING (term) CROSS JOIN st),
s2 AS (SELECT topic, docid, round(sum(times * w * {_BM25}), 6) AS rsv FROM m2 GROUP BY topic, docid)
{_top(K, 's2')}"""


def _feedback_rm() -> str:
    term, doc = _LMDS
    return f"""WITH {BASE},
{_matches(JUDGED)},
{_scored(term, doc, name='s0')},
first AS ({_top(10, 's0')}),
ex AS (SELECT topic, docid, exp(rsv - max(rsv) OVER (PARTITION BY topic)) AS e FROM first),
lk AS (SELECT topic, docid, e / sum(e) OVER (PARTITION BY topic) AS likely FROM ex),
qt AS (SELECT DISTINCT topic, term FROM q JOIN dict USING (term)),
wt AS (SELECT qt.topic, qt.term, sum(likely * (coalesce(p.tf, 0) + 2500.0 * dict.cf / l) / (d.dl + 2500.0)) AS w FROM lk JOIN qt USING (topic) JOIN dict USING (term) JOIN d USING (docid) LEFT JOIN p ON p.docid = lk.docid AND p.term = qt.term CROSS JOIN st GROUP BY ALL),
mx AS (SELECT topic, term, 0.5 * (w / sum(w) OVER (PARTITION BY topic)) + 0.5 / count(*) OVER (PARTITION BY topic) AS mixed FROM wt),
s2 AS (SELECT topic, docid, round(sum(times * mixed * {term}) + {doc}, 6) AS rsv FROM m JOIN mx USING (topic, term) GROUP BY topic, docid, dl, qlen)
{_top(K, 's2')}"""


def _rerank() -> str:
    term, doc = _LMDS
    return f"""WITH {BASE},
{_run(TOPICS, 50, 'first')},
pool AS (SELECT topic, docid FROM first),
ps AS (SELECT topic, count(*)::DOUBLE AS n, sum(dl)::DOUBLE AS l, avg(dl)::DOUBLE AS adl FROM pool JOIN d USING (docid) GROUP BY topic),
pp AS (SELECT pool.topic, p.* FROM pool JOIN p USING (docid)),
pd AS (SELECT topic, term, sum(raw)::DOUBLE AS cf, count(*)::DOUBLE AS df FROM pp GROUP BY ALL),
m2 AS (SELECT q.topic, q.times, q.qlen::DOUBLE AS qlen, pp.docid, pp.dl::DOUBLE AS dl, pp.tf::DOUBLE AS tf, pd.cf, ps.n, ps.l, ps.adl FROM q JOIN pp USING (topic, term) JOIN pd USING (topic, term) JOIN ps USING (topic)),
{_scored(term, doc, source='m2', name='s2')}
{_top(50, 's2')}"""


def _shards() -> str:
    """Runs of each shard by its own statistics, in one order."""
    return f"""WITH {BASE},
sst AS (SELECT docid % {SHARDS} AS shard, count(*)::DOUBLE AS n, sum(dl)::DOUBLE AS l, avg(dl)::DOUBLE AS adl FROM d GROUP BY ALL),
sd AS (SELECT docid % {SHARDS} AS shard, term, count(*)::DOUBLE AS df FROM p GROUP BY ALL),
{_values(TOPICS)},
m AS (SELECT q.topic, q.times, p.docid, p.dl::DOUBLE AS dl, p.tf::DOUBLE AS tf, sd.df, n, adl, sd.shard FROM q JOIN p USING (term) JOIN sd ON sd.term = p.term AND sd.shard = p.docid % {SHARDS} JOIN sst ON sst.shard = sd.shard),
s0 AS (SELECT topic, shard, docid, round(sum(times * {_BM25}), 6) AS rsv FROM m GROUP BY ALL),
s AS (SELECT topic, docid, rsv FROM s0 QUALIFY row_number() OVER (PARTITION BY topic, shard ORDER BY rsv DESC, docid DESC) <= {K})
{_top(K, tie='ASC')}"""


def _impacts(formula: str, bits: str) -> str:
    f = f"({formula})"
    return f"""im AS (SELECT p.term, p.docid, p.dl::DOUBLE AS dl, p.tf::DOUBLE AS tf, dict.df::DOUBLE AS df, dict.cf::DOUBLE AS cf, n, l, adl FROM p JOIN dict USING (term) CROSS JOIN st),
ir AS (SELECT term, docid, dl, CASE WHEN isfinite({f}) THEN {f} ELSE 0 END AS rsv FROM im),
ie AS (SELECT min(rsv) AS low, max(rsv) AS high, {bits} AS bits FROM ir),
ii AS (SELECT term, docid, dl, trunc((rsv - low) / CASE WHEN high > low THEN high - low ELSE 1 END * (pow(2, bits) - 2) + 1)::BIGINT AS impact FROM ir CROSS JOIN ie)"""


_EDGES = r"""lk AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']+)["'']', 1) AS ts FROM pages),
ed AS (SELECT DISTINCT ts[1] AS src, dst FROM (SELECT ts, unnest(ts[2:]) AS dst FROM lk) WHERE ts[1] <> dst)"""


def _pagerank(iterations: int) -> str:
    parts = [
        _EDGES,
        "nd AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed)",
        "tl AS (SELECT count(*)::DOUBLE AS total FROM nd)",
        "ou AS (SELECT src, count(*) AS out FROM ed GROUP BY src)",
        "r0 AS (SELECT node, 1 / total AS rank FROM nd, tl)",
    ]
    for i in range(iterations):
        parts.append(f"g{i} AS (SELECT dst AS node, sum(rank / out) AS given FROM ed JOIN ou USING (src) JOIN r{i} ON r{i}.node = ed.src GROUP BY dst)")
        parts.append(f"r{i + 1} AS (SELECT node, 0.15 / total + 0.85 * coalesce(given, 0) AS rank FROM nd LEFT JOIN g{i} USING (node), tl)")
    joined = ",\n".join(parts)
    return f"WITH {joined}\nSELECT node, round(rank, 9) AS rank FROM r{iterations}"


def _familiar() -> str:
    from lodestar.operators.readability import FAMILIAR

    return "[" + ", ".join(map(repr, FAMILIAR)) + "]"


def _readability() -> str:
    return rf"""rt AS (SELECT doc_id AS docid, regexp_extract_all(lower(text), '(\p{{L}}+)') AS ws, greatest(len(regexp_extract_all(text, '([.!?]+)')), 1) AS sentences FROM documents),
rc AS (SELECT docid, len(ws) AS words, len(list_filter(ws, lambda w: NOT list_contains({_familiar()}, w))) AS unfamiliar, sentences FROM rt WHERE len(ws) > 0),
rd AS (SELECT docid, words, unfamiliar, sentences, round(1000 * (0.049 * words / sentences + 15.79 * unfamiliar / words + 3.6365), 6)::DOUBLE AS readability FROM rc)"""


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


_SPAM = "(SELECT doc_id, coalesce(quality, 0) * 60 + 20 - coalesce(toxic, 0) * 15 AS score FROM labels)"
_ALL_TERMS = "HAVING sum(times) >= qlen"
_LMP_TERM = f"CASE WHEN {_LESS('tf')} > 0 THEN ln(1 + exp(ln({_LESS('tf')}) + ln(l) - ln(1000.0 * cf + 1))) ELSE 0 END"
_TI = "ln(1 + tf / uniq) * ln(n / df)"
_TITLE = "trim(regexp_replace(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '\\s+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    out = {f"rank_{name}": _rank(name) for name in FORMULAS}
    out["rank_allterms"] = _rank("termcount", having=_ALL_TERMS)
    out["tokenize"] = f"WITH {BASE} SELECT CASE WHEN regexp_matches(term, '^\\p{{N}}') THEN 'number' ELSE 'word' END AS kind, sum(raw)::BIGINT AS tokens, count(DISTINCT term) AS terms FROM p GROUP BY kind"
    out["doc_lengths"] = f"WITH {BASE} SELECT docid, dl FROM d"
    out["postings"] = f"WITH {BASE} SELECT term, docid, raw, tf FROM p"
    out["dictionary"] = f"WITH {BASE} SELECT * FROM dict"
    out["collection_stats"] = f"WITH {BASE} SELECT n, l, round(adl, 6) AS adl FROM st"
    out["tag_terms"] = r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<\?.*?\?>', ' ', 'g'), '<([A-Za-z_][\w.:-]*)', 1)) AS term FROM pages)
SELECT upper(term) AS term, count(*) AS cf, count(DISTINCT page_id) AS df FROM t GROUP BY upper(term)"""
    out["page_dictionary"] = f"WITH {PAGES} SELECT term, cf, df FROM dict"
    out["index_tagged"] = rf"""WITH {PAGES}, t AS (SELECT page_id AS docid, upper(unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<\?.*?\?>', ' ', 'g'), '<([A-Za-z_][\w.:-]*)', 1))) AS term FROM pages)
SELECT term, count(*) AS cf, count(DISTINCT docid) AS df FROM t JOIN d USING (docid) GROUP BY term UNION ALL SELECT term, cf, df FROM dict"""
    describe = "SELECT count(*) AS documents, sum(dl)::BIGINT AS terms, max(dl) AS longest, round(avg(dl), 6) AS mean_length, (SELECT count(*) FROM {0}) AS unique_terms FROM d"
    out["describe_index"] = f"WITH {BASE} " + describe.format("dict")
    out["index_without_numbers"] = f"WITH {_base(r'(\p{L}+)')} " + describe.format("dict")
    stop = "(" + ", ".join(map(repr, STOP)) + ")"
    out["index_stopped"] = f"WITH {BASE}, x AS (SELECT * FROM dict WHERE term NOT IN {stop}) " + describe.format("x")
    out["index_s_stemmed"] = f"WITH {BASE}, x AS (SELECT {_stem('term')} AS term, docid, sum(raw) AS raw FROM p GROUP BY ALL) SELECT term, sum(raw)::BIGINT AS cf, count(*) AS df FROM x GROUP BY term"
    out["facet_terms"] = "SELECT term, count(*) AS cf FROM (SELECT chr(128) || 'role:' || lower(coalesce(regexp_extract(role, '^[\\p{L}\\p{N}:-]*'), 'none')) AS term FROM conversations) GROUP BY term"
    out["scrub"] = "SELECT doc_id, md5(regexp_replace(text, '[^\\x01-\\x7F]', ' ', 'g')) AS scrubbed FROM documents"
    out["filter_exclude"] = "SELECT doc_id, lang FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"
    out["filter_include"] = "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"
    out["spam_filter"] = f"SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM {_SPAM} WHERE score >= 70)"
    out["ham_filter"] = f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {_SPAM} WHERE score < 30 AND doc_id IS NOT NULL)"
    out["mime_filter"] = "SELECT page_id FROM pages WHERE page_id % 3 <> 2 AND html IS NOT NULL"
    out["rank_lmp"] = f"""WITH {BASE},
dv AS (SELECT docid, sum({_LESS('tf::DOUBLE')}) AS disc FROM p GROUP BY docid),
{_matches(TOPICS, joins='JOIN dv ON dv.docid = p.docid', extra=', dv.disc')},
{_scored(_LMP_TERM, 'qlen * ln(1 - disc / (dl + 1000.0))', ', disc')}
{_top(K)}"""
    out["rank_lmptfidf"] = f"""WITH {BASE},
un AS (SELECT docid, count(*) AS uniq FROM p GROUP BY docid),
tw AS (SELECT docid, uniq, {_TI} AS w FROM (SELECT p.docid, p.tf::DOUBLE AS tf, uniq::DOUBLE AS uniq, dict.df::DOUBLE AS df, n FROM p JOIN dict USING (term) JOIN un USING (docid) CROSS JOIN st)),
dv AS (SELECT docid, uniq, sum(w) AS tfidf_len, sum({_LESS('w')}) AS tfidf_disc, (SELECT count(*) FROM dict)::DOUBLE AS v FROM tw GROUP BY ALL),
{_matches(TOPICS, joins='JOIN dv ON dv.docid = p.docid', extra=', dv.uniq, dv.tfidf_len, dv.tfidf_disc, dv.v')},
{_scored(f"CASE WHEN {_LESS(f'({_TI})')} > 0 THEN {_IDF} * ln({_LESS(f'({_TI})')} * v / 1000.0 + 1) ELSE 0 END", 'qlen * ln(1 - tfidf_disc / (tfidf_len + 1000.0))', ', tfidf_disc, tfidf_len')}
{_top(K)}"""
    out["readability_dale_chall"] = f"WITH {_readability()} SELECT * FROM rd"
    out["rank_readable"] = f"WITH {BASE},\n{_readability()},\n{_matches(TOPICS, joins='JOIN rd ON rd.docid = p.docid', extra=', rd.readability')},\n{_scored(f'0.5 * ({_BM25})', '0.5 * (20.0 - readability / 1000)', ', readability')}\n{_top(K)}"
    static = "sc AS (SELECT doc_id AS docid, greatest(coalesce(n_chars, 1), 1)::DOUBLE AS pregen FROM documents)"
    out["rank_pregen"] = f"WITH {BASE},\n{static},\n{_matches(TOPICS, joins='JOIN sc ON sc.docid = p.docid', extra=', sc.pregen')},\n{_scored('0.0', 'pregen', ', pregen')}\n{_top(K)}"
    out["rank_blended"] = f"WITH {BASE},\n{static},\n{_matches(TOPICS)},\n{_scored(_BM25, name='s0')},\ns AS (SELECT topic, docid, round(rsv * 0.7 + ln(pregen) * (1 - 0.7) - 0.01, 6) AS rsv FROM s0 JOIN sc USING (docid))\n{_top(K)}"
    out["rank_impact"] = f"WITH {BASE},\n{_impacts(_BM25, '8')},\nip AS (SELECT term, docid, dl, impact AS tf FROM ii),\n{_matches(TOPICS, 'ip')},\n{_scored('tf')}\n{_top(K)}"
    out["topk_page"] = f"SELECT * FROM ({_rank('divergence')}) WHERE rank BETWEEN 6 AND 15"
    out["hit_counts"] = f"WITH {BASE}, {_values(TOPICS)} SELECT topic::BIGINT AS topic, count(DISTINCT docid) AS hits FROM q JOIN p USING (term) GROUP BY topic"
    out["topic_table_search"] = rf"""WITH {BASE},
qx AS (SELECT item_id AS topic, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM benchmark),
q AS (SELECT topic, term, count(*) AS times FROM qx GROUP BY ALL),
s AS (SELECT topic, docid, round(sum(times * {_BM25}), 6) AS rsv FROM (SELECT q.topic, q.times, p.docid, p.dl::DOUBLE AS dl, p.tf::DOUBLE AS tf, dict.df::DOUBLE AS df, n, adl FROM q JOIN p USING (term) JOIN dict USING (term) CROSS JOIN st) GROUP BY ALL)
{_top(5)}"""
    out["nexi_cas"] = _rank("divergence", {1: ["the", "und", "que", "rent"]})
    stopped = {k: [t for t in ts if t not in STOP and len(t) > 2] or ts for k, ts in TOPICS.items()}
    out["stop_query"] = _rank("bm25", stopped)
    out["boolean_and"] = _flags("a AND b", ["the", "of"])
    out["boolean_or"] = _flags("a OR b", ["the", "und"])
    out["boolean_not"] = _flags("a AND NOT b", ["the", "de"])
    out["boolean_xor"] = _flags("a <> b", ["the", "of"])
    out["boolean_nested"] = _flags("a AND b AND NOT c OR d AND e", ["of", "the", "de", "par", "qui"])
    out["boolean_ranked"] = _boolean_ranked()
    out["static_prune"] = f"WITH {BASE} SELECT term, docid, tf FROM p QUALIFY row_number() OVER (PARTITION BY term ORDER BY tf DESC, docid) <= {PRUNE}"
    out["quantum_prune"] = f"WITH {BASE} SELECT term, docid, tf FROM p QUALIFY rank() OVER (PARTITION BY term ORDER BY tf DESC) <= {QUANTUM}"
    out["search_pruned"] = f"WITH {BASE},\npp AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY term ORDER BY tf DESC, docid) <= {DEPTH}),\npd AS (SELECT term, sum(raw) AS cf, count(*) AS df FROM pp GROUP BY term),\n{_matches(TOPICS, 'pp', 'pd')},\n{_scored(_BM25)}\n{_top(K)}"
    out["cull_singletons"] = f"WITH {BASE} SELECT * FROM dict WHERE cf > 1"
    out["cull_rare"] = f"WITH {BASE} SELECT * FROM dict WHERE df > 5"
    out["cull_frequent"] = f"WITH {BASE} SELECT dict.* FROM dict, st WHERE df / n < 0.1"
    out["cull_stopped"] = f"WITH {BASE} SELECT * FROM dict WHERE term NOT IN {stop}"
    out["quantize_bm25"] = f"WITH {BASE},\n{_impacts(_BM25, '8')}\nSELECT term, docid, impact FROM ii"
    out["quantize_by_size"] = f"WITH {BASE},\n{_impacts(_DIV, '(SELECT floor(5.4 + 5.4e-4 * sqrt(n)) FROM st)')}\nSELECT impact, count(*) AS postings FROM ii GROUP BY impact"
    out["merge_indexes"] = out["dictionary"]
    out["broker_merge"] = _shards()
    out["stem_soundex"] = f"WITH {BASE} SELECT term, {_soundex('term')} AS stem FROM dict"
    plain_line = "regexp_replace(coalesce(text, ''), '[\\t\\n\\r]', ' ', 'g')"
    out["read_tsv"] = f"SELECT doc_id::VARCHAR AS name, md5(regexp_replace({plain_line}, '[^\\x01-\\x7F]', ' ', 'g')) AS body_md5 FROM documents WHERE doc_id IS NOT NULL"
    out["read_lines"] = f"SELECT md5({plain_line}) AS name_md5, md5({plain_line}) AS body_md5 FROM documents"
    out["read_trec"] = "SELECT doc_id::VARCHAR AS name, md5(chr(10) || '<DOCNO> ' || doc_id || ' </DOCNO>' || chr(10) || coalesce(text, '') || chr(10)) AS body_md5 FROM documents WHERE doc_id IS NOT NULL"
    out["read_warc"] = "SELECT 'http://host/' || page_id AS name, md5(coalesce(html, '')) AS body_md5 FROM pages WHERE page_id IS NOT NULL"
    out["search_stored"] = _rank("bm25")
    out["eval_ia_err"] = f"""WITH {BASE},
{_run(JUDGED, DEPTH)},
{_QRELS},
sb AS (SELECT DISTINCT topic, subtopic, docid FROM qrels WHERE rel > 0),
ns AS (SELECT topic, count(DISTINCT subtopic) AS subtopics FROM sb GROUP BY topic),
hits AS (SELECT topic, rank, row_number() OVER (PARTITION BY topic, subtopic ORDER BY rank) - 1 AS before FROM sb JOIN run USING (topic, docid) WHERE rank <= 10),
got AS (SELECT topic, sum(pow(0.5, before) / rank) AS v FROM hits GROUP BY topic)
SELECT ns.topic::BIGINT AS topic, round(coalesce(v, 0) / (subtopics * (SELECT sum(pow(0.5, r - 1) / r) FROM range(1, 11) t(r))), 6) AS value FROM ns LEFT JOIN got USING (topic)"""
    out["stem_s"] = f"WITH {BASE} SELECT term, {_stem('term')} AS stem FROM dict"
    out["conflate_s"] = _conflated(_variants(_terms(TOPICS)))
    out["conflate_soundex"] = _conflated(_variants(_terms(TOPICS), _soundex))
    out["thesaurus_inplace"] = _conflated(_thesaurus())
    out["thesaurus_expand"] = _rank("bm25", _expanded())
    four = _similar(_variants(["rent", "mentan", "lele", "qui"]))
    out["term_similarity"] = f"WITH {BASE},\n{four}\nSELECT qterm, term, similarity FROM sim"
    every = _similar(_variants(_terms(TOPICS)).replace("vs AS", "va AS")).replace("va AS", "vs AS", 1)
    near = lambda least: every + f",\nkeep AS (SELECT * FROM sim WHERE similarity >= {least})"
    out["similarity_threshold"] = _conflated(near(0.02)).replace("p JOIN vs USING (term)", "p JOIN keep USING (term)")
    out["similarity_weighted"] = _conflated(near(0.0), "greatest(floor(raw * similarity), 1)").replace("p JOIN vs USING (term)", "p JOIN keep USING (term)")
    out["feedback_kl"] = _feedback_kl()
    out["feedback_terms"] = f"WITH {BASE},\n{_run(TOPICS, 17, 'first')},\n{_divergent('first', 5)}\nSELECT topic::BIGINT AS topic, term, kl FROM kt"
    out["feedback_rm"] = _feedback_rm()
    out["more_like_this"] = f"WITH {BASE},\n{_FIVE},\n{_divergent('ch', 10)}\nSELECT topic AS docid, term, kl FROM kt"
    out["word_cloud"] = f"WITH {BASE},\n{_FIVE},\n{_divergent('ch', 20)}\nSELECT topic AS docid, string_agg(term, ' ' ORDER BY kl DESC, term) AS cloud FROM kt GROUP BY topic"
    out["rerank_topk"] = _rerank()
    out["kendall_tau"] = f"""WITH {BASE},
{_run(JUDGED, DEPTH, 'r1', 'bm25', '1')},
{_run(JUDGED, DEPTH, 'r2', 'divergence', '2')},
b AS (SELECT r1.topic, docid, r1.rsv AS a, r2.rsv AS b FROM r1 JOIN r2 USING (topic, docid)),
pr AS (SELECT x.topic, sign(x.a - y.a) AS u, sign(x.b - y.b) AS v FROM b x JOIN b y ON x.topic = y.topic AND x.docid < y.docid)
SELECT topic::BIGINT AS topic, count(*) AS pairs, round(sum(u * v) / sqrt(count(*) FILTER (u <> 0)::DOUBLE * count(*) FILTER (v <> 0)), 6) AS tau FROM pr GROUP BY topic"""
    out["eval_map"] = _eval("sum(found::DOUBLE / rank) / any_value(relevant) AS s", "hit = 1", "s")
    out["eval_magp"] = _eval(
        "sum(CASE WHEN hit = 1 THEN so_far / a.rank END) / any_value(relevant) AS s",
        "hit = 1",
        "s",
        "gp AS (SELECT topic, docid, max(rel_chars / doc_length) AS p FROM qrels GROUP BY ALL),\ngf AS (SELECT a.topic, a.rank, sum(CASE WHEN hit = 1 THEN (1 + 0.0625) * p / (0.0625 * p + 1) ELSE 0 END) OVER (PARTITION BY a.topic ORDER BY a.rank) AS so_far FROM a LEFT JOIN gp USING (topic, docid))",
        "JOIN gf ON gf.topic = a.topic AND gf.rank = a.rank",
    )
    out["eval_p_at_10"] = _eval("sum(hit)::DOUBLE / count(*) AS s", "a.rank <= 10", "s")
    out["eval_s_at_10"] = _eval("max(hit)::DOUBLE AS s", "a.rank <= 10", "s")
    out["eval_rankeff"] = _eval("sum(CASE WHEN nonrelevant = 0 THEN 1 ELSE 1 - above::DOUBLE / nonrelevant END) / any_value(relevant) AS s", "hit = 1", "s")
    for name, m in (("eval_bpref", 0), ("eval_bpref10", 10)):
        out[name] = _eval(f"sum(CASE WHEN {m} + least(relevant, nonrelevant) = 0 THEN 1 ELSE 1 - ({m} + least(above, relevant))::DOUBLE / ({m} + least(relevant, nonrelevant)) END) / any_value(relevant) AS s", "hit = 1", "s")
    out["eval_dcg"] = _eval("sum(rel / log2(rank + 1)) AS s", "hit = 1 AND a.rank <= 10", "s")
    out["eval_ndcg"], out["eval_ndcg_exponential"] = _ndcg(False), _ndcg(True)
    out["eval_err"] = _eval(
        "sum(e.r * e.ps / a.rank) AS s",
        "a.rank <= 10",
        "s",
        "er AS (SELECT topic, rank, CASE WHEN hit = 1 THEN (pow(2, rel) - 1) / 16 ELSE 0 END AS r FROM a),\nep AS (SELECT topic, rank, r, coalesce(product(1 - r) OVER (PARTITION BY topic ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS ps FROM er)",
        "JOIN ep e ON e.topic = a.topic AND e.rank = a.rank",
    )
    out["eval_ia_map"] = _intent("sum(CASE WHEN hit = 1 THEN found::DOUBLE / rank ELSE 0 END)", "true", "relevant")
    out["eval_ia_p"] = _intent("sum(hit)::DOUBLE", "run.rank <= 10", "count(*)")
    metrics = {"map": "eval_map", "p": "eval_p_at_10", "s": "eval_s_at_10", "bpref": "eval_bpref", "ndcg": "eval_ndcg"}
    out["eval_bundle"] = "\nUNION ALL\n".join(f"SELECT '{m}' AS metric, round(avg(value), 6) AS value, count(*) AS topics FROM ({out[k]})" for m, k in metrics.items())
    out["perfect_run_map"] = _eval("sum(found::DOUBLE / rank) / any_value(relevant) AS s", "hit = 1", "s", run=f"run AS (SELECT topic, docid, row_number() OVER (PARTITION BY topic ORDER BY rel DESC, docid DESC) AS rank FROM {'best'} WHERE rel > 0)")
    qrels_first, _, rest = _QRELS.partition("tot AS")
    out["perfect_run_map"] = f"WITH {qrels_first}run AS (SELECT topic, docid, row_number() OVER (PARTITION BY topic ORDER BY rel DESC, docid DESC) AS rank FROM best WHERE rel > 0),\ntot AS{rest},\nv AS (SELECT a.topic, sum(found::DOUBLE / rank) / any_value(relevant) AS s FROM a JOIN tot USING (topic) WHERE hit = 1 GROUP BY a.topic)\nSELECT tot.topic::BIGINT AS topic, round(coalesce(s, 0), 6)::DOUBLE AS value FROM tot LEFT JOIN v USING (topic)"
    out["page_links"] = f"WITH {_EDGES} SELECT page_id AS src, (unnest(range(len(ts))))::INT AS place, unnest(ts) AS dst FROM lk"
    out["inlink_count"] = f"WITH {_EDGES} SELECT dst, count(*) AS inlinks FROM ed GROUP BY dst"
    out["pagerank"] = _pagerank(3)
    clean = "ltrim(regexp_replace(regexp_replace(lower(coalesce(url, '')), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
    out["pregen_exact_string"] = f"SELECT page_id AS docid, dense_rank() OVER (ORDER BY {clean}) AS pregen FROM pages"
    out["pregen_exact_integer"] = "SELECT doc_id AS docid, row_number() OVER (ORDER BY greatest(coalesce(n_chars, 1), 1), doc_id NULLS FIRST) AS pregen FROM documents"
    out["pregen_leading_bytes"] = "SELECT doc_id AS docid, coalesce(('0x' || rpad(left(hex(encode(text)), 8), 8, '0'))::BIGINT, 1) AS pregen FROM documents"
    out["pregen_ordering"] = """WITH b AS (SELECT doc_id AS docid, greatest(coalesce(n_chars, 1), 1) AS a, floor(greatest(coalesce(n_chars, 1), 1) / 10) AS b FROM documents),
o AS (SELECT a, b, lag(a) OVER w AS a0, lag(b) OVER w AS b0 FROM b WINDOW w AS (ORDER BY a, b, docid))
SELECT count(*) FILTER (a > a0 AND b < b0) AS misordered, count(*) FILTER (a > a0 AND b = b0) AS conflated FROM o"""
    out["weighted_tags"] = rf"""WITH t AS (SELECT page_id AS docid, unnest(regexp_extract_all(lower(array_to_string(regexp_extract_all(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), ' ')), '{WORDS}')) AS term, 5 AS w FROM pages
UNION ALL SELECT page_id, unnest(regexp_extract_all(lower(array_to_string(regexp_extract_all(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), ' ')), '{WORDS}')), 3 FROM pages)
SELECT docid, term, sum(w)::BIGINT AS extra FROM t GROUP BY ALL"""
    out["title_terms"] = f"SELECT page_id AS docid, 'tf:' || {_TITLE} AS term, 99 AS extra FROM pages WHERE {_TITLE} <> ''"
    out["snippet_title"] = f"SELECT page_id, left({_squeezed(chr(39).join(['regexp_extract(html, ', '(?is)<title\\b[^>]*>(.*?)</title>', ', 1)']))}, 300) AS snippet FROM pages"
    after = "regexp_extract(html, '(?is)</h1>(.*)', 1)"
    out["snippet_beginning"] = f"SELECT page_id, left({_squeezed(f'CASE WHEN {after} = {chr(39) * 2} THEN html ELSE {after} END')}, 300) AS snippet FROM pages"
    line = "topic || ' Q0 ' || docid || ' ' || rank || ' ' || printf('%.6f', rsv) || ' lodestar' AS line"
    out["trec_run"] = f"SELECT {line} FROM ({_rank('bm25')})"
    out["inex_run"] = f"""SELECT topic::BIGINT AS topic, '<topic topic-id="' || topic || '" run-id="lodestar">' || string_agg('<result><file>' || docid || '</file><path>/article[1]</path><rank>' || rank || '</rank><rsv>' || printf('%.6f', rsv) || '</rsv></result>', '' ORDER BY rank) || '</topic>' AS line FROM ({_rank('bm25', k=5)}) GROUP BY topic"""
    out["hit_list"] = f"SELECT topic::BIGINT AS topic, rank, '<hit><rank>' || rank || '</rank><id>' || docid || '</id><rsv>' || printf('%.2f', rsv) || '</rsv></hit>' AS line FROM ({_rank('bm25', k=5)})"
    out["dictionary_range"] = f"WITH {BASE} SELECT term, cf, df FROM dict WHERE term >= 'm' AND term < 'n'"
    out["list_terms"] = f"WITH {BASE} SELECT term, cf, df FROM dict WHERE term >= 'par' ORDER BY term LIMIT 25"
    out["zipf"] = f"WITH {BASE}, r AS (SELECT row_number() OVER (ORDER BY cf DESC, term) AS rank, term, cf FROM dict) SELECT rank, term, cf, round(rank * cf / l, 6) AS zipf FROM r, st WHERE rank <= 100"
    return out
