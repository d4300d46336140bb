"""DuckDB twins of `queries`, written from the definitions with DuckDB's own functions (lgamma instead of rising factorials)."""

from __future__ import annotations

# Written out again here, apart from what the plans use, so that the comparison notices a change of either.
# The short stop list without its first line, and the word tokenizer as (pattern, replacement) in order.
STOP_WORDS = ["`", "-", "--", "+", ":", ";", "``", "''", "[", "]", ".", "?", "!", ","]
TOKEN_STEPS = [
    (r'(^|[ (\[{<])"', r"\1`` "),
    (r'"', r" '' "),
    (r"([,;:@#$%&?!()\[\]{}<>*|])", r" \1 "),
    (r"--", r" -- "),
    (r"\.( |$)", r" . \1"),
    (r"n't( |$)", r" n't \1"),
    (r"'(s|m|d|re|ll|ve|S|M|D|RE|LL|VE)( |$)", r" '\1 \2"),
]

# The published stemming rules, (suffix, replacement), and the suffixes of its fourth step.
STEM_RULES = [
    [("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"),
     ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("alli", "al"), ("ator", "ate"), ("logi", "log"),
     ("bli", "ble"), ("eli", "e")],
    [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")],
]
STEM_ENDS = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tokenized(expr: str) -> str:
    for pattern, replacement in TOKEN_STEPS:
        expr = f"regexp_replace({expr}, {_quote(pattern)}, {_quote(replacement)}, 'g')"
    return expr


_STOP = "[" + ", ".join(_quote(w) for w in STOP_WORDS) + "]"
_R = lambda x: f"round({x}, 6) + 0.0"

DOCS = r"""docs AS (SELECT coalesce(source, '') || '/' || CAST(floor(doc_id / 1000) AS BIGINT) AS docset, doc_id, regexp_replace(text, '\n$', '') AS text
        FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"""
LINES = f"""{DOCS},
    lines AS (SELECT docset, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT docset, doc_id, string_split(text, chr(10)) AS l FROM docs))"""
SPLIT = f"""{LINES},
    split AS (SELECT docset, doc_id, pos, list_filter(string_split(lower({_tokenized("regexp_replace(line, '&[^;]*;', '', 'g')")}), ' '), lambda t: t <> '') AS toks FROM lines)"""
ALL_TOKENS = f"""{SPLIT},
    tokens AS (SELECT docset, doc_id, pos, unnest(toks) AS term, unnest(range(len(toks))) AS tok_pos FROM split)"""
TOKENS = f"""{SPLIT},
    tokens AS (SELECT docset, doc_id, pos, unnest(t) AS term, unnest(range(len(t))) AS tok_pos
               FROM (SELECT *, list_filter(toks, lambda t: NOT list_contains({_STOP}, t)) AS t FROM split))"""
BOW = f"""{TOKENS},
    bow AS (SELECT docset, doc_id, pos, term, count(*) AS cnt FROM tokens GROUP BY ALL),
    vocab AS (SELECT docset, count(DISTINCT term) AS w FROM bow GROUP BY ALL),
    dbow AS (SELECT docset, doc_id, term, sum(cnt)::BIGINT AS cnt FROM bow GROUP BY ALL)"""
_SIZES = "sizes AS (SELECT docset, doc_id, max(pos) + 1 AS n FROM lines GROUP BY ALL)"
_K = "ks AS (SELECT *, least(n, greatest(1, CAST(ceil(n / 5) AS BIGINT))) AS k FROM sizes)"
_UNIFORM = """{name} AS (SELECT docset, doc_id, pos, (SELECT count(*) FROM range(1, {k} + 1) AS r(j) WHERE floor(j * n / {k} + 0.5) <= pos) AS label
        FROM (SELECT *, unnest(range(n)) AS pos FROM (SELECT docset, doc_id, n, least(n, {want}) AS kk FROM ks)))"""
UNIFORM = f"{_SIZES}, {_K}, " + _UNIFORM.format(name="ref", k="kk", want="k")
BOTH = UNIFORM + ", " + _UNIFORM.format(name="hyp", k="kk", want="k + 1") + """,
    labels AS (SELECT docset, doc_id, pos, ref.label AS ref, hyp.label AS hyp FROM ref JOIN hyp USING (docset, doc_id, pos))"""
_RUNS = """runs_{x} AS (SELECT docset, doc_id, label, seg, min(pos) AS start, max(pos) + 1 AS "end" FROM (
        SELECT *, sum(c) OVER (PARTITION BY docset, doc_id ORDER BY pos) AS seg FROM (
            SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY docset, doc_id ORDER BY pos) THEN 1 ELSE 0 END AS c FROM {x})) GROUP BY ALL)"""
CLUSTERS = BOTH + ", " + _RUNS.format(x="ref") + ", " + _RUNS.format(x="hyp") + """,
    cr AS (SELECT docset, CAST(label AS VARCHAR) AS label, doc_id, start, "end" - 1 AS fin FROM runs_ref WHERE label >= 0),
    ch AS (SELECT docset, CAST(label AS VARCHAR) AS label, doc_id, start, "end" - 1 AS fin FROM runs_hyp WHERE label >= 0),
    tr AS (SELECT docset, label AS ref, sum(fin - start + 1)::BIGINT AS total FROM cr GROUP BY ALL),
    th AS (SELECT docset, label AS hyp, sum(fin - start + 1)::BIGINT AS hyp_total FROM ch GROUP BY ALL),
    ov AS (SELECT cr.docset, cr.label AS ref, ch.label AS hyp, sum(least(cr.fin, ch.fin) - greatest(cr.start, ch.start) + 1)::BIGINT AS overlap
           FROM cr JOIN ch ON cr.docset = ch.docset AND cr.doc_id = ch.doc_id AND cr.start <= ch.fin AND ch.start <= cr.fin GROUP BY ALL),
    kset AS (SELECT docset, count(DISTINCT label) AS k FROM cr GROUP BY ALL),
    nset AS (SELECT docset, count(*) AS n FROM labels GROUP BY ALL),
    best AS (SELECT tr.docset, tr.ref, total, coalesce(overlap, 0) AS overlap, coalesce(hyp_total, 0) AS hyp_total FROM tr LEFT JOIN (
                SELECT *, row_number() OVER (PARTITION BY docset, ref ORDER BY overlap DESC, hyp) AS r FROM ov JOIN th USING (docset, hyp)) AS b
             ON b.docset = tr.docset AND b.ref = tr.ref AND b.r = 1),
    prf0 AS (SELECT docset, avg(CASE WHEN overlap > 0 THEN overlap / hyp_total ELSE 0.0 END) AS p, avg(CASE WHEN overlap > 0 THEN overlap / total ELSE 0.0 END) AS r FROM best GROUP BY ALL),
    prf AS (SELECT *, CASE WHEN p * r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM prf0),
    hr AS (SELECT docset, -sum(total / n * ln(total / n)) AS h FROM tr JOIN nset USING (docset) GROUP BY ALL),
    hh AS (SELECT docset, -sum(hyp_total / n * ln(hyp_total / n)) AS h FROM th JOIN nset USING (docset) GROUP BY ALL),
    mi AS (SELECT docset, sum(overlap / n * (ln(overlap / n) - ln(total / n * hyp_total / n))) AS m FROM ov JOIN tr USING (docset, ref) JOIN th USING (docset, hyp) JOIN nset USING (docset) GROUP BY ALL),
    vi AS (SELECT docset, CASE WHEN n > 1 THEN 1 - (coalesce(hr.h, 0) + coalesce(hh.h, 0) - 2 * coalesce(m, 0)) / ln(n) END AS norm_vi
           FROM nset LEFT JOIN hr USING (docset) LEFT JOIN hh USING (docset) LEFT JOIN mi USING (docset)),
    ri AS (SELECT docset, CASE WHEN n > 1 THEN 2.0 * greatest(0, n * (n - 1) // 2 - coalesce(h, 0) - coalesce(r, 0)) / (n * (n - 1)) ELSE 0.0 END AS rand_like
           FROM nset LEFT JOIN (SELECT docset, sum(CASE WHEN overlap > 0 THEN hyp_total ELSE 0 END)::BIGINT AS h, sum(total)::BIGINT AS r FROM best GROUP BY ALL) USING (docset)),
    cc AS (SELECT docset, doc_id, pos, ref, hyp, sum(dr) OVER w AS c_ref, sum(dh) OVER w AS c_hyp FROM (
             SELECT *, CASE WHEN ref <> lag(ref) OVER w THEN 1 ELSE 0 END AS dr, CASE WHEN hyp <> lag(hyp) OVER w THEN 1 ELSE 0 END AS dh FROM labels
             WINDOW w AS (PARTITION BY docset, doc_id ORDER BY pos)) WINDOW w AS (PARTITION BY docset, doc_id ORDER BY pos)),
    win AS (SELECT docset, doc_id, count(*) AS n, any_value(k) AS k, count(*) // (2 * any_value(k)) AS w, avg(CASE WHEN ref = hyp THEN 1.0 ELSE 0.0 END) AS accuracy,
                   (max(c_hyp) + 1) / (max(c_ref) + 1) AS length_ratio FROM cc JOIN kset USING (docset) GROUP BY docset, doc_id),
    score AS (SELECT win.docset, win.doc_id, any_value(n) AS n, sum(CASE WHEN (b.c_ref <> a.c_ref) <> (b.c_hyp <> a.c_hyp) THEN 1 ELSE 0 END) / any_value(n - w) AS pk,
                     sum(CASE WHEN b.c_ref - a.c_ref <> b.c_hyp - a.c_hyp THEN 1 ELSE 0 END) / any_value(n - w) AS windowdiff, any_value(accuracy) AS accuracy, any_value(length_ratio) AS length_ratio
              FROM win JOIN cc AS a ON a.docset = win.docset AND a.doc_id = win.doc_id JOIN cc AS b ON b.docset = a.docset AND b.doc_id = a.doc_id AND b.pos = a.pos + w GROUP BY 1, 2)"""
# lgamma with lgamma(0) = 0
_LG = lambda x: f"(CASE WHEN ({x}) = 0 THEN 0.0 ELSE lgamma(CAST({x} AS DOUBLE)) END)"
_DCM = "sum(lgamma(cnt + 0.1) - lgamma(0.1)) - (lgamma(0.1 * any_value(w) + sum(cnt)) - lgamma(0.1 * any_value(w)))"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def _type_prior(xs: list[str], ps: list[float]) -> str:
    total, p = " + ".join(xs), sum(ps)
    out = f"{_LG(total)} + {_LG(str(p))} - {_LG(f'{total} + {p}')}"
    for x, q in zip(xs, ps, strict=True):
        out += f" + {_LG(f'{x} + {q}')} - {_LG(str(q))} - {_LG(x)}"
    return _R(out)



def _stems() -> str:
    """CTEs st0 .. st8 of (term, w), w after each step; sh tells the letters of w apart as c or v, so that a measure counts its `vc`."""
    vowel = "x IN ('a', 'e', 'i', 'o', 'u')"
    shape = f"""list_reduce(list_concat([CASE WHEN regexp_matches(w, '^[aeiou]') THEN 'v' ELSE 'c' END], string_split_regex(w, '')[2:]),
                lambda a, x: a || CASE WHEN {vowel} OR (x = 'y' AND a[-1] = 'c') THEN 'v' ELSE 'c' END)"""
    cut = lambda k, what="w": f"left({what}, length(w) - {k})"
    measure = lambda k: f"((length({cut(k, 'sh')}) - length(replace({cut(k, 'sh')}, 'vc', ''))) // 2)"
    short = lambda k: f"(regexp_matches({cut(k, 'sh')}, 'cvc$') AND NOT regexp_matches({cut(k)}, '[wxy]$'))"
    when = lambda s, yes, to: f"WHEN suffix(w, '{s}') THEN CASE WHEN {yes} THEN {to} ELSE w END"
    replaced = lambda rules: "CASE " + " ".join(when(s, f"{measure(len(s))} > 0", f"{cut(len(s))} || '{r}'") for s, r in rules) + " ELSE w END"
    cut_off = lambda s: f"(suffix(w, '{s}') AND NOT suffix(w, 'eed') AND contains({cut(len(s), 'sh')}, 'v'))"
    ended = "regexp_matches({}, '[st]$')"
    steps = [
        f"CASE WHEN regexp_matches(w, '(sses|ies)$') THEN {cut(2)} WHEN regexp_matches(w, 's$') AND NOT suffix(w, 'ss') THEN {cut(1)} ELSE w END",
        f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {measure(3)} > 0 THEN {cut(1)} ELSE w END WHEN {cut_off('ed')} THEN {cut(2)} || '+' WHEN {cut_off('ing')} THEN {cut(3)} || '+' ELSE w END",
        # A word with + lost its end: the + goes, an e comes back, or one of two equal consonants goes.
        f"""CASE WHEN NOT suffix(w, '+') OR w = term THEN w WHEN regexp_matches(w, '(at|bl|iz)[+]$') THEN {cut(1)} || 'e'
            WHEN length(w) > 2 AND w[-2] = w[-3] AND {cut(1, "sh")}[-1] = 'c' THEN CASE WHEN w[-2] IN ('l', 's', 'z') THEN {cut(1)} ELSE {cut(2)} END
            WHEN {measure(1)} = 1 AND {short(1)} THEN {cut(1)} || 'e' ELSE {cut(1)} END""",
        f"CASE WHEN suffix(w, 'y') AND contains({cut(1, 'sh')}, 'v') THEN {cut(1)} || 'i' ELSE w END",
        replaced(STEM_RULES[0]),
        replaced(STEM_RULES[1]),
        "CASE " + " ".join(when(s, f"{measure(len(s))} > 1" + (f" AND {ended.format(cut(3))}" if s == "ion" else ""), cut(len(s))) for s in STEM_ENDS) + " ELSE w END",
        f"CASE WHEN suffix(w, 'e') AND ({measure(1)} > 1 OR ({measure(1)} = 1 AND NOT {short(1)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN suffix(w, 'll') AND {measure(0)} > 1 THEN {cut(1)} ELSE w END",
    ]
    out = "st0 AS (SELECT DISTINCT term, term AS w FROM tokens)"
    for n, step in enumerate(steps):
        out += f", st{n + 1} AS MATERIALIZED (SELECT term, CASE WHEN length(term) < 3 THEN term ELSE {step} END AS w FROM (SELECT term, w, {shape} AS sh FROM st{n}))"
    return out + f", stems AS (SELECT term, w AS stem FROM st{len(steps)})"


_BY_DOC = CLUSTERS
for _x, _y in (("cr AS (SELECT docset,", "cr AS (SELECT docset || '#' || doc_id AS docset,"), ("ch AS (SELECT docset,", "ch AS (SELECT docset || '#' || doc_id AS docset,"),
               ("kset AS (SELECT docset, count(DISTINCT label) AS k FROM cr GROUP BY ALL)", "kset AS (SELECT docset, count(DISTINCT label) AS k FROM runs_ref WHERE label >= 0 GROUP BY ALL)"),
               ("nset AS (SELECT docset, count(*) AS n", "nset AS (SELECT docset || '#' || doc_id AS docset, count(*) AS n")):
    _BY_DOC = _BY_DOC.replace(_x, _y)
_HALF_UP = lambda c, n=4: f"printf('%.{n}f', floor(coalesce({c}, 0.0) * {10**n} + 0.500000001) / {10**n})"

# up[s, e]: the words' part of the score of sentences s .. e - 1, for every range of every document.
_RANGES = f"""{BOW}, {_SIZES}, {_K},
    pairs AS (SELECT docset, doc_id, s, unnest(range(s + 1, n + 1)) AS e FROM (SELECT docset, doc_id, n, unnest(range(n)) AS s FROM ks)),
    occ AS (SELECT docset, doc_id, term, pos, cnt, sum(cnt) OVER w AS upto, lead(pos) OVER w AS later FROM bow WINDOW w AS (PARTITION BY docset, doc_id, term ORDER BY pos)),
    steps AS (SELECT b.docset, b.doc_id, a.pos AS p, b.pos AS q, sum(CASE WHEN a.pos = b.pos THEN lgamma(b.cnt + 0.1) - lgamma(0.1)
                  ELSE lgamma(b.upto - a.upto + a.cnt + 0.1) - lgamma(b.upto - a.upto + 0.1) - lgamma(b.upto - b.cnt - a.upto + a.cnt + 0.1) + lgamma(b.upto - b.cnt - a.upto + 0.1) END) AS d
              FROM occ AS a JOIN occ AS b ON a.docset = b.docset AND a.doc_id = b.doc_id AND a.term = b.term AND a.pos <= b.pos GROUP BY ALL),
    grid AS (SELECT docset, doc_id, p, q, sum(coalesce(d, 0.0)) OVER (PARTITION BY docset, doc_id, p ORDER BY q) AS row_sum
             FROM (SELECT docset, doc_id, s AS p, e - 1 AS q FROM pairs) LEFT JOIN steps USING (docset, doc_id, p, q)),
    words AS (SELECT docset, doc_id, pos, sum(cnt) AS c FROM bow GROUP BY ALL),
    upto AS (SELECT docset, doc_id, pos, sum(coalesce(c, 0)) OVER (PARTITION BY docset, doc_id ORDER BY pos) AS c FROM lines LEFT JOIN words USING (docset, doc_id, pos)),
    scores AS MATERIALIZED (SELECT g.docset, g.doc_id, p AS s, q + 1 AS e, sum(row_sum) OVER (PARTITION BY g.docset, g.doc_id, q ORDER BY p DESC)
                  - lgamma(0.1 * w + b.c - coalesce(a.c, 0)) + lgamma(0.1 * w) AS score
               FROM grid AS g JOIN vocab USING (docset) JOIN upto AS b ON b.docset = g.docset AND b.doc_id = g.doc_id AND b.pos = q
               LEFT JOIN upto AS a ON a.docset = g.docset AND a.doc_id = g.doc_id AND a.pos = p - 1)"""
_PIECES = """SELECT docset, doc_id, i - 1 AS seg, CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END AS start, ends[i] AS "end"
             FROM (SELECT docset, doc_id, ends, unnest(range(1, len(ends) + 1)) AS i FROM {paths})"""



def _clusters(pieces: str, seed: int = 1) -> str:
    """k-means++ over a query of pieces (docset, doc_id, start, "end"): one recursion draws the seeds, another moves labels until none changes."""
    return f""",
    n_set AS (SELECT docset, count(*) AS n FROM (SELECT DISTINCT docset, doc_id, pos FROM bow) GROUP BY ALL),
    tfidf AS (SELECT b.docset, b.doc_id, b.pos, b.term, b.cnt / t.total * ln(n / (1.0 + df)) AS x FROM bow AS b
              JOIN (SELECT docset, doc_id, pos, sum(cnt) AS total FROM bow GROUP BY ALL) AS t USING (docset, doc_id, pos)
              JOIN (SELECT docset, term, count(*) AS df FROM bow GROUP BY ALL) USING (docset, term) JOIN n_set USING (docset)),
    pts AS MATERIALIZED ({pieces}),
    vec AS MATERIALIZED (SELECT p.docset, p.doc_id, p.start, term, sum(x) AS v FROM pts AS p JOIN tfidf AS t ON t.docset = p.docset AND t.doc_id = p.doc_id AND pos >= start AND pos < "end" GROUP BY ALL),
    tot AS MATERIALIZED (SELECT docset, doc_id, start, sum(v) AS s FROM vec GROUP BY ALL),
    kk AS MATERIALIZED (SELECT docset, least(max(k), any_value(m)) AS k FROM ks JOIN (SELECT docset, count(*) AS m FROM pts GROUP BY ALL) USING (docset) GROUP BY docset),
    near AS (
        SELECT 0 AS j, docset, doc_id, start, 1.0::DOUBLE AS d, NULL::BIGINT AS label FROM pts
        UNION ALL
        (WITH scored AS (SELECT near.*, CASE WHEN label IS NOT NULL THEN 2e300 WHEN d > 0
                            THEN -ln((('0x' || substr(md5(concat_ws('/', {seed}, j, docset, doc_id, start)), 1, 8))::BIGINT + 0.5) / 4294967296) / (d * d) ELSE 1e300 END AS score
                         FROM near JOIN kk USING (docset) WHERE j < k),
         pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY docset ORDER BY score, doc_id, start) AS r FROM scored) WHERE r = 1),
         centre AS (SELECT docset, term, v FROM vec JOIN pick USING (docset, doc_id, start)),
         dots AS (SELECT vec.docset, vec.doc_id, vec.start, sum(vec.v * centre.v) AS dot FROM vec JOIN centre USING (docset, term) GROUP BY ALL),
         far AS (SELECT docset, sum(v) AS total FROM centre GROUP BY ALL)
         SELECT a.j + 1, a.docset, a.doc_id, a.start, least(a.d, CASE WHEN dot > 0 AND s > 0 AND total > 0 THEN round(1 - dot / sqrt(s * total), 9) ELSE 1.0 END),
                CASE WHEN pick.doc_id IS NOT NULL THEN a.j ELSE a.label END
         FROM scored AS a LEFT JOIN pick ON pick.docset = a.docset AND pick.doc_id = a.doc_id AND pick.start = a.start
              LEFT JOIN dots ON dots.docset = a.docset AND dots.doc_id = a.doc_id AND dots.start = a.start
              LEFT JOIN tot ON tot.docset = a.docset AND tot.doc_id = a.doc_id AND tot.start = a.start LEFT JOIN far ON far.docset = a.docset)),
    labels_ AS (
        SELECT 0 AS it, docset, doc_id, start, label, -1::BIGINT AS prev FROM near JOIN kk USING (docset) WHERE j = k
        UNION ALL
        (WITH now AS (SELECT * FROM (SELECT *, max(CASE WHEN label IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY docset) AS moved FROM labels_) WHERE moved = 1 AND it < 100),
         m AS (SELECT docset, label, count(*) AS m FROM now WHERE label IS NOT NULL GROUP BY ALL),
         c AS (SELECT docset, label, term, sum(v) / any_value(m) AS c FROM vec JOIN now USING (docset, doc_id, start) JOIN m USING (docset, label) GROUP BY ALL),
         ct AS (SELECT docset, label, sum(c) AS total FROM c GROUP BY ALL),
         dots AS (SELECT vec.docset, doc_id, start, label, sum(v * c) AS dot FROM vec JOIN c USING (docset, term) GROUP BY ALL),
         ds AS (SELECT docset, doc_id, start, label, CASE WHEN dot > 0 AND s > 0 AND total > 0 THEN round(1 - dot / sqrt(s * total), 9) ELSE 1.0 END AS d
                FROM dots JOIN tot USING (docset, doc_id, start) JOIN ct USING (docset, label)),
         best AS (SELECT docset, doc_id, start, min({{'d': d, 'l': label}}) AS b FROM ds GROUP BY ALL),
         new AS (SELECT now.it, now.docset, now.doc_id, now.start, now.label AS prev, CASE WHEN b.d < 1 THEN b.l ELSE 0 END AS label, CASE WHEN b.d < 1 THEN b.d ELSE 1.0 END AS d
                 FROM now LEFT JOIN best ON best.docset = now.docset AND best.doc_id = now.doc_id AND best.start = now.start),
         lost AS (SELECT docset, l AS takes, row_number() OVER (PARTITION BY docset ORDER BY l) AS r FROM (SELECT docset, unnest(range(k)) AS l FROM kk WHERE docset IN (SELECT docset FROM now)) AS e
                  WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.docset = e.docset AND new.label = e.l)),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY docset ORDER BY d DESC, doc_id, start) AS r FROM new)
         SELECT it + 1, ranked.docset, doc_id, start, coalesce(takes, label), prev FROM ranked LEFT JOIN lost ON lost.docset = ranked.docset AND lost.r = ranked.r)),
    ended AS (SELECT docset, doc_id, start, label FROM labels_ WHERE (docset, it) IN (SELECT (docset, max(it)) FROM labels_ GROUP BY docset))
    SELECT docset, doc_id, start, "end", CASE WHEN count(*) OVER (PARTITION BY docset, label) = 1 THEN -(label + 1) ELSE label END AS label FROM pts JOIN ended USING (docset, doc_id, start)"""


ORACLE_SQL = {
    "best_cut": _with(f"{BOW}, {_SIZES}", f"""
        , cuts AS (SELECT docset, doc_id, n, unnest(range(1, n)) AS cut FROM sizes WHERE n > 1),
        lefts AS (SELECT c.docset, c.doc_id, cut, term, sum(CASE WHEN pos < cut THEN cnt ELSE 0 END) AS l, sum(CASE WHEN pos >= cut THEN cnt ELSE 0 END) AS r
                  FROM cuts AS c LEFT JOIN bow AS b ON b.docset = c.docset AND b.doc_id = c.doc_id GROUP BY ALL),
        scored AS (SELECT docset, doc_id, cut, coalesce(sum(lgamma(l + 0.1) + lgamma(r + 0.1) - 2 * lgamma(0.1)) FILTER (term IS NOT NULL), 0.0)
                      - (lgamma(0.1 * any_value(w) + sum(l)) - lgamma(0.1 * any_value(w))) - (lgamma(0.1 * any_value(w) + sum(r)) - lgamma(0.1 * any_value(w))) AS logp
                   FROM lefts JOIN vocab USING (docset) GROUP BY ALL)
        SELECT docset, doc_id, cut, {_R("logp")} AS logp FROM (SELECT *, row_number() OVER (PARTITION BY docset, doc_id ORDER BY round(logp, 6) DESC, cut DESC) AS i FROM scored) WHERE i = 1"""),
    "lines": _with(LINES, "SELECT docset, doc_id, pos, line FROM lines"),
    "normalized_lines": _with(SPLIT, "SELECT docset, doc_id, pos, array_to_string(toks, ' ') AS line FROM split"),
    "tokens": _with(ALL_TOKENS, "SELECT docset, doc_id, pos, tok_pos, term FROM tokens"),
    "stop_filtered": _with(ALL_TOKENS, f"SELECT docset, doc_id, count(*) AS kept, count(DISTINCT term) AS terms FROM tokens WHERE NOT list_contains({_STOP}, term) GROUP BY ALL"),
    "vocabulary": _with(TOKENS, """SELECT docset, term, row_number() OVER (PARTITION BY docset ORDER BY f, term) - 1 AS term_id
        FROM (SELECT docset, term, min({'d': doc_id, 'p': pos, 't': tok_pos}) AS f FROM tokens GROUP BY ALL)"""),
    "dictionary_round_trip": _with(TOKENS, "SELECT docset, count(*) AS tokens, count(DISTINCT term) AS terms FROM tokens GROUP BY ALL"),
    "sentence_bow": _with(BOW, "SELECT docset, doc_id, pos, term, cnt FROM bow"),
    "vector_reductions": _with(BOW, "SELECT docset, doc_id, pos, sum(cnt)::BIGINT AS total, count(*) AS size, count(*) FILTER (cnt > 0) AS nonzero FROM bow GROUP BY ALL"),
    "vector_difference": _with(BOW, """SELECT * FROM (SELECT d.docset, d.doc_id, d.term, (d.cnt - coalesce(b.cnt, 0))::BIGINT AS cnt
        FROM dbow AS d LEFT JOIN bow AS b ON b.docset = d.docset AND b.doc_id = d.doc_id AND b.term = d.term AND b.pos = 0) WHERE cnt <> 0"""),
    "vector_projections": _with(BOW, """
        , ids AS (SELECT docset, term, row_number() OVER (PARTITION BY docset ORDER BY f, term) - 1 AS id
                  FROM (SELECT docset, term, min({'d': doc_id, 'p': pos, 't': tok_pos}) AS f FROM tokens GROUP BY ALL))
        SELECT docset, doc_id, count(*) AS n_ids, sum(cnt)::BIGINT AS total, coalesce(max(cnt) FILTER (id = 0), 0) AS at_0,
               array_to_string(list_transform(range(5), lambda i: coalesce(list_sum(list_transform(list_filter(list({'i': id, 'c': cnt}), lambda e: e.i = i), lambda e: e.c)), 0)::BIGINT), ',') AS first_5,
               md5(sum(cnt)::BIGINT || ' ' || string_agg(repeat((id + 1) || ' ', cnt - 1) || (id + 1), ' ' ORDER BY id)) AS dump_md5
        FROM dbow JOIN ids USING (docset, term) GROUP BY docset, doc_id"""),
    "range_counts": _with(f"{BOW}, {_SIZES}", """SELECT docset, doc_id, start, "end", term, sum(cnt)::BIGINT AS cnt
        FROM bow JOIN (SELECT docset, doc_id, n // 4 AS start, CAST(ceil(n * 3 / 4) AS BIGINT) AS "end" FROM sizes) USING (docset, doc_id) WHERE pos >= start AND pos < "end" GROUP BY ALL"""),
    "tf_idf": _with(BOW, f"""
        , s AS (SELECT docset, doc_id, pos, sum(cnt) AS total FROM bow GROUP BY ALL), n AS (SELECT docset, count(*) AS n FROM s GROUP BY ALL),
        df AS (SELECT docset, term, count(*) AS df FROM bow GROUP BY ALL)
        SELECT docset, doc_id, pos, term, {_R("cnt / total * ln(n / (1.0 + df))")} AS tfidf FROM bow JOIN s USING (docset, doc_id, pos) JOIN df USING (docset, term) JOIN n USING (docset)"""),
    "dcm_sentence": _with(BOW, f"SELECT docset, doc_id, pos, {_R(_DCM)} AS logp FROM bow JOIN vocab USING (docset) GROUP BY docset, doc_id, pos"),
    "dcm_document": _with(BOW, f"SELECT docset, doc_id, {_R(_DCM)} AS logp FROM dbow JOIN vocab USING (docset) GROUP BY docset, doc_id"),
    "dcm_gradient": _with(BOW, f"""SELECT docset, doc_id, {_R("up - w * list_sum(list_transform(range(n), lambda i: 1 / (0.1 * w + i)))")} AS gradient
        FROM (SELECT docset, doc_id, w, sum(cnt)::BIGINT AS n, sum(list_sum(list_transform(range(cnt), lambda i: 1 / (0.1 + i)))) AS up FROM dbow JOIN vocab USING (docset) GROUP BY ALL)"""),
    "topic_type_prior": _with(f"{LINES}, {_SIZES}, {_K}", f"""SELECT docset, doc_id, {_type_prior(["x1", "x2"], [5.0, 1.0])} AS logp, {_type_prior(["x1", "x2"], [10.0, 0.0])} AS logp_zero,
        {_type_prior(["x1", "x2", "1"], [5.0, 1.0, 0.5])} AS logp_three FROM (SELECT docset, doc_id, k AS x1, n % 4 AS x2 FROM ks)"""),
    "topic_proportion": _with(f"{LINES}, {UNIFORM}", f"""SELECT docset, {_R("sum(lgamma(c + 1.0) - lgamma(1.0)) + lgamma(CAST(count(*) AS DOUBLE)) - lgamma(CAST(count(*) + sum(c) AS DOUBLE))")} AS logp
        FROM (SELECT docset, label, count(*) AS c FROM ref GROUP BY ALL) GROUP BY docset"""),
    "topic_sizes": _with(f"{LINES}, {UNIFORM}", "SELECT docset, label AS topic, count(*) AS n_dish, count(DISTINCT doc_id) AS n_restaurant FROM ref GROUP BY ALL"),
    "unigram": _with(BOW, f"SELECT docset, doc_id, term, {_R('(cnt + 0.1) / (0.1 * w + sum(cnt) OVER (PARTITION BY docset, doc_id))')} AS p FROM dbow JOIN vocab USING (docset)"),
    "skewed_kl": _with(f"{BOW}, {_SIZES}", f"""
        , halves AS (SELECT docset, doc_id, 2 * pos < n AS early, term, sum(cnt) AS cnt FROM bow JOIN sizes USING (docset, doc_id) GROUP BY ALL),
        m AS (SELECT *, (cnt + 0.1) / (0.1 * w + sum(cnt) OVER (PARTITION BY docset, doc_id, early)) AS p FROM halves JOIN vocab USING (docset))
        SELECT r.docset, r.doc_id, {_R("sum(r.p * (ln(r.p) - ln(0.99 * coalesce(l.p, 0.0) + 0.01 * r.p)))")} AS kl
        FROM m AS r LEFT JOIN m AS l ON l.docset = r.docset AND l.doc_id = r.doc_id AND l.term = r.term AND l.early WHERE NOT r.early GROUP BY r.docset, r.doc_id"""),
    "segment_logprob": _with(f"{BOW}, {UNIFORM}", f"""SELECT docset, doc_id, seg, {_R(_DCM)} AS logp
        FROM (SELECT docset, doc_id, label AS seg, term, sum(cnt) AS cnt FROM bow JOIN ref USING (docset, doc_id, pos) GROUP BY ALL) JOIN vocab USING (docset) GROUP BY docset, doc_id, seg"""),
    "corpus_loglik": _with(f"{BOW}, {UNIFORM}", f"""
        , g AS (SELECT docset, {_DCM} AS logp FROM (SELECT docset, label, term, sum(cnt) AS cnt FROM bow JOIN ref USING (docset, doc_id, pos) WHERE label % 2 = 0 GROUP BY ALL) JOIN vocab USING (docset) GROUP BY docset, label),
        l AS (SELECT docset, {_DCM} AS logp FROM (SELECT docset, doc_id, label, term, sum(cnt) AS cnt FROM bow JOIN ref USING (docset, doc_id, pos) WHERE label % 2 = 1 GROUP BY ALL) JOIN vocab USING (docset) GROUP BY docset, doc_id, label),
        t AS (SELECT docset, doc_id, count(DISTINCT label) FILTER (label % 2 = 0) AS x1, count(DISTINCT label) FILTER (label % 2 = 1) AS x2 FROM ref GROUP BY ALL),
        p AS (SELECT docset, {_type_prior(["x1", "x2"], [5.0, 1.0]).replace("round(", "(").replace(", 6) + 0.0", ")")} AS logp FROM t WHERE x2 > 0)
        SELECT docset, {_R("sum(logp)")} AS loglik FROM (SELECT * FROM g UNION ALL SELECT * FROM l UNION ALL SELECT * FROM p) GROUP BY docset"""),
    "uniform_segments": _with(f"{LINES}, {UNIFORM}", "SELECT docset, doc_id, pos, label FROM ref"),
    "label_runs": _with(f"{LINES}, {UNIFORM}, {_RUNS.format(x='ref')}", 'SELECT docset, doc_id, seg::BIGINT AS seg, start, "end", label FROM runs_ref'),
    "anneal_schedule": _with(f"{LINES}, {_SIZES}", f"""SELECT docset, doc_id, it, {_R("t")} AS t, {_R("pow(0.5, 1 / t)")} AS half FROM (
        SELECT *, CASE WHEN it < n / 4 THEN 1 + 4 * (1 - it / (n / 4)) WHEN it <= n - n / 4 THEN 1.0 ELSE (n - it + 1) / (n / 4) END AS t FROM (SELECT docset, doc_id, n, unnest(range(1, n + 1)) AS it FROM sizes))"""),
    "step_proposals": _with(f"{LINES}, {UNIFORM}, {_RUNS.format(x='ref')}", f"""
        , edges AS (SELECT docset, doc_id, seg, start, "end" AS cut, lead("end") OVER (PARTITION BY docset, doc_id ORDER BY seg) AS later FROM runs_ref),
        steps AS (SELECT docset, doc_id, seg, unnest(range(greatest(start + 1 - cut, -5), least(later - 1 - cut, 5) + 1)) AS step FROM edges WHERE later IS NOT NULL),
        w AS (SELECT *, CASE WHEN step = 0 THEN 0.0 ELSE pow(abs(step), -1 / sqrt(5)) END AS w FROM steps)
        SELECT docset, doc_id, seg::BIGINT AS seg, step::BIGINT AS step, {_R("coalesce(w / nullif(sum(w) OVER (PARTITION BY docset, doc_id, seg), 0), 0.0)")} AS weight FROM w"""),
    "move_ratios": _with(f"{LINES}, {_SIZES}", f"""
        , x AS (SELECT docset, doc_id, n // 2 AS a, CAST(ceil(n / 2) AS BIGINT) AS b FROM sizes WHERE n > 1),
        y AS (SELECT *, ln(0.1) + {_LG("a - 1")} + {_LG("b - 1")} - {_LG("a + b - 1")} AS s FROM x)
        SELECT docset, doc_id, {_R("s")} AS split, {_R("-s")} AS merge, {_R(f"{_LG('a + b - 2')} - {_LG('a - 1')} - {_LG('b - 1')}")} AS swap, {_R("(a + b - 2) * ln(2)")} AS propose_split FROM y"""),
    "change_counts": _with(f"{LINES}, {CLUSTERS}", "SELECT docset, doc_id, pos, c_ref::BIGINT AS c_ref, c_hyp::BIGINT AS c_hyp FROM cc"),
    "document_scores": _with(f"{LINES}, {CLUSTERS}", f"SELECT docset, doc_id, n, {_R('pk')} AS pk, {_R('windowdiff')} AS windowdiff, {_R('accuracy')} AS accuracy, {_R('length_ratio')} AS length_ratio FROM score"),
    "cluster_totals": _with(f"{LINES}, {CLUSTERS}", "SELECT docset, ref AS label, total FROM tr"),
    "cluster_overlaps": _with(f"{LINES}, {CLUSTERS}", "SELECT docset, ref, hyp, overlap FROM ov"),
    "cluster_prf": _with(f"{LINES}, {CLUSTERS}", f"SELECT docset, {_R('p')} AS precision, {_R('r')} AS recall, {_R('f1')} AS f1 FROM prf"),
    "norm_vi": _with(f"{LINES}, {CLUSTERS}", f"SELECT docset, {_R('norm_vi')} AS norm_vi FROM vi"),
    "rand_like": _with(f"{LINES}, {CLUSTERS}", f"SELECT docset, {_R('rand_like')} AS rand_like FROM ri"),
    "rand_index": _with(f"{LINES}, {BOTH}", f"""
        , c AS (SELECT docset, ref, hyp, count(*) AS c FROM labels GROUP BY ALL), b AS (SELECT docset, sum(c * (c - 1) / 2) AS both_, sum(c) AS n FROM c GROUP BY ALL),
        r AS (SELECT docset, sum(x * (x - 1) / 2) AS v FROM (SELECT docset, ref, sum(c) AS x FROM c GROUP BY ALL) GROUP BY ALL), h AS (SELECT docset, sum(x * (x - 1) / 2) AS v FROM (SELECT docset, hyp, sum(c) AS x FROM c GROUP BY ALL) GROUP BY ALL)
        SELECT docset, {_R("CASE WHEN n > 1 THEN (n * (n - 1) / 2 + 2 * both_ - r.v - h.v) / (n * (n - 1) / 2) ELSE 1.0 END")} AS rand FROM b JOIN r USING (docset) JOIN h USING (docset)"""),
    "class_f1": _with(f"{LINES}, {BOTH}", f"""
        , k AS (SELECT docset, greatest(1, max(ref) + 1, max(hyp) + 1) AS k FROM labels GROUP BY ALL),
        z AS (SELECT docset, CASE WHEN ref >= 0 THEN ref ELSE k END AS r, CASE WHEN hyp >= 0 THEN hyp ELSE k END AS h, k FROM labels JOIN k USING (docset)),
        u AS (SELECT docset, k, r AS c, 1 AS t, 0 AS g, CASE WHEN r = h THEN 1 ELSE 0 END AS ok FROM z UNION ALL SELECT docset, k, h, 0, 1, 0 FROM z),
        f AS (SELECT docset, k, c, sum(t) AS t, 2.0 * sum(ok) / (sum(t) + sum(g)) AS f FROM u WHERE c < k GROUP BY ALL)
        SELECT docset, {_R("sum(f) / any_value(k)")} AS macro_f1, {_R("coalesce(sum(f * t) / nullif(sum(t), 0), 0.0)")} AS micro_f1 FROM f GROUP BY docset"""),
    "corpus_scores": _with(f"{LINES}, {CLUSTERS}", f"""
        , a AS (SELECT avg(accuracy) AS accuracy, avg(pk) AS pk, avg(windowdiff) AS windowdiff, avg(length_ratio) AS length_ratio FROM score),
        s AS (SELECT avg(p) AS precision, avg(r) AS recall, avg(norm_vi) AS norm_vi, avg(rand_like) AS rand_like FROM prf JOIN vi USING (docset) JOIN ri USING (docset))
        SELECT {", ".join(f"{_R(c)} AS {c}" for c in ("accuracy", "pk", "windowdiff", "length_ratio", "precision", "recall", "norm_vi", "rand_like"))},
               {_R("CASE WHEN precision * recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END")} AS f1 FROM a, s"""),
    "report": _with(f"{LINES}, {CLUSTERS}", r"""
        , d AS (SELECT docset, avg(accuracy) AS acc, avg(pk) AS pk, avg(windowdiff) AS wd, avg(length_ratio) AS len FROM score GROUP BY docset)
        SELECT docset, 'docName=' || docset || chr(9) || printf('P=%.4f', floor(p * 10000 + 0.500000001) / 10000) || chr(9) || printf('R=%.4f', floor(r * 10000 + 0.500000001) / 10000) || chr(9) || printf('F1=%.4f', floor(f1 * 10000 + 0.500000001) / 10000) || chr(9) || printf('VI=%.4f', floor(norm_vi * 10000 + 0.500000001) / 10000) || chr(9)
               || printf('RI=%.4f', floor(rand_like * 10000 + 0.500000001) / 10000) || chr(9) || printf('Pk=%.4f', floor(pk * 10000 + 0.500000001) / 10000) || chr(9) || printf('WD=%.4f', floor(wd * 10000 + 0.500000001) / 10000) || chr(9) || printf('len=%.2f', floor(len * 100 + 0.500000001) / 100) || chr(9) || printf('acc=%.4f', floor(acc * 10000 + 0.500000001) / 10000) AS line
        FROM d JOIN prf USING (docset) JOIN vi USING (docset) JOIN ri USING (docset)"""),
    "topic_words": _with(f"{BOW}, {UNIFORM}", f"""
        , v AS (SELECT docset, label AS topic, term, sum(cnt) AS c FROM bow JOIN ref USING (docset, doc_id, pos) GROUP BY ALL),
        s AS (SELECT docset, topic, sum(c) + 0.1 * count(*) AS size FROM v GROUP BY ALL),
        x AS (SELECT t.docset, t.term, s.topic, coalesce(v.c, 0) AS c, size FROM (SELECT DISTINCT docset, term FROM v) AS t JOIN s ON s.docset = t.docset LEFT JOIN v ON v.docset = t.docset AND v.term = t.term AND v.topic = s.topic),
        m AS (SELECT docset, term, avg(ln((c + 0.1) / size)) AS mean FROM x GROUP BY ALL),
        y AS (SELECT docset, topic, term, (c + 0.1) / size * (ln((c + 0.1) / size) - mean) AS score FROM v JOIN s USING (docset, topic) JOIN m USING (docset, term)),
        z AS (SELECT *, row_number() OVER (PARTITION BY docset, topic ORDER BY round(score, 9) DESC, term) AS rank FROM y)
        SELECT docset, topic, rank, term, {_R("score")} AS score FROM z WHERE rank <= 10"""),
    "segmented_lines": _with(f"{LINES}, {UNIFORM}", """
        , l AS (SELECT docset, doc_id, pos, line, label, starts_with(line, '=====') AS ruled FROM lines LEFT JOIN ref USING (docset, doc_id, pos) WHERE trim(line) <> ''),
        b AS (SELECT *, lag(label) OVER (PARTITION BY docset, doc_id, ruled ORDER BY pos) AS was, row_number() OVER (PARTITION BY docset, doc_id, ruled ORDER BY pos) AS nth, lead(pos) OVER (PARTITION BY docset, doc_id ORDER BY pos) AS later FROM l),
        r AS (SELECT docset, doc_id, pos, 0 AS part, '=====' || CASE WHEN label >= 0 THEN ' ' || label ELSE '' END AS out FROM b WHERE NOT ruled AND (nth = 1 OR label <> was)
              UNION ALL SELECT docset, doc_id, pos, 1, CASE WHEN ruled THEN replace(line, '=====', '-----') ELSE line END FROM b
              UNION ALL SELECT docset, doc_id, pos, 2, '=====' FROM b WHERE later IS NULL)
        SELECT docset, doc_id, row_number() OVER (PARTITION BY docset, doc_id ORDER BY pos, part) - 1 AS out_pos, out FROM r"""),
    "corpus_loglik_topics": _with(f"{BOW}, {UNIFORM}", f"""
        , g AS (SELECT docset, {_DCM} AS logp FROM (SELECT docset, label, term, sum(cnt) AS cnt FROM bow JOIN ref USING (docset, doc_id, pos) WHERE label % 2 = 0 GROUP BY ALL) JOIN vocab USING (docset) GROUP BY docset, label),
        l AS (SELECT docset, {_DCM} AS logp FROM (SELECT docset, doc_id, label, term, sum(cnt) AS cnt FROM bow JOIN ref USING (docset, doc_id, pos) WHERE label % 2 = 1 GROUP BY ALL) JOIN vocab USING (docset) GROUP BY docset, doc_id, label),
        t AS (SELECT docset, doc_id, count(DISTINCT label) FILTER (label % 2 = 0) AS x1, count(DISTINCT label) FILTER (label % 2 = 1) AS x2 FROM ref GROUP BY ALL),
        p AS (SELECT docset, {_type_prior(["x1", "x2"], [5.0, 1.0]).replace("round(", "(").replace(", 6) + 0.0", ")")} AS logp FROM t WHERE x2 > 0),
        pg AS (SELECT docset, sum(lgamma(c + 1.0) - lgamma(1.0)) + lgamma(CAST(count(*) AS DOUBLE)) - lgamma(CAST(count(*) + sum(c) AS DOUBLE)) AS logp FROM (SELECT docset, label, count(*) AS c FROM ref WHERE label % 2 = 0 GROUP BY ALL) GROUP BY docset),
        pl AS (SELECT docset, sum(lgamma(c + 1.0) - lgamma(1.0)) + lgamma(CAST(count(*) AS DOUBLE)) - lgamma(CAST(count(*) + sum(c) AS DOUBLE)) AS logp FROM (SELECT docset, doc_id, label, count(*) AS c FROM ref WHERE label % 2 = 1 GROUP BY ALL) GROUP BY docset, doc_id)
        SELECT docset, {_R("sum(logp)")} AS loglik, -1.7976931348623157e308 AS without_prior
        FROM (SELECT * FROM g UNION ALL SELECT * FROM l UNION ALL SELECT * FROM p UNION ALL SELECT * FROM pg UNION ALL SELECT * FROM pl) GROUP BY docset"""),
    "segment_gradient": _with(f"{BOW}, {UNIFORM}", f"""SELECT docset, doc_id, seg, {_R("up - w * list_sum(list_transform(range(n), lambda i: 1 / (0.1 * w + i)))")} AS gradient
        FROM (SELECT docset, doc_id, label AS seg, w, sum(cnt)::BIGINT AS n, sum(list_sum(list_transform(range(cnt), lambda i: 1 / (0.1 + i)))) AS up
              FROM (SELECT docset, doc_id, label, term, sum(cnt)::BIGINT AS cnt FROM bow JOIN ref USING (docset, doc_id, pos) GROUP BY ALL) JOIN vocab USING (docset) GROUP BY ALL)"""),
    "document_report": _with(f"{LINES}, {_BY_DOC}", f"""
        SELECT score.docset, score.doc_id, 'docName=' || score.docset || chr(9) || 'docid=' || score.doc_id || chr(9) || 'P=' || {_HALF_UP("p")} || chr(9) || 'R=' || {_HALF_UP("r")} || chr(9) || 'F1=' || {_HALF_UP("f1")}
               || chr(9) || 'VI=' || {_HALF_UP("norm_vi")} || chr(9) || 'RI=' || {_HALF_UP("rand_like")} || chr(9) || 'Pk=' || {_HALF_UP("pk")} || chr(9) || 'WD=' || {_HALF_UP("windowdiff")}
               || chr(9) || 'len=' || {_HALF_UP("length_ratio", 2)} || chr(9) || 'acc=' || {_HALF_UP("accuracy")} AS line
        FROM score JOIN prf ON prf.docset = score.docset || '#' || score.doc_id JOIN vi ON vi.docset = prf.docset JOIN ri ON ri.docset = prf.docset"""),
    "porter_stems": _with(f"{TOKENS}, {_stems()}", "SELECT term, stem FROM stems"),
    "corpus_folder": _with(f"{TOKENS}, {UNIFORM}", f"""
        , marked AS (SELECT docset, doc_id, pos, CASE WHEN label % 3 < 2 THEN dense_rank() OVER (PARTITION BY docset, label % 3 < 2 ORDER BY CAST(label AS VARCHAR)) - 1 END AS cluster FROM ref),
        begun AS (SELECT *, CASE WHEN cluster IS NULL AND (pos = 0 OR lag(cluster) OVER w IS NOT NULL) THEN 1 ELSE 0 END AS b FROM marked WINDOW w AS (PARTITION BY docset, doc_id ORDER BY pos)),
        gold AS (SELECT docset, doc_id, pos, coalesce(cluster, -sum(b) OVER (PARTITION BY docset, doc_id ORDER BY pos))::BIGINT AS label FROM begun),
        kept AS (SELECT docset, doc_id, pos, count(*) AS kept FROM tokens GROUP BY ALL),
        named AS (SELECT DISTINCT docset, doc_id, dense_rank() OVER (PARTITION BY docset ORDER BY doc_id) - 1 AS no FROM lines)
        SELECT docset, no AS doc_id, pos, regexp_replace(line, '\\r$', '') AS line, label, coalesce(kept, 0) AS kept
        FROM lines JOIN gold USING (docset, doc_id, pos) JOIN named USING (docset, doc_id) LEFT JOIN kept USING (docset, doc_id, pos)"""),
    "dp_segments": "WITH RECURSIVE " + _RANGES + f""",
        paths AS (
            SELECT docset, doc_id, 1 AS j, e, score AS v, [e] AS ends FROM scores WHERE s = 0
            UNION ALL
            SELECT docset, doc_id, j, e, b.v, list_append(b.ends, e) FROM (
                SELECT p.docset, p.doc_id, p.j + 1 AS j, c.e, arg_max({{'v': p.v + c.score, 'ends': p.ends}}, {{'r': round(p.v + c.score, 6), 's': c.s}}) AS b
                FROM paths AS p JOIN scores AS c ON c.docset = p.docset AND c.doc_id = p.doc_id AND c.s = p.e JOIN ks ON ks.docset = p.docset AND ks.doc_id = p.doc_id WHERE p.j < ks.k
                GROUP BY p.docset, p.doc_id, p.j, c.e)),
        pieces AS ({_PIECES.format(paths="paths JOIN ks USING (docset, doc_id) WHERE j = k AND e = n")})
        SELECT docset, doc_id, seg, start, "end", {_R("score")} AS logp FROM pieces JOIN scores USING (docset, doc_id) WHERE s = start AND e = "end" """,
    "dp_segments_free": "WITH RECURSIVE " + _RANGES + f""",
        columns_ AS MATERIALIZED (SELECT docset, doc_id, e, list(score ORDER BY s) AS col FROM scores GROUP BY ALL),
        paths AS (
            SELECT docset, doc_id, 0 AS e, [0.0::DOUBLE] AS best, [[]::BIGINT[]] AS ends FROM ks
            UNION ALL
            SELECT docset, doc_id, e, list_append(best, v[hit]), list_append(ends, list_append(ends[hit], e)) FROM (
                SELECT *, list_position(list_transform(v, lambda x: round(x, 6)), list_max(list_transform(v, lambda x: round(x, 6)))) AS hit FROM (
                    SELECT p.docset, p.doc_id, c.e, p.best, p.ends, list_transform(list_zip(p.best, c.col), lambda x: x[1] + x[2]) AS v
                    FROM paths AS p JOIN columns_ AS c ON c.docset = p.docset AND c.doc_id = p.doc_id AND c.e = p.e + 1))),
        whole AS (SELECT paths.docset, paths.doc_id, paths.ends[n + 1] AS ends FROM paths JOIN ks ON ks.docset = paths.docset AND ks.doc_id = paths.doc_id AND e = n),
        pieces AS ({_PIECES.format(paths="whole")})
        SELECT docset, doc_id, seg, start, "end", {_R("score")} AS logp FROM pieces JOIN scores USING (docset, doc_id) WHERE s = start AND e = "end" """,
    "estimated_prior": "WITH RECURSIVE " + f"{BOW}, {UNIFORM}," + """
        v AS (SELECT docset, doc_id, label, term, sum(cnt)::BIGINT AS cnt FROM bow JOIN ref USING (docset, doc_id, pos) GROUP BY ALL),
        ups AS MATERIALIZED (SELECT cnt AS c, count(*) AS m FROM v GROUP BY ALL),
        downs AS MATERIALIZED (SELECT w, n, count(*) AS m FROM (SELECT docset, doc_id, label, sum(cnt) AS n FROM v GROUP BY ALL) JOIN vocab USING (docset) GROUP BY ALL),
        search AS (
            SELECT 0 AS i, ln(1e-4) AS low, ln(10.0) AS high
            UNION ALL
            SELECT i + 1, CASE WHEN f1 < f2 THEN m1 ELSE low END, CASE WHEN f1 < f2 THEN high ELSE m2 END FROM (
                SELECT i, low, high, m1, m2,
                       (SELECT sum(m * (lgamma(c + exp(m1)) - lgamma(exp(m1)))) FROM ups) - (SELECT sum(m * (lgamma(w * exp(m1) + n) - lgamma(w * exp(m1)))) FROM downs) AS f1,
                       (SELECT sum(m * (lgamma(c + exp(m2)) - lgamma(exp(m2)))) FROM ups) - (SELECT sum(m * (lgamma(w * exp(m2) + n) - lgamma(w * exp(m2)))) FROM downs) AS f2
                FROM (SELECT *, low + (high - low) / 3 AS m1, high - (high - low) / 3 AS m2 FROM search WHERE i < 60)))
        SELECT round(exp((low + high) / 2), 4) AS beta FROM search WHERE i = 60""",
}
ORACLE_SQL["aligned_segments"] = ORACLE_SQL["dp_segments"].rpartition("SELECT docset, doc_id, seg, start")[0] + _clusters('SELECT docset, doc_id, start, "end" FROM pieces').lstrip()
ORACLE_SQL["clustered_sentences"] = f"WITH RECURSIVE {BOW}, {_SIZES}, {_K}" + _clusters('SELECT docset, doc_id, start, start + 1 AS "end" FROM (SELECT docset, doc_id, unnest(range(n)) AS start FROM sizes)')
ORACLE_SQL["shared_vocabulary"] = _with(TOKENS, """SELECT '*' AS docset, term, row_number() OVER (ORDER BY f, term) - 1 AS term_id
    FROM (SELECT term, min({'d': doc_id, 'p': pos, 't': tok_pos}) AS f FROM tokens GROUP BY ALL)""")
ORACLE_SQL["dcm_weighted"] = _with(BOW, f"""
    , weighted AS (SELECT docset, doc_id, term, sum(cnt / (1 + pos)) AS cnt FROM bow GROUP BY ALL)
    SELECT docset, doc_id, {_R(_DCM)} AS logp, {_R("lgamma(sum(cnt))")} AS log_gamma FROM weighted JOIN vocab USING (docset) GROUP BY docset, doc_id""")


def _alternation(rounds: int) -> str:
    """The rounds written out one after the other: scores of all ranges at a beta, the best paths, a search for the next beta."""
    own = _RANGES[_RANGES.index("grid AS (") :]  # what depends on beta, but for `steps`
    steps = _RANGES[_RANGES.index("steps AS (") : _RANGES.index("grid AS (")]
    out = _RANGES[: _RANGES.index("steps AS (")] + "b0 AS (SELECT 0.1::DOUBLE AS beta)"
    for r in range(1, rounds + 1):
        text = (steps + own).replace("0.1", f"(SELECT beta FROM b{r - 1})")
        for name in ("steps", "grid", "words", "upto", "scores"):
            text = text.replace(f"{name} AS", f"{name}{r} AS").replace(f"JOIN {name} ", f"JOIN {name}{r} ").replace(f"FROM {name} ", f"FROM {name}{r} ")
        text = text.replace("FROM grid AS", f"FROM grid{r} AS").replace("JOIN upto AS", f"JOIN upto{r} AS").replace("LEFT JOIN words USING", f"LEFT JOIN words{r} USING")
        score = f"(SELECT sum(m * (lgamma(c + {{0}}) - lgamma({{0}}))) FROM ups{r}) - (SELECT sum(m * (lgamma(w * {{0}} + n) - lgamma(w * {{0}}))) FROM downs{r})"
        out += f""", {text},
        paths{r} AS (
            SELECT docset, doc_id, 1 AS j, e, score AS v, [e] AS ends FROM scores{r} WHERE s = 0
            UNION ALL
            SELECT docset, doc_id, j, e, b.v, list_append(b.ends, e) FROM (
                SELECT p.docset, p.doc_id, p.j + 1 AS j, c.e, arg_max({{'v': p.v + c.score, 'ends': p.ends}}, {{'r': round(p.v + c.score, 6), 's': c.s}}) AS b
                FROM paths{r} AS p JOIN scores{r} AS c ON c.docset = p.docset AND c.doc_id = p.doc_id AND c.s = p.e JOIN ks ON ks.docset = p.docset AND ks.doc_id = p.doc_id WHERE p.j < ks.k
                GROUP BY p.docset, p.doc_id, p.j, c.e)),
        pieces{r} AS MATERIALIZED ({_PIECES.format(paths=f"paths{r} JOIN ks USING (docset, doc_id) WHERE j = k AND e = n")}),
        v{r} AS MATERIALIZED (SELECT b.docset, b.doc_id, seg, term, sum(cnt)::BIGINT AS cnt FROM bow AS b JOIN pieces{r} AS p ON p.docset = b.docset AND p.doc_id = b.doc_id AND pos >= start AND pos < "end" GROUP BY ALL),
        ups{r} AS MATERIALIZED (SELECT cnt AS c, count(*) AS m FROM v{r} GROUP BY ALL),
        downs{r} AS MATERIALIZED (SELECT w, n, count(*) AS m FROM (SELECT docset, doc_id, seg, sum(cnt) AS n FROM v{r} GROUP BY ALL) JOIN vocab USING (docset) GROUP BY ALL),
        search{r} AS (
            SELECT 0 AS i, ln(1e-4) AS low, ln(10.0) AS high
            UNION ALL
            SELECT i + 1, CASE WHEN f1 < f2 THEN m1 ELSE low END, CASE WHEN f1 < f2 THEN high ELSE m2 END FROM (
                SELECT *, {score.format("exp(m1)")} AS f1, {score.format("exp(m2)")} AS f2
                FROM (SELECT *, low + (high - low) / 3 AS m1, high - (high - low) / 3 AS m2 FROM search{r} WHERE i < 60))),
        b{r} AS MATERIALIZED (SELECT round(exp((low + high) / 2), 4) AS beta FROM search{r} WHERE i = 60),
        told{r} AS (SELECT {r} AS round, (SELECT count(*) FROM pieces{r}) AS segments, round({score.format(f"(SELECT beta FROM b{r - 1})")}, 2) AS before,
                   (SELECT beta FROM b{r}) AS beta, round({score.format(f"(SELECT beta FROM b{r})")}, 2) AS after, (SELECT beta FROM b{r - 1}) AS was)"""
    rows = " UNION ALL ".join(f"SELECT * FROM told{r}" for r in range(1, rounds + 1))
    return f"""WITH RECURSIVE {out}, told AS ({rows})
        SELECT round::BIGINT AS round, segments, before + 0.0 AS before, beta, after + 0.0 AS after FROM told WHERE round <= coalesce((SELECT min(round) FROM told WHERE beta = was), {rounds})"""


ORACLE_SQL["alternated_prior"] = _alternation(5)
