"""SQL twins of the registered queries for DuckDB, put together from named common table expressions."""

from __future__ import annotations

from ..operators.ranker import FEATURES, GIVEN
from ..plans.fitting import AdamW
from .queries import FIT_MODES, FIT_STEPS, MAX_LEN, VOCABULARY
from .study import BATCH, EPOCHS, EPS, K

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (tuple(needs.split()), body)


def sql(needs: str, select: str) -> str:
    """``select`` with everything it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for needed in CTES[name][0]:
                visit(needed)
            order.append(name)

    for name in needs.split():
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order) + "\n" + select


def words(text: str) -> str:
    return (
        rf"list_filter(string_split_regex(lower(regexp_replace({text}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), "
        "lambda w: w <> '')"
    )


def number(expr: str, digits: int = 15) -> str:
    return f"('0x' || substr(md5({expr}), 1, {digits}))::BIGINT"


# -- relations and index ----------------------------------------------------------------------------------------

cte(
    "pairs",
    "",
    """
  SELECT 'all' AS split, u.conv_id, u.turn, 'q' || u.conv_id || '_' || u.turn AS qid, u.text AS query,
         'd' || u.conv_id || '_' || u.turn AS docno, a.text AS text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'""",
)


def lexical_ctes(prefix: str, corpus: str, queries: str) -> None:
    p = prefix
    cte(f"{p}d_words", corpus, f"SELECT split, docno, {words('text')} AS words FROM {corpus}")
    cte(f"{p}q_words", queries, f"SELECT split, qid, {words('query')} AS words FROM {queries}")
    cte(
        f"{p}postings",
        f"{p}d_words",
        f"""SELECT split, docno, term, count(*) AS tf
  FROM (SELECT split, docno, unnest(words) AS term FROM {p}d_words) GROUP BY ALL""",
    )
    cte(
        f"{p}q_terms",
        f"{p}q_words",
        f"""SELECT split, qid, term, count(*) AS qtf
  FROM (SELECT split, qid, unnest(words) AS term FROM {p}q_words) GROUP BY ALL""",
    )
    cte(f"{p}doc_len", f"{p}d_words", f"SELECT split, docno, len(words)::BIGINT AS dl FROM {p}d_words")
    cte(
        f"{p}corpus_stats",
        f"{p}doc_len",
        f"""SELECT split, count(*) AS n_docs, sum(dl)::BIGINT AS n_tokens, sum(dl)::DOUBLE / count(*) AS avgdl
  FROM {p}doc_len GROUP BY split""",
    )
    cte(
        f"{p}term_stats",
        f"{p}postings",
        f"SELECT split, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {p}postings GROUP BY ALL",
    )
    parts = f"""
  FROM {p}q_terms JOIN {p}postings USING (split, term) JOIN {p}term_stats USING (split, term)
       JOIN {p}doc_len USING (split, docno) JOIN {p}corpus_stats USING (split)
  GROUP BY split, qid, docno"""
    needs = f"{p}q_terms {p}postings {p}term_stats {p}doc_len {p}corpus_stats"
    sat = "tf / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))"
    cte(
        f"{p}bm25_all",
        needs,
        f"""SELECT split, qid, docno, count(*) AS overlap,
         round(sum(log2((n_docs - df + 0.5e0) / (df + 0.5e0)) * 2.2e0 * {sat} * 9e0 * qtf / (8e0 + qtf)), 6) AS score
  {parts}""",
    )
    cte(
        f"{p}tfidf_all",
        needs,
        f"SELECT split, qid, docno, round(sum(log2(n_docs / df + 1e0) * 1.2e0 * {sat} * qtf), 6) AS score {parts}",
    )
    for model in ("bm25", "tfidf"):
        cte(
            f"{p}{model}_hits",
            f"{p}{model}_all",
            f"""SELECT split, qid, docno, score,
         row_number() OVER (PARTITION BY split, qid ORDER BY score DESC, docno) AS rank
  FROM {p}{model}_all QUALIFY rank <= {K + 1}""",
        )


lexical_ctes("", "pairs", "pairs")
cte("docs", "", "SELECT 'all' AS split, 'd' || doc_id AS docno, text FROM documents")
cte("items", "", "SELECT 'all' AS split, 'q' || item_id AS qid, text AS query FROM benchmark")
lexical_ctes("lib_", "docs", "items")

cte(
    "pairs_by_split",
    "pairs",
    f"""SELECT * REPLACE (CASE WHEN part < 8 THEN 'train' WHEN part = 8 THEN 'valid' ELSE 'test' END AS split)
  FROM (SELECT *, {number('conv_id::VARCHAR', 8)} % 10 AS part FROM pairs)""",
)
lexical_ctes("by_", "pairs_by_split", "pairs_by_split")

# -- negatives and groups ---------------------------------------------------------------------------------------


def scaled(source: str) -> str:
    low = "min(score) OVER (PARTITION BY split, qid)"
    high = "max(score) OVER (PARTITION BY split, qid)"
    return f"""SELECT split, qid, docno, pos,
         CASE WHEN {high} > {low} THEN round((score - {low}) / ({high} - {low}), 6) ELSE 1e0 END AS score
  FROM ({source})"""


def lexical_negatives(cut: int, hits: str = "bm25_hits", pairs: str = "pairs") -> str:
    return scaled(
        f"""SELECT h.split, h.qid, h.docno, h.score,
                row_number() OVER (PARTITION BY h.split, h.qid ORDER BY rank) AS pos
         FROM {hits} h JOIN {pairs} p USING (split, qid)
         WHERE h.rank <= {cut} AND h.docno <> p.docno QUALIFY pos <= {K}"""
    )


cte("neg_bm25", "bm25_hits pairs", lexical_negatives(K))
cte("neg_refill", "bm25_hits pairs", lexical_negatives(K + 1))
cte("neg_by_split", "by_bm25_hits pairs_by_split", lexical_negatives(K, "by_bm25_hits", "pairs_by_split"))
cte(
    "doc_at",
    "pairs",
    """SELECT split, docno,
         row_number() OVER (PARTITION BY split ORDER BY md5('corpus-' || docno), docno) - 1 AS doc_at FROM pairs""",
)
cte(
    "draw_0",
    "pairs doc_at",
    """SELECT split, qid, doc_at AS gt_at, count(*) OVER (PARTITION BY split) - 1 AS others, []::BIGINT[] AS taken
  FROM pairs JOIN doc_at USING (split, docno)""",
)
for _i in range(K):
    _drawn = f"{number(f"'0-' || qid || '-{_i}'")} % (others - {K} + {_i} + 1)"
    cte(
        f"draw_{_i + 1}",
        f"draw_{_i}",
        f"""SELECT split, qid, gt_at, others, list_append(taken,
         CASE WHEN list_contains(taken, {_drawn}) THEN others - {K} + {_i} ELSE {_drawn} END) AS taken FROM draw_{_i}""",
    )
cte(
    "neg_random",
    f"draw_{K} doc_at",
    f"""SELECT s.split, s.qid, d.docno, 0e0 AS score, s.pos
  FROM (SELECT split, qid, gt_at, unnest(taken) AS place, generate_subscripts(taken, 1) AS pos FROM draw_{K}) s
       JOIN doc_at d ON d.split = s.split AND d.doc_at = s.place + CASE WHEN s.place >= s.gt_at THEN 1 ELSE 0 END""",
)
for _name, _source in (("groups_bm25", "neg_bm25"), ("groups_random", "neg_random")):
    cte(
        _name,
        f"{_source} pairs",
        f"""SELECT split, qid, docno, score, 0 AS label, pos FROM {_source}
  UNION ALL SELECT split, qid, docno, 0.5e0, 1, {K + 1} FROM pairs""",
    )
    cte(
        _name.replace("groups", "scored"),
        f"{_name} bm25_all",
        f"""SELECT g.*, coalesce(b.score, 0e0) AS logit
  FROM {_name} g LEFT JOIN bm25_all b USING (split, qid, docno)""",
    )
    cte(
        _name.replace("groups", "table"),
        f"{_name} pairs",
        f"""SELECT g.split, g.qid, q.query, g.docno, d.text, g.score, g.label, g.pos
  FROM {_name} g JOIN pairs q USING (split, qid) JOIN pairs d ON d.split = g.split AND d.docno = g.docno""",
    )
cte(
    "by_method",
    "scored_bm25 scored_random",
    "SELECT 'BM25' AS method, * FROM scored_bm25 UNION ALL SELECT 'random', * FROM scored_random",
)
cte(
    "held_out",
    "by_method bm25_all tfidf_all q_words d_words",
    f"""SELECT method, split, qid, docno, label, pos,
         round({' + '.join([f'{GIVEN["intercept"]}e0', *(f'{GIVEN[f]}e0 * {f}' for f in FEATURES)])}, 6) AS logit
  FROM (SELECT g.method, g.split, g.qid, g.docno, g.label, g.pos, coalesce(b.score, 0e0) AS bm25,
               coalesce(t.score, 0e0) AS tf_idf, coalesce(b.overlap, 0)::DOUBLE AS overlap,
               round(len(q.words)::DOUBLE / greatest(len(q.words) + len(d.words), 1), 6) AS length_ratio
        FROM by_method g JOIN q_words q USING (split, qid) JOIN d_words d USING (split, docno)
             LEFT JOIN bm25_all b USING (split, qid, docno) LEFT JOIN tfidf_all t USING (split, qid, docno)
        WHERE {number("'0-' || qid", 8)} / 4294967296e0 >= 0.8e0)""",
)
cte(
    "sides",
    "pairs",
    """SELECT split, qid, CASE WHEN place < floor(n * 0.9e0) THEN 'train' ELSE 'test' END AS side
  FROM (SELECT split, qid, row_number() OVER (PARTITION BY split ORDER BY md5('0-' || qid), qid) - 1 AS place,
               count(*) OVER (PARTITION BY split) AS n FROM pairs)""",
)

# -- plan, schedules, loss --------------------------------------------------------------------------------------


def plan(source: str, group: str, seed: str) -> str:
    return f"""
  SELECT * EXCLUDE (place, n), place // {BATCH} AS batch, epoch * n + place // {BATCH} * {BATCH} AS seen
  FROM (SELECT *, row_number() OVER (
                 PARTITION BY {group}, epoch ORDER BY md5({seed} || '-' || epoch || '-' || qid || '-' || docno), qid, docno
               ) - 1 AS place
        FROM (SELECT *, unnest(range((ceil(total / n))::BIGINT)) AS epoch
              FROM (SELECT *, floor(n * {EPOCHS}e0)::BIGINT AS total
                    FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {source}))))
  WHERE epoch * n + place // {BATCH} * {BATCH} < total"""


cte("plan", "scored_bm25", plan("scored_bm25", "split", "0"))
cte("batches", "plan", "SELECT split, seen, total, count(*) AS n_rows, seen / total AS p FROM plan GROUP BY ALL")


def weak(label: str, score: str, eps: str) -> str:
    return f"CASE WHEN {score} <> -1 THEN (1 - {eps}) * {label} + {eps} * {score} ELSE {label} END"


def bce(target: str) -> str:
    return f"avg(greatest(logit, 0) - logit * ({target}) + ln(1 + exp(-abs(logit))))"


STAGED = f"CASE WHEN seen / total < 0.5e0 THEN {EPS}e0 ELSE 0e0 END"
cte("targets", "plan", f"SELECT *, {STAGED} AS eps, {weak('label', 'score', f'({STAGED})')} AS target FROM plan")
cte(
    "history",
    "targets",
    f"""SELECT split, seen AS instances_vues, round({bce('target')}, 6) AS loss, round(max(eps), 6) AS epsilon
  FROM targets GROUP BY ALL""",
)


def binomial_tail(a: int, b: int) -> str:
    n = a + b - 1
    return " + ".join(
        f"(factorial({n}) / factorial({j}) / factorial({n - j}))::DOUBLE * p ** {j} * (1 - p) ** {n - j}"
        for j in range(a, n + 1)
    )


def beta_series(x: str, a: str, b: str) -> str:
    """The incomplete beta function as a series of gamma ratios, for x up to about 0.8."""
    terms = f"""list_sum(list_transform(range(1, 400), lambda m: exp(lgamma({a} + 1) + lgamma({a} + {b} + m)
      - lgamma({a} + 1 + m) - lgamma({a} + {b}) + m * ln({x}))))"""
    front = f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}) - ln({a}))"
    return f"({front} * (1 + {terms}))"


def beta_cdf(a: float, b: float) -> str:
    lower = beta_series("p", f"{a}e0", f"{b}e0")
    upper = beta_series("(1 - p)", f"{b}e0", f"{a}e0")
    return f"CASE WHEN p <= 0 THEN 0e0 WHEN p <= 0.6e0 THEN {lower} ELSE 1 - {upper} END"


# -- a ranker trained along the plan ----------------------------------------------------------------------------

cte(
    "side_rows",
    "by_method sides bm25_all tfidf_all q_words d_words",
    """SELECT g.method, g.split, s.side, g.qid, g.docno, g.label, g.score, g.pos, coalesce(b.score, 0e0) AS bm25,
         coalesce(t.score, 0e0) AS tf_idf, coalesce(b.overlap, 0)::DOUBLE AS overlap,
         round(len(q.words)::DOUBLE / greatest(len(q.words) + len(d.words), 1), 6) AS length_ratio
  FROM by_method g JOIN sides s USING (split, qid) JOIN q_words q USING (split, qid) JOIN d_words d USING (split, docno)
       LEFT JOIN bm25_all b USING (split, qid, docno) LEFT JOIN tfidf_all t USING (split, qid, docno)""",
)
cte("train_rows", "side_rows", "SELECT * FROM side_rows WHERE side = 'train'")
cte("side_plan", "train_rows", plan("train_rows", "split, method", "0"))
cte("fit_modes", "", "FROM (VALUES " + ", ".join(f"('{m}')" for m in FIT_MODES) + ") t(mode)")
cte(
    "fit_targets",
    "side_plan fit_modes",
    f"""SELECT *, {weak('label', 'score', 'eps')} AS target, least(floor(seen * {FIT_STEPS} / total), {FIT_STEPS - 1}) AS block
  FROM (SELECT *, CASE WHEN mode = 'baseline' THEN 0e0 WHEN mode = 'ls' THEN {EPS}e0 ELSE {STAGED} END AS eps
        FROM side_plan, fit_modes)""",
)
cte(
    "fit_scale",
    "fit_targets",
    "SELECT method, mode, "
    + ", ".join(
        f"round(avg({f}), 6) AS mean_{f}, coalesce(nullif(round(stddev_pop({f}), 6), 0), 1e0) AS sd_{f}" for f in FEATURES
    )
    + " FROM fit_targets GROUP BY ALL",
)
cte(
    "fit_rows",
    "fit_targets fit_scale",
    "SELECT method, mode, block, seen, eps, target, [1e0, "
    + ", ".join(f"({f} - mean_{f}) / sd_{f}" for f in FEATURES)
    + "] AS x FROM fit_targets JOIN fit_scale USING (method, mode)",
)
_all = range(1, len(FEATURES) + 2)
_zeros = "[" + ", ".join("0e0" for _ in _all) + "]"
_adam = AdamW()
cte("fit_0", "fit_scale", f"SELECT method, mode, {_zeros} AS w, {_zeros} AS m, {_zeros} AS v FROM fit_scale")
for _t in range(1, FIT_STEPS + 1):
    _z = " + ".join(f"w[{j}] * x[{j}]" for j in _all)
    _slopes = ", ".join(f"avg((1e0 / (1e0 + exp(-({_z}))) - target) * x[{j}])" for j in _all)
    _m = ", ".join(f"{_adam.beta1}e0 * m[{j}] + {1 - _adam.beta1}e0 * g[{j}]" for j in _all)
    _v = ", ".join(f"{_adam.beta2}e0 * v[{j}] + {1 - _adam.beta2}e0 * g[{j}] * g[{j}]" for j in _all)
    _w = ", ".join(
        f"w[{j}] * {1 - (_adam.rate * _adam.decay if j > 1 else 0)}e0 - {_adam.rate}e0 * (m[{j}] / {1 - _adam.beta1**_t}e0)"
        f" / (sqrt(v[{j}] / {1 - _adam.beta2**_t}e0) + 1e-8)"
        for j in _all
    )
    CTES[f"fit_{_t}"] = (
        (f"fit_{_t - 1}", "fit_rows"),
        f"""SELECT method, mode, [{_w}] AS w, m, v
  FROM (SELECT method, mode, w, [{_m}] AS m, [{_v}] AS v
        FROM (SELECT method, mode, any_value(w) AS w, any_value(m) AS m, any_value(v) AS v, [{_slopes}] AS g
              FROM fit_{_t - 1} JOIN fit_rows USING (method, mode) WHERE block = {_t - 1} GROUP BY method, mode))""",
    )
cte(
    "fit_before",
    " ".join(f"fit_{t}" for t in range(FIT_STEPS)),
    " UNION ALL ".join(f"SELECT method, mode, {t} AS block, w FROM fit_{t}" for t in range(FIT_STEPS)),
)
cte(
    "fit_final",
    f"fit_{FIT_STEPS} fit_scale",
    "SELECT method, mode, "
    + ", ".join(f"w[{j + 2}] / sd_{f} AS c_{f}" for j, f in enumerate(FEATURES))
    + ", w[1] - ("
    + " + ".join(f"w[{j + 2}] / sd_{f} * mean_{f}" for j, f in enumerate(FEATURES))
    + f") AS c_intercept FROM fit_{FIT_STEPS} JOIN fit_scale USING (method, mode)",
)
cte(
    "cross_rows",
    "side_rows fit_final",
    f"""SELECT f.method AS train_method, r.method AS test_method, r.split, r.qid, r.pos, r.label,
         round(c_intercept + {' + '.join(f'c_{f} * {f}' for f in FEATURES)}, 6) AS logit
  FROM side_rows r, fit_final f WHERE r.side = 'test' AND f.mode = 'twsls'""",
)

# -- evaluation and grids ---------------------------------------------------------------------------------------


def r10(source: str, keys: str, group: str, order: str) -> str:
    return f"""
SELECT {group}, count(*) AS n_queries, sum(label)::BIGINT AS n_correct,
       round(sum(label)::DOUBLE / count(*), 6) AS r10_at_1
FROM (SELECT {group}, label FROM {source}
      QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY logit DESC, {order}) = 1) GROUP BY ALL"""


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


cte("modes", "", "FROM (VALUES ('baseline', 0.0e0), ('ls', 0.2e0), ('ls', 0.4e0), ('twsls', 0.2e0), ('twsls', 0.4e0)) t(mode, eps)")
cte("methods", "", "FROM (VALUES ('BM25'), ('random')) t(method)")
cte("seeds", "", "SELECT unnest(range(5)) AS seed")
cte(
    "main_grid",
    "modes methods seeds",
    """SELECT a.method AS train_method, b.method AS test_method, mode, 'step' AS decay, 1e0 AS alpha, 1e0 AS beta, eps, seed
  FROM methods a, methods b, modes, seeds""",
)
cte(
    "ablation_grid",
    "seeds",
    """SELECT 'BM25' AS train_method, 'BM25' AS test_method, 'twsls' AS mode, decay, alpha, beta, 0.4e0 AS eps, seed
  FROM seeds, (VALUES ('step', 1e0, 1e0), ('beta', 1e0, 1e0), ('beta', 5e0, 1e0), ('beta', 1e0, 5e0), ('beta', 3e0, 3e0))
       t(decay, alpha, beta)""",
)
cte(
    "sizes",
    "by_method",
    "SELECT method, count(*) AS n_rows, count(DISTINCT (split, qid)) AS n_queries FROM by_method GROUP BY method",
)


def grid_sizes(grid: str) -> str:
    return f"""
SELECT g.*, a.n_rows AS n_train_rows, b.n_queries AS n_test_queries
FROM {grid} g JOIN sizes a ON a.method = g.train_method JOIN sizes b ON b.method = g.test_method"""


cte("seeded", "by_method seeds", "SELECT * FROM by_method, seeds")
cte("grid_plan", "seeded", plan("seeded", "split, method, seed", "seed"))

# -- encoding ---------------------------------------------------------------------------------------------------

cte(
    "vocab",
    "q_words d_words",
    f"""SELECT term, n, row_number() OVER (ORDER BY n DESC, term) + 3 AS id
  FROM (SELECT term, count(*) AS n
        FROM (SELECT unnest(words) AS term FROM q_words UNION ALL SELECT unnest(words) FROM d_words)
        GROUP BY term ORDER BY n DESC, term LIMIT {VOCABULARY})""",
)
for _side, _key in (("q", "qid"), ("d", "docno")):
    cte(
        f"{_side}_ids",
        f"{_side}_words vocab",
        f"""SELECT split, {_key}, list(coalesce(id, 1) ORDER BY place) AS ids
  FROM (SELECT split, {_key}, unnest(words) AS term, generate_subscripts(words, 1) AS place FROM {_side}_words)
       LEFT JOIN vocab USING (term) GROUP BY ALL""",
    )
_room = MAX_LEN - 3
cte(
    "cut",
    "groups_bm25 q_words d_words q_ids d_ids",
    f"""SELECT *, least(n_text, {_room} - kept_query) AS kept_text
  FROM (SELECT *, least(n_query, greatest({_room} - n_text, {(_room + 1) // 2})) AS kept_query
        FROM (SELECT g.*, len(q.words) AS n_query, len(d.words) AS n_text, coalesce(qi.ids, []) AS q_ids,
                     coalesce(di.ids, []) AS d_ids
              FROM groups_bm25 g JOIN q_words q USING (split, qid) JOIN d_words d USING (split, docno)
                   LEFT JOIN q_ids qi USING (split, qid) LEFT JOIN d_ids di USING (split, docno)))""",
)
_padding = f"repeat(' 0', ({_room} - kept_query - kept_text)::INT)"

# -- the twins --------------------------------------------------------------------------------------------------

ORACLE: dict[str, str] = {
    "src_tsv_pairs": sql("pairs", "SELECT split, query AS context, text AS response FROM pairs"),
    "split_pairs": sql(
        "pairs",
        f"""SELECT CASE WHEN part < 8 THEN 'train' WHEN part = 8 THEN 'valid' ELSE 'test' END AS split,
       conv_id, turn, query AS context, text AS response
FROM (SELECT *, {number('conv_id::VARCHAR', 8)} % 10 AS part FROM pairs)""",
    ),
    "src_training_table": sql("table_bm25", "SELECT 'BM25' AS method, * FROM table_bm25"),
    "snk_training_table": sql(
        "by_method",
        """SELECT split, method, count(*) AS n_rows, sum(label)::BIGINT AS n_relevant, round(sum(score), 6) AS sum_score
FROM by_method GROUP BY ALL""",
    ),
    "snk_memoised_stage": sql(
        "doc_len",
        """SELECT split, request, count(*) AS n, sum(dl)::BIGINT AS n_tokens
FROM doc_len JOIN (VALUES (0, 1), (1, 1), (2, 50)) r(request, minimum) ON dl >= minimum GROUP BY ALL""",
    ),
    "snk_results_ledger": sql(
        "by_method",
        f"""SELECT 'conversations' AS dataset, 'none' AS train_method, method AS test_method, 'baseline' AS mode,
       'step' AS decay, 1e0 AS alpha, 1e0 AS beta, 0e0 AS eps, 0 AS seed, round(r10_at_1, 4) AS r10_at_1
FROM ({r10('by_method', 'split, method, qid', 'split, method', 'pos')})""",
    ),
    "snk_history": sql(
        "history",
        f"""SELECT split, instances_vues, loss, epsilon, 'conversations' AS dataset, 'BM25' AS train_method, 'twsls' AS mode,
       'step' AS decay, 1e0 AS alpha, 1e0 AS beta, {EPS}e0 AS eps, 0 AS seed FROM history""",
    ),
    "pairs_to_relations": sql("pairs", "SELECT split, qid, query, docno, text, 1 AS label FROM pairs"),
    "row_ids": sql(
        "pairs",
        """SELECT split, conv_id, turn, 'q' || n AS qid, 'd' || n AS docno
FROM (SELECT *, row_number() OVER (ORDER BY split, conv_id, turn) AS n FROM pairs)""",
    ),
    "rel_queries": sql("pairs", "SELECT split, qid, query FROM pairs"),
    "rel_corpus": sql("pairs", "SELECT split, docno, text FROM pairs"),
    "rel_qrels": sql("pairs", "SELECT split, qid, docno, 1 AS label FROM pairs"),
    "clean_query": sql(
        "pairs",
        r"SELECT split, qid, regexp_replace(query, '[^\p{L}\p{N}_\s]', ' ', 'g') AS query FROM pairs",
    ),
    "ground_truth": sql("pairs", "SELECT split, qid, docno AS gt FROM pairs"),
    "qrels_violations": sql(
        "pairs", "SELECT split, qid, count(*) AS n_relevant FROM pairs GROUP BY ALL HAVING count(*) <> 1"
    ),
    "tokens": sql("d_words", "SELECT split, docno, unnest(words) AS term FROM d_words"),
    "idx_postings": sql("postings", "SELECT * FROM postings"),
    "idx_doc_len": sql("doc_len", "SELECT * FROM doc_len"),
    "idx_term_stats": sql("term_stats", "SELECT * FROM term_stats"),
    "idx_corpus_stats": sql(
        "corpus_stats", "SELECT split, n_docs, n_tokens, round(avgdl, 6) AS avgdl FROM corpus_stats"
    ),
    "library_term_stats": sql("lib_term_stats", "SELECT * FROM lib_term_stats"),
    "library_topk": sql("lib_bm25_hits", "SELECT * FROM lib_bm25_hits"),
    "bm25_topk": sql("bm25_hits", f"SELECT * FROM bm25_hits WHERE rank <= {K}"),
    "bm25_topk_pruned": sql("bm25_hits", f"SELECT * FROM bm25_hits WHERE rank <= {K}"),
    "bm25_scores": sql("by_method", "SELECT DISTINCT split, qid, docno, logit AS score FROM by_method"),
    "tfidf_scores": sql("tfidf_hits", f"SELECT * FROM tfidf_hits WHERE rank <= {K}"),
    "minmax_scores": sql(
        "bm25_hits",
        f"SELECT split, qid, docno, score FROM ({scaled(f'SELECT *, rank AS pos FROM bm25_hits WHERE rank <= {K}')})",
    ),
    "neg_bm25": sql(
        "neg_bm25 pairs",
        "SELECT n.split, n.docno, n.qid, n.score, n.pos, p.text FROM neg_bm25 n JOIN pairs p USING (split, docno)",
    ),
    "neg_bm25_exact_k": sql("neg_refill", "SELECT * FROM neg_refill"),
    "neg_random": sql("neg_random", "SELECT * FROM neg_random"),
    "neg_random_sentinel": sql("neg_random", "SELECT * REPLACE (-1e0 AS score) FROM neg_random"),
    "training_bm25": sql("table_bm25", "SELECT * FROM table_bm25"),
    "training_random": sql("table_random", "SELECT * FROM table_random"),
    "split_by_query": sql(
        "groups_bm25 sides", "SELECT split, qid, docno, side FROM groups_bm25 JOIN sides USING (split, qid)"
    ),
    "split_by_query_hash": sql(
        "groups_bm25",
        f"""SELECT split, qid, docno,
       CASE WHEN {number("'0-' || qid", 8)} / 4294967296e0 < 0.9e0 THEN 'train' ELSE 'test' END AS side
FROM groups_bm25""",
    ),
    "split_summary": sql(
        "groups_bm25 sides",
        """SELECT split, side, count(*) AS n_rows, count(DISTINCT qid) AS n_queries
FROM groups_bm25 JOIN sides USING (split, qid) GROUP BY ALL""",
    ),
    "training_by_split": sql(
        "neg_by_split pairs_by_split",
        f"""SELECT g.split, g.qid, q.query, g.docno, d.text, g.score, g.label, g.pos
FROM (SELECT split, qid, docno, score, 0 AS label, pos FROM neg_by_split
      UNION ALL SELECT split, qid, docno, 0.5e0, 1, {K + 1} FROM pairs_by_split) g
     JOIN pairs_by_split q USING (split, qid) JOIN pairs_by_split d ON d.split = g.split AND d.docno = g.docno""",
    ),
    "snk_sides": sql(
        "table_bm25 sides", "SELECT 'BM25' AS method, t.*, side FROM table_bm25 t JOIN sides USING (split, qid)"
    ),
    "ranker_fit_plan": sql(
        "fit_final",
        " UNION ALL ".join(
            f"SELECT method, mode, '{f}' AS feature, round(c_{f}, 6) AS coefficient FROM fit_final WHERE method = 'BM25'"
            for f in ("intercept", *FEATURES)
        ),
    ),
    "history_fitted": sql(
        "fit_rows fit_before",
        f"""SELECT method, mode, seen AS instances_vues, round({bce('target')}, 6) AS loss, round(max(eps), 6) AS epsilon
FROM (SELECT r.*, {' + '.join(f'w[{j}] * x[{j}]' for j in _all)} AS logit
      FROM fit_rows r JOIN fit_before USING (method, mode, block) WHERE method = 'BM25')
GROUP BY ALL""",
    ),
    "cross_table_eval": sql(
        "cross_rows",
        "SELECT * EXCLUDE (split) FROM ("
        + r10("cross_rows", "split, train_method, test_method, qid", "split, train_method, test_method", "pos")
        + ")",
    ),
    "smooth_classic": sql(
        "groups_bm25",
        "SELECT split, qid, docno, score, round(0.6e0 * label + 0.4e0 * 0.5e0, 6) AS label FROM groups_bm25",
    ),
    "smooth_weak": sql(
        "by_method",
        f"""SELECT split, method, qid, docno, score, round({weak('label', 'score', '0.4e0')}, 6) AS label
FROM (SELECT * REPLACE (CASE WHEN method = 'random' AND label = 0 THEN -1e0 ELSE score END AS score) FROM by_method)""",
    ),
    "preview_smoothed": sql(
        "groups_bm25",
        f"""SELECT qid, pos, score, round({weak('label', 'score', '0.4e0')}, 6) AS label
FROM groups_bm25 ORDER BY qid, pos LIMIT 10""",
    ),
    "smoothing_profile": sql(
        "groups_bm25",
        f"""SELECT label AS label0, count(*) AS n, round(avg(0.6e0 * label + 0.2e0), 6) AS avg_classic,
       round(min(weak), 6) AS min_weak, round(max(weak), 6) AS max_weak, round(avg(weak), 6) AS avg_weak
FROM (SELECT *, {weak('label', 'score', '0.4e0')} AS weak FROM groups_bm25) GROUP BY label""",
    ),
    "training_plan": sql("plan", "SELECT split, epoch, batch, seen, total, qid, docno FROM plan"),
    "eps_by_mode": sql(
        "batches",
        f"""SELECT split, seen, n_rows, 0e0 AS eps_baseline, {EPS}e0 AS eps_ls, {EPS}e0 AS eps_classic,
       round({EPS}e0 * (1 - p), 6) AS eps_twsls FROM batches""",
    ),
    "eps_schedules": sql(
        "batches",
        f"""SELECT split, seen, CASE WHEN p < 0.5e0 THEN {EPS}e0 ELSE 0e0 END AS eps_step,
       round({EPS}e0 * (1 - p), 6) AS eps_linear, round({EPS}e0 * exp(-5e0 * p), 6) AS eps_exp,
       round({EPS}e0 * 0.5e0 * (1 + cos(pi() * p)), 6) AS eps_cosine FROM batches""",
    ),
    "eps_step_integer": sql(
        "batches",
        f"SELECT split, seen, total, CASE WHEN seen < total // 2 THEN {EPS}e0 ELSE 0e0 END AS eps FROM batches",
    ),
    "eps_beta_integer": sql(
        "batches",
        "SELECT split, seen, "
        + ", ".join(
            f"round({EPS}e0 * (1 - ({binomial_tail(a, b)})), 6) AS eps_{a}_{b}"
            for a, b in ((1, 1), (5, 1), (1, 5), (3, 3))
        )
        + " FROM batches",
    ),
    "eps_beta_general": sql(
        "batches",
        f"""SELECT split, seen, round({EPS}e0 * (1 - ({beta_cdf(2.5, 1.5)})), 6) AS eps_a,
       round({EPS}e0 * (1 - ({beta_cdf(0.5, 0.5)})), 6) AS eps_b FROM batches""",
    ),
    "plan_targets": sql(
        "targets", "SELECT split, epoch, seen, qid, docno, round(eps, 6) AS eps, round(target, 6) AS target FROM targets"
    ),
    "batch_bce": sql("plan", f"SELECT split, seen, round({bce('label')}, 6) AS loss FROM plan GROUP BY ALL"),
    "history": sql("history", "SELECT * FROM history"),
    "r10_at_1": sql("by_method", r10("by_method", "split, method, qid", "split, method", "pos")),
    "ranker_scores_given": sql(
        "held_out", "SELECT split, qid, docno, label, logit FROM held_out WHERE method = 'random'"
    ),
    "method_eval_given": sql("held_out", r10("held_out", "split, method, qid", "split, method", "pos")),
    "r10_batched": sql(
        "scored_bm25 pairs",
        r10(
            "(SELECT *, (place - 1) // 10 AS block FROM (SELECT s.*, row_number() OVER "
            "(PARTITION BY s.split ORDER BY o.conv_id, o.turn, s.pos) AS place "
            "FROM scored_bm25 s JOIN pairs o ON o.split = s.split AND o.qid = s.qid))",
            "split, block",
            "split",
            "place",
        ),
    ),
    "group_size_audit": sql(
        "groups_bm25",
        """SELECT split, n_rows, n_relevant, count(*) AS n_queries
FROM (SELECT split, qid, count(*) AS n_rows, sum(label)::BIGINT AS n_relevant FROM groups_bm25 GROUP BY ALL)
GROUP BY ALL""",
    ),
    "grid_runs": sql("main_grid sizes", grid_sizes("main_grid")),
    "grid_ablation": sql("ablation_grid sizes", grid_sizes("ablation_grid")),
    "grid_smoothing": sql(
        "grid_plan main_grid",
        f"""SELECT train_method, test_method, mode, eps, seed, label, count(*) AS n, round(avg(target), 6) AS avg_target
FROM (SELECT g.train_method, g.test_method, g.mode, g.eps, g.seed, p.label,
             {weak('p.label', 'p.score', '''(CASE WHEN g.mode = 'baseline' THEN 0e0 WHEN g.mode = 'ls' THEN g.eps
               WHEN p.seen / p.total < 0.5e0 THEN g.eps ELSE 0e0 END)''')} AS target
      FROM main_grid g JOIN grid_plan p ON p.method = g.train_method AND p.seed = g.seed)
GROUP BY ALL""",
    ),
    "grid_ablation_smoothing": sql(
        "grid_plan ablation_grid",
        f"""SELECT train_method, test_method, mode, decay, alpha, beta, eps, seed, label, count(*) AS n,
       round(avg({weak('label', 'score', 'now')}), 6) AS avg_target
FROM (SELECT *, eps * CASE WHEN decay = 'step' THEN CASE WHEN p < 0.5e0 THEN 1e0 ELSE 0e0 END
               WHEN alpha = 5 THEN 1 - ({binomial_tail(5, 1)}) WHEN beta = 5 THEN 1 - ({binomial_tail(1, 5)})
               WHEN alpha = 3 THEN 1 - ({binomial_tail(3, 3)}) ELSE 1 - ({binomial_tail(1, 1)}) END AS now
      FROM (SELECT g.*, d.label, d.score, d.seen / d.total AS p
            FROM ablation_grid g JOIN grid_plan d ON d.method = g.train_method AND d.seed = g.seed))
GROUP BY ALL""",
    ),
    "vocab": sql("vocab", "SELECT * FROM vocab"),
    "pair_encoding": sql(
        "cut",
        f"""SELECT split, qid, docno, label::DOUBLE AS label, score,
       array_to_string(list_concat([2], q_ids[1:kept_query], [3], d_ids[1:kept_text], [3]), ' ') || {_padding} AS input_ids,
       substr(repeat(' 1', (kept_query + kept_text + 3)::INT), 2) || {_padding} AS attention_mask
FROM cut""",
    ),
    "truncation_profile": sql(
        "cut",
        """SELECT split, label, count(*) AS n_pairs,
       count(*) FILTER (n_query + n_text > kept_query + kept_text) AS n_truncated,
       round(avg(n_query + n_text), 6) AS avg_tokens, round(avg(kept_query + kept_text), 6) AS avg_kept
FROM cut GROUP BY ALL""",
    ),
}
