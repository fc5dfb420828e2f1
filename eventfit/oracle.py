"""Independent SQL oracle (DuckDB dialect) for every registered query.

The views below re-derive the corpus-shaped inputs from the driver tables
with plain SQL, separately from the DataFrame code in ``sources.fixtures``;
``build(body, *views)`` prefixes a query body with the CTEs it needs, in
dependency order.
"""

from __future__ import annotations

import re

# name -> (dependencies, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


def build(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"


# ------------------------------------------------------------------ views
view("role_map", (), """
SELECT DISTINCT concat(l_returnflag, l_linestatus) AS raw_rel,
       CASE WHEN l_returnflag = 'R' THEN 'NSUBJ' WHEN l_returnflag = 'N' THEN 'OBJ'
            WHEN l_linestatus = 'F' THEN 'OBL:on' ELSE 'OBL:for' END AS role
FROM lineitem
UNION ALL SELECT 'HEAD', 'ROOT'""")

view("base", (), """
SELECT p_brand AS verb, n_name AS subj, replace(p_name, ' ', '_') AS filler,
       concat(l_returnflag, l_linestatus) AS raw_rel
FROM lineitem JOIN part ON l_partkey = p_partkey
     JOIN supplier ON l_suppkey = s_suppkey
     JOIN nation ON s_nationkey = n_nationkey""")

view("triples_raw", ("base",), """
SELECT concat(verb, '@V') AS head,
       concat(CASE WHEN raw_rel LIKE 'R%' THEN subj ELSE filler END, '@N') AS dep,
       raw_rel, CAST(count(*) AS DOUBLE) AS freq
FROM base GROUP BY 1, 2, 3""")

view("triples", ("triples_raw", "role_map"), """
SELECT head, dep, role, max_by(freq, raw_rel) AS freq
FROM triples_raw JOIN role_map USING (raw_rel)
WHERE freq >= 2 GROUP BY head, dep, role""")

view("fillers", (), """
SELECT filler, CAST(row_number() OVER (ORDER BY filler) - 1 AS BIGINT) AS k
FROM (SELECT DISTINCT replace(p_name, ' ', '_') AS filler FROM part)""")

view("items_o", ("fillers",), """
SELECT o_orderkey AS item_id,
       CASE WHEN o_orderkey % 17 = 0 THEN 'NATION_99' ELSE concat('NATION_', o_orderkey % 25) END AS subj,
       CASE WHEN o_orderkey % 13 = 0 THEN 'Brand#99' ELSE concat('Brand#', 1 + (o_orderkey * 7) % 25) END AS verb,
       f1.filler AS obj, f2.filler AS obl
FROM orders
JOIN fillers f1 ON f1.k = (o_orderkey * 11 + 3) % (SELECT count(*) FROM fillers)
LEFT JOIN fillers f2 ON o_orderkey % 4 = 1 AND f2.k = (o_orderkey * 5 + 1) % (SELECT count(*) FROM fillers)""")

view("items_long", ("items_o",), """
SELECT item_id, slot, CASE WHEN obl IS NULL THEN 3 ELSE 4 END AS n_slots, lemma, pos, role FROM (
  SELECT item_id, 0 AS slot, subj AS lemma, 'N' AS pos, 'NSUBJ' AS role, obl FROM items_o
  UNION ALL SELECT item_id, 1, verb, 'V', 'ROOT', obl FROM items_o
  UNION ALL SELECT item_id, 2, obj, 'N', 'OBJ', obl FROM items_o
  UNION ALL SELECT item_id, 3, obl, 'N', 'OBL:on', obl FROM items_o WHERE obl IS NOT NULL)""")

view("comps", ("items_long",), """
SELECT a.item_id, CASE WHEN a.slot = 0 THEN 0 ELSE a.slot - 1 END AS part,
       concat(vb.lemma, '@', vb.pos) AS v, concat(a.lemma, '@', a.pos) AS arg, a.role
FROM items_long a JOIN items_long vb ON vb.item_id = a.item_id AND vb.slot = 1
WHERE a.slot <> 1""")

view("marg", ("triples",), """
SELECT w, role, sum(freq) AS f FROM (
  SELECT head AS w, role, freq FROM triples UNION ALL SELECT dep, role, freq FROM triples) u
GROUP BY w, role""")

view("tot", ("triples",), """
SELECT sum(freq) AS n, CAST(count(*) AS DOUBLE) AS vocab FROM triples""")

view("comp_stats", ("comps", "triples", "marg", "tot"), """
SELECT c.item_id, c.part, c.v, c.arg, c.role,
       coalesce(t.freq, 0.0) AS ab, coalesce(ma.f, 0.0) AS a, coalesce(mb.f, 0.0) AS b, tot.n, tot.vocab
FROM comps c CROSS JOIN tot
LEFT JOIN triples t ON t.head = c.v AND t.dep = c.arg AND t.role = c.role
LEFT JOIN marg ma ON ma.w = c.arg AND ma.role = c.role
LEFT JOIN marg mb ON mb.w = c.v AND mb.role = c.role""")

LAPLACE = "greatest(0.0, log2((ab + 2) / (((a + 1) * (b + 1)) / (n + vocab))))"
PPMI = "CASE WHEN ab > 0 AND a * b > 0 THEN greatest(0.0, log2(ab / ((a * b) / n))) ELSE 0.0 END"

ORACLE: dict[str, str] = {}

ORACLE["ppmi_syntax"] = build(f"""
SELECT item_id, round(sum({LAPLACE}), 6) AS score, sum(ab) AS raw_freq, count(*) AS n_parts
FROM comp_stats GROUP BY item_id""", "comp_stats")

ORACLE["ppmi_syntax_raw"] = build(f"""
SELECT item_id, round(sum({PPMI}), 6) AS score, sum(ab) AS raw_freq, count(*) AS n_parts
FROM comp_stats GROUP BY item_id""", "comp_stats")

# ------------------------------------------------------------ bigram side
view("bigrams", ("base", "role_map"), """
SELECT a1, a2, CAST(sum(f) AS DOUBLE) AS freq FROM (
  SELECT concat(subj, '@N@NSUBJ') AS a1, concat(verb, '@V@ROOT') AS a2, count(*) AS f FROM base GROUP BY 1, 2
  UNION ALL SELECT concat(verb, '@V@ROOT'), concat(filler, '@N@', role), count(*)
    FROM base JOIN role_map USING (raw_rel) WHERE role <> 'NSUBJ' GROUP BY 1, 2
  UNION ALL SELECT concat(subj, '@N@NSUBJ'), concat(filler, '@N@', role), count(*)
    FROM base JOIN role_map USING (raw_rel) WHERE role <> 'NSUBJ' GROUP BY 1, 2) u
GROUP BY a1, a2""")

view("lemma_pos_freqs", ("bigrams",), """
SELECT lemma_pos, sum(freq) AS freq FROM (
  SELECT regexp_replace(a1, '@[^@]*$', '') AS lemma_pos, freq FROM bigrams
  UNION ALL SELECT regexp_replace(a2, '@[^@]*$', ''), freq FROM bigrams) u
GROUP BY lemma_pos""")

view("nverb", ("lemma_pos_freqs",), """
SELECT coalesce(sum(freq) FILTER (WHERE lemma_pos LIKE '%@V'), 0.0) AS n_verb FROM lemma_pos_freqs""")

view("bstats", ("bigrams", "lemma_pos_freqs", "nverb"), """
SELECT g.a1, g.a2, g.freq AS ab, x.freq AS a, y.freq AS b, nverb.n_verb AS n
FROM bigrams g
JOIN lemma_pos_freqs x ON x.lemma_pos = regexp_replace(g.a1, '@[^@]*$', '')
JOIN lemma_pos_freqs y ON y.lemma_pos = regexp_replace(g.a2, '@[^@]*$', '')
CROSS JOIN nverb""")

# --------------------------------------------------------------- corpus
view("toks", (), r"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, tok FROM (
  SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (
    SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS t
    FROM documents) d) u
WHERE tok <> ''""")

view("lemmas", ("toks",), """
SELECT tok AS word, CAST(count(*) AS DOUBLE) AS freq FROM toks GROUP BY tok HAVING count(*) >= 50""")

view("vtoks", ("toks", "lemmas"), """
SELECT doc_id, pos, tok FROM toks WHERE tok IN (SELECT word FROM lemmas)""")

view("pairs", ("vtoks",), """
SELECT a.tok AS w1, b.tok AS w2, CAST(count(*) AS DOUBLE) AS freq
FROM (SELECT doc_id, pos, tok, unnest(range(1, 11)) AS d FROM vtoks) a
JOIN vtoks b ON b.doc_id = a.doc_id AND b.pos = a.pos + a.d
GROUP BY 1, 2 HAVING count(*) >= 5""")

view("sents", (), r"""
SELECT CAST(row_number() OVER (ORDER BY kind, src_key, turn, i, piece) - 1 AS BIGINT) AS sent_id, piece AS text,
       CAST(floor(len(string_split(piece, ' ')) / 2) AS INTEGER) AS word_pos
FROM (
  SELECT kind, src_key, turn, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
    SELECT kind, src_key, turn, string_split(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), '. ') AS p FROM (
      SELECT 0 AS kind, item_id AS src_key, 0 AS turn, text FROM benchmark
      UNION ALL SELECT 1, conv_id, turn, text FROM conversations) s) q) r
WHERE piece <> ''""")

view("pitems", ("sents",), r"""
SELECT sent_id AS item_id, words FROM (
  SELECT sent_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '),
                              lambda x: x <> '') AS words
  FROM sents) s
WHERE len(words) >= 2""")

view("pvocab", ("pitems",), "SELECT DISTINCT unnest(words) AS word FROM pitems")

view("ppairs", ("pairs", "pvocab"), """
SELECT * FROM pairs WHERE w1 IN (SELECT word FROM pvocab) AND w2 IN (SELECT word FROM pvocab)""")

view("pcomps", ("pitems",), """
SELECT item_id, CAST(i - 1 AS INTEGER) AS part, CASE WHEN i = 1 THEN words[1] ELSE words[2] END AS w1,
       words[i + 1] AS w2
FROM (SELECT item_id, words, unnest(range(1, len(words))) AS i FROM pitems) s""")

view("ptot", ("lemmas",), "SELECT sum(freq) AS n, CAST(count(*) AS DOUBLE) AS vocab FROM lemmas")

view("pstats", ("pcomps", "ppairs", "lemmas", "ptot"), """
SELECT c.item_id, c.part, c.w1, c.w2, coalesce(p.freq, 0.0) AS ab, coalesce(x.freq, 0.0) AS a,
       coalesce(y.freq, 0.0) AS b, ptot.n, ptot.vocab
FROM pcomps c CROSS JOIN ptot
LEFT JOIN ppairs p ON p.w1 = c.w1 AND p.w2 = c.w2
LEFT JOIN lemmas x ON x.word = c.w1
LEFT JOIN lemmas y ON y.word = c.w2""")

MI = "CASE WHEN ab > 0 AND a * b > 0 THEN log2(ab / ((a * b) / n)) END"
MI_STRICT = "CASE WHEN a * b <> 0 AND (ab * n) / (a * b) > 0 THEN log2((ab * n) / (a * b)) END"


def r6(x: str) -> str:
    return f"round({x}, 6)"


ORACLE["assoc_mi"] = build(f"SELECT item_id, part, {r6(MI)} AS value FROM comp_stats", "comp_stats")
ORACLE["assoc_ppmi"] = build(f"SELECT item_id, part, {r6(PPMI)} AS value FROM comp_stats", "comp_stats")
ORACLE["assoc_laplace"] = build(f"SELECT item_id, part, {r6(LAPLACE)} AS value FROM comp_stats", "comp_stats")
ORACLE["assoc_mi_strict"] = build(f"SELECT a1, a2, {r6(MI_STRICT)} AS value FROM bstats", "bstats")
ORACLE["assoc_lmi"] = build(f"SELECT a1, a2, {r6(f'({MI_STRICT}) * ab')} AS value FROM bstats", "bstats")
ORACLE["assoc_cprob"] = build(f"SELECT a1, a2, {r6('((ab * b) / a) * n')} AS value FROM bstats", "bstats")
ORACLE["assoc_cprob_simple"] = build(f"SELECT a1, a2, {r6('ab / a')} AS value FROM bstats", "bstats")
ORACLE["assoc_by_name"] = build(
    f"SELECT a1, a2, {r6(f'({MI_STRICT}) * ab')} AS lmi, "
    f"{r6(f'greatest(0.0, coalesce({MI_STRICT}, 0.0))')} AS ppmi FROM bstats", "bstats")

ORACLE["word_role_marginals"] = build("SELECT w, role, f FROM marg", "marg")
ORACLE["triple_total"] = build("SELECT n, vocab AS v FROM tot", "tot")
ORACLE["verb_total"] = build("SELECT n_verb FROM nverb", "nverb")
ORACLE["attested_args"] = build("SELECT a1 AS w FROM bigrams UNION SELECT a2 FROM bigrams", "bigrams")
ORACLE["corpus_lemma_counts"] = build("SELECT word, freq FROM lemmas", "lemmas")
ORACLE["corpus_pair_counts"] = build("SELECT w1, w2, freq FROM pairs", "pairs")
ORACLE["corpus_triple_counts"] = build("SELECT head, dep, raw_rel, freq FROM triples_raw WHERE freq >= 2",
                                       "triples_raw")
ORACLE["min_freq"] = ORACLE["corpus_triple_counts"]

ORACLE["pair_ppmi"] = build(f"""
SELECT item_id, round(sum({LAPLACE}), 6) AS score, sum(ab) AS raw_freq, count(*) AS n_parts
FROM pstats GROUP BY item_id""", "pstats")
ORACLE["pair_ppmi_raw"] = build(f"""
SELECT item_id, round(sum({PPMI}), 6) AS score, sum(ab) AS raw_freq, count(*) AS n_parts
FROM pstats GROUP BY item_id""", "pstats")
ORACLE["report_pair_ppmi"] = build(f"""
SELECT item_id, round(sum({LAPLACE}), 6) AS score FROM pstats GROUP BY item_id ORDER BY item_id""", "pstats")
ORACLE["src_pairs_vocab"] = build("SELECT w1, w2, freq FROM ppairs", "ppairs")
ORACLE["item_vocab"] = build("SELECT word FROM pvocab", "pvocab")

ORACLE["report_ppmi"] = build(f"""
SELECT s.item_id, t.text, string_agg(printf('%.6f', round(val, 6)), ',' ORDER BY part) AS parts,
       round(sum(val), 6) AS score
FROM (SELECT *, {LAPLACE} AS val FROM comp_stats) s
JOIN (SELECT item_id, string_agg(lemma, ' ' ORDER BY slot) AS text FROM items_long GROUP BY item_id) t
  USING (item_id)
GROUP BY s.item_id, t.text""", "comp_stats", "items_long")

ORACLE["explain_ppmi"] = build(f"""
SELECT item_id,
       string_agg(printf('%s-%s-%s freq:%s ppmi:%s', v, arg, role, printf('%.1f', ab),
                         printf('%.6f', round(val, 6))), chr(9) ORDER BY part) AS log,
       CASE WHEN sum(ab) = 0 THEN 'zero_score' ELSE 'score' END AS flag
FROM (SELECT *, {LAPLACE} AS val FROM comp_stats) s GROUP BY item_id""", "comp_stats")

# ------------------------------------------------------ text functions
ORACLE["prep_sentence"] = build(r"""
SELECT sent_id, t AS text, (t LIKE '%.' AND NOT t LIKE '% .') AS valid
FROM (SELECT sent_id, regexp_replace(text, '\s*\.$', '') || '.' AS t FROM sents) s""", "sents")
ORACLE["word_count"] = build(r"""
SELECT sent_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS n_words
FROM sents""", "sents")
ORACLE["strip_final_period"] = build(r"SELECT sent_id, regexp_replace(text, '\.+$', '') AS text FROM sents", "sents")
ORACLE["target_word"] = build(r"""
SELECT sent_id, regexp_replace(w[word_pos + 1], '\.+$', '') AS word, regexp_replace(w[-1], '\.+$', '') AS last_word
FROM (SELECT sent_id, word_pos, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM sents) s""",
                                "sents")
ORACLE["parse_item"] = build("""
SELECT item_id, slot, lemma, pos, role, split_part(role, ':', 1) AS base_role, concat(lemma, '@', pos) AS key
FROM items_long""", "items_long")
ORACLE["item_lemmas"] = build("SELECT item_id, slot, lemma FROM items_long", "items_long")
ORACLE["role_prefix_match"] = build("""
SELECT t.target, r.role FROM
  (SELECT DISTINCT split_part(role, ':', 1) AS target FROM items_long WHERE slot = n_slots - 1) t
  JOIN (SELECT DISTINCT regexp_extract(a2, '([^@]*)$', 1) AS role FROM bigrams) r
  ON starts_with(r.role, t.target)""", "items_long", "bigrams")

# ------------------------------------------------------- thematic fit
view("vectors", ("fillers",), """
SELECT coalesce(f.filler, 'w' || e.vec_id) AS word, CAST(e.embedding AS DOUBLE[]) AS vec
FROM embeddings e LEFT JOIN fillers f ON f.k = e.vec_id
WHERE e.label <> 0""")

view("ik", ("items_long",), """
SELECT item_id,
       string_agg(lemma || '@' || pos || '@' || role, chr(9) ORDER BY slot) FILTER (WHERE slot < n_slots - 1)
         || '|' || split_part(max(role) FILTER (WHERE slot = n_slots - 1), ':', 1) AS ctx_key,
       split_part(max(role) FILTER (WHERE slot = n_slots - 1), ':', 1) AS t_role,
       max(lemma) FILTER (WHERE slot = n_slots - 1) AS t_lemma,
       max(pos) FILTER (WHERE slot = n_slots - 1) AS t_pos
FROM items_long GROUP BY item_id""")

view("kctx", ("ik", "items_long"), """
SELECT DISTINCT ik.ctx_key, ik.t_role, il.slot AS ci, il.lemma || '@' || il.pos || '@' || il.role AS w
FROM ik JOIN items_long il USING (item_id) WHERE il.slot < il.n_slots - 1""")

view("attested", ("bigrams",), "SELECT a1 AS w FROM bigrams UNION SELECT a2 FROM bigrams")

view("att", ("kctx", "attested"), """
SELECT ctx_key, t_role, w, CAST(row_number() OVER (PARTITION BY ctx_key ORDER BY ci) - 1 AS INTEGER) AS li
FROM kctx WHERE w IN (SELECT w FROM attested)""")

view("adj", ("bigrams",), """
SELECT a1 AS w, a2 AS o, freq FROM bigrams
UNION ALL SELECT a2, a1, freq FROM bigrams WHERE a1 <> a2""")

MI_STRICT_XY = ("CASE WHEN x.freq * y.freq <> 0 AND (adj.freq * nverb.n_verb) / (x.freq * y.freq) > 0 "
                "THEN log2((adj.freq * nverb.n_verb) / (x.freq * y.freq)) END")

view("lists", ("att", "adj", "nverb", "lemma_pos_freqs"), f"""
SELECT p.w, p.t_role, regexp_replace(adj.o, '@[^@]*$', '') AS filler,
       regexp_extract(adj.o, '([^@]*)$', 1) AS role,
       round(({MI_STRICT_XY}) * adj.freq, 9) AS weight
FROM (SELECT DISTINCT w, t_role FROM att) p JOIN adj ON adj.w = p.w CROSS JOIN nverb
JOIN lemma_pos_freqs x ON x.lemma_pos = regexp_replace(adj.w, '@[^@]*$', '')
JOIN lemma_pos_freqs y ON y.lemma_pos = regexp_replace(adj.o, '@[^@]*$', '')
WHERE starts_with(regexp_extract(adj.o, '([^@]*)$', 1), p.t_role)""")

view("ranked", ("lists",), """
SELECT *, CAST(row_number() OVER (PARTITION BY w, t_role ORDER BY weight DESC, filler, role) AS INTEGER) AS rk
FROM lists""")

view("nl", ("att",), "SELECT ctx_key, count(*) AS nl FROM att GROUP BY ctx_key")


def tf_views(n: int, m: int, update: str) -> list[tuple[str, str]]:
    """Parameter-dependent part of the thematic-fit chain (N, M, update)."""
    comb = "product(t.weight)" if update == "prod" else "sum(t.weight)"
    return [
        ("topn", f"""
SELECT w, t_role, filler, max_by(weight, rk) AS weight FROM ranked WHERE rk <= {n} GROUP BY 1, 2, 3"""),
        ("upd", f"""
SELECT a.ctx_key, t.filler, round({comb}, 9) AS score
FROM att a JOIN nl USING (ctx_key) JOIN topn t ON t.w = a.w AND t.t_role = a.t_role
WHERE nl.nl >= 2 GROUP BY a.ctx_key, t.filler, nl.nl HAVING count(*) = nl.nl"""),
        ("upd_in", "SELECT * FROM upd WHERE split_part(filler, '@', 1) IN (SELECT word FROM vectors)"),
        ("up_cnt", "SELECT ctx_key, count(*) AS n_in_space FROM upd_in GROUP BY ctx_key"),
        ("upd_top", f"""
SELECT ctx_key, r, filler, weight FROM (
  SELECT ctx_key, CAST(row_number() OVER (PARTITION BY ctx_key ORDER BY score DESC, filler) AS INTEGER) AS r,
         filler, score AS weight FROM upd_in) s WHERE r <= {m}"""),
        ("ops", """
SELECT k.ctx_key, nl.nl, up.n_in_space,
       CASE WHEN nl.nl IS NULL THEN 'no_fillers' WHEN nl.nl = 1 THEN 'one_filler_list'
            WHEN up.n_in_space > 0 THEN 'update' ELSE 'intersection_empty_get_verbfillers' END AS operation
FROM (SELECT DISTINCT ctx_key FROM ik) k LEFT JOIN nl USING (ctx_key) LEFT JOIN up_cnt up USING (ctx_key)"""),
        ("inv", f"""
SELECT w, t_role, r, filler, weight FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY w, t_role ORDER BY weight DESC, filler, role) AS INTEGER) AS r
  FROM lists WHERE split_part(filler, '@', 1) IN (SELECT word FROM vectors)) s WHERE r <= {m}"""),
        ("chosen", """
SELECT o.ctx_key, i.r, i.filler, i.weight FROM ops o
JOIN att a ON a.ctx_key = o.ctx_key AND a.li = CASE WHEN o.operation = 'one_filler_list' THEN 0 ELSE 1 END
JOIN inv i ON i.w = a.w AND i.t_role = a.t_role
WHERE o.operation IN ('one_filler_list', 'intersection_empty_get_verbfillers')
UNION ALL SELECT u.ctx_key, u.r, u.filler, u.weight FROM ops o JOIN upd_top u USING (ctx_key)
WHERE o.operation = 'update'"""),
        ("cvec", """
SELECT c.ctx_key, c.r, v.vec FROM chosen c JOIN vectors v ON v.word = split_part(c.filler, '@', 1)"""),
        ("cent", f"""
SELECT s.ctx_key, c.n_vecs, list(CASE WHEN c.n_vecs = 1 THEN s.s ELSE s.s / {float(m)} END ORDER BY s.i) AS centroid
FROM (SELECT ctx_key, i, sum(x) AS s FROM (
        SELECT ctx_key, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM cvec) d
      GROUP BY ctx_key, i) s
JOIN (SELECT ctx_key, count(*) AS n_vecs FROM cvec GROUP BY ctx_key) c USING (ctx_key)
GROUP BY s.ctx_key, c.n_vecs"""),
        ("tfs", """
SELECT ik.item_id, CASE WHEN c.centroid IS NULL THEN 0.0 ELSE round(
         list_dot_product(t.vec, c.centroid)
         / nullif(sqrt(list_dot_product(t.vec, t.vec)) * sqrt(list_dot_product(c.centroid, c.centroid)), 0), 6)
       END AS score
FROM ik LEFT JOIN cent c USING (ctx_key) LEFT JOIN vectors t ON t.word = ik.t_lemma"""),
    ]


TF_BASE = ("ik", "att", "lists", "ranked", "nl", "vectors")


def tf_build(body: str, n: int, m: int, update: str, *extra: str) -> str:
    base = build("SELECT 1", *TF_BASE, *extra)
    head = base[: base.rindex("\nSELECT 1")]
    tail = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in tf_views(n, m, update))
    return f"{head},\n{tail}\n{body}"


TF_N, TF_M = 200, 20
COS = ("round(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) "
       "* sqrt(list_dot_product({b}, {b})), 0), 6)")

ORACLE["attested_contexts"] = build("SELECT ctx_key, li, w FROM att", "att")
ORACLE["unattested_contexts"] = build(
    "SELECT ctx_key, t_role, CAST(ci AS INTEGER) AS ci, w FROM kctx WHERE w NOT IN (SELECT w FROM attested)",
    "kctx", "attested")
ORACLE["filler_retrieval"] = build("SELECT w, t_role, filler, role, weight FROM lists", "lists")
ORACLE["filler_rank"] = build("SELECT w, t_role, filler, role, weight, rk FROM ranked", "ranked")
ORACLE["filler_top_n"] = tf_build("SELECT w, t_role, filler, weight FROM topn", TF_N, TF_M, "prod")
ORACLE["filler_intersection"] = tf_build("SELECT ctx_key, filler FROM upd", TF_N, TF_M, "prod")
ORACLE["filler_update_prod"] = tf_build("SELECT ctx_key, filler, score FROM upd", TF_N, TF_M, "prod")
ORACLE["filler_update_add"] = tf_build("SELECT ctx_key, filler, score FROM upd", TF_N, TF_M, "add")
ORACLE["prototype_fillers"] = tf_build("SELECT ctx_key, r, filler, weight FROM chosen", TF_N, TF_M, "prod")
ORACLE["tf_operation"] = tf_build(
    "SELECT ik.item_id, ops.operation FROM ik JOIN ops USING (ctx_key)", TF_N, TF_M, "prod")
ORACLE["prototype_centroid"] = tf_build("""
SELECT ctx_key, n_vecs, CAST(len(centroid) AS INTEGER) AS dim,
       round(list_sum(centroid), 6) AS c_sum, round(sqrt(list_dot_product(centroid, centroid)), 6) AS c_norm
FROM cent""", TF_N, TF_M, "prod")
ORACLE["cosine_pairs"] = tf_build(f"""
SELECT c.ctx_key, c.r, {COS.format(a='v.vec', b='ce.centroid')} AS cos
FROM chosen c JOIN vectors v ON v.word = split_part(c.filler, '@', 1) JOIN cent ce USING (ctx_key)""",
                                  TF_N, TF_M, "prod")
ORACLE["tf_score"] = tf_build("SELECT item_id, score FROM tfs", TF_N, TF_M, "prod")
ORACLE["explain_prototype"] = tf_build("""
SELECT ik.item_id, coalesce(f.fillers, '') AS fillers, ops.operation
FROM ik JOIN ops USING (ctx_key)
LEFT JOIN (SELECT ctx_key, string_agg(filler || ' (' || CAST(round(weight, 2) + 0.0 AS VARCHAR) || ')', ',' ORDER BY r)
             AS fillers FROM chosen GROUP BY ctx_key) f USING (ctx_key)""", TF_N, TF_M, "prod")
ORACLE["vec_key_lookup"] = build("""
SELECT item_id, t_lemma AS vkey, t_lemma || '/' || t_pos AS vkey_pos,
       t_lemma IN (SELECT word FROM vectors) AS in_space
FROM ik""", "ik", "vectors")


def _sweep_sql() -> str:
    parts = []
    for n, m, upd in SWEEP:
        q = tf_build(f"SELECT item_id, {n} AS list_length, {m} AS n_centroid, '{upd}' AS update_fn, score FROM tfs",
                     n, m, upd)
        parts.append(f"SELECT * FROM ({q}) s{len(parts)}")
    return "\nUNION ALL\n".join(parts)


SWEEP = [(8, 5, "prod"), (20, 5, "add"), (200, 20, "prod")]
ORACLE["tf_param_sweep"] = _sweep_sql()

view("lcent", ("lists", "vectors"), f"""
WITH top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY w, t_role ORDER BY weight DESC, filler, role) AS r
    FROM lists WHERE split_part(filler, '@', 1) IN (SELECT word FROM vectors)) s WHERE r <= {TF_M}),
tv AS (SELECT top.w, top.t_role, v.vec FROM top JOIN vectors v ON v.word = split_part(top.filler, '@', 1)),
cnt AS (SELECT w, t_role, count(*) AS n FROM tv GROUP BY w, t_role),
sums AS (SELECT w, t_role, i, sum(x) AS s FROM (
           SELECT w, t_role, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM tv) d GROUP BY w, t_role, i)
SELECT sums.w, sums.t_role, list(CASE WHEN cnt.n = 1 THEN sums.s ELSE sums.s / {float(TF_M)} END ORDER BY sums.i) AS lc
FROM sums JOIN cnt USING (w, t_role) GROUP BY sums.w, sums.t_role""")

ORACLE["sdm_combine"] = tf_build(f"""
SELECT item_id, cos_lc, cos_ac,
       CASE WHEN cos_lc IS NULL AND cos_ac IS NULL THEN NULL
            ELSE round(coalesce(cos_lc, 0.0) + coalesce(cos_ac, 0.0), 6) END AS score
FROM (
  SELECT ik.item_id, {COS.format(a='t.vec', b='lc.lc')} AS cos_lc, {COS.format(a='t.vec', b='ce.centroid')} AS cos_ac
  FROM ik
  JOIN (SELECT ctx_key, t_role, w FROM kctx WHERE ci = 1) vb USING (ctx_key)
  LEFT JOIN lcent lc ON lc.w = vb.w AND lc.t_role = vb.t_role
  LEFT JOIN cent ce USING (ctx_key)
  LEFT JOIN vectors t ON t.word = ik.t_lemma) s""", TF_N, TF_M, "prod", "lcent")

# ----------------------------------------------------------- LM scores
PRETOK = r"'[\p{L}\p{N}]+|[^\p{L}\p{N}\s]'"
PIECES_PREFIX = (f"flatten(list_transform(regexp_extract_all(__T__, {PRETOK}), lambda p: list_transform("
                 "range(0, CAST(ceil(length(p) / 4) AS BIGINT)), lambda j: "
                 "CASE WHEN j > 0 THEN '##' ELSE '' END || substring(p, j * 4 + 1, 4))))")
PIECES_MARKER = (f"flatten(list_transform(regexp_extract_all(__T__, {PRETOK}), lambda p, i: list_transform("
                 "range(0, CAST(ceil(length(p) / 4) AS BIGINT)), lambda j: "
                 "CASE WHEN j = 0 AND i > 1 AND regexp_matches(p, '^[\\p{L}\\p{N}]') THEN 'Ġ' ELSE '' END "
                 "|| substring(p, j * 4 + 1, 4))))")


def _lmsent(pieces: str) -> str:
    return rf"""
SELECT sent_id, t AS text, word_pos,
       CAST(len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS INTEGER) AS n_words,
       {pieces.replace('__T__', 't')} AS pcs
FROM (SELECT sent_id, word_pos, regexp_replace(text, '\s*\.$', '') || '.' AS t FROM sents) s"""


view("lmsent", ("sents",), _lmsent(PIECES_PREFIX))
view("lmsent_m", ("sents",), _lmsent(PIECES_MARKER))
view("dpcs", (), f"SELECT doc_id, {PIECES_PREFIX.replace('__T__', 'text')} AS pcs FROM documents")
view("puni", ("dpcs",), """
SELECT w, CAST(count(*) AS DOUBLE) AS c FROM (SELECT unnest(['<s>'] || pcs) AS w FROM dpcs) s GROUP BY w""")
view("pbi", ("dpcs",), """
SELECT prev, w, CAST(count(*) AS DOUBLE) AS c FROM (
  SELECT unnest((['<s>'] || pcs)[1:len(pcs)]) AS prev, unnest(pcs) AS w FROM dpcs WHERE len(pcs) > 0) s
GROUP BY prev, w""")
view("ptot2", ("puni",), "SELECT sum(c) AS N, CAST(count(*) AS DOUBLE) AS V FROM puni")
view("ltok", ("lmsent",), """
SELECT sent_id, CAST(len(pcs) AS INTEGER) AS n, CAST(i AS INTEGER) AS pos, (['<s>'] || pcs)[i] AS prev,
       pcs[i] AS token, pcs[i + 1] AS nxt
FROM (SELECT sent_id, pcs, unnest(range(1, len(pcs) + 1)) AS i FROM lmsent) s""")
view("tfeat", ("ltok", "puni", "pbi", "ptot2"), """
SELECT t.sent_id, t.pos, t.token, t.n,
       ln((coalesce(b1.c, 0) + 1) / (coalesce(up.c, 0) + ptot2.V)) AS left_bi,
       ln((coalesce(ut.c, 0) + 1) / (ptot2.N + ptot2.V)) AS uni,
       CASE WHEN t.nxt IS NOT NULL THEN ln((coalesce(b2.c, 0) + 1) / (coalesce(ut.c, 0) + ptot2.V))
            - ln((coalesce(un.c, 0) + 1) / (ptot2.N + ptot2.V)) END AS right_gain
FROM ltok t CROSS JOIN ptot2
LEFT JOIN puni ut ON ut.w = t.token LEFT JOIN puni up ON up.w = t.prev LEFT JOIN puni un ON un.w = t.nxt
LEFT JOIN pbi b1 ON b1.prev = t.prev AND b1.w = t.token
LEFT JOIN pbi b2 ON b2.prev = t.token AND b2.w = t.nxt""")
view("wgp", ("ltok",), """
SELECT sent_id, pos, token, n,
       CAST(sum(CASE WHEN token LIKE '#%' THEN 0 ELSE 1 END) OVER (PARTITION BY sent_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS INTEGER) AS word_idx
FROM ltok""")
view("plan_plain", ("ltok",), "SELECT sent_id, pos AS target_pos, pos AS mask_from, pos AS mask_to FROM ltok")
view("plan_l2r", ("ltok",), "SELECT sent_id, pos AS target_pos, pos AS mask_from, n AS mask_to FROM ltok")
view("plan_adapted", ("wgp",), """
SELECT sent_id, pos AS target_pos, pos AS mask_from,
       max(pos) OVER (PARTITION BY sent_id, word_idx) AS mask_to FROM wgp""")

LP = ("CASE WHEN p.target_pos = 1 OR p.target_pos - 1 < p.mask_from OR p.target_pos - 1 > p.mask_to "
      "THEN f.left_bi ELSE f.uni END + CASE WHEN p.target_pos + 1 > p.mask_to AND f.right_gain IS NOT NULL "
      "THEN f.right_gain ELSE 0.0 END")
for _k in ("plain", "l2r", "adapted"):
    view(f"ts_{_k}", (f"plan_{_k}", "tfeat"), f"""
SELECT p.sent_id, p.target_pos, {LP} AS logprob
FROM plan_{_k} p JOIN tfeat f ON f.sent_id = p.sent_id AND f.pos = p.target_pos""")
    view(f"ss_{_k}", (f"ts_{_k}", "lmsent"), f"""
SELECT s.sent_id, s.text, round(coalesce(t.score, 0.0), 6) AS score,
       round(coalesce(t.score, 0.0) / nullif(len(s.pcs), 0), 6) AS score_by_tokens,
       round(coalesce(t.score, 0.0) / nullif(s.n_words, 0), 6) AS score_by_words,
       CAST(len(s.pcs) AS INTEGER) AS n_tokens, s.n_words
FROM lmsent s LEFT JOIN (SELECT sent_id, sum(logprob) AS score FROM ts_{_k} GROUP BY sent_id) t USING (sent_id)""")
    ORACLE[f"mask_plan_{_k}"] = build(f"SELECT sent_id, target_pos, mask_from, mask_to FROM plan_{_k}",
                                      f"plan_{_k}")

view("causal", ("lmsent", "puni", "pbi", "ptot2"), """
WITH t AS (
  SELECT sent_id, unnest(seq[1:len(pcs) + 1]) AS prev, unnest(seq[2:len(pcs) + 2]) AS w
  FROM (SELECT sent_id, pcs, ['<s>'] || pcs || ['<s>'] AS seq FROM lmsent) s),
lp AS (
  SELECT t.sent_id, ln((coalesce(b.c, 0) + 1) / (coalesce(u.c, 0) + ptot2.V)) AS lp
  FROM t CROSS JOIN ptot2 LEFT JOIN pbi b ON b.prev = t.prev AND b.w = t.w LEFT JOIN puni u ON u.w = t.prev),
a AS (SELECT sent_id, avg(lp) AS m FROM lp GROUP BY sent_id)
SELECT s.sent_id, s.text, round(a.m * (len(s.pcs) + 2), 6) AS score, round(a.m, 6) AS score_by_tokens,
       round(a.m * (len(s.pcs) + 2) / nullif(s.n_words, 0), 6) AS score_by_words,
       CAST(len(s.pcs) + 2 AS INTEGER) AS n_tokens, s.n_words
FROM lmsent s JOIN a USING (sent_id)""")

view("surp", ("ltok", "puni", "pbi"), """
SELECT t.sent_id AS sentence_id, t.pos AS token_id, CASE WHEN uw.c IS NULL THEN 'UNK' ELSE t.token END AS token,
       -log2((coalesce(b.c, 0) + 1) / (coalesce(up.c, 0) + (SELECT CAST(count(*) AS DOUBLE) FROM puni))) AS surprisal
FROM ltok t LEFT JOIN pbi b ON b.prev = t.prev AND b.w = t.token
LEFT JOIN puni up ON up.w = t.prev LEFT JOIN puni uw ON uw.w = t.token""")

view("spans", ("lmsent",), rf"""
SELECT sent_id, k, coalesce(
    list_filter(cands, lambda i: pcs[i:i + k - 1] = wp)[1], cands[-1]) AS start
FROM (SELECT sent_id, pcs, wp, len(wp) AS k,
             list_filter(range(1, greatest(len(pcs), 1) + 1), lambda i: pcs[i] = wp[1]) AS cands
      FROM (SELECT sent_id, pcs, {PIECES_PREFIX.replace('__T__', 'w')} AS wp
            FROM (SELECT sent_id, pcs,
                         regexp_replace(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[word_pos + 1],
                                        '\.+$', '') AS w
                  FROM lmsent) a) b) c""")
view("spans_last", ("lmsent",), rf"""
SELECT sent_id, k, coalesce(
    list_filter(cands, lambda i: pcs[i:i + k - 1] = wp)[1], cands[-1]) AS start
FROM (SELECT sent_id, pcs, wp, len(wp) AS k,
             list_filter(range(1, greatest(len(pcs), 1) + 1), lambda i: pcs[i] = wp[1]) AS cands
      FROM (SELECT sent_id, pcs, {PIECES_PREFIX.replace('__T__', 'w')} AS wp
            FROM (SELECT sent_id, pcs,
                         regexp_replace(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[-1],
                                        '\.+$', '') AS w
                  FROM lmsent) a) b) c""")

ORACLE["word_groups_prefix"] = build("SELECT sent_id, pos, token, word_idx FROM wgp", "wgp")
ORACLE["word_groups_marker"] = build("""
SELECT sent_id, pos, token,
       CAST(sum(CASE WHEN pos = 1 OR token IN ('[CLS]', '[SEP]', '<s>', '</s>', '.') OR token LIKE 'Ġ%'
                      OR coalesce(prev, '') = '.' THEN 1 ELSE 0 END)
            OVER (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS INTEGER)
         AS word_idx
FROM (SELECT sent_id, CAST(i AS INTEGER) AS pos, pcs[i] AS token, CASE WHEN i > 1 THEN pcs[i - 1] END AS prev
      FROM (SELECT sent_id, pcs, unnest(range(1, len(pcs) + 1)) AS i FROM lmsent_m) s) t""", "lmsent_m")
ORACLE["token_count"] = build("""
SELECT sent_id, CAST(len(pcs) AS INTEGER) AS n_tokens, CAST(len(pcs) + 2 AS INTEGER) AS n_with_markers
FROM lmsent""", "lmsent")
ORACLE["locate_span"] = build("SELECT sent_id, CAST(start AS INTEGER) AS start, CAST(k AS INTEGER) AS k FROM spans", "spans")
ORACLE["span_score"] = build("""
SELECT s.sent_id, round(sum(t.logprob), 6) AS score
FROM spans s LEFT JOIN ts_plain t ON t.sent_id = s.sent_id AND t.target_pos BETWEEN s.start AND s.start + s.k - 1
GROUP BY s.sent_id, s.k""", "spans", "ts_plain")
view("lg", ("pbi", "ltok"), "SELECT prev, w AS cand, ln(c + 1) AS logit FROM pbi WHERE prev IN (SELECT prev FROM ltok)")
view("lse", ("lg",), """
SELECT l.prev, m.m + ln(sum(exp(l.logit - m.m))) AS lse
FROM lg l JOIN (SELECT prev, max(logit) AS m FROM lg GROUP BY prev) m USING (prev) GROUP BY l.prev, m.m""")
ORACLE["log_softmax_gather"] = build("""
SELECT t.sent_id, t.pos, round(g.logit - lse.lse, 6) AS logprob
FROM ltok t LEFT JOIN lg g ON g.prev = t.prev AND g.cand = t.token LEFT JOIN lse ON lse.prev = t.prev""",
                                      "ltok", "lg", "lse")
ORACLE["sentence_pll"] = build("SELECT sent_id, score FROM ss_plain", "ss_plain")
ORACLE["length_normalise"] = build("""
SELECT sent_id, 'none' AS norm, score FROM ss_plain
UNION ALL SELECT sent_id, 'byNrTokens', score_by_tokens FROM ss_plain
UNION ALL SELECT sent_id, 'byNrWords', score_by_words FROM ss_plain""", "ss_plain")
ORACLE["pll_plain"] = build("SELECT * FROM ss_plain", "ss_plain")
ORACLE["pll_l2r"] = build("SELECT * FROM ss_l2r", "ss_l2r")
ORACLE["pll_adapted"] = build("SELECT sent_id, text, score, n_tokens, n_words FROM ss_adapted", "ss_adapted")
ORACLE["causal_ll"] = build("SELECT * FROM causal", "causal")
ORACLE["word_score_at"] = build("""
SELECT s.sent_id, round(sum(t.logprob) / s.k, 6) AS score
FROM spans s LEFT JOIN ts_plain t ON t.sent_id = s.sent_id AND t.target_pos BETWEEN s.start AND s.start + s.k - 1
GROUP BY s.sent_id, s.k""", "spans", "ts_plain")
ORACLE["word_score_last"] = build("""
SELECT s.sent_id, round(sum(t.logprob) / s.k, 6) AS score
FROM spans_last s LEFT JOIN ts_plain t ON t.sent_id = s.sent_id AND t.target_pos BETWEEN s.start AND s.start + s.k - 1
GROUP BY s.sent_id, s.k""", "spans_last", "ts_plain")
ORACLE["ngram_surprisal"] = build("SELECT sentence_id, token_id, token, round(surprisal, 6) AS surprisal FROM surp", "surp")
ORACLE["sentence_surprisal"] = build("""
SELECT s.sent_id, round(coalesce(x.surprisal, 0.0), 6) AS surprisal
FROM lmsent s LEFT JOIN (SELECT sentence_id, sum(surprisal) AS surprisal FROM surp GROUP BY sentence_id) x
  ON x.sentence_id = s.sent_id""", "lmsent", "surp")
ORACLE["surprisal_report"] = build("""
SELECT s.sent_id, s.text, round(coalesce(x.surprisal, 0.0), 6) AS surprisal, coalesce(x.sentence, '') AS sentence,
       CASE WHEN coalesce(x.sentence, '') LIKE '%UNK%' THEN 'unk' ELSE 'nounk' END AS unk
FROM lmsent s LEFT JOIN (SELECT sentence_id, sum(surprisal) AS surprisal,
                                string_agg(token, ' ' ORDER BY token_id) AS sentence
                         FROM surp GROUP BY sentence_id) x ON x.sentence_id = s.sent_id""", "lmsent", "surp")
ORACLE["score_with_udf"] = build("SELECT sent_id, target_pos, round(logprob, 6) AS logprob FROM ts_plain", "ts_plain")
ORACLE["sentence_number"] = build(
    "SELECT sent_id, CAST(row_number() OVER (ORDER BY sent_id) - 1 AS BIGINT) AS idx FROM sents", "sents")
ORACLE["dedupe_last"] = build("""
SELECT head, dep, role, max_by(freq, raw_rel) AS freq FROM triples_raw JOIN role_map USING (raw_rel)
GROUP BY head, dep, role""", "triples_raw", "role_map")
ORACLE["score_fanout"] = build("""
SELECT sent_id, m AS metric, nm AS norm, sc AS score FROM (
  SELECT sent_id, 'sentence-PLL' AS m, score, score_by_tokens, score_by_words FROM ss_adapted
  UNION ALL SELECT sent_id, 'sentence-l2r-PLL', score, score_by_tokens, score_by_words FROM ss_l2r
  UNION ALL SELECT sent_id, 'sentence-LL', score, score_by_tokens, score_by_words FROM causal) u,
  (VALUES ('', 0), ('average_byNrTokens', 1), ('average_byNrWords', 2)) v(nm, j),
  LATERAL (SELECT CASE v.j WHEN 0 THEN u.score WHEN 1 THEN u.score_by_tokens ELSE u.score_by_words END AS sc) x""",
                               "ss_adapted", "ss_l2r", "causal")

# ------------------------------------------------------ sources and sinks
ORACLE["src_sentences"] = build("SELECT sent_id, text, word_pos FROM sents", "sents")
ORACLE["src_role_items"] = build(
    "SELECT item_id, slot, lemma, pos, role, slot = n_slots - 1 AS is_target FROM items_long", "items_long")
ORACLE["src_role_map"] = build("SELECT raw_rel, role FROM role_map", "role_map")
ORACLE["src_triples_mapped"] = build("SELECT head, dep, role, freq FROM triples", "triples")
ORACLE["src_lemma_pos"] = build("""
SELECT split_part(lemma_pos, '@', 1) AS lemma, split_part(lemma_pos, '@', 2) AS pos, freq FROM lemma_pos_freqs""",
                                "lemma_pos_freqs")
ORACLE["src_lemma_sum"] = build("""
SELECT tok AS word, CAST(count(*) AS DOUBLE) AS freq, (SELECT CAST(count(*) AS DOUBLE) FROM toks) AS n_total
FROM toks GROUP BY tok""", "toks")
view("raw_bigrams", ("base",), """
SELECT x1, x2, CAST(sum(c) AS DOUBLE) AS freq FROM (
  SELECT subj || '@N@' || raw_rel AS x1, verb || '@V@HEAD' AS x2, count(*) AS c
  FROM base WHERE raw_rel LIKE 'R%' GROUP BY 1, 2
  UNION ALL SELECT verb || '@V@HEAD', filler || '@N@' || raw_rel, count(*)
  FROM base WHERE raw_rel NOT LIKE 'R%' GROUP BY 1, 2) u
GROUP BY x1, x2""")
ORACLE["src_bigrams_mapped"] = build("""
SELECT split_part(x1, '@', 1) || '@' || split_part(x1, '@', 2) || '@' || m1.role AS a1,
       split_part(x2, '@', 1) || '@' || split_part(x2, '@', 2) || '@' || m2.role AS a2,
       last(freq ORDER BY x1, x2) AS freq
FROM raw_bigrams JOIN role_map m1 ON m1.raw_rel = split_part(x1, '@', 3)
JOIN role_map m2 ON m2.raw_rel = split_part(x2, '@', 3)
GROUP BY 1, 2""", "raw_bigrams", "role_map")
ORACLE["src_vectors"] = build("""
SELECT word, CAST(len(v) AS INTEGER) AS dim, round(list_sum(v), 6) AS v_sum, round(v[1], 6) AS v_first
FROM (SELECT word, list_slice(vec, len(vec) - 31, len(vec)) AS v FROM vectors
      WHERE word IN (SELECT lemma FROM items_long)) s""", "vectors", "items_long")
ORACLE["src_vectors_full"] = build("""
SELECT word, CAST(len(vec) AS INTEGER) AS dim, round(list_sum(vec), 6) AS v_sum, round(vec[1], 6) AS v_first FROM vectors""", "vectors")
ORACLE["src_vectors_first"] = build("""
SELECT word, CAST(len(v) AS INTEGER) AS dim, round(list_sum(v), 6) AS v_sum, round(v[1], 6) AS v_first
FROM (SELECT word, list_slice(vec, 1, 32) AS v FROM vectors) s""", "vectors")
ORACLE["src_surprisal"] = build("SELECT sentence_id, token_id, token, round(surprisal, 6) AS surprisal FROM surp", "surp")
view("orig", ("items_long", "orders_v"), """
SELECT i.item_id, string_agg(i.lemma, ' ' ORDER BY i.slot) AS text,
       CASE WHEN max(o.o_orderstatus) = 'F' THEN 'Plausible' ELSE 'Implausible' END AS label,
       string_agg(i.lemma || ':' || lower(i.role), ' ' ORDER BY i.slot) || ' ' AS deps
FROM items_long i JOIN orders_v o ON o.o_orderkey = i.item_id GROUP BY i.item_id""")
view("orders_v", (), "SELECT o_orderkey, o_orderstatus FROM orders")
view("ppmi_scores", ("comp_stats",), f"""
SELECT item_id, round(sum({LAPLACE}), 6) AS score FROM comp_stats GROUP BY item_id""")
ORACLE["join_original"] = build("""
SELECT o.item_id, o.text, o.label, o.deps, p.score FROM orig o JOIN ppmi_scores p USING (item_id)""",
                                "orig", "ppmi_scores")
view("score_matrix", ("ss_adapted", "ss_l2r", "causal"), """
SELECT 'sents' AS dataset, 'bigram' AS model, m AS metric, nm AS norm, sent_id AS id, text, sc AS score,
       n_tokens, n_words
FROM (
  SELECT 'sentence-PLL' AS m, * FROM ss_adapted
  UNION ALL SELECT 'sentence-l2r-PLL', * FROM ss_l2r
  UNION ALL SELECT 'sentence-LL', * FROM causal) u,
  (VALUES ('none', 0), ('average_byNrTokens', 1), ('average_byNrWords', 2)) v(nm, j),
  LATERAL (SELECT CASE v.j WHEN 0 THEN u.score WHEN 1 THEN u.score_by_tokens ELSE u.score_by_words END AS sc) x""")
view("word_matrix", ("spans", "spans_last", "ts_plain", "lmsent"), """
SELECT 'sents' AS dataset, 'bigram' AS model, metric, 'none' AS norm, s.sent_id AS id, l.text, s.score,
       CAST(NULL AS INTEGER) AS n_tokens, CAST(NULL AS INTEGER) AS n_words
FROM (SELECT 'verb-PLL' AS metric, sp.sent_id, round(sum(t.logprob) / sp.k, 6) AS score
      FROM spans sp LEFT JOIN ts_plain t ON t.sent_id = sp.sent_id
        AND t.target_pos BETWEEN sp.start AND sp.start + sp.k - 1 GROUP BY sp.sent_id, sp.k
      UNION ALL
      SELECT 'last-word-PLL', sp.sent_id, round(sum(t.logprob) / sp.k, 6)
      FROM spans_last sp LEFT JOIN ts_plain t ON t.sent_id = sp.sent_id
        AND t.target_pos BETWEEN sp.start AND sp.start + sp.k - 1 GROUP BY sp.sent_id, sp.k) s
JOIN lmsent l USING (sent_id)""")
ORACLE["report_sentence_scores"] = build(
    "SELECT dataset, model, metric, norm, id, score, n_tokens, n_words FROM score_matrix", "score_matrix")
ORACLE["report_word_scores"] = build("SELECT metric, id, text, score, n_tokens FROM word_matrix", "word_matrix")
ORACLE["src_score_matrix"] = build("""
SELECT dataset, model, metric, norm, id, score, n_tokens, n_words FROM score_matrix
UNION ALL SELECT dataset, model, metric, norm, id, score, n_tokens, n_words FROM word_matrix""",
                                   "score_matrix", "word_matrix")
ORACLE["report_surprisal"] = build("""
SELECT CAST(row_number() OVER (ORDER BY s.sent_id) - 1 AS BIGINT) AS idx, s.text,
       round(coalesce(x.surprisal, 0.0), 6) AS surprisal, coalesce(x.sentence, '') AS sentence,
       CASE WHEN coalesce(x.sentence, '') LIKE '%UNK%' THEN 'unk' ELSE 'nounk' END AS unk
FROM lmsent s LEFT JOIN (SELECT sentence_id, sum(surprisal) AS surprisal,
                                string_agg(token, ' ' ORDER BY token_id) AS sentence
                         FROM surp GROUP BY sentence_id) x ON x.sentence_id = s.sent_id""", "lmsent", "surp")
ORACLE["report_sentences"] = build("SELECT text FROM lmsent", "lmsent")
ORACLE["unk_flag"] = build("""
SELECT s.sent_id, CASE WHEN coalesce(x.sentence, '') LIKE '%UNK%' THEN 'unk' ELSE 'nounk' END AS unk
FROM lmsent s LEFT JOIN (SELECT sentence_id, string_agg(token, ' ' ORDER BY token_id) AS sentence
                         FROM surp GROUP BY sentence_id) x ON x.sentence_id = s.sent_id""", "lmsent", "surp")
ORACLE["rejoin_tokens"] = build("""
SELECT sentence_id AS sent_id, string_agg(token, ' ' ORDER BY token_id) AS sentence FROM surp GROUP BY sentence_id""",
                                "surp")

ORACLE["src_score_matrix_pruned"] = build("""
SELECT dataset, model, metric, norm, id, score, n_tokens, n_words FROM score_matrix
WHERE metric = 'sentence-l2r-PLL' AND norm = 'average_byNrWords'""", "score_matrix")
ORACLE["src_score_matrix_files"] = build("""
SELECT dataset, model, metric, norm, id, score, n_tokens, n_words FROM score_matrix
WHERE metric = 'sentence-PLL' AND norm IN ('none', 'average_byNrTokens')
UNION ALL SELECT dataset, model, metric, norm, id, score, n_tokens, n_words FROM word_matrix WHERE metric = 'verb-PLL'""",
                                         "score_matrix", "word_matrix")

ORACLE["vec_key_lookup_pos"] = build("""
SELECT item_id, t_lemma || '/' || t_pos AS vkey_pos, v.vec IS NOT NULL AS in_space, round(sqrt(list_dot_product(v.vec, v.vec)), 6) AS norm
FROM ik LEFT JOIN vectors v ON v.word || '/N' = t_lemma || '/' || t_pos""", "ik", "vectors")

view("frequent", ("lemma_pos_freqs",), "SELECT lemma_pos FROM lemma_pos_freqs WHERE freq >= 60")
ORACLE["filler_dropped"] = build("""
, probes AS (
  SELECT w, t_role, regexp_replace(w, '@[^@]*$', '') IN (SELECT lemma_pos FROM frequent) AS kept FROM (SELECT DISTINCT w, t_role FROM att) s),
cands AS (
  SELECT regexp_replace(adj.o, '@[^@]*$', '') IN (SELECT lemma_pos FROM frequent) AS kept
  FROM probes JOIN adj ON adj.w = probes.w WHERE probes.kept AND starts_with(regexp_extract(adj.o, '([^@]*)$', 1), probes.t_role))
SELECT 'probes' AS what, count(*) AS seen, count(*) FILTER (WHERE NOT kept) AS dropped FROM probes
UNION ALL SELECT 'candidates', count(*), count(*) FILTER (WHERE NOT kept) FROM cands""", "att", "adj", "frequent")

# ------------------------------------------------- K3-K7 as ordered files


def _line_report(key: str, line: str) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS line_no, {line} AS line FROM ({ORACLE[key]}) r"


_ID = "CAST(r.item_id AS VARCHAR)"
_SIX = "printf('%.6f', score + 0.0)"
ORACLE["report_ppmi_file"] = _line_report("report_ppmi", f"concat_ws(chr(9), {_ID}, text, parts, {_SIX})")
ORACLE["explain_ppmi_file"] = _line_report("explain_ppmi", f"concat_ws(' ', {_ID}, log, flag)")
ORACLE["report_pair_ppmi_file"] = _line_report("pair_ppmi", f"concat_ws(chr(9), {_ID}, {_SIX})")
_TEXTS = "(SELECT item_id, string_agg(lemma, ' ' ORDER BY slot) AS text, string_agg(lemma || '@' || pos || '@' || role, chr(9) ORDER BY slot) AS slots FROM ({0}) i GROUP BY item_id)".format(
    build("SELECT * FROM items_long", "items_long"))
ORACLE["report_tf_file"] = f"""
SELECT CAST(row_number() OVER (ORDER BY r.item_id) - 1 AS BIGINT) AS line_no,
       concat_ws(chr(9), {_ID}, t.text, CASE WHEN score IS NULL THEN 'None' ELSE {_SIX} END) AS line
FROM ({ORACLE["tf_score"]}) r JOIN {_TEXTS} t ON t.item_id = r.item_id"""
ORACLE["explain_tf_file"] = f"""
SELECT CAST(row_number() OVER (ORDER BY r.item_id) - 1 AS BIGINT) AS line_no,
       concat_ws(chr(9), {_ID}, t.slots, fillers, operation) AS line
FROM ({ORACLE["explain_prototype"]}) r JOIN {_TEXTS} t ON t.item_id = r.item_id"""

# ------------------------------------------------- the same model with pieces in marker style
_MARKER = ("lmsent", "dpcs", "puni", "pbi", "ptot2", "ltok", "tfeat", "plan_plain", "plan_adapted", "ts_plain", "ts_adapted")


def _marker(sql: str) -> str:
    return re.sub(r"\b(" + "|".join((*_MARKER, "wgp")) + r")\b", lambda m: m[1] + "_m", sql)


view("dpcs_m", (), f"SELECT doc_id, {PIECES_MARKER.replace('__T__', 'text')} AS pcs FROM documents")
view("wgp_m", ("ltok_m",), """
SELECT sent_id, pos, token, n, CAST(sum(CASE WHEN pos = 1 OR token IN ('[CLS]', '[SEP]', '<s>', '</s>', '.') OR token LIKE 'Ġ%'
                      OR prev = '.' THEN 1 ELSE 0 END)
            OVER (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS INTEGER) AS word_idx
FROM ltok_m""")
for _v in _MARKER[2:]:
    view(f"{_v}_m", tuple(_marker(d) for d in VIEWS[_v][0]), _marker(VIEWS[_v][1]))
ORACLE["pll_adapted_marker"] = build("""
SELECT s.sent_id, round(coalesce(t.score, 0.0), 6) AS score, CAST(len(s.pcs) AS INTEGER) AS n_tokens, s.n_words
FROM lmsent_m s LEFT JOIN (SELECT sent_id, sum(logprob) AS score FROM ts_adapted_m GROUP BY sent_id) t USING (sent_id)""",
                                     "lmsent_m", "ts_adapted_m")
view("spans_m", ("lmsent_m",), rf"""
SELECT sent_id, k, coalesce(list_filter(cands, lambda i: pcs[i:i + k - 1] = wp)[1], cands[-1]) AS start
FROM (SELECT sent_id, pcs, wp, len(wp) AS k, list_filter(range(1, greatest(len(pcs), 1) + 1), lambda i: pcs[i] = wp[1]) AS cands
      FROM (SELECT sent_id, pcs, CASE WHEN len(bare) > 0 THEN list_concat(['Ġ' || bare[1]], bare[2:]) ELSE bare END AS wp
            FROM (SELECT sent_id, pcs, {PIECES_MARKER.replace('__T__', 'w')} AS bare
                  FROM (SELECT sent_id, pcs,
                               regexp_replace(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[word_pos + 1],
                                              '\.+$', '') AS w
                        FROM lmsent_m) a) b) c) d""")
ORACLE["word_score_at_marker"] = build("""
SELECT s.sent_id, round(sum(t.logprob) / s.k, 6) AS score
FROM spans_m s LEFT JOIN ts_plain_m t ON t.sent_id = s.sent_id AND t.target_pos BETWEEN s.start AND s.start + s.k - 1
GROUP BY s.sent_id, s.k""", "spans_m", "ts_plain_m")

ORACLE["src_role_lists"] = build("""
SELECT role, string_agg(raw_rel, ',' ORDER BY raw_rel) AS raws, CAST(count(*) AS INTEGER) AS n FROM role_map GROUP BY role""", "role_map")
ORACLE["src_pair_sum"] = build("SELECT w1, w2, freq, (SELECT sum(freq) FROM pairs) AS n_total FROM pairs", "pairs")
