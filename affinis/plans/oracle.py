"""SQL that another engine can run on the same tables, one text for each query, built from named parts."""

from __future__ import annotations

import re

from affinis.schema import SMALL

P = SMALL


def sh(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.501) / 1e6"


def metrics(rows: str) -> str:
    """Over (rating, prediction)."""
    e, b = "(prediction - rating)", f"(greatest({P.low}, least({P.high}, prediction)) - rating)"
    out = f"CASE WHEN prediction < {P.low} OR prediction > {P.high} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""SELECT {sh(f'sqrt(avg({e} * {e}))')} AS rmse, {sh(f'avg(abs({e}))')} AS mae, {sh(f'avg({e})')} AS bias,
  {sh(f'sqrt(avg({b} * {b}))')} AS bounded_rmse, {sh(f'avg(abs({b}))')} AS bounded_mae, {sh(f'avg({b})')} AS bounded_bias,
  CAST(sum({out}) AS BIGINT) AS n_out_of_range, {sh(f'avg({out}) * 100')} AS out_of_range_pct,
  count(*) FILTER (WHERE prediction IS NULL OR NOT isfinite(prediction)) AS n_non_finite, count(*) AS n_total FROM {rows}"""


def ranks(scored: str, by: str = "") -> str:
    """(by, user_id, rank) by numbering all candidates."""
    return f"""SELECT {by} user_id, CAST(rank AS INTEGER) AS rank FROM (SELECT {by} user_id, is_positive,
  row_number() OVER (PARTITION BY {by} user_id ORDER BY score DESC, pos) AS rank FROM {scored}) WHERE is_positive"""


def ranking(rank_rows: str, by: str = "") -> str:
    k = P.cutoff
    group = f" GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""SELECT {by} {sh(f'avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS hit_rate,
  {sh(f'avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0.0::DOUBLE END)')} AS ndcg,
  {sh(f'avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END)')} AS mrr,
  count(*) AS n_evaluated, {P.candidates} AS n_candidates, {k} AS k FROM {rank_rows}{group}"""


PARTS: dict[str, str] = {
    "t_noise": "SELECT o_custkey AS user_id, l_partkey AS item_id, ceil(avg(l_quantity) / 5) / 2 AS rating, CAST(epoch(max(o_orderdate)) AS BIGINT) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "t_raw": """SELECT o_custkey AS user_id, l_partkey AS item_id,
  least(5.0::DOUBLE, 1.0::DOUBLE + CASE WHEN o_custkey % 5 = CAST(substr(max(p_brand), 7) AS INT) % 5 THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END + 0.5::DOUBLE * (CAST(max(l_quantity) AS INT) % 4)) AS rating,
  CAST(epoch(max(o_orderdate)) AS BIGINT) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_custkey, l_partkey""",
    "t_kept": f"SELECT * FROM t_raw WHERE user_id IN (SELECT user_id FROM t_raw GROUP BY user_id HAVING count(*) >= {P.min_history})",
    "t_split": "SELECT *, CASE row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS split FROM t_kept",
    "t_train": "SELECT user_id, item_id, rating FROM t_split WHERE split = 'train'",
    "t_val": "SELECT user_id, item_id, rating FROM t_split WHERE split = 'validation'",
    "t_test": "SELECT user_id, item_id, rating FROM t_split WHERE split = 'test'",
    "t_mu": "SELECT avg(rating) AS mu FROM t_train",
    "t_um": "SELECT user_id, coalesce(m, mu) AS mean, coalesce(c, 0) AS n FROM (SELECT DISTINCT user_id FROM t_split) LEFT JOIN (SELECT user_id, avg(rating) AS m, count(*) AS c FROM t_train GROUP BY user_id) USING (user_id), t_mu",
    "t_im": "SELECT item_id, coalesce(m, mu) AS mean, coalesce(c, 0) AS n FROM (SELECT DISTINCT item_id FROM t_split) LEFT JOIN (SELECT item_id, avg(rating) AS m, count(*) AS c FROM t_train GROUP BY item_id) USING (item_id), t_mu",
    "t_cen": "SELECT t.user_id, t.item_id, rating, rating - m AS residual FROM t_train t JOIN (SELECT user_id, avg(rating) AS m FROM t_train GROUP BY user_id) USING (user_id)",
    # content
    "t_items": "SELECT p_partkey AS item_id, p_name AS title, replace(p_name, ' ', '|') || '|' || p_type || '|' || p_brand AS genres FROM part",
    "t_hot": "SELECT DISTINCT item_id, feature, 1.0::DOUBLE AS x FROM (SELECT item_id, unnest(string_split(genres, '|')) AS feature FROM t_items) WHERE feature <> ''",
    "t_feat": "SELECT item_id, feature, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS x FROM t_hot",
    "t_vec": "SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings",
    "t_tag": "SELECT item_id, CAST(generate_subscripts(vector, 1) - 1 AS INT) AS feature, unnest(vector) AS x FROM t_vec",
    "t_tagn": "SELECT item_id, feature, CASE WHEN s > 0 THEN x / sqrt(s) ELSE 0.0::DOUBLE END AS x FROM (SELECT *, sum(x * x) OVER (PARTITION BY item_id) AS s FROM t_tag)",
    "t_prof": "SELECT user_id, feature, CASE WHEN s > 0 THEN w / sqrt(s) ELSE 0.0::DOUBLE END AS w FROM (SELECT *, sum(w * w) OVER (PARTITION BY user_id) AS s FROM (SELECT user_id, feature, round(sum(residual * x), 9) AS w FROM t_cen JOIN t_feat USING (item_id) GROUP BY user_id, feature))",
    "t_tagprof": "SELECT user_id, feature, CASE WHEN s > 0 THEN w / sqrt(s) ELSE 0.0::DOUBLE END AS w FROM (SELECT *, sum(w * w) OVER (PARTITION BY user_id) AS s FROM (SELECT user_id, feature, round(sum(residual * x), 9) AS w FROM t_cen JOIN t_tagn USING (item_id) GROUP BY user_id, feature))",
    "t_pairs": "SELECT DISTINCT user_id, item_id FROM (SELECT user_id, item_id FROM t_val UNION ALL SELECT user_id, item_id FROM t_test)",
    "t_cos": "SELECT p.user_id, p.item_id, round(coalesce(s, 0), 9) AS cosine FROM t_pairs p LEFT JOIN (SELECT q.user_id, q.item_id, sum(w * x) AS s FROM t_pairs q JOIN t_feat USING (item_id) JOIN t_prof USING (user_id, feature) GROUP BY ALL) USING (user_id, item_id)",
    "t_beta": "SELECT round(CASE WHEN b > 2.220446049250313e-16 THEN greatest(0.0, a / b) ELSE 0.0 END, 9) AS beta FROM (SELECT sum(cosine * (rating - mean)) AS a, sum(cosine * cosine) AS b FROM t_val JOIN t_cos USING (user_id, item_id) JOIN t_um USING (user_id))",
    "t_content": "SELECT user_id, item_id, round(mean + beta * cosine, 9) AS prediction FROM t_cos JOIN t_um USING (user_id), t_beta",
    "t_tcos": "SELECT p.user_id, p.item_id, round(coalesce(s, 0), 9) AS cosine FROM t_pairs p LEFT JOIN (SELECT q.user_id, q.item_id, sum(w * x) AS s FROM t_pairs q JOIN t_tagn USING (item_id) JOIN t_tagprof USING (user_id, feature) GROUP BY ALL) USING (user_id, item_id)",
    "t_tbeta": "SELECT round(CASE WHEN b > 2.220446049250313e-16 THEN greatest(0.0, a / b) ELSE 0.0 END, 9) AS beta FROM (SELECT sum(cosine * (rating - mean)) AS a, sum(cosine * cosine) AS b FROM t_val JOIN t_tcos USING (user_id, item_id) JOIN t_um USING (user_id))",
    "t_tcontent": "SELECT user_id, item_id, round(mean + beta * cosine, 9) AS prediction FROM t_tcos JOIN t_um USING (user_id), t_tbeta",
    # neighbours
    "t_ipairs": f"SELECT a.item_id AS a, b.item_id AS b, sum(a.residual * b.residual) AS xy, sum(a.residual * a.residual) AS xx, sum(b.residual * b.residual) AS yy, count(*) AS n FROM t_cen a JOIN t_cen b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL HAVING count(*) >= {P.min_common}",
    "t_isim": f"SELECT a AS item_id, b AS nbr_id, sim, n AS support FROM (SELECT *, round(CASE WHEN xx > 0 AND yy > 0 THEN xy / sqrt(xx * yy) * (n / (n + {P.shrinkage}::DOUBLE)) ELSE 0.0 END, 9) AS sim FROM t_ipairs) WHERE sim <> 0",
    "t_itop": f"SELECT item_id, nbr_id, sim, support FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY abs(sim) DESC, nbr_id) AS nth FROM t_isim) WHERE nth <= {P.item_neighbors}",
    "t_upairs": f"SELECT a.user_id AS a, b.user_id AS b, sum(a.residual * b.residual) AS xy, sum(a.residual * a.residual) AS xx, sum(b.residual * b.residual) AS yy, count(*) AS n FROM t_cen a JOIN t_cen b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY ALL HAVING count(*) >= {P.min_common}",
    "t_usim": f"SELECT a AS user_id, b AS nbr_id, sim, n AS n_common FROM (SELECT *, round(CASE WHEN xx > 0 AND yy > 0 THEN xy / (sqrt(xx) * sqrt(yy)) * (n / (n + {P.shrinkage}::DOUBLE)) ELSE 0.0 END, 9) AS sim FROM t_upairs) WHERE sim <> 0",
    "t_unbr_all": "SELECT p.user_id, p.item_id, s.nbr_id, sim, residual, row_number() OVER (PARTITION BY p.user_id, p.item_id ORDER BY abs(sim) DESC, s.nbr_id) AS nth FROM t_pairs p JOIN t_cen c ON c.item_id = p.item_id JOIN t_usim s ON s.user_id = p.user_id AND s.nbr_id = c.user_id",
    "t_unbr": f"SELECT user_id, item_id, nbr_id, sim, residual FROM t_unbr_all WHERE nth <= {P.user_neighbors}",
    "t_uknn": "SELECT p.user_id, p.item_id, round(CASE WHEN b > 0 THEN u.mean + a / b ELSE i.mean END, 9) AS prediction, CAST(CASE WHEN b > 0 THEN c ELSE 0 END AS INT) AS n_neighbors FROM t_pairs p JOIN t_um u USING (user_id) JOIN t_im i USING (item_id) LEFT JOIN (SELECT user_id, item_id, sum(sim * residual) AS a, sum(abs(sim)) AS b, count(*) AS c FROM t_unbr GROUP BY ALL) USING (user_id, item_id)",
    "t_inbr": "SELECT p.user_id, p.item_id, s.nbr_id, sim, residual FROM t_pairs p JOIN t_itop s USING (item_id) JOIN t_cen c ON c.user_id = p.user_id AND c.item_id = s.nbr_id",
    "t_iknn": "SELECT p.user_id, p.item_id, round(CASE WHEN b > 0 THEN u.mean + a / b ELSE i.mean END, 9) AS prediction, CAST(CASE WHEN b > 0 THEN c ELSE 0 END AS INT) AS n_neighbors FROM t_pairs p JOIN t_um u USING (user_id) JOIN t_im i USING (item_id) LEFT JOIN (SELECT user_id, item_id, sum(sim * residual) AS a, sum(abs(sim)) AS b, count(*) AS c FROM t_inbr GROUP BY ALL) USING (user_id, item_id)",
    # candidates
    "t_known": "SELECT DISTINCT user_id, item_id FROM t_split",
    "t_cat": "SELECT DISTINCT item_id FROM t_train",
    "t_rel": f"SELECT * FROM t_test WHERE rating >= {P.relevance} AND item_id IN (SELECT item_id FROM t_cat)",
    "t_relval": f"SELECT * FROM t_val WHERE rating >= {P.relevance} AND item_id IN (SELECT item_id FROM t_cat)",
    "t_room": "SELECT user_id, (SELECT count(*) FROM t_cat) - count(*) AS room FROM t_known WHERE item_id IN (SELECT item_id FROM t_cat) GROUP BY user_id",
    "t_ru": f"SELECT user_id, item_id AS positive FROM t_rel JOIN t_room USING (user_id) WHERE room >= {P.candidates - 1} ORDER BY md5(concat_ws('|', '{P.test_seed}', CAST(user_id AS VARCHAR), 'u')), user_id LIMIT {P.ranking_users}",
    "t_ruval": f"SELECT user_id, item_id AS positive FROM t_relval JOIN t_room USING (user_id) WHERE room >= {P.candidates - 1} ORDER BY md5(concat_ws('|', '{P.validation_seed}', CAST(user_id AS VARCHAR), 'u')), user_id LIMIT {P.ranking_users}",
    "t_free": "SELECT u.user_id, c.item_id FROM t_ru u CROSS JOIN t_cat c ANTI JOIN t_known k ON k.user_id = u.user_id AND k.item_id = c.item_id",
    "t_freeval": "SELECT u.user_id, c.item_id FROM t_ruval u CROSS JOIN t_cat c ANTI JOIN t_known k ON k.user_id = u.user_id AND k.item_id = c.item_id",
    "t_neg": f"SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', '{P.test_seed}', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR))), item_id) AS nth FROM t_free) WHERE nth <= {P.candidates - 1}",
    "t_negval": f"SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', '{P.validation_seed}', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR))), item_id) AS nth FROM t_freeval) WHERE nth <= {P.candidates - 1}",
    "t_cand": f"SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', '{P.test_seed}', 'p', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR))), item_id) - 1 AS INT) AS pos, item_id, is_positive FROM (SELECT user_id, positive AS item_id, true AS is_positive FROM t_ru UNION ALL SELECT user_id, item_id, false FROM t_neg)",
    "t_candval": f"SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', '{P.validation_seed}', 'p', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR))), item_id) - 1 AS INT) AS pos, item_id, is_positive FROM (SELECT user_id, positive AS item_id, true AS is_positive FROM t_ruval UNION ALL SELECT user_id, item_id, false FROM t_negval)",
    # factors
    "t_size": "SELECT count(*) AS size FROM embeddings",
    "t_mfu": "SELECT user_id, vector AS factors, round(mean - mu, 9) AS bias FROM (SELECT DISTINCT user_id, user_id % size AS place FROM t_train, t_size) JOIN t_vec v ON v.item_id = place JOIN t_um USING (user_id), t_mu",
    "t_mfi": "SELECT t.item_id, vector AS factors, round(mean - mu, 9) AS bias FROM (SELECT DISTINCT item_id, item_id % size AS place FROM t_train, t_size) t JOIN t_vec v ON v.item_id = place JOIN t_im m ON m.item_id = t.item_id, t_mu",
    "t_bpu": "SELECT user_id, vector AS factors FROM (SELECT DISTINCT user_id, (user_id + 1) % size AS place FROM t_train, t_size) JOIN t_vec v ON v.item_id = place",
    "t_bpi": "SELECT t.item_id, vector AS factors FROM (SELECT DISTINCT item_id, (item_id + 3) % size AS place FROM t_train, t_size) t JOIN t_vec v ON v.item_id = place",
    "t_targets": "SELECT DISTINCT user_id, item_id FROM (SELECT user_id, item_id FROM t_pairs UNION ALL SELECT user_id, item_id FROM t_cand UNION ALL SELECT user_id, item_id FROM t_candval)",
    "t_mf": "SELECT p.user_id, p.item_id, round(mu + coalesce(u.bias, 0) + coalesce(i.bias, 0) + coalesce(list_dot_product(u.factors, i.factors), 0), 9) AS prediction FROM t_targets p LEFT JOIN t_mfu u ON u.user_id = p.user_id LEFT JOIN t_mfi i ON i.item_id = p.item_id, t_mu",
    "t_bpr": "SELECT p.user_id, p.item_id, round(coalesce(list_dot_product(u.factors, i.factors), 0), 9) AS score FROM t_targets p LEFT JOIN t_bpu u ON u.user_id = p.user_id LEFT JOIN t_bpi i ON i.item_id = p.item_id",
    "t_affine0": "SELECT avg(score) AS mx, avg(rating) AS my, covar_pop(score, rating) AS xy, var_pop(score) AS xx, count(*) AS n FROM t_val JOIN t_bpr USING (user_id, item_id)",
    "t_affine1": "SELECT round(CASE WHEN xx * n > 2.220446049250313e-16 THEN greatest(0.0, xy / xx) ELSE 0.0 END, 9) AS slope, mx, my FROM t_affine0",
    "t_affine": "SELECT slope, round(my - slope * mx, 9) AS intercept FROM t_affine1",
    "t_bprr": "SELECT user_id, item_id, round(slope * score + intercept, 9) AS prediction FROM t_bpr, t_affine",
    # ensembles
    "t_comp": "SELECT user_id, item_id, c.prediction AS content, k.prediction AS knn, n_neighbors FROM t_tcontent c JOIN t_uknn k USING (user_id, item_id)",
    "t_grid": "SELECT k / 10.0::DOUBLE AS lam FROM range(11) r(k)",
    "t_asweep": "SELECT alpha, round(sqrt(avg((p - rating) * (p - rating))), 9) AS rmse FROM (SELECT lam AS alpha, rating, CASE WHEN n_neighbors > 0 THEN lam * content + (1 - lam) * knn ELSE content END AS p FROM t_val JOIN t_comp USING (user_id, item_id), t_grid) GROUP BY alpha",
    "t_alpha": "SELECT alpha, rmse FROM t_asweep ORDER BY rmse, alpha LIMIT 1",
    "t_hyb": "SELECT user_id, item_id, round(CASE WHEN n_neighbors > 0 THEN alpha * content + (1 - alpha) * knn ELSE content END, 9) AS prediction, n_neighbors FROM t_comp, t_alpha",
    "t_rsweep": "SELECT lam, round(sqrt(avg((p - rating) * (p - rating))), 9) AS rmse FROM (SELECT lam, rating, lam * m.prediction + (1 - lam) * b.prediction AS p FROM t_val JOIN t_mf m USING (user_id, item_id) JOIN t_bprr b USING (user_id, item_id), t_grid) GROUP BY lam",
    "t_rlam": "SELECT lam, rmse FROM t_rsweep ORDER BY rmse, lam DESC LIMIT 1",
    "t_mfbpr": "SELECT user_id, item_id, round(lam * m.prediction + (1 - lam) * b.prediction, 9) AS prediction FROM t_mf m JOIN t_bprr b USING (user_id, item_id), t_rlam",
    "t_two": "SELECT c.user_id, pos, c.item_id, is_positive, m.prediction AS a, b.score AS b FROM t_cand c JOIN t_mf m USING (user_id, item_id) JOIN t_bpr b USING (user_id, item_id)",
    "t_twoval": "SELECT c.user_id, pos, c.item_id, is_positive, m.prediction AS a, b.score AS b FROM t_candval c JOIN t_mf m USING (user_id, item_id) JOIN t_bpr b USING (user_id, item_id)",
    "t_z": "SELECT *, round(CASE WHEN sa < 1e-12 THEN 0.0 ELSE (a - ma) / sa END, 9) AS za, round(CASE WHEN sb < 1e-12 THEN 0.0 ELSE (b - mb) / sb END, 9) AS zb FROM (SELECT *, avg(a) OVER w AS ma, stddev_pop(a) OVER w AS sa, avg(b) OVER w AS mb, stddev_pop(b) OVER w AS sb FROM t_two WINDOW w AS (PARTITION BY user_id))",
    "t_zval": "SELECT *, round(CASE WHEN sa < 1e-12 THEN 0.0 ELSE (a - ma) / sa END, 9) AS za, round(CASE WHEN sb < 1e-12 THEN 0.0 ELSE (b - mb) / sb END, 9) AS zb FROM (SELECT *, avg(a) OVER w AS ma, stddev_pop(a) OVER w AS sa, avg(b) OVER w AS mb, stddev_pop(b) OVER w AS sb FROM t_twoval WINDOW w AS (PARTITION BY user_id))",
    "t_ksweep_s": "SELECT lam, user_id, pos, is_positive, round(lam * za + (1 - lam) * zb, 9) AS score FROM t_zval, t_grid",
    "t_ksweep_r": ranks("t_ksweep_s", "lam,"),
    "t_ksweep": f"SELECT lam, hit_rate, ndcg, mrr FROM ({ranking('t_ksweep_r', 'lam, ')})",
    "t_klam": "SELECT lam, ndcg FROM t_ksweep ORDER BY ndcg DESC, lam DESC LIMIT 1",
    "t_fused": "SELECT user_id, pos, item_id, is_positive, za, zb, lam, round(lam * za + (1 - lam) * zb, 9) AS score FROM t_z, (SELECT lam FROM t_klam)",
    # scores of the candidates
    "t_s_global_mean": f"SELECT *, CAST('0x' || substr(md5(concat_ws('|', '{P.baseline_seed}', CAST(user_id AS VARCHAR), CAST(pos AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS score FROM t_cand",
    "t_s_mf": "SELECT c.*, prediction AS score FROM t_cand c JOIN t_mf USING (user_id, item_id)",
    "t_s_bpr": "SELECT c.*, score FROM t_cand c JOIN t_bpr USING (user_id, item_id)",
    "t_s_mf_bpr": "SELECT user_id, pos, item_id, is_positive, score FROM t_fused",
    "t_bpos": f"SELECT user_id, item_id FROM t_train WHERE rating >= {P.relevance}",
    "t_place": "SELECT item_id AS negative, row_number() OVER (ORDER BY item_id) - 1 AS place FROM t_cat",
    "t_bdrawn": f"SELECT user_id, item_id, arg_min(negative, draw) AS negative FROM (SELECT user_id, item_id, draw, negative FROM (SELECT user_id, item_id, draw, CAST('0x' || substr(md5(concat_ws('|', '{P.seed}', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR), CAST(draw AS VARCHAR))), 1, 12) AS BIGINT) % (SELECT count(*) FROM t_cat) AS place FROM t_bpos, range(8) r(draw)) JOIN t_place USING (place) ANTI JOIN (SELECT user_id, item_id AS negative FROM t_train) USING (user_id, negative)) GROUP BY ALL",
    "t_bleft": "SELECT DISTINCT user_id, item_id FROM t_bpos ANTI JOIN t_bdrawn USING (user_id, item_id)",
    "t_bneg": f"SELECT user_id, item_id, negative FROM t_bdrawn UNION ALL SELECT l.user_id, l.item_id, arg_min(c.item_id, struct_pack(h := md5(concat_ws('|', '{P.seed}', CAST(l.user_id AS VARCHAR), CAST(l.item_id AS VARCHAR), 'f', CAST(c.item_id AS VARCHAR))), i := c.item_id)) AS negative FROM t_bleft l CROSS JOIN t_cat c ANTI JOIN t_train k ON k.user_id = l.user_id AND k.item_id = c.item_id GROUP BY ALL",
    "t_tri": "SELECT n.user_id, n.item_id, n.negative, round(round(list_dot_product(u.factors, i.factors), 9) - round(list_dot_product(u.factors, j.factors), 9), 9) AS margin FROM t_bneg n JOIN t_bpu u ON u.user_id = n.user_id JOIN t_bpi i ON i.item_id = n.item_id JOIN t_bpi j ON j.item_id = n.negative",
}
#: The candidates of the stages that the pairs above do not have: the same parts over the candidates instead.
for kind, deps in {
    "content": ("t_cos", "t_content"),
    "dense": ("t_tcos", "t_tcontent"),
    "uknn": ("t_unbr_all", "t_unbr", "t_uknn"),
    "iknn": ("t_inbr", "t_iknn"),
}.items():
    for name in deps:
        text = re.sub(r"\bt_pairs\b", "t_cpairs", PARTS[name])
        for other in deps:
            text = re.sub(rf"\b{other}\b", f"{other}_c", text)
        PARTS[f"{name}_c"] = text
PARTS["t_cpairs"] = "SELECT DISTINCT user_id, item_id FROM t_cand"
PARTS["t_s_genre_content"] = "SELECT c.*, prediction AS score FROM t_cand c JOIN t_content_c USING (user_id, item_id)"
PARTS["t_s_genome_content"] = "SELECT c.*, prediction AS score FROM t_cand c JOIN t_tcontent_c USING (user_id, item_id)"
PARTS["t_s_user_knn"] = "SELECT c.*, prediction AS score FROM t_cand c JOIN t_uknn_c USING (user_id, item_id)"
PARTS["t_s_movie_knn"] = "SELECT c.*, prediction AS score FROM t_cand c JOIN t_iknn_c USING (user_id, item_id)"
PARTS["t_s_hybrid"] = "SELECT c.*, round(alpha * t.prediction + (1 - alpha) * k.prediction, 9) AS score FROM t_cand c JOIN t_tcontent_c t USING (user_id, item_id) JOIN t_uknn_c k USING (user_id, item_id), t_alpha"
PARTS["t_s_hybrid_n"] = "SELECT c.*, round(CASE WHEN n_neighbors > 0 THEN alpha * t.prediction + (1 - alpha) * k.prediction ELSE t.prediction END, 9) AS score FROM t_cand c JOIN t_tcontent_c t USING (user_id, item_id) JOIN t_uknn_c k USING (user_id, item_id), t_alpha"
for stage in ("global_mean", "genre_content", "genome_content", "user_knn", "movie_knn", "mf", "bpr", "hybrid", "mf_bpr"):
    PARTS[f"t_r_{stage}"] = ranks(f"t_s_{stage}")
#: Test predictions of each stage.
PREDICTIONS = {
    "global_mean": "(SELECT t.*, mu AS prediction FROM t_test t, t_mu)",
    "genre_content": "(SELECT t.*, prediction FROM t_test t JOIN t_content USING (user_id, item_id))",
    "genome_content": "(SELECT t.*, prediction FROM t_test t JOIN t_tcontent USING (user_id, item_id))",
    "user_knn": "(SELECT t.*, prediction FROM t_test t JOIN t_uknn USING (user_id, item_id))",
    "movie_knn": "(SELECT t.*, prediction FROM t_test t JOIN t_iknn USING (user_id, item_id))",
    "mf": "(SELECT t.*, prediction FROM t_test t JOIN t_mf USING (user_id, item_id))",
    "bpr": "(SELECT t.*, prediction FROM t_test t JOIN t_bprr USING (user_id, item_id))",
    "hybrid": "(SELECT t.*, prediction FROM t_test t JOIN t_hyb USING (user_id, item_id))",
    "mf_bpr": "(SELECT t.*, prediction FROM t_test t JOIN t_mfbpr USING (user_id, item_id))",
}


def build(final: str, changed: dict[str, str] | None = None) -> str:
    """``final`` with the parts that it needs, in order."""
    parts = PARTS | (changed or {})
    done: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bt_\w+", text)):
            if name in parts and name not in done:
                need(parts[name])
                done.append(name)

    need(final)
    return ("WITH " + ",\n".join(f"{n} AS ({parts[n]})" for n in done) + "\n" if done else "") + final


#: On items with dense vectors alone.
CATALOG = {"t_kept": f"SELECT * FROM t_incat WHERE user_id IN (SELECT user_id FROM t_incat GROUP BY user_id HAVING count(*) >= {P.min_history})", "t_incat": "SELECT * FROM t_raw WHERE item_id IN (SELECT vec_id FROM embeddings)"}
