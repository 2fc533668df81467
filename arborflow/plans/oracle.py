"""DuckDB SQL for the deterministic queries of the catalogue."""

from __future__ import annotations

from ..functions import text as T
from .catalogue import STAGES, TREE_SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _linear(v: str, n: int, turn: int = 0) -> str:
    """Row i of the catalogue's weights times v."""
    return f"list_sum(list_transform(range({n}), lambda j: {v}[j + 1] * ((i * 7 + j * 3 + {turn}) % 11 - 5) / 8.0))"


def _uniform(key: str) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967296.0"


V = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS l, label FROM embeddings"
TREE = f"""p AS ({TREE_SQL}),
n AS (SELECT row_number() OVER (ORDER BY len(path), path) - 1 AS node_id, len(path) AS depth, path, CASE WHEN len(path) = 0 THEN 0 ELSE path[-1] + 10 * (len(path) - 1) + 1 END AS tree_index FROM p),
a AS (SELECT x.node_id, y.node_id AS anc_id, y.depth AS d FROM n x JOIN n y ON x.path[1:y.depth] = y.path AND y.depth <= x.depth),
leaf AS (SELECT node_id FROM n x WHERE NOT EXISTS (SELECT 1 FROM n y WHERE y.depth = x.depth + 1 AND y.path[1:x.depth] = x.path)),
w AS (SELECT node_id, list(anc_id ORDER BY d) AS nodes FROM a JOIN leaf USING (node_id) GROUP BY node_id),
t AS (SELECT row_number() OVER (ORDER BY node_id DESC) - 1 AS path_id, nodes || list_transform(range((SELECT max(depth) FROM n) + 1 - len(nodes)), lambda x: CAST(-1 AS BIGINT)) AS nodes FROM w)"""
WORDS = r"""ws AS (SELECT doc_id AS request_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS g FROM documents),
x AS (SELECT request_id, unnest(range(len(g))) AS pos, unnest(list_transform(g, lambda s: CAST(length(s) AS BIGINT))) AS token_id FROM ws)"""
SOFT = "list_transform(l, lambda x: exp({s} * x / 0.7 - {s} * list_max(l) / 0.7))"


def _soft(scale: int) -> str:
    return f"""e AS (SELECT vec_id, {SOFT.format(s=scale)} AS e FROM ({V})),
s AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"""


ENTROPY = "-list_sum(list_transform(p, lambda x: x * ln(x + 1e-5)))"
CAND = f"""WITH {TREE},
v AS ({V}),
f AS (SELECT vec_id // 6 AS request_id, list(CASE WHEN vec_id % 6 = 0 THEN [list_position(l, list_max(l)) - 1] ELSE list_transform(list_sort(list_transform(range(64), lambda i: [-l[i + 1], i]))[1:10], lambda s: CAST(s[2] AS BIGINT)) END ORDER BY vec_id) AS heads FROM v GROUP BY 1 HAVING count(*) = 6),
g AS (SELECT request_id, flatten(heads) AS flat FROM f),
k AS (SELECT request_id, list(flat[tree_index + 1] ORDER BY node_id) AS tokens FROM g, n GROUP BY request_id),
c AS (SELECT request_id, path_id, nodes, list_transform(nodes, lambda x: CASE WHEN x < 0 THEN 0 ELSE tokens[x + 1] END) AS cand FROM k, t)"""
STEP = """, size AS (SELECT count(*) AS n FROM embeddings), lastn AS (SELECT max(node_id) AS z FROM n),
d AS (SELECT request_id, path_id, cand, i, cand[i + 2] AS tok, CASE WHEN nodes[i + 1] < 0 THEN z ELSE nodes[i + 1] END AS node_id FROM (SELECT *, unnest(range(len(cand) - 1)) AS i FROM c), lastn),
j AS (SELECT d.*, v.l FROM d, size, v WHERE v.vec_id = (d.request_id + 31 * d.node_id) % size.n)"""
GREEDY = CAND + STEP + """,
m AS (SELECT request_id, path_id, i, cand, tok = list_position(l, list_max(l)) - 1 AS ok FROM j),
r AS (SELECT request_id, path_id, cand, coalesce(min(i) FILTER (NOT ok), max(i) + 1) AS acc FROM m GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY acc DESC, path_id) AS o FROM r)"""
TYPICAL = CAND + STEP + f""",
q AS (SELECT request_id, path_id, i, cand, tok, {SOFT.format(s=1)} AS e FROM j),
u AS (SELECT request_id, path_id, i, cand, tok, list_transform(e, lambda x: x / list_sum(e)) AS p FROM q),
m AS (SELECT request_id, path_id, i, cand, p[tok + 1] AS pt, p[tok + 1] > least(0.09, exp({ENTROPY.replace("-list", "-1 * list")} * -1) * 0.3) AS ok FROM u),
r0 AS (SELECT request_id, path_id, cand, coalesce(min(i) FILTER (NOT ok), max(i) + 1) AS acc FROM m GROUP BY ALL),
r AS (SELECT r0.request_id, r0.path_id, r0.cand, acc, coalesce(sum(ln(pt)) FILTER (i < acc), 0) AS lk FROM r0 JOIN m USING (request_id, path_id) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY acc DESC, round(lk, 9) DESC, path_id) AS o FROM r)"""
KV = "k AS (SELECT l_orderkey AS request_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS line, l_partkey AS value FROM lineitem)"
NAMES = "nm AS (SELECT 'model.layers.' || i || '.' || part || '.weight' AS tensor_name, i AS layer FROM range(32) r(i), (VALUES ('self_attn.q_proj'), ('mlp.up_proj')) p(part) UNION ALL SELECT x, NULL FROM (VALUES ('model.embed_tokens.weight'), ('model.norm.weight'), ('lm_head.weight')) o(x))"
PTS = "SELECT doc_id, unnest(range(len(s))) AS idx, unnest(s) AS point FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)"

ORACLE = {
    "skeleton_prompt": f"SELECT conv_id, turn, {_q(T.SKELETON_HEAD)} || text || {_q(T.SKELETON_TAIL)} AS prompt FROM conversations WHERE role = 'user'",
    "outline_points": PTS,
    "point_prompts": f"SELECT doc_id, idx, (idx + 1) || '. [/INST]' || point AS prompt FROM ({PTS})",
    "shared_prefix": f"SELECT a.conv_id, {_q(T.PREFIX_PARTS[0])} || a.text || {_q(T.PREFIX_PARTS[1])} || b.text || {_q(T.PREFIX_PARTS[2])} AS prompt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1",
    "skeleton_normalised": r"SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '\n', chr(10) || '  ', 'g'), '\n$', ''), chr(10)), lambda s: regexp_replace(s, '^\s+', '')), chr(10)) AS skeleton FROM documents",
    "tree_dispatch": "SELECT * FROM (VALUES ('vicuna-7b-v1.3', 'vicuna_7b_stage2'), ('vicuna_13b', 'vicuna_13b_stage2'), ('vicuna-33b', 'vicuna_33b_stage2'), ('zephyr-7b', 'zephyr_stage2'), ('other', 'mc_sim_7b_63'), ('vicuna-1b', 'mc_sim_7b_63')) x(model, tree)",
    "slice_sequences": f"WITH {WORDS}, y AS (SELECT *, ntile(5) OVER (PARTITION BY request_id ORDER BY pos) - 1 AS slice_id FROM x) SELECT request_id, slice_id, count(*) AS n, min(pos) AS first, CAST(sum(token_id) AS BIGINT) AS tokens FROM y GROUP BY ALL",
    "stage_range_join": f"WITH {NAMES}, st AS (SELECT rank, CAST(sum(k) OVER (ORDER BY rank) AS BIGINT) - k AS l, CAST(sum(k) OVER (ORDER BY rank) AS BIGINT) AS r FROM (VALUES {', '.join(map(str, STAGES))}) v(rank, k)) SELECT CAST(rank AS BIGINT) AS rank, tensor_name, CASE WHEN layer IS NULL THEN tensor_name ELSE replace(tensor_name, 'layers.' || layer || '.', 'layers.' || (layer - l) || '.') END AS stage_name FROM nm JOIN st ON layer IS NULL OR (layer >= l AND layer < r)",
    "layer_split": f"WITH {NAMES} SELECT tensor_name, coalesce(layer, -1) AS layer FROM nm",
    "manifest_last_wins": "WITH m AS (SELECT 't.' || (o_custkey % 1000) AS tensor_name, 'file-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS file FROM orders), u AS (SELECT *, 0 AS turn FROM m WHERE tensor_name < 't.5' UNION ALL SELECT *, 1 FROM m WHERE tensor_name LIKE '%7%') SELECT tensor_name, file FROM (SELECT *, row_number() OVER (PARTITION BY tensor_name ORDER BY turn DESC, file DESC) AS o FROM u) WHERE o = 1",
    "tree_nodes": f"WITH {TREE} SELECT n.node_id, coalesce(m.node_id, -1) AS parent_id, n.depth, n.tree_index, array_to_string(n.path, ',') AS path FROM n LEFT JOIN n m ON n.depth > 0 AND m.path = n.path[1:n.depth - 1]",
    "tree_ancestors": f"WITH {TREE} SELECT node_id, anc_id FROM a",
    "tree_paths": f"WITH {TREE} SELECT path_id, array_to_string(nodes, ',') AS nodes FROM t",
    "depth_histogram": f"WITH {TREE} SELECT depth, count(*) AS n_nodes FROM n WHERE depth > 0 GROUP BY depth",
    "tree_mask_semijoin": f"WITH {TREE} SELECT x.node_id, y.node_id AS anc_id FROM n x, n y WHERE EXISTS (SELECT 1 FROM a WHERE a.node_id = x.node_id AND a.anc_id = y.node_id)",
    "topk_per_head": f"SELECT vec_id, o - 1 AS r, i AS token FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS o FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(l) AS x FROM ({V}))) WHERE o <= 10",
    "argmax_token": f"SELECT vec_id, CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS token FROM ({V})",
    "softmax": f"WITH {_soft(1)} SELECT vec_id, unnest(range(64)) AS i, round(unnest(p), 6) AS p FROM s",
    "entropy_threshold": f"WITH {_soft(1)} SELECT vec_id, round({ENTROPY}, 6) AS entropy, round(least(0.09, exp(-({ENTROPY})) * 0.3), 6) AS threshold FROM s",
    "typical_mask": f"WITH {_soft(10)} SELECT vec_id, array_to_string(list_filter(range(64), lambda i: p[i + 1] >= least(0.09, exp(-({ENTROPY})) * 0.3)), ',') AS kept FROM s",
    "nucleus_mask": f"WITH {_soft(10)}, x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(p) AS p FROM s), y AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS UNBOUNDED PRECEDING) - p AS before FROM x) SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS kept FROM y WHERE before <= 0.8 GROUP BY vec_id",
    "candidates_cart": f"{CAND} SELECT request_id, path_id, array_to_string(cand, ',') AS candidate FROM c",
    "accept_greedy": f"{GREEDY} SELECT request_id, path_id AS best, acc AS accept_length, array_to_string(cand, ',') AS candidate FROM b WHERE o = 1",
    "accept_typical": f"{TYPICAL} SELECT request_id, path_id AS best, acc AS accept_length, array_to_string(cand, ',') AS candidate FROM b WHERE o = 1",
    "accept_message": f"{GREEDY} SELECT b.request_id, acc + 1 AS n, array_to_string(list_transform(nodes[1:acc + 1], lambda x: x + request_id), ',') AS \"select\", array_to_string(cand[1:acc + 1], ',') AS ids FROM b JOIN t USING (path_id) WHERE o = 1",
    "kv_append": f"WITH {KV} SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY line) - 1 AS pos, value FROM k",
    "kv_compact": f"WITH {KV}, h AS (SELECT request_id FROM k WHERE line = 4) SELECT k.request_id, CASE WHEN h.request_id IS NULL OR line = 1 THEN line - 1 WHEN line = 2 THEN 1 WHEN line = 4 THEN 2 END AS pos, value FROM k LEFT JOIN h ON h.request_id = k.request_id WHERE h.request_id IS NULL OR line IN (1, 2, 4)",
    "shared_prefix_union": f"WITH {KV}, br AS (SELECT DISTINCT request_id, line % 2 AS branch_id FROM k WHERE line > 2), z AS (SELECT request_id, least(max(line), 2) AS n FROM k GROUP BY 1) SELECT k.request_id, branch_id, line - 1 AS pos, value FROM k JOIN br ON k.request_id = br.request_id WHERE line <= 2 UNION ALL SELECT k.request_id, line % 2, n + (line - 3) // 2, value FROM k JOIN z ON z.request_id = k.request_id WHERE line > 2",
    "round_robin": f"WITH {KV}, s AS (SELECT request_id, line, row_number() OVER (PARTITION BY request_id ORDER BY line) - 1 AS seat, count(*) OVER (PARTITION BY request_id) AS n FROM k) SELECT request_id, step, line AS branch_id FROM s, range(10) r(step) WHERE step % n = seat",
    "beam_reorder": f"WITH {KV} SELECT b.beam, request_id, value FROM k JOIN (VALUES (CAST(0 AS BIGINT), 1), (1, 1), (2, 0)) b(beam, source) ON line - 1 = source",
    "eos_stop": f"WITH {WORDS} SELECT request_id, coalesce(bool_or(pos >= 5 AND token_id = 11), false) AS stops, greatest(count(*) - 2, 0) AS n_trimmed FROM x GROUP BY request_id",
    "causal_attention": f"WITH v AS ({V}), s AS (SELECT a.vec_id, b.l AS bl, list_sum(list_transform(range(24), lambda i: a.l[i + 1] * b.l[i + 25])) / sqrt(24.0) AS s FROM v a JOIN v b ON a.vec_id // 8 = b.vec_id // 8 AND b.vec_id <= a.vec_id), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM s), o AS (SELECT vec_id, i, sum(e * bl[i + 49]) / sum(e) AS x FROM e, range(16) r(i) GROUP BY ALL) SELECT vec_id // 8 AS request_id, vec_id % 8 AS pos, i, round(x, 6) AS x FROM o",
    "gqa_repeat": "SELECT (vec_id % 8) * 4 + r AS head, vec_id % 8 AS kv_head, vec_id // 8 AS pos, vec_id AS v FROM embeddings, range(4) x(r)",
    "rmsnorm": f"SELECT vec_id, unnest(range(64)) AS i, round(unnest(list_transform(l, lambda x: x / sqrt(list_sum(list_transform(l, lambda y: y * y)) / 64 + 1e-6))), 6) AS x FROM ({V})",
    "rope": f"SELECT vec_id, unnest(range(64)) AS i, round(unnest(list_transform(range(64), lambda i: l[i + 1] * cos((vec_id % 17) * pow(10000.0, -2.0 * (i % 32) / 64)) + (CASE WHEN i < 32 THEN -l[i + 33] ELSE l[i - 31] END) * sin((vec_id % 17) * pow(10000.0, -2.0 * (i % 32) / 64)))), 6) AS x FROM ({V})",
    "silu": f"SELECT vec_id, unnest(range(64)) AS i, round(unnest(list_transform(l, lambda x: x / (1 + exp(-x)))), 6) AS x FROM ({V})",
    "cross_entropy": f"SELECT vec_id, round(list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) - l[label + 1], 6) AS loss FROM ({V})",
    "shifted_loss": f"WITH v AS ({V}), y AS (SELECT vec_id, l, lead(label) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS nx FROM v) SELECT vec_id // 10 AS request_id, round(avg(list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) - l[nx + 1]), 6) AS loss FROM y WHERE nx IS NOT NULL GROUP BY 1",
    "mse": "SELECT label, round(avg(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x - label) * (x - label))) / len(embedding)), 6) AS loss FROM embeddings GROUP BY label",
    "bce_logits": "SELECT vec_id, round(greatest(x, 0.0) - x * y + ln(1 + exp(-abs(x))), 6) AS loss FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(label % 2 AS DOUBLE) AS y FROM embeddings)",
    "last_nonpad_pool": f"WITH {WORDS} SELECT request_id, coalesce(min(pos) FILTER (token_id = 12) - 1, -1) AS pos FROM x GROUP BY request_id",
    "position_ids_from_mask": f"WITH {WORDS} SELECT request_id, pos, CASE WHEN token_id > 3 THEN CAST(sum(CASE WHEN token_id > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY pos) AS BIGINT) - 1 ELSE 1 END AS position_id FROM x",
    "unpad": f"WITH {WORDS}, y AS (SELECT request_id, count(*) FILTER (token_id > 3) AS n, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY pos) FILTER (token_id > 3) AS kept FROM x GROUP BY 1) SELECT request_id, n, coalesce(kept, '') AS kept FROM y",
    "padded_causal_visible": f"WITH {WORDS} SELECT request_id, pos, CAST(sum(CASE WHEN token_id > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY pos) AS BIGINT) AS visible FROM x",
    "sliced_linear": f"SELECT vec_id, unnest(range(4)) AS i, round(unnest(list_transform(range(4), lambda i: list_sum(list_transform(range(64), lambda j: l[j + 1] * ((i * 7 + j * 3) % 11 - 5) / 8.0)))), 6) AS x FROM ({V})",
    "rope_linear": f"SELECT vec_id, unnest(range(64)) AS i, round(unnest(list_transform(range(64), lambda i: l[i + 1] * cos(((vec_id % 17) / 4.0) * pow(10000.0, -2.0 * (i % 32) / 64)) + (CASE WHEN i < 32 THEN -l[i + 33] ELSE l[i - 31] END) * sin(((vec_id % 17) / 4.0) * pow(10000.0, -2.0 * (i % 32) / 64)))), 6) AS x FROM ({V})",
    "rope_ntk": f"SELECT vec_id, unnest(range(64)) AS i, round(unnest(list_transform(range(64), lambda i: l[i + 1] * cos((vec_id % 17) * pow((10000.0 * pow(3.0, 64.0 / 62.0)), -2.0 * (i % 32) / 64)) + (CASE WHEN i < 32 THEN -l[i + 33] ELSE l[i - 31] END) * sin((vec_id % 17) * pow((10000.0 * pow(3.0, 64.0 / 62.0)), -2.0 * (i % 32) / 64)))), 6) AS x FROM ({V})",
    "loss_by_problem_type": f"""WITH v AS ({V}) SELECT vec_id, 'regression' AS kind, round(list_sum(list_transform(l, lambda x: (x - label) * (x - label))) / 64, 6) AS loss FROM v
UNION ALL SELECT vec_id, 'single_label_classification', round(list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) - l[label + 1], 6) FROM v
UNION ALL SELECT vec_id, 'multi_label_classification', round(list_sum(list_transform(range(64), lambda i: greatest(l[i + 1], 0.0) - l[i + 1] * ((label + i) % 2) + ln(1 + exp(-abs(l[i + 1]))))) / 64, 6) FROM v""",
    "stage_checkpoint": f"WITH {NAMES} SELECT tensor_name, CASE WHEN layer IS NULL THEN tensor_name ELSE replace(tensor_name, 'layers.' || layer || '.', 'layers.' || (layer - 17) || '.') END AS stage_name FROM nm WHERE layer IS NULL OR (layer >= 17 AND layer < 26)",
    "prompt_source": "SELECT conv_id AS request_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "gated_layer": f"WITH a AS (SELECT vec_id, list_transform(range(8), lambda i: {_linear('l', 64)}) AS g, list_transform(range(8), lambda i: {_linear('l', 64, 4)}) AS u FROM ({V})), h AS (SELECT vec_id, list_transform(range(8), lambda i: g[i + 1] / (1 + exp(-g[i + 1])) * u[i + 1]) AS h FROM a) SELECT vec_id, unnest(range(4)) AS i, round(unnest(list_transform(range(4), lambda i: {_linear('h', 8)})), 6) AS x FROM h",
    "residual_head": f"WITH a AS (SELECT vec_id, l, list_transform(range(64), lambda i: {_linear('l', 64)} + 0.5) AS g FROM ({V})), h AS (SELECT vec_id, list_transform(range(64), lambda i: l[i + 1] + g[i + 1] / (1 + exp(-g[i + 1]))) AS h FROM a) SELECT vec_id, unnest(range(4)) AS i, round(unnest(list_transform(range(4), lambda i: {_linear('h', 64, 2)})), 6) AS x FROM h",
    "cumulative_lengths": f"WITH {WORDS}, y AS (SELECT request_id, count(*) FILTER (token_id > 3) AS length FROM x GROUP BY request_id) SELECT request_id // 100 AS batch, request_id, CAST(sum(length) OVER (PARTITION BY request_id // 100 ORDER BY request_id) - length AS BIGINT) AS first, length FROM y",
    "token_embedding": f"WITH {WORDS}, v AS (SELECT vec_id, list_sum(l) AS s FROM ({V})) SELECT request_id, count(*) AS n, round(sum(s), 4) AS x FROM x JOIN v ON token_id = vec_id GROUP BY request_id",
    "generation_inputs": f"WITH {WORDS}, y AS (SELECT request_id, arg_max(token_id, pos) AS token_id, count(*) FILTER (token_id > 3) AS n FROM x GROUP BY request_id) SELECT request_id, token_id, CASE WHEN token_id > 3 THEN n - 1 ELSE 1 END AS position_id FROM y",
    "last_position": f"WITH {WORDS} SELECT request_id, arg_max(token_id, pos) AS token_id FROM x GROUP BY request_id",
    "continuation": f"WITH {WORDS} SELECT request_id, coalesce(string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY pos) FILTER (pos >= 5), '') AS ids FROM x GROUP BY request_id",
    "pad_path": f"WITH {TREE} SELECT node_id, array_to_string(path || list_transform(range(6 - len(path)), lambda x: CAST(-2 AS BIGINT)), ',') AS path FROM n",
    "update_inputs": f"{GREEDY}, y AS (SELECT b.request_id, acc, cand, CASE WHEN nodes[acc + 1] < 0 THEN z ELSE nodes[acc + 1] END AS node_id FROM b JOIN t USING (path_id), lastn WHERE o = 1) SELECT request_id, array_to_string([request_id, request_id + 1] || cand[1:acc + 1], ',') AS ids, acc + 8 AS new_token, CAST(list_position(v.l, list_max(v.l)) - 1 AS BIGINT) AS next FROM y, size, v WHERE v.vec_id = (y.request_id + 31 * y.node_id) % size.n",
    "kv_allocate": "SELECT o_orderkey AS request_id, layer, kind, CAST(0 AS BIGINT) AS length, CAST(2048 AS BIGINT) AS room FROM orders, range(2) l(layer), (VALUES ('key'), ('value')) k(kind)",
    "kv_valid": f"WITH {KV}, m AS (SELECT *, max(line) OVER (PARTITION BY request_id) AS top FROM k) SELECT request_id, line - 1 AS pos, value FROM m WHERE line < top",
    "kv_reset": f"WITH {KV}, m AS (SELECT *, max(line) OVER (PARTITION BY request_id) AS top FROM k) SELECT request_id, line - 1 AS pos, value FROM m WHERE top < 4",
    "role_pruning": f"WITH {NAMES}, st AS (SELECT rank, CAST(sum(k) OVER (ORDER BY rank) AS BIGINT) - k AS l, CAST(sum(k) OVER (ORDER BY rank) AS BIGINT) AS r FROM (VALUES {', '.join(f'(CAST({a} AS BIGINT), {b})' for a, b in STAGES)}) s(rank, k)) SELECT rank, tensor_name FROM nm, st WHERE (layer >= l AND layer < r) OR (tensor_name = 'model.embed_tokens.weight' AND rank = 0) OR (tensor_name IN ('model.norm.weight', 'lm_head.weight') AND rank = {len(STAGES) - 1})",
    "queue_places": "SELECT user_id AS branch_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events",
    "config_source": "SELECT CAST(4096 AS BIGINT) AS hidden_size, '8,8,8,8' AS stages, CAST(0.7 AS DOUBLE) AS temperature, 'typical' AS sampling",
    "index_source": f"WITH {NAMES} SELECT tensor_name, 'part-' || length(tensor_name) AS file FROM nm",
    "checkpoint_union": "SELECT 't.' || vec_id AS tensor_name, CAST(len(embedding) AS BIGINT) AS n FROM embeddings UNION ALL SELECT 'medusa_head.t.' || vec_id, len(embedding) + 1 FROM embeddings WHERE label = 3",
    "mask_dump": f"WITH {TREE} SELECT node_id, anc_id FROM a",
    "memory_figures": "SELECT CAST(sum(len(embedding) * 4) AS BIGINT) AS n_bytes FROM embeddings",
    "answer_output": "SELECT conv_id AS request_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role || ': ' || coalesce(text, '')) AS text FROM conversations GROUP BY conv_id",
    "stage_files": f"SELECT rank, 'temp_vicuna_7b_world_{len(STAGES)}_rank_' || rank || '/stage.bin' AS path FROM range({len(STAGES)}) r(rank)",
    "encode_decode": "SELECT doc_id, text AS decoded FROM documents",
    "encode_parts": f"SELECT a.conv_id, idx, CAST(1 AS BIGINT) AS n_start, {_q(T.PREFIX_PARTS[0])} || a.text || {_q(T.PREFIX_PARTS[1])} || b.text || {_q(T.PREFIX_PARTS[2])} || (idx + 1) || {_q(T.POINT_MARK)} || line AS prompt FROM conversations a JOIN (SELECT conv_id, text, unnest(range(len(s))) AS idx, unnest(s) AS line FROM (SELECT conv_id, text, string_split(text, chr(10)) AS s FROM conversations WHERE turn = 1)) b USING (conv_id) WHERE a.turn = 0",
    "sample_token": f"""WITH {_soft(1)}, h AS (SELECT vec_id, p, {ENTROPY} AS h, {_uniform("vec_id || ',1'")} AS u FROM s),
x AS (SELECT vec_id, u, least(0.09, exp(-h) * 0.3) AS th, unnest(range(64)) AS i, unnest(p) AS p FROM h),
y AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
w AS (SELECT vec_id, u, i, CASE WHEN before <= 0.8 THEN p ELSE 0 END AS a, CASE WHEN p < th THEN 0 ELSE p END AS b FROM y),
c AS (SELECT vec_id, u, sum(a) OVER g AS ca, sum(b) OVER g AS cb, sum(a) OVER (PARTITION BY vec_id) AS ta, sum(b) OVER (PARTITION BY vec_id) AS tb FROM w WINDOW g AS (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT vec_id, least(count(*) FILTER (ca <= u * ta), 63) AS nucleus, least(count(*) FILTER (cb <= u * tb), 63) AS typical FROM c GROUP BY vec_id""",
    "accept_nucleus": CAND + STEP + f""",
q AS (SELECT request_id, path_id, i, tok, {SOFT.format(s=1)} AS e, {_uniform("request_id || ',' || path_id || ',' || i || ',0'")} AS u FROM j),
s AS (SELECT request_id, path_id, i, tok, u, list_transform(e, lambda x: x / list_sum(e)) AS p FROM q),
x AS (SELECT request_id, path_id, i, tok, u, unnest(range(64)) AS k, unnest(p) AS p FROM s),
y AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY request_id, path_id, i ORDER BY p DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
kept AS (SELECT request_id, path_id, i, tok, u, k, CASE WHEN before <= 0.8 THEN p ELSE 0 END AS p FROM y),
runs AS (SELECT request_id, path_id, i, tok, u, sum(p) OVER (PARTITION BY request_id, path_id, i ORDER BY k ROWS UNBOUNDED PRECEDING) AS run, sum(p) OVER (PARTITION BY request_id, path_id, i) AS total FROM kept),
m AS (SELECT request_id, path_id, i, least(count(*) FILTER (run <= u * total), 63) = any_value(tok) AS ok FROM runs GROUP BY ALL),
r AS (SELECT request_id, path_id, coalesce(min(i) FILTER (NOT ok), max(i) + 1) AS acc FROM m GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY acc DESC, path_id) AS o FROM r)
SELECT request_id, path_id AS best, acc AS accept_length FROM b WHERE o = 1""",
}
