"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from engramlake.llm import mixing, sharding


def shares(level: list[str], weight: str, budget: str) -> str:
    """Equal fill by weight of one level of the tree, as a chain of common table expressions."""
    name, parents = level[-1], level[:-1]
    family = f"PARTITION BY {', '.join(parents)}" if parents else ""
    on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in parents) or "TRUE"
    keys = ", ".join(level)
    return f"""
    {name}_cap AS (SELECT {keys}, CAST(sum(tokens) * {mixing.MAX_EPOCHS} AS DOUBLE) AS cap FROM leaves GROUP BY {keys}),
    {name}_n AS (SELECT {', '.join(f'n.{c}' for c in level)}, cap, {weight} AS weight, p.budget FROM {name}_cap n JOIN {budget} p ON {on}),
    {name}_o AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM {name}_n WINDOW o AS ({family} ORDER BY cap / weight, {name} NULLS FIRST)),
    {name}_f AS (SELECT *, (budget - before) * weight >= cap * rest AND weight > 0 AS filled FROM {name}_o),
    {name}_b AS (SELECT {keys}, CASE WHEN filled THEN cap
      WHEN sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({family}) > 0
      THEN (budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({family})) * weight / sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({family})
      ELSE 0 END AS budget FROM {name}_f)"""


def weight_case(weights: dict[tuple[str, ...], float], tree: tuple[str, ...], level: int) -> str:
    cases = [
        "WHEN " + " AND ".join(f"n.{c} = '{v}'" for c, v in zip(tree, path, strict=False)) + f" THEN {w}"
        for path, w in weights.items() if len(path) == level + 1
    ]
    return f"CASE {' '.join(cases)} ELSE 1.0 END" if cases else "1.0"


def mixing_sql(weights: dict[tuple[str, ...], float], tree: tuple[str, ...], docs: str = "documents", columns: str = "d.doc_id, d.domain, d.lang, d.source, d.n AS n_tokens, e.epoch") -> str:
    words = r"[^\x20\x09-\x0D]+"
    levels, budget = [], "root"
    for k in range(len(tree)):
        levels.append(shares(list(tree[: k + 1]), weight_case(weights, tree, k), budget))
        budget = f"{tree[k]}_b"
    keys = ", ".join(tree)
    same = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in tree)
    return f"""
    WITH numbered AS (SELECT *, TRY_CAST(nullif(regexp_extract(source, '^src([0-9]{{1,6}})$', 1), '') AS INT) AS number FROM {docs}),
    tagged AS (SELECT * EXCLUDE (number), CASE WHEN number < 5 THEN 'web' WHEN number < 10 THEN 'books' WHEN number < 15 THEN 'code'
      WHEN number >= 15 THEN 'forums' ELSE 'other' END AS domain, coalesce(len(regexp_extract_all(text, '{words}')), 0) AS n FROM numbered),
    leaves AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS tokens FROM tagged GROUP BY {keys}),
    root AS (SELECT CAST(sum(tokens) AS DOUBLE) AS budget FROM leaves), {','.join(levels)},
    whole AS (SELECT l.*, CAST(floor(b.budget + 1e-6) AS BIGINT) AS budget FROM leaves l JOIN {budget} b ON {same('l', 'b')}),
    plan AS (SELECT *, CASE WHEN tokens > 0 THEN least(budget // tokens, {mixing.MAX_EPOCHS}) ELSE 0 END AS epochs FROM whole),
    joined AS (SELECT t.*, p.tokens, p.budget, p.epochs FROM tagged t JOIN plan p ON {same('t', 'p')}),
    keyed AS (SELECT *, md5('{mixing.SEED}:' || epochs || ':' || doc_id) || ':' || doc_id AS k,
      CASE WHEN epochs < {mixing.MAX_EPOCHS} THEN budget - epochs * tokens ELSE 0 END AS rest FROM joined),
    d AS (SELECT *, epochs + CASE WHEN rest > 0 AND sum(n) OVER (PARTITION BY {keys} ORDER BY k) <= rest THEN 1 ELSE 0 END AS times FROM keyed)
    SELECT {columns} FROM d, LATERAL (SELECT CAST(unnest(range(CAST(d.times AS BIGINT))) AS INT) AS epoch) e"""


def sharding_sql(limit: int = sharding.LIMIT) -> str:
    bits, text = sharding.BITS, sharding.TEXT_BITS
    return f"""
    WITH hashed AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
      CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {sharding.ID_BITS // 4}) AS BIGINT) * {1 << text}
      + CAST('0x' || substr(md5(coalesce(text, '')), 1, {text // 4}) AS BIGINT) AS h FROM documents),
    nodes AS (SELECT *, h >> ({bits} - depth) AS node FROM hashed, (SELECT CAST(unnest(range({bits + 1})) AS INT) AS depth)),
    fits AS (SELECT depth, node FROM nodes GROUP BY depth, node HAVING sum(n_bytes) <= {limit} OR min(h) = max(h)),
    depths AS (SELECT h, min(depth) AS depth FROM nodes JOIN fits USING (depth, node) GROUP BY h)
    SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({bits} - depth)), depth, '0') END AS shard, depth, CAST(n_bytes AS BIGINT) AS n_bytes
    FROM hashed JOIN depths USING (h)"""


INFILL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
e AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM g"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS r, id AS negative_id, positive_score, score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, score AS negative_score FROM n WHERE r <= 10"""
