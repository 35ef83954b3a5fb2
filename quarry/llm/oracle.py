"""DuckDB SQL for the queries that it can express.

op3, op5, op7, op8, op9, op10: trained models, XXH64 and Viterbi have no SQL form; tests hold them against brute force.
"""

from quarry.llm.license_scan import BASE, NOTICES
from quarry.llm.secret_scan import BASE as SECRET_BASE
from quarry.llm.secret_scan import KINDS
from quarry.llm.url_filter import ALPHABET, RULES

OP1 = """
WITH RECURSIVE raw AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM raw WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.vec_id = l.a WHERE r.root < l.b),
comp AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT c.vec_id, (SELECT count(*) FROM links WHERE a = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM comp c"""

_templates = ", ".join(
    f"({t}, '{label}', {str(t < len(BASE)).lower()}, {k}, {len(w)}, '{w[k]}', '{w[k + 1]}')" for t, (phrase, label) in enumerate([*BASE, *NOTICES]) for w in [phrase.split()] for k in range(len(w) - 1)
)
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2 = f"""
WITH t(template, label, is_base, t_pos, t_words, t1, t2) AS (VALUES {_templates}),
d AS (SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT id, unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2, unnest(range(0, len(w) - 1)) AS pos FROM d WHERE len(w) > 1),
h AS (SELECT id, template, label, is_base, t_words, pos - t_pos AS diagonal, t_pos, pos FROM g JOIN t ON w1 = t1 AND w2 = t2),
x AS (SELECT DISTINCT id, template, diagonal FROM h),
y AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY id, template ORDER BY diagonal) AS gap FROM x),
z AS (SELECT *, sum(CASE WHEN template < {len(BASE)} OR gap IS NULL OR gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY id, template ORDER BY diagonal) AS island FROM y),
s AS (SELECT h.id, h.template, any_value(label) AS label, any_value(is_base) AS is_base, any_value(t_words) AS t_words, island, count(DISTINCT t_pos) AS n, min(pos) AS lo, max(pos) AS hi, min(h.diagonal) AS start FROM h JOIN z ON h.id = z.id AND h.template = z.template AND h.diagonal = z.diagonal GROUP BY h.id, h.template, island),
f AS (SELECT *, n / (t_words - 1) AS share FROM s WHERE CASE WHEN is_base THEN n = t_words - 1 ELSE n / (t_words - 1) >= 0.8 AND hi + 2 - lo <= 1.5 * t_words END),
a AS (SELECT id, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share)::DOUBLE AS score FROM f GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN a USING (id)"""

_host = "coalesce(" + _LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)") + ", '')"
_path = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
_fits = [(h + p, v, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
_rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, _, c in _fits) + " END"
_given = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for _, v, c in _fits) + " END"
_A = len(ALPHABET)
OP4 = f"""
WITH p AS (SELECT row_number() OVER () AS id, page_id, {_host} AS host, {_path} AS path, ('0x' || substr(md5(coalesce(url, '')), 1, 4))::INT % 5 AS fold,
  '^^' || regexp_replace(regexp_replace({_LOWER.format("coalesce(url, '')")}, '[0-9]', '0', 'g'), '[^a-z0/.:?=&#_\\-]', '~', 'g') || '$' AS s FROM pages),
r AS (SELECT *, {_rule} AS rule, {_given} AS given FROM p),
g AS (SELECT id, given, fold, s[i:i + 2] AS gram FROM (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM r)),
c AS (SELECT given AS class, gram, count(*)::DOUBLE AS n FROM g WHERE given IS NOT NULL AND fold > 0 GROUP BY 1, 2),
need AS (SELECT DISTINCT k.class, gram, gram[1:1] AS a, gram[2:2] AS b, gram[3:3] AS c FROM g, (VALUES ('allow'), ('block')) k(class)),
c3 AS (SELECT class, gram[1:2] AS ab, sum(n) AS s3, count(*)::DOUBLE AS k3 FROM c GROUP BY 1, 2),
n2 AS (SELECT class, gram[2:2] AS b, gram[3:3] AS c, sum(n) AS n2 FROM c GROUP BY ALL),
c2 AS (SELECT class, b, sum(n2) AS s2, count(*)::DOUBLE AS k2 FROM n2 GROUP BY 1, 2),
n1 AS (SELECT class, c, sum(n2) AS n1 FROM n2 GROUP BY 1, 2), c1 AS (SELECT class, sum(n1) AS s1 FROM n1 GROUP BY 1),
m AS (SELECT need.class, need.gram, (coalesce(n1, 0) + 1) / (coalesce(s1, 0) + {_A}) AS p1, n2, s2, k2, n, s3, k3 FROM need LEFT JOIN n1 ON need.class = n1.class AND need.c = n1.c LEFT JOIN c1 ON need.class = c1.class
  LEFT JOIN n2 ON need.class = n2.class AND need.b = n2.b AND need.c = n2.c LEFT JOIN c2 ON need.class = c2.class AND need.b = c2.b LEFT JOIN c ON need.class = c.class AND need.gram = c.gram LEFT JOIN c3 ON need.class = c3.class AND need.a || need.b = c3.ab),
m2 AS (SELECT *, CASE WHEN s2 > 0 THEN (coalesce(n2, 0) + k2 * p1) / (s2 + k2) ELSE p1 END AS p2 FROM m), m3 AS (SELECT *, CASE WHEN s3 > 0 THEN (coalesce(n, 0) + k3 * p2) / (s3 + k3) ELSE p2 END AS p3 FROM m2),
ratio AS (SELECT gram, sum(CASE class WHEN 'allow' THEN ln(p3) ELSE -ln(p3) END) AS ratio FROM m3 GROUP BY 1),
s AS (SELECT id, avg(ratio) AS ratio FROM g JOIN ratio USING (gram) GROUP BY 1),
bins AS (SELECT greatest(-1000, least(1000, floor(ratio * 100)))::INT AS bin, count(*) FILTER (given = 'allow') AS good, count(*) FILTER (given = 'block') AS bad FROM s JOIN r USING (id) WHERE given IS NOT NULL AND fold = 0 GROUP BY 1),
b AS (SELECT bin, lead(bin) OVER (ORDER BY bin DESC) AS below, sum(good) OVER (ORDER BY bin DESC) / sum(good) OVER () AS hits, 1 - sum(bad) OVER (ORDER BY bin DESC) / sum(bad) OVER () AS kept, sum(good) OVER () AS goods, sum(bad) OVER () AS bads FROM bins),
t AS (SELECT coalesce((SELECT CASE WHEN below IS NULL THEN bin ELSE (bin + below + 1) / 2.0 END / 100.0 FROM b WHERE goods > 0 AND bads > 0 ORDER BY round(hits + kept, 9) DESC, abs(bin), bin LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN ratio >= least THEN 'allow' ELSE 'block' END) AS verdict FROM r JOIN s USING (id), t"""


def _any_case(pattern: str) -> str:
    """RE2's (?i) also folds non-ASCII letters; spelt out, only A-Z and a-z match."""
    if not pattern.startswith("(?i)"):
        return pattern
    out, inside, i, body = "", False, 0, pattern[4:]
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            out, i = out + body[i : i + (4 if body[i + 1] == "x" else 2)], i + (4 if body[i + 1] == "x" else 2)
            continue
        inside = ch == "[" or (inside and ch != "]")
        out += f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() and not inside else ch
        i += 1
    return out.replace("[a-z]+", "[A-Za-z]+") if "jdbc" in pattern else out


def _hits(kind: str, order: int) -> str:
    q = _any_case(KINDS[kind][0]).replace("'", "''")
    keep = f"length(regexp_extract(hit, '{q}', 2)) >= 6" if kind == "assign" else "true"
    return f"""SELECT id, {order} AS kind, stop - length(hit) AS start, stop FROM (SELECT id, nth, hit, sum(length(skip) + length(hit)) OVER (PARTITION BY id ORDER BY nth) AS stop FROM (
      SELECT id, unnest(regexp_extract_all(text, '{q}')) AS hit, unnest(list_resize(string_split_regex(text, '{q}'), len(regexp_extract_all(text, '{q}')))) AS skip, unnest(range(0, len(regexp_extract_all(text, '{q}')))) AS nth FROM d)) WHERE {keep}"""


_kinds = list(KINDS)
_names = "[" + ", ".join(f"'{k}'" for k in _kinds) + "]"
_roles = "[" + ", ".join(f"'{KINDS[k][1]}'" for k in _kinds) + "]"
_n_base = len(SECRET_BASE)
_span = f"({_names}[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT)"
OP6 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
h AS MATERIALIZED ({" UNION ALL ".join(_hits(k, i) for i, k in enumerate(_kinds))}),
s AS (SELECT * FROM h a WHERE kind < {_n_base} OR EXISTS (SELECT 1 FROM h b WHERE a.id = b.id AND {_roles}[a.kind + 1] <> {_roles}[b.kind + 1] AND b.start <= a.stop + 200 AND b.stop >= a.start - 200)),
a AS (SELECT id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg({_span}, ',' ORDER BY start, kind) FILTER (kind < {_n_base}) AS base, string_agg({_span}, ',' ORDER BY start, kind) AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (id)"""

ORACLE_SQL = {"op1_embedding_near_dedup": OP1, "op2_license_scan": OP2, "op4_url_filter": OP4, "op6_secret_scan": OP6}
