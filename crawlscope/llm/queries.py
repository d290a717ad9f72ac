"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from crawlscope.llm import bpe, decontamination, grid_join, jaccard, language, mixing, phrases, quality, ranked_search, secrets, tokens, toxicity, url_filter
from crawlscope.llm.common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    @wraps(fn)
    def run(spark, d):
        ship(spark)
        return fn(spark, d)

    QUERIES[fn.__name__] = run
    return run


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_output(spark, d):
    return tokens.token_output(table(spark, d, "documents"), tokenizer_path())


@query
def op2_markov_secrets(spark, d):
    return secrets.report(secrets.scan(table(spark, d, "documents")))


@query
def op3_line_crf_quality(spark, d):
    return quality.judge(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op4_source_mix(spark, d):
    return mixing.mix_report(table(spark, d, "documents"))


# Rules of the query: host, path, action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op5_url_cascade(spark, d):
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, action)")
    return url_filter.judge_urls(table(spark, d, "pages"), rules)


ORACLES["op5_url_cascade"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
rules(h, p, action) AS (VALUES {", ".join(map(str, URL_RULES))}),
fits AS (
  SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
  FROM urls JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM urls u LEFT JOIN fits f USING (page_id, host, path)
"""


@query
def op6_toxicity(spark, d):
    return toxicity.judge(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op7_ngram_jaccard_join(spark, d):
    return jaccard.jaccard_join(table(spark, d, "documents"), n=4, num=85, den=100)


@query
def op8_template_decontamination(spark, d):
    return decontamination.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("text_hash")


@query
def op9_epsilon_grid_join(spark, d):
    return grid_join.grid_join(table(spark, d, "embeddings"), least=0.98)


ORACLES["op9_epsilon_grid_join"] = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.a LEFT JOIN degree ON e.vec_id = degree.a
"""


@query
def op10_string_kernel_language(spark, d):
    return language.identify(table(spark, d, "documents"))


@query
def op11_block_max_search(spark, d):
    index = ranked_search.build_index(table(spark, d, "documents"))
    return ranked_search.search(spark, index, table(spark, d, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op11_block_max_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT row, doc_id, len(terms)::BIGINT AS n, terms FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
postings AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term),
items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (
  SELECT item_id, row, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op12_quotient_phrases(spark, d):
    return phrases.phrases(table(spark, d, "documents"))


_LANGS = "coalesce(lang, 'und')"
ORACLES["op12_quotient_phrases"] = f"""
WITH pieces AS (
  SELECT {_LANGS} AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
spread AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
triples AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM spread),
runs AS (
  SELECT lang, x AS p, 1 AS size, NULL AS p1, NULL AS r1, NULL AS p2, NULL AS r2, count(*)::BIGINT AS f FROM triples GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y, 2, x, y, NULL, NULL, count(*) FROM triples WHERE y IS NOT NULL GROUP BY lang, x, y
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, 3, x, y || ' ' || z, x || ' ' || y, z, count(*) FROM triples WHERE z IS NOT NULL GROUP BY lang, x, y, z),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM runs WHERE size = 1 GROUP BY lang),
often AS (SELECT * FROM runs WHERE f >= 10),
halves AS (
  SELECT lang, p, size, f, 1 AS k, p1 AS lp, r1 AS rp FROM often WHERE size > 1 UNION ALL SELECT lang, p, size, f, 2, p2, r2 FROM often WHERE size = 3),
cuts AS (
  SELECT h.lang, h.p, h.size, h.f AS a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * h.f * h.f) // (l.f::HUGEINT * r.f) AS score
  FROM halves h JOIN often l ON l.lang = h.lang AND l.p = h.lp JOIN often r ON r.lang = h.lang AND r.p = h.rp),
best AS (SELECT lang, p, size, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS b FROM cuts GROUP BY ALL),
inside AS (
  SELECT lang, p, max(f) AS longer FROM (
    SELECT lang, p2 AS p, f FROM often WHERE size = 3 UNION ALL SELECT lang, r1, f FROM often WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inside ON best.lang = inside.lang AND best.p = inside.p WHERE longer IS NULL OR 100 * longer < 50 * a OR size = 3),
ranked AS (
  SELECT lang, p AS phrase, a, b.l AS l, b.r AS r, b.score::BIGINT AS score,
    row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, p)::INTEGER AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op13_bpe_round_trip(spark, d):
    path = tokenizer_path("word_bpe_49k.json")
    return bpe.digests(bpe.decode(bpe.encode(table(spark, d, "documents"), path), path))
