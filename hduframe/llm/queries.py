"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import chat_format, decontaminate, kneser_ney, lm_score, near_dedup, quality_rules, secrets, sentencepiece_codec, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(docs, tokenizer("piece_bpe_32k.model")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.format_chats(chat_format.with_probe(spark, table(spark, sf_dir, "conversations"))))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(spark, table(spark, sf_dir, "documents")).drop("text_key")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.lm_scores(spark, table(spark, sf_dir, "documents"))
    # decimals that don't depend on the order in which a document's terms are added up
    return scores.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_files": op4_token_files,
    "op5_chat_format": op5_chat_format,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_quality_rules": op8_quality_rules,
    "op9_stupid_backoff": op9_stupid_backoff,
    "op10_secret_scan": op10_secret_scan,
}

# ---- SQL ----------------------------------------------------------------------------------------------------------


def _escaped(column: str) -> str:
    """The template's escapes as nested replacements."""
    out = f"replace({column}, '\\', '\\b')"
    for k, s in enumerate(chat_format.INSTRUCT.controls()):
        out = f"replace({out}, '{s}', '\\{k};')"
    return out


def _role_chars() -> str:
    t = chat_format.INSTRUCT
    cases = " ".join(f"WHEN '{name}' THEN {len(r.open) + len(r.close)}" for name, r in t.roles.items())
    return f"CASE role {cases} ELSE {len(t.other.open) + 1 + len(t.other.close)} + length({_escaped('role')}) END"


CHATS = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '{chat_format.PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{chat_format.PROBE}'),
 n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, lag(role, 1, '') OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
 m AS (SELECT *, CASE role WHEN 'system' THEN k = 1 WHEN 'user' THEN k = 1 OR before IN ('system', 'assistant') WHEN 'assistant' THEN before = 'user' ELSE false END AS fits FROM n),
 g AS (SELECT conv_id, any_value(n) AS n_turns, min(CASE WHEN NOT fits THEN k - 1 END) AS first_bad, max_by(role, k) AS last_role, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
  coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss, sum(length({_escaped('text')}) + {_role_chars()}) AS chars FROM m GROUP BY conv_id)
 SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars, first_bad IS NULL AND last_role = 'assistant' AS valid,
  CASE WHEN first_bad IS NOT NULL THEN first_bad WHEN last_role <> 'assistant' THEN n_turns ELSE -1 END::BIGINT AS bad_turn FROM g"""

_SIGNALS = {"symbols_per_word": "n_symbols / n_words", "chars_per_word": "word_chars / n_words", "repeated_words": "n_repeat_words / n_words", "dup_lines": "n_dup_lines::DOUBLE"}


def _quality_sql() -> str:
    each = quality_rules.GRIDS
    a, delta = quality_rules.ALPHA, quality_rules.DELTA
    grid = ", ".join(f"('{r}', {j}, {c})" for r, cuts in each.items() for j, c in enumerate(cuts))
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {x}" for r, x in _SIGNALS.items()) + " END"
    over = " OR ".join(f"coalesce({x} > (SELECT cutoff FROM best WHERE rule = '{r}' AND stratum IS NOT DISTINCT FROM f.lang), false)" for r, x in _SIGNALS.items())
    return rf"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
 i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
 d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM i),
 r AS (SELECT doc_id, sum(step)::BIGINT AS n_repeat_words FROM (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS step FROM d WHERE n > 1) GROUP BY doc_id),
 l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM w),
 f AS (SELECT w.doc_id, lang, w.t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN r ON w.doc_id = r.doc_id),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
 good AS (SELECT DISTINCT lang, t, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
 grid AS (SELECT * FROM (VALUES {grid}) g(rule, step, cutoff)),
 k AS (SELECT lang AS stratum, rule, step, cutoff, count(*) AS n, sum(({value} > cutoff)::INT) AS k FROM good, grid GROUP BY lang, rule, step, cutoff),
 p AS (SELECT stratum, rule, step, cutoff, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({a}) + (n - j) * ln(1 - {a}))) FROM (SELECT unnest(range(0, k::BIGINT + 1)) AS j)) AS tail, (SELECT count(DISTINCT stratum) + max((stratum IS NULL)::INT) FROM k) AS strata FROM k),
 e AS (SELECT *, min(CASE WHEN NOT tail <= {delta} / (strata * {len(each)}) THEN step END) OVER (PARTITION BY stratum, rule) AS fails FROM p),
 best AS (SELECT stratum, rule, cutoff FROM e WHERE step = coalesce(fails - 1, (SELECT max(g.step) FROM grid g WHERE g.rule = e.rule)))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept, lang FROM b f"""


def _secrets_sql() -> str:
    """Places of matches from the lengths of the texts between them."""
    parts = []
    for k, r in enumerate(secrets.RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.base} AS base, {r.least} AS least, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {r.group}) AS g, string_split_regex(text, {p}) AS s FROM t WHERE regexp_matches(text, {p})")
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 a AS ({' UNION ALL '.join(parts)}),
 b AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a),
 c AS (SELECT doc_id, k, kind, base, length(m[i]) AS n, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM b WHERE length(g[i]) >= least),
 d AS (SELECT doc_id, k, a, kind, base, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS span FROM c),
 e AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY a, k) FILTER (base) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM d GROUP BY doc_id)
 SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN e ON t.doc_id = e.doc_id"""


NEAR = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, md5(coalesce(text, '')) AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS fp FROM s GROUP BY r),
 p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
 l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
 e AS (SELECT x AS u, y AS v FROM l UNION SELECT y, x FROM l),
 t(node, reach) AS (SELECT r, r FROM w UNION SELECT t.node, e.v FROM t JOIN e ON t.reach = e.u),
 g AS (SELECT node, min(reach) AS g FROM t GROUP BY node),
 o AS (SELECT w.r, doc_id, coalesce(n, 0) AS n_shingles, fp, min(doc_id) OVER (PARTITION BY g) AS component_id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, k) = 1 AS kept FROM w LEFT JOIN n ON w.r = n.r JOIN g ON g.node = w.r)
 SELECT doc_id, n_shingles, component_id, kept, CASE WHEN fp IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY fp) END AS rep FROM o"""

BACKOFF = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 t AS (SELECT doc_id, i, w[i] AS a, w[i - 1] AS b, w[i - 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
 c1 AS (SELECT a, count(*) AS n1 FROM t GROUP BY a), c2 AS (SELECT a, b, count(*) AS n2 FROM t WHERE i >= 2 GROUP BY a, b), c3 AS (SELECT a, b, c, count(*) AS n3 FROM t WHERE i >= 3 GROUP BY a, b, c),
 u AS (SELECT doc_id, i, a, b, c, n1 / (SELECT count(*) FROM t) AS s1 FROM t JOIN c1 USING (a)),
 v AS (SELECT u.*, CASE WHEN i < 2 THEN s1 WHEN n2 >= {lm_score.LEAST} THEN n2 / p.n1 ELSE {lm_score.BACKOFF} * s1 END AS s2 FROM u LEFT JOIN c2 ON u.a = c2.a AND u.b = c2.b LEFT JOIN c1 p ON u.b = p.a),
 x AS (SELECT v.doc_id, CASE WHEN i < 3 THEN s2 WHEN n3 >= {lm_score.LEAST} THEN n3 / q.n2 ELSE {lm_score.BACKOFF} * s2 END AS s3 FROM v LEFT JOIN c3 ON v.a = c3.a AND v.b = c3.b AND v.c = c3.c LEFT JOIN c2 q ON v.b = q.a AND v.c = q.b),
 y AS (SELECT doc_id, sum(ln(s3)) AS score FROM x GROUP BY doc_id)
 SELECT w.doc_id, len(w)::BIGINT AS n_words, round(coalesce(score, 0), 4) AS score, round(score / len(w), 6) AS mean_score FROM w LEFT JOIN y ON w.doc_id = y.doc_id"""

ORACLE_SQL: dict[str, str] = {"op6_minhash_dedup": NEAR, "op9_stupid_backoff": BACKOFF, "op10_secret_scan": _secrets_sql(), "op5_chat_format": CHATS, "op8_quality_rules": _quality_sql()}
