"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, media, mixing, pii, quality, secrets, simhash, urls, wordpiece
from .common import read

#: Targets of the mixing query: between natural and uniform for sources, fixed shares for the languages, natural topics with more long texts.
TARGETS = {"source": 0.5, "lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}, "topic": {"note": 0.1, "article": 0.5, "longread": 0.4}}
BUDGET, MIX_SEED = 0.5, 7
SQL_ROUNDS = 30


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), words=4, max_bits=4)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), TARGETS, BUDGET, MIX_SEED)
    return mixed.select("doc_id", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), "kept", *(F.round(f"{k}_{a}", 6).alias(f"{k}_{a}") for a in mixing.AXES for k in ("target", "expected")))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find(read(spark, sf_dir, "documents"), owner=F.col("source")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media_digest(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_mixing, op3_nearest, op4_bpe, op5_secrets, op6_quality, op7_urls, op8_media, op9_token_counts, op10_pii)}


def _mixing_sql() -> str:
    """The mixing query with its raking rounds written out, as many as settle all that is rounded."""

    def target(axis: str) -> str:
        wanted = TARGETS[axis]
        if isinstance(wanted, dict):
            cases = " ".join(f"WHEN {axis} = '{k}' THEN {v}" for k, v in wanted.items())
            return f"CASE {cases} ELSE s / sum(s) OVER () END"
        return f"pow(s / sum(s) OVER (), {wanted})"

    parts = [
        r"""counted AS (SELECT doc_id, coalesce(source, chr(0)) AS source, coalesce(lang, chr(0)) AS lang,
  greatest(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+')), 1)::BIGINT AS n_tokens FROM documents)""",
        "topical AS (SELECT *, CASE WHEN n_tokens < 120 THEN 'note' WHEN n_tokens < 800 THEN 'article' ELSE 'longread' END AS topic FROM counted)",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM topical GROUP BY ALL)",
    ]
    for axis in mixing.AXES:
        parts.append(f"raw_{axis} AS (SELECT {axis}, {target(axis)} AS raw FROM (SELECT {axis}, sum(n) AS s FROM cells GROUP BY {axis}))")
        parts.append(f"target_{axis} AS (SELECT {axis}, raw / sum(raw) OVER () AS t_{axis} FROM raw_{axis})")
    parts.append("w0 AS MATERIALIZED (SELECT *, n AS w FROM cells JOIN target_source USING (source) JOIN target_lang USING (lang) JOIN target_topic USING (topic))")
    k = 0
    for _ in range(SQL_ROUNDS):
        for axis in mixing.AXES:
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{axis} / sum(w) OVER (PARTITION BY {axis}) AS w) FROM w{k})")
            k += 1
    parts += [
        f"""filled AS (SELECT *, w / n AS r, ({BUDGET} * sum(n) OVER () - coalesce(sum(n) OVER (ORDER BY w / n DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY w / n DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM w{k})""",
        "common AS (SELECT arg_min(scale, {'a': -r, 'b': source, 'c': lang, 'd': topic}) AS common FROM filled WHERE scale * r < 1)",
        "shares AS (SELECT source, lang, topic, w / (n / sum(n) OVER ()) AS weight, CASE WHEN common IS NULL THEN 1 ELSE least(1, greatest(0, common * r)) END AS p, t_source, t_lang, t_topic, n FROM filled, common)",
        "expected AS (SELECT *, " + ", ".join(f"sum(n * p) OVER (PARTITION BY {a}) / sum(n * p) OVER () AS e_{a}" for a in mixing.AXES) + " FROM shares)",
    ]
    report = ", ".join(f"round(t_{a}, 6) AS target_{a}, round(e_{a}, 6) AS expected_{a}" for a in mixing.AXES)
    draw = f"('0x' || substr(md5(concat_ws(':', '{MIX_SEED}', doc_id::VARCHAR)), 1, 13))::BIGINT::DOUBLE / {1 << 52}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, topic, n_tokens, round(weight, 6) AS weight, round(p, 6) AS p, {draw} < p AS kept, {report} FROM topical JOIN expected USING (source, lang, topic)"


def _secrets_sql() -> str:
    """The secret scan: positions as running lengths of gaps and matches. RE2 needs neither possessive marks nor look-behind."""
    assign = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    kinds = {"assign": assign, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", "loose": "[A-Za-z0-9+/_=-]{20,}"}
    found = " UNION ALL ".join(f"SELECT doc_id, {i} AS rank, '{k}' AS kind, regexp_extract_all(text, $${rx}$$) AS a, regexp_split_to_array(text, $${rx}$$) AS g FROM d" for i, (k, rx) in enumerate(kinds.items()))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents), found AS ({found}),
  flat AS (SELECT doc_id, rank, kind, unnest(a) AS m, unnest(g[1:len(a)]) AS gap, generate_subscripts(a, 1) AS k FROM found),
  placed AS (SELECT doc_id, rank, kind, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY k)::BIGINT AS e FROM flat),
  spans AS (SELECT *, e - length(m) AS s, CASE WHEN kind = 'assign' THEN regexp_extract(m, $$^{assign}$$, 2) ELSE m END AS value FROM placed),
  good AS (SELECT * FROM spans WHERE CASE kind WHEN 'assign' THEN length(value) >= 8 WHEN 'loose' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') ELSE true END),
  held AS (SELECT value, count(DISTINCT text) AS repositories, count(DISTINCT source) AS owners FROM good JOIN d USING (doc_id) GROUP BY value),
  added AS (SELECT DISTINCT doc_id, CASE WHEN owners >= {secrets.OWNERS} OR repositories >= {secrets.REPOSITORIES} THEN 4 ELSE 3 END AS rank, s, e FROM good JOIN held USING (value)
    WHERE owners >= {secrets.OWNERS} OR repositories >= {secrets.REPOSITORIES} OR len(list_distinct(string_split(value, ''))) >= {secrets.VARIETY}),
  named AS (SELECT doc_id, rank, s, e, ['assign', 'access', 'hex', 'live', 'copied'][rank + 1] || ':' || s || ':' || e AS x FROM (SELECT doc_id, rank, s, e FROM good WHERE kind <> 'loose' UNION ALL SELECT doc_id, rank, s, e FROM added)),
  per AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS b, count(*) FILTER (WHERE rank = 2) AS c, string_agg(x, ',' ORDER BY s, rank, e) FILTER (WHERE rank < 3) AS base, string_agg(x, ',' ORDER BY s, rank, e) AS spans FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (doc_id)"""


def _pii_sql() -> str:
    """Personal data: positions as in the secret scan; terms judged by their mutual information with each entity."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    found = " UNION ALL ".join(f"SELECT text, {i} AS rank, regexp_extract_all(text, $${rx}$$) AS a, regexp_split_to_array(text, $${rx}$$) AS g FROM t" for i, rx in enumerate(kinds.values()))
    term = r"[\p{L}\p{N}\p{M}]+(?:[._'\x{2019}-][\p{L}\p{N}\p{M}]+)*"
    twice = "CASE WHEN substr(x, i, 1)::INT > 4 THEN substr(x, i, 1)::INT * 2 - 9 ELSE substr(x, i, 1)::INT * 2 END"
    names = "[" + ", ".join(f"'{k}'" for k in pii.KINDS) + "]"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT greatest(count(*), 2)::DOUBLE AS n FROM d), t AS (SELECT DISTINCT text FROM d), found AS ({found}),
  flat AS (SELECT text, rank, unnest(a) AS m, unnest(g[1:len(a)]) AS gap, generate_subscripts(a, 1) AS k FROM found),
  placed AS (SELECT text, rank, m, sum(length(gap) + length(m)) OVER (PARTITION BY text, rank ORDER BY k)::BIGINT AS e FROM flat),
  spans AS (SELECT text, rank, m, e - length(m) AS s, e, regexp_replace(m, '[^0-9]', '', 'g') AS x FROM placed),
  base AS (SELECT text, rank, s, e, CASE WHEN rank < 2 THEN lower(m) ELSE x END AS entity FROM spans WHERE CASE rank WHEN 0 THEN true
    WHEN 1 THEN list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND ('0' || right(p, 3))::INT <= 255))
    WHEN 2 THEN length(x) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 0 THEN substr(x, i, 1)::INT ELSE {twice} END)) % 10 = 0
    ELSE length(x) BETWEEN 8 AND 15 END),
  reach AS (SELECT text, s, e, coalesce(max(e) OVER (PARTITION BY text ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM base),
  rest AS (SELECT text, string_agg(substr(text, p + 1, greatest(s - p, 0)) || repeat(' ', greatest(e - greatest(s, p), 0)), '' ORDER BY s, e) || substr(text, max(e) + 1) AS rest FROM reach GROUP BY text),
  copies AS (SELECT text, count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN 1 END) AS copies FROM d WHERE text IN (SELECT text FROM rest) GROUP BY text),
  held AS (SELECT DISTINCT text, rank, entity FROM base), size AS (SELECT rank, entity, sum(copies)::DOUBLE AS n_c FROM held JOIN copies USING (text) GROUP BY ALL),
  words AS (SELECT DISTINCT text, lower(w) AS term FROM (SELECT text, unnest(regexp_extract_all(rest, $${term}$$)) AS w FROM rest)), terms AS (SELECT DISTINCT term FROM words),
  each AS (SELECT text, count(*) AS rows FROM d GROUP BY text), all_words AS (SELECT DISTINCT text, lower(w) AS term FROM (SELECT text, unnest(regexp_extract_all(text, $${term}$$)) AS w FROM t)),
  n_t AS (SELECT term, sum(rows) AS n_t FROM all_words JOIN each USING (text) WHERE term IN (SELECT term FROM terms) GROUP BY term),
  judged AS (SELECT rank, entity, term, sum(copies) AS n_ct, count(*) AS texts FROM words JOIN held USING (text) JOIN copies USING (text) GROUP BY ALL),
  shares AS (SELECT rank, entity, term, ln(n_ct * n / (n_c * greatest(n_t, n_ct))) / ln(n / n_c) * (1 - pow(n, {-pii.EVIDENCE} * texts)) AS share FROM judged JOIN size USING (rank, entity) LEFT JOIN n_t USING (term), n WHERE n_c < n),
  risky AS (SELECT text, term, max(share) AS share FROM words JOIN held USING (text) JOIN shares USING (rank, entity, term) WHERE share >= {pii.GENERALISE} GROUP BY ALL),
  cut AS (SELECT text, regexp_extract_all(rest, $${term}$$) AS a, regexp_split_to_array(rest, $${term}$$) AS g FROM rest WHERE text IN (SELECT text FROM risky)),
  pieces AS (SELECT text, unnest(a) AS m, unnest(g[1:len(a)]) AS gap, generate_subscripts(a, 1) AS k FROM cut),
  spots AS (SELECT text, m, sum(length(gap) + length(m)) OVER (PARTITION BY text ORDER BY k)::BIGINT AS e FROM pieces),
  every AS (SELECT text, rank, s, e FROM base UNION ALL SELECT spots.text, CASE WHEN share >= {pii.REMOVE} THEN 4 ELSE 5 END, e - length(m), e FROM spots JOIN risky ON risky.text = spots.text AND risky.term = lower(spots.m)),
  per AS (SELECT text, {", ".join(f"count(*) FILTER (WHERE rank = {i}) AS n_{k}" for i, k in enumerate(pii.BASE))}, string_agg({names}[rank + 1] || ':' || s || ':' || e, ',' ORDER BY rank, s, e) FILTER (WHERE rank < 4) AS base,
    string_agg({names}[rank + 1] || ':' || s || ':' || e, ',' ORDER BY rank, s, e) AS spans FROM every GROUP BY text)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (text)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": _mixing_sql(), "op5_secrets": _secrets_sql(), "op10_pii": _pii_sql()}
