"""Queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, license_rules, license_scan, mixing, near_dedup, packing, periodic_runs, quality_classifier, quality_rules, secrets, sharding, substring_dedup, token_counts, whitening
from docloom.llm.common import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(documents(spark, sf_dir), size=3, num=85, den=100).drop("n_joining_links")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir), texts=False)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir).where("quality = 1"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).drop("source", "expected", "copies", "text_crc")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(documents(spark, sf_dir)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = quality_classifier.held_out()
    scores = quality_classifier.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir).where(~held))
    return scores.select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.license_spans(documents(spark, sf_dir)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(documents(spark, sf_dir))))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d WHERE len(ws) >= 50)),
low AS (SELECT k, min(doc_id) AS first_id FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN low USING (k) WHERE first_id < doc_id),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, 3 * source_size / w AS level_at FROM s),
o AS (SELECT *, row_number() OVER f AS nth, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
    FROM c WINDOW f AS (ORDER BY level_at, source NULLS LAST), b AS (ORDER BY level_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT min_by(level, nth) AS common FROM o WHERE level <= level_at),
t AS (SELECT source, source_size, least(w * coalesce(common, 'inf'::DOUBLE), cap::DOUBLE) AS target FROM o CROSS JOIN m),
h AS (SELECT d.source, size, length(bin(size)) AS w, count(*) AS n, any_value(target) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY ALL),
b AS (SELECT *, sum(size * n) OVER p AS full_words, sum(w * size * n) OVER (PARTITION BY source) - coalesce(sum(w * size * n) OVER p, 0) AS drawn FROM h WINDOW p AS (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT source, max_by(level, size) AS level FROM (SELECT source, size, w, (target - 3 * coalesce(full_words, 0)) / drawn::DOUBLE AS level FROM b) WHERE level * w <= 3 GROUP BY source),
e AS (SELECT h.*, least(coalesce(level * w, 3.0::DOUBLE), 3.0::DOUBLE) AS copies FROM h LEFT JOIN v ON h.source IS NOT DISTINCT FROM v.source),
q AS (SELECT t.*, greatest(t.target - coalesce(x.whole, 0), 0::DOUBLE) AS rest FROM t LEFT JOIN (SELECT source, sum(floor(copies)::BIGINT * size * n) AS whole FROM e GROUP BY source) x ON t.source IS NOT DISTINCT FROM x.source),
a AS (SELECT d.*, source_size, q.target, rest, coalesce(floor(copies), 0) AS whole, copies - floor(copies) AS p, CASE WHEN copies > floor(copies) THEN u / (1 - u) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) END AS odds
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.size = e.size),
k AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id) AS upto FROM a WHERE odds IS NOT NULL AND size > 0),
x AS (SELECT *, min(CASE WHEN upto > rest THEN upto END) OVER (PARTITION BY source) AS stop FROM k),
y AS (SELECT *, stop IS NULL OR upto < stop AS chosen FROM x),
g AS (SELECT source, max(rest) - coalesce(sum(size) FILTER (chosen), 0) AS gap, bool_or(NOT chosen) AS more FROM y GROUP BY source),
f AS (SELECT y.source, min_by(doc_id, (abs(size - gap), odds, doc_id)) AS filler FROM y JOIN g ON y.source IS NOT DISTINCT FROM g.source WHERE NOT chosen AND gap > 0 AND size < 2 * gap GROUP BY y.source)
SELECT a.doc_id, a.size, a.source_size, a.target,
    CASE WHEN a.size > 0 THEN a.size * (a.whole::BIGINT + CASE WHEN y.chosen OR a.doc_id = f.filler THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS taken
FROM a LEFT JOIN y ON a.doc_id = y.doc_id LEFT JOIN f ON a.source IS NOT DISTINCT FROM f.source
"""

OP8_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g USING (x)
"""

OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + 2], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS same FROM g GROUP BY doc_id),
rep AS (SELECT same, n, min(doc_id) AS id FROM n GROUP BY same, n),
rs AS (SELECT id, n, s FROM rep JOIN g ON doc_id = id),
pair AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM rs x JOIN rs y ON x.s = y.s AND x.id < y.id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL),
link AS (SELECT a, b FROM pair WHERE 100 * k >= 85 * (na + nb - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, root) AS (SELECT id, id FROM rep UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.id WHERE r.root < e.b),
comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (same, n) LEFT JOIN comp c ON c.id = rep.id
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM d WHERE len(ws) > 2)),
again AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT p + i) AS n FROM again, (SELECT unnest([0, 1, 2]) AS i) GROUP BY doc_id),
line AS (SELECT doc_id, count(l) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(line.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
bytes AS (SELECT doc_id, ('0x' || unnest(hs))::UBIGINT AS b, generate_subscripts(hs, 1) AS p FROM (SELECT doc_id, regexp_extract_all(x, '..') AS hs FROM d)),
word AS (SELECT doc_id, b + 256 * lead(b, 1) OVER w + 65536 * lead(b, 2) OVER w + 16777216 * lead(b, 3) OVER w AS v FROM bytes WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
gram AS (SELECT doc_id, ((xor(v, v >> 15)::UHUGEINT * 2246822507 % 4294967296)::UBIGINT >> 18)::INT AS bucket FROM word WHERE v IS NOT NULL),
part AS (SELECT doc_id, bucket, count(*) AS k FROM gram GROUP BY ALL),
seen AS (SELECT bucket, sum(k) AS r, sum(CASE WHEN trusted.doc_id IS NOT NULL THEN k ELSE 0 END) AS t FROM part LEFT JOIN trusted USING (doc_id) GROUP BY bucket),
total AS (SELECT sum(r) + 16384 AS r, sum(t) + 16384 AS t FROM seen),
ratio AS (SELECT bucket, ln((seen.t + 1) / total.t::DOUBLE) - ln((seen.r + 1) / total.r::DOUBLE) AS ratio FROM seen, total),
score AS (SELECT doc_id, round(sum(k * ratio) / sum(k), 6) AS llr FROM part JOIN ratio USING (bucket) GROUP BY doc_id),
every AS (SELECT judged.*, coalesce(llr, 0.0::DOUBLE) AS llr FROM judged LEFT JOIN score USING (doc_id)),
step AS (SELECT floor(llr * 1000) AS step, count(*) AS n FROM every SEMI JOIN trusted USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
upto AS (SELECT step, sum(n) OVER (ORDER BY step) AS n, sum(n) OVER () AS total FROM step),
level AS (SELECT coalesce(min(step) / 1000.0::DOUBLE - 0.25, -1e9) AS level FROM upto WHERE n > 0.005::DOUBLE * total)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND llr >= level AS kept, llr FROM every, level
"""


def _spans_sql(kind: str, pattern: str, short: str) -> str:
    """Spans of a pattern: its matches, and the text between them, laid end to end; short ones are dropped."""
    return f"""SELECT doc_id, '{kind}' AS kind, began AS start, began + length(m) AS stop FROM (
    SELECT doc_id, m, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS began FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(string_split_regex(text, '{pattern}')[:len(regexp_extract_all(text, '{pattern}'))]) AS gap,
            generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i FROM d WHERE regexp_matches(text, '{pattern}'))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE {short}"""


def _letters(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGNED = "(?:" + "|".join(map(_letters, ("password", "passwd", "secret", "token"))) + "|" + _letters("api") + "_?" + _letters("key") + """)["'']?\\x20*[:=]\\x20*["'']?"""
_OPEN = "[A-Za-z0-9+/_.=-]+"
_CRC_SQL = "list_reduce([4294967295::UBIGINT] || list_transform(range(1, 31), lambda i: ord(body[i])::UBIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8)::UBIGINT[], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END))"

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
plain AS ({_spans_sql("assign", _ASSIGNED + _OPEN, f"length(regexp_extract(m, '^{_ASSIGNED}({_OPEN})$', 1)) >= 6")}
    UNION ALL {_spans_sql("access", "AKIA[A-Z0-9]+", "length(m) >= 20")} UNION ALL {_spans_sql("hex", "[0-9a-f]+", "length(m) >= 24")}),
key AS ({_spans_sql("private_key", secrets._KEY.pattern, "true")} UNION ALL {_spans_sql("web_token", secrets._WEB.pattern, "true")}),
like_token AS (SELECT doc_id, start, stop, substr(text, start::BIGINT + 1, (stop - start)::BIGINT) AS m FROM ({_spans_sql("checked_token", "(?:gh[opsru]|npm)_[A-Za-z0-9]+", "length(m) = 40")}) JOIN d USING (doc_id)),
crc AS (SELECT doc_id, start, stop, m, xor({_CRC_SQL}, 4294967295::UBIGINT) AS crc FROM (SELECT *, m[5:34] AS body FROM like_token)),
token AS (SELECT doc_id, 'checked_token' AS kind, start, stop FROM crc
    WHERE m[35:] = array_to_string(list_transform([916132832, 14776336, 238328, 3844, 62, 1], lambda k: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', (crc // k % 62)::INT + 1, 1)), '')),
span AS (SELECT *, list_position({[*secrets.KINDS]}, kind) AS o, kind || ':' || start || ':' || stop AS t FROM (SELECT * FROM plain UNION ALL SELECT * FROM key UNION ALL SELECT * FROM token)),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(t, ',' ORDER BY start, o) FILTER (o <= 3) AS base, string_agg(t, ',' ORDER BY start, o) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)
"""



def _rule_rows() -> str:
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    rows = ((r["number"], quoted(r["keyword"]), quoted(r["before"]), quoted(r["after"]), quoted(r["label"]), r["level"], r["confidence"], r["base"]) for r in map(license_scan.shown, license_rules.rules()))
    return ", ".join(f"({', '.join(map(str, r))})" for r in rows)


OP12_SQL = rf"""
WITH rule(number, keyword, before, after, label, level, confidence, base) AS (VALUES {_rule_rows()}),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{license_scan.GAP}'), lambda w: w <> '') AS ws FROM documents),
word AS (SELECT doc_id, ws, unnest(ws) AS w, (generate_subscripts(ws, 1) - 1)::INT AS pos FROM d),
hit AS (SELECT doc_id, w, pos, array_to_string(list_transform(ws[greatest(pos - 24, 0) + 1:pos], lambda x: x || ' '), '') AS l, array_to_string(list_transform(ws[pos + 2:pos + 25], lambda x: ' ' || x), '') AS r
    FROM word WHERE w IN (SELECT keyword FROM rule)),
part AS (SELECT doc_id, pos, regexp_extract(l, before, 1) AS l, regexp_extract(r, after, 1) AS r, number, label, level, confidence, base FROM hit JOIN rule ON w = keyword WHERE regexp_matches(l, before) AND regexp_matches(r, after)),
found AS (SELECT doc_id, pos - length(l) + length(replace(l, ' ', '')) AS start, pos + 1 + length(r) - length(replace(r, ' ', '')) AS stop, number, label, level, confidence, base FROM part),
gone AS (SELECT DISTINCT x.doc_id, x.start, x.stop, x.number FROM found x JOIN found y ON x.doc_id = y.doc_id AND y.start <= x.start AND y.stop >= x.stop AND y.level <= x.level AND NOT y.base
    WHERE NOT x.base AND (y.start < x.start OR y.stop > x.stop OR (y.level, y.number) < (x.level, x.number))),
s AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(confidence) AS score FROM found ANTI JOIN gone USING (doc_id, start, stop, number) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN s USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_packing, op3_substring_dedup, op4_sharding, op5_quality_rules, op6_mixing, op7_secrets, op8_exact_dedup, op9_quality_classifier, op10_token_counts, op11_whitening, op12_licenses, op13_periodic_runs)}
ORACLES = {"op1_near_dedup": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op5_quality_rules": OP5_SQL, "op6_mixing": OP6_SQL, "op7_secrets": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op12_licenses": OP12_SQL}
