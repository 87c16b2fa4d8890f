"""The registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: F401

from wakeline.llm import bpe, collocations, curriculum, decontaminate, filter_audit, licences, line_dedup, near_dedup, personal_data, quality, secrets, toxicity, warc
from wakeline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), near_dedup.NearDedup(k=4))


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ("ids_sha256", "decoded_sha256"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def joined(found: str, kinds: tuple[str, ...] | None = None):
    """Spans as ``kind:start:end`` in their order, comma-joined."""
    spans = F.filter(found, lambda s: s.kind.isin(*kinds)) if kinds else F.col(found)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def counted(found: str, kinds: tuple[str, ...]) -> list:
    def number(kind: str):
        return F.size(F.filter(found, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return [number(kind) for kind in kinds]


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counted("found", secrets.BASE), F.sha2(joined("found", secrets.BASE), 256).alias("base_sha256"),
                        joined("found").alias("spans"))


@query("op10_quality_rules", r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
win AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM w, unnest(range(1, len(w) - 3)) AS t(i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, range(5) AS t(k) GROUP BY r),
c AS (SELECT r, doc_id, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM w),
j AS (SELECT c.*, coalesce(n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS up,
             length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters FROM c LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR 2 * up > letters OR 10 * letters < 6 * word_chars) AS kept
FROM b""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counted("found", personal_data.BASE), F.sha2(joined("found", personal_data.BASE), 256).alias("base_sha256"),
                        joined("found").alias("spans"))


@query("op4_line_dedup", r"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS d, doc_id, text, string_split(text, chr(10)) AS all_lines FROM documents),
raw AS (SELECT d, p, trim(all_lines[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM docs, unnest(range(1, len(all_lines) + 1)) AS t(p)),
seq AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY p) AS i, count(*) OVER (PARTITION BY line) AS n FROM raw WHERE line <> ''),
rep AS (SELECT *, i - row_number() OVER (PARTITION BY d ORDER BY i) AS seg FROM seq WHERE n > 1),
segs AS (SELECT d, seg, list(line ORDER BY i) AS lines, list(p ORDER BY i) AS ps,
                list(len(regexp_extract_all(line, '[^ 	-
]+')) ORDER BY i) AS ws FROM rep GROUP BY d, seg),
win AS (SELECT d, seg, s, e, ps, lines[s:e] AS g, list_sum(ws[s:e]) AS w, d * 67108864 + ps[s] AS pos
        FROM segs, unnest(range(1, len(lines) + 1)) AS a(s), unnest(range(s, len(lines) + 1)) AS b(e)),
hit AS (SELECT d, s, e, ps FROM (SELECT *, min(pos) OVER (PARTITION BY g) AS first FROM win) WHERE first < pos AND w >= 20),
gone AS (SELECT DISTINCT d, ps[k] AS p FROM hit, unnest(range(s, e + 1)) AS t(k)),
kept AS (SELECT d, count(g.p) AS n_gone, string_agg(CASE WHEN g.p IS NULL THEN all_lines[q.p] END, chr(10) ORDER BY q.p) AS text
         FROM (SELECT d, all_lines, unnest(range(1, len(all_lines) + 1)) AS p FROM docs) q LEFT JOIN gone g USING (d, p) GROUP BY d)
SELECT doc_id, n_gone::BIGINT AS n_deleted, sha256(coalesce(kept.text, '')) AS text_sha256 FROM docs JOIN kept USING (d)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines_deleted").alias("n_deleted"), F.sha2("text", 256).alias("text_sha256"))


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"),
                        F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


@query("op6_warc_dictionary", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(x, (1 + (i // 4) * 5)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM g""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_licence_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).withColumn("families", F.array_join("families", ","))


@query("op12_filter_audit", r"""
WITH lab AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
             (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)::INT AS mask FROM d LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(bad) AS bad FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT array_to_string(o, '') AS filter_order, step, o[step] AS name, (1 << (ascii(o[step]) - 65))::INT AS own,
             coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << (ascii(x) - 65))), 0)::INT AS before FROM o, unnest(range(1, 6)) AS t(step)),
g AS (SELECT part, filter_order, step, name, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, name)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley FROM g""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = filter_audit.text_filters()
    found = filter_audit.marked(table(spark, sf_dir, "documents"), filters)
    return filter_audit.audit(found, list(filters), table(spark, sf_dir, "labels"))


@query("op11_curriculum_mix", r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS lot FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT *, (3 * n)::DOUBLE AS cap, (3 * n)::DOUBLE / w AS fa, (sum(n) OVER ())::DOUBLE AS total, sum(w) OVER () AS ws FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (ws - coalesce(sum(w) OVER b, 0)) AS lv FROM f
      WINDOW b AS (ORDER BY fa, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, n, least(cap, coalesce((SELECT lv FROM l WHERE lv * w <= cap ORDER BY fa, source NULLS FIRST LIMIT 1) * w, cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN n > 0 THEN least(3, floor(target / n))::BIGINT ELSE 0 END AS passes FROM t),
r AS (SELECT *, target - passes * n AS rest, CASE WHEN n > 0 THEN (target - passes * n) / n ELSE 0 END AS share FROM p),
x AS (SELECT row_number() OVER () AS id, d.*, n, target, passes, rest, share, size > 0.001 * n AS large FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
g AS (SELECT id, source, size, share, row_number() OVER (PARTITION BY source ORDER BY size DESC, lot, id) AS k FROM x WHERE large),
c AS (SELECT id, source, k, share > 0 AND 2 * (size * share) >= size AS extra,
             size * share - CASE WHEN share > 0 AND 2 * (size * share) >= size THEN size ELSE 0 END AS carry FROM g WHERE k = 1
      UNION ALL
      SELECT g.id, g.source, g.k, share > 0 AND 2 * (carry + size * share) >= size,
             carry + size * share - CASE WHEN share > 0 AND 2 * (carry + size * share) >= size THEN size ELSE 0 END
      FROM c JOIN g ON g.k = c.k + 1 AND g.source IS NOT DISTINCT FROM c.source),
m AS (SELECT source, arg_max(carry, k) AS missed FROM c GROUP BY source),
q AS (SELECT x.*, coalesce(extra, false) AS extra, coalesce(missed, 0) AS missed,
             coalesce(sum(CASE WHEN large THEN 0 ELSE size END) OVER (PARTITION BY x.source ORDER BY lot, x.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ss,
             (sum(CASE WHEN large THEN 0 ELSE size END) OVER (PARTITION BY x.source))::BIGINT AS st
      FROM x LEFT JOIN c ON c.id = x.id LEFT JOIN m ON m.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, n AS source_size, target,
       (size * (passes + CASE WHEN large THEN extra ELSE rest > 0 AND 2 * ss + size <= 2 * (st * share + missed) END::INT))::BIGINT AS taken
FROM q""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = curriculum.mix(docs, curriculum.ranked_schedule(docs))
    return mixed.select("doc_id", "size", "source_size", "target", "taken").orderBy(F.try_element_at("times", F.lit(1)), "lot")


@query("op13_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m AS words, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM w, unnest(range(1, 4)) AS a(m), unnest(range(1, len(w) - m + 2)) AS b(i)),
f AS (SELECT lang, words, phrase, count(*)::HUGEINT AS f FROM g GROUP BY lang, words, phrase),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE words > 1 AND f >= 10),
k AS (SELECT c.*, k, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score FROM c, unnest(range(1, words)) AS t(k)
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(s[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(s[k + 1:], ' ')),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(s[j:j + 1], ' ') AS phrase, max(a) AS longer FROM c, unnest([1, 2]) AS t(j) WHERE words = 3 GROUP BY ALL),
v AS (SELECT o.*, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank
      FROM o LEFT JOIN i ON i.lang = o.lang AND i.phrase = o.phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM v JOIN n USING (lang) WHERE rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
