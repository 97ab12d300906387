"""The operators bound to the test tables: one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as vocab
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chunk_dedup, embeddings, fertility, fill_middle, line_dedup, minhash, mixing, negatives, packing, secret_scan, sharding, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


#: Windows compared as strings, numbered by place; covered lines dropped.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, pos, array_to_string(ls[pos + 1:pos + 3], chr(10)) AS w
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM d WHERE len(ls) >= 3)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n
      FROM w WHERE regexp_matches(w, '[^\x20\x09-\x0D]')),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE n > 1),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM d),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL) AS text,
             count(*) AS n_lines, count(c.pos) AS n_removed
      FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN k USING (doc_id)
"""


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_spans(documents(spark, sf_dir))


def op2_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(
        documents(spark, sf_dir), vocab.path("piece_bpe_32k.model"), vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocab.path("piece_bpe_32k.model"))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, sf_dir), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: Two regions of two racks of two equal shards; growth adds a third region with one shard.
SHARD_TREE = {f"r{r}": {f"k{k}": {4 * r + 2 * k + s: 1.0 for s in range(2)} for k in range(2)} for r in range(2)}
GROWN_TREE = SHARD_TREE | {"r2": {"k0": {8: 1.0}}}


def op6_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hash_tree_shards(documents(spark, sf_dir), SHARD_TREE, GROWN_TREE)


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        documents(spark, sf_dir), vocab.path("byte_bpe_50k.json"), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN
    )


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op9_hyperplane_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """positions: the training times of the passes in billionths, and ranks, both comma-joined."""
    mixed = mixing.with_ranks(documents(spark, sf_dir))
    first = F.try_element_at("positions", F.lit(1)).alias("first_position")
    parts = F.transform("positions", lambda p: F.floor(p * 1e9).cast("string"))
    ranks = F.transform("ranks", lambda r: r.cast("string"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first, F.array_join(parts, ",").alias("positions"), F.array_join(ranks, ",").alias("ranks"))


def op11_pivot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; labels of ids divisible by 7 move on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocab.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_texts(documents(spark, sf_dir), ranks, vocab.PATTERN)
    hashed = encoded.select("doc_id", "n_tokens", "ids", *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "offsets")])
    decoded = byte_bpe.decode_ids(hashed, ranks)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "offsets_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(documents(spark, sf_dir))
    hashes = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


#: Sets as strings, all pairs that share a shingle counted, links followed to the least id.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT DISTINCT a AS id, a AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT id, min(other) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""

#: Every match placed by the lengths before it; owners of a value counted by the value itself.
OP8_SQL = r"""
WITH k(kind, name, pattern, part, least) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12), (1, 'access', 'AKIA[A-Z0-9]+', 0, 18), (2, 'hex', '[0-9a-f]+', 0, 16)),
m AS (SELECT doc_id, source, lang, 0 AS kind, string_split(regexp_replace(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', chr(57344) || '\0' || chr(57344), 'g'), chr(57344)) AS parts FROM documents
  UNION ALL SELECT doc_id, source, lang, 1, string_split(regexp_replace(text, 'AKIA[A-Z0-9]+', chr(57344) || '\0' || chr(57344), 'g'), chr(57344)) FROM documents
  UNION ALL SELECT doc_id, source, lang, 2, string_split(regexp_replace(text, '[0-9a-f]+', chr(57344) || '\0' || chr(57344), 'g'), chr(57344)) FROM documents),
u AS (SELECT doc_id, source, lang, kind, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM m),
e AS (SELECT *, CAST(sum(length(part)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM u),
v AS (SELECT doc_id, source, lang, kind, stop - length(part) AS start, stop, CASE kind WHEN 0 THEN regexp_extract(part, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE part END AS value FROM e WHERE i % 2 = 0),
f AS MATERIALIZED (SELECT v.*, k.name FROM v JOIN k USING (kind) WHERE length(v.value) >= k.least),
o AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT coalesce(source, '') || '/' || coalesce(lang, '')) AS repositories FROM f GROUP BY value),
x AS (SELECT f.*, o.owners, o.owners = 1 AND o.repositories = 1 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8 AS live FROM f JOIN o USING (value)),
a AS (SELECT doc_id, start, kind, stop, name FROM x UNION ALL SELECT DISTINCT doc_id, stop - length(value), 3, stop, 'live' FROM x WHERE live),
g AS (SELECT doc_id, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < 3) AS base,
  count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind = 3) AS n_live FROM a GROUP BY doc_id),
h AS (SELECT doc_id, count(*) FILTER (WHERE owners >= 3) AS n_examples FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(g.base, '')) AS base_sha256, coalesce(g.spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN h USING (doc_id)
"""

#: All pairs.
OP9_SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT DISTINCT a AS id, a AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT id, min(other) AS c FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, e.vec_id) AS component_id, coalesce(c.c, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN n ON n.id = e.vec_id LEFT JOIN c ON c.id = e.vec_id
"""


def _time_sql(share: str, schedule: mixing.Schedule) -> str:
    """The inverse of a schedule's demand in SQL, segment by segment."""
    number = lambda x: f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))
    area, done, cases = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])), 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        w0, w1 = w0 / area, w1 / area
        part, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        left = f"greatest({share} - {number(done)}, 0e0)"
        root = f"sqrt(greatest({number(w0 * w0)} + {left} * {number(2 * slope)}, 0e0))"
        at = f"CASE WHEN {left} = 0e0 THEN {number(t0)} ELSE least({number(t1)}, {number(t0)} + {left} * 2 / ({root} + {number(w0)})) END"
        cases.append(f"WHEN {share} < {number(done + part)} THEN {at}")
        done += part
    return f"CASE {' '.join(cases)} ELSE 1e0 END"


#: The level at which the sources share, each source's stream summed in order, passes before the target timed and ranked.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || coalesce(md5(text), 'null')) AS place, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
w AS (SELECT *, source_size * 3 AS cap, [5, 2, 1][turn % 3 + 1] AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source)),
k AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(cap) OVER o AS BIGINT) - cap AS filled, CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight DESC, turn DESC) AS BIGINT) AS open FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, turn)),
v AS (SELECT arg_min(CAST(total - filled AS DOUBLE) / open, (CAST(cap AS DOUBLE) / weight, turn)) FILTER (WHERE CAST(total - filled AS DOUBLE) / open <= CAST(cap AS DOUBLE) / weight) AS level FROM k),
t AS (SELECT source, turn, source_size, least(CAST(cap AS DOUBLE), coalesce(level, 0e0) * weight) AS target FROM w, v),
q AS (SELECT d.doc_id, d.size, t.turn, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY t.turn ORDER BY place) AS BIGINT) - size AS before FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
p AS (SELECT doc_id, pass, turn, (before + CAST(size AS DOUBLE) / 2 + pass * source_size) / target AS share FROM q, (VALUES (0), (1), (2)) x(pass) WHERE before + CAST(size AS DOUBLE) / 2 + pass * source_size < target),
g AS (SELECT doc_id, count(*) AS n, min(moment) AS first, string_agg(CAST(floor(moment * 1e9) AS BIGINT), ',' ORDER BY pass) AS positions, string_agg(place - 1, ',' ORDER BY place) AS ranks
  FROM (SELECT *, row_number() OVER (ORDER BY moment, doc_id, pass) AS place FROM (SELECT *, CASE turn % 3 WHEN 0 THEN TIME0 WHEN 1 THEN TIME1 ELSE TIME2 END AS moment FROM p)) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, q.size * coalesce(g.n, 0) AS taken, g.first AS first_position, coalesce(g.positions, '') AS positions, coalesce(g.ranks, '') AS ranks FROM q LEFT JOIN g USING (doc_id)
"""
for _i, _schedule in enumerate(mixing.SCHEDULES):
    OP10_SQL = OP10_SQL.replace(f"TIME{_i}", _time_sql("share", _schedule))


#: All pairs of anchors and rows.
OP11_SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

#: Tokens as lists of strings, sliced and joined.
OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || doc_id) AS h FROM documents),
d AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(w) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(w) + 1) AS c2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT doc_id, len(w) AS n, form, text, array_to_string(w[1:least(c1, c2)], '') AS p, array_to_string(w[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(w[greatest(c1, c2) + 1:], '') AS s FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_line_dedup, op2_quality_fertility, op3_token_counts, op4_chunk_dedup, op5_minhash_near_duplicates,
            op6_hash_tree_sharding, op7_sum_of_squares_packing, op8_secret_ownership, op9_hyperplane_near_duplicates, op10_curriculum_mixing,
            op11_pivot_hard_negatives, op12_byte_bpe, op13_fill_in_middle,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op5_minhash_near_duplicates": OP5_SQL,
        "op8_secret_ownership": OP8_SQL,
        "op9_hyperplane_near_duplicates": OP9_SQL,
        "op10_curriculum_mixing": OP10_SQL,
        "op11_pivot_hard_negatives": OP11_SQL,
        "op13_fill_in_middle": OP13_SQL,
    }
