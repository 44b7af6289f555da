"""The registered queries of this subpackage: ``queries()`` and their SQL, ``oracle_sql()``."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.caps import cap_contributors
from skyweave.llm.groups import connected_groups
from skyweave.llm.leaks import find_leaks
from skyweave.llm.packing import pack_texts
from skyweave.llm.quality import quality
from skyweave.llm.topn import top_n_per_group
from skyweave.llm.vectors import IndexParams, most_similar
from skyweave.operators.keyed import latest
from skyweave.session import materialise


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def strongest_connections(spark: SparkSession, sf: str, n: int = 10) -> DataFrame:
    """``image_id, other_id, score, rank``: every camera's strongest usable connections."""
    rows = _table(spark, sf, "camera_connections").select("image_id", "other_id", "score", "evaluated", "updated_at").filter("image_id != other_id")
    newest = latest(rows, ["image_id", "other_id"], "updated_at", ["evaluated", "score"])
    usable = newest.filter("evaluated and score is not null and not isnan(score) and abs(score) != double('infinity')")
    return top_n_per_group(usable, "image_id", "score", ["other_id"], n, keep_missing=False)


def strongest_overlaps(spark: SparkSession, sf: str, n: int = 5) -> DataFrame:
    """``batch_id, lo, hi, overlap, rank``: every batch's pairs with the largest overlap."""
    rows = _table(spark, sf, "batch_pairs").filter("image_i != image_j and batch_id is not null")
    rows = rows.select("batch_id", F.least("image_i", "image_j").alias("lo"), F.greatest("image_i", "image_j").alias("hi"), "overlap", "measured_at")
    newest = latest(rows, ["batch_id", "lo", "hi"], "measured_at", ["overlap"])
    return top_n_per_group(newest, "batch_id", "overlap", ["lo", "hi"], n, keep_missing=False)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    a = strongest_connections(spark, sf).select(
        F.lit("connections").alias("field"), F.col("image_id").cast("long").alias("group_id"), F.least("image_id", "other_id").alias("image_lo"), F.greatest("image_id", "other_id").alias("image_hi")
    )
    b = strongest_overlaps(spark, sf).select(F.lit("overlap").alias("field"), F.col("batch_id").alias("group_id"), F.col("lo").alias("image_lo"), F.col("hi").alias("image_hi"))
    return a.unionByName(b)


P1_FOUND = """
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, other_id ORDER BY updated_at DESC NULLS LAST, evaluated DESC NULLS LAST, score DESC NULLS LAST) k
                          FROM camera_connections WHERE image_id <> other_id) WHERE k = 1),
ct AS (SELECT image_id, other_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, other_id) r FROM c WHERE evaluated AND score IS NOT NULL AND isfinite(score)),
o AS (SELECT * FROM (SELECT batch_id, least(image_i, image_j) lo, greatest(image_i, image_j) hi, overlap,
                     row_number() OVER (PARTITION BY batch_id, least(image_i, image_j), greatest(image_i, image_j) ORDER BY measured_at DESC NULLS LAST, overlap DESC NULLS LAST) k
                     FROM batch_pairs WHERE image_i <> image_j AND batch_id IS NOT NULL) WHERE k = 1),
ot AS (SELECT batch_id, lo, hi, row_number() OVER (PARTITION BY batch_id ORDER BY overlap DESC, lo, hi) r FROM o WHERE overlap IS NOT NULL AND NOT isnan(overlap))
SELECT 'connections' AS field, CAST(image_id AS BIGINT) AS group_id, least(image_id, other_id) AS image_lo, greatest(image_id, other_id) AS image_hi FROM ct WHERE r <= 10
UNION ALL SELECT 'overlap', batch_id, lo, hi FROM ot WHERE r <= 5
"""


def _newest_observations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "track_obs").select("obs_img", "obs_feat", "conf", "logged_at").filter("obs_img is not null and obs_feat is not null")
    return latest(rows, ["obs_img", "obs_feat"], "logged_at", ["conf"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    kept = cap_contributors(_newest_observations(spark, sf), "obs_img", "conf", ["obs_feat"], max_count=80)
    return kept.filter("capped").select("obs_img", "obs_feat")


P2_FOUND = """
WITH t AS (SELECT obs_img, obs_feat, CASE WHEN isnan(conf) THEN NULL ELSE conf END conf FROM (
  SELECT *, row_number() OVER (PARTITION BY obs_img, obs_feat ORDER BY logged_at DESC NULLS LAST, conf DESC NULLS LAST) k FROM track_obs
  WHERE obs_img IS NOT NULL AND obs_feat IS NOT NULL) WHERE k = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY obs_img ORDER BY conf DESC NULLS LAST, obs_feat) r, count(*) OVER (PARTITION BY obs_img) n FROM t)
SELECT obs_img, obs_feat FROM r WHERE n > 80 AND r <= 80
"""


def p2_share(spark: SparkSession, sf: str) -> DataFrame:
    """No image may give more than half a per cent of the observations that are kept."""
    kept = cap_contributors(_newest_observations(spark, sf), "obs_img", "conf", ["obs_feat"], max_share=0.005)
    return kept.select("obs_img", "obs_feat", "rank", "capped", F.col("level").cast("long").alias("level"))


P2_SHARE = """
WITH t AS (SELECT obs_img, obs_feat, CASE WHEN isnan(conf) THEN NULL ELSE conf END conf FROM (
  SELECT *, row_number() OVER (PARTITION BY obs_img, obs_feat ORDER BY logged_at DESC NULLS LAST, conf DESC NULLS LAST) k FROM track_obs
  WHERE obs_img IS NOT NULL AND obs_feat IS NOT NULL) WHERE k = 1),
n AS (SELECT obs_img, count(*) n FROM t GROUP BY 1),
m AS (SELECT max(n) m FROM n),
levels AS (SELECT unnest(generate_series(1, (SELECT m FROM m))) c),
ok AS (SELECT c FROM levels, n GROUP BY c HAVING c <= 0.005 * sum(least(n.n, c))),
lv AS (SELECT greatest(1, coalesce((SELECT max(c) FROM ok), 0)) AS level),
r AS (SELECT t.*, row_number() OVER (PARTITION BY t.obs_img ORDER BY conf DESC NULLS LAST, obs_feat) AS rank, n.n AS n FROM t JOIN n USING (obs_img))
SELECT obs_img, obs_feat, CAST(rank AS INTEGER) AS rank, n > level AS capped, CAST(level AS BIGINT) AS level FROM r, lv WHERE rank <= level
"""

#: (image, feature) as one number that keeps their order
_CODE = "shiftleft(cast({0} as bigint), 32) + (cast({1} as bigint) + 2147483648)"


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "feature_matches").filter("verified")
    pairs = rows.select(F.expr(_CODE.format("obs_img_a", "obs_feat_a")).alias("a"), F.expr(_CODE.format("obs_img_b", "obs_feat_b")).alias("b")).filter("a != b")
    image = lambda c: F.shiftright(c, 32).cast("int")
    feature = lambda c: (c.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(2147483648)).cast("int")
    g = connected_groups(pairs, "a", "b")
    return g.select(image(F.col("component")).alias("group_img"), feature(F.col("component")).alias("group_feat"), image(F.col("node")).alias("obs_img"), feature(F.col("node")).alias("obs_feat"))


P3_FOUND = """
WITH RECURSIVE e AS (
  SELECT DISTINCT x, y FROM (
    SELECT obs_img_a::BIGINT * 4294967296 + obs_feat_a AS x, obs_img_b::BIGINT * 4294967296 + obs_feat_b AS y FROM feature_matches
    WHERE verified AND obs_img_a IS NOT NULL AND obs_feat_a IS NOT NULL AND obs_img_b IS NOT NULL AND obs_feat_b IS NOT NULL) WHERE x <> y),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(node, g) AS (
  SELECT DISTINCT x, x FROM b
  UNION
  SELECT b.y, r.g FROM r JOIN b ON b.x = r.node WHERE r.g < b.y),
c AS (SELECT node, min(g) AS g FROM r GROUP BY node)
SELECT CAST(g // 4294967296 AS INTEGER) AS group_img, CAST(g % 4294967296 AS INTEGER) AS group_feat,
       CAST(node // 4294967296 AS INTEGER) AS obs_img, CAST(node % 4294967296 AS INTEGER) AS obs_feat FROM c
"""

VIEW_INDEX = IndexParams(dim=48)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    near = most_similar(_table(spark, sf, "batch_members"), "member_id", "descriptors", 5, VIEW_INDEX, at="predicted_at", min_sim=0.93)
    return near.select(F.least("id", "other").alias("member_lo"), F.greatest("id", "other").alias("member_hi")).distinct()


P4_FOUND = """
WITH m AS (SELECT member_id, descriptors::DOUBLE[] d FROM (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY predicted_at DESC NULLS LAST) k FROM batch_members) WHERE k = 1 AND len(descriptors) = 48),
v AS (SELECT * FROM m WHERE len(list_filter(d, lambda x: x IS NOT NULL AND isfinite(x))) = 48 AND len(list_filter(d, lambda x: x <> 0)) > 0),
u AS (SELECT member_id, d, sqrt(list_sum(list_transform(d, lambda x: x * x))) n FROM v),
s AS (SELECT a.member_id q, b.member_id o, round(list_inner_product(a.d, b.d) / (a.n * b.n), 6) s FROM u a JOIN u b ON a.member_id <> b.member_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, o) r FROM s)
SELECT DISTINCT least(q, o) AS member_lo, greatest(q, o) AS member_hi FROM r WHERE r <= 5 AND s >= 0.93
"""


def p4_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The lists of every view whose id is divisible by 50, against all views."""
    near = most_similar(_table(spark, sf, "batch_members"), "member_id", "descriptors", 5, VIEW_INDEX, at="predicted_at", queries="id % 50 = 0")
    return near.select(F.col("id").alias("member_id"), F.col("other").alias("other_id"), "sim", "rank")


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every text: ``doc_id, part, parts, tokens, container``."""
    packed = pack_texts(_table(spark, sf, "documents"), "doc_id", "text", 1024)
    return packed.select(F.col("id").alias("doc_id"), "part", "parts", F.col("size").alias("tokens"), "container")


def p6_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any packing: all texts are in, no container is overfull, no text is split that fits, none is lost in part."""
    packed = materialise(p6_pack(spark, sf), "packing-audit")
    texts = packed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.max("parts").alias("parts"), F.count(F.lit(1)).alias("n"))
    needless = F.count_if((F.col("parts") > 1) & (F.col("tokens") <= 1024))
    a = texts.agg(F.count(F.lit(1)).alias("texts"), needless.alias("needless_splits"), F.count_if(F.col("n") != F.col("parts")).alias("lost_parts"))
    b = packed.groupBy("container").agg(F.sum("tokens").alias("tokens")).agg(F.count_if(F.col("tokens") > 1024).alias("overfull"))
    return a.crossJoin(F.broadcast(b))  # one row each


P6_AUDIT = "SELECT count(*) AS texts, CAST(0 AS BIGINT) AS needless_splits, CAST(0 AS BIGINT) AS lost_parts, CAST(0 AS BIGINT) AS overfull FROM documents"


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_pack(spark, sf).filter("parts > 1").select("doc_id").distinct()


#: A subword never spans two runs of letters, digits or marks, so a text has at least as many tokens as runs; no text is near the size.
P6_FOUND = r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+')) > 1024"


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    leaks = find_leaks(_table(spark, sf, "documents"), "doc_id", "text", _table(spark, sf, "eval_items"), "item_id", "text")
    return leaks.filter("exact_windows > 0").select("doc_id", "item_id")


def _compatible() -> str:
    """SQL that takes ``text`` to NFKD without marks and format characters, in lower case; the mapping is made from Unicode's own tables."""
    single, several = {}, {}
    for c in map(chr, range(0xA0, 0x30000)):
        plain = unicodedata.normalize("NFKD", c)
        if plain != unicodedata.normalize("NFD", c) and not 0xAC00 <= ord(c) <= 0xD7A3:
            kept = "".join(x for x in plain if unicodedata.category(x) not in ("Mn", "Cf"))
            (single if len(kept) == 1 else several)[c] = kept
    quoted = lambda x: "".join(x).replace("'", "''")
    text = f"translate(text, '{quoted(single)}', '{quoted(single.values())}')"
    for c in (c for c in several if unicodedata.category(c)[0] in "LN" and several[c].isalnum() and ord(c) in (*range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFB00, 0xFB07))):
        text = f"replace({text}, '{c}', '{several[c]}')"
    return f"lower(regexp_replace(strip_accents(regexp_replace({text}, '[\\p{{Cf}}\\p{{Mn}}]', '', 'g')), '[\\p{{Cf}}\\p{{Mn}}]', '', 'g'))"


_WORDS = f"regexp_extract_all({_compatible()}, '[\\p{{L}}\\p{{N}}]+')"
P7_FOUND = f"""
WITH n AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[i:i+8], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 8)) AS i FROM n WHERE len(w) >= 9)),
kw AS (SELECT DISTINCT item_id, array_to_string(w[i:i+8], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 8)) AS i FROM k WHERE len(w) >= 9))
SELECT DISTINCT doc_id, item_id FROM dw JOIN kw USING (g)
"""


def p8_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics, rules and nearest structural profile of every text."""
    return quality(_table(spark, sf, "documents"), "doc_id", "text", _table(spark, sf, "common_words"))


def p8_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The structure of every text as divergence decides it: prose of a language, list, table or junk."""
    return p8_stats(spark, sf).select("doc_id", "profile", F.round("divergence", 4).alias("divergence"))


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics alone, rounded, for comparison with SQL."""
    six = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return p8_stats(spark, sf).select("doc_id", F.col("words").cast("long").alias("words"), six("mean_word_length"), six("symbol_share"), six("line_end_share"), six("common_share"), "not_prose")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The texts for which one of the statement's rules holds; the nearest profile is in ``p8_stats`` and does not decide here."""
    return p8_stats(spark, sf).filter("not_prose").select("doc_id")


_SEP = "[ \\t\\r\\n\u00a0]"
_P8 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_SEP}+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r\\n\u00a0]')) AS l,
             length(regexp_replace(text, '{_SEP}', '', 'g')) AS chars,
             length(regexp_replace(text, '[^#$%&*+/<=>@\\\\^_|~{{}}\\[\\]•]', '', 'g')) AS sym FROM t),
c AS (SELECT doc_id, len(w) AS words, chars, sym, len(l) AS lines,
             len(list_filter(l, lambda x: regexp_matches(x, '[.!?…;:]{_SEP}*\\z'))) AS ended,
             len(list_filter(w, lambda x: list_contains(cw, trim(lower(x), '.,;:!?…"''()[]«»¿¡–—')))) AS common FROM w, (SELECT list(DISTINCT word) AS cw FROM common_words)),
s AS (SELECT doc_id, words, lines, CASE WHEN words > 0 THEN chars::DOUBLE / words END AS mwl, CASE WHEN chars > 0 THEN sym::DOUBLE / chars END AS ss,
             CASE WHEN lines > 0 THEN ended::DOUBLE / lines END AS le, CASE WHEN words > 0 THEN common::DOUBLE / words END AS cs FROM c),
f AS (SELECT *, words < 3 OR coalesce(mwl < 2.5 OR mwl > 11, FALSE) OR coalesce(ss > 0.08, FALSE) OR (lines >= 3 AND coalesce(le < 0.5, FALSE)) OR coalesce(cs < 0.1, FALSE) AS not_prose FROM s)
"""
P8_FOUND = _P8 + "SELECT doc_id FROM f WHERE not_prose"
P8_COUNTS = (
    _P8
    + """SELECT doc_id, words, floor(mwl * 1e6 + 0.5) / 1e6 AS mean_word_length, floor(ss * 1e6 + 0.5) / 1e6 AS symbol_share,
floor(le * 1e6 + 0.5) / 1e6 AS line_end_share, floor(cs * 1e6 + 0.5) / 1e6 AS common_share, not_prose FROM f"""
)


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p2_share": p2_share,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_lists": p4_lists,
        "p6_found": p6_found,
        "p6_pack": p6_pack,
        "p6_audit": p6_audit,
        "p7_found": p7_found,
        "p8_found": p8_found,
        "p8_counts": p8_counts,
        "p8_stats": p8_stats,
        "p8_profiles": p8_profiles,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p2_found": P2_FOUND,
        "p2_share": P2_SHARE,
        "p3_found": P3_FOUND,
        "p4_found": P4_FOUND,
        "p6_found": P6_FOUND,
        "p6_audit": P6_AUDIT,
        "p7_found": P7_FOUND,
        "p8_found": P8_FOUND,
        "p8_counts": P8_COUNTS,
    }
