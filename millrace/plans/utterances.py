"""Queries over utterances: one row for each, and none that is protected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import utterances
from .registry import query, table


@query(
    f"""
    WITH RECURSIVE b AS (SELECT doc_id, doc_id % 7 = 3 AS held, doc_id % 11 = 0 AS ext, (n_chars % 100) / 100 AS cer, strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss')) AS cap, doc_id % 5 = 3 OR doc_id % 13 = 5 AS many,
        CASE doc_id % 5 WHEN 0 THEN 'en001_' || doc_id || '_video' || lpad((doc_id // 100)::VARCHAR, 6, '0') || '_' || doc_id % 100 // 5 * 2 || '_0_5_0' || CASE WHEN doc_id % 3 = 1 THEN '_p1' ELSE '' END WHEN 1 THEN 'row_' || doc_id || '_20180618-09:00:00_' || doc_id // 15
            WHEN 2 THEN '20180618-0900-PLENARY-' || doc_id // 50 || '-en_' || doc_id WHEN 3 THEN 'fleurs_' || doc_id || '_1' ELSE 'row' || doc_id END AS id,
        CASE WHEN doc_id % 5 = 0 THEN doc_id // 100 END AS video, doc_id % 100 // 5 * 2 + CASE WHEN doc_id % 3 = 1 THEN 1.5 ELSE 0 END AS s, doc_id % 100 // 5 * 2 + CASE WHEN doc_id % 3 = 1 THEN 4 ELSE 5 END AS e, CASE WHEN doc_id % 5 = 1 THEN doc_id // 15 END AS vox, CASE WHEN doc_id % 5 = 2 THEN doc_id // 50 END AS gv FROM documents),
    w AS (SELECT *, list_filter(list_transform(regexp_extract_all(cap, '[^\\s]+'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> '') AS words, len(regexp_extract_all(cap, '[^\\s]+')) AS nw FROM b),
    f AS (SELECT *, CASE WHEN len(array_to_string(words, '')) >= 20 AND nw >= 4 THEN array_to_string(words, '') END AS tk, list_sort(regexp_extract_all(cap, '[0-9]+')) AS nums FROM w),
    s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 2, 1) + 1), lambda i: array_to_string(words[i:i+2], ' '))) AS sh FROM f WHERE len(words) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
    p AS (SELECT a, b, c, x.n AS na, y.n AS nb FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b),
    r AS (SELECT 'audio_vox' AS name, x.doc_id AS a, y.doc_id AS b FROM f x JOIN f y ON x.vox = y.vox AND x.doc_id <> y.doc_id
        UNION ALL SELECT 'audio_yt', x.doc_id, y.doc_id FROM f x JOIN f y ON x.video = y.video AND x.doc_id <> y.doc_id AND least(x.e, y.e) - greatest(x.s, y.s) > 0.5 * least(x.e - x.s, y.e - y.s)
        UNION ALL SELECT 'text', x.doc_id, y.doc_id FROM f x JOIN f y ON x.tk = y.tk AND x.doc_id <> y.doc_id
        UNION ALL SELECT 'session_text', a, b FROM p JOIN f x ON x.doc_id = a JOIN f y ON y.doc_id = b WHERE x.gv = y.gv AND least(na, nb) >= 3 AND c >= 0.5 * least(na, nb)
        UNION ALL SELECT 'near_text', a, b FROM p JOIN f x ON x.doc_id = a JOIN f y ON y.doc_id = b WHERE x.tk IS NOT NULL AND y.tk IS NOT NULL AND 5 * c >= 4 * (na + nb - c)),
    h AS (SELECT b AS doc_id, min(list_position(['audio_vox', 'audio_yt', 'session_text', 'text', 'near_text'], name)) AS k FROM r JOIN f x ON x.doc_id = a JOIN f y ON y.doc_id = b WHERE x.held AND NOT y.held GROUP BY b),
    l AS (SELECT f.*, row_number() OVER (ORDER BY ext, cer, id) AS rn FROM f WHERE NOT held AND doc_id NOT IN (SELECT doc_id FROM h)),
    e AS (SELECT y.rn, x.rn AS before, name FROM r JOIN l x ON x.doc_id = a JOIN l y ON y.doc_id = b WHERE x.rn < y.rn AND NOT (name IN ('text', 'near_text') AND (x.many OR y.many)) AND NOT (name = 'near_text' AND x.nums <> y.nums)),
    m AS (SELECT rn, list(DISTINCT before) AS before FROM e GROUP BY rn), q AS (SELECT l.rn, before FROM l LEFT JOIN m USING (rn)),
    g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT i + 1, CASE WHEN before IS NOT NULL AND list_has_any(kept, before) THEN kept ELSE list_append(kept, i + 1) END FROM g JOIN q ON q.rn = i + 1),
    k AS (SELECT unnest(kept) AS rn FROM g WHERE i = (SELECT max(i) FROM g)),
    d AS (SELECT e.rn, min(list_position(['audio_vox', 'audio_yt', 'text', 'session_text', 'near_text'], name)) AS k FROM e WHERE before IN (SELECT rn FROM k) AND e.rn NOT IN (SELECT rn FROM k) GROUP BY e.rn)
    SELECT f.id, CASE WHEN h.k IS NOT NULL THEN 'heldout_' || ['audio_vox', 'audio_yt', 'session_text', 'text', 'near_text'][h.k] WHEN d.k IS NOT NULL THEN 'dup_' || ['audio_vox', 'audio_yt', 'text', 'session_text', 'near_text'][d.k] END AS reason
    FROM f LEFT JOIN h USING (doc_id) LEFT JOIN l ON l.doc_id = f.doc_id LEFT JOIN d ON d.rn = l.rn WHERE NOT f.held
    """
)
def deduped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as utterances of five kinds, a seventh of them protected: the first reason for which each goes."""
    d, t = F.col("doc_id"), lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    video = t("en001_", d, "_video", F.lpad(F.floor(d / 100).cast("string"), 6, "0"), "_", (F.floor(d % 100 / 5) * 2), "_0_5_0", F.when(d % 3 == 1, "_p1").otherwise(""))
    name = F.when(d % 5 == 0, video).when(d % 5 == 1, t("row_", d, "_20180618-09:00:00_", F.floor(d / 15))).when(d % 5 == 2, t("20180618-0900-PLENARY-", F.floor(d / 50), "-en_", d)).when(d % 5 == 3, t("fleurs_", d, "_1")).otherwise(t("row", d))
    rank = F.struct((d % 11 == 0).alias("ext"), ((F.col("n_chars") % 100) / 100).alias("cer"), name.alias("id"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("id"), F.col("text").alias("caption"), rank.alias("rank"), F.when((d % 5 == 0) & (d % 3 == 1), F.array(F.lit(1.5), F.lit(4.0))).alias("piece"), F.when(d % 13 == 5, "fleurs").otherwise("other").alias("src"))
    return utterances.deduped(rows.where("doc_id % 7 <> 3").drop("doc_id"), rows.where("doc_id % 7 = 3").drop("doc_id"))
