"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

import math

from tradewind.llm import quality, warc

_SPACE = r"[\x20\x09-\x0D]+"

_WORDS = f"""words AS (
    SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS ws
    FROM documents),
places AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM words)"""


def _runs(size: int) -> str:
    """Runs of size words: doc_id, i (place of the first), g."""
    return f"""SELECT doc_id, i, array_to_string(ws[i : i + {size - 1}], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {size - 2})) AS i FROM words)"""


def _substring() -> str:
    return f"""WITH {_WORDS},
        runs AS ({_runs(13)}),
        hits AS (SELECT doc_id, i FROM runs QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
        gone AS (SELECT DISTINCT doc_id, i + j AS k FROM hits CROSS JOIN range(13) r(j)),
        kept AS (
            SELECT p.doc_id, count(g.k) AS n_removed, string_agg(p.word, ' ' ORDER BY p.k) FILTER (WHERE g.k IS NULL) AS t
            FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.k = g.k GROUP BY p.doc_id)
        SELECT w.doc_id, len(w.ws) AS n_words, coalesce(x.n_removed, 0) AS n_removed,
            sha256(coalesce(x.t, '')) AS kept_sha256
        FROM words w LEFT JOIN kept x ON w.doc_id = x.doc_id"""


def _quality() -> str:
    gamma = quality.GAMMA
    cases = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{m}' AS measure, {how} AS v "
        "FROM stats WHERE n_words > 0"
        for m, (how, _, _) in quality.MEASURES.items()
    )
    bounds = " UNION ALL ".join(
        f"SELECT '{m}' AS measure, {spread} AS spread, {str(low).lower()} AS low"
        for m, (_, spread, low) in quality.MEASURES.items()
    )

    def level(keys: str) -> str:
        group = f"{keys}measure"
        q = ", ".join(
            f"min(CASE WHEN upto >= {p} * total THEN value END) AS q{i}" for i, p in enumerate((0.25, 0.5, 0.75))
        )
        return f"""SELECT {group}, max(total) AS total, {q} FROM (
            SELECT {group}, CASE WHEN bucket IS NULL THEN 0 ELSE 2 * pow({gamma}, bucket) / ({gamma} + 1) END AS value,
                sum(n) OVER (PARTITION BY {group} ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {group}) AS total
            FROM (SELECT {group}, bucket, count(*) AS n FROM buckets GROUP BY {group}, bucket)) GROUP BY {group}"""

    def pick(i: int) -> str:
        least = quality.MIN_GROUP
        return f"CASE WHEN o.total >= {least} THEN o.q{i} WHEN l.total >= {least} THEN l.q{i} ELSE a.q{i} END"

    return f"""WITH {_WORDS},
        runs AS ({_runs(quality.WINDOW)}),
        twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice CROSS JOIN range({quality.WINDOW}) r(j) GROUP BY 1),
        sums AS (
            SELECT doc_id, sum(length(word)) AS chars, count(*) FILTER (WHERE word = before) AS stutter
            FROM (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM places) GROUP BY 1),
        lines AS (
            SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
            FROM documents),
        stats AS (
            SELECT d.doc_id, d.lang, d.source, len(w.ws) AS n_words, CAST(coalesce(s.chars, 0) AS BIGINT) AS word_chars,
                length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                CAST(len(x.ls) - len(list_distinct(x.ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
                len(x.ls) AS n_lines, coalesce(s.stutter, 0) AS n_stutter
            FROM documents d JOIN words w ON w.doc_id = d.doc_id JOIN lines x ON x.doc_id = d.doc_id
            LEFT JOIN sums s ON s.doc_id = d.doc_id LEFT JOIN repeated r ON r.doc_id = d.doc_id),
        measured AS ({cases}),
        buckets AS (SELECT *, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / {math.log(gamma)!r}) AS BIGINT) END AS bucket FROM measured),
        fences AS (
            SELECT o.lang, o.source, o.measure, {pick(1)} + {quality.FENCE} * greatest({pick(1)} - {pick(0)}, b.spread) AS high,
                CASE WHEN b.low THEN {pick(1)} - {quality.FENCE} * greatest({pick(2)} - {pick(1)}, b.spread) ELSE 0 END AS low
            FROM ({level('lang, source, ')}) o JOIN ({level('lang, ')}) l
                ON l.measure = o.measure AND l.lang IS NOT DISTINCT FROM o.lang
            JOIN ({level('')}) a ON a.measure = o.measure JOIN ({bounds}) b ON b.measure = o.measure),
        fits AS (
            SELECT m.doc_id, bool_and(m.v BETWEEN f.low AND f.high) AS fits FROM measured m JOIN fences f
                ON f.measure = m.measure AND f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source
            GROUP BY 1)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND coalesce(fits, false) AS kept
        FROM (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words
              AS base_failed FROM stats) LEFT JOIN fits USING (doc_id)"""


def _warc() -> str:
    again = f"payload_bytes >= {warc.LEAST_REVISIT} AND page_id > first"
    return f"""SELECT page_id, payload_bytes, payload_digest, CASE WHEN {again} THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN {again} THEN first END AS refers_to
        FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages))"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _substring(), "op2_quality_rules": _quality(), "op4_warc_bundles": _warc()}
