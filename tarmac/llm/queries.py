"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from tarmac.llm.ann import op6_approximate_nearest_neighbours
from tarmac.llm.decontam import op5_benchmark_decontamination
from tarmac.llm.html_extract import op8_html_extraction
from tarmac.llm.infill import op12_fill_in_middle
from tarmac.llm.licenses import op2_license_scans
from tarmac.llm.lm_score import op4_lm_scoring
from tarmac.llm.merkle import op13_merkle_manifest
from tarmac.llm.mixing import op1_mixing_to_targets
from tarmac.llm.pii import op10_pii
from tarmac.llm.quality import op9_quality_classifier
from tarmac.llm.simhash import op3_simhash_near_dedup
from tarmac.llm.substrings import op11_substring_dedup
from tarmac.llm.tokens import op7_token_counts


def base_of_op2(spark, sf_dir):
    """The columns of op2 that SQL can express."""
    return op2_license_scans(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_of_op10(spark, sf_dir):
    """The counts and places of op10's base spans."""
    return op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def base_of_op7(spark, sf_dir):
    """Bytes by document, and how many documents share a text, from op7."""
    return op7_token_counts(spark, sf_dir, copies=True).select("doc_id", "n_bytes", "copies")


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing_to_targets, op2_license_scans, op3_simhash_near_dedup, op4_lm_scoring, op5_benchmark_decontamination,
        op6_approximate_nearest_neighbours, op7_token_counts, op8_html_extraction, op9_quality_classifier, op10_pii,
        op11_substring_dedup, op12_fill_in_middle, op13_merkle_manifest,
    )
}

QUERIES |= {f.__name__: f for f in (base_of_op2, base_of_op7, base_of_op10)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LUHN = "list_sum(list_transform(generate_series(1, length(d)), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(d), i, 1) AS INTEGER) WHEN CAST(substr(reverse(d), i, 1) AS INTEGER) > 4 THEN 2 * CAST(substr(reverse(d), i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(reverse(d), i, 1) AS INTEGER) END)) % 10 = 0"


def _matches(name: str, kind: str, pattern: str, check: str) -> str:
    """A named subquery: matches of a pattern (as m, its digits as d) that pass a check, with their places.

    Matches are set between two control characters, and a place is the length of all that stands before, without these.
    """
    return f"""{name} AS (SELECT doc_id, '{kind}' AS kind, s, s + length(m) AS z FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (
      SELECT doc_id, split_part(ps[i], chr(2), 1) AS m, CAST(list_sum(list_transform(ps[1 : i - 1], lambda x: length(x))) AS BIGINT) - (i - 2) AS s FROM (
        SELECT doc_id, ps, unnest(generate_series(2, len(ps))) AS i FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM documents)))) WHERE {check})"""


#: Lowest bit of the CRC-32 of a string of digits: bytes are folded in one by one, bit by bit, by the reversed polynomial.
_CRC_ODD = "(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, b: xor(r >> 1, (r & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) & 1)"
_SUMMED = "sha256(concat(" + ", ".join(f"coalesce(concat(strlen(CAST({{{c}}} AS VARCHAR)), ':', CAST({{{c}}} AS VARCHAR)), '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")) + "))"
_NAMES = {c: c for c in ("doc_id", "source", "lang", "n_chars", "text")}

#: What SQL can express of the operators: all of op11 to op13, of the others their base columns.
ORACLE_SQL: dict[str, str] = {
    "op11_substring_dedup": r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
      windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)),
      earlier AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE doc_id > least),
      gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(generate_series(i, i + 12)) AS p FROM earlier) GROUP BY 1),
      kept AS (SELECT doc_id, ws, coalesce(len(ps), 0) AS n_removed, CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS ks FROM w LEFT JOIN gone USING (doc_id))
      SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256 FROM kept""",
    "op12_fill_in_middle": r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256(concat('1:', doc_id)) AS h FROM documents),
      s AS (SELECT doc_id, t, us, CAST(len(us) AS BIGINT) AS n, [CAST(concat('0x', substr(h, 8 * k + 1, 8)) AS BIGINT) for k in [0, 1, 2, 3]] AS hs FROM u),
      c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b FROM s),
      p AS (SELECT *, coalesce(array_to_string(us[1 : a], ''), '') AS pre, coalesce(array_to_string(us[a + 1 : b], ''), '') AS mid, coalesce(array_to_string(us[b + 1 : n], ''), '') AS suf,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 90 THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_merkle_manifest": rf"""WITH RECURSIVE leaves AS (SELECT doc_id, source, {_SUMMED.format(**_NAMES)} AS leaf, {_SUMMED.format(**_NAMES | {"text": "replace(text, chr(10), '')"})} AS changed, {_CRC_ODD} = 0 AS tampered,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents),
      nodes AS (SELECT source, 0 AS level, place, leaf AS node, n FROM leaves
        UNION ALL SELECT source, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, place // 3),
      subroots AS (SELECT source, node, level, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
      tops AS (SELECT 0 AS level, place, node, n FROM subroots
        UNION ALL SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, place // 3),
      runs AS (SELECT source, level, place // 3 AS run, list(node ORDER BY place) AS members FROM nodes WHERE n > 1 GROUP BY ALL),
      top_runs AS (SELECT level, place // 3 AS run, list(node ORDER BY place) AS members FROM tops WHERE n > 1 GROUP BY ALL),
      steps AS (SELECT l.doc_id, r.level, r.members, (l.place // CAST(pow(3, r.level) AS BIGINT)) % 3 AS me FROM leaves l JOIN runs r ON l.source IS NOT DISTINCT FROM r.source AND l.place // CAST(pow(3, r.level + 1) AS BIGINT) = r.run
        UNION ALL SELECT l.doc_id, s.level + r.level, r.members, (s.place // CAST(pow(3, r.level) AS BIGINT)) % 3 FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN top_runs r ON s.place // CAST(pow(3, r.level + 1) AS BIGINT) = r.run),
      sides AS (SELECT doc_id, level, coalesce(array_to_string(members[1 : me], ''), '') AS l, coalesce(array_to_string(members[me + 2 : 3], ''), '') AS r FROM steps),
      proofs AS (SELECT doc_id, string_agg(concat(l, r), '' ORDER BY level) AS proof, list(concat(l, '|', r) ORDER BY level) AS ways FROM sides GROUP BY 1),
      ends AS (SELECT l.doc_id, leaf, s.node AS subroot, t.node AS root, sha256(coalesce(proof, '')) AS proof_sha256, list_reduce(list_prepend(CASE WHEN tampered THEN changed ELSE leaf END, coalesce(ways, [])), lambda a, w: sha256(concat(split_part(w, '|', 1), a, split_part(w, '|', 2)))) AS folded_root
        FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN tops t ON t.n = 1 LEFT JOIN proofs USING (doc_id))
      SELECT *, folded_root = root AS verified FROM ends""",
    "base_of_op2": rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
      p AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM w), (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) t(phrase, label) WHERE ws[i : i + len(phrase) - 1] = phrase),
      g AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY 1)
      SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)""",
    "base_of_op7": r"""SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, count(*) OVER (PARTITION BY regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')) AS copies FROM documents""",
    "base_of_op10": "WITH " + ", ".join([
        _matches("e", "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _matches("i", "ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(m, '.'), lambda x: CAST(x AS DOUBLE) <= 255))"),
        _matches("c", "card", r"[0-9](?:[ -]?[0-9])+", f"CASE WHEN length(d) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END"),
        _matches("p", "phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
    ]) + """, spans AS (SELECT * FROM e UNION ALL SELECT * FROM i UNION ALL SELECT * FROM c UNION ALL SELECT * FROM p)
      SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
        sha256(coalesce(string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(z AS VARCHAR), ',' ORDER BY s, list_position(['email', 'ip', 'card', 'phone'], kind)), '')) AS base_sha256 FROM documents LEFT JOIN spans USING (doc_id) GROUP BY 1""",
}
