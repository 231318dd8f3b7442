"""SQL twins of the corpus queries that SQL can express, for a brute-force comparison."""

from __future__ import annotations

import string

from salesloom.llm import decontamination, merkle, secret_scan, spelling

_LOWER = (
    f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
)
_SPACE = r"[\x20\x09-\x0D]+"


def _runs(words: str, size: str) -> str:
    return (
        f"list_transform(range(1, greatest(len({words}) - {size} + 2, 1)), "
        f"lambda i: array_to_string({words}[i : i + {size} - 1], ' '))"
    )


def _bare(text: str) -> str:
    """Words without the signs at their ends; words of signs only go."""
    parts = f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda x: x <> '')"
    trimmed = f"list_transform({parts}, lambda x: regexp_replace(x, '{decontamination.SIGNS}', '', 'g'))"
    return f"list_filter({trimmed}, lambda x: x <> '')"


_ANSWER = "CASE WHEN contains(low, chr(10)) THEN substr(low, instr(low, chr(10)) + 1) ELSE '' END"

# Every item whose question and answer runs occur in a document, without retrieval. An
# item of few words is one part.
DECONTAMINATION = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS n, doc_id, {_bare(_LOWER)} AS words
  FROM documents),
item AS (
  SELECT row_number() OVER () AS m, item_id, {_LOWER} AS low FROM benchmark),
cut AS (
  SELECT m, item_id, {_bare("split_part(low, chr(10), 1)")} AS question, {_bare(_ANSWER)} AS answer FROM item),
part AS (
  SELECT m, item_id, 1 AS k,
         CASE WHEN len(question) + len(answer) < {decontamination.LEAST_WORDS}
              THEN list_concat(question, answer) ELSE question END AS words FROM cut
  UNION ALL
  SELECT m, item_id, 2, answer FROM cut WHERE len(question) + len(answer) >= {decontamination.LEAST_WORDS}),
sized AS (
  SELECT m, item_id, k, least(len(words), 5) AS size, words FROM part WHERE len(words) > 0),
part_run AS (
  SELECT DISTINCT m, item_id, k, size, unnest({_runs("words", "size")}) AS run FROM sized),
part_size AS (SELECT m, item_id, k, count(*) AS runs FROM part_run GROUP BY ALL),
doc_run AS (
  SELECT DISTINCT n, doc_id, s.size, unnest({_runs("words", "s.size")}) AS run
  FROM doc, (SELECT DISTINCT size FROM sized) s),
hit AS (
  SELECT d.n, d.doc_id, p.m, p.item_id, p.k, count(*) AS shared
  FROM doc_run d JOIN part_run p USING (size, run) GROUP BY ALL),
scored AS (
  SELECT n, doc_id, m, item_id, k, shared / runs AS overlap
  FROM hit JOIN part_size USING (m, item_id, k) WHERE shared / runs >= 0.8),
need AS (SELECT m, count(*) AS parts FROM part_size GROUP BY m)
SELECT doc_id, item_id,
       round(max(CASE WHEN k = 1 THEN overlap END), 6) AS question_overlap,
       round(max(CASE WHEN k = 2 THEN overlap END), 6) AS answer_overlap
FROM scored JOIN need USING (m)
GROUP BY n, doc_id, m, item_id, parts HAVING count(*) = parts
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(kind: str, pattern: str, group: int = 0, keep: str = "true") -> str:
    """Spans of one pattern: starts from the lengths of the texts between matches."""
    rank = secret_scan.KINDS.index(kind)
    p = _quoted(pattern)
    return f"""
  SELECT n, {rank} AS rank, '{kind}' AS kind, start, start + len(whole) AS stop, value FROM (
    SELECT n, whole, value,
           sum(len(gap) + len(whole)) OVER (PARTITION BY n ORDER BY i) - len(whole) AS start
    FROM (SELECT n, unnest(range(1, len(w) + 1)) AS i, unnest(g[1:len(w)]) AS gap, unnest(w) AS whole,
                 unnest(v) AS value
          FROM (SELECT n, regexp_split_to_array(body, {p}) AS g, regexp_extract_all(body, {p}, 0) AS w,
                       regexp_extract_all(body, {p}, {group}) AS v
                FROM doc WHERE regexp_matches(body, {p}))))
  WHERE {keep}"""


def _high() -> str:
    tests = []
    for _, alphabet, window, least in secret_scan.CLASSES:
        width = f"least(len(value), {window})"
        tests.append(
            f"""(translate(value, {_quoted(alphabet)}, '') = '' AND
     list_max(list_transform(range(1, len(value) - {width} + 2), lambda i:
       list_aggregate(string_split(substr(value, i, {width}), ''), 'entropy')))
     >= {least} * log2({width}) / log2({window}))"""
        )
    return " OR ".join(tests)


_ALLOWED = " AND ".join(f"NOT regexp_matches(value, {_quoted(p)})" for p in secret_scan.ALLOWED)

SECRETS = f"""
WITH doc AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS body FROM documents),
base AS (
  {_found("assign", secret_scan.ASSIGN, 2, f"len(value) >= {secret_scan.SHORTEST_VALUE}")}
  UNION ALL {_found("access", secret_scan.ACCESS)}
  UNION ALL {_found("hex", secret_scan.HEX)}),
candidate AS ({_found("entropy", secret_scan.CANDIDATE)}),
extra AS (
  SELECT * FROM candidate
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND {_ALLOWED} AND ({_high()})),
free AS (
  SELECT e.* FROM extra e
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.n = e.n AND b.start < e.stop AND e.start < b.stop)),
every AS (SELECT n, rank, kind, start, stop FROM base UNION ALL SELECT n, rank, kind, start, stop FROM free),
listed AS (
  SELECT n, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
         count(*) FILTER (rank = 2) AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ','
                    ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ','
                    ORDER BY start, rank) AS spans
  FROM every GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM doc LEFT JOIN listed USING (n)
"""


def _crc_table() -> list[int]:
    """The 256 steps of the reflected CRC-32 polynomial."""
    steps = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ 0xEDB88320 if value & 1 else value >> 1
        steps.append(value)
    return steps


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text whose code points are below 2048."""
    codes = f"list_transform(string_split({text}, ''), lambda c: unicode(c))"
    two = "[192 | (u >> 6), 128 | (u & 63)]"
    codes = f"flatten(list_transform({codes}, lambda u: CASE WHEN u < 128 THEN [u] ELSE {two} END))"
    steps = f"{_crc_table()}::BIGINT[]"
    folded = (
        f"list_reduce(list_transform({codes}, lambda b: b::BIGINT), "
        f"lambda c, b: xor(c >> 8, ({steps})[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)"
    )
    return f"xor({folded}, 4294967295::BIGINT)"


# Pairs at one edit by another way: equal words after one place is blanked, or one letter goes.
SPELLING = f"""
WITH RECURSIVE run AS (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
                                     '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE len(run) >= {spelling.LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, times, {_crc32("id || ':' || run")} AS h FROM run),
occurrence AS (
  SELECT CASE WHEN h % {spelling.DROP_EVERY} = 0
              THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, times
  FROM hashed),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM occurrence
  WHERE len(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {spelling.LEAST_COUNT}),
gone AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS low, substr(word, i + 1) AS high
  FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gone a JOIN gone b USING (i, low, high) WHERE a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN words w ON w.word = g.low || g.high
  UNION SELECT w.word, g.word, g.n FROM gone g JOIN words w ON w.word = g.low || g.high),
best AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN near_n >= {spelling.RATIO} * w.n THEN near END AS form,
         CASE WHEN near_n >= {spelling.RATIO} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
chain AS (
  SELECT word, word AS reached, 0 AS depth FROM formed
  UNION ALL SELECT c.word, f.form, c.depth + 1 FROM chain c JOIN formed f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n
FROM formed JOIN (SELECT word, arg_max(reached, depth) AS root FROM chain GROUP BY word) USING (word)
"""


def _written(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    columns = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(_written(c) for c in columns) + ")"


# Trees level by level. A tree is named by k: that of a language, or -1 over the languages.
MANIFEST = f"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS id, doc_id, {_leaf("n_chars")} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % {merkle.TAMPER_EVERY} = 0
              THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS seen,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY k) AS total FROM doc),
low AS (
  SELECT k, 0 AS level, i, total, leaf AS digest FROM placed
  UNION ALL
  SELECT k, level + 1, i // 2, (total + 1) // 2, sha256(digest || coalesce(beside, ''))
  FROM (SELECT *, lead(digest) OVER (PARTITION BY k, level ORDER BY i) AS beside FROM low WHERE total > 1)
  WHERE i % 2 = 0),
subroots AS (SELECT k, digest AS subroot FROM low WHERE total = 1),
high AS (
  SELECT -1 AS k, 0 AS level, k AS i, (SELECT count(*) FROM subroots) AS total, subroot AS digest FROM subroots
  UNION ALL
  SELECT k, level + 1, i // 2, (total + 1) // 2, sha256(digest || coalesce(beside, ''))
  FROM (SELECT *, lead(digest) OVER (PARTITION BY level ORDER BY i) AS beside FROM high WHERE total > 1)
  WHERE i % 2 = 0),
steps AS (
  SELECT n.k, n.i, n.level, CASE WHEN n.i % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.digest, '') AS step
  FROM (SELECT * FROM low WHERE total > 1 UNION ALL SELECT * FROM high WHERE total > 1) n
  LEFT JOIN (SELECT * FROM low UNION ALL SELECT * FROM high) s
    ON s.k = n.k AND s.level = n.level AND s.i = xor(n.i, 1)),
up AS (
  SELECT p.id, list(s.step ORDER BY s.level) AS path
  FROM placed p JOIN steps s ON s.k = p.k AND s.i = p.i >> s.level GROUP BY p.id),
crown AS (
  SELECT r.k, list(s.step ORDER BY s.level) AS path
  FROM subroots r JOIN steps s ON s.k = -1 AND s.i = r.k >> s.level GROUP BY r.k),
whole AS (
  SELECT p.doc_id, p.leaf, p.seen, subroot, (SELECT digest FROM high WHERE total = 1) AS root,
         list_concat(coalesce(up.path, []), coalesce(crown.path, [])) AS path
  FROM placed p JOIN subroots USING (k) LEFT JOIN up USING (id) LEFT JOIN crown ON crown.k = p.k),
folded AS (
  SELECT *, CASE WHEN len(path) = 0 THEN seen ELSE list_reduce(path, lambda a, s: sha256(
    CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END), seen) END AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""
