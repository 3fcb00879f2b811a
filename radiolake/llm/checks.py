"""SQL checks of the native operators, built from the same tables of values."""

from __future__ import annotations

from radiolake.llm.licenses import COPYRIGHT_LINE, DIGESTS, EQUIVALENT, NOTICES
from radiolake.llm.quality import CHARS, CLASSES, COMMON_WORDS, N_WORDS
from radiolake.llm.quotes import _ATTRIBUTION


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    """Canonical text with its line breaks."""
    out = f"regexp_replace(lower(coalesce({column}, '')), {_text(COPYRIGHT_LINE)}, '', 'g')"
    for pattern, plain in EQUIVALENT:
        out = f"regexp_replace({out}, {_text(pattern)}, {_text(plain.replace('$', chr(92)))}, 'g')"
    return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def _lines(canonical: str) -> str:
    """Canonical lines of a text, as a list."""
    return f"list_filter(list_transform(string_split({canonical}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


def license_sql() -> str:
    known = ", ".join(f"({_text(i)}, {_text(t)})" for i, t in NOTICES)
    whole = ", ".join(f"({_text(i)}, {_text(g)})" for i, g in DIGESTS)
    return f"""
WITH k AS (
  SELECT g, min(i) AS license_id
  FROM (SELECT i, sha256(array_to_string({_lines(_canonical('t'))}, ' ')) AS g FROM (VALUES {known}) AS v(i, t)
    UNION ALL SELECT * FROM (VALUES {whole}) AS v(i, g))
  GROUP BY g),
t AS (SELECT DISTINCT doc_id, text, {_canonical('text')} AS c FROM documents),
d AS (SELECT doc_id, text, {_lines('c')} AS l,
    list_filter(list_transform(regexp_split_to_array(c, '\\n *\\n'), lambda x: trim(x, ' ' || chr(10))), lambda x: contains(x, chr(10))) AS p FROM t),
u AS (
  SELECT doc_id, text, 'line' AS kind, sha256(unnest(list_distinct(l))) AS g FROM d
  UNION ALL SELECT doc_id, text, 'paragraph', sha256(regexp_replace(unnest(p), ' *\\n *', ' ', 'g')) FROM d
  UNION ALL SELECT doc_id, text, 'whole', sha256(array_to_string(l, ' ')) FROM d WHERE len(l) > 0),
m AS (
  SELECT doc_id, text, max(license_id) FILTER (kind = 'whole') AS whole_license,
    array_to_string(list_sort(list(DISTINCT license_id)), ',') AS license_ids, count(DISTINCT g) FILTER (kind = 'line') AS n_lines
  FROM u JOIN k USING (g) GROUP BY doc_id, text)
SELECT d.doc_id, whole_license, coalesce(license_ids, '') AS license_ids, coalesce(n_lines, 0) AS n_lines
FROM d LEFT JOIN m ON d.doc_id IS NOT DISTINCT FROM m.doc_id AND d.text IS NOT DISTINCT FROM m.text
"""


def _distance(p: str, q: str, n: int) -> str:
    """Jensen-Shannon distance of two lists of counts; null where one is null or empty."""
    total = {h: "(" + " + ".join(f"{h}[{i}]" for i in range(1, n + 1)) + ")" for h in (p, q)}

    def part(a: str, b: str) -> str:
        return f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0e0 END)"

    terms = []
    for i in range(1, n + 1):
        x, y = (f"(CAST({h}[{i}] AS DOUBLE) / {total[h]})" for h in (p, q))
        terms += [f"({part(x, y)} + {part(y, x)})"]
    return f"CASE WHEN {total[p]} > 0 AND {total[q]} > 0 THEN sqrt(greatest(0e0, ({' + '.join(terms)}) / 2)) END"


def quality_sql(max_chars: float = 0.17, first_chars: float = 0.2, max_words: float = 0.6, min_chars: int = 400, min_words: int = 50) -> str:
    space = r"[\x20\x09-\x0D]"
    classes = ", ".join(f"length(t) - length(regexp_replace(t, {_text(p)}, '', 'g'))" for p in CLASSES.values())
    listed = " ".join(
        f"WHEN lang = {_text(lang)} THEN [{', '.join(map(_text, words))}]" for lang, words in COMMON_WORDS.items()
    )
    known = f"CASE WHEN lang IN ({', '.join(map(_text, COMMON_WORDS))}) THEN lang ELSE '' END"

    def sums(name: str, n: int) -> str:
        return "[" + ", ".join(f"coalesce(sum({name}[{i}]), 0)" for i in range(1, n + 1)) + f"] AS ref_{name}"

    def references(rows: str) -> str:
        return f"""SELECT ref, {sums('chars', len(CHARS))}, {sums('common', N_WORDS + 1)} FROM {rows} WHERE ref <> '' GROUP BY ref
  UNION ALL SELECT '', {sums('chars', len(CHARS))}, NULL FROM {rows}"""

    by_chars, by_words = _distance("chars", "ref_chars", len(CHARS)), _distance("common", "ref_common", N_WORDS + 1)
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    row_number() OVER () AS r FROM documents),
win AS (SELECT r, i, list_slice(w, i, i + 4) AS x FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) > 5)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1) GROUP BY r),
a AS (
  SELECT t.r, doc_id, lang, {known} AS ref, len(w) AS n_words, length(t) AS n_chars, length(regexp_replace(t, '{space}+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, [{classes}] AS c, w, CASE {listed} END AS words
  FROM t LEFT JOIN rep USING (r)),
b AS (
  SELECT * EXCLUDE (c, w, words), list_append(c, n_chars - list_sum(c)) AS chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    list_transform(words, lambda v: len(list_filter(w, lambda x: x = v))) AS k FROM a),
m AS (SELECT * EXCLUDE (k), CASE WHEN k IS NOT NULL THEN list_append(k, n_words - list_sum(k)) END AS common FROM b),
good AS (SELECT * FROM m WHERE NOT base_failed),
ref1 AS ({references('good')}),
near AS (SELECT * FROM (SELECT good.*, {by_chars} AS d FROM good JOIN ref1 USING (ref)) WHERE NOT coalesce(n_chars >= {min_chars} AND d > {first_chars}, FALSE)),
ref2 AS ({references('near')}),
j AS (SELECT m.*, {by_chars} AS cd, {by_words} AS wd FROM m LEFT JOIN ref2 USING (ref))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_chars >= {min_chars} AND cd > {max_chars}, FALSE) AND NOT coalesce(n_words >= {min_words} AND wd > {max_words}, FALSE) AS kept,
  round(cd, 9) AS char_distance, round(wd, 9) AS word_distance
FROM j
"""


def reply_sql() -> str:
    quoted, marks = r"'^\s{0,3}>'", r"'^\s{0,3}(?:>\s?)+'"

    def normal(column: str) -> str:
        return rf"trim(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"

    return rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, CAST(turn AS INT) AS turn, role, text FROM conversations),
l AS (SELECT r, conv_id, turn, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM m WHERE text IS NOT NULL),
q AS (SELECT *, regexp_matches(line, {quoted}) AS quoted, coalesce(lead(regexp_matches(line, {quoted})) OVER (PARTITION BY r ORDER BY i), FALSE) AS next_quoted,
    length(regexp_extract(line, {marks})) - length(replace(regexp_extract(line, {marks}), '>', '')) AS level FROM l),
own AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT quoted AND NOT (next_quoted AND regexp_matches(line, {_text(_ATTRIBUTION)}))), '') AS body
  FROM q GROUP BY r HAVING bool_or(quoted)),
b AS (SELECT m.*, CASE WHEN own.r IS NULL THEN coalesce(text, '') ELSE trim(own.body, ' ' || chr(9) || chr(13) || chr(10)) END AS body FROM m LEFT JOIN own USING (r)),
o AS (SELECT *, min(parent) OVER (PARTITION BY conv_id, u) AS first FROM (
    SELECT DISTINCT conv_id, turn AS parent, {normal('x')} AS u FROM (
      SELECT conv_id, turn, unnest(list_distinct([body] || regexp_split_to_array(body, '\n\s*\n') || string_split(body, chr(10)))) AS x FROM b WHERE turn IS NOT NULL))
  WHERE u <> ''),
c AS (SELECT *, level IS DISTINCT FROM lag(level) OVER (PARTITION BY r ORDER BY i) AS change FROM q),
g AS (SELECT *, sum(change::INT) OVER (PARTITION BY r ORDER BY i) AS passage FROM c),
p AS (SELECT DISTINCT conv_id, turn, text, level, passage, t FROM (
    SELECT conv_id, turn, text, level, passage, string_agg(regexp_replace(line, {marks}, ''), chr(10) ORDER BY i) AS t FROM g WHERE level > 0 GROUP BY r, conv_id, turn, text, level, passage)),
u AS (SELECT conv_id, turn, text, level, {normal('x')} AS u FROM (
    SELECT conv_id, turn, text, level, passage, unnest(list_distinct([t] || regexp_split_to_array(t, '\n\s*\n') || string_split(t, chr(10)))) AS x FROM p)),
k AS (SELECT u.conv_id, turn, level, parent, sum(len(string_split(u, ' '))) AS words, sum(CASE WHEN parent = first THEN len(string_split(u, ' ')) ELSE 0 END) AS first_words
  FROM u JOIN o USING (conv_id, u) WHERE u <> '' AND parent < turn GROUP BY u.conv_id, turn, text, level, parent),
best AS (SELECT conv_id, turn, arg_min(parent, struct_pack(a := level, b := -words, c := -first_words, d := -parent)) AS parent FROM k GROUP BY conv_id, turn),
w AS (SELECT DISTINCT conv_id, turn, turn AS root, [turn] AS path FROM m ANTI JOIN best USING (conv_id, turn) WHERE turn IS NOT NULL AND conv_id IS NOT NULL
  UNION ALL SELECT best.conv_id, best.turn, w.root, list_append(w.path, best.turn) FROM best JOIN w ON best.conv_id = w.conv_id AND best.parent = w.turn)
SELECT b.conv_id, b.turn, role, body, best.parent AS parent_turn, coalesce(w.root, b.turn) AS root_turn,
  CAST(greatest(coalesce(len(w.path), 1) - 1, 0) AS INT) AS depth,
  CASE WHEN b.turn IS NULL THEN '' ELSE array_to_string(coalesce(w.path, [b.turn]), '/') END AS reply_path
FROM b LEFT JOIN best ON b.conv_id = best.conv_id AND b.turn = best.turn LEFT JOIN w ON b.conv_id = w.conv_id AND b.turn = w.turn
"""
