"""SQL, for DuckDB, that gives the rows of those operators' queries that SQL can express, by comparing everything."""

from __future__ import annotations

from .licenses import PHRASES, STOP_WORDS, TEMPLATES
from .shared import LOWER, UPPER

COMPONENTS = """e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
r(doc, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.x, r.root FROM r JOIN e ON e.y = r.doc WHERE r.root < e.x),
c AS (SELECT doc, min(root) AS root FROM r GROUP BY 1)"""

#: All pairs of documents that share a shingle; links reach the smallest id.
OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * m >= 80 * (a.n + b.n - m)),
{COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.doc = d.doc_id
"""

#: All pairs of vectors of a label.
OP5_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT vec_id, label, list_transform(v, lambda x: coalesce(x, 0)) AS v FROM v WHERE v IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
{COMPONENTS},
k AS (SELECT x, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.root, vec_id) AS component_id, coalesce(c.root, vec_id) = vec_id AS kept FROM v LEFT JOIN k ON k.x = vec_id LEFT JOIN c ON c.doc = vec_id
"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def op10_sql(rare: int = 12, least: float = 0.6) -> str:
    """Every occurrence of a template's words votes for its alignments; the words and weights follow from the documents."""
    words = [(t, label, k, w) for t, (label, notice, _) in enumerate(TEMPLATES) for k, w in enumerate(notice.split()) if w not in STOP_WORDS]
    keys = [(t, key) for t, (_, _, held) in enumerate(TEMPLATES) for key in held]
    base = [(label, k, part, len(phrase.split())) for phrase, label in PHRASES.items() for k, part in enumerate(phrase.split())]
    return rf"""
WITH tw(t, label, k, word) AS (VALUES {_values(words)}), tk(t, phrase) AS (VALUES {_values(keys)}), bp(label, k, part, n) AS (VALUES {_values(base)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM d),
b AS (SELECT doc_id, label, place - k AS place FROM x JOIN bp ON x.word = bp.part GROUP BY doc_id, label, place - k, n HAVING count(DISTINCT k) = n),
bb AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels, list(DISTINCT label) AS base_list FROM b GROUP BY 1),
f AS (SELECT word, count(DISTINCT doc_id) AS df FROM x WHERE word IN (SELECT word FROM tw) GROUP BY 1),
i AS (SELECT word, ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 1)) + 1e-6 AS idf FROM (SELECT DISTINCT word FROM tw) LEFT JOIN f USING (word)),
o AS (SELECT t, word, idf FROM (SELECT DISTINCT t, word FROM tw) JOIN i USING (word) QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC, word) <= {rare}),
kept AS (SELECT t, label, k, word, idf FROM tw JOIN o USING (t, word)),
total AS (SELECT t, sum(idf) AS total FROM kept GROUP BY 1),
h AS (SELECT doc_id, t FROM (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS j FROM d), tk GROUP BY doc_id, t HAVING bool_and(contains(j, ' ' || phrase || ' '))),
a AS (SELECT x.doc_id, kept.t, label, place - k AS place, sum(idf) AS weight FROM x JOIN kept USING (word) JOIN h ON h.doc_id = x.doc_id AND h.t = kept.t GROUP BY ALL),
m AS (SELECT doc_id, label, max(least(1, weight / total)) AS score FROM a JOIN total USING (t) GROUP BY 1, 2),
mm AS (SELECT doc_id, max(score) AS score, list(label) FILTER (score >= {least}) AS labels FROM m GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(labels, [])))), ','), '') AS labels, round(coalesce(score, 0), 9) AS score FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN mm USING (doc_id)
"""


#: Every window of an item's length that shares a shingle with it, compared exactly.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS size FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0),
ig AS (SELECT item_id, n, size, unnest(list_transform(range(n - size + 1), lambda k: array_to_string(w[k + 1:k + size], ' '))) AS g FROM i),
ic AS (SELECT item_id, n, size, g, count(*) AS c FROM ig GROUP BY ALL),
dg AS (SELECT doc_id, len(w) AS m, size, unnest(range(greatest(len(w) - size, 0) + 1)) AS p, unnest(list_transform(range(greatest(len(w) - size, 0) + 1), lambda k: array_to_string(w[k + 1:k + size], ' '))) AS g
  FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) > 0),
s AS (SELECT doc_id, item_id, m, n, ic.size, ic.g, c, unnest(range(greatest(p - n + ic.size, 0), least(p, greatest(m - n, 0)) + 1)) AS start FROM dg JOIN ic ON dg.g = ic.g AND dg.size = ic.size),
t AS (SELECT doc_id, item_id, m, n, size, start, least(count(*), c) AS k FROM s GROUP BY doc_id, item_id, m, n, size, start, g, c),
u AS (SELECT doc_id, item_id, n, start, sum(k) AS shared, greatest(least(n, m) - size, 0) + 1 + n - size + 1 - sum(k) AS either FROM t GROUP BY doc_id, item_id, m, n, size, start)
SELECT doc_id, item_id, CAST(shared AS DOUBLE) / CAST(either AS DOUBLE) AS similarity, start, n AS n_words FROM u WHERE 100 * shared >= 80 * either
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / either DESC, start) = 1
"""


def crc_table() -> list[int]:
    """The table of CRC-32 by its rule: eight shifts of each byte, with the reversed polynomial where a one falls out."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


def sql_crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text of ASCII characters."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = f"xor(c >> 8, {crc_table()}[CAST(xor(c, b) & 255 AS INTEGER) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}), 4294967295)"


def op13_sql(levels: int = 6) -> str:
    """Trees of up to 16^levels leaves, one WITH step for each level of the sources' trees and of the tree over sources."""
    framed = lambda names: " || ".join(f"coalesce(strlen({n}) || ':' || {n}, '-')" for n in names)
    text = "CAST({} AS VARCHAR)".format
    names = [text("doc_id"), "source", "lang", text("n_chars")]
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"d AS (SELECT *, sha256({framed([*names, 'text'])}) AS leaf, sha256({framed([*names, lower])}) AS low, coalesce('1' || source, '0') AS k FROM documents)",
        f"l0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS m, leaf AS h, doc_id, leaf, CASE WHEN {sql_crc32(text('doc_id'))} % 5 = 0 THEN low ELSE leaf END AS other FROM d)",
    ]
    for tree in "lt":
        if tree == "t":
            subs = " UNION ALL ".join(f"SELECT k, h FROM l{x} WHERE m = 1" for x in range(levels + 1))
            out.append(f"t0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS m, h, k AS of FROM ({subs}))")
        for x in range(levels):
            out.append(f"{tree}{x + 1} AS (SELECT k, i // 16 AS i, (max(m) + 15) // 16 AS m, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {tree}{x} WHERE m > 1 GROUP BY k, i // 16)")
            side = "coalesce(string_agg(h, '') OVER (PARTITION BY k, i // 16 ORDER BY i ROWS BETWEEN {} AND {}), '')".format
            out.append(f"{tree}s{x} AS (SELECT k, i, {side('UNBOUNDED PRECEDING', '1 PRECEDING')} AS l, {side('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS r FROM {tree}{x} WHERE m > 1)")
    out.append("root AS (" + " UNION ALL ".join(f"SELECT h AS root FROM t{x} WHERE m = 1" for x in range(levels + 1)) + ")")
    out.append("f0 AS (SELECT l0.doc_id, l0.leaf, l0.k, l0.i, l0.i AS j, l0.other AS now, '' AS beside, t0.i AS ti, t0.h AS subroot FROM l0 JOIN t0 ON l0.k = t0.of)")
    for x in range(2 * levels):
        tree, at = ("l", "j") if x < levels else ("t", "ti")
        key = "f.k" if tree == "l" else "''"
        out.append(f"f{x + 1} AS (SELECT f.* REPLACE ({at} // 16 AS {at}, CASE WHEN s.l IS NULL THEN now ELSE sha256(s.l || now || s.r) END AS now, beside || coalesce(s.l || s.r, '') AS beside) FROM f{x} f LEFT JOIN {tree}s{x % levels} s ON s.k = {key} AND s.i = f.{at})")
    head = ", ".join(out)
    return f"WITH {head} SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, now AS folded_root, now = root AS verified FROM f{2 * levels}, root"


def op12_sql() -> str:
    """The cheapest way through the grammar, turn by turn: of each state (nothing yet, after the system turn, user or assistant expected) the least cost and audit.

    A state is a text, six digits of cost and the audit, so the least text has the least cost and of those the least audit.
    """
    put = lambda v, cost, edit: f"lpad(CAST(CAST(left({v}, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || substr({v}, 7) || '{edit}'"
    inserted = lambda a, b: f"least({a}, {', '.join(put(x, 3, 'I') for x in b)})"
    # Two turns at most are inserted at one place.
    twice = f"""SELECT * REPLACE ({inserted('e', ['a'])} AS e, {inserted('a', 'nse')} AS a) FROM (SELECT * REPLACE ({inserted('e', ['a'])} AS e, {inserted('a', 'nse')} AS a) FROM {{}})"""
    stay = lambda kind, x: f"CASE WHEN gone THEN NULL WHEN kind = '{kind}' THEN {put(x, '(CASE WHEN broken THEN 3 ELSE 0 END)', 'K')} ELSE {put(x, '(CASE WHEN broken THEN 6 ELSE 3 END)', 'R')} END"
    system = f"CASE WHEN NOT gone AND kind = 's' THEN {put('n', '(CASE WHEN broken THEN 3 ELSE 0 END)', 'K')} END"
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    order = "turn NULLS FIRST, role, text, copy"
    turn = "substr(audit, CAST(p AS INT), 1)"
    row = "list_extract(lines, CAST(length(replace(substr(audit, 1, CAST(p AS INT)), 'I', '')) AS INT))"
    place = "(length(replace(substr(audit, 1, CAST(p AS INT) - 1), 'D', '')) - length(replace(audit, 'D', '')) % 2)"
    role = f"CASE WHEN {place} % 2 = 0 THEN 'user' ELSE 'assistant' END"
    line = f"CASE {turn} WHEN 'I' THEN {role} || ':' WHEN 'R' THEN {role} || ':' || {row}.text ELSE {row}.role || ':' || {row}.text END"
    return f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, {text('role')} AS role, {text('text')} AS text, {sql_crc32(f"({text('conv_id')} || ':' || {text('turn')})")} % 20 AS f FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM r WHERE f <> 0),
o AS (SELECT *, left(role, 1) AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY {order}) > 1 AS again, rtrim(text, {blanks}) AS bare FROM d),
t AS (SELECT *, bare = '' OR again AS gone, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS broken, lag(kind) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(count_if(bare = '') AS BIGINT) AS blank, CAST(count_if(bare <> '' AND again) AS BIGINT) AS duplicate, CAST(count_if(broken) AS BIGINT) AS truncated, CAST(count_if(before IS NOT NULL AND before || kind NOT IN ('su', 'ua', 'au')) AS BIGINT) AS illegal,
  count(*) AS turns, list({{'role': role, 'text': text}} ORDER BY i) AS lines FROM t GROUP BY 1),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000' AS n, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS e, CAST(NULL AS VARCHAR) AS a FROM g
  UNION ALL SELECT conv_id, i, {put('n', 4, 'D')}, least({put('s', 4, 'D')}, {system}), least({put('e', 4, 'D')}, {stay('a', 'a')}), least({put('a', 4, 'D')}, {stay('u', 'n')}, {stay('u', 's')}, {stay('u', 'e')})
  FROM (SELECT x.*, t.i AS i, kind, gone, broken FROM (SELECT * EXCLUDE (i), i AS done FROM ({twice.format('w')})) x JOIN t ON t.conv_id IS NOT DISTINCT FROM x.conv_id AND t.i = x.done + 1)),
z AS (SELECT conv_id, least(n, e) AS v FROM ({twice.format('(SELECT w.* FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND i = turns)')})),
q AS (SELECT g.*, CAST(left(v, 6) AS BIGINT) AS cost, substr(v, 7) AS audit FROM g JOIN z ON g.conv_id IS NOT DISTINCT FROM z.conv_id),
p AS (SELECT *, sha256(coalesce(array_to_string(list_transform(list_filter(range(1, length(audit) + 1), lambda p: {turn} <> 'D'), lambda p: {line}), chr(10)), '')) AS repaired_sha256 FROM q)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
"""
