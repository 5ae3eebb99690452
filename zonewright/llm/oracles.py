"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from zonewright.llm import license_scan, line_dedup, quality_rules

SPACE = r"[\x20\x09-\x0D]"


def line_dedup_sql() -> str:
    bare = rf"regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g')"
    return f"""
WITH pages AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '>') AS host, text FROM documents),
lines AS (SELECT rid, doc_id, host, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM pages),
marked AS (SELECT *, {bare} AS bare FROM lines),
totals AS (SELECT host, count(*) AS pages FROM (SELECT DISTINCT host, text FROM pages) GROUP BY 1),
common AS (SELECT host, bare FROM (SELECT DISTINCT text, host, bare FROM marked WHERE bare <> '') JOIN totals USING (host)
  GROUP BY host, bare, pages HAVING count(*) >= {line_dedup.LEAST_PAGES} AND count(*) > {line_dedup.RATIO} * pages)
SELECT m.doc_id,
  CASE WHEN m.text IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.bare IS NULL), '') END AS text,
  CASE WHEN m.text IS NOT NULL THEN count(*) ELSE 0 END AS n_lines,
  CASE WHEN m.text IS NOT NULL THEN count(c.bare) ELSE 0 END AS n_dropped
FROM marked m LEFT JOIN common c ON c.host = m.host AND c.bare = m.bare GROUP BY m.rid, m.doc_id, m.text"""


def quality_rules_sql() -> str:
    q = quality_rules
    rate = lambda n, d, rare: f"1000 * sqrt(({n} + 0.375::DOUBLE) / {d})" if rare else f"1000 * ({n} / {d})"
    measures = ", ".join(f"CAST(CASE WHEN {d} > 0 THEN floor({rate(n, d, rare)}) ELSE 0 END AS BIGINT) AS v_{m}" for m, (n, d, rare, _) in q.MEASURES.items())
    pairs = " UNION ALL ".join(f"SELECT lang_key, source_key, '{m}' AS measure, v_{m} AS v FROM judged WHERE NOT base_failed" for m in q.MEASURES)
    bits, bins = q.BIN_BITS, 1 << q.BIN_BITS
    start = f"CASE WHEN {{0}} < {2 * bins} THEN {{0}} ELSE ({{0}} - {bins} * ({{0}} // {bins} - 1)) << ({{0}} // {bins} - 1) END".format

    def quartiles(name: str, source: str, keys: str) -> str:
        part = f"PARTITION BY {keys}" if keys else ""
        group = f"{keys}" if keys else "measure"
        return f"""{name}_r AS (SELECT *, sum(n) OVER ({part} ORDER BY bin) AS upto, sum(n) OVER ({part}) AS total FROM {source}),
{name}_b AS (SELECT {group}, max(total) AS n, min(bin) FILTER (WHERE 4 * upto >= total) AS b1, min(bin) FILTER (WHERE 4 * upto >= 3 * total) AS b3 FROM {name}_r GROUP BY {group}),
{name} AS (SELECT {group}, n, {start("b1")} AS q1, {start("b3")} AS q3 FROM {name}_b)"""

    toward = lambda n, own, prior: f"(({n}::DOUBLE * {own}::DOUBLE + {q.PRIOR_DOCUMENTS} * {prior}) / ({n}::DOUBLE + {q.PRIOR_DOCUMENTS}))"
    weighed = lambda x: toward("f.n", f"f.{x}", toward("c.n", f"c.{x}", f"t.{x}::DOUBLE"))
    inside = []
    for m, (count, of, rare, both) in q.MEASURES.items():
        q1, q3 = (f"(SELECT {x} FROM picked t WHERE t.lang_key = j.lang_key AND t.source_key = j.source_key AND measure = '{m}')" for x in ("q1", "q3"))
        chance = f"{q.CHANCE}::DOUBLE / sqrt({of})" if rare else f"{q.CHANCE}::DOUBLE * ({count} / {of}) / sqrt({of})"
        reach = f"{q.RANGES} * greatest({q3} - {q1}, CASE WHEN {of} > 0 THEN {chance} ELSE 0 END)"
        inside.append(f"v_{m} <= {q3} + {reach}")
        if both:
            inside.append(f"v_{m} >= {q1} - {reach}")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '>') AS lang_key, coalesce('=' || source, '>') AS source_key, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)),
windows AS (SELECT rid, pos, word, CASE WHEN lead(word, 2) OVER o IS NOT NULL THEN [word, lead(word, 1) OVER o, lead(word, 2) OVER o] END AS win FROM words WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos, word, win IS NOT NULL AND count(*) OVER (PARTITION BY rid, win) > 1 AS again FROM windows),
word_counts AS (SELECT rid, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (WHERE inside) AS n_repeat_words
  FROM (SELECT rid, word, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS inside FROM twice WINDOW o AS (PARTITION BY rid ORDER BY pos)) GROUP BY rid),
line_counts AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
counts AS (SELECT d.*, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper FROM docs d LEFT JOIN word_counts USING (rid) LEFT JOIN line_counts USING (rid)),
judged AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {measures} FROM counts),
each AS ({pairs}),
sketch AS (SELECT lang_key, source_key, measure, CAST(CASE WHEN v < {2 * bins} THEN v ELSE {bins} * (length(bin(v)) - 1 - {bits}) + (v >> (length(bin(v)) - 1 - {bits})) END AS BIGINT) AS bin, count(*) AS n FROM each GROUP BY 1, 2, 3, 4),
lang_sketch AS (SELECT lang_key, measure, bin, CAST(sum(n) AS BIGINT) AS n FROM sketch GROUP BY 1, 2, 3),
all_sketch AS (SELECT measure, bin, CAST(sum(n) AS BIGINT) AS n FROM lang_sketch GROUP BY 1, 2),
{quartiles("fine", "sketch", "lang_key, source_key, measure")},
{quartiles("coarse", "lang_sketch", "lang_key, measure")},
{quartiles("total", "all_sketch", "measure")},
picked AS (SELECT f.lang_key, f.source_key, f.measure, {weighed("q1")} AS q1, {weighed("q3")} AS q3
  FROM fine f JOIN coarse c ON c.lang_key = f.lang_key AND c.measure = f.measure JOIN total t ON t.measure = f.measure)
SELECT doc_id, {", ".join(q.COUNTS)}, base_failed, coalesce(NOT base_failed AND {" AND ".join(inside)}, false) AS kept FROM judged j"""


def license_scan_sql() -> str:
    s = license_scan
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    rules = ", ".join(f"({n}, {quote(label)}, {quote(word)}, {quote(regex)}, {of_text})" for n, label, word, regex, of_text in s.rules())
    gate = " OR ".join(f"contains(words, {quote(g)})" for g in (*s.GATES, *s.GATES_OF_TEXTS))
    fits = lambda where, signs: " OR ".join(f"{where}_with(match, {quote(x)})" for x in signs)
    rank = lambda k: f"CASE WHEN of_text THEN {s.OF_TEXT[k]} " + " ".join(f"WHEN {fits(w, signs)} THEN {(p, c)[k]}" for w, signs, p, c in s.RANKS) + f" ELSE {s.OF_NAME_ALONE[k]} END"
    spaces = "CAST((length({0}) - length(replace({0}, ' ', ''))) // 2 AS BIGINT)".format
    phrases = ", ".join(f"({quote(' ' + p.replace(' ', '  ') + ' ')}, {quote(label)})" for p, label in s.BASE_PHRASES.items())
    return f"""
WITH lowered AS (SELECT row_number() OVER () AS rid, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{s.NOT_WORD}', '  ', 'g')) AS bare FROM documents),
docs AS (SELECT rid, doc_id, CASE WHEN bare <> '' THEN ' ' || bare || ' ' ELSE '' END AS words FROM lowered),
rules(number, label, keyword, regex, of_text) AS (VALUES {rules}),
phrases(phrase, label) AS (VALUES {phrases}),
split AS (SELECT rid, string_split(words, phrase) AS pieces, phrase, label FROM docs, phrases WHERE contains(words, phrase)),
base AS (SELECT rid, label, {spaces("array_to_string(pieces[1:i], '')")} + (i - 1) * {spaces("phrase")} AS s0 FROM (SELECT rid, label, phrase, pieces, unnest(range(1, len(pieces))) AS i FROM split)),
base_sums AS (SELECT rid, count(*) AS n_base, min(s0) AS first_word, max(s0) AS last_word, list(DISTINCT label) AS base_labels FROM base GROUP BY 1),
found AS (SELECT rid, number, label, of_text, regexp_extract_all(words, regex) AS m, string_split_regex(words, regex) AS p FROM docs, rules WHERE ({gate}) AND len(list_filter(string_split(keyword, '|'), lambda k: contains(words, k))) > 0 AND regexp_matches(words, regex)),
matched AS (SELECT rid, number, label, of_text, m[i] AS match, {spaces("array_to_string(p[1:i], '')")} + {spaces("array_to_string(m[1:i - 1], '')")} AS s0 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
spans AS (SELECT rid, number, label, {rank(0)} AS priority, {rank(1)} AS confidence, s0, s0 + {spaces("match")} AS s1 FROM matched),
kept AS (SELECT * FROM spans d WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.rid = d.rid AND o.s0 <= d.s0 AND o.s1 >= d.s1 AND o.priority >= d.priority
  AND (o.s0, -o.s1, -o.priority, o.number) < (d.s0, -d.s1, -d.priority, d.number))),
own AS (SELECT rid, list(DISTINCT label) AS own_labels, max(confidence) AS best, count(*) AS n_spans FROM kept GROUP BY 1)
SELECT d.doc_id, {spaces("words")} AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base_labels, own_labels))), ','), '') AS labels,
  CAST(greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN {s.BASE_CONFIDENCE} ELSE 0 END) AS DOUBLE) AS score, coalesce(n_spans, 0) AS n_spans
FROM docs d LEFT JOIN base_sums b ON b.rid = d.rid LEFT JOIN own o ON o.rid = d.rid"""


def nearest_neighbours_sql() -> str:
    return """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10"""
