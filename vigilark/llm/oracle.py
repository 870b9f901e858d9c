"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

# op6: the counts by list functions, repeated windows by grouping windows of each document
OP6 = r"""
with t as (select doc_id, row_number() over () as r, coalesce(text, '') as x from documents),
w as (select doc_id, r, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from t),
g as (select r, i, array_to_string(ws[i:i + 7], ' ') as g
      from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
s as (select r, i, count(*) over (partition by r, g) as n from g),
p as (select r, i, lead(i) over (partition by r order by i) as nx from s where n > 1),
c as (select r, sum(least(8, coalesce(nx - i, 8))) as n_repeat_words from p group by r),
m as (
  select doc_id, w.r, len(ws) as n_words,
         coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0) as word_chars,
         length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(ls) - len(list_distinct(ls)) as n_dup_lines,
         coalesce(c.n_repeat_words, 0) as n_repeat_words, len(ls) as n_lines,
         length(x) - length(replace(x, '!', '')) as n_exclaim,
         len(list_filter(ws, lambda v: list_contains([@STOPS@], v))) as n_stop,
         len(list_filter(ls, lambda l: regexp_matches(ltrim(l), '^[\-*•]\s'))) as n_bullet,
         len(list_filter(ls, lambda l: regexp_matches(rtrim(l), '(\.\.\.|…)$'))) as n_ellipsis
  from w left join c on w.r = c.r),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and coalesce(word_chars / n_words between 2 and 15, false) and n_symbols / n_words <= 0.1
         and n_exclaim / n_words <= 0.3 and n_stop / n_words >= 0.01 and n_dup_lines / n_lines <= 0.5
         and n_bullet / n_lines <= 0.9 and n_ellipsis / n_lines <= 0.3 as kept
from b
"""


def _stops() -> str:
    from vigilark.llm.quality_rules import STOP_WORDS
    both = dict.fromkeys(STOP_WORDS + tuple(x.capitalize() for x in STOP_WORDS))
    return ", ".join(f"'{w}'" for w in both)


ORACLE: dict[str, str] = {"op6_quality_rules": OP6.replace("@STOPS@", _stops())}

ORACLE["op13_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (
    SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase, k
    FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
scored AS (
    SELECT c.lang, c.phrase, c.k, c.a, x.f AS l, y.f AS r, cut,
           CAST(CAST(c.a AS HUGEINT) * c.a * 1000000 // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.cut], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.cut + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase
    FROM candidates WHERE k = 3),
left_over AS (
    SELECT * FROM lowest l WHERE NOT EXISTS (
        SELECT 1 FROM inside i WHERE i.lang = l.lang AND i.phrase = l.phrase AND l.k = 2 AND 100 * i.a >= 50 * l.a)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
